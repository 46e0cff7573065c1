"""World folders as DataFrames: a ``world`` data source over the layer codecs.

    spark.dataSource.register(WorldSource)
    spark.read.format("world").option("layer", "height").load(folder)

Folders are map/sector/file; each sector's file is one input partition, so a corpus of
any number of maps reads in parallel, and ``map`` and ``layer`` prune whole files.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.sources import codecs

GRID = "map string, sx int, sy int, side int, raw array<int>, tail binary"
#: File name, decoder and schema of each layer.
LAYERS = {
    "height": ("height.raw", codecs.read_height, GRID),
    "tile": ("tile.raw", codecs.read_tile, GRID),
    "attr": ("attr.atr", codecs.read_attr, GRID),
    "shadow": ("shadowmap.raw", codecs.read_shadow, GRID),
    "water": ("water.wtr", codecs.read_water, "map string, sx int, sy int, side int, raw array<int>, heights array<int>, short boolean"),
    "placements": (
        "areadata.txt",
        codecs.read_placements,
        "map string, sx int, sy int, ordinal int, x double, y double, z double, crc long, yaw double, pitch double, roll double, bias double, portals array<int>, scale array<double>",
    ),
}
KEYS = ("map", "sx", "sy")
ENCODERS = {"height": codecs.write_plain, "tile": codecs.write_plain, "shadow": codecs.write_plain, "attr": codecs.write_attr}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a plain path or a URI of any store that Arrow reaches."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SectorFile(InputPartition):
    def __init__(self, name: str, sx: int, sy: int, path: str) -> None:
        self.map, self.sx, self.sy, self.path = name, sx, sy, path


class WorldReader(DataSourceReader):
    """One partition a sector file. Options: ``map`` and ``limit`` (maps, in order of their names).

    Sector folders one level too deep are not part of a map and are not read.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.layer = options["path"], options.get("layer", "height")
        self.only, self.limit = options.get("map"), options.get("limit")

    def partitions(self) -> list[SectorFile]:
        store, root = store_of(self.root)
        name, found = LAYERS[self.layer][0], defaultdict(list)
        top = f"{root.rstrip('/')}/{self.only}" if self.only else root
        for info in store.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
            parts = info.path.removeprefix(root.rstrip("/")).strip("/").split("/")
            if len(parts) == 3 and parts[1].isdigit() and parts[2] == name:
                found[parts[0]].append(SectorFile(parts[0], int(parts[1]) // 1000, int(parts[1]) % 1000, info.path))
        maps = sorted(found)[: int(self.limit)] if self.limit else sorted(found)
        return [s for m in maps for s in sorted(found[m], key=lambda s: s.path)] or [SectorFile("", 0, 0, "")]

    def read(self, partition: SectorFile):
        if not partition.path:
            return
        store, _ = store_of(self.root)
        with store.open_input_file(partition.path) as f:
            value = LAYERS[self.layer][1](f.read())
        key = (partition.map, partition.sx, partition.sy)
        if isinstance(value, codecs.Grid):
            yield (*key, value.values.shape[0], value.values.astype(np.int32).ravel().tolist(), value.tail)
        elif isinstance(value, codecs.Water):
            yield (*key, value.cells.shape[0], value.cells.astype(np.int32).ravel().tolist(), value.heights, value.short)
        else:
            for r in value:
                yield (*key, *r.values())


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) names of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WorldWriter(DataSourceWriter):
    """Files go under names of their own until the job commits; an aborted job leaves none.

    A grid layer has a row a sector; placement rows of a sector must be in one partition
    (``repartition("map", "sx", "sy")``).
    """

    def __init__(self, options: dict) -> None:
        self.root, self.layer = options["path"], options.get("layer", "height")

    def encoded(self, rows: list) -> bytes:
        if self.layer == "placements":
            return codecs.write_placements([{k: v for k, v in r.asDict(True).items() if k not in KEYS} for r in sorted(rows, key=lambda r: r["ordinal"])])
        (r,) = rows
        if self.layer == "water":
            return codecs.write_water(codecs.Water(np.array(r["raw"], "u1").reshape(r["side"], -1), r["heights"], r["short"]))
        dtype = "<u2" if self.layer in ("height", "shadow") else "u1"
        return ENCODERS[self.layer](codecs.Grid(np.array(r["raw"]).astype(dtype).reshape(r["side"], -1), bytes(r["tail"])))

    def write(self, rows) -> Written:
        store, root = store_of(self.root)
        name, done, held = LAYERS[self.layer][0], Written(), defaultdict(list)

        def put(key: tuple, own: list) -> None:
            folder = f"{root.rstrip('/')}/{key[0]}/{key[1] * 1000 + key[2]:06d}"
            store.create_dir(folder, recursive=True)
            temp = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as f:
                f.write(self.encoded(own))
            done.files.append((temp, f"{folder}/{name}"))

        for r in rows:
            key = tuple(r[k] for k in KEYS)
            if self.layer == "placements":
                held[key].append(r)
            else:
                put(key, [r])
        for key, own in held.items():
            put(key, own)
        return done

    def commit(self, messages: list[Written]) -> None:
        store, _ = store_of(self.root)
        for temp, final in (f for m in messages if m for f in m.files):
            store.move(temp, final)

    def abort(self, messages: list[Written]) -> None:
        store, _ = store_of(self.root)
        for temp, _ in (f for m in messages if m for f in m.files):
            if store.get_file_info(temp).type != fs.FileType.NotFound:
                store.delete_file(temp)


class WorldSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "world"

    def schema(self) -> str:
        return LAYERS[self.options.get("layer", "height")][2]

    def reader(self, schema) -> DataSourceReader:
        return WorldReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorldWriter(self.options)
