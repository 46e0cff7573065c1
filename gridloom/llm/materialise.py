"""Training-order materialisation of token sequences into fixed-stride shards.

Documents are tokenised once; each task's token stream is cut into sequences of
``stride`` tokens, the task's last one possibly shorter, which are stored compressed. A
stored row's dense number is its file's offset, from per-file counts, plus its row index,
both fixed once the files exist. A keyed Feistel permutation over the next power of four,
walked until it lands below the number of sequences, turns that number into the
sequence's global slot: a bijection, so slots are dense and their ranges are known by
arithmetic, without a sample. Rows are range-partitioned by slot, a few whole shards a
task, and sorted; each task writes whole shards of fixed-stride records: slot s is record
s mod shard_slots of its shard, so any range of slots is read sequentially and a run
resumes from a slot number alone.

Shards are written under a temporary name and moved, with the same bytes on any attempt.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import delete_path, path_exists, shared_dir
from gridloom.llm.tokens import token_ids


def feistel_slots(numbers: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of the dense numbers below ``total``: a permutation of 0..total-1."""
    half = max(1, -(-max(1, total - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while len(walk := np.flatnonzero(out >= np.uint64(total))):
            out[walk] = once(out[walk])
    return out.astype(np.int64)


PIECES = "array<struct<doc_id:bigint,start:bigint,offset:int,length:int>>"


def sequences(docs: DataFrame, vocabulary: str, stride: int, end_id: int) -> DataFrame:
    """(length, ids_crc32, pieces, packed): zstd-packed 16-bit ids and what they are of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        parts: list[np.ndarray] = []
        pieces: list[dict] = []
        held = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal parts, pieces, held
            ids = np.concatenate(parts).astype("<u4", copy=False)
            if ids.max() > 0xFFFF:
                raise ValueError("token ids above 65535 do not fit the shards' 16 bits")
            out.append((held, zlib.crc32(ids), pieces, press.compress(ids.astype("<u2").tobytes())))
            parts, pieces, held = [], [], 0

        def table() -> pd.DataFrame:
            nonlocal out
            frame = pd.DataFrame(out, columns=["length", "ids_crc32", "pieces", "packed"])
            out = []
            return frame

        for batch in batches:
            names = batch["id"].astype(object).where(batch["id"].notna(), None).tolist()
            for doc_id, own in zip(names, token_ids(vocabulary, batch["text"].tolist()), strict=True):
                data = np.append(own, np.uint32(end_id))
                total, at = len(data), 0
                while at < total:
                    n = min(stride - held, total - at)
                    parts.append(data[at : at + n])
                    pieces.append({"doc_id": doc_id, "start": at, "offset": held, "length": n})
                    held, at = held + n, at + n
                    if held == stride:
                        close()
                if len(out) >= 1000:
                    yield table()
        if held:
            close()
        yield table()

    return docs.mapInPandas(run, f"length int, ids_crc32 long, pieces {PIECES}, packed binary")


def materialise(
    docs: DataFrame,
    vocabulary: str,
    out_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    stride: int = 2048,
    shard_slots: int = 4096,
    key: int = 20_240_501,
    end_id: int = 0,
    task_slots: int = 8192,
) -> DataFrame:
    """Writes ``out_dir``/shard-NNNNNN.bin and returns the manifest, one row a sequence.

    Rows: slot, shard, record, length, ids_crc32, pieces (doc_id, start in the document,
    offset in the sequence, length). Record bytes: the length as unsigned 16 bits, then
    ``stride`` unsigned 16-bit ids, zero-padded.

    * null and empty texts give the end id alone; rows that repeat an id are pieces of
      their own; a null id stays null; long texts run over as many sequences as they need;
    * an empty table writes no shard and gives no rows; other columns are ignored;
    * ids above 65,535 do not fit a record and raise an error;
    * sequences follow the order of rows inside the input's partitions, so another split
      of the same rows into files gives other sequences and slots;
    * a call that was broken off is taken up by calling again with the same folder and
      arguments: the stored sequences and every finished shard are kept;
    * a task writes whole shards of about ``task_slots`` records, whatever their number.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = f"{out_dir}/sequences"
    if not path_exists(spark, f"{kept}/_SUCCESS"):
        sequences(rows, vocabulary, stride, end_id).write.mode("overwrite").option("compression", "none").parquet(kept)
    stored = spark.read.parquet(kept).withColumn("file", F.col("_metadata.file_name")).withColumn("row", F.col("_metadata.row_index"))
    # A row for each file, thus for each task that wrote: as many as the driver tracked anyway.
    files = sorted(tuple(r) for r in stored.groupBy("file").agg(F.count(F.lit(1)).alias("rows")).collect())
    offsets, total = {}, 0
    for name, count in files:
        offsets[name] = total
        total += count
    before = spark.sparkContext.broadcast(offsets)

    @F.pandas_udf("long")
    def slot_of(file: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(feistel_slots(file.map(before.value).to_numpy() + row.to_numpy(), total, key))

    shards = -(-total // shard_slots)
    per_task = max(1, task_slots // shard_slots)
    placed = (
        stored.withColumn("slot", slot_of("file", "row"))
        .withColumn("shard", F.expr(f"cast(slot div {shard_slots} as int)"))
        .select("length", "ids_crc32", "pieces", "packed", "slot", "shard")
    )
    ranged = placed.repartitionById(max(1, -(-shards // per_task)), F.expr(f"shard div {per_task}").cast("int")).sortWithinPartitions("slot")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)
        unpack = zstandard.ZstdDecompressor()
        open_shard, sink, name, temp = -1, None, "", ""

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(temp, name)

        def finished(shard: int) -> bool:
            """Whether an earlier attempt has left the whole shard; its bytes are the same."""
            slots = min(shard_slots, total - shard * shard_slots)
            return store.get_file_info(f"{root}/shard-{shard:06d}.bin").size == slots * 2 * (stride + 1)

        try:
            for batch in batches:
                records = np.zeros((len(batch), stride + 1), "<u2")
                for i, packed in enumerate(batch["packed"]):
                    own = np.frombuffer(unpack.decompress(packed), "<u2")
                    records[i, 0], records[i, 1 : len(own) + 1] = len(own), own
                shard = batch["shard"].to_numpy()
                for at in [0, *(np.flatnonzero(np.diff(shard)) + 1)] if len(shard) else []:
                    if shard[at] != open_shard:
                        close()
                        open_shard, sink, name = shard[at], None, f"{root}/shard-{shard[at]:06d}.bin"
                        if not finished(int(open_shard)):
                            temp = f"{name}.{uuid.uuid4().hex}"
                            sink = store.open_output_stream(temp)
                    if sink is not None:
                        sink.write(records[at : at + int(np.searchsorted(shard[at:], open_shard, "right"))].tobytes())
                batch["record"] = batch["slot"] % shard_slots
                yield batch[["slot", "shard", "record", "length", "ids_crc32", "pieces"]]
        except BaseException:
            if sink is not None:  # a failed attempt leaves no file behind
                sink.close()
                store.delete_file(temp)
            raise
        close()

    manifest = ranged.mapInPandas(write, f"slot long, shard int, record int, length int, ids_crc32 long, pieces {PIECES}")
    written = f"{out_dir}/manifest"
    manifest.write.mode("overwrite").parquet(written)
    layout = json.dumps({"stride": stride, "shard_slots": shard_slots, "sequences": total, "key": key})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/layout")
    delete_path(spark, kept)  # the shards hold the same ids
    return spark.read.parquet(written)


def document_places(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest by document piece: where each run of a document's tokens stands."""
    rows = manifest.select("slot", "shard", "record", "ids_crc32", F.explode("pieces").alias("p"))
    return rows.select(F.col("p.doc_id").alias(id_col), F.col("p.start").alias("start"), F.col("p.length").alias("length"), "slot", "shard", "record", F.col("p.offset").alias("offset"), "ids_crc32")


def new_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gridloom/shards-{uuid.uuid4().hex}"


def read_slots(out_dir: str, first: int, count: int, stride: int = 2048, shard_slots: int = 4096) -> Iterator[np.ndarray]:
    """The ids of slots first, first + 1, ...: one seek per shard, then sequential reads."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)
    width = 2 * (stride + 1)
    while count > 0:
        shard, at = divmod(first, shard_slots)
        many = min(count, shard_slots - at)
        with store.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(at * width)
            for _ in range(many):
                record = f.read(width)
                if len(record) < width:
                    return
                row = np.frombuffer(record, "<u2")
                yield row[1 : 1 + int(row[0])].astype(np.int64)
        first, count = first + many, count - many
