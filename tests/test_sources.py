import random

import numpy as np
import pytest

from gridloom.sources import codecs
from gridloom.sources.world import LAYERS, WorldSource


def test_grid_layers_round_trip():
    rng = np.random.default_rng(1)
    height = rng.integers(0, 65536, (131, 131)).astype("<u2").tobytes() + b"xyz"
    assert codecs.write_plain(codecs.read_height(height)) == height
    tile = rng.integers(0, 256, 258 * 258).astype("u1").tobytes() + b"\1\2\3"
    assert codecs.write_plain(codecs.read_tile(tile)) == tile and codecs.read_tile(tile).tail == b"\1\2\3"
    attr = codecs.write_attr(codecs.Grid(rng.integers(0, 256, (256, 256)).astype("u1")))
    assert len(attr) == 65_542 and codecs.write_attr(codecs.read_attr(attr)) == attr
    with pytest.raises(ValueError):
        codecs.read_tile(tile[:1000])
    with pytest.raises(ValueError):
        codecs.read_attr(b"\0" * 70_000)


@pytest.mark.parametrize("short", [False, True])
def test_water(short):
    water = codecs.Water(np.random.default_rng(2).integers(0, 2, (128, 128)).astype("u1"), [12_345, 678], short)
    data = codecs.write_water(water)
    back = codecs.read_water(data)
    assert back.heights == [12_345, 678] and back.short == short and codecs.write_water(back) == data


def test_lzo():
    rng = random.Random(4)
    noise = rng.randbytes(3000)
    cases = [b"", b"a", b"abc", b"A" * 5000, noise + b"B" * 900 + noise, b"\0" * 70_000, noise[:200] + rng.randbytes(20_000) + noise[:200], b"abcd" * 3 + noise[:5] + b"abcd" * 80]
    for case in cases:
        assert codecs.lzo_decompress(codecs.lzo_compress(case), len(case)) == case
    blocks = [np.random.default_rng(i).integers(0, 3, (128, 128)).astype("<u4") for i in range(2)]
    w, h, back = codecs.read_server_attr(codecs.write_server_attr(2, 1, blocks))
    assert (w, h) == (2, 1) and all((a == b).all() for a, b in zip(blocks, back, strict=True))
    with pytest.raises(ValueError):
        codecs.lzo_decompress(b"\x20")


def test_lzo_short_references():
    # A stream by hand: 4 literals, a 2048-window match of 5, the end marker.
    assert codecs.lzo_decompress(bytes([21]) + b"abcd" + bytes([0x8C, 0x00]) + b"\x11\0\0") == b"abcdabcda"


def test_dxt_and_pixels():
    solid = bytes([0x00, 0xF8, 0x00, 0xF8, 0, 0, 0, 0])  # pure red, every index 0
    assert codecs.read_dxt(solid, 4, 4, "DXT1")[0, 0].tolist() == [255, 0, 0, 255]
    assert codecs.read_dxt(b"\xff" * 8 + solid, 3, 2, "DXT3").shape == (2, 3, 4)
    assert codecs.read_dxt(bytes([10, 200, 0, 0, 0, 0, 0, 0]) + solid, 4, 4, "DXT5")[0, 0, 3] == 10
    assert codecs.rgb555(np.array([0x7FFF, 0]))[0].tolist() == [255, 255, 255]


def test_text_layers():
    record = {"ordinal": 0, "x": 100.5, "y": -200.0, "z": 3.0, "crc": 2_718_281_828, "yaw": 90.0, "pitch": 0.0, "roll": 45.0, "bias": -12.5, "portals": [3, 4], "scale": [0.75, 0.5, 1.25]}
    plain = record | {"ordinal": 1, "portals": [], "scale": [1.0, 1.0, 1.0]}
    assert codecs.read_placements(codecs.write_placements([record, plain])) == [record, plain]
    short = b"AreaDataFile\r\nObjectCount 2\r\nStart Object000\r\n1 2 3\r\n7\r\nEnd Object\r\nStart Object001\r\n1 2 3\r\n8 45.0\r\nEnd Object"
    assert [(r["crc"], r["roll"]) for r in codecs.read_placements(short)] == [(7, 0.0), (8, 45.0)]
    with pytest.raises(ValueError):
        codecs.read_placements(b"ObjectCount 1\nStart Object000\n1 2 3\nEnd Object")
    palette = b'TextureSet\nTextureCount 3\nStart Texture001\n"a b.dds" 4 4 0 0 1 0 0\nEnd\nStart Texture003\nc.dds 2 2 0 0 0 0 0\nEnd'
    assert [(p["slot"], p["path"]) for p in codecs.read_palette(palette)] == [(1, "a b.dds"), (3, "c.dds")]
    setting = codecs.read_setting(b"ScriptType MapSetting\nCellScale 200\nHeightScale 0.5\nMapSize 2 3\nMapSize 9 9\nFoo bar")
    assert setting["size"] == [2, 3] and setting["extras"] == {"foo": ["bar"]}
    assert codecs.read_property(b'YPRT\r\n123\r\nname\t"x y"\r\nname\t"z"\r\n') == {"crc": 123, "values": {"name": ["x y"]}}
    spawns = codecs.read_spawns(b"// head\nm 1 2 3 4 0 0 1h30m 100 2 101\ne 1 2 3\n4 0\nga 5 6 1 1 0 1 60s 1 1 7")
    assert [s["type"] for s in spawns] == ["m", "e", "ga"] and spawns[0]["time"] == "1h30m" and spawns[1]["vnum"] is None


def test_world_source(spark, tmp_path):
    spark.dataSource.register(WorldSource)
    rows = [("m1", sx, sy, 131, [(sx * 7 + i) % 65_536 for i in range(131 * 131)], bytearray(b"t")) for sx in range(2) for sy in range(2)]
    table = spark.createDataFrame(rows, "map string, sx int, sy int, side int, raw array<int>, tail binary")
    table.write.format("world").option("layer", "height").mode("append").save(str(tmp_path))
    back = spark.read.format("world").option("layer", "height").load(str(tmp_path))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))
    assert spark.read.format("world").option("layer", "height").option("map", "none").load(str(tmp_path)).count() == 0
    folder = tmp_path / "m1" / "000000"
    (folder / "areadata.txt").write_bytes(b"AreaDataFile\r\nObjectCount 1\r\nStart Object000\r\n1 -2 3\r\n7\r\nEnd Object")
    placed = spark.read.format("world").option("layer", "placements").load(str(tmp_path)).collect()
    assert [(r["sx"], r["crc"], r["y"]) for r in placed] == [(0, 7, -2.0)]
    # A folder too deep is no sector; the first map only; no temporary files stay.
    deep = folder / "000001"
    deep.mkdir()
    (deep / "height.raw").write_bytes((folder / "height.raw").read_bytes())
    more = rows[:1] + [("m0", 0, 0, 131, [1] * 131 * 131, bytearray())]
    spark.createDataFrame(more, table.schema).write.format("world").option("layer", "height").mode("append").save(str(tmp_path))
    read = spark.read.format("world").option("layer", "height")
    assert read.load(str(tmp_path)).count() == 5 and [r["map"] for r in read.option("limit", "1").load(f"file://{tmp_path}").collect()] == ["m0"]
    assert not list(tmp_path.rglob(".height*"))
    records = spark.createDataFrame([("m1", 1, 1, i, 1.0 * i, -2.0, 0.0, 5 + i, 0.0, 0.0, 0.0, 0.0, [], [1.0, 1.0, 1.0]) for i in range(3)], LAYERS["placements"][2])
    records.repartition("map", "sx", "sy").write.format("world").option("layer", "placements").mode("append").save(str(tmp_path))
    back = spark.read.format("world").option("layer", "placements").option("map", "m1").load(str(tmp_path))
    assert sorted(map(str, back.filter("sx = 1").collect())) == sorted(map(str, records.collect()))


def test_block_images():
    from gridloom.sources import images

    rng = np.random.default_rng(5)
    two = np.array([[200, 40, 90, 255], [16, 120, 240, 255]], np.uint8)
    picture = two[rng.integers(0, 2, (16, 12))]
    back = codecs.read_dds(images.write_dds(picture))
    assert back.shape == picture.shape and np.abs(back.astype(int) - picture).max() <= 8  # two colours: the ends
    smooth = np.zeros((9, 7, 4), np.uint8)
    smooth[..., 0], smooth[..., 3] = np.linspace(0, 255, 63).reshape(9, 7), 255
    assert np.abs(codecs.read_dds(images.write_dds(smooth)).astype(int) - smooth).mean() < 12
    clear = picture.copy()
    clear[0, 0, 3] = 0
    assert codecs.read_dds(images.write_dds(clear))[0, 0, 3] == 0
    stored = images.read_levels(images.write_dds(picture, mips=True))
    assert [x.shape[:2] for x in stored] == [x.shape[:2] for x in images.levels(picture)] and stored[-1].shape == (1, 1, 4)
    tile = images.Overview.read(images.write_dds(picture))
    assert tile.pixels.shape == (16, 12, 4) and tile.bounds(2, 1) == (51_200, 25_600, 76_800, 51_200)


def test_property_registry(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridloom.sources import registry

    (tmp_path / "b" / "c").mkdir(parents=True)
    (tmp_path / "a.prt").write_bytes(b'YPRT\r\n11\r\nname\t"old"\r\n')
    (tmp_path / "b" / "c" / "z.prb").write_bytes(b'YPRT\r\n11\r\nname\t"new"\r\n')
    (tmp_path / "b" / "other.prt").write_bytes(b'YPRT\r\n12\r\nname\t"x"\r\n')
    (tmp_path / "b" / "bad.prt").write_bytes(b"junk")
    scanned = registry.scan_properties(spark, str(tmp_path))
    assert scanned.count() == 4 and scanned.filter("problem IS NOT NULL").count() == 1
    assert {r["crc"]: r["values"]["name"] for r in registry.registry(scanned).collect()} == {11: ["new"], 12: ["x"]}
    names = spark.createDataFrame([("plain",), ("공용".encode("cp949").decode("latin-1"),), ("é",), (None,)], "n string")
    assert [r[0] for r in names.select(registry.repaired(F.col("n"))).collect()] == ["plain", "공용", "é", None]


def test_folders(tmp_path):
    from gridloom import config

    file = tmp_path / "folders.json"
    file.write_text('{"worlds": "/file", "models": "/models"}')
    got = config.folders(file, {"GRIDLOOM_WORLDS": "/env"}, {"output": "/out", "models": "/default"})
    assert got == {"worlds": "/env", "models": "/models", "output": "/out"}
    with pytest.raises(KeyError):
        config.required("palettes", got)
    file.write_text('{"wrlds": "/x"}')
    with pytest.raises(ValueError):
        config.folders(file, {})
