"""Grid kernels on small constructed grids, and scalar expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import graph, raster, rules, spatial


def test_components_connectivity():
    mask = np.zeros((6, 6), bool)
    mask[0:2, 0:2] = mask[2:4, 2:4] = True  # a diagonal touch
    assert len(np.unique(graph.labels(mask))) == 3 and len(np.unique(graph.labels(mask, diagonal=True))) == 2
    board = np.indices((8, 8)).sum(0) % 2 == 0
    assert graph.labels(board).max() > 0 and len(np.unique(graph.labels(board))) == 33
    rng = np.random.default_rng(0)
    for _ in range(5):
        m = rng.random((30, 30)) > 0.45
        assert len(np.unique(graph.labels(m))) == len(np.unique(graph.labels(m.T)))
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert len(np.unique(graph.labels(u))) == 2


def test_chamfer_close_to_euclid():
    mask = np.zeros((40, 40), bool)
    mask[20, 20] = True
    d = graph.chamfer(mask)
    y, x = np.indices(mask.shape)
    exact = np.hypot(y - 20, x - 20)
    assert d[20, 20] == 0 and np.all(np.abs(d - exact) <= 0.03 * exact + 1e-9)


def test_thinning_keeps_lines_and_components():
    ribbon = np.zeros((12, 40), bool)
    ribbon[4:9, 2:38] = True
    thin = graph.thinned(ribbon)
    assert thin.sum() < ribbon.sum() / 3 and len(np.unique(graph.labels(thin, diagonal=True))) == 2 and not (thin & ~ribbon).any()


def test_forms_spectrum_and_plane():
    y, x = np.meshgrid(np.linspace(-1, 1, 33), np.linspace(-1, 1, 33), indexing="ij")
    for z, form in ((x * x + y * y, "basin"), (-x * x - y * y, "dome"), (x * x - y * y, "saddle"), (3 * x + y, "planar"), (x * x, "trough"), (-x * x, "ridge")):
        assert graph.quadratic_form(10 * z)["form"] == form
    assert graph.radial_power(np.sin(np.arange(64) * 0.2)[None].repeat(64, 0))[0] > 0.9


def test_route_and_scatter():
    cost = np.ones((9, 9))
    cost[:8, 4] = 1000
    total, path = graph.route(cost, (0, 0), (0, 8))
    assert (8, 4) in path and total < 30
    spots = graph.scatter(np.ones((40, 40), bool), 4.0, 7)
    gaps = np.linalg.norm(spots[:, None] - spots[None], axis=-1) + np.eye(len(spots)) * 99
    assert gaps.min() >= 4 and len(spots) > 40 and (spots == graph.scatter(np.ones((40, 40), bool), 4.0, 7)).all()
    assert (graph.value_noise((16, 16), 3) == graph.value_noise((16, 16), 3)).all()


def test_slope_of_a_ramp(spark):
    ramp = spark.range(8).select(F.lit("m").alias("map"), F.col("id").cast("int").alias("gx")).select("map", "gx", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("gy"))
    got = raster.slopes(ramp.withColumn("h", F.col("gx").cast("long")), 200.0, 0.5).select("slope").distinct().collect()
    assert len(got) == 1 and got[0][0] == pytest.approx(np.degrees(np.arctan(0.5 / 200)))


def test_radius_pairs_and_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)))] + [(900, 9, 5.0, 5.0), (901, 3, 0.5, 0.5), (902, 3, 0.5, 0.5)]
    pts = spark.createDataFrame(rows, "id long, label int, x double, y double")
    got = {(r["a"], r["b"]) for r in spatial.radius_pairs(pts, 0.1).collect()}
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 0.1 * 0.1}
    assert got == want
    for r in spatial.nearest(pts, 0.02).collect():
        me = next(p for p in rows if p[0] == r["id"])
        d = [((p[2] - me[2]) ** 2 + (p[3] - me[3]) ** 2, p[1] == me[1]) for p in rows if p[0] != me[0]]
        same, other = min((v for v, s in d if s), default=None), min(v for v, s in d if not s)
        assert r["other"] == pytest.approx(other) and (r["same"] == pytest.approx(same) if same is not None else r["same"] is None)


def test_scalars(spark):
    row = spark.createDataFrame([("1h30m", " -12abc", "3.5e2x", "90#0#45", "7")], "d string, i string, f string, r string, b string").select(
        scalar.duration_seconds(F.col("d")).alias("d"), scalar.leading_int(F.col("i")).alias("i"), scalar.leading_float(F.col("f")).alias("f"), scalar.leading_int(F.col("d")).alias("j"),
        scalar.rotation(F.col("r")).alias("r"), scalar.rotation(F.col("b")).alias("b"), scalar.unsigned32(F.lit(-1)).alias("u"), scalar.duration_text(F.lit(5400)).alias("t"),
        scalar.sector_name(F.lit(1), F.lit(2)).alias("s"), scalar.stream_seed("terrain", F.lit(4242)).alias("seed"), scalar.snap_residual(F.lit(-14.0), 15.0).alias("snap"),
        scalar.share(F.lit(1), F.lit(0)).alias("none"), scalar.has_flag(F.lit(0xC9), 1).alias("flag"), scalar.clear_flag(F.lit(0xC9), 1).alias("clear"),
    ).first()
    assert (row["d"], row["i"], row["f"], row["j"]) == (5400, -12, 350.0, 1)
    assert tuple(row["r"]) == (90.0, 0.0, 45.0) and tuple(row["b"]) == (0.0, 0.0, 7.0)
    assert (row["u"], row["t"], row["s"], row["seed"]) == (0xFFFFFFFF, "1h30m", "001002", 162_036_731)
    assert row["snap"] == pytest.approx(1.0) and row["none"] == 0.0 and row["flag"] and row["clear"] == 0xC8


def test_report_order(spark):
    t = spark.range(1)
    make = lambda rule, sev: rules.finding(t, rule, sev, F.lit("x"), "s", F.lit(1), "f")
    out = rules.report(make("B", "minor"), make("A", "blocker"), make("C", "major"))
    assert [r["rule"] for r in out.orderBy(*rules.by_severity(out)).collect()] == ["A", "C", "B"]


def test_streaming_counts(spark, tmp_path):
    from gridloom.streaming.events import tumbling_counts

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    q = tumbling_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == source.count()


def test_staged_build_with_re_entry(spark, tmp_path):
    from gridloom.operators import stages

    done = []

    def step(name, table):
        return name, lambda s, t: done.append(name) or table(s, t)

    steps = [step("a", lambda s, t: s.range(5)), step("b", lambda s, t: t["a"].filter("id > 1")), step("c", lambda s, t: t["b"].selectExpr("id * 2 AS id"))]
    assert sorted(r["id"] for r in stages.build(spark, steps, str(tmp_path))["c"].collect()) == [4, 6, 8]
    again = stages.build(spark, steps, str(tmp_path), start="c")
    assert again["c"].count() == 3 and done == ["a", "b", "c", "c"]
    with pytest.raises(ValueError):
        stages.build(spark, steps, str(tmp_path), start="x")
    made = [stages.cached(spark, f"{tmp_path}/kept", lambda n=n: spark.range(n), rescan=n == 9).count() for n in (3, 5, 9)]
    assert made == [3, 3, 9]
