"""Queries on repeated tables, where small ones have no case of what differed from the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.plans.assembly import contact_counts, contacts
from gridloom.plans.registry import QUERIES, SQL
from tools_compare import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def thick(tmp_path_factory):
    """Every cell filled, high and of one line number; rows that repeat a placement's key."""
    out = tmp_path_factory.mktemp("thick")
    db = duckdb.connect()
    db.execute(f"COPY (SELECT * FROM '{SF}/orders.parquet') TO '{out}/orders.parquet'")
    db.execute(f"COPY (SELECT l_orderkey, ((l_orderkey * 7 + o * 11) % 64)::BIGINT AS l_partkey, l_suppkey, 7::INTEGER AS l_linenumber, 50.0::DOUBLE AS l_quantity, l_returnflag FROM (SELECT i * 64 + j AS l_orderkey, i % 9 AS l_suppkey, 'A' AS l_returnflag, o FROM range(64) a(i), range(64) b(j), range(70) c(o))) TO '{out}/lineitem.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["object_distances", "road_verdicts", "rendered_records"])
def test_thick_cells_equal_sql(spark, thick, name):
    db = duckdb.connect()
    db.execute("SET threads = 1")  # which of equal keys DISTINCT ON keeps is open with more
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{thick}/{t}.parquet'")
    df = QUERIES[name](spark, thick)
    cur = db.execute(SQL[name])
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), [d[0] for d in cur.description])


def test_contacts_of_copies_and_several_groups(spark):
    """Copies on one floor, and pieces that stand in more than one group."""
    cells = [(g, i, i % 3 + x, g + y) for g, i in [(0, 1), (0, 2), (0, 4), (0, 7), (1, 1), (1, 4), (1, 5), (2, 4), (2, 1)] for x in range(2) for y in range(1 + i % 2)]
    floors = spark.createDataFrame(cells, "grp long, id long, cx long, cy long")
    grown = {(g, i, x + dx, y + dy) for g, i, x, y in cells for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    want = {}
    for g, a, x, y in grown:
        for h, b, u, v in cells:
            if (g, x, y) == (h, u, v) and a != b:
                want[a, b] = want.get((a, b), 0) + 1
    want = {k: n for k, n in want.items() if n >= 3}
    assert {(r["a"], r["b"]): r["shared"] for r in contacts(floors).collect()} == want
    counted = {r["shared"]: r["n"] for r in contact_counts(floors).collect()}
    assert counted == {n: list(want.values()).count(n) for n in want.values()}


def test_overlaps_join_no_pieces(spark):
    """Twenty copies of a floor are one place: no join makes rows for pairs of pieces."""
    floors = spark.createDataFrame([(0, i, x, y) for i in range(20) for x in range(3) for y in range(4)], "grp long, id long, cx long, cy long")
    from gridloom.plans.assembly import trace_pairs

    assert trace_pairs(floors, 3)[1].agg(F.count(F.lit(1))).first()[0] == 1
    assert [tuple(r) for r in contact_counts(floors).collect()] == [(12, 380)]
