"""What the shingle join leaves and copies on disk."""

import time

from pyspark.sql import functions as F

from gridloom.llm import common, ngram_join
from test_operators import near_copy, syllables


def shuffle_blocks(spark) -> int:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def test_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_blocks(spark), spark.conf.get(common.CLEANUP)
    made = [common.stored(spark.range(1000).repartition(4, "id"), "test-shuffled") for _ in range(5)]
    until = time.time() + 20
    while shuffle_blocks(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_blocks(spark) <= before and spark.conf.get(common.CLEANUP) == setting
    assert [m.count() for m in made] == [1000] * 5


def test_pairs_of_parts_meet_once_in_few_copies(spark):
    rows = [(c, m, p, b"%d-%d" % (m, p), b"") for c, m in ((7, 7), (8, 8), (2, 2)) for p in range(m)]
    members = spark.createDataFrame(rows, "component long, parts int, part int, sig binary, shingles binary")
    met = []
    for least in range(5):
        got = [(r["grp"], r["side"], bytes(r["sig"])) for r in ngram_join.pairs_of_parts(members, least, least + 1).collect()]
        assert len(got) <= 2 * len(rows)
        groups = {}
        for grp, side, sig in got:
            groups.setdefault(grp, []).append((side, sig))
        met += [tuple(sorted(g)) for g in groups.values()]
    whole = [((-1, b"%d-%d" % (m, p)),) for m in (7, 8, 2) for p in range(m)]
    pairs = [((0, b"%d-%d" % (m, p)), (1, b"%d-%d" % (m, o))) for m in (7, 8, 2) for p in range(m) for o in range(p + 1, m)]
    assert sorted(met) == sorted(whole + pairs)


def test_large_group_is_never_copied_to_all_parts_at_once(spark, monkeypatch):
    base = syllables(1, 150)
    rows = [(i, near_copy(base, i, 1)) for i in range(12)]
    sent, join_groups = [], ngram_join.join_groups
    monkeypatch.setattr(ngram_join, "join_groups", lambda members, percent: (sent.append(members.count()), join_groups(members, percent))[1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), part_size=300, hot=2).collect()}
    assert set(got.values()) == {0} and len(got) == 12
    assert max(sent) <= 2 * len(rows)


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, syllables(i, 60)) for i in range(20)], "doc_id long, text string")
    kept = ngram_join.distinct_rows(docs)
    assert kept.count() == 20
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    twice = ngram_join.distinct_rows(docs.unionAll(docs.filter(F.col("doc_id") < 3)))
    assert sorted(r["doc_id"] for r in twice.collect()) == list(range(20))
