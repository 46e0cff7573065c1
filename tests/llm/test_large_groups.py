"""Large candidate groups of the shingle join are cut down before they are joined."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import ngram_join, shingles
from test_operators import near_copy, syllables


def linked_texts() -> list[tuple]:
    base = [syllables(i, 150) for i in range(30)]
    return [(i, t) for i, t in enumerate(base)] + [(100 + i, near_copy(base[i], i, 2)) for i in range(0, 30, 3)]


def test_large_group_is_cut_to_its_ties(spark):
    rows = linked_texts()
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("mark", F.xxhash64("text"))
    nodes = [(ngram_join.node_of(ngram_join.digest(own)), len(own)) for own in shingles.shingle_sets([t for _, t in rows])]
    # All texts in one group, as a sketch too small for the corpus ties them.
    groups = ngram_join.stored(spark.createDataFrame([(n, 1) for n, _ in nodes], "node long, component long"), "test-groups")
    sized = spark.createDataFrame(nodes, "s long, n long")
    out, sizes = ngram_join.narrowed(docs, groups, sized, 5, 80, 500, 4096)
    members = {}
    for node, component in out.collect():
        members.setdefault(component, set()).add(node)
    at = {i: n for (i, _), (n, _) in zip(rows, nodes, strict=True)}
    assert all(any({at[i], at[100 + i]} <= m for m in members.values()) for i in range(0, 30, 3))
    assert max(map(len, members.values())) < 10 and sizes.agg(F.max("shingles")).first()[0] <= 4 * 500


def test_join_with_many_large_groups(spark):
    rows = linked_texts()
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), part_size=60, hot=2).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    kept = ngram_join.distinct_rows(spark.createDataFrame(rows, "doc_id long, text string"), part_size=60, hot=2).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(30))


def test_shingles_of_one_set_tie_nothing_in_a_full_sketch(spark):
    """Every shingle in one place of the sketch, which cannot tell those of one set from those of all."""
    rng = np.random.default_rng(7)
    passage = np.arange(1, 21, dtype=np.uint64)
    sets = [np.sort(np.concatenate([passage, rng.integers(100, 1 << 40, 30).astype(np.uint64)])) for _ in range(60)]
    sets += [np.sort(np.concatenate([own[:-2], rng.integers(1 << 41, 1 << 42, 2).astype(np.uint64)])) for own in sets[:60:10]]
    sets += sets[5:60:10]  # a set may be there twice
    nodes = [ngram_join.node_of(ngram_join.digest(own)) for own in sets]
    rows = spark.createDataFrame([(own.tobytes(),) for own in sets], "shingles binary").repartition(5)
    groups = ngram_join.stored(spark.createDataFrame([(n, 1) for n in sorted(set(nodes))], "node long, component long"), "test-groups")
    sized = spark.createDataFrame(sorted({(n, 50) for n in nodes}), "s long, n long")
    out, _ = ngram_join.narrowed(rows, groups, sized, 5, 80, 100, 4096)
    members = {}
    for node, component in out.collect():
        members.setdefault(component, set()).add(node)
    assert sorted(map(sorted, members.values())) == sorted(sorted((nodes[10 * i], nodes[60 + i])) for i in range(6))


def test_exact_prefixes_equal_plain_python(spark):
    """Entries, reach and salts as defined, with shingles that only the sketch counts, too."""
    rng = np.random.default_rng(3)
    top = 1 << (64 - ngram_join.SKETCH_BITS)
    sets = [np.unique(np.concatenate([rng.integers(0, 60, 25) * 7, rng.integers(1, 9, 6) * top])).astype(np.uint64) for _ in range(80)]
    table = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint32)
    ngram_join.count(table, sets)
    usual, hot = int((m := float(table.mean(dtype=np.float64))) + 6 * m**0.5), 30
    times = Counter(x for own in sets for x in own.tolist())
    least = {x: int(table[x // top]) if table[x // top] > usual + hot else times[x] for x in times}
    want = {}
    for own in sets:
        n = len(own)
        order = sorted(own.tolist(), key=lambda x: (least[x], x))[: n - -(-80 * n // 100) + 1]
        entries = [(x, (n - i) * 180 // 80 - n, 1 + max(0, least[x] - usual) // hot) for i, x in enumerate(order) if least[x] > 1]
        if entries:
            want[ngram_join.node_of(ngram_join.digest(own))] = (n, entries)
    stored = spark.createDataFrame([(ngram_join.node_of(ngram_join.digest(own)), own.tobytes()) for own in sets], "own long, shingles binary").repartition(3)
    sketch = spark.sparkContext.broadcast(table)
    got = {r["node"]: (r["n"], list(zip(r["shingles"], r["reach"], r["parts"], strict=True))) for r in ngram_join.exact_prefixes(stored, 80, sketch, hot, 2000).collect()}
    assert got == want and len(want) > 10
    assert len({p for _, e in want.values() for *_, p in e}) > 1
