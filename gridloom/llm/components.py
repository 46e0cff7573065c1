"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, stored


class Forest:
    """Union-find whose root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (parent := up.setdefault(x, x)) != x:
            up[x] = up[parent]
            x = parent
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def stars(self) -> tuple[list, list]:
        members = [x for x in list(self.up) if self.root(x) != x]
        return members, [self.root(x) for x in members]


def contract(edges: DataFrame, most: int = 500_000) -> DataFrame:
    """A spanning star forest of every partition's edges, ``most`` nodes at a time."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                forest.join(a, b)
            if len(forest.up) > most:
                yield pd.DataFrame(dict(zip("ab", forest.stars(), strict=True)))
                forest = Forest()
        yield pd.DataFrame(dict(zip("ab", forest.stars(), strict=True)))

    return edges.mapInPandas(local, edges.schema)


def nearest(pairs: DataFrame, least_hot: int, most_hot: int = 100_000) -> DataFrame:
    """(a, b, m): every pair with the smallest b of its a.

    The pairs of a crowded node are dealt over salts. Crowded nodes have above ``cut``
    pairs, so there are at most ``most_hot`` of them and their table may be broadcast.
    """
    cut = max(least_hot, pairs.count() // most_hot)
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cut)
    hot = degrees.select(F.col("a").alias("h"), F.ceil(F.col("n") / cut).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(hot), F.col("a") == F.col("h"), "left").select("a", "b", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    least = dealt.groupBy("a", "salt", "parts").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.max("parts").alias("parts"))
    sent = least.select(F.col("a").alias("k"), "m", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k_salt"))
    return dealt.join(sent, (F.col("a") == F.col("k")) & (F.col("salt") == F.col("k_salt"))).select("a", "b", "m")


def components(edges: DataFrame, least_hot: int = 500) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Every round contracts inside the partitions, then applies a large star (neighbours
    above a node move to its smallest neighbour) and a small star (neighbours below
    move likewise); both keep the components, and a number of rounds in the order of
    log(n) leaves a forest of stars, which a further round does not change. Nothing is
    gathered on the driver but a checksum, and a round's table goes when the next stands.

    Null ends and loops are no edges; repeated edges count once; no edges, no rows.
    """
    kept = stored(contract(edges.filter("a <> b").select("a", "b")), "edges")
    before = None
    while True:
        wide = kept.unionAll(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = nearest(wide, least_hot).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        moved = stored(large, "edges")  # each end is above its new neighbour already
        small = nearest(moved, least_hot)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        after = stored(small.filter("a <> b").distinct(), "edges")
        for old in (kept, moved):
            dropped(old)
        kept = after
        now = tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    centres = kept.select(F.col("b").alias("node")).distinct()
    return kept.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(centres.select("node", F.col("node").alias("component")))
