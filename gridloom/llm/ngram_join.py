"""Exact Jaccard join on word shingles, as classes of linked documents.

1. A first pass hashes every text into its set of distinct shingles, names the set by a
   128-bit digest (equal sets are one node from here on) and fills a count sketch of all
   shingles, of 16 MB whatever the corpus.
2. The sketch orders shingles from rare to common. Sets that reach the threshold share a
   shingle among the first n - ceil(t n) + 1 of either, in any common order; only those
   prefixes are shuffled. An entry's position bounds what the two sets can still share
   from there on, hence the largest partner it can have. An index list sorted by set size
   is skipped by that reach: an entry is tied to the one entry before it that reaches
   furthest, if that reaches its size, and to none of the others. Lists of common shingles
   are salted and their runs stitched from (low, reach) summaries.
3. Ties make candidate groups (connected components, no pair is ever written). The sets
   of groups far above a task's part are grouped anew by themselves, by the exact counts
   of their shingles among them, until that no longer halves them: what only one of these
   sets has is first in its order and ties nothing, however full the sketch was. Each
   group is joined exactly inside tasks; a large one as pairs of parts, some distances of
   parts at a time, so that the copies on disk stay a fixed multiple of the sets.
4. Inside a task sets are ordered by size, so index lists are skipped to the size window
   by position, and the overlap counts of a set are derived from its similar
   predecessor's counts by the lists of the differing shingles alone.

Texts are never cut, lists never capped; only the order depends on the sketch, not the
answer. Shingles are 64-bit hashes, sets 128-bit digests; candidate ties use half of the
digest, where a chance agreement adds a candidate and no link.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, fan_out, stored, text_of
from gridloom.llm.components import Forest, components
from gridloom.llm.shingles import mix, shingle_sets

SKETCH_BITS = 22
PIECE = 1 << 14
BLOOM_BITS = 26
#: Groups of so many parts are tied again; below, joining pairs of parts costs little.
LARGE = 4
#: Shingles whose counts one task takes at a time.
COUNTED = 1_000_000


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def pieces(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a flat table that hold anything, packed."""
    for i in range(0, len(table), PIECE):
        part = table[i : i + PIECE]
        if part.any():
            yield i // PIECE, zlib.compress(part.tobytes(), 1)


def summed(parts: DataFrame, length: int, dtype: str, combine) -> np.ndarray:
    """The element-wise combination of all packed parts (columns piece, packed).

    The driver gets one fixed-size table.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed in zip(batch["piece"], batch["packed"], strict=True):
                values = np.frombuffer(zlib.decompress(packed), dtype)
                held[piece] = values.copy() if piece not in held else combine(held[piece], values)
        yield pd.DataFrame({"piece": list(held), "packed": [zlib.compress(v.tobytes(), 1) for v in held.values()]}).astype({"piece": "int64"})

    merged = parts.select("piece", "packed").repartition(min(32, fan_out(parts.sparkSession)), "piece").mapInPandas(add, "piece long, packed binary")
    table = np.zeros(length, dtype)
    for row in merged.collect():
        table[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(zlib.decompress(row["packed"]), dtype)
    return table


def sketch_places(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def node_of(sig: bytes) -> int:
    """The first half of a digest as a signed number."""
    return int.from_bytes(sig[:8], "big", signed=True)


def count(table: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        at, more = np.unique(sketch_places(np.concatenate(held)), return_counts=True)
        table[at] += more.astype(np.uint32)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """Rows (id, mark, n, sig) of all documents and, beside them, the sketch's packed parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            n, sig, held, size = [], [], [], 0
            for own in shingle_sets(batch["text"].tolist(), width):
                n.append(len(own))
                sig.append(digest(own) if len(own) else None)
                held.append(own)
                size += len(own)
                if size > 500_000:
                    count(table, held)
                    held, size = [], 0
            count(table, held)
            yield pd.DataFrame({"id": batch["id"], "mark": batch["mark"], "n": n, "sig": sig, "piece": -1, "packed": None})
        rows = list(pieces(table))
        yield pd.DataFrame({"id": pd.array([None] * len(rows), "Int64"), "mark": 0, "n": 0, "sig": None, "piece": [p for p, _ in rows], "packed": [b for _, b in rows]})

    return docs.mapInPandas(run, "id long, mark long, n long, sig binary, piece long, packed binary")


def sets_of(batch: pd.DataFrame, width: int) -> Iterator[np.ndarray]:
    """Every row's set: from its text, or from the column shingles if that is there."""
    if "shingles" in batch:
        return (np.frombuffer(x, np.uint64) for x in batch["shingles"])
    return shingle_sets(batch["text"].tolist(), width)


def resketched(sets: DataFrame) -> np.ndarray:
    """The count sketch of stored sets (column shingles)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            held, size = [], 0
            for own in sets_of(batch, 0):
                held.append(own)
                size += len(own)
                if size > 500_000:
                    count(table, held)
                    held, size = [], 0
            count(table, held)
        rows = list(pieces(table))
        yield pd.DataFrame({"piece": [p for p, _ in rows], "packed": [b for _, b in rows]}).astype({"piece": "int64"})

    return summed(sets.select("shingles").mapInPandas(run, "piece long, packed binary"), 1 << SKETCH_BITS, "uint32", np.add)


def bloom_of(nodes: DataFrame) -> np.ndarray:
    """A one-hash Bloom table of the column node."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            at = batch["node"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - BLOOM_BITS)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = list(pieces(table))
        yield pd.DataFrame({"piece": [p for p, _ in rows], "packed": [b for _, b in rows]}).astype({"piece": "int64"})

    return summed(nodes.select("node").mapInPandas(mark, "piece long, packed binary"), 1 << (BLOOM_BITS - 3), "uint8", np.bitwise_or)


def sets_among(rows: DataFrame, width: int, bloom) -> DataFrame:
    """(own, sig, shingles): the sets whose nodes the Bloom table has, repeats mostly left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = bloom.value
        seen: set[bytes] = set()
        for batch in batches:
            out, held = [], 0
            for own in sets_of(batch, width):
                if not len(own) or (sig := digest(own)) in seen:
                    continue
                at = (node_of(sig) % (1 << 64)) >> (64 - BLOOM_BITS)
                if table[at >> 3] >> (at & 7) & 1:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(sig)
                    out.append((node_of(sig), sig, own.tobytes()))
                    held += len(own)
                if len(out) >= 1000 or held > 1_000_000:
                    yield pd.DataFrame(out, columns=["own", "sig", "shingles"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["own", "sig", "shingles"])

    return rows.mapInPandas(run, "own long, sig binary, shingles binary")


def prefixes(docs: DataFrame, width: int, percent: int, sketch, hot: int) -> DataFrame:
    """(node, n, shingles, reach, parts): each set's prefix in the sketch's order, rare first.

    docs has texts, or sets (column shingles).

    ``reach`` is the size of the largest set that this shingle could be the first common
    one with; ``parts`` is how many salts the shingle's index list is dealt over, 1 if
    its count does not stand out from what the sketch's places hold anyway.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sketch.value
        load = float(table.mean(dtype=np.float64))
        usual = int(load + 6 * load**0.5)
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for own in sets_of(batch, width):
                if not len(own) or (sig := digest(own)) in seen:
                    continue
                if len(seen) > 100_000:  # saves repeated rows only; they fall together later
                    seen.clear()
                seen.add(sig)
                common = table[sketch_places(own)].astype(np.int64)
                first = np.lexsort((own, common))[: len(own) - -(-percent * len(own) // 100) + 1]
                reach = (len(own) - np.arange(len(first))) * (100 + percent) // percent - len(own)
                met = common[first] > 1  # met once: no other set has it
                first, reach = first[met], reach[met]
                if len(first):
                    parts = 1 + np.maximum(0, common[first] - usual) // hot
                    out.append((node_of(sig), len(own), own[first].view(np.int64), reach.astype(np.int32), parts.astype(np.int32)))
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=["node", "n", "shingles", "reach", "parts"])
                    out = []
            yield pd.DataFrame(out, columns=["node", "n", "shingles", "reach", "parts"])

    return docs.mapInPandas(run, "node long, n int, shingles array<long>, reach array<int>, parts array<int>")


def exact_prefixes(sets: DataFrame, percent: int, sketch, hot: int, held: int) -> DataFrame:
    """As ``prefixes``, of stored sets (own, shingles), in the order of exact counts.

    Shingles are dealt by their value and counted; those of two sets at least come back to
    their sets. The sketch never counts too few: what it has once is not sent, and what
    stands out in it by ``hot`` is not sent either but stays, as the most common, with the
    sketch's count, so that no task gets more than that of one shingle.

    held: about how many shingles the sets have.
    """
    spark = sets.sparkSession
    slices = max(4 * fan_out(spark), -(-held // COUNTED))
    load = float(sketch.value.mean(dtype="float64"))
    usual = int(load + 6 * load**0.5)

    def flat(batch: pd.DataFrame) -> tuple[np.ndarray, ...]:
        own = [np.frombuffer(x, np.uint64) for x in batch["shingles"]]
        n = np.array([len(x) for x in own], np.int32)
        shingle = np.concatenate(own)
        return np.repeat(batch["own"].to_numpy(np.int64), n), np.repeat(n, n), shingle, sketch.value[sketch_places(shingle)].astype(np.int64)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed() -> pd.DataFrame:
            node, n, shingle = (np.concatenate(x) for x in zip(*kept, strict=True))
            at = (mix(shingle) % np.uint64(slices)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at, cuts = np.unique(at[order], return_index=True)
            return pd.DataFrame({"slice": at} | {name: [x.tobytes() for x in np.split(values[order], cuts[1:])] for name, values in (("node", node), ("n", n), ("shingle", shingle))})

        kept, size = [], 0
        for batch in batches:
            for i in range(0, len(batch), 1000):
                node, n, shingle, common = flat(batch.iloc[i : i + 1000])
                sent = (common > 1) & (common <= usual + hot)
                if sent.any():
                    kept.append((node[sent], n[sent], shingle[sent]))
                    size += int(sent.sum())
                if size > 2_000_000:
                    yield packed()
                    kept, size = [], 0
        if kept:
            yield packed()

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        node, n, shingle = (np.frombuffer(b"".join(group[name]), kind) for name, kind in (("node", np.int64), ("n", np.int32), ("shingle", np.uint64)))
        order = np.lexsort((n, node, shingle))
        node, n, shingle = node[order], n[order], shingle[order]
        other = np.append(True, shingle[1:] != shingle[:-1])
        once = other | np.append(True, (node[1:] != node[:-1]) | (n[1:] != n[:-1]))  # a set may be there several times
        node, n, shingle = node[once], n[once], shingle[once]
        which = np.cumsum(other[once]) - 1
        times = np.bincount(which)[which]
        met = times > 1
        return pd.DataFrame({"node": node[met], "n": n[met], "shingle": shingle[met].view(np.int64), "times": times[met]})

    def common_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                node, n, shingle, common = flat(batch.iloc[i : i + 1000])
                far = common > usual + hot
                yield pd.DataFrame({"node": node[far], "n": n[far], "shingle": shingle[far].view(np.int64), "times": common[far]})

    found = "node long, n int, shingle long, times long"
    counts = sets.mapInPandas(dealt, "slice int, node binary, n binary, shingle binary").groupBy("slice").applyInPandas(counted, found)
    met = counts.unionAll(sets.mapInPandas(common_ones, found)).groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("times", "shingle"))).alias("met"))
    # Those that no other set has come first, so a set with enough of them has no entry.
    alone = F.col("n") - F.size("met")
    entries = F.expr(f"n - ceil({percent} * n / 100) + 1").cast("int") - alone
    first = met.withColumn("alone", alone).withColumn("entries", entries).filter("entries > 0").withColumn("first", F.expr("slice(met, 1, entries)"))
    return first.select(
        "node",
        "n",
        F.expr("transform(first, x -> x.shingle)").alias("shingles"),
        F.expr(f"transform(first, (x, i) -> CAST((n - alone - i) * {100 + percent} div {percent} - n AS INT))").alias("reach"),
        F.expr(f"transform(first, x -> CAST(1 + greatest(0, x.times - {usual}) div {hot} AS INT))").alias("parts"),
    )


def candidate_edges(prefix: DataFrame, percent: int) -> DataFrame:
    """(a, b): ties between sets that meet in some index list, within each other's reach.

    Two entries of sizes m <= n tie if n <= reach(m) and m <= reach(n). An entry whose
    reach is below its own size meets smaller sets only. Entries before one of size n
    that reach n are all tied to each other, so the furthest reaching of them stands for
    all; that its size is within the later one's reach is not asked, which can only add
    candidates.
    """
    rows = prefix.select("node", "n", F.explode(F.arrays_zip("shingles", "reach", "parts")).alias("x")).select(
        "node",
        "n",
        F.col("x.shingles").alias("shingle"),
        F.col("x.reach").alias("reach"),
        F.col("x.parts").alias("parts"),
        F.pmod(F.hash("node"), F.col("x.parts")).alias("part"),
    )
    # In a salted list any entry may be the one that meets another part's entry.
    rows = rows.withColumn("reach", F.when(F.col("parts") > 1, F.greatest("reach", "n")).otherwise(F.col("reach")))
    dealt = rows.repartition(fan_out(prefix.sparkSession), "shingle", "part")
    by_size = Window.partitionBy("shingle", "part").orderBy("n", F.col("reach").desc(), "node")
    prior = F.max(F.when(F.col("reach") >= F.col("n"), F.struct("reach", "node"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    ties = dealt.withColumn("prior", prior).withColumn("tied", F.coalesce(F.col("prior.reach") >= F.col("n"), F.lit(False)))
    ties = ties.withColumn("head", F.last(F.when(~F.col("tied"), F.col("node")), ignorenulls=True).over(by_size))
    ties = ties.filter("parts > 1 OR (tied AND prior.node <> node)").select("shingle", "part", "parts", "node", "n", "reach", "head", "tied", F.col("prior.node").alias("to"))
    ties = stored(ties, "ties")
    inside = ties.filter("tied AND to <> node").select(F.col("node").alias("a"), F.col("to").alias("b"))
    runs = ties.filter("parts > 1").groupBy("shingle", "part", "head").agg(F.min("n").alias("low"), F.max("reach").alias("reach"))
    along = Window.partitionBy("shingle").orderBy("low", "head", "part").rowsBetween(Window.unboundedPreceding, -1)
    across = runs.withColumn("prior", F.max(F.struct("reach", "head")).over(along)).filter("prior.reach >= low AND prior.head <> head")
    edges = stored(inside.unionAll(across.select(F.col("head").alias("a"), F.col("prior.head").alias("b"))).distinct(), "candidates")
    dropped(ties)
    return edges


def exact_links(sigs: list[bytes], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Linked positions (i, j): every link, or enough to tie the same classes together.

    Only sets on different sides are compared where ``side`` is given.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    side = None if side is None else side[order]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[code] > 1  # a shingle of one set alone has nothing to skip to
    code, owner = code[shared], owner[shared]
    by_code = np.lexsort((owner, code))
    posted, heads = owner[by_code], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(df)))])
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    codes = [np.sort(code[cuts[i] : cuts[i + 1]]) for i in range(len(sets))]

    def tally(which: np.ndarray) -> np.ndarray:
        """How often each set stands in the index lists of these shingles."""
        if not len(which):
            return np.zeros(len(sets), np.int64)
        start, length = heads[which], heads[which + 1] - heads[which]
        jump = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        return np.bincount(posted[jump + np.arange(len(jump))], minlength=len(sets))

    walk = sorted(range(len(sets)), key=lambda i: (codes[i][:3].tolist(), sizes[i]))
    last, counts = None, None
    for i in walk:
        own = codes[i]
        if not len(own):
            continue
        fresh = True
        if last is not None:
            lost, new = np.setdiff1d(codes[last], own, assume_unique=True), np.setdiff1d(own, codes[last], assume_unique=True)
            if len(lost) + len(new) < len(own) // 2:
                counts, fresh = counts - tally(lost) + tally(new), False
        if fresh:
            counts = tally(own)
        last = i
        # Positions outside the size window are skipped, both ways, in one step.
        low = np.searchsorted(sizes, -(-percent * sizes[i] // 100))
        both = counts[low:i]
        hits = low + np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[low:i] - both))
        if side is not None:
            hits = hits[side[hits] != side[i]]
        for j in hits.tolist():
            yield int(order[i]), int(order[j])


def join_groups(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the true links inside every group.

    members: (grp, side, sig, shingles); side -1 compares all, 0 and 1 across only.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["sig", "side"])
        sigs = group["sig"].tolist()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        side = group["side"].to_numpy()
        forest = Forest()
        if len(sets) > 1:
            for i, j in exact_links(sigs, sets, percent, None if (side < 0).all() else side):
                forest.join(sigs[i], sigs[j])
        a, b = forest.stars()
        return pd.DataFrame({"a": a, "b": b})

    return members.groupBy("grp").applyInPandas(run, "a binary, b binary")


def pairs_of_parts(members: DataFrame, least: int, below: int) -> DataFrame:
    """(grp, side, sig, shingles): the pairs of parts of one group that are ``least`` to ``below`` - 1 apart.

    Parts stand in a ring, so none of m is further than m / 2 from another. A set is copied
    twice for every distance, however many parts there are; all pairs at once would copy it
    m times.
    """
    apart = [sign * d for d in range(least, below) for sign in (1, -1)]
    others = F.array_distinct(F.transform(F.filter(F.array(*map(F.lit, apart)), lambda d: 2 * F.abs(d) <= F.col("parts")), lambda d: F.pmod(F.col("part") + d, F.col("parts"))))
    pair = F.transform(
        others,
        lambda o: F.struct(
            F.concat_ws("-", F.hex("component"), F.least(o, F.col("part")), F.greatest(o, F.col("part"))).alias("grp"),
            F.when(o == F.col("part"), -1).when(o > F.col("part"), 0).otherwise(1).alias("side"),
        ),
    )
    return members.select(F.explode(pair).alias("g"), "sig", "shingles").select("g.grp", "g.side", "sig", "shingles")


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    part_size: int = 250_000,
    hot: int = 4096,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable).

    * words are lower-cased A-Z runs without white space; fewer than ``width`` words
      make one shingle; null or wordless texts have none and stand alone;
    * sets link when 100 * intersection >= percent * union; equal sets always link;
    * rows that repeat an id are rows of their own and share its component only if
      their sets link; a null id takes part, and its component is the smallest
      non-null id, or null if there is none;
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    judged = classes_of(docs, id_col, text_col, width, percent, part_size, hot)
    return judged.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def narrowed(rows: DataFrame, groups: DataFrame, nodes_n: DataFrame, width: int, percent: int, part_size: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(groups, sizes) with the large groups cut down: their sets are counted and tied again.

    Links stay inside groups, so the sets of the large ones are a corpus of their own: the
    exact counts in them alone tell common passages from rare ones, and what met in no
    other large set drops out. Repeated while that halves them.

    nodes_n: (s, n), the size of every set by its node.
    """
    spark = rows.sparkSession

    def sized(some: DataFrame) -> DataFrame:
        own = some.join(nodes_n, F.col("node") == F.col("s"))
        return stored(own.groupBy("component").agg(F.sum("n").alias("shingles")), "group-sizes")

    sizes, source, before = sized(groups), rows, None
    done_groups, done_sizes = [], []
    while True:
        large = F.col("shingles") > LARGE * part_size
        held = sizes.agg(F.sum(F.when(large, F.col("shingles")))).first()[0] or 0
        if not held or (before is not None and 2 * held > before):
            break
        before = held
        over = sizes.withColumnRenamed("component", "c")
        parted = stored(groups.join(over, F.col("component") == F.col("c")).select("node", "component", large.alias("large")), "parted")
        bloom = spark.sparkContext.broadcast(bloom_of(parted.filter("large")))
        sets = stored(sets_among(source, width, bloom).select("own", "shingles"), "large-sets")
        bloom.unpersist()
        done_groups.append(parted.filter("NOT large").select("node", "component"))
        done_sizes.append(sizes.filter(~large))
        dropped(groups)
        if source is not rows:
            dropped(source)
        source = sets
        sketch = spark.sparkContext.broadcast(resketched(sets))
        edges = candidate_edges(exact_prefixes(sets, percent, sketch, hot, held), percent)
        groups = stored(components(edges), "groups")
        dropped(edges)
        sketch.unpersist()
        sizes = sized(groups)
    if source is not rows:
        dropped(source)
    for g, z in zip(done_groups, done_sizes, strict=True):
        groups, sizes = groups.unionAll(g), sizes.unionAll(z)
    return groups, sizes


def classes_of(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, part_size: int, hot: int) -> DataFrame:
    """(id, mark, n, sig, component_id, chosen) of every row.

    ``mark`` is a hash of the text; ``chosen`` says that the row has the id and mark that
    stand for its class (the smallest, null ids last), or stands alone without words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("mark"))
    first = stored(profile(rows, width), "profile")
    nodes = first.filter("piece < 0")
    own = F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")
    named = nodes.filter("sig IS NOT NULL").groupBy("sig").agg(F.min(own).alias("least"), F.max("n").alias("n"))
    table = summed(first.filter("piece >= 0"), 1 << SKETCH_BITS, "uint32", np.add)
    sketch = spark.sparkContext.broadcast(table)  # 16 MB, whatever the corpus

    edges = candidate_edges(prefixes(rows, width, percent, sketch, hot), percent)
    groups = stored(components(edges), "groups")
    dropped(edges)
    sketch.unpersist()
    half = F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("long")
    nodes_n = named.select(half.alias("s"), "n")
    groups, sizes = narrowed(rows, groups, nodes_n, width, percent, part_size, hot)
    bloom = spark.sparkContext.broadcast(bloom_of(groups))
    sets = sets_among(rows, width, bloom)
    small = F.col("shingles") <= part_size
    few, many, widest = sizes.agg(F.sum(F.when(small, F.col("shingles"))), F.sum(F.when(~small, F.col("shingles"))), F.max("shingles")).first()
    shelves = max(1, 2 * (few or 0) // part_size)
    # Small groups share a shelf; a large one is cut into parts, joined two by two. Both
    # are measured in shingles, so a task's memory does not follow the texts' lengths.
    parts = F.ceil(F.col("shingles") / F.lit(part_size)).cast("int")
    placed = groups.join(sizes.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select("node", "component", parts.alias("parts"), F.pmod(F.hash("node", F.lit(7)), parts).alias("part"))
    # Written first: two Python steps in one stage would double an executor's workers.
    members = stored(sets.join(placed, F.col("own") == F.col("node")).select("component", "parts", "part", "sig", "shingles"), "members")
    shelf = F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(shelves)).cast("string"))
    found = [stored(join_groups(members.filter("parts = 1").select(shelf.alias("grp"), F.lit(-1).alias("side"), "sig", "shingles"), percent), "links")]
    if many:
        large = stored(members.filter("parts > 1"), "large-members")
        dropped(members)
        members = large
        step = max(1, (few or 0) // (2 * many))
        for least in range(0, -(-widest // part_size) // 2 + 1, step):
            found.append(stored(join_groups(pairs_of_parts(large, least, least + step), percent), "links"))
    dropped(members)
    links = stored(components(functools.reduce(DataFrame.unionAll, found)), "classes")
    for done in (*found, groups, sizes):
        dropped(done)

    classes = named.join(links, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("least").alias("best")).withColumnRenamed("class", "k")
    answer = classes.join(lowest, F.col("class") == F.col("k")).select(F.col("sig").alias("s"), "best")
    chosen = F.col("sig").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")))
    return nodes.join(answer, F.col("sig") == F.col("s"), "left").select("id", "mark", "n", "sig", F.coalesce("best.id", "id").alias("component_id"), chosen.alias("chosen"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, part_size: int = 250_000, hot: int = 4096) -> DataFrame:
    """One row of every class of linked rows, with all its columns.

    * the row with the smallest id stays, a null id only if the class has no other; of
      rows of that id, those with one text stay, and one of them if they are equal;
    * rows without words (null, empty, white space) are linked with nothing: all stay;
    * long texts are compared whole; an empty table gives no rows; columns of any name,
      nulls in them included, come through as they are.
    """
    judged = classes_of(docs, id_col, text_col, width, percent, part_size, hot).filter("chosen")
    again = F.first("sig").isNotNull() & (F.count(F.lit(1)) > 1)
    stay = stored(judged.groupBy(F.col("id").alias("_s_id"), F.col("mark").alias("_s_mark")).agg(again.alias("_again")), "stay")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_mark"))
    kept = rows.join(stay, F.col("_id").eqNullSafe(F.col("_s_id")) & (F.col("_mark") == F.col("_s_mark")))
    if stay.filter("_again").isEmpty():
        return kept.select("_row.*")
    # Only rows that repeat id and text are sent a second time, to leave one of them.
    once = kept.filter("_again").dropDuplicates(["_id", "_mark"])
    return once.unionAll(kept.filter("NOT _again")).select("_row.*")
