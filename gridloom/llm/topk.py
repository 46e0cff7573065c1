"""Exact top-k inner products by three phases with a uniform threshold.

A score is the sum of ``lists`` partial scores, one for each block of components. For
every query:

1. each task gathers the head of its local score lists: the k best rows of every list;
   of these heads alone the exact scores are computed, and the k best of them are sent;
2. the k-th best score of all heads is a safe cutoff: k rows are known to reach it. It
   is broadcast to the tasks with the queries it belongs to. A row that reaches the
   cutoff T has some partial score of at least T / lists, whatever the signs, so each
   task collects only the entries above that uniform threshold in some list. Rows whose
   list norms rule that out, or rule out T itself, are skipped before any product, whole
   blocks first: blocks hold rows of like norm, and keep the largest norm of each list;
3. the collected rows' remaining partial scores are resolved list by list; a row is given
   up as soon as its partial scores and the norms of the lists left cannot reach T.

Queries travel in blocks of at most about ``query_block`` rows and candidates in blocks
of about ``row_block``: each pair of blocks is one unit of work of bounded size, and
neither side is gathered whole. Scores are integers held in float64 while all products
stay below 2^53, and Python integers where components are larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored


#: Bands of vector norms that blocks are kept within.
BANDS = 8


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def top_k(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    every: int = 20,
    k: int = 20,
    lists: int = 4,
    query_block: int = 1024,
    row_block: int = 16_384,
) -> DataFrame:
    """One row per query and rank: query_id, rank, vec_id, score.

    * components become floor(scale * x); the score is their integer inner product;
    * queries are the rows whose id is divisible by ``every``, candidates all rows but
      the query's own id; ties go to the smaller id;
    * vectors that are null, empty, hold null or non-finite components, or have a null
      id take no part; of vectors of different lengths only equal lengths meet;
    * rows that repeat an id are candidates each, and a query each time its id occurs is
      answered once, by its smallest vector;
    * components whose product with ``scale`` leaves the range of 64-bit integers, and
      scores that do, raise an error; below that scores are exact;
    * fewer than k candidates give fewer rows; an empty table gives none; other columns
      are ignored, whatever their names.
    """
    spark = table.sparkSession
    raw = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    whole = raw.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    )
    whole = whole.select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = stored(whole.withColumn("norm", norm), "vectors")
    cuts = whole.agg(F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000).alias("cuts"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("queries")).first()
    query_blocks = -(-max(1, cuts["queries"]) // query_block)
    band = F.lit(0)
    for cut in sorted(set(cuts["cuts"] or [])):  # rows of like norm
        band = band + (F.col("norm") > F.lit(cut)).cast("int")
    banded = whole.withColumn("band", band)
    rows_in = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # BANDS rows at most
    # Dealt by row number, not by value: rows that repeat do not fall together.
    parts, first = {b: max(-(-n // row_block), min(4, -(-n // 1024))) for b, n in rows_in.items()}, {}
    for b in sorted(parts):
        first[b] = sum(parts[x] for x in parts if x < b)
    block = F.lit(0).cast("long")
    for b in parts:
        block = F.when(F.col("band") == b, F.lit(first[b]) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts[b]))).otherwise(block)
    row_blocks = max(1, sum(parts.values()))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        matrix = np.array(group["v"].tolist(), np.int64)
        return pd.DataFrame({"block": group["block"].iloc[:1], "dim": group["dim"].iloc[:1], "largest": [int(np.abs(matrix).max())], "ids": [group["id"].to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})

    packed = "block long, dim int, largest long, ids binary, matrix binary"
    blocks = stored(banded.withColumn("block", block).groupBy("block", "dim").applyInPandas(pack, packed), "row-blocks")
    asked = whole.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v")
    queries = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(query_blocks))).groupBy("block", "dim").applyInPandas(pack, packed), "query-blocks")

    def units(cutoffs: DataFrame | None) -> DataFrame:
        """Each block of rows with each block of queries: block numbers are dealt, rows never crossed.

        Never broadcast: Spark takes the queries' size from their compressed file, though
        every block stands here unpacked and once for each block of rows.
        """
        q = queries if cutoffs is None else queries.join(cutoffs.withColumnRenamed("block", "c_block").withColumnRenamed("dim", "c_dim").hint("merge"), (F.col("block") == F.col("c_block")) & (F.col("dim") == F.col("c_dim"))).drop("c_block", "c_dim")
        q = q.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "matrix": "q_matrix", "largest": "q_largest"}).withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
        return q.withColumnRenamed("dim", "q_dim").join(blocks.hint("merge"), (F.col("row_block") == F.col("block")) & (F.col("q_dim") == F.col("dim")))

    def opened(row) -> tuple:
        dim = row.dim
        ids, q_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.q_ids, np.int64)
        exact = np.float64 if dim * max(1, row.largest) * max(1, row.q_largest) < 1 << 53 else object
        m, q = np.frombuffer(row.matrix, np.int64).reshape(-1, dim).astype(exact), np.frombuffer(row.q_matrix, np.int64).reshape(-1, dim).astype(exact)
        cuts = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
        return ids, q_ids, m, q, list(zip(cuts, cuts[1:], strict=False))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, q_ids, m, q, spans = opened(row)
                out = []
                for at in range(0, len(q_ids), 128):
                    partial = [q[at : at + 128, a:b] @ m[:, a:b].T for a, b in spans]
                    for i in range(len(partial[0])):
                        own = ids == q_ids[at + i]
                        found = set()
                        for p in partial:
                            line = np.where(own, -np.inf, p[i])
                            found.update(np.argpartition(line, len(line) - k)[len(line) - k :].tolist() if len(line) > k else range(len(line)))
                        found = np.array([j for j in found if not own[j]], np.int64)
                        out.append((row.q_block, row.dim, q_ids[at + i], np.sort((m[found] @ q[at + i]).astype(np.int64))[::-1][:k].tolist()))
                yield pd.DataFrame(out, columns=["block", "dim", "query_id", "scores"])

    first = units(None).mapInPandas(heads, "block long, dim int, query_id long, scores array<long>")
    # Enough heads give a cutoff; with fewer than k rows all of them are collected.
    cutoff = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
    known = first.groupBy("block", "dim", "query_id").agg(cutoff.alias("s")).select("block", "dim", F.struct("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("cutoff")).alias("c"))
    cutoffs = known.groupBy("block", "dim").agg(F.sort_array(F.collect_list("c")).alias("cutoffs"))  # at most query_block each

    def norms(x: np.ndarray, spans: list) -> np.ndarray:
        """Norms of every list's components, rounded up a little."""
        return np.stack([np.sqrt((x[:, a:b].astype(np.float64) ** 2).sum(axis=1)) for a, b in spans], axis=1) * (1 + 1e-9)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, q_ids, m, q, spans = opened(row)
                cut = {c["query_id"]: c["cutoff"] for c in row.cutoffs}
                goals = np.array([-np.inf if cut[i] is None or np.isnan(cut[i]) else float(cut[i]) for i in q_ids.tolist()])
                q_norms, m_norms = norms(q, spans), norms(m, spans)
                most = m_norms.max(axis=0)  # the block's bounds: some queries need none of it
                asks = np.flatnonzero((q_norms @ most >= goals) & (q_norms * most >= goals[:, None] / len(spans)).any(axis=1))
                out = []
                for at in range(0, len(asks), 128):
                    some_q = asks[at : at + 128]
                    goal = goals[some_q][:, None]
                    may = (q_norms[some_q] @ m_norms.T) >= goal
                    over = np.zeros_like(may)
                    for x in range(len(spans)):
                        over |= np.outer(q_norms[some_q, x], m_norms[:, x]) >= goal / len(spans)
                    need = np.flatnonzero((may & over).any(axis=0))
                    if not len(need):
                        continue
                    own, own_norms = m[need], m_norms[need]
                    partial = [q[some_q, a:b] @ own[:, a:b].T for a, b in spans]
                    reached = np.zeros((len(some_q), len(need)), bool)
                    for p in partial:  # the uniform threshold
                        reached |= (p >= goal / len(spans)).astype(bool)
                    for i, n in enumerate(some_q.tolist()):
                        some = np.flatnonzero(reached[i] & (ids[need] != q_ids[n]))
                        left, score = q_norms[n] * own_norms[some], np.zeros(len(some), own.dtype)
                        for x, p in enumerate(partial):  # resolve what the lists left open
                            score = score + p[i][some]
                            on = (score + left[:, x + 1 :].sum(axis=1) >= goal[i, 0]).astype(bool)
                            some, score, left = some[on], score[on], left[on]
                        score = score.astype(np.int64)
                        order = best(ids[need[some]], score, k)
                        out.append((q_ids[n], ids[need[some[order]]].tolist(), score[order].tolist()))
                yield pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    found = units(cutoffs).mapInPandas(collect, "query_id long, ids array<long>, scores array<long>")
    entry = lambda s, i: F.struct((-s).alias("neg"), i.alias("vec_id"))
    merged = found.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.zip_with("scores", "ids", entry)))), 1, k).alias("top"))
    return merged.select("query_id", F.posexplode("top").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.neg")).alias("score")
    )
