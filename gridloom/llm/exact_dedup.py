"""Exact deduplication by content sort.

Method: sampled splitters range-partition the normalised bytes, an external sort inside
each range puts equal texts next to each other, and neighbouring rows are compared in
full. A group of copies that holds a large part of the corpus would fill one range, so
digests with above ``cut`` rows are counted first and their rows dealt over salts, about
``cut`` rows each; there are at most ``most_hot`` such groups. Each run is reduced to its
survivor in place. The runs of a salted group meet again, one row each with its text, are
compared in full and agree on one survivor for the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fan_out, stored, text_of

#: Characters of a text that take part in sampling splitters.
HEAD = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    least_hot: int = 1000,
    most_hot: int = 100_000,
    normalise=None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    * null text counts as empty, so null and "" are copies of each other;
    * ``keep`` "max" or "min" picks the surviving id; rows that repeat an id and text
      count in ``group_size`` each and are all flagged alike (see ``kept_rows``);
    * a null id never survives next to a non-null one and is kept only if alone;
    * texts of any length are compared whole; no rows in, no rows out; further columns
      are ignored, whatever their names;
    * ``normalise`` maps the text column to the compared one (default: no change).
    """
    spark = docs.sparkSession
    pick = F.max if keep == "max" else F.min
    text: Column = text_of(text_col)
    if normalise is not None:
        text = normalise(text)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_sha", F.sha2(F.col("_text").cast("binary"), 256))
    sizes = stored(rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least_hot), "hot-digests")
    cut = max(least_hot, (sizes.agg(F.sum("_n")).first()[0] or 0) // most_hot)
    # At most most_hot groups have above that many rows: a proven bound for the broadcast.
    hot = sizes.filter(F.col("_n") > cut).select(F.col("_sha").alias("_h_sha"), F.ceil(F.col("_n") / cut).cast("int").alias("_h_parts"))
    parts = F.coalesce("_h_parts", F.lit(1))
    rows = rows.join(F.broadcast(hot), F.col("_sha") == F.col("_h_sha"), "left").select(
        "_id",
        "_text",
        F.substring("_text", 1, HEAD).alias("_head"),
        "_sha",
        parts.alias("_parts"),
        F.pmod(F.xxhash64("_row"), parts).cast("int").alias("_salt"),
    )
    # Splitters are sampled on the texts' heads and digests, which equal texts share, so
    # what the driver samples stays a few hundred bytes a row however long the texts are.
    ranged = rows.repartitionByRange(fan_out(spark), "_head", "_sha", "_salt")
    order = F.col("_id").desc_nulls_last() if keep == "max" else F.col("_id").asc_nulls_last()
    # The range keys are among the windows' grouping keys: no further exchange, one
    # external sort, and the window operator compares the whole neighbouring texts.
    by_text = Window.partitionBy("_head", "_sha", "_salt", "_text").orderBy(order)
    run = by_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = stored(
        ranged.select(
            "_id",
            "_sha",
            "_parts",
            "_salt",
            F.first("_id").over(run).alias("_run_keep"),
            F.count(F.lit(1)).over(run).alias("_run_size"),
            # Names the run where texts share a digest; one row of a salted run has its text.
            F.when(F.col("_parts") > 1, F.xxhash64("_text")).alias("_twin"),
            F.when((F.col("_parts") > 1) & (F.row_number().over(by_text) == 1), F.col("_text")).alias("_rep"),
        ),
        "content-runs",
    )
    whole = Window.partitionBy("_sha", "_rep")
    agreed = runs.filter("_rep IS NOT NULL").select(
        F.col("_sha").alias("_g_sha"),
        F.col("_salt").alias("_g_salt"),
        F.col("_twin").alias("_g_twin"),
        pick("_run_keep").over(whole).alias("_run_keep"),
        F.sum("_run_size").over(whole).alias("_run_size"),
    )
    same = (F.col("_sha") == F.col("_g_sha")) & (F.col("_salt") == F.col("_g_salt")) & (F.col("_twin") == F.col("_g_twin"))
    salted = runs.filter("_parts > 1").select("_id", "_sha", "_salt", "_twin").join(agreed, same).select("_id", "_sha", "_run_keep", "_run_size")
    return (
        runs.filter("_parts = 1")
        .select("_id", "_sha", "_run_keep", "_run_size")
        .unionAll(salted)
        .select(
            F.col("_id").alias(id_col),
            F.col("_run_keep").alias("keep_id"),
            F.col("_run_size").cast("long").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("_run_keep")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The surviving rows with all their columns.

    * one row of each distinct text stays, null and empty texts being one text; of rows
      that repeat id and text one stays, whichever it is;
    * a null id stays only where its text has no other;
    * long texts are compared whole; an empty table gives no rows; columns of any name,
      nulls in them included, come through as they are.
    """
    verdict = exact_dedup(docs, id_col, text_col, **options)
    survivors = verdict.filter("kept").select(F.col(id_col).alias("_s_id"), F.col("text_sha256").alias("_s_sha")).distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    if options.get("normalise") is not None:
        text = options["normalise"](text)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs[id_col].alias("_id"),
        F.sha2(text.cast("binary"), 256).alias("_sha"),
    )
    # Repeated rows fall together before the join, inside the tasks first.
    return rows.dropDuplicates(["_id", "_sha"]).join(survivors, F.col("_id").eqNullSafe(F.col("_s_id")) & (F.col("_sha") == F.col("_s_sha"))).select("_row.*")
