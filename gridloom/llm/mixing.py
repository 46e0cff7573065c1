"""Mixing sources to target weights under a token budget.

Method: every document gets a hash-random key, rows are range-sorted within their
source by that key, distributed prefix sums of the sizes run along that order, and the
mix is cut where a source's exact budget is used up; a budget above the source's size
repeats whole epochs first.

The prefix sums never bring a source to one task. The hash key is cut into equal
buckets, a bucket's subtotal comes from a map-side combined aggregate, the subtotals of
one source are summed along the buckets in two levels (inside shelves of ``SHELF``
buckets, then along the shelves), and each document adds its place inside its bucket. The
number of buckets per source follows the source's number of documents, so a
bucket holds about ``bucket_docs`` documents whatever the source's share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, stored, text_of


#: Buckets that are summed in one task.
SHELF = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Targets from (source, source_size): water-filling under the cap ``most`` x size.

    A source's target is min(most * size, level * weight). With sources ordered by
    size / weight the capped ones come first, so the level follows from running sums;
    the last candidate level that leaves its own source uncapped is the one. The table
    has one row per source, an aggregate's output, not a row per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    level = (share * F.sum("source_size").over(everyone) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    capped = F.col("level") * F.col("weight") > most * F.col("source_size")
    first_free = F.min(F.when(~capped, F.struct("at", "level"))).over(everyone)["level"]
    limit = most * F.col("source_size")
    return levels.withColumn("free", first_free).select(
        "source",
        "source_size",
        "docs",
        F.when(F.col("free").isNull(), limit).otherwise(F.least(limit, F.col("free") * F.col("weight"))).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    bucket_docs: int = 512,
    size: Column | None = None,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken.

    * sources by code point, null last, take ``weights`` in turn and share ``share``
      times all words; no target exceeds ``most`` times its source's words;
    * ``taken`` is what the mix takes of the document, repeats counted: the whole
      epochs of its source, plus its part of the cut epoch. The document at the cut
      gives only the words up to the budget, so a source's taken words are the floor
      of its target exactly;
    * the order is md5(seed:id), ties by id, then size: reruns agree; rows equal in all
      three share one place, each handled as a row of its own;
    * null text has size 0 and is never taken; a null source is a source;
    * an empty table gives no rows; other columns are ignored, whatever their names.
    """
    # Rows without an id are told apart by their text.
    name = F.coalesce(F.col(id_col).cast("string"), F.xxhash64(text_of(text_col)).cast("string") if text_col in docs.columns else F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), name))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            (word_count(text_of(text_col)) if size is None else size).alias("size"),
            key.alias("key"),
        ),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sizes, weights, share, most).withColumn(
        "buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(bucket_docs))).cast("long")
    )
    plan = targets.select(F.col("source").alias("t_source"), "source_size", "target", "buckets")
    # 32 bits of the key, scaled to the source's number of buckets: order-preserving.
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).withColumn(
        "bucket", F.shiftright(high * F.col("buckets"), 32)
    )
    subtotals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    shelved = subtotals.withColumn("shelf", F.floor(F.col("bucket") / SHELF))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    shelves = shelved.groupBy("source", "shelf").agg(F.sum("words").alias("words"))
    shelves = shelves.select(F.col("source").alias("s_source"), F.col("shelf").alias("s_shelf"), F.coalesce(F.sum("words").over(upto("source").orderBy("shelf")), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("words").over(upto("source", "shelf").orderBy("bucket")), F.lit(0))
    offsets = (
        shelved.withColumn("inner", inner)
        .join(shelves, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shelf") == F.col("s_shelf")))
        .select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), (F.col("before") + F.col("inner")).alias("ahead"))
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("ahead") - F.col("inside")))
    return ordered.select(
        F.col("id").alias(id_col),
        F.col("size"),
        F.col("source_size"),
        F.col("target").cast("double").alias("target"),
        (epochs * F.col("size") + cut).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all its columns.

    * a row at its source's cut ends with the words up to the budget; ``length_col``, if
      the table has it, follows the cut text; whole rows keep their text as it is;
    * rows that repeat id and text are one row, unlike in ``mix_sources``;
    * rows without words (null, empty, white space) are never taken; a null source is a
      source; null ids are told apart by their text;
    * long texts are cut by words, not read partly; an empty table gives no rows; columns
      of any name, nulls in them included, come through as they are.
    """
    key = F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key")).dropDuplicates(["key"])
    plan = mix_sources(docs.select(key.alias("key"), docs[text_col].alias("text"), docs[source_col].alias("source")).dropDuplicates(["key"]), "key", "text", "source", **options)
    plan = plan.filter("taken > 0").select(F.col("key").alias("p_key"), "size", "taken")
    part = F.expr("taken % size")
    copies = rows.join(plan, F.col("key") == F.col("p_key")).select(
        "row", part.alias("part"), F.explode(F.concat(F.expr("array_repeat(true, cast(taken div size as int))"), F.expr("array_repeat(false, cast(taken % size > 0 as int))"))).alias("whole")
    )
    words = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("part").cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col("row")[text_col], words, F.lit(0))
    text = F.when(F.col("whole"), F.col("row")[text_col]).otherwise(head)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(text.alias(c))
        elif c == length_col:
            columns.append(F.when(F.col("whole"), F.col("row")[c]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return copies.select(*columns)
