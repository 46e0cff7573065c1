"""Line and group text files as DataFrames: (file, text) -> typed rows, without Python.

Texts are read whole, so records may not depend on the reader's line splits; CRLF and LF
both end a line. Numbers are read as the engine reads them: the numeric prefix, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import leading_float, leading_int, unsigned32


def lines(files: DataFrame) -> DataFrame:
    """(file, at, line) of the lines that are neither blank nor comments."""
    split = files.select("file", F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("at", "line"))
    return split.filter((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(?://|#)"))


def words(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def dungeons(files: DataFrame) -> DataFrame:
    """(file, name, x, y, sx, sy, dir): lines with a name and five numbers."""
    w = lines(files).select("file", words(F.col("line")).alias("w")).filter(F.size("w") >= 6)
    return w.select("file", F.col("w")[0].alias("name"), *[leading_int(F.col("w")[i + 1]).alias(n) for i, n in enumerate(("x", "y", "sx", "sy", "dir"))])


def indexes(files: DataFrame) -> DataFrame:
    """(file, number, name, duplicate): the second and later entries of a number are duplicates."""
    w = lines(files).select("file", "at", words(F.col("line")).alias("w")).filter(F.size("w") >= 2)
    e = w.select("file", "at", leading_int(F.col("w")[0]).alias("number"), F.col("w")[1].alias("name"))
    return e.select("file", "number", "name", (F.row_number().over(Window.partitionBy("file", "number").orderBy("at")) > 1).alias("duplicate"))


def towns(files: DataFrame) -> DataFrame:
    """(file, x, y, x1 .. y3): the first two numbers of a file, six more if eight stand."""
    n = lines(files).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", words(F.col("line")).alias("w")))).alias("l"))
    n = n.select("file", F.transform(F.flatten(F.transform("l", lambda x: x["w"])), leading_int).alias("n")).filter(F.size("n") >= 2)
    more = lambda i: F.when(F.size("n") >= 8, F.get("n", F.lit(i)))
    return n.select("file", F.col("n")[0].alias("x"), F.col("n")[1].alias("y"), *[more(2 + 2 * i + j).alias(f"{c}{i + 1}") for i in range(3) for j, c in enumerate("xy")])


def reserves(files: DataFrame) -> DataFrame:
    """(file, id): retired ids as unsigned 32 bits."""
    return lines(files).select("file", unsigned32(leading_int(F.col("line"))).alias("id"))


def pastes(files: DataFrame, magic: str) -> DataFrame:
    """(file, x, y, id, roll, bias) after the magic line and the count."""
    after = files.filter(F.split("text", "\\r\\n|\\n")[0] == magic).select("file", F.posexplode(F.split("text", "\\r\\n|\\n")).alias("at", "line")).filter("at >= 2")
    w = after.select("file", words(F.col("line")).alias("w")).filter(F.size("w") >= 8)
    number = lambda i: leading_float(F.col("w")[i])
    return w.select("file", number(0).alias("x"), number(1).alias("y"), leading_int(F.col("w")[3]).alias("id"), F.pmod(number(6), F.lit(360.0)).alias("roll"), number(7).alias("bias"))


def groups(files: DataFrame) -> DataFrame:
    """(file, key, values): the values of brace groups, keys led by their groups' names.

    The open groups of a line are folded over the lines before it; quoted words stay whole.
    """
    token = r'"([^"]*)"|(\S+)'
    split = F.filter(F.transform(F.split("text", "\\r\\n|\\n"), lambda x: F.transform(F.regexp_extract_all(x, F.lit(token), F.lit(0)), lambda t: F.regexp_replace(t, '^"|"$', ""))), lambda w: F.size(w) > 0)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<key:string,values:string>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        head = F.lower(w[0])
        entry = F.struct(F.array_join(F.concat(s["open"], F.array(head)), "/").alias("key"), F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), ",").alias("values"))
        opened = F.when(head == "group", F.concat(s["open"], F.array(F.lower(F.get(w, F.lit(1)))))).when(head == "}", F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        plain = ~head.isin("group", "{", "}")
        return F.struct(opened.alias("open"), F.when(plain, F.concat(s["out"], F.array(entry))).otherwise(s["out"]).alias("out"))

    folded = files.select("file", F.explode(F.aggregate(split, start, step, lambda s: s["out"])).alias("e"))
    return folded.select("file", "e.key", "e.values")
