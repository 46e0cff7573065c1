"""Personal data by weak supervision, in DataFrame expressions only.

Candidates are the strict matches of four patterns and, beside them, looser spellings
(obfuscated addresses, telephone numbers without a plus, long addresses, dotted card
numbers). Four labelers vote on each: a regex of the usual spellings, which holds for
some strict and some loose matches and against others, a gazetteer (top-level domains,
dialling codes, address ranges, issuer prefixes), the words before it, and its digits and
signs. Expectation-maximisation over the counts of equal vote patterns estimates each
labeler's reliability for each kind. Its soft labels train the final span classifier, a
naive Bayes over what the labelers do not look at: the span's length, the character
shapes at its beginning and end, its shape as a whole, and the neighbouring words. Strict
matches stay as they are; the classifier, with the labelers' posterior as its prior,
decides which looser candidates are added.

Texts are read once. What follows works on candidate arrays and on tables of counts by
votes and feature value, which have a bounded number of rows whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored, text_of

# Kinds in order and the strict patterns. Quantifiers are possessive where
# nothing could be given back, and an attempt begins at a run's start or where the last
# match ended, so that matching takes linear time and constant stack.
KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,5}",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# The gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|us|uk|de|fr|es|it|nl|eu|ch|at|be|pl|pt|se|no|dk|fi|ie|ca|au|nz|jp|cn|in|br|mx|ru"
DIALLING = "1|20|27|30|31|32|33|34|36|39|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|35[1-9]|37[0-8]|38[0-9]|42[01]|97[0-9]"
UNROUTED = r"^(?:0|10|127|192\.168|169\.254|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-8]|6[0245])"
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|send)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment|account|pay)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ring)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|serial|sku|build|rev)\b[^.]{0,12}$"
USUAL = {
    "email": r"(?i)^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20\.\x20?)[a-z0-9-]+)*(?:\.|[)\]]\x20?)[a-z]{2,}$",
    "ip": r"^(?:(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){3}|(?=.*[A-Fa-f])[0-9A-Fa-f:]+)$",
    "card": r"^(?:[0-9]{13,16}|[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,3}$",
}
LABELERS = ("regex", "gazetteer", "context", "shape")
#: The classifier's features and how many values each has.
FEATURES = {"length": 5, "head": 64, "tail": 64, "form": 128, "word_before": 256, "word_after": 256}
BEFORE = 40
BLOCK = 64
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a strict match stands."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def gazetteer(kind: str, m: Column) -> Column:
    """1 for, -1 against, 0 no vote."""
    if kind == "email":
        return F.when(m.rlike(rf"(?i)(?:\.|dot[\])])\x20?(?:{DOMAINS})$"), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(UNROUTED), -1).otherwise(1)
    if kind == "card":
        return F.when(digits(m).rlike(ISSUERS), 1).otherwise(-1)
    return F.when(m.startswith("+"), F.when(digits(m).rlike(f"^(?:{DIALLING})"), 1).otherwise(-1)).otherwise(
        F.when(digits(m).rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1)
    )


def context(kind: str, gap: Column) -> Column:
    near = F.substr(gap, F.greatest(F.lit(1), F.length(gap) - BEFORE + 1))
    return F.when(near.rlike(AGAINST), -1).when(near.rlike(CONTEXT[kind]), 1).otherwise(0)


def shape(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when((F.length(m) > 254) | m.rlike(r"\.\.|^\.|@-|-\.|\.-|-$"), -1).otherwise(1)
    if kind == "ip":
        return F.when(m.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1)
    if kind == "card":
        return F.when(digits(m).rlike(r"^([0-9])\1+$") | ~F.call_function("luhn_check", digits(m)), -1).otherwise(1)
    return F.when(digits(m).rlike(r"([0-9])\1{6}"), -1).when(m.rlike(r"\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), 1).otherwise(0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def block_starts(lengths: Column) -> Column:
    """Sums of the blocks of ``BLOCK`` lengths."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    return F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))


def usual(kind: str, m: Column) -> Column:
    return F.when(F.length(m) > 254, -1).when(m.rlike(USUAL[kind]), 1).otherwise(-1)


def form_of(m: Column) -> Column:
    """The first 64 characters with 9, A and a for digits, capitals and small letters."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.substr(m, F.lit(1), F.lit(64)), "012345678", "999999999"), "[A-Z]", "A"), "[a-z]", "a")


def features(m: Column, form: Column, before: Column, after: Column) -> Column:
    """One small number for each of ``FEATURES``: buckets of hashes of shapes and words."""
    runs = F.regexp_replace(form, r"(.)\1+", "$1+")
    word = lambda c, pattern: F.lower(F.regexp_extract(c, pattern, 0))
    near = F.substr(before, F.greatest(F.lit(1), F.length(before) - BEFORE + 1))
    texts = {
        "head": F.substr(form, F.lit(1), F.lit(3)),
        "tail": F.substr(form, F.greatest(F.lit(1), F.length(form) - 2)),
        "form": runs,
        "word_before": word(near, r"[\p{L}\p{N}]+(?=[^\p{L}\p{N}]*$)"),
        "word_after": word(F.substr(after, F.lit(1), F.lit(BEFORE)), r"[\p{L}\p{N}]+"),
    }
    buckets = [F.pmod(F.xxhash64(texts[name]), F.lit(n)).cast("int") for name, n in FEATURES.items() if name != "length"]
    return F.array(F.least(F.floor(F.length(m) / 8), F.lit(FEATURES["length"] - 1)).cast("int"), *buckets)


def candidates(kind: str, strict: bool, found: Column, gaps: Column, sizes: Column, blocks: Column) -> Column:
    """Spans with votes and features from the matches and the texts between them.

    ``sizes`` has the length of each text between with its match, ``blocks`` the sums of
    blocks of them: a start takes two short sums, so many matches stay affordable.
    """
    index = F.sequence(F.lit(0), F.size(found) - 1)
    k = KINDS.index(kind)

    def own(i: Column) -> Column:
        return F.struct(i.alias("i"), F.get(found, i).alias("m"), F.get(gaps, i).alias("gap"), F.coalesce(F.get(gaps, i + 1), F.lit("")).alias("after"))

    def span(x: Column) -> Column:
        m, gap, i = x["m"], x["gap"], x["i"]
        block = F.floor(i / BLOCK).cast("int")
        start = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(sizes, block * BLOCK + 1, i % BLOCK)) + F.length(gap)
        code = F.lit(0)
        for v in (usual(kind, m), gazetteer(kind, m), context(kind, gap), shape(kind, m)):
            code = code * 3 + (v + 1)
        return F.struct(
            start.cast("long").alias("start"),
            F.lit(k).alias("kind"),
            F.length(m).alias("length"),
            F.lit(strict).alias("base"),
            code.cast("int").alias("code"),
            features(m, x["form"], gap, x["after"]).alias("features"),
            (valid(kind, m) if strict else F.lit(True)).alias("stands"),
        )

    def closed(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (x["start"] + x["length"]).alias("end"), *[x[c].alias(c) for c in ("base", "code", "features", "stands")])

    # Step by step, so that each part is computed once.
    opened = F.transform(F.transform(index, own), lambda x: x.withField("form", form_of(x["m"])))
    return F.when(F.size(found) > 0, F.transform(F.filter(F.transform(opened, span), lambda x: x["stands"]), closed)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,code:int,features:array<int>,stands:boolean>>"


def vote_of(code: Column, j: int) -> Column:
    """The j-th labeler's vote, 0 to 2."""
    return (F.floor(code / 3 ** (len(LABELERS) - 1 - j)) % 3).cast("int")


def reliabilities(patterns: DataFrame, rounds: int = 8) -> tuple[list, list]:
    """EM for every kind: the share of true spans, and P(vote | true), P(vote | false).

    patterns: (kind, code, n). Each round is one aggregate of at most a few thousand
    rows, whose 4 result rows are the new parameters.
    """
    prior = [0.7] * len(KINDS)
    table = [[[[0.1, 0.3, 0.6], [0.5, 0.3, 0.2]] for _ in LABELERS] for _ in KINDS]
    for _ in range(rounds):
        votes = [vote_of(F.col("code"), j).alias(f"v{j}") for j in range(len(LABELERS))]
        rows = patterns.select("kind", "n", (F.col("n") * posterior(prior, table)).alias("soft"), *votes)
        sums = [F.sum("n").alias("n"), F.sum("soft").alias("t")]
        for j in range(len(LABELERS)):
            for v in range(3):
                hit = F.col(f"v{j}") == v
                sums += [F.sum(F.when(hit, F.col("soft")).otherwise(0.0)).alias(f"t{j}{v}"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"a{j}{v}")]
        for r in rows.groupBy("kind").agg(*sums).collect():
            k, true, false = r["kind"], r["t"], r["n"] - r["t"]
            prior[k] = (true + 7) / (r["n"] + 10)
            for j in range(len(LABELERS)):
                for v in range(3):  # smoothed towards the starting table
                    first = [[0.1, 0.3, 0.6], [0.5, 0.3, 0.2]]
                    table[k][j][0][v] = (r[f"t{j}{v}"] + 10 * first[0][v]) / (true + 10)
                    table[k][j][1][v] = (r[f"a{j}{v}"] - r[f"t{j}{v}"] + 10 * first[1][v]) / (false + 10)
    return prior, table


def posterior(prior: list, table: list) -> Column:
    """P(true | votes) of a pattern row (kind, code)."""
    odds = F.lit(0.0)
    for k in range(len(KINDS)):
        own = F.lit(math.log(prior[k] / (1 - prior[k])))
        for j in range(len(LABELERS)):
            ratio = F.array(*[F.lit(math.log(table[k][j][0][v] / table[k][j][1][v])) for v in range(3)])
            own = own + F.get(ratio, vote_of(F.col("code"), j))
        odds = F.when(F.col("kind") == k, own).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def span_classifier(counts: DataFrame, prior: list, table: list) -> dict[tuple[int, int], list[float]]:
    """Log-odds of every feature value for each (kind, feature): a naive Bayes.

    counts: (kind, code, feature, value, n). Trained on the soft labels, smoothed towards
    no evidence; the result has a number for each kind and value of ``FEATURES``.
    """
    soft = counts.withColumn("t", F.col("n") * posterior(prior, table))
    sums = soft.groupBy("kind", "feature", "value").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    sizes = list(FEATURES.values())
    weights = {(k, f): [0.0] * n for k in range(len(KINDS)) for f, n in enumerate(sizes)}
    for k, f in weights:
        own = [r for r in sums if (r["kind"], r["feature"]) == (k, f)]
        true, false = sum(r["t"] for r in own), sum(r["n"] - r["t"] for r in own)
        for r in own:  # a value's share of true and false spans, each with one observation spread by size
            part = r["n"] / (true + false)
            weights[k, f][r["value"]] = math.log((r["t"] + part) / (true + 1)) - math.log((r["n"] - r["t"] + part) / (false + 1))
    return weights


def classified(kind: Column, code: Column, values: Column, prior: list, table: list, weights: dict) -> Column:
    """P(personal data) of a candidate: the labelers' log-odds and the classifier's weights."""
    odds = F.lit(0.0)
    for k in range(len(KINDS)):
        own = F.lit(math.log(prior[k] / (1 - prior[k])))
        for j in range(len(LABELERS)):
            ratio = F.array(*[F.lit(math.log(table[k][j][0][v] / table[k][j][1][v])) for v in range(3)])
            own = own + F.get(ratio, vote_of(code, j))
        for f in range(len(FEATURES)):
            own = own + F.get(F.array(*[F.lit(w) for w in weights[k, f]]), F.get(values, F.lit(f)))
        odds = F.when(kind == k, own).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    * counts and digest are of the strict spans, ``spans`` holds these and the added
      ones (probability of at least ``least``, not overlapping a strict span), each as
      kind:start:end in code points, end exclusive, by start, then kind;
    * null and empty texts have none; texts of any length are read whole; repeated rows
      and null ids are reported each; an empty table gives no rows; other columns are
      ignored, whatever their names; spans of one start are ordered by kind, then end.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    may = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+")) & digit, "ip": digit, "card": digit}
    also = {"email": F.col("text").rlike(r"(?i)[(\[]at[)\]]"), "ip": F.col("text").rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "card": digit, "phone": digit}
    none = F.array().cast("array<string>")
    for kind in KINDS:
        rows = rows.withColumn(f"m_{kind}", F.when(may[kind], F.regexp_extract_all("text", F.lit(STRICT[kind]), F.lit(0))).otherwise(none))
        rows = rows.withColumn(f"l_{kind}", F.when(also[kind], F.regexp_extract_all("text", F.lit(LOOSE[kind]), F.lit(0))).otherwise(none))
    for kind in KINDS:
        for name, pattern in ((f"m_{kind}", STRICT[kind]), (f"l_{kind}", LOOSE[kind])):
            rows = rows.withColumn(f"g_{name}", F.when(F.size(name) > 0, F.split("text", pattern, -1)).otherwise(none))
            size = F.zip_with(f"g_{name}", name, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
            rows = rows.withColumn(f"s_{name}", size)
            rows = rows.withColumn(f"b_{name}", F.when(F.size(name) > 0, block_starts(F.col(f"s_{name}"))).otherwise(F.array().cast("array<bigint>")))
    parts = [candidates(kind, name[0] == "m", *[F.col(f"{x}{name}") for x in ("", "g_", "s_", "b_")]) for kind in KINDS for name in (f"m_{kind}", f"l_{kind}")]
    spans = stored(rows.select("id", F.concat(*parts).alias("spans")), "spans")

    each = spans.select(F.explode("spans").alias("s"))
    patterns = stored(each.groupBy("s.kind", "s.code").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    prior, table = reliabilities(patterns)
    flat = each.select("s.kind", "s.code", F.posexplode("s.features").alias("feature", "value"))
    weights = span_classifier(flat.groupBy("kind", "code", "feature", "value").agg(F.count(F.lit(1)).alias("n")), prior, table)
    strict = F.filter("spans", lambda s: s["base"])
    kept = F.filter(
        "spans",
        lambda s: s["base"]
        | (
            (classified(s["kind"], s["code"], s["features"], prior, table, weights) >= least)
            & ~F.exists("strict", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda a: F.concat_ws(
        ",", F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda k: F.size(F.filter("strict", lambda s: s["kind"] == k)).cast("long")
    out = spans.withColumn("strict", strict).withColumn("kept", kept)
    return out.select(
        F.col("id").alias(id_col),
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(line(F.col("strict")).cast("binary"), 256).alias("base_sha256"),
        line(F.col("kept")).alias("spans"),
        (F.size("kept") - F.size("strict")).cast("long").alias("n_added"),
    )
