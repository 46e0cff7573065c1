"""Language identification by interpolated Kneser-Ney character models.

Texts are read as words of letters, lower-cased, between single boundaries. For each
language the model of order four keeps, in arrays sorted by a bijective hash of the
n-gram, the counts of the highest order, the continuation counts of the lower ones, and
for every context its total and its number of followers. A text is scored whole by every
language's model; the lowest length-normalised cross-entropy wins.

Rejection is calibrated on a fold that trained no model. A text's excess over the
language's median cross-entropy, divided by what varies between texts of its length (a
part that shrinks with the root of the scored characters, and one that does not), is
compared with the quantile of the calibration texts' excesses that leaves a share of
``false_rejection`` of them out, times ``slack``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shingles import mix

ORDER = 4
WIDTH = 16  # bits of a character in a packed n-gram
FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


_letters: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """16-bit code of every code point's lower-case form; 0 where it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = ord(s.lower()[0])
                table[c] = low if low < 0x10000 else 0xE000 + low % 0x1900  # a private range
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of the highest order, text position) of all scored characters."""
    gap = "\x00" * (ORDER - 1)
    parts = [t or "" for t in texts]
    joined = gap + gap.join(parts) + gap
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(parts)), [len(p) + ORDER - 1 for p in parts])
    codes, owner = codes[ORDER - 1 :], owner
    begins = np.cumsum([0, *(len(p) + ORDER - 1 for p in parts)])
    edge = np.zeros(len(codes), bool)
    for back in range(1, ORDER):  # the gaps stay whole, so no context spans two texts
        edge[begins[1:] - back] = True
    letter = codes > 0
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    keep = letter | after | edge
    codes, owner, scored = codes[keep].astype(np.uint64), owner[keep], (letter | after)[keep]
    packed = codes.copy()
    for back in range(1, ORDER):
        packed[back:] |= codes[:-back] << np.uint64(WIDTH * back)
    return packed[scored], owner[scored]


def batches_of(texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size < most_chars):
            size += len(texts[at] or "")
            at += 1
        yield first, texts[first:at]


@dataclass
class Order:
    """One order's sorted hash arrays."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    followers: np.ndarray
    discount: float


def sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of their values and their number."""
    own, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return own, np.bincount(at, values, len(own)), n


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[at] == wanted, values[at], 0.0) if len(keys) else np.zeros(len(wanted))


class KneserNey:
    """A language's model, from the packed n-grams of the highest order."""

    def __init__(self, packed: np.ndarray, counts: np.ndarray) -> None:
        self.orders: list[Order] = []
        keys, values = packed.astype(np.uint64), counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            once, twice = (values == 1).sum(), (values == 2).sum()
            discount = float(once / (once + 2 * twice)) if once and twice else 0.5
            context, totals, followers = sums(mix(keys >> np.uint64(WIDTH)), values)
            hashed = mix(keys)
            order = np.argsort(hashed)
            self.orders.append(Order(hashed[order], values[order], context, totals, followers.astype(np.float64), discount))
            if n > 1:  # the lower order counts the distinct characters before an n-gram
                shorter = keys & np.uint64((1 << WIDTH * (n - 1)) - 1)
                keys, n_before = np.unique(shorter, return_counts=True)
                values = n_before.astype(np.float64)
        self.floor = 1.0 / (len(keys) + 1)

    def log_prob(self, packed: np.ndarray) -> np.ndarray:
        prob = np.full(len(packed), self.floor)
        for n, order in zip(range(1, ORDER + 1), reversed(self.orders), strict=True):
            key = packed if n == ORDER else packed & np.uint64((1 << WIDTH * n) - 1)
            context = mix(key >> np.uint64(WIDTH))
            total, followers = found(order.contexts, order.totals, context), found(order.contexts, order.followers, context)
            seen = total > 0
            total = np.where(seen, total, 1.0)
            direct = np.maximum(found(order.grams, order.counts, mix(key)) - order.discount, 0.0) / total
            prob = np.where(seen, direct + order.discount * followers / total * prob, prob)
        return np.log(prob)


def cross_entropies(models: list[KneserNey], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x models) cross-entropy in nats a character, and the characters scored."""
    entropy, length = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)
    for first, part in batches_of(texts):
        packed, owner = grams(part)
        own, at = np.unique(packed, return_inverse=True)
        here = slice(first, first + len(part))
        length[here] = np.bincount(owner, minlength=len(part))
        for m, model in enumerate(models):
            total = np.bincount(owner, model.log_prob(own)[at], len(part))
            entropy[here, m] = -total / np.maximum(length[here], 1)
    return entropy, length


@dataclass
class Identifier:
    """The trained models and the calibrated limits of each language."""

    languages: list[str]
    models: list[KneserNey]
    centre: np.ndarray
    spread: np.ndarray
    floor: np.ndarray
    limit: np.ndarray

    def excess(self, entropy: np.ndarray, best: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How far above the language's median a text lies, in what is usual at its length."""
        usual = np.sqrt(self.floor[best] ** 2 + self.spread[best] ** 2 / np.maximum(length, 1))
        return (entropy - self.centre[best]) / usual


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-gram counts, summed inside the tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                for _, part in batches_of(own["text"].tolist()):
                    keys, n = np.unique(grams(part)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    return docs.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    docs_per_language: int = 2000,
    calibration_docs: int = 1000,
    chars_per_language: int = 8_000_000,
    most_languages: int = 500,
    false_rejection: float = 0.002,
    slack: float = 2.0,
    wanted: Sequence[str] | None = None,
) -> Identifier | None:
    """Models of every language, from whole texts of a bounded sample of labelled rows.

    About ``docs_per_language`` documents of folds 1 to 3 train a language, or as many
    as have about ``chars_per_language`` characters if that is less, and about
    ``calibration_docs`` of fold 4 calibrate it; rows are picked by a hash of the id, at
    a rate from the language's counts over all rows. These bounds and ``most_languages``
    bound what the driver gathers (an error beyond that many). Languages that are not
    ``wanted`` compete too, but their texts are rejected; None wants all.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold(id_col).alias("fold"))
    rows = rows.filter("fold > 0 AND text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(
        F.count_if(F.col("fold") < 4).alias("train"), F.count_if(F.col("fold") == 4).alias("check"), F.sum(F.when(F.col("fold") < 4, F.length("text"))).alias("chars")
    )
    sizes = {r["lang"]: r for r in counts.orderBy("lang").limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    languages = sorted(k for k, r in sizes.items() if r["train"])
    if not languages:
        return None
    share = lambda most, n: min(1 << 20, (most << 20) // max(1, n or 0))
    rates = spark.createDataFrame(
        [(k, min(share(docs_per_language, sizes[k]["train"]), share(chars_per_language, sizes[k]["chars"])), share(calibration_docs, sizes[k]["check"])) for k in languages],
        "l string, rate long, check_rate long",
    )
    drawn = rows.join(F.broadcast(rates), F.col("lang") == F.col("l")).withColumn("draw", F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(1 << 20)))
    learn = counted(drawn.filter("fold < 4 AND draw < rate").select("lang", "text"))
    table = learn.toPandas()
    models, kept = [], []
    for lang in languages:
        own = table[table["lang"] == lang]
        if len(own):
            models.append(KneserNey(own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()))
            kept.append(lang)
    if not kept:
        return None
    shared = spark.sparkContext.broadcast((kept, models))

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, own = shared.value
        for batch in batches:
            entropy, length = cross_entropies(own, batch["text"].tolist())
            at = batch["lang"].map({k: i for i, k in enumerate(names)}).fillna(-1).to_numpy(int)
            fine = (at >= 0) & (length > 0)
            h = entropy[np.arange(len(at)), at]
            yield pd.DataFrame({"lang": batch["lang"][fine], "h": h[fine], "n": length[fine]})

    # About calibration_docs rows a language, two numbers each.
    checked = drawn.filter("fold = 4 AND draw < check_rate").select("lang", "text").mapInPandas(calibrate, "lang string, h double, n long").toPandas()
    n = len(kept)
    model = Identifier(kept, models, np.full(n, np.log(1 << WIDTH)), np.zeros(n), np.ones(n), np.full(n, np.inf))  # not calibrated: rejects nothing
    for i, lang in enumerate(kept):
        own = checked[checked["lang"] == lang]
        if len(own):
            h, length = own["h"].to_numpy(), own["n"].to_numpy(np.float64)
            model.centre[i] = np.median(h)
            off = np.abs(h - model.centre[i])
            model.spread[i] = 1.4826 * np.median(off * np.sqrt(length))
            longer = off[length >= np.median(length)]
            model.floor[i] = max(1.4826 * np.median(longer), 0.02)
            excess = model.excess(h, np.full(len(h), i), length)
            model.limit[i] = slack * max(1.0, np.quantile(excess, 1 - false_rejection))
        if wanted is not None and lang not in set(wanted):
            model.limit[i] = -np.inf
    return model


VERDICT = "lang_pred string, score double, cross_entropy double, accepted boolean"


def verdict_of(docs: DataFrame, model: Identifier | None):
    """A column function of the text: the struct ``VERDICT``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            n = len(texts)
            pred, score, lowest, accepted = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if own is not None and n:
                entropy, length = cross_entropies(own.models, texts.tolist())
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(n), best]
                odds = np.exp(-(entropy - low[:, None]) * np.minimum(length, 64)[:, None])
                real = length > 0
                pred[real] = np.array(own.languages, object)[best[real]]
                score[real], lowest[real] = (1 / odds.sum(axis=1))[real], low[real]
                accepted = real & (own.excess(low, best, length) <= own.limit[best])
            yield pd.DataFrame({"lang_pred": pred, "score": score, "cross_entropy": lowest, "accepted": accepted})

    return verdict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, cross_entropy, accepted.

    * learns only from rows with text, id and language outside fold 0 (``train`` has the
      options);
    * ``und``, score 0, not accepted: the text is null or has no letter, or no language
      could be learned; the score is the winner's share among the languages, by
      likelihood of up to 64 characters;
    * whole texts of any length are scored; repeated rows get the same answer; equal
      cross-entropies go to the first language by code point; a null id is not held
      out; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    judged = rows.select("id", "held_out", verdict_of(docs, model)("text").alias("v"))
    return judged.select(
        F.col("id").alias(id_col), "held_out", "v.lang_pred", "v.score", F.nanvl("v.cross_entropy", F.lit(None)).alias("cross_entropy"), "v.accepted"
    )


def accepted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows, with all their columns, whose language is learned, wanted and accepted.

    * rows whose text is null, empty or without a letter go, and so do all rows where no
      language could be learned;
    * rows that repeat stay or go together; null ids, languages and sources are no
      reason to go; long texts are scored whole; an empty table gives no rows; columns
      of any name come through as they are.
    """
    model = train(docs, id_col, text_col, lang_col, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), verdict_of(docs, model)(docs[text_col]).alias("_v"))
    return rows.filter("_v.accepted").select("_row.*")
