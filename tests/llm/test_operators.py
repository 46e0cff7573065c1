"""Every training-data operator against brute force, and on awkward tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, langid, materialise, mixing, ngram_join, packing, pii, token_count, topk, url_graph

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string"


def syllables(seed: int, n: int, parts: str = "the an re tion ou éa der ich") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(parts.split(), k=rng.randint(1, 4))) for _ in range(n))


def near_copy(text: str, seed: int, edits: int) -> str:
    words, rng = text.split(" "), random.Random(seed)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeats, copies, near copies."""
    base = [syllables(i, 120 + i) for i in range(6)]
    passage = syllables(99, 60)
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 3], "en", "s0") for i in range(9)]
    rows += [(200 + i, near_copy(base[i % 4], i, 1 + i % 5), "en", "s1") for i in range(40)]
    rows += [(300 + i, f"{passage} {syllables(500 + i, 40)}", "en", None) for i in range(12)]
    rows += [(400, None, None, None), (401, "", "en", "s9"), (402, "  \t\n", None, "s0"), (None, "no id here", "en", "s1"), (403, "one two", None, "s2"), (404, "One TWO", "en", "s2")]
    rows += [(405, "x" * 50_000, "en", "s2"), (406, "word " * 9_000, "en", "s2"), (407, "1234 !? 5678", "en", "s2")]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    table = spark.createDataFrame(corpus(), DOCS).repartition(3)
    for c in ("id", "key", "size", "sig", "n", "component_id", "_text", "kept", "keep_id", "taken", "shard", "host", "spans"):
        table = table.withColumn(c, F.lit(1))
    return table.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, nothing):
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Groups above two rows are salted; their runs agree by comparing texts.
    salted = [tuple(r) for r in exact_dedup.exact_dedup(docs, least_hot=2).collect()]
    assert sorted(salted, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.kept_rows(nothing).count() == 0
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(((r["text"] or "", r["doc_id"]) for r in kept.collect()), key=str) == sorted(last.items(), key=str)


def brute_components(rows: list[tuple]) -> list[tuple]:
    sets = []
    for _, t, *_ in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[root(j)] = root(i)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i), d)) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("part_size", [250_000, 900])
def test_ngram_join(docs, nothing, part_size):
    got = [tuple(r) for r in ngram_join.ngram_join(docs, part_size=part_size, hot=2).collect()]
    assert sorted(got, key=str) == sorted(brute_components(corpus()), key=str)
    if part_size > 900:
        assert ngram_join.ngram_join(nothing).count() == 0 and ngram_join.distinct_rows(nothing).count() == 0
        least = {}
        for (i, n, c) in brute_components(corpus()):
            least.setdefault(c if n else (i, "alone"), []).append(i)
        kept = ngram_join.distinct_rows(docs)
        want = sorted((k[0] if isinstance(k, tuple) else k for k in least), key=str)
        assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_distinct_rows_with_repeated_ids(spark):
    """An id that stands for one class and repeats in another keeps the first class only."""
    a, b, c = syllables(1, 100), syllables(2, 100), syllables(3, 100)
    rows = [(1, a), (5, near_copy(a, 1, 1)), (2, b), (5, c), (None, near_copy(c, 2, 1)), (None, "x y"), (None, "x y"), (7, None), (7, None)]
    kept = ngram_join.distinct_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (2, b), (5, c), (None, "x y"), (7, None), (7, None)], key=str)


def test_components_of_a_crowded_star(spark):
    from gridloom.llm.components import components

    edges = [(0, i) for i in range(1, 60)] + [(i, 100 + i) for i in range(1, 60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300), (301, 302), (301, 302)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), least_hot=3).collect()}
    want = {n: 0 for n in [*range(60), *range(101, 160)]} | {n: 200 for n in range(200, 231)} | {301: 301, 302: 301}
    assert got == want and components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_links_incremental():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.choice(400, 60, replace=False)
        for _ in range(rng.integers(1, 9)):
            drop = rng.random(60) > rng.random() * 0.2
            sets.append(np.unique(np.concatenate([base[drop], rng.choice(400, rng.integers(1, 8))])).astype(np.uint64))
    links = {frozenset(p) for p in ngram_join.exact_links([], sets, 80)}
    want = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            want.add(frozenset((i, j)))
    assert links == want and len(want) > 20


def test_mixing(docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s in corpus():
        sizes[s] += len(WORDS.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(names, itertools.cycle((5, 2, 1))))
    target, free, budget = {}, set(names), 1.5 * sum(sizes.values())
    while free:  # reshare until no target is above twice its source
        level = (budget - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in free}
        free = free - over if over else set()
    by = {i: s for i, _, _, s in corpus()}
    taken = collections.Counter()
    for r in rows:
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(corpus()) and all(abs(taken[s] - target[s]) < 1.001 for s in names)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(nothing).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns


def test_mixed_rows_cut(spark):
    rows = [(i, " ".join([f"w{i}"] * (i + 3)), "en", f"s{i % 2}") for i in range(30)]
    table = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text"))
    plan = {r["doc_id"]: r for r in mixing.mix_sources(table.withColumn("key", F.lit(0))).collect()}
    got = mixing.mixed_rows(table).collect()
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    words = collections.Counter()
    for r in got:
        words[f"s{r['doc_id'] % 2}"] += len(r["text"].split())
    for s in ("s0", "s1"):
        assert words[s] == int(next(p["target"] for i, p in plan.items() if f"s{i % 2}" == s))


def encoded(path: str, text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    encoded.cache = getattr(encoded, "cache", {})
    if path not in encoded.cache:
        encoded.cache[path] = Tokenizer.from_file(path)
    return encoded.cache[path].encode(text or "", add_special_tokens=False).ids


AWKWARD = ["don't won't 'S it's!'s  x", " \n\n a\t\tb  ", "<|endoftext|>a<|endoftext|>", "Ünïcödé ΣΊΣ ١٢ ½ 日本 \x1c\x85 é", "a" * 3000, " " * 500 + "b", "'", "''ll 'll"]


def test_packing(docs, nothing):
    got = packing.pack_documents(docs, WORD_VOCABULARY, capacity=64, shelf_pieces=200).collect()
    want = collections.Counter()
    for i, t, *_ in corpus():
        ids = [*encoded(WORD_VOCABULARY, t), 0]
        for p, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 64 + 20
    assert packing.pack_documents(nothing, WORD_VOCABULARY).count() == 0


def test_local_search():
    rng = random.Random(1)
    square = lambda b, sizes: sum(sum(sizes[i] for i in x) ** 2 for x in b)
    for sizes in ([rng.randint(1, 100) for _ in range(300)], [60, 50, 41, 40], [34, 33, 33] * 20, [1] * 250, [100] * 5, [1], []):
        bins = packing.next_fit(sizes, 100)
        better = packing.local_search(bins, sizes, 100)
        assert sorted(i for b in better for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in better) and len(better) <= len(bins) and square(better, sizes) >= square(bins, sizes)


def test_local_search_empties_bins():
    # A move and a two-for-one exchange mend these bins.
    sizes = [70, 20, 10, 50, 30, 20]
    assert len(packing.local_search([[0, 1], [3, 4], [2, 5]], sizes, 100)) == 2


def test_local_search_on_real_lengths():
    import pyarrow.parquet as pq

    from gridloom.llm.tokens import token_ids

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = [len(a) + 1 for a in token_ids(WORD_VOCABULARY, texts)]
    sizes = [n for x in lengths for n in [2048] * (x // 2048) + [x % 2048] * (x % 2048 > 0)]
    start, least = packing.next_fit(sizes, 2048), -(-sum(sizes) // 2048)
    packed = packing.local_search(start, sizes, 2048)
    assert len(start) > 1.1 * least and len(packed) <= 1.002 * least + 1  # the search empties a tenth of the bins
    again = packing.LocalSearch(packed, sizes, 2048)
    open_bins = [b for b in range(len(again.bins)) if again.fill[b] < 2048]
    assert len(packed) == least or not any(again.step(b) for b in open_bins)  # a fixed point


def test_tokens_equal_library(spark):
    from gridloom.llm.tokens import token_ids

    rng = random.Random(3)
    texts = AWKWARD + ["".join(rng.choices("abE'st \n.,!é1ñΣ́日<|>", k=rng.randint(0, 60))) for _ in range(500)]
    texts += [None, "", "x" * 5000 + " y", "É×ßÿ À'B ñ\x85\xa0¿q ́a", "word " * 3000]
    want = [encoded(WORD_VOCABULARY, t) for t in texts]
    for most in (1_000_000, 100):  # long texts are cut at a space
        assert [a.tolist() for a in token_ids(WORD_VOCABULARY, texts, most)] == want


def test_materialise(docs, nothing, tmp_path):
    for total in (1, 2, 5, 1000, 65_537):
        assert sorted(materialise.feistel_slots(np.arange(total), total, 9).tolist()) == list(range(total))
    out = f"file://{tmp_path}/shards"
    manifest = materialise.materialise(docs, WORD_VOCABULARY, out, stride=128, shard_slots=50)
    rows = manifest.orderBy("slot").collect()
    stored = list(materialise.read_slots(out, 0, len(rows) + 5, 128, 50))
    assert [r["slot"] for r in rows] == list(range(len(rows))) and len(stored) == len(rows)
    for r, ids in zip(rows, stored, strict=True):
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r["ids_crc32"]
    assert [a.tolist() for a in materialise.read_slots(out, 47, 8, 128, 50)] == [a.tolist() for a in stored[47:55]]
    tokens = collections.defaultdict(collections.Counter)
    for p in materialise.document_places(manifest).collect():
        tokens[p["doc_id"]].update(stored[p["slot"]][p["offset"] : p["offset"] + p["length"]].tolist())
    want = collections.defaultdict(collections.Counter)
    for i, t, *_ in corpus():
        want[i].update([*encoded(WORD_VOCABULARY, t), 0])
    assert tokens == want
    shards = sorted(tmp_path.glob("shards/shard-*"))
    assert all(re.fullmatch(r"shard-\d{6}\.bin", p.name) for p in shards) and len(shards) == -(-len(rows) // 50)
    # A call that was broken off: one shard is missing, the others stay as they are.
    lost, stamp = shards[0].read_bytes(), shards[1].stat().st_mtime_ns
    shards[0].unlink()
    again = materialise.materialise(docs, WORD_VOCABULARY, out, stride=128, shard_slots=50)
    assert again.count() == len(rows) and shards[0].read_bytes() == lost and shards[1].stat().st_mtime_ns == stamp
    assert materialise.materialise(nothing, WORD_VOCABULARY, f"file://{tmp_path}/none").count() == 0


def test_token_count(docs, nothing):
    want = sorted((str(i), len((t or "").encode()), len(encoded(BYTE_VOCABULARY, t))) for i, t, *_ in corpus())
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(docs, BYTE_VOCABULARY).collect())
    assert got == want
    assert token_count.count_tokens(nothing, BYTE_VOCABULARY).count() == 0
    counter = token_count.TokenCounter(BYTE_VOCABULARY)
    rng = random.Random(2)
    texts = AWKWARD + ["".join(rng.choices("abE'stlvred  \n\t.,!é1ñ日", k=rng.randint(0, 1500))) for _ in range(200)]
    assert counter.counts(texts).tolist() == [len(encoded(BYTE_VOCABULARY, t)) for t in texts]


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist() if i % 3 else (rng.random(6) - 0.5).tolist()) for i in range(150)]
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (None, [1.0] * 6), (220, [1.0, 2.0]), (240, [0.5] * 6), (241, rows[7][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, query_block=3, row_block=40).collect()]
    use = {i: np.floor(64 * np.array(v)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in use if i % 20 == 0):
        scored = sorted((-int(use[q] @ v), i) for i, v in use.items() if i != q and len(v) == len(use[q]))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:20])]
    assert sorted(got) == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["rank"], r["vec_id"]) for r in topk.top_k(few).collect()) == [(1, 1), (2, 2)]
    assert topk.top_k(few.filter("false")).count() == 0
    huge = spark.createDataFrame([(0, [3.0e7, 1.0]), (1, [3.0e7 + 1, 7.0]), (2, [-1.0, 1.0]), (3, [3.0e7, 1.0]), (3, [3.0e7, 1.0])], "vec_id long, embedding array<double>")
    use = {0: (1_920_000_000, 64), 1: (1_920_000_064, 448), 2: (-64, 64), 3: (1_920_000_000, 64)}
    want = [(1, use[0][0] * use[1][0] + 64 * 448), (3, use[0][0] ** 2 + 64 * 64), (3, use[0][0] ** 2 + 64 * 64), (2, use[0][0] * -64 + 64 * 64)]
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(huge).orderBy("rank").collect()] == want  # beyond 2^53


def test_language_id(spark, docs, nothing):
    tongues = {"en": "the an ing tion ed to of and st ha", "de": "der ung ich sch keit ein ver zu ü ß", "fr": "le aux ou eu é è que tion ré ai"}
    rows = [(i, syllables(i, 60, p), lang, "s") for i, (lang, p) in enumerate(list(tongues.items()) * 80)]
    rows += [(1000, None, "en", "s"), (1001, "12 34 !", "en", "s"), (1002, "", None, "s"), (None, syllables(5, 40, tongues["de"]), "de", "s"), (1003, "ひらがな カタカナ " * 30, None, "s")]
    table = spark.createDataFrame(rows, DOCS).withColumn("fold", F.lit(0)).withColumn("n", F.lit(0))
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    held = [(i, lang) for i, _, lang, _ in rows[:240] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and all(got[i]["held_out"] and got[i]["lang_pred"] == lang and got[i]["accepted"] for i, lang in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None]["lang_pred"] == "de"
    assert not got[1003]["accepted"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rejection_of_an_unlearned_language(spark):
    """At a false rejection of at most 2 %, a Latin-script language left out of training is rejected."""
    tongues = {"en": "the an ing tion ed to of and st ha", "de": "der ung ich sch keit ein ver zu ü ß", "fr": "le aux ou eu é è que tion ré ai"}
    stranger = "kwa mto ji bu zi nda ngo wa tu li ha pe"
    rows = [(i, syllables(i, 30 + i % 60, p), lang, "s") for i, (lang, p) in enumerate(list(tongues.items()) * 200)]
    rows += [(1000 + i, syllables(9000 + i, 30 + i % 60, stranger), None, "s") for i in range(200)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    false_rejection = sum(not got[i]["accepted"] for i in held) / len(held)
    rejection = sum(not got[1000 + i]["accepted"] for i in range(200)) / 200
    assert false_rejection <= 0.02 and rejection >= 0.98
    stay = langid.accepted_rows(spark.createDataFrame(rows, DOCS), wanted=["de"])
    langs = {r["lang"] for r in stay.collect()}
    assert langs == {"de"} and langid.accepted_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_kneser_ney_equals_dictionaries():
    """Against interpolated Kneser-Ney written with plain dictionaries of strings."""
    texts = ["banana bandana", "an band, a Ban", "ab abba cab"]
    packed, _ = langid.grams(texts)
    own, n = np.unique(packed, return_counts=True)
    model = langid.KneserNey(own, n)
    order, grams = langid.ORDER, []
    for t in texts:
        letters = "".join(c.lower() if c.isalpha() else " " for c in t)
        line = "^" * (order - 1) + " ".join(letters.split()) + " "
        grams += [line[i : i + order] for i in range(len(line) - order + 1)]
    grams = [g.replace("^", " ") for g in grams]  # outside words there is one symbol
    counts = {order: collections.Counter(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    vocabulary = len(counts[1])

    def prob(gram: str) -> float:
        k = len(gram)
        if k == 0:
            return 1 / (vocabulary + 1)
        once, twice = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        followers = [v for g, v in counts[k].items() if g[:-1] == gram[:-1]]
        lower = prob(gram[1:])
        if not followers:
            return lower
        return (max(counts[k][gram] - discount, 0) + discount * len(followers) * lower) / sum(followers)

    def unpacked(x: int) -> str:
        return "".join(chr(c) if c else " " for c in (x >> 48 & 0xFFFF, x >> 32 & 0xFFFF, x >> 16 & 0xFFFF, x & 0xFFFF))

    other, _ = langid.grams(["nab a cabana", "xylo"])
    asked = np.unique(np.concatenate([own, other]))
    want = [np.log(prob(unpacked(int(x)))) for x in asked]
    assert len(asked) > 30 and np.allclose(model.log_prob(asked), want, rtol=0, atol=1e-9)


def strict_spans(text: str | None) -> list[tuple]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(spark, nothing):
    rng = random.Random(3)
    bits = [*"ab.@@-_ 0123456789+() é", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (634) 555-2085", "call (634) 555-2085 ", "256.1.1.1", "mail bob [at] x.org", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 50))) for _ in range(600)]
    texts += [None, "", "1" * 20_000, "a" * 30_000 + "@", "1.1" * 9_000, "+1" + " 2" * 9_000, "a@b" + ".c" * 9_000, " ".join(["a@b.c"] * 500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("strict", F.lit(1))
    got = {r["doc_id"]: r for r in pii.find_pii(table).collect()}
    for i, t in enumerate(texts):
        want = strict_spans(t)
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[1] == k for w in want) for k in range(4)]
        assert set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
    assert pii.find_pii(nothing).count() == 0
    twice = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co"), (7, None), (7, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_email"]) for r in pii.find_pii(twice).collect()) == [("7", 0), ("7", 0), ("None", 1), ("None", 1)]


def test_pii_adds_spans(spark):
    """Loose spellings in the company of telephone numbers are added, serial numbers are not."""
    rng = random.Random(5)
    area = lambda: rng.randint(201, 989)
    texts = [f"please call +1 ({area()}) {area()}-{rng.randint(1000, 9999)} today" for _ in range(120)]
    good = [f"please call ({area()}) {area()}-{rng.randint(1000, 9999)} today" for _ in range(60)]
    bad = [f"order serial no {rng.randint(100, 199)} {rng.randint(100, 199)} {rng.randint(1000, 9999)} x" for _ in range(60)]
    mails = [f"write to {w}{i} [at] mail{i % 7} [dot] example [dot] com now" for i, w in enumerate(["anna", "bob"] * 30)]
    table = spark.createDataFrame(list(enumerate(texts + good + bad + mails)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(table).collect()}
    added = lambda a, b: sum(got[i]["n_added"] for i in range(a, b))
    assert added(0, 120) == 0 and added(120, 180) == 60 and added(180, 240) == 0 and added(240, 300) == 60
    start, text = 12, good[0]
    assert got[120]["spans"] == f"phone:{start}:{text.index(' today')}" and got[120]["n_phone"] == 0


def test_pii_em_equals_plain_python(spark):
    rng = random.Random(8)
    rows = [(k, code, rng.randint(1, 400)) for k in range(4) for code in rng.sample(range(81), 30)]
    prior, table = pii.reliabilities(spark.createDataFrame(rows, "kind int, code int, n long"), rounds=5)
    first = [[0.1, 0.3, 0.6], [0.5, 0.3, 0.2]]
    vote = lambda code, j: code // 3 ** (3 - j) % 3
    for kind in range(4):
        own = [(code, n) for k, code, n in rows if k == kind]
        p, t = 0.7, [[list(first[0]), list(first[1])] for _ in range(4)]
        for _ in range(5):
            soft = []
            for code, n in own:
                yes, no = p, 1 - p
                for j in range(4):
                    yes, no = yes * t[j][0][vote(code, j)], no * t[j][1][vote(code, j)]
                soft.append((code, n, n * yes / (yes + no)))
            total, true = sum(n for _, n, _ in soft), sum(x for *_, x in soft)
            p = (true + 7) / (total + 10)
            for j in range(4):
                for v in range(3):
                    yes, both = sum(x for c, _, x in soft if vote(c, j) == v), sum(n for c, n, _ in soft if vote(c, j) == v)
                    t[j][0][v], t[j][1][v] = (yes + 10 * first[0][v]) / (true + 10), (both - yes + 10 * first[1][v]) / (total - true + 10)
        assert prior[kind] == pytest.approx(p, rel=1e-9)
        assert np.allclose(table[kind], t, rtol=1e-9)


def test_propagation_equals_dense_pagerank(spark):
    """Against the dense personalised PageRank of a random graph of 200 hosts, some without links."""
    rng = np.random.default_rng(6)
    n = 200
    links = {(i, int(j)) for i in range(n) if i % 7 for j in rng.choice(n, rng.integers(1, 6))} | {(0, j) for j in range(1, 120)}
    allowed, blocked = rng.integers(0, 4, n), (rng.random(n) < 0.1).astype(int) * 5
    hosts = spark.createDataFrame([(f"h{i}", int(allowed[i]), int(blocked[i])) for i in range(n)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in links], "src string, dst string")
    got = {r["host"]: r for r in url_graph.propagate(hosts, edges, crowded=20).collect()}
    for column, seed, pairs in (("trust", allowed, links), ("distrust", blocked, {(b, a) for a, b in links})):
        move = np.zeros((n, n))
        for a, b in pairs:
            move[b, a] = 1
        for a in range(n):
            if not move[:, a].any():
                move[a, a] = 1  # a host without links keeps its mass
        move /= move.sum(axis=0)
        start = seed / seed.sum()
        want = np.linalg.solve(np.eye(n) - 0.85 * move, 0.15 * start)
        mass = np.array([got[f"h{i}"][column] for i in range(n)]) / url_graph.MASS
        assert abs(mass.sum() - 1) < 1e-6 and np.abs(mass - want).sum() < 1e-5


def test_url_graph_odd_rows(spark):
    rows = [(None, "http://a.com/x", "<a href='/y'>" + "z" * 200_000 + "</a>"), (None, "http://a.com/x", None), (1, None, None), (1, None, None)]
    got = url_graph.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in got) == [("1", "", "allow")] * 2 + [("None", "a.com", "allow")] * 2


def test_url_graph(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a>' for h in hosts)
    rows = [(i, f"http://bad.com/en/{i}", link("farm.org")) for i in range(20)]
    rows += [(100, "http://feeder.org/a", link("bad.com")), (101, "https://Good.Example.NET/de/1?q=1#x", link("friend.org")), (102, "http://friend.org/", "")]
    rows += [(103, None, None), (104, "no scheme", ""), (105, "http://x.example.net/de/85", ""), (106, "http://x.example.com/en/7/z", ""), (107, "http://a.com?x=/en/", ""), (107, "http://a.com?x=/en/", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("mass", F.lit(1))
    got = {r["page_id"]: r for r in url_graph.judge_urls(table).collect()}
    assert got[100]["rule"] is None and got[100]["verdict"] == "block"  # it links to a blocked host
    assert got[102]["verdict"] == "allow" and got[102]["trust"] > 0  # a trusted host links to it
    assert (got[101]["host"], got[101]["path"], got[101]["rule"], got[101]["verdict"]) == ("good.example.net", "/de/1", "net/de/", "allow")
    assert (got[105]["rule"], got[105]["verdict"]) == ("example.net/de/8", "block")
    assert (got[106]["rule"], got[106]["verdict"]) == ("example.com/en/7", "allow")
    assert [(got[i]["host"], got[i]["path"], got[i]["verdict"]) for i in (103, 104)] == [("", "", "allow")] * 2
    assert (got[107]["host"], got[107]["path"], got[107]["rule"]) == ("a.com", "", None)
    assert url_graph.judge_urls(table).count() == len(rows) and url_graph.judge_urls(table.filter("false")).count() == 0


def packed_pieces(rows: list[tuple], capacity: int) -> collections.Counter:
    """(doc_id, piece, start, length, crc) of (doc_id, text) rows, by the library."""
    out = collections.Counter()
    for i, t in rows:
        ids = [*encoded(WORD_VOCABULARY, t), 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            out[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def test_pipeline(spark, tmp_path):
    """Every stage against brute force over what the stage before it kept."""
    import corpus_pipeline

    rows = [(i, syllables(i, 80), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(200 + i, near_copy(rows[i][1], i, 1), "en", "s1", 0) for i in range(20, 30)]
    rows += [rows[3], rows[3], (None, syllables(901, 70), "en", None, 0), (302, syllables(902, 3000), "en", "s2", 0), (300, None, None, None, None), (301, "123 456", "en", "s0", 7)]
    path = f"{tmp_path}/documents.parquet"
    table = spark.createDataFrame(rows, DOCS + ", n_chars long").withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast("long"))
    table = table.withColumn("_row", F.lit(1)).withColumn("sig", F.lit("x"))  # names that stages use inside
    table.write.parquet(path)
    docs = spark.read.parquet(path)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        if name == "mix":  # rows are named by id and text there
            named = docs.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2(F.col("text").cast("binary"), 256)))
            plan = {r["key"]: r for r in mixing.mix_sources(named, "key").collect()}
            sources = {r["source"]: int(r["target"]) for r in mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(kept["language"], key=key) == sorted((r[:4] for r in rows[:-2]), key=key)  # two have no letter
    groups = collections.defaultdict(list)
    for r in kept["language"]:
        groups[r[1]].append(r[0])
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(((r[0], r[1]) for r in kept["exact_copies"]), key=key) == sorted(((i, t) for t, i in last.items()), key=key)
    stay = {(i, t) for (i, t, *_), (_, _, c) in zip(kept["exact_copies"], brute_components(kept["exact_copies"]), strict=True) if i == c}
    assert {(r[0], r[1]) for r in kept["near_copies"]} == stay and len(kept["near_copies"]) == len(stay) < len(kept["exact_copies"])
    want = collections.Counter()
    for i, t, *_ in kept["near_copies"]:
        own = plan[f"{'' if i is None else i}:{hashlib.sha256(t.encode()).hexdigest()}"]
        size, taken = own["size"], own["taken"]
        want[i, t] += taken // size
        if taken % size:
            want[i, re.match(rf"(?:\s*\S+){{{taken % size}}}", t)[0]] += 1
    assert collections.Counter((r[0], r[1]) for r in kept["mix"]) == +want
    words = collections.Counter()
    for _, t, _, source in kept["mix"]:
        words[source] += len(WORDS.findall(t))
    assert {k: words[k] for k in sources} == sources  # each source's words are its target's floor
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == packed_pieces([(r[0], r[1]) for r in kept["mix"]], 2048)
    bins = collections.Counter()
    for r in pieces:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048 and corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], DOCS + ", n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "pack" or out.columns == none.columns)
