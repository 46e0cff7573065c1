"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from gridloom.llm import url_graph
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.langid import identify
from gridloom.llm.materialise import document_places, materialise, new_dir
from gridloom.llm.mixing import mix_sources
from gridloom.llm.ngram_join import ngram_join
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import find_pii
from gridloom.llm.token_count import count_tokens
from gridloom.llm.topk import top_k
from gridloom.llm.url_graph import judge_urls


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return document_places(materialise(docs, public_tokenizers.path("word_bpe_49k.json"), new_dir(spark)))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def url_graph_sql(rounds: int = 8, threshold: float = 1.0) -> str:
    """The same rules, host graph and integer masses in SQL, one CTE for each round.

    The test pages link within their hosts, so their masses stand from the first round on.
    """
    steps = ",\n".join(
        f"""
        r{i} AS (
            SELECT kind, node, sum(seed)::BIGINT AS seed, ((15 * sum(seed) + 85 * sum(sent)) // 100)::BIGINT AS mass
            FROM (SELECT kind, node, seed, 0::BIGINT AS sent FROM seeds
                  UNION ALL
                  SELECT e.kind, e.b, 0, s.mass // e.degree FROM r{i - 1} s JOIN steps e ON s.kind = e.kind AND s.node = e.a
                  UNION ALL
                  SELECT kind, node, 0, mass FROM r{i - 1} s WHERE NOT EXISTS (FROM steps e WHERE s.kind = e.kind AND s.node = e.a))
            GROUP BY kind, node)"""
        for i in range(1, rounds + 1)
    )
    return rf"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        n AS (
            SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
        u AS (
            SELECT *, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' END AS rule FROM n),
        v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM u),
        h AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
              FROM v WHERE host <> '' GROUP BY host),
        seeds AS (
            SELECT 't' AS kind, host AS node, (({url_graph.MASS} // (SELECT greatest(1, sum(allowed)) FROM h)) * allowed)::BIGINT AS seed FROM h
            UNION ALL
            SELECT 'd', host, (({url_graph.MASS} // (SELECT greatest(1, sum(blocked)) FROM h)) * blocked)::BIGINT FROM h),
        raw AS (
            SELECT host AS src, translate(unnest(regexp_extract_all(html, $re${url_graph.LINK}$re$, 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
            FROM v WHERE host <> ''
            UNION ALL
            SELECT host, host FROM v WHERE host <> '' AND regexp_matches(html, $re$(?i)\bhref\s*=\s*["']?\s*(?:/[^/]|[^"'\s<>:/]+["'\s>/])$re$)),
        edges AS (SELECT DISTINCT src, dst FROM raw WHERE dst IN (SELECT host FROM h)),
        both_ways AS (SELECT 't' AS kind, src AS a, dst AS b FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
        steps AS (SELECT *, count(*) OVER (PARTITION BY kind, a) AS degree FROM both_ways),
        r0 AS (SELECT kind, node, seed, seed AS mass FROM seeds),
        {steps},
        m AS (SELECT node, sum(mass) FILTER (kind = 't') AS trust, sum(mass) FILTER (kind = 'd') AS distrust FROM r{rounds} GROUP BY node),
        sc AS (
            SELECT host, trust::DOUBLE / {float(url_graph.MASS)}::DOUBLE * (SELECT sum(pages) FROM h)::DOUBLE / pages AS trust,
                   distrust::DOUBLE / {float(url_graph.MASS)}::DOUBLE * (SELECT sum(pages) FROM h)::DOUBLE / pages AS distrust
            FROM h JOIN m ON h.host = m.node)
        SELECT page_id, v.host, path, rule,
               coalesce(ruled, CASE WHEN distrust - trust > {threshold} THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
        FROM v LEFT JOIN sc ON v.host = sc.host
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_training_order": op3_training_order,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_language_id": op5_language_id,
    "op6_ngram_join": op6_ngram_join,
    "op7_source_mix": op7_source_mix,
    "op8_url_graph": op8_url_graph,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op7_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('mix:' || doc_id::VARCHAR) AS key
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
        r AS (
            SELECT *, row_number() OVER o AS pos,
                   (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
            FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
        f AS (SELECT level FROM r WHERE NOT level * weight > 2.0::DOUBLE * source_size ORDER BY pos LIMIT 1),
        t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM f) * weight) AS target FROM r),
        b AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE
                    ((budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead))) END::BIGINT AS taken
        FROM b
    """,
    "op8_url_graph": url_graph_sql(),
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
               count(*) OVER (PARTITION BY text) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
               sha256(text) AS text_sha256
        FROM d
    """,
}
