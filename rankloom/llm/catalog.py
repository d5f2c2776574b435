"""The operators' queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from public_tokenizers import path as vocabulary_file
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import (
    alignment, bpe, divergence, fingerprints, language, minhash, multi_index, packing, quality, sanitise, secret_scan, suffixes, url_filter,
)
from rankloom.llm.common import table


# The block list of op4: hosts with one of these labels.
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def op1_multi_index(spark: SparkSession, root: str) -> DataFrame:
    """Links and groups among all vectors of a label."""
    return multi_index.near_vectors(table(spark, root, "embeddings"))


def op2_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    docs = table(spark, root, "documents")
    return quality.quality_scores(docs, quality.fit(docs, table(spark, root, "labels")))


def op3_packing(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 ids."""
    return packing.pack(table(spark, root, "documents"), vocabulary_file("word_bpe_49k.json"), with_ids=False)


def op4_url_filter(spark: SparkSession, root: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = table(spark, root, "pages").select("page_id", "url")
    labels = F.array(*[F.lit(label) for label in LISTED_LABELS])
    listed = url_filter.page_hosts(pages).select("host").distinct().filter(F.arrays_overlap(F.split("host", r"\."), labels))
    return url_filter.judge_urls(pages, listed)


def op5_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Secrets of all documents: counts, and places of base and added spans."""
    docs = table(spark, root, "documents")
    return secret_scan.digests(secret_scan.secret_spans(docs, secret_scan.fit(docs)))


def op6_suffixes(spark: SparkSession, root: str) -> DataFrame:
    """What is left of all documents without strings of 200 bytes that occur twice."""
    return suffixes.repeat_report(table(spark, root, "documents")).drop("spans")


def op7_minhash(spark: SparkSession, root: str) -> DataFrame:
    """Groups of near-duplicates among all documents."""
    return minhash.near_duplicates(table(spark, root, "documents"))


def op8_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Digests of all documents' ids and of the texts they decode to."""
    return bpe.bpe_digests(table(spark, root, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.edit_report(table(spark, root, "documents"))


def op10_language(spark: SparkSession, root: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs, pieces = table(spark, root, "documents"), vocabulary_file("piece_bpe_32k.model")
    return language.languages(docs, pieces, *language.fit(docs, pieces))


def op11_sanitise(spark: SparkSession, root: str) -> DataFrame:
    """Personal data of all documents, and the words that give it away."""
    return sanitise.digests(sanitise.private_spans(table(spark, root, "documents")))


def op12_divergence(spark: SparkSession, root: str) -> DataFrame:
    """How each source's words differ from the language's other sources and from the language."""
    return divergence.source_divergence(table(spark, root, "documents"))


def op13_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in all documents."""
    docs = table(spark, root, "documents")
    return alignment.alignment_report(docs, vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"))


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_secrets": op5_secrets,
    "op6_suffixes": op6_suffixes,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
    "op11_sanitise": op11_sanitise,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": f"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule,
    coalesce(b.verdict, CASE WHEN list_has_any(string_split(p.host, '.'), {LISTED_LABELS}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
""",
    "op12_divergence": r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), sets AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT s.lang, s.source, k.term, coalesce(w.n, 0) AS n
    FROM sets s JOIN kept k ON k.lang = s.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) w ON w.lang = s.lang AND w.source = s.source AND w.term = k.term
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM counts JOIN sizes USING (lang)
), common AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) JOIN sizes USING (lang)
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM sets a JOIN sets b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
               FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.source = a.source AND d.other = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares JOIN common USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
WHERE part = 'pair' OR rank <= 50
""",
}
