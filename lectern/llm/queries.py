"""The registered queries of this package, with production parameters, and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, collocations, media, minhash, neighbours, packing, quality, substrings, topk, toxicity, unigram, urls
from .common import fold, table

#: The rules that op10 applies: host, path prefix, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_table(docs, model).select(
        "doc_id",
        (fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.groups(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.groups(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_table(table(spark, sf_dir, "documents"), window=35)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_table(docs, model).select(
        "doc_id",
        (fold("doc_id", quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_table(media.text_images(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return unigram.count_table(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urls.RULES)
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), threshold=30, longest=4, top=2000)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_embeddings": op2_embeddings,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_token_counts": op9_token_counts,
    "op10_urls": op10_urls,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_topk": op13_topk,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE = {
    "op2_embeddings": """
        WITH RECURSIVE sound AS (
            SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
                AND len(list_filter(embedding, lambda v: v <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach AS (
            SELECT vec_id AS node, vec_id AS least FROM embeddings
            UNION
            SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node
        ), roots AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
    """,
    "op4_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
            FROM words
        ), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS node, doc_id AS least FROM documents
            UNION
            SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.node
        ), roots AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN roots ON node = doc_id
    """
    % (_UPPER, _LOWER),
    "op6_substrings": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, array_to_string(w[i:i + 34], ' ') AS g FROM words
        ), repeated AS (
            SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) >= 2
        ), gone AS (
            SELECT doc_id, list(DISTINCT j) AS js
            FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM repeated) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
                CASE WHEN js IS NULL THEN w
                    ELSE [w[k] FOR k IN list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(js, k))] END AS v
            FROM words LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
            sha256(array_to_string(v, ' ')) AS kept_sha256
        FROM kept
    """,
    "op10_urls": rf"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}), cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parsed AS (
            SELECT page_id, row_number() OVER () AS uid,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), best AS (
            SELECT uid, arg_max(rule_host || rule_path, (length(rule_host) + length(rule_path), length(rule_host))) AS rule,
                arg_max(rule_verdict, (length(rule_host) + length(rule_path), length(rule_host))) AS verdict
            FROM parsed JOIN rules
                ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY uid
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN best USING (uid)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                unnest(regexp_split_to_array(translate(coalesce(text, ''), '%s', '%s'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
            FROM words, range(1, 5) AS sizes(k)
        ), f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING a >= 30
        ), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
        ), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1
        ), cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.cut], ' ')
                JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
        ), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), inside AS (
            SELECT lang, s, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, k - s + 2)]) AS phrase
            FROM candidates, range(2, 4) AS sizes(s) WHERE s < k
        ), longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY lang, phrase)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, lowest.a DESC, phrase) AS rank,
            phrase, lowest.a, l, r, n, score::BIGINT AS score
        FROM lowest JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
        WHERE longer.a IS NULL OR 100::HUGEINT * longer.a < 80::HUGEINT * lowest.a
        QUALIFY rank <= 2000
    """
    % (_UPPER, _LOWER),
    "op13_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
        ), scores AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM scores QUALIFY rank <= 5
    """,
}
