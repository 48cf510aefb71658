"""The subpackage's entries for ``queries()`` and ``oracle_sql()``: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpack.llm import bpe, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, oracle, secrets, simhash, token_counts, url_filter
from vecpack.llm.common import small_batches, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


#: The rules that the contract of op5 fixes.
URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"), pre_token_pattern())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("tag", "group")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).drop("url")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return secrets.find_secrets(docs, tokenizer("byte_bpe_50k.tiktoken"), pre_token_pattern())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), pre_token_pattern())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (page_id null) and pages (doc_id null), by a text model of a bounded sample of the documents."""
    small_batches(spark)
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.fit(docs)
    result = ["lid_lang AS lang", "round(lid_score, 6) AS score", "lid_kept AS kept"]
    of_docs = language_id.identify_documents(docs.select("doc_id", "text", "source"), model).selectExpr("doc_id", "CAST(NULL AS BIGINT) AS page_id", *result)
    of_pages = language_id.identify_pages(pages.select("page_id", "html", "url"), model).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "page_id", *result)
    return of_docs.unionAll(of_pages)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_extract": op7_html_extract,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
        reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
        components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept
        FROM components c LEFT JOIN counts n ON c.id = n.a
    """,
    "op4_simhash": oracle.simhash_groups(),
    "op5_url_filter": """
        WITH split AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules AS (SELECT * FROM (VALUES
            ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, rule_verdict)),
        urls AS (SELECT DISTINCT host, path FROM split),
        fits AS (
            SELECT host, path, rule_host || rule_path AS rule, rule_verdict,
                   row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
            FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
        FROM split s LEFT JOIN fits f ON s.host = f.host AND s.path = f.path AND f.n = 1
    """,
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
        counted AS (
            SELECT doc_id, pos, md5(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '))) AS h,
                   len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
            FROM lines),
        placed AS (
            SELECT doc_id, pos, h, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS s, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e
            FROM counted WHERE n > 0),
        spans AS (
            SELECT doc_id, pos,
                   list(h) OVER ahead AS ahead_lines, sum(n) OVER ahead AS ahead_words, max(pos) OVER ahead AS b,
                   list(h) OVER back AS back_lines, sum(n) OVER back AS back_words, min(pos) OVER back AS a
            FROM placed
            WINDOW ahead AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                   back AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
        runs AS (
            SELECT doc_id, ahead_lines AS gram, pos AS a, b FROM spans WHERE ahead_words >= 50
            UNION SELECT doc_id, back_lines, a, pos FROM spans WHERE back_words >= 50),
        later AS (
            SELECT doc_id, a, b FROM (
                SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id, a) AS i FROM runs) WHERE i > 1),
        removed AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b),
        marked AS (SELECT l.*, r.pos IS NOT NULL AS gone FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.pos = r.pos)
        SELECT d.doc_id,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '') END AS text,
               count(m.pos) AS n_lines, count(*) FILTER (WHERE m.gone) AS n_removed
        FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id
        GROUP BY d.doc_id, d.text
    """,
    "op6_decontaminate": """
        WITH lower AS (
            SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        docs AS (SELECT id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lower),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        grams AS (
            SELECT id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
        found AS (SELECT g.id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.phrase = x.phrase AND g.size = x.size),
        hit AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + size)) FROM found) GROUP BY id),
        named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY id)
        SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
               sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.w), false) AS contaminated
        FROM docs d LEFT JOIN hit h ON d.id = h.id LEFT JOIN named n ON d.id = n.id
    """,
}
