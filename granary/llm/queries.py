"""The registered queries of the ten components, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.token_counts import token_counts

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    got = token_counts(docs, tokenizer_file("piece_bpe_32k.model")).drop("text")
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "n_whole")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.ngram_join import ngram_join

    return ngram_join(common.documents(spark, sf_dir).select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.secret_scan import BASE, KINDS, listed, scan_secrets

    found = scan_secrets(common.documents(spark, sf_dir))
    own = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(kind: int):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(BASE))]
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.line_dedup import line_dedup

    done = line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"), added=True)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from granary.llm.byte_bpe import bpe_encode

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return bpe_encode(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


#: Domains of the labelled table, and the shares of tokens that they are mixed to.
TARGETS = {"clean": 0.95, "junk": 0.04, "toxic": 0.01}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text and domain of the documents that the labelled table has: toxic, else junk (quality 0) or clean."""
    labels = common.table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    rows = labels.select("doc_id", domain.alias("domain")).dropna()
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return docs.join(common.checked_broadcast(rows), "doc_id").select("text", "domain")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.mixing import mix

    docs = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs, labelled_domains(spark, sf_dir), TARGETS, keep_text=False).select("doc_id", "source", "tokens", "domain", "posterior", "rate")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.exact_dedup import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which each 97th page has one character changed."""
    from granary.llm.warc import fixity_audit, page_records

    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damage = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30)))
    return fixity_audit(page_records(pages), page_records(pages, damage)).withColumnRenamed("id", "page_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.language_id import predict_languages

    # A document without an id isn't held out.
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = common.documents(spark, sf_dir)
    training = docs.where(~held).select("text", "lang")
    return predict_languages(docs.select("doc_id", "text", held.alias("held_out")), training).select("doc_id", "held_out", "lang_pred", "score")


def op10_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.llm.media import media_digests

    return media_digests(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_join, op3_secret_scan, op4_line_dedup, op5_byte_bpe, op6_mixing, op7_exact_dedup, op8_warc_fixity, op9_language_id, op10_lossless_webp)}

#: The rules of the secret scan as DuckDB has them: kind, name, regex, group and least length. Letters in either case are written out.
SECRETS = (
    (0, "assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _secrets_sql() -> str:
    """Matches and the text between them take turns; their lengths add up to where each match stands."""
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, '{name}' AS name, {least} AS least, unnest(regexp_extract_all(text, '{regex}')) AS w, unnest(regexp_extract_all(text, '{regex}', {group})) AS p, "
        f"unnest(string_split_regex(text, '{regex}')[:len(regexp_extract_all(text, '{regex}'))]) AS g, unnest(range(len(regexp_extract_all(text, '{regex}')))) AS i FROM t"
        for k, name, regex, group, least in SECRETS
    )
    return f"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), m AS ({each}),
        s AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM m),
        f AS (SELECT r, kind, name || ':' || (stop - length(w))::BIGINT || ':' || stop::BIGINT AS span, stop - length(w) AS start FROM s WHERE length(p) >= least),
        a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM f GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN a USING (r)"""


ORACLES: dict[str, str] = {
    "op3_secret_scan": _secrets_sql(),
    "op8_warc_fixity": """
        WITH r AS (
          SELECT page_id, page_id // 1000 AS file, html,
                 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                 || 'WARC-Record-ID: <urn:uuid:' || regexp_replace(md5('page ' || page_id), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') || '>' || chr(13) || chr(10)
                 || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                 || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR)
                 || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
          FROM pages),
        s AS (SELECT page_id, file, html, octet_length(encode(record)) AS length, sha256(record) AS sha FROM r)
        SELECT page_id, file, row_number() OVER w - 1 AS seq, CAST(sum(length) OVER w - length AS BIGINT) AS "offset", length, sha,
               page_id % 97 = 5 AND NOT starts_with(html, '#') AS corrupt
        FROM s WINDOW w AS (PARTITION BY file ORDER BY page_id, sha ROWS UNBOUNDED PRECEDING)""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
