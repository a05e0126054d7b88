"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import text as T
from glossa.plans import bindings
from glossa.sources import corpus
from glossa.sources.corpus import pages_to_requests, read_corpus
from registry.common import SP, SP_LITERAL, sql_count, sql_trim, sql_utf16, table

QUERIES = {}
ORACLES = {}

TEXT_CAP = 20_000


def sql_norm(expr):
    out = f"replace({expr}, chr(160), ' ')"
    out = f"regexp_replace({out}, '[ \\t]+\\n', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_trim(out)


KANA = r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}"
CYR = r"\x{0400}-\x{052F}"
LAT = r"\p{Latin}"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"


def sql_profile(expr):
    known = KANA + CYR + LAT + HAN
    other = sql_count(f"regexp_replace({expr}, '[{known}]', '', 'g')", r"\p{L}")
    return (
        f"{sql_count(expr, KANA)} AS kana, {sql_count(expr, CYR)} AS cyrillic, "
        f"{sql_count(expr, LAT)} AS latin, {sql_count(expr, HAN)} AS han, {other} AS other_letters"
    )


SQL_DETECT = """CASE
  WHEN kana > 0 AND (kana >= 2 OR han <= 8)
   AND (kana + han)::DOUBLE / greatest(kana + cyrillic + latin + han + other_letters, 1) >= 0.6 THEN 'ja'
  WHEN cyrillic > 0 AND cyrillic >= latin * 0.35 AND cyrillic >= han + other_letters THEN 'ru'
  WHEN latin > 0 AND kana = 0 AND cyrillic = 0 AND han = 0 AND other_letters = 0 THEN 'en'
  ELSE '' END"""


def sql_validate(expr, cap=TEXT_CAP):
    t = sql_trim(expr)
    return (
        f"CASE WHEN {t} IS NULL OR {t} = '' THEN 'INVALID_TEXT' "
        f"WHEN {sql_utf16(t)} > {cap} THEN 'TEXT_TOO_LONG' END"
    )


# --- sources ---------------------------------------------------------------

QUERIES["read_corpus"] = lambda spark, d: read_corpus(spark, f"{d}/documents.parquet").select(
    "doc_id", "lang", "source", "n_chars", "utf8_bytes"
)
ORACLES["read_corpus"] = (
    "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, "
    "CAST(strlen(text) AS BIGINT) AS utf8_bytes FROM documents"
)

QUERIES["pages_to_requests"] = lambda spark, d: pages_to_requests(table(spark, d, "pages"))


def _sql_visible():
    out = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in corpus.HIDDEN:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    editing = corpus.EDITING.replace("'", "''").replace('\\"', '"')
    for tag in corpus.EDITABLE:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*{editing}.*?</{tag}>', '', 'g')"
    out = f"regexp_replace({out}, '{corpus.BLOCK_END}', chr(10), 'g')"
    return f"regexp_replace({out}, '(?s)<[^>]*>', '', 'g')"


def _sql_entities(text):
    """Entities one after another; the ampersand last."""
    names = ", ".join(f"'{k}': chr({ord(v)})" for k, v in corpus.named_entities().items())
    code = "CASE WHEN lower(left(e, 2)) = '#x' THEN CAST('0x' || substr(e, 3) AS BIGINT) WHEN left(e, 1) = '#' THEN CAST(substr(e, 2) AS BIGINT) END"
    valid = f"({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 AND ({code}) <> 38"
    char = f"CASE WHEN left(e, 1) <> '#' THEN MAP {{{names}}}[e] WHEN ({code}) = 160 THEN ' ' WHEN {valid} THEN chr(CAST({code} AS INTEGER)) END"
    out = f"list_reduce(list_prepend({text}, list_distinct(regexp_extract_all({text}, '{corpus.ENTITY}', 1))), lambda t, e: coalesce(replace(t, '&' || e || ';', {char}), t))"
    return f"regexp_replace({out}, '{corpus.AMPERSAND}', '&', 'g')"


ORACLES["pages_to_requests"] = (
    f"SELECT page_id, url, t AS text FROM (SELECT page_id, url, {sql_norm(_sql_entities('v'))} AS t "
    f"FROM (SELECT page_id, url, {_sql_visible()} AS v FROM pages)) WHERE t <> ''"
)

# --- preparation -----------------------------------------------------------

QUERIES["normalize_text"] = lambda spark, d: T.normalize_text(table(spark, d, "documents")).select(
    "doc_id", "norm_text", "changed"
)
ORACLES["normalize_text"] = (
    f"SELECT doc_id, n AS norm_text, n IS DISTINCT FROM text AS changed "
    f"FROM (SELECT doc_id, text, {sql_norm('text')} AS n FROM documents)"
)

QUERIES["script_profile"] = lambda spark, d: T.script_profile(table(spark, d, "documents")).select(
    "doc_id", "kana", "cyrillic", "latin", "han", "other_letters"
)
ORACLES["script_profile"] = f"SELECT doc_id, {sql_profile('text')} FROM documents"

QUERIES["detect_language"] = lambda spark, d: T.detect_language(
    T.script_profile(table(spark, d, "documents"))
).select("doc_id", "detected")
ORACLES["detect_language"] = (
    f"SELECT doc_id, {SQL_DETECT} AS detected FROM (SELECT doc_id, {sql_profile('text')} FROM documents)"
)

QUERIES["language_audit"] = lambda spark, d: T.language_audit(
    T.detect_language(T.script_profile(table(spark, d, "documents")))
)
ORACLES["language_audit"] = f"""
WITH p AS (SELECT lang, source, {sql_profile('text')} FROM documents),
     x AS (SELECT lang, source, {SQL_DETECT} AS detected FROM p),
     l AS (SELECT 'lang' AS level, lang AS name, detected FROM x
           UNION ALL SELECT 'source', source, detected FROM x
           UNION ALL SELECT 'all', 'all', detected FROM x)
SELECT level, name, count(*) AS n_docs,
       count(*) FILTER (detected = 'en') AS n_en, count(*) FILTER (detected = 'ja') AS n_ja,
       count(*) FILTER (detected = 'ru') AS n_ru, count(*) FILTER (detected = '') AS n_unroutable,
       count(*) FILTER (detected = '') / count(*) AS unroutable_share
FROM l GROUP BY level, name"""

_SQL_CONTENT = f"""CASE WHEN {sql_utf16('t')} <= 80
  AND NOT regexp_matches(t, '[.!?\\x{{3002}}\\x{{FF01}}\\x{{FF1F}}\\n]')
  AND len(list_filter(regexp_split_to_array(t, '{SP}+'), lambda w: w <> '')) <= 3
  THEN 'word' ELSE 'paragraph' END"""

QUERIES["classify_content"] = lambda spark, d: T.classify_content(
    table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text").unionByName(
        table(spark, d, "part").select(
            F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text")
        )
    )
).select("kind", "id", "content_type")
ORACLES["classify_content"] = f"""
SELECT kind, id, {_SQL_CONTENT} AS content_type FROM (
  SELECT 'document' AS kind, doc_id AS id, text AS t FROM documents
  UNION ALL SELECT 'part', p_partkey, p_name FROM part)"""

QUERIES["validate_requests"] = lambda spark, d: T.validate_requests(
    table(spark, d, "documents"), TEXT_CAP
).select("doc_id", "error_code")
ORACLES["validate_requests"] = f"SELECT doc_id, {sql_validate('text')} AS error_code FROM documents"

QUERIES["count_valid_chars"] = lambda spark, d: T.count_valid_chars(table(spark, d, "documents")).select(
    "doc_id", "valid_chars"
)
ORACLES["count_valid_chars"] = (
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) AS BIGINT) AS valid_chars FROM documents"
)

# --- batch and job validation ----------------------------------------------

BLOCK_CAP, CHAR_CAP, BYTE_CAP = 6, 2_000, 1_800

QUERIES["validate_batches"] = lambda spark, d: T.validate_batches(
    bindings.conversation_blocks(table(spark, d, "conversations")), BLOCK_CAP, CHAR_CAP, BYTE_CAP
)
ORACLES["validate_batches"] = f"""
WITH b AS (
  SELECT conv_id AS batch_id, turn AS block_ix, text,
    CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN '-bad' WHEN conv_id % 13 = 0 AND turn = 2 THEN 't0'
         ELSE 't' || turn END AS block_id FROM conversations),
c AS (SELECT batch_id, block_ix, block_id, length(text) AS ch, strlen(text) AS nb, text,
    count(*) OVER (PARTITION BY batch_id) AS n,
    row_number() OVER (PARTITION BY batch_id, block_id ORDER BY block_ix) AS nth,
    sum(length(text)) OVER w AS rc, sum(strlen(text)) OVER w AS rb
  FROM b WINDOW w AS (PARTITION BY batch_id ORDER BY block_ix)),
k AS (SELECT *, CASE WHEN NOT regexp_matches(block_id, '^[A-Za-z0-9][A-Za-z0-9._:-]*$') THEN 'BLOCK_ID_INVALID'
    WHEN nth > 1 THEN 'DUPLICATE_BLOCK_ID' WHEN {sql_trim('text')} = '' THEN 'BLOCK_TEXT_INVALID'
    WHEN rc > {CHAR_CAP} THEN 'BATCH_TEXT_TOO_LONG' WHEN rb > {BYTE_CAP} THEN 'BATCH_UTF8_TOO_LARGE' END AS code FROM c)
SELECT batch_id, count(*) AS n_blocks,
  CAST(sum(ch) AS BIGINT) AS n_chars, CAST(sum(nb) AS BIGINT) AS n_bytes,
  CASE WHEN count(*) > {BLOCK_CAP} THEN 'BLOCKS_INVALID' ELSE arg_min(code, block_ix) FILTER (code IS NOT NULL) END
    AS error_code
FROM k GROUP BY batch_id"""

QUERIES["validate_jobs"] = lambda spark, d: T.validate_jobs(
    bindings.document_jobs(table(spark, d, "documents"))
).select("seq", "job_id", "fingerprint", "page_count", "error_code")
ORACLES["validate_jobs"] = """
WITH j AS (SELECT doc_id AS seq,
    CASE WHEN doc_id % 17 = 0 THEN '_job' ELSE 'job:' || sha256(text) END AS job_id,
    CASE WHEN doc_id % 19 = 0 THEN 'short' ELSE upper(sha256(text)) END AS fingerprint,
    CAST(floor(length(text) / 40) AS BIGINT) AS page_count FROM documents),
c AS (SELECT *, CASE WHEN NOT regexp_matches(job_id, '^[A-Za-z0-9][A-Za-z0-9._:-]*$') THEN 'JOB_ID_INVALID'
    WHEN NOT regexp_matches(fingerprint, '^[0-9A-Fa-f]{64}$') THEN 'FINGERPRINT_INVALID'
    WHEN NOT page_count BETWEEN 1 AND 500 THEN 'PAGE_COUNT_INVALID' END AS code FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, code IS NULL ORDER BY seq) AS nth FROM c)
SELECT seq, job_id, lower(fingerprint) AS fingerprint, page_count,
  CASE WHEN code IS NOT NULL THEN code WHEN nth > 1 THEN 'JOB_ALREADY_EXISTS' END AS error_code FROM n"""

QUERIES["rejection_summary"] = lambda spark, d: T.rejection_summary(
    T.validate_requests(table(spark, d, "documents"), 2_000)
)
ORACLES["rejection_summary"] = f"""
WITH v AS (SELECT source, lang, {sql_validate('text', 2000)} AS error_code FROM documents)
SELECT CASE WHEN grouping(error_code) = 1 THEN '*' ELSE error_code END AS error_code,
       CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source,
       CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS n_rows
FROM v WHERE error_code IS NOT NULL GROUP BY CUBE (error_code, source, lang)"""

QUERIES["fingerprint_dedup"] = lambda spark, d: T.fingerprint_dedup(table(spark, d, "documents")).select(
    "doc_id", "fingerprint", "representative", "group_size", "is_representative"
)
ORACLES["fingerprint_dedup"] = """
SELECT doc_id, sha256(text) AS fingerprint, min(doc_id) OVER w AS representative,
       count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS is_representative
FROM documents WINDOW w AS (PARTITION BY sha256(text))"""

QUERIES["suppress_repeats"] = lambda spark, d: T.suppress_repeats(
    table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.lit("en").alias("lang"), F.col("event_type").alias("text")
    )
)
ORACLES["suppress_repeats"] = """
SELECT event_id, user_id, ts, 'en' AS lang, event_type AS text FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE p IS DISTINCT FROM event_type"""

# --- chunking and unwrapping -----------------------------------------------

CHUNK = 1_000
LO = 550
PUNCT = r"[.!?;:\x{3002}\x{FF01}\x{FF1F}\x{FF1B}]"

QUERIES["chunk_text"] = lambda spark, d: T.chunk_text(
    table(spark, d, "documents").select("doc_id", "text"), CHUNK
)
ORACLES["chunk_text"] = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, 0 AS step, CAST(NULL AS VARCHAR) AS piece, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, step + 1, {sql_trim('substr(rest, 1, cut)')}, ltrim(substr(rest, cut + 1), {SP_LITERAL})
  FROM (SELECT doc_id, step, rest,
    CASE WHEN length(rest) <= {CHUNK} THEN {CHUNK} ELSE coalesce(list_max(list_filter(range({LO}, {CHUNK + 1}), lambda i:
      regexp_full_match(substr(rest, i, 1), '{SP}')
      OR (regexp_full_match(substr(rest, i, 1), '{PUNCT}') AND regexp_full_match(substr(rest, i + 1, 1), '{SP}')))), {CHUNK})
    END AS cut FROM r WHERE rest <> '')),
p AS (SELECT doc_id, step, piece FROM r WHERE piece <> '')
SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS continuation_count,
  row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS continuation_ix,
  piece AS chunk, CAST(length(piece) AS BIGINT) AS n_chars FROM p"""

QUERIES["unwrap_lines"] = lambda spark, d: T.unwrap_lines(
    bindings.hard_wrapped(table(spark, d, "documents"))
).select("doc_id", "unwrapped")
_UNSP = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
_CLOSE = T.CLOSING
_OPEN = T.OPENING
ORACLES["unwrap_lines"] = f"""
WITH w AS (SELECT doc_id, regexp_replace(text, '([\\p{{L}}]{{5}})([\\p{{L}}]{{3}})', '\\1-' || chr(10) || '\\2', 'g') AS t
           FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '')
      AS xs FROM w)
SELECT doc_id, CASE WHEN len(xs) = 0 THEN '' ELSE list_reduce(xs, lambda a, x: CASE
    WHEN regexp_matches(right(a, 2), '\\p{{L}}-$') AND regexp_matches(left(x, 1), '^\\p{{Ll}}')
      THEN left(a, length(a) - 1) || x
    WHEN regexp_matches(right(a, 1), '{_UNSP}') AND regexp_matches(left(x, 1), '{_UNSP}') THEN a || x
    WHEN regexp_matches(left(x, 1), '{_CLOSE}') OR regexp_matches(right(a, 1), '{_OPEN}') THEN a || x
    ELSE a || ' ' || x END) END AS unwrapped FROM l"""

# --- the first slice --------------------------------------------------------

QUERIES["routable_share"] = lambda spark, d: T.routable_share(table(spark, d, "documents"), TEXT_CAP)
ORACLES["routable_share"] = f"""
WITH n AS (SELECT lang, source, {sql_norm('text')} AS t FROM documents),
p AS (SELECT lang, source, t, {sql_profile('t')} FROM n),
x AS (SELECT lang, source, t, {SQL_DETECT} AS detected, {sql_validate('t')} AS code FROM p)
SELECT lang, source, count(*) AS n_docs,
  count(*) FILTER (code IS NULL AND detected <> '') AS n_routable,
  count(*) FILTER (code = 'INVALID_TEXT') AS n_invalid,
  count(*) FILTER (code = 'TEXT_TOO_LONG') AS n_too_long,
  count(*) FILTER (code IS NULL AND detected = '') AS n_unknown_language,
  CAST(coalesce(sum(length(t)) FILTER (code IS NULL AND detected <> ''), 0) AS BIGINT) AS routable_chars,
  count(*) FILTER (code IS NULL AND detected <> '') / count(*) AS routable_share
FROM x GROUP BY lang, source"""
