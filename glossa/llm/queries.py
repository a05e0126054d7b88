"""The queries of the training-data operators, and SQL that restates those it can express."""

from __future__ import annotations

from glossa.llm import (
    bpe,
    chat,
    counting,
    exact,
    jaccard,
    licenses,
    manifest,
    packing,
    quality,
    resampling,
    sharding,
    suffix,
    toxicity,
)
from glossa.llm.common import read
from glossa.llm.sql import MANIFEST_SQL, RESAMPLING_SQL

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _rule_values() -> str:
    return ", ".join(
        f"('{rule}', {step}, {cut})" for rule, (_, _, cuts) in quality.RULES.items() for step, cut in enumerate(cuts)
    )


def _rule_ratios() -> str:
    return " ".join(f"WHEN '{rule}' THEN 1000 * {num} > %s * {den}" for rule, (num, den, _) in quality.RULES.items())


SHARE = quality.RISK / len(quality.RULES)

QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    CASE WHEN lang IN {quality.STRATA} THEN lang ELSE '{quality.OTHER}' END AS stratum
  FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
win AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
    lead(word, 4) OVER o) AS g, lead(i, 4) OVER o AS last
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dup AS (SELECT doc_id, i FROM win WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, stratum,
    CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{SPACES}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
  HAVING min(quality) = max(quality)),
grid AS (SELECT * FROM (VALUES {_rule_values()}) v(rule, step, cut)),
tests AS (
  SELECT stratum, rule, step, cut, count(*) FILTER (good) AS n,
    count(*) FILTER (good AND CASE rule {_rule_ratios() % (("cut",) * len(quality.RULES))} END) AS k,
    count(*) FILTER (NOT good AND CASE rule {_rule_ratios() % (("cut",) * len(quality.RULES))} END) AS bad
  FROM b JOIN known USING (doc_id), grid WHERE NOT base_failed GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN k < n * {SHARE} THEN list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1)
      - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({SHARE}) + (n - i) * ln(1 - {SHARE}))))
    ELSE 1.0 END AS p, (SELECT count(DISTINCT stratum) FROM tests) AS strata
  FROM tests),
seq AS (
  SELECT *, bool_and(p * strata * {len(quality.RULES)} <= {quality.LEVEL})
    OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM p),
cutoffs AS (SELECT stratum, rule, arg_max(cut, (bad - k, cut)) AS cut FROM seq WHERE ok AND bad > k GROUP BY ALL),
hits AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rejected_by FROM b JOIN cutoffs USING (stratum)
  WHERE CASE rule {_rule_ratios() % (("cut",) * len(quality.RULES))} END GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN hits USING (doc_id)
"""

NORMAL = f"regexp_replace(coalesce(text, ''), '{SPACES}+', ' ', 'g')"

EXACT_SQL = f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY print ORDER BY doc_id) = 1 AS kept, print AS text_sha256
FROM (SELECT doc_id, sha256({NORMAL}) AS print FROM documents)
WINDOW g AS (PARTITION BY print)
"""

PREFERENCE_SQL = f"""
WITH answers AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
chosen AS (SELECT conv_id AS pair_id, turn, role, text, 'chosen' AS side FROM conversations),
final AS (
  SELECT xor(c.conv_id, 1) AS conv_id, role, text FROM conversations c JOIN answers a USING (conv_id)
  WHERE role = 'assistant' AND turn = last),
rejected AS (
  SELECT conv_id AS pair_id, turn, role, text, 'rejected' AS side FROM conversations LEFT JOIN answers USING (conv_id)
  WHERE last IS NULL OR NOT (role = 'assistant' AND turn = last)
  UNION ALL SELECT conv_id, last, role, text, 'rejected' FROM final JOIN answers USING (conv_id)),
turns AS (
  SELECT pair_id, coalesce(turn, {chat.LAST}) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, side
  FROM (SELECT * FROM chosen UNION ALL SELECT * FROM rejected)),
split AS (
  SELECT pair_id, min(turn) AS split FROM (
    SELECT pair_id, turn, role, text FROM turns GROUP BY ALL
    HAVING count(*) FILTER (side = 'chosen') <> count(*) FILTER (side = 'rejected'))
  GROUP BY pair_id),
parts AS (
  SELECT pair_id, turn, role, text, side,
    CASE WHEN split IS NULL OR turn < split THEN 'prompt' ELSE side END AS part
  FROM turns LEFT JOIN split USING (pair_id))
SELECT pair_id, part, turn, role, count(*) AS copies,
  concat('{chat.HEAD}', role, '|>', chr(10), text, '<|end|>', chr(10)) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS BIGINT) AS trained_from,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(text) + {len(chat.END)} ELSE 0 END AS BIGINT)
    AS trained_chars
FROM parts WHERE part <> 'prompt' OR side = 'chosen'
GROUP BY pair_id, part, turn, role, text
"""


def op1_quality_rules(spark, sf_dir):
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return exact.mark_copies(read(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pieces(packing.pack(read(spark, sf_dir, "documents"), with_ids=False)).drop("input_ids")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix.removal_digests(read(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_bpe(spark, sf_dir):
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_rows(read(spark, sf_dir, "documents"))


def op10_preference(spark, sf_dir):
    return chat.preference_rows(*chat.pairs(read(spark, sf_dir, "conversations")))


def op11_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_manifest(spark, sf_dir):
    return manifest.audit(read(spark, sf_dir, "documents"))


def op13_token_counts(spark, sf_dir):
    return counting.token_counts(read(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_quality_rules,
        op2_exact_dedup,
        op3_packing,
        op4_license_scan,
        op5_jaccard_join,
        op6_suffix_dedup,
        op7_toxicity,
        op8_bpe,
        op9_sharding,
        op10_preference,
        op11_resampling,
        op12_manifest,
        op13_token_counts,
    )
}
ORACLES = {
    "op1_quality_rules": QUALITY_SQL,
    "op2_exact_dedup": EXACT_SQL,
    "op10_preference": PREFERENCE_SQL,
    "op11_resampling": RESAMPLING_SQL,
    "op12_manifest": MANIFEST_SQL,
}
