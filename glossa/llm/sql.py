"""SQL that restates resampling and the manifest; CRC-32 is computed in SQL, byte by byte, from its definition."""

from __future__ import annotations

from glossa.llm import manifest, resampling

#: A CTE with the remainder of each byte.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY n) AS remainders FROM (
  SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
  FROM (SELECT unnest(range(256)) AS n)))"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``; ``remainders`` must be in scope."""
    hexed = f"hex(encode({text}))"
    return (
        f"xor(4294967295, list_reduce([CAST(('0x' || substr({hexed}, i, 2)) AS BIGINT) FOR i IN range(1, length({hexed}), 2)], "
        f"lambda c, b: xor(c >> 8, remainders[xor(c, b) % 256 + 1]), 4294967295))"
    )


WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

RESAMPLING_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, row_number() OVER () AS row_no, {WORDS} AS ws FROM documents),
dw AS (SELECT row_no, unnest(ws) AS word FROM d),
bw AS (SELECT unnest({WORDS}) AS word FROM benchmark),
hashed AS (SELECT word, {crc32("word")} % {resampling.BUCKETS} AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor({resampling.SCALE} * ln(
      (coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {resampling.BUCKETS})::DOUBLE
      / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {resampling.BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT row_no, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row_no),
scored AS (
  SELECT doc_id, row_no, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-{resampling.SCALE}.0::DOUBLE * ln(-ln((
      CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (row_no)),
placed AS (
  SELECT *, n_features >= {resampling.MIN_WORDS} AS fit,
    row_number() OVER (PARTITION BY n_features >= {resampling.MIN_WORDS} ORDER BY score DESC, doc_id ASC NULLS LAST) AS place
  FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN fit AND place <= (SELECT count(*) FROM placed WHERE fit) * {resampling.PERCENT} // 100 THEN place END AS rank
FROM placed
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_field(text if name == 'text' else name) for name in manifest.FIELDS)}))"


def _tree(name: str, start: str, arity: int) -> str:
    """A CTE, the nodes of all levels of a forest: ``name`` (grp, level, pos, size, digest)."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, pos, size, digest FROM {start}
  UNION ALL
  SELECT grp, level + 1, pos // {arity}, (any_value(size) + {arity - 1}) // {arity}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE size > 1 GROUP BY grp, level, pos // {arity})"""


def _paths(name: str, tree: str, start: str, arity: int) -> str:
    """A CTE, ``name``: the paths climbed from each leaf of ``start``, with the siblings passed and the digest folded so far."""
    return f"""{name} AS (
  SELECT grp, pos AS leaf_pos, 0 AS level, pos, size, '' AS siblings, shown AS folded FROM {start}
  UNION ALL
  SELECT p.grp, leaf_pos, p.level + 1, p.pos // {arity}, (p.size + {arity - 1}) // {arity},
    concat(siblings, before, after), sha256(concat(before, folded, after))
  FROM {name} p JOIN {tree}_sides s ON s.grp = p.grp AND s.level = p.level AND s.pos = p.pos WHERE p.size > 1)"""


def _sides(tree: str, arity: int) -> str:
    before = ", ".join(f"lag(digest, {k}) OVER run" for k in range(arity - 1, 0, -1))
    after = ", ".join(f"lead(digest, {k}) OVER run" for k in range(1, arity))
    return f"""{tree}_sides AS (
  SELECT grp, level, pos, concat({before}) AS before, concat({after}) AS after FROM {tree}
  WINDOW run AS (PARTITION BY grp, level, pos // {arity} ORDER BY pos))"""


A = manifest.ARITY

MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (SELECT doc_id AS hashed_id, {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS even
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc),
leaves AS (
  SELECT d.doc_id, coalesce('=' || source, '-') AS grp, {_leaf("text")} AS digest,
    CASE WHEN even THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS shown
  FROM documents d LEFT JOIN hashed h ON doc_id = hashed_id),
ground AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size
  FROM leaves),
{_tree("forest", "ground", A)},
{_sides("forest", A)},
subroots AS (SELECT grp AS source_grp, digest FROM forest WHERE size = 1),
crown AS (SELECT '' AS grp, source_grp, digest, digest AS shown, row_number() OVER (ORDER BY source_grp) - 1 AS pos, count(*) OVER () AS size
  FROM subroots),
{_tree("top", "crown", A)},
{_sides("top", A)},
{_paths("climbed", "forest", "ground", A)},
folded AS (
  SELECT c.grp, c.leaf_pos, c.siblings AS low, k.pos, k.size, c.folded AS shown, k.digest AS subroot
  FROM climbed c JOIN crown k ON k.source_grp = c.grp WHERE c.size = 1),
upper AS (
  SELECT grp, leaf_pos, subroot, low AS siblings, shown AS folded, 0 AS level, pos, size FROM folded
  UNION ALL
  SELECT u.grp, leaf_pos, subroot, concat(siblings, before, after), sha256(concat(before, folded, after)), u.level + 1, u.pos // {A},
    (u.size + {A - 1}) // {A}
  FROM upper u JOIN top_sides s ON s.level = u.level AND s.pos = u.pos WHERE u.size > 1)
SELECT g.doc_id, g.digest AS leaf, u.subroot, r.digest AS root, sha256(u.siblings) AS proof_sha256, u.folded AS folded_root,
  u.folded = r.digest AS verified
FROM ground g JOIN upper u ON u.grp = g.grp AND u.leaf_pos = g.pos AND u.size = 1, (SELECT digest FROM top WHERE size = 1) r
"""
