"""Layout queries over the runs derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import text as T
from glossa.operators.layout import blocks as B
from glossa.operators.layout import geometry as G
from glossa.operators.layout import lines as N
from glossa.operators.layout import rows as R
from glossa.operators.layout import units as U
from glossa.plans import layout as P
from glossa.sources import items as I
from registry.common import SP_LITERAL, sql_count, table

QUERIES = {}
ORACLES = {}


def _inputs(spark, d):
    docs = table(spark, d, "documents")
    items = I.items_from_documents(docs)
    return items, I.views_from_items(items), I.styles_from_documents(docs)


def _prepared(spark, d):
    return P.prepared_items(*_inputs(spark, d))


def _rows(spark, d):
    return R.row_bands(_prepared(spark, d))


def _segments(spark, d):
    return P.segmented_items(_prepared(spark, d))


def _first(spark, d):
    return P.first_units(_prepared(spark, d))


def _ordered(spark, d):
    return U.ordered(U.refined(_first(spark, d)))


def _final(spark, d):
    return U.with_paragraphs(U.with_captions(_ordered(spark, d)))


# --- SQL restatement, valid for the derived runs (one font size, no rotation) ------

_NOSPACE = (
    f"(regexp_matches(left({{r}}, 1), '{T.CLOSING}') OR regexp_matches(right({{l}}, 1), '{T.OPENING}') OR "
    "(regexp_matches(right({l}, 1), '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]') AND "
    "regexp_matches(left({r}, 1), '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]')))"
)


def _nospace(left, right):
    return _NOSPACE.replace("{l}", left).replace("{r}", right)


IT = f"""pc AS (SELECT doc_id, doc_id % 2 = 1 AS odd, flatten(list_transform(string_split(text, chr(10)), lambda l:
    CASE WHEN doc_id % 2 = 1 THEN regexp_extract_all(l, '.{{1,44}}') ELSE regexp_extract_all(l, '.{{1,90}}') END)) AS ps
  FROM documents),
k AS (SELECT doc_id, odd, unnest(ps) AS str, generate_subscripts(ps, 1) - 1 AS item_ix FROM pc),
it AS (SELECT doc_id, odd, str, CAST(item_ix AS INTEGER) AS item_ix,
    CAST(item_ix // (CASE WHEN odd THEN 96 ELSE 48 END) + 1 AS INTEGER) AS page_no,
    CASE WHEN odd AND item_ix % 96 >= 48 THEN 324.0::DOUBLE ELSE 60.0::DOUBLE END AS x,
    60.0::DOUBLE + ((item_ix % (CASE WHEN odd THEN 96 ELSE 48 END)) % 48) * 14 AS y,
    (length(str) * 5)::DOUBLE AS w FROM k),
g AS (SELECT doc_id, page_no, item_ix, trim(regexp_replace(str, '[\\t\\r\\n\\f\\x0B ]+', ' ', 'g'), {SP_LITERAL}) AS text,
    x, y, w, 10.0::DOUBLE AS h, doc_id % 7 = 0 AS is_bold, doc_id % 11 = 0 AS is_italic FROM it
  WHERE trim(regexp_replace(str, '[\\t\\r\\n\\f\\x0B ]+', ' ', 'g'), {SP_LITERAL}) <> '')"""
RB = """rb AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY y) - 1 AS INTEGER) AS row_ix FROM g),
nb AS (SELECT *, lag(x + w) OVER rw AS pr, lag(x + w / 2) OVER rw AS pc, x - lag(x + w) OVER rw AS gap,
    regexp_matches(text, '(?i)^(?:\\(?[0-9]+(?:[a-z]|\\.[0-9]+)?\\)?|\\[[0-9]+(?:[a-z]|\\.[0-9]+)?\\])$') AND w <= 612 * 0.08
    AS eq FROM rb WINDOW rw AS (PARTITION BY doc_id, page_no, row_ix ORDER BY x, item_ix))"""
GU = """gp AS (SELECT doc_id, page_no, row_ix, pr AS s, x AS e,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY row_ix, x) - 1 AS i,
    count(*) OVER (PARTITION BY doc_id, page_no) AS n FROM nb
  WHERE NOT eq AND gap >= greatest(612 * 0.008, 10.5) AND pr < 612 * 0.75 AND x > 612 * 0.25),
nr AS (SELECT doc_id, page_no, max(row_ix) + 1 AS n_rows FROM rb GROUP BY ALL),
cd AS (SELECT doc_id, page_no, 3 * i AS rk, (s + e) / 2 AS x FROM gp WHERE n >= 2
  UNION ALL SELECT doc_id, page_no, 3 * i + 1, s + (e - s) * 0.3::DOUBLE FROM gp WHERE n >= 2
  UNION ALL SELECT doc_id, page_no, 3 * i + 2, s + (e - s) * 0.7::DOUBLE FROM gp WHERE n >= 2),
sc AS (SELECT cd.doc_id, cd.page_no, rk, cd.x, count(DISTINCT row_ix) AS score FROM cd JOIN gp
    ON gp.doc_id = cd.doc_id AND gp.page_no = cd.page_no AND gp.s < cd.x AND gp.e > cd.x
  WHERE cd.x >= 612 * 0.25 AND cd.x <= 612 * 0.75 GROUP BY ALL),
gu AS (SELECT doc_id, page_no, floor(x * 1000 + 0.5) / 1000 AS lane, score FROM sc JOIN nr USING (doc_id, page_no)
  WHERE score >= CASE WHEN n_rows >= 6 THEN greatest(3, ceil(n_rows * 0.06::DOUBLE)) ELSE 2 END
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, abs(x - 306), rk) = 1)"""
_EQ_CUT = "(gap > 50 OR (lane IS NOT NULL AND pr < lane AND x > lane AND gap > 10.5))"


def _lines_sql(p, items, extra_cut="false"):
    """Segments, lines, types and column layout of one pass (CTE names get prefix p)."""
    cut = f"CASE WHEN pr IS NOT NULL AND ({_EQ_CUT} OR {extra_cut}) THEN 1 ELSE 0 END"
    return f"""{p}sg AS (SELECT *, CAST(sum({cut}) OVER (PARTITION BY doc_id, page_no, row_ix ORDER BY x, item_ix) AS INTEGER)
    AS seg_ix FROM {items}),
{p}ln AS (SELECT doc_id, page_no, row_ix, seg_ix, CASE WHEN count(*) = 1 THEN min(text)
      ELSE arg_min(text, x) || CASE WHEN {_nospace('arg_min(text, x)', 'arg_max(text, x)')} THEN '' ELSE ' ' END
        || arg_max(text, x) END AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, 10.0::DOUBLE AS h,
    bool_and(is_bold) AS is_bold, bool_and(is_italic) AS is_italic, CAST(count(*) AS INTEGER) AS n_items,
    CAST(max(max(seg_ix)) OVER (PARTITION BY doc_id, page_no, row_ix) + 1 AS INTEGER) AS row_segments,
    max(x - pr) FILTER (pr IS NOT NULL) AS inner_gap, min(pc) FILTER (pr IS NOT NULL) AS inner_pc,
    max(x + w / 2) AS last_c, CAST(sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) AS BIGINT) AS valid
  FROM {p}sg GROUP BY doc_id, page_no, row_ix, seg_ix),
{p}ty AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, x, seg_ix) AS INTEGER) AS line_ix,
    CASE WHEN regexp_matches(text, '(?i)^\\s*(?:fig(?:ure)?|table)\\s*[.0-9IVXLC:-]+') THEN 'caption'
      WHEN length(text) <= 240 AND regexp_matches(text, '(?i)^\\s*(?:abstract|keywords?|references|bibliography|acknowledg(?:e)?ments?|appendix|[0-9]+(?:\\.[0-9]+)*\\s+[\\p{{L}}\\p{{N}}])') THEN 'heading'
      WHEN length(text) <= 240 AND regexp_matches(text, '(?i)^(?:\\S+@\\S+|(?:https?://|doi\\s*:|arxiv\\s*:).+)$') THEN 'metadata'
      WHEN regexp_matches(text, '(?i)^\\s*(?:[-*\\x{{2022}}\\x{{2023}}\\x{{25E6}}\\x{{2043}}\\x{{2219}}]|(?:[0-9]+|[A-Za-z]|[ivxlcdm]+)[.)])\\s+') THEN 'list'
      WHEN is_italic AND length(text) >= 20 THEN 'quote' ELSE 'paragraph' END AS type FROM {p}ln),
{p}ca AS (SELECT *, row_number() OVER cx AS nth, x - lag(x) OVER cx AS jump, count(*) OVER (PARTITION BY doc_id, page_no) AS n
  FROM {p}ty WHERE type NOT IN ('heading', 'metadata') AND w <= 612 * 0.62
  WINDOW cx AS (PARTITION BY doc_id, page_no ORDER BY x, line_ix)),
{p}sp AS (SELECT doc_id, page_no, nth AS split FROM {p}ca
  WHERE n >= 4 AND nth >= 3 AND n - nth >= 1 AND jump >= greatest(612 * 0.14, 40)
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY jump DESC, nth) = 1),
{p}rs AS (SELECT doc_id, page_no, min(x) AS rs FROM {p}ca JOIN {p}sp USING (doc_id, page_no) WHERE nth >= split GROUP BY ALL),
{p}sd AS (SELECT {p}ca.*, rs, CASE WHEN nth >= split THEN 'r' WHEN x + w <= rs - 9.18 THEN 'l' END AS side,
    {sql_count('text', chr(92) + 'p{L}' + chr(92) + 'p{N}')} AS vc
  FROM {p}ca JOIN {p}sp USING (doc_id, page_no) JOIN {p}rs USING (doc_id, page_no)),
{p}ag AS (SELECT doc_id, page_no, any_value(rs) AS rs, count(*) FILTER (side = 'l') AS ln, count(*) FILTER (side = 'r') AS rn,
    sum(vc) FILTER (side = 'l') AS lc, sum(vc) FILTER (side = 'r') AS rc,
    quantile_cont(w, 0.5) FILTER (side = 'l') AS lw, quantile_cont(w, 0.5) FILTER (side = 'r') AS rw,
    max(x + w) FILTER (side = 'l') AS le,
    greatest(min(y) FILTER (side = 'l'), min(y) FILTER (side = 'r')) AS top,
    least(max(y + h) FILTER (side = 'l'), max(y + h) FILTER (side = 'r')) AS bot FROM {p}sd GROUP BY ALL),
{p}co AS (SELECT doc_id, page_no, le AS left_end, rs AS right_start, rs - le AS gutter_width, top, bot FROM {p}ag
  WHERE ln >= 2 AND rn >= 2 AND lc >= 12 AND (lw >= 61.2 OR lc >= 80) AND rc >= 12 AND (rw >= 61.2 OR rc >= 80)
    AND bot - top >= 5 AND rs - le >= 9.18)"""


P1 = "i1 AS (SELECT nb.*, lane FROM nb LEFT JOIN gu USING (doc_id, page_no)), " + _lines_sql("a", "i1")
P2 = (
    """sx AS (SELECT aty.*, left_end + gutter_width / 2 AS gx, top AS ctop, bot AS cbot FROM aty JOIN aco USING (doc_id, page_no)
  WHERE aty.x < left_end + gutter_width / 2 AND aty.x + aty.w > left_end + gutter_width / 2),
rg AS (SELECT doc_id, page_no, left_end + gutter_width / 2 AS gx,
    (SELECT greatest(0.0, max(y + h + 2.5)) FROM sx WHERE sx.doc_id = aco.doc_id AND sx.page_no = aco.page_no
      AND y < ctop AND type IN ('heading', 'metadata')) AS rtop FROM aco),
kp AS (SELECT DISTINCT doc_id, page_no, row_ix FROM sx WHERE NOT (coalesce(inner_pc, 1e9) < gx AND last_c > gx)
    OR inner_gap <= 9),
i2 AS (SELECT i1.*, gx, coalesce(rtop, 0.0) AS rtop, kp.row_ix IS NOT NULL AS keep FROM i1 JOIN rg USING (doc_id, page_no)
  LEFT JOIN kp USING (doc_id, page_no, row_ix)), """
    + _lines_sql("b", "i2", "(NOT keep AND y + 5 >= rtop AND y + 5 <= 792 AND pc < gx AND x + w / 2 > gx AND gap >= 4.5)")
)
FL = """fl AS (SELECT aty.*, NULL::DOUBLE AS right_start, NULL::DOUBLE AS gutter_width FROM aty ANTI JOIN bco USING (doc_id, page_no)
    ANTI JOIN aco USING (doc_id, page_no)
  UNION ALL SELECT aty.*, aco.right_start, aco.gutter_width FROM aty JOIN aco USING (doc_id, page_no) ANTI JOIN bco USING (doc_id, page_no)
  UNION ALL SELECT bty.*, bco.right_start, bco.gutter_width FROM bty JOIN bco USING (doc_id, page_no)),
cl AS (SELECT *, CASE WHEN right_start IS NULL THEN 0 WHEN x + w <= right_start - greatest(2, gutter_width * 0.15) THEN 0
    WHEN x >= right_start - greatest(2, gutter_width * 0.15) THEN 1 END AS col_ix FROM fl),
sn AS (SELECT doc_id, page_no, line_ix, y + 1.5 AS lim,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, line_ix) - 1 AS i FROM cl WHERE col_ix IS NULL),
ns AS (SELECT doc_id, page_no, count(*) AS n FROM sn GROUP BY ALL),
br AS (SELECT cl.doc_id, cl.page_no, cl.line_ix, min(i) AS b FROM cl JOIN sn
    ON sn.doc_id = cl.doc_id AND sn.page_no = cl.page_no AND cl.col_ix IS NOT NULL AND sn.lim > cl.y GROUP BY ALL),
ro AS (SELECT cl.*, CAST(row_number() OVER (PARTITION BY cl.doc_id, cl.page_no ORDER BY
    CASE WHEN col_ix IS NULL THEN sn.i ELSE coalesce(br.b, ns.n, 0) END, col_ix IS NULL, col_ix, y, x, cl.line_ix) AS INTEGER)
    AS order_ix FROM cl LEFT JOIN sn USING (doc_id, page_no, line_ix) LEFT JOIN br USING (doc_id, page_no, line_ix)
    LEFT JOIN ns USING (doc_id, page_no))"""
CP = """c0 AS (SELECT *, coalesce('c' || col_ix, 's' || row_ix) AS grp FROM ro),
c1 AS (SELECT *, count(*) FILTER (type = 'caption') OVER gw AS chain, lag(y + h) OVER gw AS pb,
    last_value(CASE WHEN type = 'caption' THEN x END IGNORE NULLS) OVER gw AS ax
  FROM c0 WINDOW gw AS (PARTITION BY doc_id, page_no, grp ORDER BY y, order_ix)),
c2 AS (SELECT *, row_number() OVER cw - 1 AS pos, sum(CASE WHEN type = 'caption' THEN 0 WHEN type = 'paragraph'
    AND y - pb BETWEEN -2.5 AND 5.5 AND abs(x - ax) <= 20 THEN 0 ELSE 1 END) OVER cw AS broken FROM c1
  WINDOW cw AS (PARTITION BY doc_id, page_no, grp, chain ORDER BY y, order_ix)),
cp AS (SELECT * EXCLUDE (type), CASE WHEN chain > 0 AND broken = 0 AND pos BETWEEN 1 AND 8 THEN 'caption' ELSE type END AS type
  FROM c2)"""
SG = """s0 AS (SELECT *, list_sort(list(x) OVER pw) AS xs, list_sort(list(w) OVER pw) AS ws FROM cp
    WHERE type = 'paragraph' AND col_ix IS NOT NULL WINDOW pw AS (PARTITION BY doc_id, page_no, col_ix)),
s1 AS (SELECT *, x - xs[CAST(floor((len(xs) - 1) * 0.15::DOUBLE + 0.5) AS BIGINT) + 1] >= 8 AS ind,
    w <= ws[CAST(floor((len(ws) - 1) * 0.72::DOUBLE + 0.5) AS BIGINT) + 1] * 0.76::DOUBLE AS short,
    regexp_matches(text, '^\\s*\\[\\s*[0-9]+(?:\\s*[-,]\\s*[0-9]+)*\\s*\\]') AS ref FROM s0),
s2 AS (SELECT *, lag(ind) OVER sw AS pi, lead(ind) OVER sw AS ni, lag(short) OVER sw AS ps, lag(text) OVER sw AS pt,
    lag(y + h) OVER sw AS py, count(*) FILTER (ref OR NOT ind) OVER sw AS ch FROM s1
  WINDOW sw AS (PARTITION BY doc_id, page_no, col_ix ORDER BY order_ix)),
s3 AS (SELECT *, row_number() OVER hw AS hp, first_value(ref) OVER hw AS entry,
    nth_value(x, 2) OVER (PARTITION BY doc_id, page_no, col_ix, ch ORDER BY order_ix ROWS BETWEEN UNBOUNDED PRECEDING AND
      UNBOUNDED FOLLOWING) AS hx FROM s2 WINDOW hw AS (PARTITION BY doc_id, page_no, col_ix, ch ORDER BY order_ix)),
s4 AS (SELECT *, entry AND hp > 1 AND ind AND sum(CASE WHEN hp > 1 AND abs(x - hx) > 2.5 THEN 1 ELSE 0 END) OVER
    (PARTITION BY doc_id, page_no, col_ix, ch ORDER BY order_ix) = 0 AS hang FROM s3),
ps AS (SELECT cp.*, coalesce((s4.ref OR (ind AND NOT coalesce(pi, false) AND NOT coalesce(ni, false) AND (pt IS NULL OR ps
      OR regexp_matches(pt, '[.!?\\x{3002}\\x{FF01}\\x{FF1F}]["''\\x{201D}\\x{2019}\\])]?$')
      OR regexp_matches(pt, '\\[\\s*[0-9]+(?:\\s*[-,]\\s*[0-9]+)*\\s*\\][.)]?$') OR s4.y - py > 4.5))) AND NOT hang, false)
    AS paragraph_start, coalesce(short, false) AS short_line FROM cp LEFT JOIN s4 USING (doc_id, page_no, line_ix))"""
BL = f"""b0 AS (SELECT *, lag(struct_pack(c := col_ix, t := type, x := x, w := w, e := y + h, s := text, p := paragraph_start))
    OVER (PARTITION BY doc_id, page_no ORDER BY order_ix) AS q FROM ps),
b1 AS (SELECT *, y - q.e AS gp, abs(x - q.x) AS di,
    CASE WHEN type = 'heading' THEN text ELSE q.s END AS ht FROM b0),
b2 AS (SELECT *, q IS NOT NULL AND q.c IS NOT DISTINCT FROM col_ix AND (
    (q.t = type AND gp >= -3.5 AND gp <= CASE type WHEN 'paragraph' THEN 13 WHEN 'quote' THEN 11 ELSE 8.5 END
      AND type <> 'list' AND NOT (type = 'paragraph' AND paragraph_start)
      AND (di <= 18 OR abs((q.x + q.w / 2) - (x + w / 2)) <= 18
        OR (type = 'paragraph' AND (q.p OR regexp_matches(q.s, '^\\s*\\[\\s*[0-9]+(?:\\s*[-,]\\s*[0-9]+)*\\s*\\]')) AND di <= 40)))
    OR (((q.t = 'paragraph' AND type = 'paragraph') OR (((q.t = 'paragraph' AND type = 'heading')
        OR (q.t = 'heading' AND type = 'paragraph')) AND NOT regexp_matches(CASE WHEN q.t = 'heading' THEN q.s ELSE text END,
        '(?i)^\\s*(?:abstract|keywords?|references|bibliography|acknowledg(?:e)?ments?|appendix|[0-9]+(?:\\.[0-9]+)*\\s+[\\p{{L}}\\p{{N}}])')))
      AND gp >= -4 AND gp <= 18 AND di <= 50)) AS joined FROM b1),
b3 AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY order_ix) AS block_ix FROM b2),
bl AS (SELECT doc_id, page_no, CAST(block_ix AS BIGINT) AS block_ix, arg_min(type, order_ix) AS type,
    CASE WHEN count(col_ix) = 0 THEN NULL ELSE arg_min(col_ix, order_ix) END AS col_ix,
    list_reduce(list(text ORDER BY order_ix), lambda a, z: CASE
      WHEN regexp_matches(right(a, 2), '\\p{{L}}-$') AND regexp_matches(left(z, 1), '^\\p{{Ll}}') THEN left(a, length(a) - 1) || z
      WHEN {_nospace('a', 'z')} THEN a || z ELSE a || ' ' || z END) AS text, count(*) AS n_lines,
    min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b3 GROUP BY doc_id, page_no, block_ix)"""
OB = """pw AS (SELECT DISTINCT doc_id, page_no, right_start, gutter_width FROM fl),
bs AS (SELECT doc_id, page_no, block_ix, y + 1.5 AS lim,
    row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y, text, block_ix) - 1 AS i FROM bl WHERE col_ix IS NULL),
bn AS (SELECT doc_id, page_no, count(*) AS n FROM bs GROUP BY ALL),
bb AS (SELECT bl.doc_id, bl.page_no, bl.block_ix, min(i) AS b FROM bl JOIN bs ON bs.doc_id = bl.doc_id
    AND bs.page_no = bl.page_no AND bl.col_ix IS NOT NULL AND bs.lim > bl.y GROUP BY ALL),
bo AS (SELECT bl.*, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY
    CASE WHEN col_ix IS NULL THEN bs.i ELSE coalesce(bb.b, bn.n, 0) END, col_ix IS NULL, col_ix, y, x, text, bl.block_ix)
    AS block_no FROM bl LEFT JOIN bs USING (doc_id, page_no, block_ix) LEFT JOIN bb USING (doc_id, page_no, block_ix)
    LEFT JOIN bn USING (doc_id, page_no))"""
PV = """vw AS (SELECT DISTINCT doc_id, page_no FROM it),
pf AS (SELECT fl.doc_id, fl.page_no, CAST(sum(valid) AS BIGINT) AS valid_chars, sum(w * h) / (612.0 * 792.0) AS cov,
    max(right_start) IS NOT NULL AS two FROM fl GROUP BY ALL),
pv AS (SELECT doc_id, page_no, CASE WHEN pf.doc_id IS NULL OR valid_chars < 12 OR cov < 0.00025 THEN 'scanned' ELSE 'text' END
    AS page_type, coalesce(valid_chars, 0) AS valid_chars, coalesce(floor(least(1.0, cov) * 1000 + 0.5) / 1000, 0.0) AS text_coverage,
    CASE WHEN pf.doc_id IS NULL OR valid_chars = 0 THEN 'no_text' WHEN valid_chars < 12 OR cov < 0.00025 THEN 'sparse_text' END
    AS scan_reason, CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS column_count FROM vw LEFT JOIN pf USING (doc_id, page_no))"""
FB = """fb AS (SELECT bo.doc_id, bo.page_no, CAST(block_no AS INTEGER) AS block_no,
    'p' || bo.page_no || '-b' || lpad(block_no::VARCHAR, 3, '0') AS block_id, type, text,
    CAST(length(text) AS BIGINT) AS n_chars, CAST(col_ix AS INTEGER) AS col_ix,
    floor(x / 612 * 1000 * 1000 + 0.5) / 1000 AS x, floor(y / 792 * 1000 * 1000 + 0.5) / 1000 AS y,
    floor(w / 612 * 1000 * 1000 + 0.5) / 1000 AS width, floor(h / 792 * 1000 * 1000 + 0.5) / 1000 AS height
  FROM bo JOIN pv USING (doc_id, page_no) WHERE page_type = 'text')"""


def _with(*ctes):
    return "WITH " + ", ".join(ctes) + " "


# --- runs ---------------------------------------------------------------------

QUERIES["text_items"] = lambda spark, d: _inputs(spark, d)[0].withColumns(
    {"tx": F.get("transform", F.lit(4)), "ty": F.get("transform", F.lit(5))}
).drop("transform")
ORACLES["text_items"] = _with(IT) + (
    "SELECT doc_id, page_no, item_ix, str, 'ltr' AS dir, 'F1' AS font_name, false AS has_eol, w AS width, "
    "10.0::DOUBLE AS height, x AS tx, 792.0::DOUBLE - (y + 8) AS ty FROM it"
)
QUERIES["sanitize_items"] = lambda spark, d: T.sanitize_items(_inputs(spark, d)[0]).select("doc_id", "item_ix", "str")
ORACLES["sanitize_items"] = _with(IT) + "SELECT doc_id, item_ix, text AS str FROM g"
QUERIES["item_geometry"] = lambda spark, d: G.item_geometry(*_inputs(spark, d)).select(
    "doc_id", "page_no", "item_ix", "text", "font_size", "angle", "quarter", "bx", "by", "bw", "bh"
)
ORACLES["item_geometry"] = _with(IT) + (
    "SELECT doc_id, page_no, item_ix, text, 10.0::DOUBLE AS font_size, 0.0::DOUBLE AS angle, 0 AS quarter, x AS bx, "
    "y AS by, w AS bw, h AS bh FROM g"
)
QUERIES["font_flags"] = lambda spark, d: G.item_geometry(*_inputs(spark, d)).select(
    "doc_id", "item_ix", "is_bold", "is_italic"
)
ORACLES["font_flags"] = _with(IT) + "SELECT doc_id, item_ix, is_bold, is_italic FROM g"
QUERIES["page_orientation"] = lambda spark, d: G.page_orientation(G.item_geometry(*_inputs(spark, d)))
ORACLES["page_orientation"] = _with(IT) + (
    "SELECT doc_id, page_no, 0 AS orientation, sum(48 + least(80, greatest(1, "
    + sql_count("text", "\\p{L}\\p{N}")
    + ")))::DOUBLE AS weight FROM g GROUP BY doc_id, page_no"
)
QUERIES["logical_geometry"] = lambda spark, d: _prepared(spark, d).select(
    "doc_id", "page_no", "item_ix", "lx", "ly", "lw", "lh", "logical_width", "logical_height", "is_main", "n_ignored"
)
ORACLES["logical_geometry"] = _with(IT) + (
    "SELECT doc_id, page_no, item_ix, x AS lx, y AS ly, w AS lw, h AS lh, 612.0::DOUBLE AS logical_width, "
    "792.0::DOUBLE AS logical_height, true AS is_main, 0::BIGINT AS n_ignored FROM g"
)

# --- rows, gutters, segments ----------------------------------------------------

QUERIES["row_bands"] = lambda spark, d: _rows(spark, d).select(
    "doc_id", "page_no", "item_ix", "row_ix", "row_y", "row_h"
)
ORACLES["row_bands"] = _with(IT, RB) + "SELECT doc_id, page_no, item_ix, row_ix, y AS row_y, h AS row_h FROM rb"
QUERIES["persistent_gutter"] = lambda spark, d: (
    R.persistent_gutter(R.with_neighbour(_rows(spark, d), R.UNIT))
    .filter("gutter_lane is not null")
    .groupBy("doc_id", "page_no")
    .agg(F.first("gutter_lane").alias("gutter_lane"), F.first("gutter_rows").cast("bigint").alias("gutter_rows"))
)
ORACLES["persistent_gutter"] = _with(IT, RB, GU) + (
    "SELECT doc_id, page_no, lane AS gutter_lane, score AS gutter_rows FROM gu"
)
QUERIES["split_segments"] = lambda spark, d: _segments(spark, d).select(
    "doc_id", "page_no", "item_ix", "row_ix", "seg_ix", "row_segments"
)
ORACLES["split_segments"] = _with(IT, RB, GU, P1) + (
    "SELECT doc_id, page_no, item_ix, row_ix, seg_ix, CAST(max(seg_ix) OVER (PARTITION BY doc_id, page_no, row_ix) + 1 "
    "AS INTEGER) AS row_segments FROM asg"
)

# --- lines ---------------------------------------------------------------------

QUERIES["assemble_lines"] = lambda spark, d: N.assemble_lines(_segments(spark, d)).select(
    "doc_id", "page_no", "row_ix", "seg_ix", "text", "dir", "is_bold", "is_italic", "n_items", "lx", "ly", "lw", "lh",
    "font_size", "row_segments",
)
ORACLES["assemble_lines"] = _with(IT, RB, GU, P1) + (
    "SELECT doc_id, page_no, row_ix, seg_ix, text, 'ltr' AS dir, is_bold, is_italic, n_items, x AS lx, y AS ly, w AS lw, "
    "h AS lh, 10.0::DOUBLE AS font_size, row_segments FROM aln"
)
QUERIES["mark_table_rows"] = lambda spark, d: U.line_rows(_first(spark, d), "row_ix", "seg_ix", "line_ix", "is_table", "text").select(
    "doc_id", "page_no", "row_ix", "seg_ix", "line_ix", "is_table", "text"
)
ORACLES["mark_table_rows"] = _with(IT, RB, GU, P1) + (
    "SELECT doc_id, page_no, row_ix, seg_ix, line_ix, false AS is_table, text FROM aty"
)
QUERIES["classify_lines"] = lambda spark, d: U.line_rows(_first(spark, d), "line_ix", "type").select(
    "doc_id", "page_no", "line_ix", "type"
)
ORACLES["classify_lines"] = _with(IT, RB, GU, P1) + "SELECT doc_id, page_no, line_ix, type FROM aty"
QUERIES["detect_columns"] = lambda spark, d: (
    _first(spark, d)
    .filter("columns is not null")
    .groupBy("doc_id", "page_no")
    .agg(F.max("columns").alias("c"))
    .select("doc_id", "page_no", "c.left_end", "c.right_start", "c.gutter_width", "c.top", "c.bottom")
)
ORACLES["detect_columns"] = _with(IT, RB, GU, P1) + (
    "SELECT doc_id, page_no, left_end, right_start, gutter_width, top, bot AS bottom FROM aco"
)
QUERIES["refine_columns"] = lambda spark, d: U.line_rows(U.refined(_first(spark, d))).select(
    "doc_id", "page_no", "line_ix", "row_ix", "seg_ix", "text", "type", F.col("columns.right_start").alias("right_start")
)
ORACLES["refine_columns"] = _with(IT, RB, GU, P1, P2, FL) + (
    "SELECT doc_id, page_no, line_ix, row_ix, seg_ix, text, type, right_start FROM fl"
)
QUERIES["reading_order"] = lambda spark, d: U.line_rows(_ordered(spark, d), "line_ix", "order_ix", "col_ix").select(
    "doc_id", "page_no", "line_ix", "order_ix", "col_ix"
)
ORACLES["reading_order"] = _with(IT, RB, GU, P1, P2, FL) + (
    "SELECT doc_id, page_no, line_ix, order_ix, CAST(col_ix AS INTEGER) AS col_ix FROM ro"
)
QUERIES["extend_captions"] = lambda spark, d: U.line_rows(U.with_captions(_ordered(spark, d)), "order_ix", "type").select(
    "doc_id", "page_no", "order_ix", "type"
)
ORACLES["extend_captions"] = _with(IT, RB, GU, P1, P2, FL, CP) + "SELECT doc_id, page_no, order_ix, type FROM cp"
QUERIES["paragraph_signals"] = lambda spark, d: U.line_rows(_final(spark, d), "order_ix", "type", "paragraph_start", "short_line").select(
    "doc_id", "page_no", "order_ix", "type", "paragraph_start", "short_line"
)
ORACLES["paragraph_signals"] = _with(IT, RB, GU, P1, P2, FL, CP, SG) + (
    "SELECT doc_id, page_no, order_ix, type, paragraph_start, short_line FROM ps"
)

# --- blocks and pages --------------------------------------------------------------

QUERIES["segment_blocks"] = lambda spark, d: B.segment_blocks(_final(spark, d)).select(
    "doc_id", "page_no", "block_ix", "type", "text", "n_lines", "lx", "ly", "lw", "lh"
)
ORACLES["segment_blocks"] = _with(IT, RB, GU, P1, P2, FL, CP, SG, BL) + (
    "SELECT doc_id, page_no, block_ix, type, text, n_lines, x AS lx, y AS ly, w AS lw, h AS lh FROM bl"
)
QUERIES["rotated_blocks"] = lambda spark, d: B.place_rotated_blocks(
    B.segment_blocks(P.analyze_units(I.turned_margin_notes(_inputs(spark, d)[0]), *_inputs(spark, d)[1:]))
).filter("not is_main").select(
    "doc_id", "page_no", "block_no", "type", "text", "reading_orientation", "col_ix", "lx", "ly", "lw", "lh"
)


QUERIES["finalize_blocks"] = lambda spark, d: P.page_blocks(*_inputs(spark, d)).select(
    "doc_id", "page_no", "block_no", "block_id", "type", "text", "n_chars", "col_ix", "x", "y", "width", "height"
)
ORACLES["finalize_blocks"] = _with(IT, RB, GU, P1, P2, FL, CP, SG, BL, OB, PV, FB) + "SELECT * FROM fb"
QUERIES["page_verdict"] = lambda spark, d: B.page_verdict(
    P.analyze_pages(*_inputs(spark, d)), _inputs(spark, d)[1]
).select(
    "doc_id", "page_no", "page_type", "valid_chars", "text_coverage", "scan_reason", "column_count"
)
ORACLES["page_verdict"] = _with(IT, RB, GU, P1, P2, FL, PV) + "SELECT * FROM pv"


def _summary(spark, d):
    items, views, fonts = _inputs(spark, d)
    return B.document_summary(views, P.page_blocks(items, views, fonts, drop_invalid=False))


QUERIES["document_summary"] = _summary
ORACLES["document_summary"] = _with(IT, RB, GU, P1, P2, FL, CP, SG, BL, OB, PV, FB) + """,
n AS (SELECT doc_id, page_no, count(*) AS nb FROM fb GROUP BY ALL)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (page_type = 'text') AS n_text_pages,
  count(*) FILTER (page_type <> 'text') AS n_scanned_pages, CAST(coalesce(sum(nb), 0) AS BIGINT) AS n_blocks,
  count(*) FILTER (page_type = 'text' AND column_count > 1) AS n_column_pages, 0::BIGINT AS n_table_pages,
  0::BIGINT AS n_footnote_pages, CASE WHEN count(*) FILTER (page_type <> 'text') = count(*) THEN 'all'
    WHEN count(*) FILTER (page_type <> 'text') > 0 THEN 'some' ELSE 'none' END AS scan_class
FROM pv LEFT JOIN n USING (doc_id, page_no) GROUP BY doc_id"""
