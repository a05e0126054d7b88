"""Rows, lines, columns, reading order, captions and paragraphs over units held as one row each.

A unit is the runs of a page that share a reading direction.  Its runs, rows and lines are arrays of one table row, so
the steps below are array expressions: no step sorts or copies table rows, and a task compiles a few classes instead of
some for each window.  A page is bounded, and no step takes more than its runs times its text rows.

Each step adds its columns through a one-row generator (``_with``), so that the optimizer does not write a column out
again inside the lambda of a later one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import SPACE_CHARS, code_points, valid_chars
from glossa.operators.layout.lines import (
    CAPTION_START,
    DIRECTIONS,
    HEADING_START,
    LIST_START,
    METADATA_LINE,
)
from glossa.operators.layout.rows import _FOLD, _SWEEP, EQUATION_NUMBER, UNIT
from glossa.operators.text import CLOSING, OPENING, UNSPACED

# Patterns of paragraph ends and of numbered references.
SENTENCE_END = r"[.!?\x{3002}\x{FF01}\x{FF1F}][\"'\x{201D}\x{2019}\])]?\z"
REFERENCE_START = r"\A\s*\[\s*[0-9]+(?:\s*[-,]\s*[0-9]+)*\s*\]"
CITATION_END = r"\[\s*[0-9]+(?:\s*[-,]\s*[0-9]+)*\s*\][.)]?\z"

#: What a line is made of; every run has them too (``f``), as a line of its own.
LINE_FIELDS = [
    "text", "dir", *[f"w_{d}" for d in DIRECTIONS], "bx", "by", "bw", "bh", "lx", "ly", "lw", "lh",
    "font_size", "font_name", "is_bold", "is_italic", "n_items", "item_valid", "item_area",
]
#: Where a line stands among the rows and segments.
PLACE_FIELDS = ["row_ix", "seg_ix", "row_segments", "is_table"]
#: What holds for all runs of a unit.
FACTS = ["is_main", "orientation", "n_ignored", "logical_width", "logical_height", "page"]


def _with(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with columns given as SQL, behind a generator of one row."""
    added = F.struct(*[F.expr(sql).alias(name) for name, sql in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(added)))


# --- SQL fragments -----------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _regex(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _r3(value: str) -> str:
    """``round3`` in SQL."""
    return f"cast(floor(({value}) * 1000.0D + 0.5D) as double) / 1000.0D"


def _starts(array: str, flag: str) -> str:
    """Positions ``k`` of ``array`` where ``flag`` holds, and 0."""
    return f"filter(transform({array}, (x_, k) -> k), k -> k = 0 or {flag})"


def _slices(array: str, starts: str) -> str:
    """``array`` cut at the positions ``starts``."""
    return f"transform({starts}, (s_, j_) -> slice({array}, s_ + 1, coalesce(get({starts}, j_ + 1), size({array})) - s_))"


def _cut(array: str, flag: str) -> str:
    """Slices of ``array``; one starts where ``flag`` of the position ``k`` holds, the first at 0."""
    return _let("cuts_", _starts(array, flag), _slices(array, "cuts_"))


def _median(array: str) -> str:
    """Exact median, null for an empty array; the two middles are averaged."""
    middle = "shiftright(size(sorted_), 1)"
    return _let(
        "sorted_",
        f"sort_array({array})",
        f"if(size(sorted_) % 2 = 0, (get(sorted_, {middle} - 1) + get(sorted_, {middle})) / 2, get(sorted_, {middle}))",
    )


def _total(array: str, value: str, zero: str = "0L") -> str:
    """Sum of ``value`` over the elements ``i``."""
    return f"aggregate({array}, {zero}, (sum_, i) -> sum_ + {value})"


def _box(array: str, p: str) -> dict[str, str]:
    """Box around the boxes ``{p}x/y/w/h`` of an array of structs."""
    left, top = (f"array_min(transform({array}, i -> i.{p}{c}))" for c in "xy")
    right, low = (f"array_max(transform({array}, i -> i.{p}{c} + i.{p}{d}))" for c, d in ("xw", "yh"))
    return {f"{p}x": _r3(left), f"{p}y": _r3(top), f"{p}w": _r3(f"{right} - {left}"), f"{p}h": _r3(f"{low} - {top}")}


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def _majority(weights: dict[str, str], first: dict[str, str]) -> str:
    """Direction with most characters; the one seen first wins a tie."""
    ranked = ", ".join(
        f"named_struct('w', coalesce({weights[d]}, 0L), 'f', -coalesce({first[d]}, {2**40}L), 'd', '{d}')" for d in weights
    )
    return f"array_max(array({ranked})).d"


def _unspaced(left: str, right: str) -> str:
    """``joins_without_space`` in SQL."""
    end, start = f"right({left}, 1)", f"left({right}, 1)"
    return (
        f"({start} rlike {_regex(CLOSING)} or {end} rlike {_regex(OPENING)}"
        f" or ({end} rlike {_regex(UNSPACED)} and {start} rlike {_regex(UNSPACED)}))"
    )


def _trimmed(text: str) -> str:
    return f"btrim({text}, '{SPACE_CHARS}')"


# --- units and text rows ---------------------------------------------------------------


def gather_units(items: DataFrame) -> DataFrame:
    """One row per unit: its facts and its runs (``items``).

    Runs come from ``item_geometry``, with clean text and rounded boxes, so most facts of a line of one run are the run's.
    """
    counted = items.withColumns({"_n": code_points(F.col("text")), "item_valid": valid_chars(F.col("text"))})
    counted = counted.withColumns(
        {
            **{f"w_{d}": F.when(F.col("dir") == d, F.greatest(F.lit(1).cast("bigint"), "_n")) for d in DIRECTIONS},
            "n_items": F.lit(1),
            "item_area": F.col("bw") * F.col("bh"),
        }
    )
    run = F.struct("item_ix", "has_eol", F.struct(*LINE_FIELDS).alias("f"))
    return counted.groupBy(*UNIT).agg(
        F.first(F.struct(*FACTS)).alias("_facts"), F.collect_list(run).alias("items")
    ).select(*UNIT, "_facts.*", "items")


def _across(array: str, y: str, order: str) -> str:
    """A band of boxes sorted by y, then by ``order`` (of ``e``), put in that order throughout."""
    by_x = f"transform(sort_array(transform(g, e -> named_struct({order}, 'e', e))), z -> z.e)"
    return f"transform({array}, g -> if(g[0].{y} = get(g, size(g) - 1).{y}, g, {by_x}))"


def with_rows(units: DataFrame) -> DataFrame:
    """Adds ``rows`` (y, h, runs by x): the text rows of ``row_bands``, from top to bottom.

    ``runs`` are short: where the run is in ``items`` (``at``) and what rows and gaps are made of.
    """
    df = _with(
        units,
        _runs="""sort_array(transform(items, (i, k) -> named_struct('ly', i.f.ly, 'lx', i.f.lx, 'item_ix', i.item_ix,
            'at', k, 'lh', i.f.lh, 'lw', i.f.lw, 'font_size', i.f.font_size, 'has_eol', i.has_eol)))""",
    )
    # Bands of near-equal y; a new one starts where y grows by more than 0.5.
    df = _with(df, _at=_starts("_runs", "get(_runs, k).ly - get(_runs, k - 1).ly > 0.5D"))
    across = _across(_slices("_runs", "_at"), "ly", "'x', e.lx, 'n', e.item_ix, 'k', e.at")
    df = _with(df, _bands=across).drop("_runs")
    df = _with(
        df,
        _stats="""transform(_bands, b -> named_struct(
            'low', array_max(transform(b, i -> i.ly + i.lh)), 'far', array_max(transform(b, i -> i.ly + i.lh / 2)),
            'top', array_min(transform(b, i -> i.ly)),
            'near', array_min(transform(b, i -> i.ly + i.lh / 2 - greatest(2.0D, i.font_size * 0.48D)))))""",
    )
    df = _with(
        df,
        _above="""aggregate(_stats, cast(array() as array<struct<low:double,far:double>>), (a, x) -> array_append(a,
            named_struct('low', greatest(x.low, get(a, size(a) - 1).low), 'far', greatest(x.far, get(a, size(a) - 1).far))))""",
        _below="""reverse(aggregate(reverse(_stats), cast(array() as array<struct<top:double,near:double>>), (a, x) -> array_append(a,
            named_struct('top', least(x.top, get(a, size(a) - 1).top), 'near', least(x.near, get(a, size(a) - 1).near)))))""",
    ).drop("_stats")
    # A strip starts where no later run can join an earlier row.
    opens = "(get(_below, k).top >= get(_above, k - 1).low and get(_below, k).near > get(_above, k - 1).far)"
    df = _with(df, _at=_starts("_bands", opens)).drop("_above", "_below")
    df = _with(df, _strips=f"transform({_slices('_bands', '_at')}, g -> flatten(g))").drop("_bands", "_at")
    plain = "not exists(_members, m -> m.ly <> _members[0].ly or m.lh <> _members[0].lh)"
    folded = _let(
        "numbers",
        _FOLD,
        _let(
            "numbered",
            """sort_array(transform(_members, (m, k) -> named_struct('n', numbers[k], 'x', m.lx, 'i', m.item_ix, 'at', m.at,
                'm', m)))""",
            f"transform({_cut('numbered', 'get(numbered, k).n <> get(numbered, k - 1).n')}, g -> transform(g, e -> e.m))",
        ),
    )
    top = "array_min(transform(g, i -> i.ly))"
    row = _struct(
        {"y": _r3(top), "strip": "t", "sub": "u", "h": _r3(f"array_max(transform(g, i -> i.ly + i.lh)) - {top}"), "runs": "g"}
    )
    return _with(
        df,
        rows=f"""sort_array(flatten(transform(_strips, (_members, t) ->
            transform(if({plain}, array(_members), {folded}), (g, u) -> {row}))))""",
    ).drop("_strips")


# --- gutter and lines ----------------------------------------------------------------------

_EQNO = f"(x.lw <= logical_width * 0.08D and get(items, x.at).f.text rlike {_regex(EQUATION_NUMBER)})"
_GAP = "(x.lx - (p.lx + p.lw))"
_PAIR_FONT = "((p.font_size + x.font_size) / 2)"


def _pair(array: str, body: str) -> str:
    """``body`` on the run ``x`` at ``k`` and the one before it, ``p``."""
    return _let("p", f"get({array}, k - 1)", _let("x", f"get({array}, k)", body))


def with_gutter(units: DataFrame) -> DataFrame:
    """Adds ``gutter_lane`` and ``gutter_rows``, the lane of ``persistent_gutter``."""
    counts = (
        f"{_GAP} >= greatest(logical_width * 0.008D, {_PAIR_FONT} * 1.05D) and p.lx + p.lw < logical_width * 0.75D"
        f" and x.lx > logical_width * 0.25D and not {_EQNO}"
    )
    df = _with(
        units,
        _gaps=f"""flatten(transform(rows, r -> filter(transform(r.runs, (x, k) -> if(k = 0, null, {_let(
            "p", "get(r.runs, k - 1)", f"if({counts}, named_struct('s', p.lx + p.lw, 'e', x.lx), null)")})), g -> g is not null)))""",
        _min_rows="if(size(rows) >= 6, greatest(3L, ceil(size(rows) * 0.06D)), 2L)",
    )
    df = _with(df, _best=f"if(size(_gaps) >= 2, {_SWEEP.replace('array_sort(', 'sort_array(')}, null)")
    return _with(df, gutter_lane=_r3("_best.x"), gutter_rows="_best.score").drop("_gaps", "_min_rows", "_best")


def _line() -> str:
    """SQL of a line from the runs ``refs`` of the segment ``seg_ix`` of the row ``row_ix`` (``s``: its segments)."""
    dirs = ", ".join(f"'{d}'" for d in DIRECTIONS)
    weight = "greatest(1L, i.item_valid)"
    weights = {
        d: f"if(exists(g, i -> i.dir = '{d}'), {_total('g', f'coalesce(i.w_{d}, 0L)')}, null)" for d in DIRECTIONS
    }
    seen = {d: f"nullif(array_position(transform(g, i -> i.dir), '{d}'), 0L)" for d in DIRECTIONS}
    gap = "if(dir_ = 'rtl', p.lx - (x.lx + x.lw), x.lx - (p.lx + p.lw))"
    letters = f"(k = 1 and length(p.text) = 1 and length(x.text) = 1 and gap_ < {_PAIR_FONT} * 0.18D)"
    blank = f"(not {_unspaced('p.text', 'x.text')} and not {letters} and gap_ > -{_PAIR_FONT} * 0.08D)"
    piece = _let("p", "get(ordered, k - 1)", _let("gap_", gap, f"if({blank}, concat(' ', x.text), x.text)"))
    # Right-to-left lines read from the largest x.
    mirrored = "transform(sort_array(transform(g, (i, k) -> named_struct('x', -i.lx, 'n', k, 'i', i))), e -> e.i)"
    joined = f"array_join(transform(ordered, (x, k) -> if(k = 0, x.text, {piece})), '')"
    many = {
        "text": _trimmed(joined),
        "dir": "dir_",
        **{f"w_{d}": w for d, w in weights.items()},
        **_box("g", "b"),
        **_box("g", "l"),
        "font_size": _r3(_median("transform(g, i -> i.font_size)")),
        "font_name": "coalesce(get(filter(transform(ordered, i -> i.font_name), n -> n <> ''), 0), '')",
        "is_bold": f"{_total('g', f'if(i.is_bold, {weight}, 0L)')} >= {_total('g', weight)} * 0.5D",
        "is_italic": f"{_total('g', f'if(i.is_italic, {weight}, 0L)')} >= {_total('g', weight)} * 0.5D",
        "n_items": "size(g)",
        "item_valid": _total("g", "i.item_valid"),
        "item_area": _total("g", "i.item_area", "0.0D"),
    }
    whole = _let("ordered", f"if(dir_ = 'rtl', {mirrored}, g)", _struct({f: many[f] for f in LINE_FIELDS}))
    whole = _let("g", "transform(refs, e -> get(items, e.at).f)", _let("dir_", _majority(weights, seen), whole))
    facts = f"if(size(refs) = 1 and get(items, refs[0].at).f.dir in ({dirs}), get(items, refs[0].at).f, {whole})"
    place = {"row_ix": "row_ix", "seg_ix": "seg_ix", "row_segments": "size(s)", "is_table": "false"}
    return _struct({**place, "f": facts})


def _table_line() -> str:
    """SQL of the line that a table row of cells ``c`` collapses into."""
    cells = "transform(c, z -> z.f)"
    merged = {
        "text": f"array_join(transform({cells}, i -> i.text), '\t')",
        "font_size": _r3(_median(f"transform({cells}, i -> i.font_size)")),
        "n_items": _total(cells, "i.n_items", "0"),
        "item_valid": _total(cells, "i.item_valid"),
        "item_area": _total(cells, "i.item_area", "0.0D"),
        **{f"w_{d}": _total(cells, f"coalesce(i.w_{d}, 0L)") for d in DIRECTIONS},
        **_box(cells, "b"),
        **_box(cells, "l"),
    }
    place = {"row_ix": "c[0].row_ix", "seg_ix": "c[0].seg_ix", "row_segments": "size(c)", "is_table": "true"}
    return _struct({**place, "f": _struct({f: merged.get(f, f"c[0].f.{f}") for f in LINE_FIELDS})})


def with_lines(units: DataFrame, extra_cut: str = "false", missing: str = "false") -> DataFrame:
    """Adds ``segments`` (runs per row and segment), ``lines`` and ``marks``.

    Rows are cut as in ``split_segments`` (``extra_cut``: further cuts, on the row ``r``); lines follow the rules of
    ``assemble_lines``, ``mark_table_rows`` and ``classify_lines``.  ``marks`` has, from top to bottom, where a line is in
    ``lines`` (``k``) and its type.  Null where ``missing`` holds.
    """
    cut = f"""((p.has_eol and not {_EQNO}) or {_GAP} > greatest(logical_width * 0.08D, {_PAIR_FONT} * 5)
        or coalesce(p.lx + p.lw < gutter_lane and x.lx > gutter_lane
            and {_GAP} > greatest(logical_width * 0.008D, {_PAIR_FONT} * 1.05D), false) or {extra_cut})"""
    slices = _let("runs_", "r.runs", _cut("runs_", _pair("runs_", cut)))
    df = _with(
        units,
        segments=f"if({missing}, null, transform(rows, (r, row_ix) -> if(size(r.runs) = 1, array(r.runs), {slices})))",
    )
    df = _with(
        df,
        _cells=f"transform(segments, (s, row_ix) -> transform(s, (refs, seg_ix) -> {_line()}))",
    )
    # Rows of three and more cells next to a row with the same cell starts are table rows.
    aligned = (
        "(e.xs is not null and o.xs is not null and "
        + _let(
            "font_",
            _median("concat(e.fonts, o.fonts)"),
            "abs(e.y - o.y) <= font_ * 3 and size(filter(e.xs, a -> exists(o.xs, z -> abs(z - a) <= greatest(6.0D, font_ * 1.1D)))) >= 3",
        )
        + ")"
    )
    beside = " or ".join(f"coalesce({_let('o', f'get(by_y, j {step} 1)', aligned)}, false)" for step in "+-")
    wide = "transform(c, l -> l.f.{})"
    tables = _let(
        "by_y",
        f"""sort_array(transform(_cells, (c, i) -> named_struct('y', c[0].f.ly, 'i', i,
            'xs', if(size(c) >= 3, {wide.format('lx')}, null), 'fonts', if(size(c) >= 3, {wide.format('font_size')}, null))))""",
        f"transform(filter(transform(by_y, (e, j) -> named_struct('i', e.i, 't', {beside})), z -> z.t), z -> z.i)",
    )
    df = _with(
        df,
        _tables=f"if(is_main and exists(_cells, c -> size(c) >= 3), {tables}, cast(array() as array<int>))",
    )
    df = _with(
        df,
        lines=f"flatten(transform(_cells, (c, i) -> if(array_contains(_tables, i), array({_table_line()}), c)))",
    ).drop("_cells", "_tables")
    df = _with(
        df,
        _sorted="""sort_array(transform(lines, (l, k) -> named_struct('y', l.f.ly, 'x', l.f.lx, 'row_ix', l.row_ix,
            'seg_ix', l.seg_ix, 'k', k)))""",
        _body=f"coalesce({_median('transform(filter(lines, l -> not l.is_table), l -> l.f.font_size)')}, 12.0D)",
    )
    df = _with(df, _at=_starts("_sorted", "get(_sorted, k).y - get(_sorted, k - 1).y > 0.5D"))
    bands = _across(_slices("_sorted", "_at"), "y", "'x', e.x, 'row_ix', e.row_ix, 'seg_ix', e.seg_ix, 'k', e.k")
    edge = "greatest(24.0D, logical_height * 0.065D)"
    rules = [
        ("not is_main", "rotated_text"),
        ("get(lines, m.k).is_table", "table"),
        (f"l.ly + l.lh >= logical_height - {edge}", "footer"),
        ("l.ly >= logical_height * 0.68D and l.font_size <= _body * 0.8D", "footnote"),
        (f"l.text rlike {_regex(CAPTION_START)}", "caption"),
        (f"(l.font_size >= _body * 1.22D or l.text rlike {_regex(HEADING_START)}) and length(l.text) <= 240", "heading"),
        (f"l.ly <= {edge} and length(l.text) <= 240", "header"),
        (f"l.text rlike {_regex(METADATA_LINE)} and length(l.text) <= 240", "metadata"),
        (f"l.text rlike {_regex(LIST_START)}", "list"),
        ("l.is_italic and length(l.text) >= 20", "quote"),
    ]
    kind = "'paragraph'"
    for holds, name in reversed(rules):
        kind = f"if({holds}, '{name}', {kind})"
    mark = _let("l", "get(lines, m.k).f", f"named_struct('k', m.k, 'type', {kind})")
    return _with(df, marks=f"transform(flatten({bands}), m -> {mark})").drop("_sorted", "_at", "_body")


# --- columns ---------------------------------------------------------------------------------


def with_columns_found(units: DataFrame) -> DataFrame:
    """Adds the struct ``columns``, the layout of ``detect_columns``."""
    df = _with(
        units,
        _cands="""sort_array(filter(transform(marks, (m, j) -> if(is_main and get(lines, m.k).f.lw <= logical_width * 0.62D
              and m.type not in ('table', 'header', 'footer', 'heading', 'metadata'),
            named_struct('lx', get(lines, m.k).f.lx, 'line_ix', j + 1, 'lw', get(lines, m.k).f.lw, 'ly', get(lines, m.k).f.ly,
                'lh', get(lines, m.k).f.lh, 'font_size', get(lines, m.k).f.font_size, 'n_valid', get(lines, m.k).f.item_valid),
            null)), z -> z is not null))""",
    )
    df = _with(df, _font=f"coalesce({_median('transform(_cands, i -> i.font_size)')}, 12.0D)")
    df = _with(
        df,
        # The widest jump of x between candidates, the first on ties.
        _best="""if(size(_cands) >= 4, array_max(filter(transform(_cands, (x, k) -> if(k >= 2 and size(_cands) - k >= 2
              and x.lx - get(_cands, k - 1).lx >= greatest(logical_width * 0.14D, _font * 4),
              named_struct('jump', x.lx - get(_cands, k - 1).lx, 'k', -k), null)), z -> z is not null)), null)""",
    )
    df = _with(
        df,
        _right="if(_best is null, null, slice(_cands, 1 - _best.k, size(_cands)))",
        _left="""if(_best is null, null, filter(slice(_cands, 1, -_best.k),
            x -> x.lx + x.lw <= get(_cands, -_best.k).lx - greatest(8.0D, logical_width * 0.015D)))""",
    ).drop("_cands", "_best")
    sides = {}
    for s in ("left", "right"):
        sides |= {
            f"_{s}_chars": _total(f"_{s}", "i.n_valid"),
            f"_{s}_width": _median(f"transform(_{s}, i -> i.lw)"),
            f"_{s}_top": f"array_min(transform(_{s}, i -> i.ly))",
            f"_{s}_bottom": f"array_max(transform(_{s}, i -> i.ly + i.lh))",
        }
    found = "coalesce(size(_left) >= 2 and size(_right) >= 2, false)"
    df = _with(
        df,
        _found=found,
        **{n: f"if({found}, {v}, null)" for n, v in sides.items()},
        _end="array_max(transform(_left, i -> i.lx + i.lw))",
        _start="_right[0].lx",
    )
    solid = " and ".join(
        f"_{s}_chars >= 12 and (_{s}_width >= logical_width * 0.1D or _{s}_chars >= 80)" for s in ("left", "right")
    )
    top, low = "greatest(_left_top, _right_top)", "least(_left_bottom, _right_bottom)"
    layout = _struct(
        {
            "left_end": _r3("_end"), "right_start": _r3("_start"), "gutter_width": _r3("_start - _end"),
            "top": _r3(top), "bottom": _r3(low),
        }
    )
    two = f"_found and {solid} and {low} - {top} >= _font * 0.5D and _start - _end >= greatest(8.0D, logical_width * 0.015D)"
    return _with(df, columns=f"if({two}, {layout}, null)").drop("_font", "_right", "_left", "_found", "_end", "_start", *sides)


def _with_region(units: DataFrame) -> DataFrame:
    """Adds ``_region`` (x, top, bottom of the forced gutter) and ``_kept``, the rows it must not cut."""
    df = _with(units, _gx="columns.left_end + columns.gutter_width / 2")
    df = _with(
        df,
        _spans="""if(_gx is null, null, transform(
            filter(marks, m -> get(lines, m.k).f.lx < _gx and get(lines, m.k).f.lx + get(lines, m.k).f.lw > _gx),
            m -> named_struct('type', m.type, 'row_ix', get(lines, m.k).row_ix, 'seg_ix', get(lines, m.k).seg_ix,
                'is_table', get(lines, m.k).is_table, 'ly', get(lines, m.k).f.ly, 'lh', get(lines, m.k).f.lh,
                'font_size', get(lines, m.k).f.font_size)))""",
    )
    # First pair of neighbouring runs whose centres lie on both sides of the gutter.
    runs = "if(l.is_table, get(rows, l.row_ix).runs, get(get(segments, l.row_ix), l.seg_ix))"
    cross = _let(
        "runs",
        runs,
        "get(filter(transform(runs, (x, k) -> if(k > 0 and get(runs, k - 1).lx + get(runs, k - 1).lw / 2 < _gx"
        " and x.lx + x.lw / 2 > _gx, named_struct('gap', x.lx - (get(runs, k - 1).lx + get(runs, k - 1).lw),"
        " 'font', (x.font_size + get(runs, k - 1).font_size) / 2), null)), z -> z is not null), 0)",
    )
    pad = "least(3.0D, l.font_size * 0.25D)"
    top = f"""greatest(0.0D, array_max(transform(filter(_spans, l -> l.ly < columns.top
        and l.type in ('heading', 'header', 'metadata', 'table')), l -> l.ly + l.lh + {pad})))"""
    low = f"""least(logical_height, array_min(transform(filter(_spans, l -> l.ly + l.lh > columns.bottom
        and l.type = 'footer'), l -> l.ly - {pad})))"""
    df = _with(
        df,
        _kept=f"""transform(filter(_spans, l -> {_let("cross", cross, "cross is null or cross.gap <= greatest(3.0D, cross.font * 0.9D)")}),
            l -> l.row_ix)""",
        _top=top,
        _low=low,
    )
    return _with(
        df,
        _region="""if(_gx is null, null, named_struct('x', _gx, 'top', least(_top, logical_height),
            'bottom', least(greatest(_top, _low), logical_height)))""",
    ).drop("_gx", "_spans", "_top", "_low")


_FORCED = f"""coalesce(not array_contains(_kept, row_ix) and r.y + r.h / 2 >= _region.top and r.y + r.h / 2 <= _region.bottom
    and p.lx + p.lw / 2 < _region.x and x.lx + x.lw / 2 > _region.x and {_GAP} >= greatest(2.0D, {_PAIR_FONT} * 0.45D), false)"""


def refined(units: DataFrame) -> DataFrame:
    """Cut two-column pages again with a forced gutter; keep it if they stay two columns.

    Units with two columns get their lines of a second pass; lines and column layout always come from the same pass.
    """
    df = _with_region(units)
    df = df.withColumnsRenamed({"lines": "_lines1", "marks": "_marks1", "columns": "_columns1"}).drop("segments")
    df = with_columns_found(with_lines(df, _FORCED, "_region is null")).drop("_region", "_kept", "segments", "rows", "items")
    return _with(
        df,
        lines="if(columns is null, _lines1, lines)",
        marks="if(columns is null, _marks1, marks)",
        columns="if(columns is null, _columns1, columns)",
    ).drop("_lines1", "_marks1", "_columns1")


# --- reading order, captions, paragraphs ---------------------------------------------------


def ordered(units: DataFrame) -> DataFrame:
    """Adds ``order``: place in ``lines`` (``k``), ``line_ix``, ``col_ix`` and ``type`` of each line, by ``with_reading_order``.

    Lines of turned text belong to no column and keep their own top-down order.
    """
    edge = "(columns.right_start - greatest(2.0D, columns.gutter_width * 0.15D))"
    column = f"case when not is_main or columns is null then 0 when l.lx + l.lw <= {edge} then 0 when l.lx >= {edge} then 1 end"
    place = _let(
        "l",
        "get(lines, m.k).f",
        f"""named_struct('c', {column}, 'y', l.ly, 'x', l.lx, 'n', j + 1, 'k', m.k, 'type', m.type,
            'limit', l.ly + least(2.0D, l.font_size * 0.15D))""",
    )
    df = _with(units, _placed=f"transform(marks, (m, j) -> {place})").drop("marks")
    # Boxes that span the gutter are barriers; their limits are made monotonic.
    df = _with(
        df,
        _spans="""sort_array(transform(filter(_placed, z -> z.c is null), z -> named_struct('y', z.y, 'n', z.n, 'limit', z.limit)))""",
    )
    df = _with(
        df,
        _limits="""aggregate(_spans, cast(array() as array<double>),
            (a, x) -> array_append(a, greatest(x.limit, get(a, size(a) - 1))))""",
        _numbers="transform(_spans, s -> s.n)",
    ).drop("_spans")
    df = _with(
        df,
        _placed="""sort_array(transform(_placed, z -> named_struct(
            'b', if(z.c is null, cast(array_position(_numbers, z.n) as int) - 1, size(filter(_limits, m -> m <= z.y))),
            's', z.c is null, 'c', z.c, 'y', z.y, 'x', z.x, 'n', z.n, 'k', z.k, 'type', z.type)))""",
    ).drop("_limits", "_numbers")
    new_band = _let(
        "a",
        "get(_placed, k - 1)",
        _let("z", "get(_placed, k)", "a.b <> z.b or a.s <> z.s or not a.c <=> z.c or z.y - a.y > 0.5D"),
    )
    df = _with(df, _at=_starts("_placed", new_band))
    bands = _across(_slices("_placed", "_at"), "y", "'x', e.x, 'n', e.n")
    number = "named_struct('k', z.k, 'line_ix', z.n, 'col_ix', if(is_main, z.c, null), 'type', z.type)"
    return _with(df, order=f"transform(flatten({bands}), z -> {number})").drop("_placed", "_at")


def with_captions(units: DataFrame) -> DataFrame:
    """Up to eight matching paragraph lines below a caption become caption.

    A line compares with the caption above it and with its direct predecessor; the chain ends with the first line that fails.
    """
    font = "((a.font_size + x.font_size) / 2)"
    gap = "(x.ly - (p.ly + p.lh))"
    follows = f"""(get(g, k).type = 'paragraph' and {gap} >= -{font} * 0.25D and {gap} <= greatest(2.0D, a.font_size * 0.55D)
        and abs(x.lx - a.lx) <= greatest(12.0D, {font} * 2)
        and greatest(a.font_size, x.font_size) / greatest(1.0D, least(a.font_size, x.font_size)) <= 1.08D
        and (a.font_name = '' or x.font_name = '' or a.font_name = x.font_name)
        and x.is_bold = a.is_bold and x.is_italic = a.is_italic)"""
    fails = _let(
        "p", "get(lines, get(g, k - 1).k).f", _let("x", "get(lines, get(g, k).k).f", f"not coalesce({follows}, false)")
    )
    last = f"coalesce(get(filter(transform(g, (e, k) -> k), k -> k > 0 and {fails}), 0), size(g))"
    # Chains start at captions; each group (a column, or a row that spans both) is on its own.
    chains = _let(
        "grouped",
        """sort_array(transform(order, (z, i) -> named_struct(
            'g', coalesce(concat('c', z.col_ix), concat('s', get(lines, z.k).row_ix)), 'y', get(lines, z.k).f.ly, 'o', i + 1,
            'k', z.k, 'type', z.type)))""",
        _cut("grouped", "(get(grouped, k).g <> get(grouped, k - 1).g or get(grouped, k).type = 'caption')"),
    )
    becomes = f"""flatten(transform(filter({chains}, g -> g[0].type = 'caption'), g ->
        {_let("a", "get(lines, g[0].k).f", f"transform(slice(g, 2, least(8, {last} - 1)), e -> e.o)")}))"""
    df = _with(units, _become=f"if(exists(order, z -> z.type = 'caption'), {becomes}, cast(array() as array<int>))")
    kind = "if(array_contains(_become, i + 1), 'caption', z.type)"
    return _with(
        df,
        order=f"""if(size(_become) = 0, order, transform(order, (z, i) ->
            named_struct('k', z.k, 'line_ix', z.line_ix, 'col_ix', z.col_ix, 'type', {kind})))""",
    ).drop("_become")


def with_paragraphs(units: DataFrame) -> DataFrame:
    """Adds ``paragraph_start`` and ``short_line`` of paragraph lines in a column to ``order``."""

    def nearest(values: str, ratio: str) -> str:
        return f"get(sort_array(transform(g, l -> l.{values})), cast(floor((size(g) - 1) * {ratio} + 0.5D) as int))"

    place = _let(
        "l",
        "get(lines, z.k).f",
        """named_struct('c', z.col_ix, 'o', i + 1, 'k', z.k, 'lx', l.lx, 'lw', l.lw, 'y', l.ly, 'low', l.ly + l.lh,
            'font_size', l.font_size)""",
    )
    df = _with(
        units,
        _inside=f"""filter(transform(order, (z, i) -> if(z.type = 'paragraph' and z.col_ix is not null, {place}, null)),
            z -> z is not null)""",
    )
    marked = _let(
        "left_",
        nearest("lx", "0.15D"),
        _let(
            "width_",
            nearest("lw", "0.72D"),
            f"""transform(g, l -> named_struct('o', l.o, 'k', l.k, 'lx', l.lx, 'y', l.y, 'low', l.low, 'font_size', l.font_size,
                'indent', l.lx - left_ >= greatest(6.0D, l.font_size * 0.8D),
                'ref', get(lines, l.k).f.text rlike {_regex(REFERENCE_START)}, 'short', l.lw <= width_ * 0.76D))""",
        ),
    )
    df = _with(
        df, _columns=f"transform(array(0, 1), c -> {_let('g', 'filter(_inside, z -> z.c = c)', marked)})"
    ).drop("_inside")
    # A hanging entry starts at a reference line and runs over indented lines; a chain begins at every reference or
    # unindented line.
    off = "abs(get(e, k).lx - get(e, 1).lx) > greatest(2.0D, get(e, k).font_size * 0.25D)"
    entry = f"slice(e, 2, coalesce(get(filter(transform(e, (x, k) -> k), k -> k > 1 and {off}), 0), size(e)) - 1)"
    hanging = f"""if(exists(g, x -> x.ref), flatten(transform(filter({_cut("g", "(get(g, k).ref or not get(g, k).indent)")},
        e -> e[0].ref), e -> transform({entry}, x -> x.o))), cast(array() as array<int>))"""
    df = _with(df, _hanging=f"flatten(transform(_columns, g -> {hanging}))")
    text = "get(lines, p.k).f.text"
    closed = f"""(p is null or p.short or {text} rlike {_regex(SENTENCE_END)} or {text} rlike {_regex(CITATION_END)}
        or x.y - p.low > greatest(3.0D, x.font_size * 0.45D))"""
    alone = f"(not coalesce(p.indent, false) and not coalesce(get(g, k + 1).indent, false) and {closed})"
    start = f"(x.ref or x.indent and {_let('p', 'get(g, k - 1)', alone)}) and not array_contains(_hanging, x.o)"
    df = _with(
        df,
        _starting=f"flatten(transform(_columns, g -> transform(filter(transform(g, (x, k) -> if({start}, x, null)), x -> x is not null), x -> x.o)))",
        _short="sort_array(flatten(transform(_columns, g -> transform(filter(g, x -> x.short), x -> x.o))))",
    ).drop("_columns", "_hanging")
    line = """named_struct('k', z.k, 'line_ix', z.line_ix, 'col_ix', z.col_ix, 'type', z.type,
        'paragraph_start', array_contains(_starting, i + 1), 'short_line', array_contains(_short, i + 1))"""
    return _with(df, order=f"transform(order, (z, i) -> {line})").drop("_starting", "_short")


ORDER_FIELDS = ["line_ix", "col_ix", "type", "paragraph_start", "short_line"]


def _full_lines(units: DataFrame, fields: list[str] | None = None) -> str:
    """SQL of the lines as structs: in reading order, or from top to bottom before there is one."""
    array = "order" if "order" in units.columns else "marks"
    known = units.schema[array].dataType.elementType.names
    number = {"order_ix": "i + 1"} if array == "order" else {"line_ix": "i + 1"}
    line = {
        **number,
        **{f: f"z.{f}" for f in ORDER_FIELDS if f in known},
        **{f: f"get(lines, z.k).{f}" for f in PLACE_FIELDS},
        **{f: f"get(lines, z.k).f.{f}" for f in LINE_FIELDS},
    }
    return f"transform({array}, (z, i) -> {_struct({f: v for f, v in line.items() if fields is None or f in fields})})"


def line_rows(units: DataFrame, *fields: str) -> DataFrame:
    """One row per line (all columns of lines, or ``fields``), with the facts of its unit."""
    rest = [c for c in units.columns if c not in ("items", "rows", "segments", "lines", "marks", "order")]
    return units.select(*rest, F.inline(F.expr(_full_lines(units, list(fields) or None))))


# --- blocks --------------------------------------------------------------------------------


def _merges() -> str:
    """SQL: whether the line ``x`` continues the block of the line ``p`` before it."""
    font, gap, indent = "((p.font_size + x.font_size) / 2)", "(x.ly - (p.ly + p.lh))", "abs(x.lx - p.lx)"
    ratio = "(greatest(p.font_size, x.font_size) / greatest(1.0D, least(p.font_size, x.font_size)))"
    centred = f"abs((p.lx + p.lw / 2) - (x.lx + x.lw / 2)) <= greatest(18.0D, {font} * 1.8D)"
    expected = f"""(x.type = 'paragraph' and (p.paragraph_start or p.text rlike {_regex(REFERENCE_START)})
        and {indent} <= {font} * 4)"""
    strict = f"""(p.type = x.type and {gap} >= -{font} * 0.35D
        and {gap} <= {font} * case x.type when 'paragraph' then 1.3D when 'quote' then 1.1D else 0.85D end and {ratio} <= 1.35D
        and case when x.type = 'list' then false when x.type = 'table' then {gap} <= {font} * 0.55D
            when x.type in ('header', 'footer') then {gap} <= {font} * 0.4D
            when x.type = 'footnote' then {gap} <= {font} * 0.65D
            when x.type = 'paragraph' and x.paragraph_start then false
            else {indent} <= greatest(18.0D, {font} * 1.5D) or {centred} or {expected} end)"""
    heading_text = "if(p.type = 'heading', p.text, x.text)"
    loose = f"""({gap} >= -{font} * 0.4D and {gap} <= {font} * 1.8D and {indent} <= {font} * 5 and {ratio} <= 1.45D
        and (p.type = 'paragraph' and x.type = 'paragraph'
            or (p.type = 'paragraph' and x.type = 'heading' or p.type = 'heading' and x.type = 'paragraph')
                and not {heading_text} rlike {_regex(HEADING_START)}))"""
    return f"coalesce(p.col_ix <=> x.col_ix and ({strict} or {loose}), false)"


def block_lines(units: DataFrame) -> DataFrame:
    """One row per block: ``block_ix`` (from 1) and its lines (``lines``), cut where a line does not continue the block."""
    rest = [c for c in units.columns if c not in ("lines", "order")]
    df = _with(units, lines=_full_lines(units)).drop("order")
    df = _with(df, _at=_starts("lines", _pair("lines", f"not {_merges()}")))
    df = _with(df, _blocks=_slices("lines", "_at"))
    return df.select(*rest, F.posexplode("_blocks").alias("_at", "lines")).select(
        *rest, (F.col("_at") + 1).cast("bigint").alias("block_ix"), "lines"
    )


def block_box(p: str) -> list:
    """Columns of the box around the lines of a block."""
    return [F.expr(v).alias(n) for n, v in _box("lines", p).items()]
