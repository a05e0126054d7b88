import random

from pyspark.sql import functions as F

from glossa.operators.layout import blocks as B
from glossa.operators.layout import geometry as G
from glossa.operators.layout import lines as N
from glossa.operators.layout import rows as R
from glossa.plans import layout as P
from glossa.schemas import FONT_STYLES, PAGE_VIEWS, TEXT_ITEMS


def run(page, ix, text, x, y, size=10.0, width=None, turn=0, font="F", eol=False, doc=1):
    """A run whose box has its top at y (upright) on a 600 x 800 page."""
    base = 800.0 - (y + 0.8 * size)
    matrix = [size, 0.0, 0.0, size, float(x), base] if turn == 0 else [0.0, size, -size, 0.0, float(x), 800.0 - y]
    return (doc, page, ix, text, "ltr", font, eol, float(width or 5 * len(text)), size, matrix)


def tables(spark, runs, rotation=0, transform=True):
    items = spark.createDataFrame(runs, TEXT_ITEMS)
    matrix = [1.0, 0.0, 0.0, -1.0, 0.0, 800.0] if transform else None
    pages = sorted({(r[0], r[1]) for r in runs})
    views = spark.createDataFrame([(d, p, 600.0, 800.0, rotation, matrix, None) for d, p in pages], PAGE_VIEWS)
    fonts = spark.createDataFrame([(1, "B", 0.8, -0.2, "Sans-Bold", "", ""), (1, "I", 0.8, -0.2, "Sans", "", "oblique")], FONT_STYLES)
    return items, views, fonts


def brute_rows(boxes):
    """Greedy row clustering, one item after the other."""
    ordered, band = [], 0
    by_y = sorted(boxes, key=lambda b: b[1])
    for i, b in enumerate(by_y):
        band += i > 0 and b[1] - by_y[i - 1][1] > 0.5
        ordered.append((band, b[0], b[3], b))
    bands = []
    for _, _, ix, (x, y, h, _, font) in sorted(ordered, key=lambda t: t[:3]):
        best, near = None, float("inf")
        for k in range(max(0, len(bands) - 6), len(bands)):
            t, bh, fonts, _ = bands[k]
            fs = sorted(fonts)
            mid = (fs[(len(fs) - 1) // 2] + fs[len(fs) // 2]) / 2
            far = abs(y + h / 2 - (t + bh / 2))
            over = max(0.0, min(y + h, t + bh) - max(y, t)) / max(1.0, min(h, bh))
            if (far <= max(2.0, min(font, mid) * 0.48) or over >= 0.45) and far < near:
                best, near = k, far
        if best is None:
            bands.append([y, h, [font], [ix]])
        else:
            t, bh, fonts, ids = bands[best]
            top, low = min(t, y), max(t + bh, y + h)
            bands[best] = [top, round(low - top, 3), [*fonts, font], [*ids, ix]]
    ranked = sorted(range(len(bands)), key=lambda k: (bands[k][0], k))
    return {ix: rank for rank, k in enumerate(ranked) for ix in bands[k][3]}


def test_row_bands_equal_brute_force(spark):
    rng = random.Random(11)
    pages, rows = {}, []
    for page in range(25):
        boxes = []
        for ix in range(rng.randint(1, 40)):
            font = rng.choice([6.0, 8.0, 10.0, 24.0])
            boxes.append((float(rng.randint(0, 500)), round(rng.uniform(0, 250), 1), font * 1.0, ix, font))
        pages[page] = brute_rows(boxes)
        rows += [(1, page, 0, ix, x, y, h, f) for x, y, h, ix, f in boxes]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, quarter int, item_ix int, lx double, ly double, lh double, font_size double")
    got = {}
    for r in R.row_bands(df).collect():
        got.setdefault(r.page_no, {})[r.item_ix] = r.row_ix
    assert got == pages


def test_geometry_of_turned_and_unframed_runs(spark):
    runs = [run(1, 0, "upright", 50, 100), run(1, 1, "turned up", 300, 400, turn=1), run(1, 2, " \t", 5, 5)]
    for transform in (True, False):
        got = {r.item_ix: r for r in G.item_geometry(*tables(spark, runs, transform=transform)).collect()}
        assert set(got) == {0, 1}
        assert (got[0].bx, got[0].by, got[0].bw, got[0].bh, got[0].quarter) == (50.0, 100.0, 35.0, 10.0, 0)
        assert (got[1].bx, got[1].by, got[1].bw, got[1].bh, got[1].quarter) == (292.0, 355.0, 10.0, 45.0, 3)


def blocks(spark, runs, **kw):
    items, views, fonts = tables(spark, runs, **kw)
    return P.page_blocks(items, views, fonts).orderBy("page_no", "block_no").collect()


def paragraph(page, start, x, y, n, text="words of a plain body line here", **kw):
    return [run(page, start + i, text, x, y + 12 * i, **kw) for i in range(n)]


def test_tables_captions_and_fonts(spark):
    cells = [run(1, 10 * r + c, f"cell{r}{c}", 60 + 180 * c, 300 + 14 * r) for r in range(3) for c in range(3)]
    caption = [run(1, 50, "Figure 2: a drawing of the", 60, 400), run(1, 51, "machine in its case", 60, 411)]
    title = [run(1, 60, "A large title", 60, 80, size=20.0)]
    body = paragraph(1, 70, 60, 500, 4)
    got = {b.type: b.text for b in blocks(spark, cells + caption + title + body)}
    assert got["table"] == "\n".join("\t".join(f"cell{r}{c}" for c in range(3)) for r in range(3))
    assert got["caption"] == "Figure 2: a drawing of the machine in its case"
    assert got["heading"] == "A large title"
    assert got["paragraph"] == " ".join(["words of a plain body line here"] * 4)


def test_two_columns_with_a_spanning_heading(spark):
    left, right = paragraph(1, 0, 50, 100, 12, "left column body text line of words"), paragraph(1, 100, 330, 100, 12, "right column body text line of words")
    heading = [run(1, 300, "1 Introduction that reaches over both of the columns on the page", 50, 70, width=500)]
    late = [run(1, 301, "2 Results that reach over both of the columns on the page", 50, 260, width=500)]
    more = paragraph(1, 400, 50, 300, 3, "left again with a line of words") + paragraph(1, 500, 330, 300, 3, "right again with a line of words")
    got = [(b.type, b.text.split()[0], b.col_ix) for b in blocks(spark, left + right + heading + late + more)]
    assert got == [
        ("heading", "1", None), ("paragraph", "left", 0), ("paragraph", "right", 1),
        ("heading", "2", None), ("paragraph", "left", 0), ("paragraph", "right", 1),
    ]


def test_turned_side_text_and_margin_artefacts(spark):
    body = paragraph(1, 0, 100, 100, 10)
    side = [run(1, 50, "turned note beside the body", 450, 500, turn=1)]
    margin = [run(1, 51, "arXiv stamp in the margin", 30, 500, turn=1)]
    got = blocks(spark, body + side + margin)
    assert [(b.type, b.reading_orientation) for b in got] == [("paragraph", 0), ("rotated_text", 270)]
    items, views, fonts = tables(spark, body + side + margin)
    verdict = B.page_verdict(P.analyze_pages(items, views, fonts), views).first()
    assert (verdict.n_ignored, verdict.page_type, verdict.reading_orientation) == (1, "text", 0)


def test_scanned_pages(spark):
    runs = [run(1, 0, "elevenchars", 50, 100), run(2, 0, "twelve chars1", 50, 100), run(3, 0, "fullstopsonlyhere", 50, 100, size=1.0, width=5)]
    items, views, fonts = tables(spark, runs)
    views = views.unionByName(views.limit(1).withColumn("page_no", F.lit(9)))
    got = {r.page_no: (r.page_type, r.scan_reason) for r in B.page_verdict(P.analyze_pages(items, views, fonts), views).collect()}
    assert got == {1: ("scanned", "sparse_text"), 2: ("text", None), 3: ("scanned", "sparse_text"), 9: ("scanned", "no_text")}
    summary = B.document_summary(views, P.page_blocks(items, views, fonts, drop_invalid=False)).first()
    assert (summary.n_pages, summary.n_text_pages, summary.scan_class) == (4, 1, "some")


def test_references_hang_and_paragraphs_indent(spark):
    refs = []
    for k in range(3):
        refs.append(run(1, 10 * k, f"[{k + 1}] Author and title of a work", 60, 100 + 36 * k, width=400))
        refs += [run(1, 10 * k + i, "continued with more words", 80, 100 + 36 * k + 12 * i, width=380) for i in (1, 2)]
    body = paragraph(1, 100, 60, 400, 2, width=420) + [run(1, 109, "and it ends here.", 60, 424, width=90), run(1, 110, "Indented start of the next part", 80, 436, width=400)] + paragraph(1, 120, 60, 448, 3, width=420)
    items, views, fonts = tables(spark, refs + body)
    lines = P.analyze_pages(items, views, fonts).orderBy("order_ix").collect()
    assert [r.text.split()[0] for r in lines if r.paragraph_start] == ["[1]", "[2]", "[3]", "Indented"]


def test_every_run_ends_in_one_block(spark, small):
    from glossa.sources import items as I

    docs = spark.read.parquet(f"{small}/documents.parquet").filter("doc_id < 40")
    items = I.items_from_documents(docs)
    lines = N.assemble_lines(P.segmented_items(P.prepared_items(items, I.views_from_items(items), I.styles_from_documents(docs))))
    cleaned = items.filter("trim(str) <> ''").count()
    assert lines.agg(F.sum("n_items")).first()[0] == cleaned


def test_missing_matrix_maps_the_view_box_onto_the_page(spark):
    """The corner of the box that a clockwise turn brings to the page's top left is its origin, the opposite one its end."""
    box, w, h = [30.0, -20.0, 630.0, 380.0], 500.0, 700.0
    left, bottom, right, top = box
    first = {0: (left, top), 90: (left, bottom), 180: (right, bottom), 270: (right, top)}
    last = {0: (right, bottom), 90: (right, top), 180: (left, top), 270: (left, bottom)}
    views = spark.createDataFrame([(1, rot, w, h, rot, None, box) for rot in first], PAGE_VIEWS)
    for r in G.page_frames(views).collect():
        a, b, c, d, e, f = r.page.matrix
        at = lambda x, y: (round(a * x + c * y + e, 6), round(b * x + d * y + f, 6))  # noqa: E731, B023
        assert at(*first[r.page_no]) == (0, 0) and at(*last[r.page_no]) == (w, h)


def test_pages_are_shared_by_tasks_according_to_the_number_of_runs(spark, small, monkeypatch):
    """A task of the layout plan holds a bounded number of runs (pages are not split), however small they compress."""
    from glossa.sources import items as I

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = I.items_from_documents(docs)
    inputs = items, I.views_from_items(items), I.styles_from_documents(docs)
    runs = items.count()
    monkeypatch.setattr(P, "RUNS_PER_TASK", 500)
    found = P.prepared_items(*inputs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in found) == items.filter("trim(str) <> ''").count()
    assert max(r["count"] for r in found) <= 4 * 500 and len(found) >= runs / 1000
    assert [P.tasks_for(n, 8) for n in (0, 9_000, 25_000, 10**6, 500 * 50)] == [1, 18, 50, 2_000, 50]


def test_the_plan_sorts_pages_not_lines(spark, small):
    """Steps after the boxes are array expressions: only page orientation takes windows, however many steps follow."""
    from glossa.sources import items as I

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = I.items_from_documents(docs)
    lines = P.analyze_pages(items, I.views_from_items(items), I.styles_from_documents(docs))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3


def random_runs(rng, pages):
    """Cells of several rows, sizes, gaps and directions, some of them tables."""
    runs = []
    for page in range(pages):
        y = 60
        for row in range(rng.randint(1, 14)):
            x = 50
            for cell in range(rng.choice([1, 2, 3, 3, 4])):
                text = rng.choice(["words", "cell", "(3)", "Figure 1: x", "[2] Ref", "1.2 Heading", "a", "end."])
                wide = rng.choice([10, 40, 200])
                runs.append(run(page, 10 * row + cell, text, x, y + rng.choice([0, 0, 0.3]), size=rng.choice([8.0, 10.0, 14.0]), width=wide, eol=rng.random() < 0.1))
                x += wide + rng.choice([1, 3, 60, 70])
            y += rng.choice([6, 14, 14, 30])
    return runs


def test_units_give_the_lines_of_the_row_operators(spark):
    from glossa.operators.layout import columns as C
    from glossa.operators.layout import units as U

    prepared = P.prepared_items(*tables(spark, random_runs(random.Random(5), 40))).cache()
    rows = C.detect_columns(N.classify_lines(N.mark_table_rows(N.assemble_lines(P.segmented_items(prepared)))))
    kept = ["page_no", "quarter", "line_ix", "row_ix", "seg_ix", "row_segments", "text", "type", "is_table", "lx", "ly", "lw", "lh",
            "bx", "by", "bw", "bh", "font_size", "is_bold", "n_items", "item_valid", "gutter_lane", "gutter_rows", "columns"]
    want = sorted(map(str, rows.select(*kept).collect()))
    assert sorted(map(str, U.line_rows(P.first_units(prepared)).select(*kept).collect())) == want
    assert any("is_table=True" in r for r in want)
