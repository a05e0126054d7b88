import hashlib
import re

from glossa.llm import exact


def brute(rows):
    groups = {}
    for r in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()
        groups.setdefault(key, []).append(r.doc_id)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return {key: (least(ids), len(ids), sorted(map(str, ids))) for key, ids in groups.items()}


def check(df, **options):
    want, got = brute(df.collect()), {}
    for r in exact.mark_copies(df, **options).collect():
        got.setdefault(r.text_sha256, []).append(r)
    assert got.keys() == want.keys()
    for key, rows in got.items():
        keep, size, ids = want[key]
        assert sorted(str(r.doc_id) for r in rows) == ids
        assert {(r.keep_id, r.group_size) for r in rows} == {(keep, size)}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_edges(edges):
    check(edges)
    check(edges, candidates=1, tracked=8)  # the rest goes through the ordinary shuffle


def test_documents(documents):
    check(documents)


def test_heavy_group(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'copied  text', concat('own ', id)) AS text")
    prints = rows.select("doc_id", exact.digest(rows["text"]).alias("digest"))
    heavy = exact.winners(prints, 16, 64).collect()
    assert [(r.keep_id, r.group_size) for r in heavy] == [(0, 1000)]
    check(rows)


def test_repeated_rows(spark):
    """A third of the rows repeat one id and one text, another group repeats a null id."""
    kind = "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 30 = 1 THEN 1 ELSE id END"
    rows = spark.range(3000).selectExpr(f"nullif({kind}, 1) AS doc_id", f"concat('text ', {kind}) AS text").repartition(7)
    check(rows, candidates=16, tracked=64)
    kept = exact.drop_copies(rows, candidates=16, tracked=64)
    assert kept.count() == kept.select("text").distinct().count() == rows.select("text").distinct().count()
    heavy = exact.winners(rows.select("doc_id", exact.digest(rows["text"]).alias("digest")), 16, 64)
    assert {(r.keep_id, r.group_size) for r in heavy.collect()} == {(0, 1000), (None, 100)}


def test_stage_keeps_rows_whole(edges):
    kept = exact.drop_copies(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len(brute(edges.collect()))
    assert {r.kept for r in kept.collect()} == {"mine"}


def test_nothing(nothing):
    assert exact.mark_copies(nothing).count() == 0
    assert exact.drop_copies(nothing).count() == 0
