from pathlib import Path

from pyspark.sql import functions as F

from glossa.sources import export
from glossa.sources.files import intake_files


def test_intake(spark, tmp_path):
    files = {
        "ok.pdf": b"%PDF-1.7 body",
        "late.pdf": b" " * 1019 + b"%PDF-",
        "too_late.pdf": b" " * 1020 + b"%PDF-",
        "empty.pdf": b"",
        "none.pdf": b"plain",
        "note.txt": b"%PDF-1.7",
        "big.pdf": b"%PDF-" + b"x" * 5000,
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {Path(r.path).name: r.code for r in intake_files(spark, str(tmp_path), max_bytes=4000).collect()}
    assert got == {
        "ok.pdf": None, "late.pdf": None, "too_late.pdf": "INVALID_PDF_SIGNATURE", "empty.pdf": "EMPTY_FILE",
        "none.pdf": "INVALID_PDF_SIGNATURE", "note.txt": "INVALID_FILE_TYPE", "big.pdf": "FILE_TOO_LARGE",
    }


def test_export_escapes_and_marks(spark, tmp_path):
    documents = spark.createDataFrame([(1, 'a<b>:"x".pdf'), (2, None)], "doc_id int, file_name string")
    pages = spark.createDataFrame([(1, 1, "text"), (1, 2, "scanned")], "doc_id int, page_no int, page_type string")
    pairs = spark.createDataFrame(
        [(1, 1, 1, "p1", "<b> & 'q'", None), (1, 1, 0, "p0", "x", "y")],
        "doc_id int, page_no int, block_ix int, block_id string, source string, target string",
    )
    fragments = export.document_fragments(documents, pages, pairs, "now")
    html = {r.doc_id: r.html for r in export.whole_documents(fragments).collect()}
    assert "&lt;b&gt; &amp; &#39;q&#39;" in html[1] and "<b>" not in html[1]
    assert html[1].index('data-block="p0"') < html[1].index('data-block="p1"')
    assert "not translated yet" in html[1] and "no text on this page" in html[1] and "no pages" in html[2]
    assert "<script" not in html[1]
    export.write_bilingual_html(fragments, documents, str(tmp_path / "out"))
    written = spark.read.text(str(tmp_path / "out"))
    assert {r.document for r in written.select("document").distinct().collect()} == {"1-a-b---x-.pdf", "2-document.html"}


def test_request_lines(spark, tmp_path):
    df = spark.range(3).select(F.to_json(F.struct("id")).alias("payload"))
    export.write_requests_jsonl(df, str(tmp_path / "requests"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "requests")).collect()) == [0, 1, 2]
