import random

import pytest
from pyspark.sql import functions as F

from glossa.functions.text import trim_space, utf8_bytes, utf16_units
from glossa.operators import text as T
from glossa.sources.corpus import visible_text


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_scripts_and_languages(spark):
    cases = [
        ("これは日本語のテキストです", "ja"),
        ("日本語研究発表会開催案内文書概要は", ""),
        ("漢字の", "ja"),
        ("漢字漢字", ""),
        ("Привет, мир", "ru"),
        ("Привет абвгдежз word", "ru"),
        ("Привет a long english sentence follows here", ""),
        ("한국어 text", ""),
        ("12345 !?", ""),
        ("", ""),
        ("Plain English, été", "en"),
    ]
    got = column(T.detect_language(T.script_profile(texts(spark, [c[0] for c in cases]))), "detected")
    assert got == [c[1] for c in cases]


def test_whitespace_rules(spark):
    raw = ["a b", "a \t\nb", "a\n\n\n\nb", "　﻿a ", "\u000ba b\u0085"]
    assert column(T.normalize_text(texts(spark, raw)), "norm_text") == ["a b", "a\nb", "a\n\nb", "a", "a b\u0085"]
    items = texts(spark, ["a\u0000b", " \t ", "x\r\n y"]).withColumnRenamed("text", "str")
    assert [r["str"] for r in T.sanitize_items(items).orderBy("doc_id").collect()] == ["ab", "x y"]


def test_counting_beyond_the_basic_plane(spark):
    df = texts(spark, ["a😀é", "漢", ""]).select(
        "doc_id", F.length("text").alias("p"), utf16_units(F.col("text")).alias("u"), utf8_bytes(F.col("text")).alias("b")
    )
    assert [(r.p, r.u, r.b) for r in df.orderBy("doc_id").collect()] == [(3, 4, 7), (1, 1, 3), (0, 0, 0)]


def test_limits_count_units(spark):
    df = T.validate_requests(texts(spark, ["😀" * 6, "a" * 10, "a" * 11, " 　", None]), 10)
    assert column(df, "error_code") == ["TEXT_TOO_LONG", None, "TEXT_TOO_LONG", "INVALID_TEXT", "INVALID_TEXT"]


def test_words_and_paragraphs(spark):
    cases = [("one two three", "word"), ("one two three four", "paragraph"), ("one.", "paragraph"), ("a" * 81, "paragraph")]
    assert column(T.classify_content(texts(spark, [c[0] for c in cases])), "content_type") == [c[1] for c in cases]


def test_unwrapping(spark):
    cases = [
        ("trans-\nlation", "translation"),
        ("trans-\nLation", "trans- Lation"),
        ("漢字\n仮名", "漢字仮名"),
        ("see (\nbelow", "see (below"),
        ("end\n, more", "end, more"),
        ("a\n\n b ", "a b"),
        ("", ""),
    ]
    assert column(T.unwrap_lines(texts(spark, [c[0] for c in cases])), "unwrapped") == [c[1] for c in cases]


def brute_chunks(text, limit):
    """Straight restatement of the cutting rule."""
    space = set(T.trim_space.__globals__["SPACE_CHARS"])
    strip = "".join(space)
    out, rest, low = [], text, int(limit * 0.55)
    while len(rest) > limit:
        cut = next(
            (
                i
                for i in range(limit, low - 1, -1)
                if rest[i - 1] in space or (rest[i - 1] in ".!?;:。！？；" and rest[i] in space)
            ),
            limit,
        )
        out.append(rest[:cut].strip(strip))
        rest = rest[cut:].lstrip(strip)
    out.append(rest.strip(strip))
    return [c for c in out if c]


@pytest.mark.parametrize("limit", [7, 20, 61])
def test_chunking_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    raw = ["".join(rng.choice("ab. ;\n　。x") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    raw += ["x" * limit, "x" * (limit + 1), " " * 50, "x" * (3 * limit)]
    got = {}
    for r in T.chunk_text(texts(spark, raw), limit).orderBy("doc_id", "continuation_ix").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: c for i, t in enumerate(raw) if (c := brute_chunks(t, limit))}


def test_batches_report_the_first_fault(spark):
    rows = [("b1", 0, "x", "ok"), ("b1", 1, "x", "dup"), ("b2", 0, "-x", " "), ("b3", 0, "y", "　"),
            ("b4", 0, "y", "aaaa"), ("b4", 1, "z", "aaaa"), ("b5", 0, "y", "ééé"), ("b6", 0, "n" * 101, "a"),
            *[("b7", i, f"i{i}", "a") for i in range(3)], ("b8", 0, "y", "ok")]
    df = spark.createDataFrame(rows, "batch_id string, block_ix int, block_id string, text string")
    got = {r.batch_id: r.error_code for r in T.validate_batches(df, 2, 7, 5).collect()}
    assert got == {
        "b1": "DUPLICATE_BLOCK_ID", "b2": "BLOCK_ID_INVALID", "b3": "BLOCK_TEXT_INVALID", "b4": "BATCH_TEXT_TOO_LONG",
        "b5": "BATCH_UTF8_TOO_LARGE", "b6": "BLOCK_ID_INVALID", "b7": "BLOCKS_INVALID", "b8": None,
    }


def test_trim_is_total(spark):
    df = texts(spark, ["﻿  x "]).select(trim_space(F.col("text")).alias("t"))
    assert df.first().t == "x"


def test_entities_and_editable_regions(spark):
    cases = {
        "caf&#233; &mdash; it&#x2019;s &copy; &amp;lt; &#38;gt; &bogus; &#xD800; a&nbsp;b": "café — it’s © &lt; &gt; &bogus; &#xD800; a b",
        "x<div contenteditable><p>edit</p></div>y": "xy",
        '<p contenteditable="false">stays</p><span class="a" contenteditable=\'true\'>goes</span>': "stays",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    got = {r.html: r.text for r in df.select("html", visible_text(df["html"]).alias("text")).collect()}
    assert {k: v.strip() for k, v in got.items()} == cases


def test_null_groups_are_not_all(spark):
    df = spark.createDataFrame([(None, None, "en"), ("de", "s", "")], "lang string, source string, detected string")
    got = {(r.level, r.name): r.n_docs for r in T.language_audit(df).collect()}
    assert got == {("lang", None): 1, ("lang", "de"): 1, ("source", None): 1, ("source", "s"): 1, ("all", "all"): 2}
