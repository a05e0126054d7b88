import re

from glossa.llm import licenses

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in BASE.items():
        own = phrase.split()
        found = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(df):
    got = licenses.scan(df).collect()
    key = lambda x: str(x)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in got)
    return {r.doc_id: r for r in got}


def test_edges(edges):
    check(edges)


def test_phrases(spark):
    texts = [
        "Under the MIT license, under the-mit LICENSE; cc-by-nc by nc cc by nc",
        "mit license under the",
        "Apache License, Version 2.0 apache Apache License version 2",
        "This work is licensed under the GNU General Public License, version 3.",
        "Permission is hereby granted, free of charge, to any person",
        "ünder the mit license éunder the mit licenseé",
        "cc by nc",
        "the " * 30_000 + "cc by nc",
    ]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    assert got[3].labels == "gpl-3" and got[3].base_labels == ""
    assert got[4].labels == "mit" and 0 < got[4].score < 1
    assert got[0].n_base == 4


def test_scattered_words_do_not_hide_a_phrase(spark):
    """Rarer words of the template elsewhere in the file leave the phrase its label."""
    texts = ["mozilla public license"] * 5 + ["subject x to x x terms x of x v x x 2 x x x 0 x mozilla public license", "public x license mozilla"]
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2))
    assert [got[i].labels for i in range(7)] == ["mpl-2"] * 6 + [""]


def test_documents(documents):
    check(documents)


def test_nothing(nothing):
    assert licenses.scan(nothing).count() == 0
