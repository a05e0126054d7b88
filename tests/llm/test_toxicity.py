import random
import zlib

from glossa.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, 0), (None, 1, 1), (7, 1, None)], LABELS)
    got = toxicity.judge(edges, labels).collect()
    assert len(got) == edges.count()
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    kept = toxicity.drop_toxic(edges, labels)
    assert kept.columns == edges.columns and {r.score for r in kept.collect()} == {"s"}


def test_held_out_accuracy(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioubdfgklmnprst") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(1500):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        toxic = int(rnd.random() < 0.2)
        for _ in range(rnd.randint(1, 3) * toxic):
            own.insert(rnd.randint(0, len(own)), rnd.choice(["Zwxqual", "zwxqued!", "xyvorty"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    truth = {i: t for i, _, t in labels}
    got = [r for r in toxicity.judge(docs, known).collect() if r.held_out]
    assert len(got) > 300
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    # Rows that are held out teach nothing: other labels there give the same scores.
    flipped = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in labels], LABELS)
    again = {r.doc_id: r.score for r in toxicity.judge(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_windows_are_of_characters():
    """As many windows for a word of any script, with no character cut apart."""
    for word in ("abcdef", "абвгде", "字漢文本章句"):
        grams = [f" {word} "[i : i + n] for n in toxicity.LENGTHS for i in range(len(word) + 3 - n)]
        got = toxicity.buckets(word)
        assert len(got) == len(grams) == len(set(got.tolist()))
    # Windows of the same characters are the same, others are not.
    shared = set(toxicity.buckets("абвгд").tolist()) & set(toxicity.buckets("абвгж").tolist())
    assert len(shared) == 3 + 2 + 1
    assert not set(toxicity.buckets("а").tolist()) & set(toxicity.buckets("б").tolist())


def test_sample_bounds_repeated_rows(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[0], "same")] * 40 + [(ids[1], f"text {k}") for k in range(40)] + [(ids[2], None), (ids[2], None), (ids[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, 1, 0) for i in ids[:4]], LABELS)
    few = toxicity.training_rows(docs, known, "doc_id", "text", 10).collect()
    assert len(few) == len({(r.place, r.text) for r in few}) == 10
    every = toxicity.training_rows(docs, known, "doc_id", "text", 100).collect()
    assert sorted((r.text or "") for r in every) == sorted(["same", "", "x", *(f"text {k}" for k in range(40))])


def test_nothing(spark, nothing, documents):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.judge(nothing, none).count() == 0
    assert {r.predicted for r in toxicity.judge(documents.limit(20), none).collect()} == {0}
