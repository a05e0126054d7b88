import hashlib
import random
from collections import Counter

from glossa.llm import suffix


def brute(texts, length):
    """Mask of the bytes to be removed of each text."""
    raws = [(t or "").encode() for t in texts]
    often = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    masks = []
    for raw in raws:
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if often[raw[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        masks.append(mask)
    return raws, masks


def check(df, length=400, **options):
    rows = df.collect()
    want = []
    for r, raw, mask in zip(rows, *brute([r.text for r in rows], length), strict=True):
        kept = bytes(b for b, gone in zip(raw, mask, strict=True) if not gone)
        runs = sum(gone and not (i and mask[i - 1]) for i, gone in enumerate(mask))
        want.append((r.doc_id, len(raw), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix.removal_digests(df, length=length, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return sum(w[2] for w in want)


def test_edges(edges):
    assert check(edges) > 0
    cut = suffix.cut_repeats(edges)
    assert cut.columns == edges.columns and cut.count() == edges.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[4] is None and texts[5] == "" and texts[8] == "one two"


def test_passages(spark):
    """Shared passages at various places, a crowd around one anchor, and a periodic text."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(60)) for _ in range(3)]
    texts = []
    for i in range(60):
        parts = ["".join(word() for _ in range(rnd.randint(0, 40)))]
        for p in rnd.sample(passages, rnd.randint(0, 2)):
            a = rnd.randint(0, 60)
            parts += [p[a : a + rnd.randint(60, 300)], "".join(word() for _ in range(rnd.randint(0, 30)))]
        texts.append("".join(parts))
    texts += ["xyz" * 120, "xyz" * 60 + "w", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    removed = check(df, length=90, gram=12, group=8)
    assert check(df, length=90, gram=12, group=8, crowd=2) == removed > 0


def test_repeated_rows_gather_one_set_of_ranges(spark):
    """However often a row is repeated, what is gathered for its id and text stays as it is."""
    rnd = random.Random(8)
    passage, other = ("".join(rnd.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    for copies in (1, 30):
        rows = [(1, passage + other)] * copies + [(None, passage)] * copies + [(3, passage), (4, other + passage)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert check(df, length=90, gram=12, group=8) > 0
        gathered = suffix.covered(suffix._keyed(df, "doc_id", "text"), length=90, gram=12, group=8).collect()
        assert gathered and all(len(r.covered) == len({(x["from"], x["to"]) for x in r.covered}) for r in gathered)


def test_expansion():
    rnd = random.Random(5)
    for trial in range(120):
        base = bytes(rnd.choice(b"ab" if trial % 2 else b"abcdefgh ") for _ in range(60))
        texts = []
        for _ in range(rnd.randint(1, 7)):
            a = rnd.randint(0, 40)
            texts.append(base[a : a + rnd.randint(0, 60)] + bytes(rnd.choice(b"abz\x00\xff") for _ in range(rnd.randint(0, 20))))
        length = rnd.choice([3, 5, 9, 16])
        often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if often[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in suffix.repeated_windows(texts, length)] == want


def test_expansion_of_many_pairs():
    """Hundreds of pairs with shared strings of all lengths around the bound; the number of tasks follows the bytes."""
    rnd = random.Random(6)
    texts = []
    for i in range(300):
        own = bytes(rnd.choice(b"abcd") for _ in range(140))
        at = rnd.randrange(20, 120)
        texts += [own, own[:at] + b"#" + own[at + 1 :]]
    often = Counter(w for t in texts for w in {t[i : i + 60] for i in range(81)})
    got = suffix.repeated_windows(texts, 60)
    assert [x.tolist() for x in got] == [[i for i in range(81) if often[t[i : i + 60]] > 1] for t in texts]
    assert sum(map(len, got)) > 5_000


def test_tasks_of_the_expansion_follow_their_text(spark):
    contexts = spark.createDataFrame([(i, 1, 0, b"x" * 500) for i in range(40)], "anchor long, print long, start long, bytes binary")
    tasks = suffix._expanded(contexts, 400, 9).selectExpr("spark_partition_id() AS task").distinct().collect()
    assert 1 < len(tasks) <= 9


def test_documents(documents):
    assert check(documents) > 0


def test_planted_lengths(spark):
    """Passages of 400 bytes and more go with all their bytes, shorter ones stay, whatever their words."""
    rnd = random.Random(11)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    short = " ".join("".join(rnd.choice("xyz") for _ in range(5)) for _ in range(51))
    long = " ".join("".join(rnd.choice("xyz") for _ in range(9)) for _ in range(51))
    planted = [letters(300), letters(399), letters(400), letters(801), short, long]
    assert len(short) < 400 < len(long)
    rows = []
    for passage in planted:
        # The bytes around a passage differ from copy to copy, so that it repeats by itself only.
        rows += [f"{letters(150)}{before}{passage}{after}{letters(90)}" for before, after in (("1", "2"), ("3", "4"), ("5", "6"))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    check(df)
    removed = {r.doc_id: r.n_removed for r in suffix.removal_digests(df).collect()}
    for k, passage in enumerate(planted):
        assert {removed[3 * k + copy] for copy in range(3)} == {len(passage) if len(passage) >= 400 else 0}


def test_nothing(nothing):
    assert suffix.removal_digests(nothing).count() == 0
    assert suffix.cut_repeats(nothing).count() == 0
