import re
from collections import Counter, defaultdict

import numpy as np

from glossa.llm import jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def families(texts, percent=80):
    """Number of each text's component; texts without words are alone."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            holders[x].append(i)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def check(df, **options):
    rows = df.filter("doc_id is not null").orderBy("doc_id").collect()
    root, sizes = families([r.text for r in rows])
    want = sorted((r.doc_id, n, rows[i].doc_id if n else r.doc_id) for r, i, n in zip(rows, root, sizes, strict=True))
    got = sorted(tuple(r) for r in jaccard.near_duplicates(df.filter("doc_id is not null"), **options).collect())
    assert got == want
    return len({w[2] for w in want})


def test_edges(edges):
    check(edges)
    assert jaccard.near_duplicates(edges).filter("doc_id is null").count() == 2
    kept = jaccard.keep_one(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and {4, 5, 6} <= set(ids)


def test_documents(documents):
    check(documents)


def test_chains_and_crowds(spark):
    """Small cells and many frequent shingles: families of near copies, chains, and a passage all share."""
    rnd = np.random.default_rng(7)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(120)] + (passage if family % 2 else [])
        for _ in range(25):
            words = list(words)
            words[rnd.integers(0, 120)] = f"x{rnd.integers(0, 10**9)}"
            texts.append(" ".join(words))
    texts += [" ".join([*(f"s{i}w{k}" for k in range(30)), *passage]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    n = check(df, cell=8, frequent=3)
    assert n < len(texts)


def test_fewer_percent(spark):
    """Links between sets of unlike sizes, in large buckets and with unlike numbers of groups."""
    base = [f"w{k}" for k in range(900)]
    texts = [" ".join([*base[:n], *(f"t{n}x{k}" for k in range(n // 50))]) for n in range(150, 900, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for percent in (30, 55, 80):
        want = brute_links(texts, percent)
        got = {r.doc_id: r.n_links for r in jaccard.link_counts(df, percent=percent, cell=2, frequent=3).collect()}
        assert got == want and sum(want.values()) > 0


def brute_links(texts, percent=80):
    sets = [shingles(t) for t in texts]
    linked = lambda s, t: bool(s and t) and 100 * len(s & t) >= percent * len(s | t)
    return {i: sum(linked(s, t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)}


def test_all_links(spark, edges):
    """Links within a family count each, also where the components need only a few."""
    rnd = np.random.default_rng(3)
    texts = [None, "", "one"]
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(120)]
        for _ in range(12):
            words = list(words)
            words[rnd.integers(0, 120)] = f"x{rnd.integers(0, 10**9)}"
            texts.append(" ".join(words))
    texts += texts[-2:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_links(texts)
    assert max(want.values()) > 2
    assert {r.doc_id: r.n_links for r in jaccard.link_counts(df, cell=8, frequent=3).collect()} == want
    rows = edges.collect()
    counts = brute_links([r.text for r in rows])
    assert sorted((str(r.doc_id), r.n_links) for r in jaccard.link_counts(edges).collect()) == sorted((str(r.doc_id), counts[i]) for i, r in enumerate(rows))


def crowd(family, words=120, changed=18):
    """Near copies of one text, at a similarity around the threshold, that share most of their frequent shingles."""
    rnd = np.random.default_rng(family)
    base = [f"w{k}" for k in range(words)]
    texts = []
    for i in range(family):
        own, at = list(base), rnd.integers(0, words - 8)
        for k in range(at, at + rnd.integers(1, changed)):
            own[k % words] = f"x{i}y{k}"
        texts.append(" ".join(own))
    return texts


def test_buckets_of_a_crowd_are_one(spark):
    """A large family is compared once, not once for each shingle that it shares, and its pairs don't come out."""
    rows = {}
    for family in (60, 120):
        texts = crowd(family)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        keyed = jaccard._keyed(df, "doc_id", "text")
        _, buckets, active = jaccard._routed(keyed, 5, 80, 3)
        small, large = jaccard._parted(buckets, 16)
        before = buckets.groupBy("bucket").count().filter("count > 16").count()
        assert before >= 10 and large.select("bucket").distinct().count() <= before // 5
        assert small.groupBy("bucket").count().filter("count > 16").count() == 0
        # Every pair of classes that met still meets.
        pairs = lambda b: {tuple(r) for r in b.alias("x").join(b.alias("y"), "bucket").selectExpr("x.cls", "y.cls").collect()}
        assert pairs(buckets) <= pairs(small) | pairs(large)
        texts_of = jaccard._texts_of(keyed, active, jaccard._wanted(spark.createDataFrame([], "a long, b long"), large))
        cells, sets = jaccard._cells(large, active, 16, 80), jaccard._sets(texts_of, 5)
        rows[family] = cells.count()
        links = jaccard._crowd_links(cells, sets, 80, all_links=False).count()
        every = jaccard._crowd_links(cells, sets, 80, all_links=True).count()
        assert links <= rows[family] and links < every
        assert check(df, cell=16, frequent=3) < family
    assert rows[120] <= 120 * 5 and rows[60] <= 60 * 3


def test_overlaps_and_spanning():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))).astype(np.uint64) for _ in range(50)]
    q, p = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(q, p, strict=True)]
    # A set's overlap with itself isn't asked for: shingles that one set holds alone are left out.
    other = q != p
    for columns in (64, 100, 8192):
        got = jaccard.overlaps(sets, q, p, columns=columns, block=37)
        assert (got[other] == np.array(want)[other]).all()
    for _ in range(50):
        n = rng.integers(1, 40)
        a, b = rng.integers(0, n, (2, rng.integers(0, 80)))
        some = jaccard.spanning(a, b, n)
        assert len(some) < n
        assert groups(a, b, n) == groups(a[some], b[some], n)


def groups(a, b, n):
    root = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        low, high = sorted((root[x], root[y]))
        root = [low if r == high else r for r in root]
    return root


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m, k = rng.integers(1, 60, 2)
        base = rng.poisson(2, (6, 64))
        a, b = (base[rng.integers(0, 6, x)] + rng.poisson(0.1, (x, 64)) for x in (m, k))
        na, nb = a.sum(1), b.sum(1)
        q, p, bound = jaccard.tree_join(na, a, b, nb, 80)
        overlap = np.minimum(b[:, None], a[None]).sum(2)
        want = overlap >= jaccard.needed_overlap(nb[:, None], na[None], 80)
        got = np.zeros_like(want)
        got[q, p] = True
        fits = (5 * np.minimum(nb[:, None], na[None]) >= 4 * np.maximum(nb[:, None], na[None]))
        assert (got == (want & fits)).all() and (overlap[q, p] == bound).all()


def test_nothing(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0
    assert jaccard.keep_one(nothing).count() == 0
