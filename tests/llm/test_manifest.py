import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glossa.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes, arity):
    """(root, path of every node): the definition, run by run."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, owners = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for slot in range(len(run)):
                for i in members[at + slot]:
                    paths[i].append((run[:slot], run[slot + 1 :]))
            parents.append(sha(*run))
            owners.append(sum(members[at : at + arity], []))
        nodes, members = parents, owners
    return nodes[0], paths


def plain(rows, arity=3):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        changed = own
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        groups[source].append((doc_id is not None, doc_id or 0, own, changed, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(groups[s])], arity) for s in names}
    root, crown = tree([trees[s][0] for s in names], arity)
    out = []
    for s, upper in zip(names, crown, strict=True):
        for (_, _, own, changed, doc_id), path in zip(sorted(groups[s]), trees[s][1], strict=True):
            siblings = [d for before, after in path + upper for d in before + after]
            folded = changed
            for before, after in path + upper:
                folded = sha(*before, folded, *after)
            out.append((doc_id, own, trees[s][0], root, sha(*siblings), folded, folded == root))
    return sorted(out, key=str)


def result(df, arity=3, small=manifest.SMALL):
    return sorted((tuple(r) for r in manifest.audit(df, arity, small).collect()), key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_edges(edges, arity):
    assert result(edges, arity) == plain(rows_of(edges), arity)


def test_documents(documents):
    want = plain(rows_of(documents))
    assert result(documents) == want
    assert {r[6] for r in want} == {True, False}


def test_hot_group_and_repeated_rows(spark):
    rnd = random.Random(2)
    rows = [(7 if i % 3 == 0 else i, f"t\n{i % 5}", "en", rnd.choice(["hot", "hot", f"s{i % 11}", None]), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    for small in (0, 60, manifest.SMALL):  # all levels shuffled, some, none
        assert result(df, small=small) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    rows = [(i, "x\ny", None, "é" if i % 4 == 0 else "z", 3) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert result(df) == plain(rows)


def test_manifest_of_other_columns(spark):
    df = spark.range(20).selectExpr("id AS key", "id % 2 = 0 AS part", "'x' AS leaf", "1 AS root", "2 AS steps")
    found = manifest.manifest(df, F.col("part"), F.col("key"), manifest.leaf_digest(k=F.col("key")), {"key": F.col("key")}, 2)
    assert found.filter(manifest.fold(F.col("leaf"), F.col("steps")) == F.col("root")).count() == 20
    assert found.select("root").distinct().count() == 1


def test_nothing(nothing):
    assert manifest.audit(nothing).count() == 0


def test_estimated_sizes_do_not_multiply(spark):
    """Each level is two joins of the one below; with checkpoints the estimate of level n was of 3 ** n times the digits."""
    nodes = spark.range(500).selectExpr("'g' AS grp", "id AS at", "500L AS of", "sha2(CAST(id AS STRING), 256) AS digest")
    levels, _, _ = manifest._climb(manifest.written(nodes), 3, manifest.SMALL)
    assert len(levels) == 6
    assert max(x.nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() for x in levels) < 40
