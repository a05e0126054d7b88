import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from glossa.llm import bpe, jaccard, packing, suffix

PARTS = ["a", "b", "'", "s", "t", "er", "é", "É", "Σ", "ς", " ", "\n", "1", "²", "½", "中", "😀", "#", "$", "<|endoftext|>", "<|start", "İ", "ẞ", "the", "ing", "\x1c", "\x85", "é", "\x00", "_", "aaaa", "'ll", "​", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def lex():
    return bpe.lexicon(open(bpe.vocabulary_path(), encoding="utf-8").read())


def test_against_the_library(library, lex):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "#" * 3000, "ab" * 700, "<|endoftext|>" * 3]
    for packed, want in zip(lex.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(packed, lex.dtype).tolist()
        assert ids == want.ids
        assert lex.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pairs_are_compatible_just_if_merging_keeps_them(lex):
    rnd = random.Random(4)
    inner = [(i, p) for p, i in lex.pieces.items() if not p.endswith(bpe.WORD_END)]
    last = [(i, p) for p, i in lex.pieces.items()]
    pairs = [(rnd.choice(inner), rnd.choice(last)) for _ in range(4000)]
    good = lex.compatible(np.array([a[0] for a, _ in pairs]), np.array([b[0] for _, b in pairs]))
    forms = [a[1] + b[1] for a, b in pairs]
    raw = [f.removesuffix(bpe.WORD_END).encode("latin-1") for f in forms]
    symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    ends = np.cumsum([len(x) for x in raw])
    symbols[ends - 1] += 256 * np.array([f.endswith(bpe.WORD_END) for f in forms])
    merged = {}
    for rows, ids, counts in lex.merge(symbols, ends):
        merged |= dict(zip(rows.tolist(), [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], strict=True))
    assert len(merged) == len(pairs)
    for n, ((a, b), ok) in enumerate(zip(pairs, good, strict=True)):
        assert (merged[n] == [a[0], b[0]]) == ok


def test_words_of_all_sizes(library, lex):
    rnd = random.Random(7)
    sizes = [1, 2, *(w + d for w in bpe.WIDTHS for d in (-1, 0, 1)), 300]
    words = ["".join(rnd.choice("aeinorsté中") for _ in range(n)) for n in sizes for _ in range(60)]
    failed = lex.learn(dict.fromkeys(words))
    assert failed
    for word in words:
        assert np.frombuffer(lex.cache[word], lex.dtype).tolist() == library.encode(word, add_special_tokens=False).ids


def test_round_trip(edges, library):
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in edges.collect())
    coded = bpe.encode(edges)
    assert sorted((str(r.doc_id), r.ids) for r in coded.collect()) == want
    texts = sorted((str(r.doc_id), r.text) for r in bpe.decode(coded).collect())
    assert texts == sorted((d, library.decode(ids, skip_special_tokens=False)) for d, ids in want)
    assert sorted(r.n_tokens for r in bpe.round_trip_digests(edges).collect()) == sorted(len(ids) for _, ids in want)


def test_packing(edges, library):
    records = packing.pack(edges.filter("doc_id is null or doc_id <> 2"))
    ids = {str(r.doc_id) + str(r.text is None): library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in edges.collect()}
    pieces = packing.pieces(records).collect()
    whole = {r.sequence_id: r for r in packing.sequences(records).collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.input_ids) and zlib.crc32(np.array(p.input_ids, "<u4").tobytes()) == p.ids_crc32
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
    for (doc, n), own in by_doc.items():
        joined = [i for p in sorted(own, key=lambda p: p.start) for i in p.input_ids]
        assert len(joined) == n and joined in ids.values()
    assert len(by_doc) == 13
    total = sum(p.length for p in pieces)
    assert sorted(by_sequence) == list(range(-(-total // packing.WINDOW)))
    for s, own in by_sequence.items():
        joined, at = [], 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            joined += p.input_ids
        assert whole[s].length == at == min(packing.WINDOW, total - s * packing.WINDOW)
        assert whole[s].input_ids == joined + [packing.PAD_ID] * (packing.WINDOW - at)


def test_nothing(nothing):
    assert packing.pack(nothing).count() == 0
    assert bpe.round_trip_digests(nothing).count() == 0


class Captured:
    """Stands for a table; keeps the function that its tasks would run."""

    schema = {"doc_id": type("Field", (), {"dataType": type("Long", (), {"simpleString": lambda self: "bigint"})()})}

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        raise InterruptedError


@pytest.mark.parametrize("start", [lambda t: jaccard.frequent_shingles(t, 5, 64), lambda t: suffix._anchored(t, 400, 32)])
def test_caches_end_where_another_operator_begins(start):
    source = open(bpe.vocabulary_path(), encoding="utf-8").read()
    assert bpe.lexicon(source) is bpe.lexicon(source)
    table = Captured()
    try:
        start(table)
    except InterruptedError:
        pass
    list(table.run(iter([])))
    assert bpe.lexicon.cache_info().currsize == 0
