import random

import pytest
import sentencepiece

from glossa.llm import counting
from glossa.llm.bpe import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def ranks():
    return counting.pieces(vocabulary_path("piece_bpe_32k.model"))


def strings(seed: int):
    rnd = random.Random(seed)
    alphabets = ["ab ", "the and of  ", "aeinorst\n\t ", "▁ a", "0123456789. ", "éßñ中文字😀\U0010ffff ", "<s></s><unk> <0x0A>", " "]
    for n in [0, 1, 2, 3, 5, 17, 64, 500]:
        for alphabet in alphabets:
            for _ in range(8):
                yield "".join(rnd.choice(alphabet) for _ in range(n))


def test_texts_of_all_kinds(library, ranks):
    counter = counting.Counter(ranks)
    for text in strings(1):
        assert counter.text(text) == len(library.encode(text)), text


def test_plainest_merging(ranks):
    """The count of the heap is that of merging the best pair of the whole list again and again."""

    def plain(word):
        symbols = list(word)
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return len(word) - len(symbols)
            at = min(pairs)[1]
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]

    for text in strings(2):
        if len(text) < 100:
            assert counting.count_merges(text, ranks) == plain(text), text


def test_blocks_and_small_cache(library, ranks, monkeypatch):
    monkeypatch.setattr(counting, "BLOCK", 7)
    counter = counting.Counter(ranks, limit=2000)
    for text in strings(3):
        assert counter.text(text) == len(library.encode(text)), text
    assert len(counter.fresh) + len(counter.stale) < 40


def test_unsupported_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary_path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        counting.pieces(str(tmp_path / "other.model"))


def check(df, library):
    want = []
    for r in df.select("doc_id", "text").collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > counting.LIMIT))
    got = [tuple(r) for r in counting.token_counts(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def test_edges(edges, library):
    assert any(w[3] for w in check(edges, library))


def test_documents(documents, library):
    check(documents, library)


def test_limit(spark, library):
    df = spark.createDataFrame([(1, "a b c")], "key long, body string")
    n = len(library.encode("a b c"))
    got = [counting.token_counts(df, "key", "body", limit=k).first().over_limit for k in (n - 1, n)]
    assert got == [True, False]


def test_nothing(nothing):
    assert counting.token_counts(nothing).count() == 0
