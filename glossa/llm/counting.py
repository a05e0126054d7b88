"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

A word starts as a list of characters.  A heap holds the adjacent pairs that are a piece
of the vocabulary; the pair of the lowest rank, the leftmost among equals, is popped and
merged, and the pairs with its new neighbours are pushed.  Each merge makes one symbol
less, so the count is that of the first symbols minus the merges.  A character that is no
piece stands for its UTF-8 bytes and never merges.

No merge joins two characters that no piece has side by side.  Characters are therefore
put into classes by the pieces they share (letters of a script, signs), texts are cut where
the class changes or a blank begins, and the counts of words seen before come from a cache
of the worker.  The cache is bounded by its bytes: when one half is full, the half that was
not used lately goes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.bpe import vocabulary_path
from glossa.llm.common import quoted, sliced, worker_cache

BLANK = "▁"
LIMIT = 4096
CACHE_BYTES = 160_000_000
#: About what an entry of the cache takes beside its characters.
ENTRY_BYTES = 160
#: Places of words up to this length are kept in lists, which are faster, of longer ones in arrays, which are smaller.
LISTED = 10_000
#: Characters of a text that are cut into words at a time.
BLOCK = 500_000


def word_pattern(ranks: dict[str, int]) -> re.Pattern:
    """Cuts a text into spans that no merge leaves: blanks, and what follows of one class of characters."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while (up := parent.setdefault(c, c)) != c:
            c = up
        return c

    for piece in ranks:
        body = piece.lstrip(BLANK)
        for a, b in pairwise(body):
            parent[root(a)] = root(b)
    classes: dict[str, list[str]] = defaultdict(list)
    for c in sorted(parent):
        classes[root(c)].append(c)
    spans = ["[" + re.escape("".join(c)) + "]+" for c in sorted(classes.values(), key=len, reverse=True)]
    return re.compile(f"{BLANK}*(?:{'|'.join([*spans, f'[^{BLANK}]'])})|{BLANK}+")


def pieces(path: str) -> dict[str, int]:
    """Rank of every piece: 0 for the one merged first, equal for equal scores.

    Raises ValueError where the file asks for something else than merging by rank with
    bytes for unknown characters, one blank in front and blanks as they are.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds, norm, train = model.SentencePiece, model.normalizer_spec, model.trainer_spec
    if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError("only byte-pair models with byte fallback and leading blanks are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only the identity normalizer with a blank in front is supported")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    ranks = {piece: order[score] for piece, score in scores.items()}
    if any(re.search(f"[^{BLANK}]{BLANK}", p) or any(c not in ranks for c in p) for p in ranks):
        raise ValueError("pieces with a blank behind a character, or of characters that are no pieces, are not supported")
    if max(map(len, ranks)) >= 1 << SIZE_BITS or len(order) >= 1 << RANK_BITS:
        raise ValueError("the vocabulary is too large")
    return ranks


#: A pair in the heap is one number: rank, place and length.
SIZE_BITS, PLACE_BITS, RANK_BITS = 8, 36, 19


def count_merges(word: str, ranks: dict[str, int]) -> int:
    """Merges that byte-pair encoding makes in ``word``."""
    n = len(word)
    # A symbol is a span that starts at its place: next start (0: merged away) and previous start.
    places_of = list if n <= LISTED else partial(array, "q")
    after, before = places_of(range(1, n + 2)), places_of(range(-1, n))
    after[n] = 0
    heap = [
        (rank << PLACE_BITS | at) << SIZE_BITS | 2
        for at in range(n - 1)
        if (rank := ranks.get(word[at : at + 2])) is not None
    ]
    heapify(heap)
    places, sizes, merges = (1 << PLACE_BITS) - 1, (1 << SIZE_BITS) - 1, 0
    while heap:
        pair = heappop(heap)
        at = pair >> SIZE_BITS & places
        end, middle = at + (pair & sizes), after[at]
        if not middle or after[middle] != end:
            continue  # one of the two has merged with another symbol since
        merges += 1
        after[at], after[middle] = end, 0
        if end < n:
            before[end] = at
            upto = after[end]
            if (rank := ranks.get(word[at:upto])) is not None:
                heappush(heap, (rank << PLACE_BITS | at) << SIZE_BITS | upto - at)
        start = before[at]
        if start >= 0 and (rank := ranks.get(word[start:end])) is not None:
            heappush(heap, (rank << PLACE_BITS | start) << SIZE_BITS | end - start)
    return merges


class Counter:
    """Counts tokens; remembers the counts of words within a bound of bytes."""

    def __init__(self, ranks: dict[str, int], limit: int = CACHE_BYTES):
        self.ranks, self.limit = ranks, limit // 2
        self.known = {c for c in ranks if len(c) == 1}
        self.pattern = word_pattern(ranks)
        self.fresh: dict[str, int] = {}
        self.stale: dict[str, int] = {}
        self.held = 0

    def word(self, word: str) -> int:
        symbols = len(word)
        if not self.known.issuperset(word):
            symbols = sum(1 if c in self.known else len(c.encode()) for c in word)
        return symbols - count_merges(word, self.ranks) if len(word) > 1 else symbols

    def _learn(self, words: set[str]) -> None:
        for word in words:
            n = self.stale.get(word)
            self.fresh[word] = self.word(word) if n is None else n
            self.held += ENTRY_BYTES + 4 * len(word)

    def text(self, text: str) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        total, at = 0, 0
        text = BLANK + text.replace(" ", BLANK)
        while at < len(text):
            upto = self._border(text, at + BLOCK)
            words = self.pattern.findall(text, at, upto)
            self._learn(set(words).difference(self.fresh))
            total += sum(map(self.fresh.__getitem__, words))
            if self.held > self.limit:
                self.fresh, self.stale, self.held = {}, self.fresh, 0
            at = upto
        return total

    @staticmethod
    def _border(text: str, at: int) -> int:
        """The first start of a word from ``at`` on."""
        while 0 < at < len(text):
            at = text.find(BLANK, at)
            if at > 0 and text[at - 1] != BLANK:
                return at
            at += at >= 0
        return len(text)


@worker_cache
def _counter(source: str) -> Counter:
    return Counter(json.loads(source))


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    Null and empty texts have no bytes and no tokens.  Repeated rows and null ids are rows
    like others; other columns are ignored; an empty table gives no rows.  A text is worked
    on in blocks that end between words; only a word without blanks is held whole, with
    some 60 bytes per character.
    """
    ranks = pieces(path or vocabulary_path("piece_bpe_32k.model"))
    source = docs.sparkSession.sparkContext.broadcast(json.dumps(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            for part in sliced(batch):
                texts = pc.fill_null(part.column("text"), "")
                counts = pa.array([counter.text(t.as_py()) for t in texts], pa.int64())
                sizes = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, counts], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    counted = named.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
