"""BPE encoding and decoding: propose by greedy longest match, verify every adjacent pair.

A sequence of tokens is the result of merging by rank exactly if each token merges to
itself and no merge ever crosses the border of two neighbours, which depends on the two
tokens alone.  Words are therefore cut greedily, all distinct pairs of neighbours of a
batch are checked at once in numpy, and only words with a pair that fails are merged step
by step.  Words seen before, and runs of them between white space, come from caches of the
worker that are bounded by their bytes.

The vocabulary (a file of fixed size) is read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import quoted, worker_cache

NEVER = np.int64(2**62)
WORD_END = "Ā"
#: Bound of each of the two caches of a worker (words, runs), and about what an entry takes beside its characters and tokens.
CACHE_BYTES = 130_000_000
ENTRY_BYTES = 160
CHUNK_CHARS = 1_000_000
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Words up to these sizes are merged as tables, longer ones by a heap.
WIDTHS = (6, 9, 13, 20, 40)
ASCII_WORDS = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
ANY_WORDS = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


#: Python takes these for white space, the vocabulary's patterns don't.
CONTROLS = re.compile(r"[\x1c-\x1f]")


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    # Lower case goes character by character, so the final sigma is no case of its own.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _cut(normal: str) -> list[str]:
    return (ASCII_WORDS if normal.isascii() else ANY_WORDS).findall(normal)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[str, str]:
    """Names of the bytes in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, the last one of each raised by 256, and where each word ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    symbols[ends - 1] += 256
    return symbols, ends


class Lexicon:
    """Tokens, merges and the tables for the checks.

    Tokens are named by one character per UTF-8 byte, with ``WORD_END`` behind the last one
    of a word; words are arrays of symbols, in which the last byte of a word has its own 256.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        names = _byte_names()

        def piece(token: str) -> str:
            ends = bool(suffix) and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            return "".join(names[c] for c in body) + WORD_END * ends

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.names = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.size = size
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        pairs = []
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, ab = vocab[a], vocab[b], vocab[a + b]
            pairs.append((a * size + b, n, ab))
            self.rank[ab], self.left[ab], self.right[ab] = n, a, b
        self.merges = {key: n for key, n, _ in pairs}
        self.made = made = np.array([p[2] for p in pairs], np.int64)
        ordered = sorted(pairs) or [(-1, 0, 0)]
        self.pair_keys = np.array([p[0] for p in ordered], np.int64)
        self.pair_ranks = np.array([p[1] for p in ordered], np.int64)
        self.base = {piece(t): i for t, i in vocab.items() if self.rank[i] < 0}
        # Only tokens that merge to themselves may be proposed.
        whole = self.compatible(self.left[made], self.right[made], self.rank[made]) if len(made) else np.array([], bool)
        sound = np.zeros(size, bool)
        for token, good in zip(made.tolist(), whole.tolist(), strict=True):
            a, b = self.left[token], self.right[token]
            sound[token] = good and (self.rank[a] < 0 or sound[a]) and (self.rank[b] < 0 or sound[b])
        self.pieces = self.base | {piece(t): i for t, i in vocab.items() if sound[i]}
        self._grow_trie()
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, bytes] = {}
        for text, i in self.special.items():
            self.cache[" " + text] = np.array([i], self.dtype).tobytes()
        self.fixed = dict(self.cache)
        self.seen: dict[str, bytes] = {}
        self.word_bytes = self.run_bytes = 0

    def _grow_trie(self) -> None:
        """Edges of the trie of pieces, level by level: edge k leads to node k + 1 and has the key node * 512 + symbol."""
        # The end mark alone is no piece: it belongs to the last byte.
        names = [p for p in self.pieces if p != WORD_END]
        symbols, ends = _symbols([p.removesuffix(WORD_END).encode("latin-1") for p in names])
        ids = np.array([self.pieces[p] for p in names], np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        open_end = np.array([not p.endswith(WORD_END) for p in names], bool)
        symbols[ends[open_end] - 1] -= 256
        at, node, keys, tokens, count = np.arange(len(names)), np.zeros(len(names), np.int64), [], [], 0
        depth = 0
        while len(at):
            level, back = np.unique(node[at] * 512 + symbols[starts[at] + depth], return_inverse=True)
            node[at] = count + back + 1
            done = starts[at] + depth + 1 == ends[at]
            own = np.full(len(level), -1, np.int64)
            own[back[done]] = ids[at[done]]
            keys.append(level)
            tokens.append(own)
            count += len(level)
            at = at[~done]
            depth += 1
        self.edges = np.concatenate(keys)
        self.edge_token = np.concatenate(tokens)
        self.unit = np.full(512, -1, np.int64)
        for p, i in self.base.items():
            if p != WORD_END:
                self.unit[ord(p[0]) + 256 * (len(p) > 1)] = i

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank below ``limit`` crosses the border of tokens a and b.

        Both tokens are taken apart again, the later-made one first.  At each step the
        parts that touch would merge if their pair has a rank below the one at which the
        left part was used up, and not above that of the right part (the left of two equal
        merges comes first).
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x = np.full(len(a), NEVER) if limit is None else limit.copy()
        until_y = until_x.copy()
        while len(at):
            key = x * self.size + y
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[spot] == key, self.pair_ranks[spot], NEVER)
            crossed = (rank < until_x) & (rank <= until_y) & (rank < NEVER)
            good[at[crossed]] = False
            made_x, made_y = self.rank[x], self.rank[y]
            go = ~crossed & ((made_x >= 0) | (made_y >= 0))
            undo_x = made_x > made_y
            until_x, until_y = np.where(undo_x, made_x, until_x)[go], np.where(undo_x, until_y, made_y)[go]
            x, y = np.where(undo_x, self.right[x], x)[go], np.where(undo_x, y, self.left[y])[go]
            at = at[go]
        return good

    def propose(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: tokens, the word of each, and which words ran into a dead end."""
        at = np.concatenate([[0], ends[:-1]])
        word, failed = np.arange(len(ends)), np.zeros(len(ends), bool)
        owners, found = [], []
        while len(word):
            token, stop = np.full(len(word), -1, np.int64), at.copy()
            live, node, spot = np.arange(len(word)), np.zeros(len(word), np.int64), at.copy()
            while len(live):
                key = node * 512 + symbols[spot]
                edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[edge] == key
                live, edge, spot = live[on], edge[on], spot[on] + 1
                whole = self.edge_token[edge] >= 0
                token[live[whole]], stop[live[whole]] = self.edge_token[edge[whole]], spot[whole]
                # Nothing follows the symbol that ends a word.
                more = spot < ends[word[live]]
                live, node, spot = live[more], edge[more] + 1, spot[more]
            good = token >= 0
            failed[word[~good]] = True
            owners.append(word[good])
            found.append(token[good])
            left = good & (stop < ends[word])
            word, at = word[left], stop[left]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], owner[order], failed

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NEVER`` if there is none."""
        key = a * self.size + b
        spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[spot] == key) & (a >= 0) & (b >= 0), self.pair_ranks[spot], NEVER)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Exact merging: always the lowest rank, the leftmost of equal ones.

        Gives the places of some of the words, their tokens in a row and how many each has,
        until all words have come.
        """
        ids = self.unit[symbols]
        sizes = np.diff(np.concatenate([[0], np.cumsum(ids >= 0)[ends - 1]]))
        ids = ids[ids >= 0]
        starts = np.cumsum(sizes) - sizes
        low = -1
        for high in WIDTHS:
            if len(rows := np.flatnonzero((sizes > low) & (sizes <= high))):
                inside = np.arange(high) < sizes[rows, None]
                table = np.full((len(rows), high), -1, np.int64)
                table[inside] = ids[(starts[rows, None] + np.arange(high))[inside]]
                table = self._merge_table(table)
                inside = table >= 0
                yield rows, table[inside], inside.sum(axis=1)
            low = high
        for r in np.flatnonzero(sizes > low).tolist():
            own = self._merge_long(ids[starts[r] : starts[r] + sizes[r]].tolist())
            yield np.array([r]), np.array(own, np.int64), np.array([len(own)])

    def _merge_table(self, ids: np.ndarray) -> np.ndarray:
        """One merge a row and round; rows are filled up with -1."""
        done = np.full(ids.shape, -1, np.int64)
        ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(ids))
        while ranks.shape[1]:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(row)), best]
            go = rank < NEVER
            done[row[~go], : ids.shape[1]] = ids[~go]
            row, ids, ranks, best, rank = row[go], ids[go], ranks[go], best[go], rank[go]
            each, width = np.arange(len(row)), ids.shape[1]
            ids[each, best] = self.made[rank]
            ids = np.take_along_axis(ids, np.arange(width - 1) + (np.arange(width - 1) > best[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, np.arange(width - 2) + (np.arange(width - 2) >= best[:, None]), axis=1)
            for near, i in ((best > 0, best - 1), (best < width - 2, best)):
                at, i = each[near], i[near]
                ranks[at, i] = self.ranks_of(ids[at, i], ids[at, i + 1])
        done[row, : ids.shape[1]] = ids
        return done

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.merges.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, here in zip(ids, alive, strict=True) if here]

    def learn(self, words: Iterable[str]) -> int:
        """Put the tokens of new words into the cache; returns how many needed exact merging."""
        words = list(words)
        if not words:
            return 0
        symbols, ends = _symbols([w.encode("utf-8", "surrogatepass") for w in words])
        flat, owner, failed = self.propose(symbols, ends)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        bad = ~self.compatible(keys // self.size, keys % self.size)[back]
        failed[owner[inner[bad]]] = True
        again = np.flatnonzero(failed)
        counts = np.bincount(owner, minlength=len(words))
        self._keep(words, np.flatnonzero(~failed), flat[~failed[owner]], counts[~failed])
        if len(again):
            sizes = np.diff(np.concatenate([[0], ends]))
            own = np.repeat(failed, sizes)
            for rows, ids, n in self.merge(symbols[own], np.cumsum(sizes[again])):
                self._keep(words, again[rows], ids, n)
        return len(again)

    def _keep(self, words: list[str], rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Put the tokens of words at ``rows`` into the cache; ``ids`` has those of all of them in a row."""
        raw, stops, start = ids.astype(self.dtype).tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist(), 0
        for r, stop in zip(rows.tolist(), stops, strict=True):
            self.cache[words[r]] = raw[start:stop]
            start = stop
        self.word_bytes += ENTRY_BYTES * len(rows) + len(raw) + sum(map(len, map(words.__getitem__, rows.tolist())))

    def words(self, text: str) -> list[str]:
        """Words of a text in normal form; a special token is itself behind a space, which no word contains."""
        if "<" in text and (found := self.specials.search(text)):
            out, at = [], 0
            while found:
                out += [*self.words(text[at : found.start()]), " " + found.group()]
                at = found.end()
                found = self.specials.search(text, at)
            return out + self.words(text[at:])
        return _cut(_normal(text))

    def runs(self, text: str) -> list[str]:
        """Keys of the cache of runs: the parts of a text between white space, which can be encoded one by one."""
        if ("<" in text and self.specials.search(text)) or CONTROLS.search(text):
            return self.words(text)
        return _normal(text).split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as packed little-endian numbers."""
        parts = [self.runs(t) for t in texts]
        distinct = set().union(*parts)
        new = {run: [run] if run in self.fixed else _cut(run) for run in distinct.difference(self.seen)}
        self.learn(set().union(*new.values()).difference(self.cache))
        get = self.cache.__getitem__
        for run, words in new.items():
            self.seen[run] = get(words[0]) if len(words) == 1 else b"".join(map(get, words))
            self.run_bytes += ENTRY_BYTES + len(run) + len(self.seen[run])
        get = self.seen.__getitem__
        out = [b"".join(map(get, runs)) for runs in parts]
        if self.word_bytes > CACHE_BYTES:
            self.cache, self.word_bytes = dict(self.fixed), 0
        if self.run_bytes > CACHE_BYTES:
            self.seen, self.run_bytes = {}, 0
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder in the vocabulary file, tokens are joined by spaces as they are named."""
        return " ".join(map(self.names.__getitem__, ids))


@worker_cache
def lexicon(source: str) -> Lexicon:
    return Lexicon(source)


def shared_source(spark, path: str | None = None):
    """The vocabulary file as a broadcast value."""
    return spark.sparkContext.broadcast(Path(path or vocabulary_path()).read_text(encoding="utf-8"))


def chunked(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; null counts as empty."""
    batch, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        batch.append(text)
        size += len(text) + 16
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids.

    Repeated rows and null ids pass as they are; other columns are ignored.  Letters that
    only later Unicode versions know may be cut otherwise than by older tables.
    """
    source = shared_source(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(source.value)
        for batch in batches:
            at = 0
            for texts in chunked(batch.column("text").to_pylist()):
                ids = [np.frombuffer(x, lex.dtype).astype(np.int32) for x in lex.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encode``; a null array is an empty text."""
    source = shared_source(rows.sparkSession, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        lex = lexicon(source.value)
        return ids.map(lambda x: lex.decode([] if x is None else x.tolist()))

    return rows.select("doc_id", text("ids").alias("text"))


def round_trip_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256, in one pass over the texts.

    Rows are treated as in ``encode``; an empty text has the digests of the empty string.
    """
    source = shared_source(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(source.value)
        digits = [str(i) for i in range(lex.size)].__getitem__
        hexed = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, ids_print, text_print = [], [], []
            for texts in chunked(batch.column("text").to_pylist()):
                for packed in lex.encode(texts):
                    ids = np.frombuffer(packed, lex.dtype).tolist()
                    n.append(len(ids))
                    ids_print.append(hexed(" ".join(map(digits, ids))))
                    text_print.append(hexed(lex.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_print, pa.string()), pa.array(text_print, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return named.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
