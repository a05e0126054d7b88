"""Packing by concatenating and cutting.

Pass 1 encodes the texts and writes the ids with their offset within their partition.
The token totals of the partitions (one number each) are summed up in order, which gives
every partition, and so every token, its offset in the one stream of all tokens.  Pass 2
cuts each partition at the multiples of the window.  A window that lies in one partition
comes out whole; where partitions meet, each gives a boundary record with its part of the
window, and only those are shuffled when sequences are put together.  All sequences but
the last are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import bpe
from glossa.llm.common import quoted
from glossa.session import cut_lineage

WINDOW = 2048
END_ID = 1
PAD_ID = 0
PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, offset long"


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """doc_id, part, local (offset of the row in its partition), n and packed ids, written to the shared folder."""
    source = bpe.shared_source(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = bpe.lexicon(source.value)
        part, local = TaskContext.get().partitionId(), 0
        end = np.array([end_id], lex.dtype).tobytes()
        for batch in batches:
            at = 0
            for texts in bpe.chunked(batch.column("text").to_pylist()):
                packed = [ids + end for ids in lex.encode(texts)]
                n = np.array([len(ids) // lex.dtype.itemsize for ids in packed], np.int64)
                ends = local + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(ends - n),
                        pa.array(n),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "part", "local", "n", "packed"],
                )
                local = int(ends[-1])
                at += len(texts)
        # The caches stay for the next task, what the texts took needn't.
        pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    rows = named.mapInArrow(run, f"doc_id {kind}, part int, local long, n long, packed binary")
    return cut_lineage(rows)


def partition_bases(rows: DataFrame) -> dict[int, int]:
    """Offset of each partition in the stream: prefix sums of one total per partition."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        bases[part] = at
        at += n
    return bases


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Records of windows: sequence_id, offset, length, input_ids (null without ``with_ids``) and pieces.

    A record of full length is a whole sequence, a shorter one the part that one partition
    has of a sequence (see ``sequences``).  ``pieces`` names the documents in it: doc_id,
    start within the document, length, ids_crc32, doc_tokens, offset within the sequence.

    Null texts are empty and have the end id only.  Repeated rows and null ids are documents
    like others.  Other columns are ignored; an empty table gives no records.
    """
    rows = encoded(docs, id_col, text_col, path, end_id)
    spark = docs.sparkSession
    bases = spark.sparkContext.broadcast(partition_bases(rows))
    source = bpe.shared_source(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    piece = PIECE.format(kind=kind).replace(", ", ",").replace(" ", ":")
    schema = f"sequence_id long, offset long, length long, input_ids array<int>, pieces array<struct<{piece}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = bpe.lexicon(source.value).dtype
        records, pieces, ids, shape = [], [], [], None

        def close() -> None:
            """End the record of the current window."""
            if pieces:
                sequence, offset = pieces[0].pop("_at")
                for p in pieces[1:]:
                    p.pop("_at")
                records.append(
                    {
                        "sequence_id": sequence,
                        "offset": offset,
                        "length": sum(p["length"] for p in pieces),
                        "input_ids": np.concatenate(ids).astype(np.int32) if with_ids else None,
                        "pieces": list(pieces),
                    }
                )
                pieces.clear()
                ids.clear()

        for batch in batches:
            shape = shape or _record_shape(batch.schema.field("doc_id").type)
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "part", "local", "n", "packed"))
            for doc_id, part, local, n, packed in zip(*columns, strict=True):
                tokens = np.frombuffer(packed, dtype)
                base, start = bases.value[part] + local, 0
                while start < n:
                    sequence, offset = divmod(base + start, window)
                    if offset == 0:
                        close()
                    length = min(n - start, window - offset)
                    own = tokens[start : start + length]
                    pieces.append(
                        {
                            "doc_id": doc_id,
                            "start": start,
                            "length": length,
                            "ids_crc32": zlib.crc32(own.astype("<u4").tobytes()),
                            "doc_tokens": n,
                            "offset": offset,
                            "_at": (sequence, offset),
                        }
                    )
                    if with_ids:
                        ids.append(own)
                    start += length
            if len(records) >= 256:
                yield pa.RecordBatch.from_pylist(records, shape)
                records.clear()
        close()
        if records:
            yield pa.RecordBatch.from_pylist(records, shape)

    return rows.mapInArrow(run, schema)


def _record_shape(id_type: pa.DataType) -> pa.Schema:
    whole = pa.int64()
    piece = [("doc_id", id_type), ("start", whole), ("length", whole), ("ids_crc32", whole), ("doc_tokens", whole), ("offset", whole)]
    return pa.schema(
        [
            ("sequence_id", whole),
            ("offset", whole),
            ("length", whole),
            ("input_ids", pa.list_(pa.int32())),
            ("pieces", pa.list_(pa.struct(piece))),
        ]
    )


def pieces(records: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if there are any."""
    flat = records.select("sequence_id", F.col("offset").alias("first"), "input_ids", F.explode("pieces").alias("piece"))
    ids = F.slice("input_ids", (F.col("piece.offset") - F.col("first") + 1).cast("int"), F.col("piece.length").cast("int"))
    return flat.select(
        *[F.col(f"piece.{c}").alias(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")],
        "sequence_id",
        F.col("piece.offset").alias("offset"),
        ids.alias("input_ids"),
    )


def sequences(records: DataFrame, window: int = WINDOW, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, length and input_ids padded to the window, with the boundary records put together.

    Whole windows are not shuffled; a window has at most ``window`` boundary records.
    """
    whole = records.filter(F.col("length") == window).select("sequence_id", "length", "input_ids")
    parts = records.filter(F.col("length") < window).groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "input_ids"))).alias("parts")
    )
    ids = F.flatten(F.col("parts.input_ids"))
    padding = F.array_repeat(F.lit(pad_id), (F.lit(window) - F.col("length")).cast("int"))
    return whole.unionByName(parts.select("sequence_id", "length", F.concat(ids, padding).alias("input_ids")))
