"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys and virtual nodes lie on a ring of ``CELLS`` cells.  A key belongs to the next
virtual node clockwise; a shard takes keys up to its bound, and keys that overflow go on
clockwise to the next node whose shard has room.  The bound is exact: the number of rows
over the shards, so that counts are at most one apart, and only the surplus of full
shards moves.

Only counts per cell (at most ``CELLS`` rows, whatever the input) reach the driver, which
walks the ring once; the rows themselves get their place from their rank in their cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import quoted
from glossa.session import cut_lineage

CELLS = 16_384
NODES = 128


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order; a shard's nodes don't depend on the number of shards."""
    taken: dict[int, int] = {}
    for node in range(nodes):
        for shard in range(shards):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{node}".encode()).digest()[:8]) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def settle(counts: dict[int, int], bounds: list[int], nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from rank, to rank, shard, first slot) that place every key of every cell."""
    room, filled = list(bounds), [0] * len(bounds)
    segments, surplus = [], []

    def put(cell: int, low: int, high: int, shard: int) -> int:
        take = min(high - low, room[shard])
        if take:
            segments.append((cell, low, low + take, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
        return low + take

    at = 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        home = at % len(nodes)
        if (low := put(cell, 0, counts[cell], nodes[home][1])) < counts[cell]:
            surplus.append((cell, low, counts[cell], home))
    for cell, low, high, home in surplus:
        while low < high:
            home = (home + 1) % len(nodes)
            low = put(cell, low, high, nodes[home][1])
    return segments


def row_bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def shard_rows(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, cells: int = CELLS
) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot and grown_shard (null under this law).

    A row's key is its id; rows without one use size and checksum of their text instead.
    Null texts have no bytes.  Repeated rows are rows like others: each gets a slot of its
    own.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    base = docs.select(
        quoted(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    keyed = cut_lineage(
        base.withColumn("place", place).withColumn("cell", F.pmod("place", F.lit(cells)).cast("int"))
    )
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = settle(counts, row_bounds(sum(counts.values()), shards), ring(shards, nodes, cells))
    segments = docs.sparkSession.createDataFrame(plan, "cell int, low long, high long, shard int, first long")
    in_cell = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(in_cell).cast("long") - 1)
    return ranked.join(
        F.broadcast(segments.withColumnRenamed("cell", "at")),
        (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
