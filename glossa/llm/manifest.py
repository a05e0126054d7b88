"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups.

Every level is a self-join of its nodes by their run of ``arity`` neighbours: the node with
slot s finds its sibling with slot s + k (mod ``arity``; the XOR with 1 for two) for each
offset k, and the slot-zero rows, which then hold the digests of their whole run, emit the
parents.  Nodes are keyed by group and place, so a large group is spread like any other;
each level is written to the shared folder (as Parquet, so that the optimizer knows its size)
and has an ``arity``-th of the rows.

Levels of at most ``SMALL`` nodes (counted, not guessed) are joined in one task without a
shuffle, all others are shuffled by group and run.

The way back down gives every row its proof: level by level the digests left and right of
the own one.  It is joined from the root down, so a proof is handed to the few nodes of a
level before it is handed to their children.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import quoted, ranked
from glossa.session import written

ARITY = 3
#: Most nodes of a level that one task joins; with the steps above them about 40 MB.
SMALL = 20_000
STEPS = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**fields: Column) -> Column:
    """Digest of a row: its fields in the order given, each with its length in front."""
    return digest(*[field(value) for value in fields.values()])


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(steps, leaf, lambda own, step: digest(step["before"], own, step["after"]))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda step: F.concat(step["before"], step["after"]))), 256)


@dataclass
class Level:
    """Nodes of a level that have siblings, and a bound of their number."""

    nodes: DataFrame
    bound: int


def _join(left: DataFrame, right: DataFrame, on: Column, how: str, small: bool) -> DataFrame:
    """A join in one task, where both sides are small."""
    return left.coalesce(1).join(right.coalesce(1).hint("merge"), on, how) if small else left.join(right, on, how)


def _with_siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """``nodes`` with ``before`` and ``after``, the joined digests of the siblings on both sides."""
    key = nodes.withColumn("run", F.floor(F.col("at") / arity)).withColumn("slot", F.col("at") % arity)
    out = key
    for offset in range(1, arity):
        other = key.select(
            F.col("grp").alias("_grp"), F.col("run").alias("_run"), F.col("slot").alias("_slot"), F.col("digest").alias(f"_d{offset}")
        )
        # The slots are compared beside the keys, so all offsets share one partitioning.
        near = F.pmod(F.col("_slot") - F.col("slot"), F.lit(arity)) == offset
        same_run = (F.col("grp") == F.col("_grp")) & (F.col("run") == F.col("_run"))
        out = _join(out, other, same_run & near, "left", small).drop("_grp", "_run", "_slot")
    wraps = [(F.col("slot") + k >= arity, F.col(f"_d{k}")) for k in range(1, arity)]
    return out.select(
        *nodes.columns,
        "run",
        "slot",
        F.concat_ws("", *[F.when(wrapped, d) for wrapped, d in wraps]).alias("before"),
        F.concat_ws("", *[F.when(~wrapped, d) for wrapped, d in wraps]).alias("after"),
    )


def _climb(nodes: DataFrame, arity: int, small: int) -> tuple[list[Level], DataFrame, int]:
    """The nodes of each level with siblings, (grp, top, level) of the last node of each group, and the number of groups.

    ``nodes`` has grp, at, of (nodes of the group), digest, and columns that stay with the first level.
    """
    levels, tops = [], []
    most, bound, groups = nodes.agg(F.max("of"), F.count(F.lit(1)), F.count_if(F.col("at") == 0)).first()
    while (most or 0) > 1:
        tops.append(nodes.filter("of = 1").select("grp", F.col("digest").alias("top"), F.lit(len(levels)).alias("level")))
        level = written(_with_siblings(nodes.filter("of > 1"), arity, bound <= small))
        levels.append(Level(level, bound))
        nodes = level.filter("slot = 0").select(
            "grp",
            F.col("run").alias("at"),
            F.ceil(F.col("of") / arity).alias("of"),
            digest(F.col("digest"), F.col("after")).alias("digest"),
        )
        most, bound = -(-most // arity), bound // arity + groups
    tops.append(nodes.select("grp", F.col("digest").alias("top"), F.lit(len(levels)).alias("level")))
    return levels, reduce(DataFrame.unionByName, tops), groups


def _descend(levels: list[Level], ends: DataFrame, small: int) -> DataFrame:
    """Rows of the first level, with the ``steps`` from them up to the root, and the columns of ``ends``.

    ``ends`` has grp, level and steps for the top node of each group.
    """
    own = [c for c in ends.columns if c not in ("grp", "level", "steps")]

    def at_level(n: int) -> DataFrame:
        return ends.filter(F.col("level") == n).select(F.col("grp").alias("_grp"), F.lit(0).cast("long").alias("_at"), "steps", *own)

    def below(n: int) -> DataFrame:
        """Rows of level ``n`` with the steps of their parents behind their own."""
        if n + 1 < len(levels):
            above = below(n + 1).select(F.col("grp").alias("_grp"), F.col("at").alias("_at"), "steps", *own)
            above = above.unionByName(at_level(n + 1))
            if levels[n + 1].bound > small:
                above = written(above)
        else:
            above = at_level(n + 1)
        to_parent = (F.col("grp") == F.col("_grp")) & (F.col("run") == F.col("_at"))
        step = F.array(F.struct("before", "after"))
        return _join(levels[n].nodes, above, to_parent, "inner", levels[n].bound <= small).withColumn(
            "steps", F.concat(step, F.col("steps")).cast(STEPS)
        )

    return below(0)


def _paths(nodes: DataFrame, levels: list[Level], ends: DataFrame, carried: list[str], small: int) -> DataFrame:
    """``carried`` columns of every first node, its steps and the columns of ``ends``; also where a group has one node."""
    own = [c for c in ends.columns if c not in ("grp", "level")]
    alone = nodes.filter("of = 1").join(ends.filter("level = 0"), "grp").select(*carried, *own)
    return _descend(levels, ends, small).select(*carried, *own).unionByName(alone) if levels else alone


def manifest(
    rows: DataFrame,
    group: Column,
    order: Column,
    leaf: Column,
    carry: dict[str, Column] | None = None,
    arity: int = ARITY,
    small: int = SMALL,
) -> DataFrame:
    """leaf, steps (the siblings of its path), subroot, root and the ``carry`` columns of every row.

    Leaves ascend by ``order`` within ``group`` (nulls first, ties by leaf); groups ascend by
    their UTF-8 bytes, null first.  A group of one row has that leaf as its subroot, a table
    of one group that subroot as its root.  Repeated rows are leaves of their own; an empty
    table gives no rows.
    """
    carry = carry or {}
    named = {
        "grp": F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-")),  # "-" sorts before "="
        "ordered_by": order,
        "digest": leaf,
        **{f"carried_{name}": value for name, value in carry.items()},
    }
    leaves = written(rows.select(*[value.alias(name) for name, value in named.items()]))
    nodes = written(ranked(leaves, "grp", [F.col("ordered_by").asc_nulls_first(), F.col("digest")]).drop("ordered_by"))
    levels, tops, n_groups = _climb(nodes, arity, small)
    groups = written(tops.select(F.lit("").alias("all"), "grp", "level", F.col("top").alias("digest")))
    if n_groups <= small:
        whole = Window.partitionBy("all")
        place = F.row_number().over(whole.orderBy("grp")).cast("long") - 1
        placed = groups.coalesce(1).withColumns({"at": place, "of": F.count(F.lit(1)).over(whole)})
    else:
        placed = ranked(groups, "all", [F.col("grp")])
    crown = written(
        placed.select(F.col("all").alias("grp"), "at", "of", "digest", F.col("grp").alias("group"), F.col("level").alias("group_level"))
    )
    upper, last, _ = _climb(crown, arity, small)
    ends = last.select("grp", "level", F.array().cast(STEPS).alias("steps"), F.col("top").alias("root"))
    ends = _paths(crown, upper, ends, ["group", "group_level", "digest"], small).select(
        F.col("group").alias("grp"), F.col("group_level").alias("level"), "steps", F.col("digest").alias("subroot"), "root"
    )
    ends = written(ends)
    carried = [f"carried_{name}" for name in carry]
    found = _paths(nodes, levels, ends, ["digest", *carried], small)
    return found.select(
        F.col("digest").alias("leaf"), "steps", "subroot", "root", *[F.col(c).alias(c.removeprefix("carried_")) for c in carried]
    )


def audit(docs: DataFrame, arity: int = ARITY, small: int = SMALL) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    Rows whose id has an even CRC-32 are tampered with: their texts lose the line feeds, and
    the root is folded from the changed leaf with the original siblings.  Null ids and null
    texts are not tampered with.  Other columns are ignored.
    """
    columns = {name: quoted(name) for name in FIELDS}
    doc_id, text = columns["doc_id"], columns["text"]
    changed = (F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0) & (F.instr(text, "\n") > 0)
    tampered = F.when(changed, leaf_digest(**columns | {"text": F.translate(text, "\n", "")}))
    found = manifest(docs, columns["source"], doc_id, leaf_digest(**columns), {"doc_id": doc_id, "tampered": tampered}, arity, small)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
