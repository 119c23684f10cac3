"""Hierarchical weighted hash tree (law ``key``).

Regions hold racks, racks hold shards.  A row descends the tree: at each level every child draws
``-ln(u) / weight`` with ``u`` hashed from (doc_id, child), and the smallest draw wins, so a child gets
rows in proportion to its weight.  A draw depends on the row, the child and the child's own weight
only; rows therefore move only out of or into subtrees whose weight changes.  ``grown`` adds a
shard as a region of its own: no old subtree changes its weight, so only the new shard takes rows.

Everything is one projection of JVM expressions; only doc_ids, sizes and checksums are shuffled,
to number the rows of each shard.

Defined cases: a null text has size 1 and checksum 0; a null doc_id is a key like any other;
repeated rows go to the same shard and each takes a slot of its own; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


# Rows of one (shard, bucket) group are numbered by one task; a bucket is a hash of doc_id.
SLOT_BUCKETS = 4096


def layout(n_shards: int, per_rack: int = 2, per_region: int = 2) -> list[Shard]:
    """``n_shards`` equal shards, ``per_rack`` to a rack and ``per_region`` racks to a region."""
    return [Shard(i // (per_rack * per_region), i // per_rack, i) for i in range(n_shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    return [*tree, Shard(*(max((s[k] for s in tree), default=-1) + 1 for k in range(3)), weight)]


def _smallest_draw(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child of the smallest draw; ties go to the smaller number."""
    draws = []
    for child, weight in sorted(weights.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}{child}")), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def _below(tree: list[Shard], parent: int | None, child: int) -> dict[int | None, dict[int, float]]:
    """parent -> its children's total weights; fields of ``Shard`` by number, None: the root."""
    out: dict[int | None, dict[int, float]] = {}
    for s in tree:
        at = out.setdefault(None if parent is None else s[parent], {})
        at[s[child]] = at.get(s[child], 0.0) + s.weight
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Struct (region, rack, shard) of a key, by descending the tree."""
    if not tree or any(s.weight <= 0 for s in tree) or len({s.shard for s in tree}) < len(tree):
        raise ValueError("a tree needs shards with distinct numbers and positive weights")
    region = _smallest_draw(key, "region", _below(tree, None, 0)[None])

    def descend(at: Column, level: str, groups: dict) -> Column:
        out = F.lit(None).cast("int")
        for parent, weights in groups.items():
            out = F.when(at == parent, _smallest_draw(key, level, weights)).otherwise(out)
        return out

    rack = descend(region, "rack", _below(tree, 0, 1))
    return F.struct(region.alias("region"), rack.alias("rack"),
                    descend(rack, "shard", _below(tree, 1, 2)).alias("shard"))


def assign(docs: DataFrame, tree: list[Shard], more: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and, for a second tree, grown_shard."""
    out = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("at"),
        (shard_of(F.col("doc_id"), more)["shard"] if more else F.lit(None).cast("int")).alias("grown_shard"))
    out = out.select("doc_id", "size", "text_crc32", "at.*", "grown_shard",
                     F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOT_BUCKETS)).alias("bucket"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most SLOT_BUCKETS rows per shard
    first = (out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
             .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    return (out.withColumn("rank", F.row_number().over(in_bucket) - 1)
            .join(first, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", "region", "rack", "shard",
                    (F.col("first") + F.col("rank")).alias("slot"), "grown_shard"))
