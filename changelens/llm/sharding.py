"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards.  A row descends it: at each node every
child draws -ln(u) / weight from a hash of the row's id and the child's name,
and the smallest draw wins, so a child gets its weight's share of the rows.
Names are never renumbered, so a child whose weight stays the same draws the
same: when a weight changes, rows move only into or out of that subtree.

The tree is founded with a number of shards, filled in by ``SHAPE``; the founding
number belongs to a store and stays when it grows.  A further shard joins as a
region of its own, beside regions whose weights stay.  Law ``key``: the id and the
shard count decide, and growing by one shard moves rows into the new shard only,
never between old ones, whatever the founding number.

Slots number a shard's rows without gaps: ranks within hash-split parts of a
shard plus the counts of the parts before, so no task sorts a whole shard.

Only native expressions, no Python on the executors.  Defined cases: null text
has no bytes and checksum 0; a null id is an id like any other; repeated rows
get a shard in common and a slot each, ties in any order; very long texts are
only measured; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SHAPE = (2, 3, 4)                      # regions, racks in each, shards in each rack
BASE = SHAPE[0] * SHAPE[1] * SHAPE[2]  # a full tree: 24 shards of weight 1
PARTS = 1024                           # hash-split parts of a shard, for slots


def tree(n_shards: int, weights: dict[int, float] | None = None, founded: int | None = None,
         shape: tuple[int, int, int] = SHAPE) -> dict[str, dict[str, float]]:
    """Per inner node its children's names and weights; "" is the root.

    A node weighs what its shards weigh.  Shards from ``founded`` on (at most a
    full tree) are regions of their own, so the weights of the founding tree never
    depend on their number.
    """
    regions, racks, leaves = shape
    full = regions * racks * leaves
    founded = min(n_shards if founded is None else founded, full)
    out: dict[str, dict[str, float]] = {"": {}}
    for s in range(n_shards):
        region = f"region {s // (racks * leaves)}" if s < founded else f"region x{s}"
        rack = f"rack {s // leaves}" if s < founded else f"rack x{s}"
        weight = float((weights or {}).get(s, 1.0))
        for parent, child in (("", region), (region, rack), (rack, str(s))):
            node = out.setdefault(parent, {})
            node[child] = node.get(child, 0.0) + weight
    return out


def _descend(key: Column, at: Column, nodes: dict[str, dict[str, float]]) -> Column:
    """The child of node ``at`` with the least draw."""
    children = F.create_map(*[x for node, kids in nodes.items() for x in (
        F.lit(node), F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).alias("weight")) for k, w in kids.items()]))])

    def draw(c):
        # 52 hash bits as a number strictly between 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("/"), c["name"])), 12)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    return F.array_min(F.transform(F.element_at(children, at), draw))["name"]


def shard_of(id_col: Column, n_shards: int, weights: dict[int, float] | None = None, founded: int | None = None,
             shape: tuple[int, int, int] = SHAPE) -> Column:
    key = F.coalesce(id_col.cast("string"), F.lit("null"))
    nodes = tree(n_shards, weights, founded, shape)
    regions, racks = {"": nodes[""]}, {k: v for k, v in nodes.items() if k.startswith("region")}
    leaves = {k: v for k, v in nodes.items() if k.startswith("rack")}
    region = _descend(key, F.lit(""), regions)
    return _descend(key, _descend(key, region, racks), leaves).cast("int")


def assign(docs: DataFrame, n_shards: int = BASE, id_col: str = "doc_id", text_col: str = "text",
           weights: dict[int, float] | None = None, founded: int | None = None,
           shape: tuple[int, int, int] = SHAPE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row;
    ``founded`` is the number of shards the store began with (default: ``n_shards``)."""
    founded = n_shards if founded is None else founded
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(F.col(id_col), n_shards, weights, founded, shape).alias("shard"),
        shard_of(F.col(id_col), n_shards + 1, weights, founded, shape).alias("grown_shard"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(PARTS)).cast("int").alias("part")))
    parts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("rank", rank).join(starts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"),
                    "grown_shard"))
