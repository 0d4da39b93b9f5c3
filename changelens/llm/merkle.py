"""Merkle manifest of a dataset: leaves, subtree roots, proofs and their check.

Every row is a leaf, a hash over its fields.  The leaves of a group (``lang``)
stand in id order; while a level has several nodes, every ``FANOUT``
consecutive ones become one, their hash.  Group roots, in group order, form a
tree of the same kind above.

Subtree exchange: a superblock is ``FANOUT ** LEVELS`` consecutive nodes.
Going up, each superblock is reduced to one node on its own, so a tree of n
leaves takes log(n) / log(4096) rounds over ever smaller tables.  Going down,
the nodes of a superblock and the outer nodes it needs (the siblings on the
path from its top to the root) are cogrouped by superblock in applyInPandas,
which finishes the local levels, joins the proof and folds the leaf.  A task
holds one superblock, whatever a group's size.

Positions come from a range partition by (group, id) with a row number as last
key, so equal ids split too, plus counts per partition.

Defined cases: null fields hash as ``-``; a null id stands before all ids, a
null group before all groups; rows of equal id stand in order of their leaf;
empty and very long texts are texts like others; repeated rows are leaves each; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, save

FANOUT = 8        # fixed value
LEVELS = 4        # levels that one superblock reduces
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")     # fixed order
_ROW = (1 << 33) - 1      # monotonically_increasing_id: partition * 2^33 + row


def leaf_hash(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields: ``-`` or byte count, ``:`` and value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")),
                                        F.lit("-")) for c in fields]), 256)


def n_levels(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _up(nodes: list[str]) -> list[str]:
    return [_hash("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place within ``tree`` by ``order``, and ``n``, the tree's size."""
    placed = save(nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                  .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part")).withColumn("_at", F.col("_at").bitwiseAND(_ROW))
    counts = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per tree and partition: as many rows a tree as there are partitions
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "_part", (before - F.col("_first")).alias("_start"), F.sum("_n").over(of_tree).alias("n"))
    return (placed.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_start"))
            .drop("_at", "_part", "_start"))


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / FANOUT ** levels).cast("long").alias("block")


def _reduce(levels: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        nodes, n = block["node"].tolist(), int(block["n"].iloc[0])
        local = min(levels, n_levels(n))
        for _ in range(local):
            nodes = _up(nodes)
        size = FANOUT ** levels
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "pos": block["block"].iloc[:1], "n": [-(-n // size)],
                             "node": nodes})
    return run


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, node): the tops of the superblocks of nodes (tree, pos, n, node)."""
    return nodes.select("tree", "pos", "n", "node", _block(levels)).groupBy("tree", "block").applyInPandas(
        _reduce(levels), "tree string, pos long, n long, node string")


def local_paths(nodes: list[str], levels: int) -> list[tuple[list[str], list[str]]]:
    """Per node the siblings, joined, left and right of its path at each of ``levels`` levels."""
    by_level = []
    for _ in range(levels):
        sides = []
        for i in range(len(nodes)):
            first = i - i % FANOUT
            sides.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + FANOUT])))
        by_level.append(sides)
        nodes = _up(nodes)
    n = len(by_level[0]) if by_level else len(nodes)
    out = []
    for i in range(n):
        path = [by_level[level][i // FANOUT ** level] for level in range(levels)]
        out.append(([p[0] for p in path], [p[1] for p in path]))
    return out


def _joined(levels: int, last: bool):
    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        above = outer.iloc[0]
        lefts, rights = list(above["lefts"]), list(above["rights"])
        paths = local_paths(block["node"].tolist(), min(levels, n_levels(int(block["n"].iloc[0]))))
        if not last:
            return pd.DataFrame({
                "tree": block["tree"], "pos": block["pos"], "lefts": [a + lefts for a, _ in paths],
                "rights": [b + rights for _, b in paths], "subroot": above["subroot"], "root": above["root"]})
        proofs, folds = [], []
        for (left, right), node, changed in zip(paths, block["node"], block["changed"]):
            sides = list(zip(left + lefts, right + rights))
            proofs.append(_hash("".join(a + b for a, b in sides)))
            h = node if changed is None else changed
            for a, b in sides:
                h = _hash(a + h + b)
            folds.append(h)
        return pd.DataFrame({"id": block["id"], "leaf": block["node"], "subroot": above["subroot"], "root": above["root"],
                             "proof_sha256": proofs, "folded_root": folds})
    return run


_PATHS = "tree string, pos long, lefts array<string>, rights array<string>, subroot string, root string"
_PROVED = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _down(nodes: DataFrame, paths: DataFrame, levels: int, last: bool = False) -> DataFrame:
    """Paths of nodes from the paths (tree, pos) of their superblocks' tops."""
    return (nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
            .cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block"))
            .applyInPandas(_joined(levels, last), _PROVED if last else _PATHS))


def _tower(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes``, the tops of their superblocks, and so on to one node a tree."""
    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tables.append(save(reduced(tables[-1], levels)))
    return tables


def manifest(docs: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             group_col: str = "lang", altered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows of which ``changed`` holds are checked with ``altered`` values (field:
    column) in place of the manifest's; the others as they are.
    """
    here = [F.col(f"`{f}`") for f in fields]
    other = [(altered or {}).get(f, F.col(f"`{f}`")) for f in fields]
    is_changed = F.lit(False) if changed is None else F.coalesce(changed, F.lit(False))
    group = F.col(f"`{group_col}`").cast("string")
    leaves = save(docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), F.col(f"`{id_col}`").alias("id"),
        leaf_hash(*here).alias("node"), F.when(is_changed, leaf_hash(*other)).alias("changed"),
        F.monotonically_increasing_id().alias("row")))
    id_type = dict(leaves.dtypes)["id"]
    placed = positions(leaves, ["id", "node", "row"]).drop("row").withColumn("id", F.col("id").cast("string"))
    placed = save(placed)
    towers = _tower(placed, levels)
    tops = towers[-1].select(F.col("tree").alias("name"), "node", F.lit("").alias("tree"))
    roots = _tower(save(positions(tops, ["name"])), levels)
    none = F.array().cast("array<string>")
    paths = roots[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(roots[:-1]):
        paths = _down(nodes, paths, levels)
    named = roots[0].select("tree", "pos", "name", "node")
    paths = (paths.join(named, ["tree", "pos"])
             .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("node").alias("subroot"), "root"))
    for nodes in reversed(towers[1:-1]):
        paths = _down(nodes, paths, levels)
    proved = _down(placed, paths, levels, last=True)
    return proved.select(F.col("id").cast(id_type).alias("id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(tree_levels: int = 9, root_levels: int = 4) -> str:
    """DuckDB twin for groups of up to 8^tree_levels rows and 8^root_levels groups."""
    def f(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = " || ".join(f(c) for c in FIELDS[:-1])
    parts = [f"""l AS (SELECT doc_id, lang, sha256({rest} || {f("text")}) AS leaf,
        CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({rest} || {f(low)}) END AS changed FROM documents),
    a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
        count(*) OVER (PARTITION BY lang) AS n, leaf AS h, coalesce(changed, leaf) AS fold, '' AS proof FROM l)"""]

    def level(table, nxt, key):
        # siblings from the run's list; the run's hash goes up
        run = f"(SELECT {key} AS k, r, list(h ORDER BY p) AS hs FROM (SELECT DISTINCT {key}, p, p // 8 AS r, h FROM {table} WHERE n > 1) GROUP BY ALL)"
        before, after = "array_to_string(hs[1:(p % 8)::BIGINT], '')", "array_to_string(hs[(p % 8)::BIGINT + 2:], '')"
        return f"""{nxt} AS (SELECT t.* REPLACE (CASE WHEN n > 1 THEN p // 8 ELSE p END AS p, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n,
        CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE h END AS h,
        CASE WHEN n > 1 THEN sha256({before} || fold || {after}) ELSE fold END AS fold,
        CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof)
        FROM {table} t LEFT JOIN {run} g ON t.{key} IS NOT DISTINCT FROM g.k AND t.p // 8 = g.r AND t.n > 1)"""

    for i in range(tree_levels):
        parts.append(level(f"a{i}", f"a{i + 1}", "lang"))
    parts.append(f"""s AS (SELECT lang, any_value(h) AS h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS p FROM a{tree_levels} GROUP BY lang),
    b0 AS (SELECT doc_id, leaf, a.h AS subroot, a.fold, a.proof, s.p, (SELECT count(*) FROM s) AS n, s.h, 0 AS one
           FROM a{tree_levels} a JOIN s ON a.lang IS NOT DISTINCT FROM s.lang)""")
    for i in range(root_levels):
        parts.append(level(f"b{i}", f"b{i + 1}", "one"))
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM b{root_levels}"""


ORACLE = _oracle()
