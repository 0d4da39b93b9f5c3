"""Near-duplicate detection over code / text units.

Unit table columns (see ``changelens.schemas.UNITS``): ``unit_id, repo, file,
name, start_line, line_count, lang_group, code, n_chars, scan_ord``.

Two paths answer "which units of the same group and similar size are near
copies?":

* ``similar_pairs_exact`` - the reference's measure (``difflib`` ratio,
  Ratcliff-Obershelp) on every pair of a size band.  The measure has no exact
  sub-quadratic filter, so the band join is kept, pruned by the lossless
  length bound in the join condition and by difflib's own quick bounds
  before the full ratio; identical texts skip the ratio (exactly 1.0).
  Meant for bounded inputs (one repo, a few thousand units); AQE's skew
  join splits a hot band across tasks.
* ``shingle_similar_pairs`` - the scale path: exact Jaccard over k-word
  shingle sets with the same band rule.  Exact copies (same shingle set) are
  collapsed into copy groups first, candidates come from prefix filtering
  with frequent shingles ordered last (no cap, no sampling: every pair with
  Jaccard >= t shares a prefix shingle), and survivors are verified on the
  full sets.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rounded_ratio
from ..functions.shingles import hashed_sets
from ..session import drop_stored, materialize, ship_package, shuffles_dropped, store
from ..functions.text import line_count as _line_count
from .caps import number_in_order
from .components import connected

# Fixed values taken from the reference's duplicate scan.
MIN_FUNCTION_LINES = 3
SIMILARITY_THRESHOLD = 0.75
BUCKET_SIZE = 5

# Float slack for threshold products (t * n); a smaller alpha only lengthens
# prefixes, which keeps the filter lossless.
_EPS = 1e-9
# Counters of the shingle count (one that several shingles share only moves them in
# the token order), and how many are sent in one row.
_SLOTS = 1 << 20
_SLOT_BLOCK = 1 << 13
# Bits of the filter that spares moving the sets of units without candidates.
FILTER_BITS = 1 << 23
# Shingles of the sets that one cell of the check holds, at most twice this.
BLOCK_TOKENS = 2_000_000
# Pairs that one cell checks, about.
BLOCK_PAIRS = 50_000
# Units whose sets a task holds at once.
_ROWS = 1 << 10


def min_size_filter(units: DataFrame, n: int = MIN_FUNCTION_LINES) -> DataFrame:
    """Keep units with ``line_count >= n`` (line_count = newlines + 1)."""
    if "line_count" not in units.columns:
        units = units.withColumn("line_count", _line_count("code"))
    return units.filter(F.col("line_count") >= n)


def with_bucket(units: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    return units.withColumn("bucket", F.expr(f"line_count div {int(bucket_size)}").cast("int"))


def size_histogram(units: DataFrame, bucket_size: int = BUCKET_SIZE) -> DataFrame:
    """Units per (group, size bucket) and the band pairs each bucket starts.

    ``band_pairs`` = C(n, 2) + n * n(bucket + 1): the number of comparisons the
    band rule asks for, computed from counts only.  This is the blocking-key
    skew report; no pair is materialised.
    """
    hist = (with_bucket(units, bucket_size)
            .groupBy("lang_group", "bucket")
            .agg(F.count(F.lit(1)).alias("n_units")))
    # next bucket's count from the aggregated rows (one row per bucket, so
    # the window per group is small) - no self-join, the input is read once
    w = Window.partitionBy("lang_group").orderBy("bucket")
    nxt = F.lead(F.struct("bucket", "n_units")).over(w)
    return (hist.withColumn("n_next", F.when(nxt["bucket"] == F.col("bucket") + 1, nxt["n_units"]))
            .select("lang_group", "bucket", "n_units",
                    (F.col("n_units") * (F.col("n_units") - 1) / 2).cast("long")
                    .alias("within_pairs"),
                    (F.col("n_units") * F.coalesce(F.col("n_next"), F.lit(0))).cast("long")
                    .alias("next_pairs")))


# ---------------------------------------------------------------------------
# exact path (reference measure)
# ---------------------------------------------------------------------------

_SIDE_COLS = ["unit_id", "repo", "file", "name", "start_line", "line_count",
              "lang_group", "n_chars", "scan_ord", "bucket"]


def candidate_pairs(units: DataFrame, bucket_size: int = BUCKET_SIZE,
                    min_len_ratio: float | None = None, within_repo: bool = False) -> DataFrame:
    """All unit pairs of one group whose buckets differ by at most one.

    ``within_repo`` pairs units of one repo only (a scan of each repo by
    itself); otherwise repos are compared with each other too, and equal
    paths and names in two repos are a pair like any other.

    Equi-join on (group, band key): the left side is exploded to its own bucket
    and the next one, so Catalyst gets a hash-partitionable key instead of a
    theta condition.  Orientation follows the reference: ``a`` is the unit
    with the smaller (bucket, repo, scan_ord, unit_id).  Pairs inside one file
    of one repo with the same name are dropped.  ``min_len_ratio`` adds the lossless length bound
    ``2*min(la, lb)/(la + lb) >= t`` to the join condition.
    """
    u = with_bucket(units, bucket_size).select(*_SIDE_COLS)
    a = u.select(*[F.col(c).alias(f"a_{c}") for c in _SIDE_COLS],
                 F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("band"))
    b = u.select(*[F.col(c).alias(f"b_{c}") for c in _SIDE_COLS])
    cond = [a.a_lang_group == b.b_lang_group, a.band == b.b_bucket]
    if within_repo:
        cond.append(a.a_repo.eqNullSafe(b.b_repo))
    pairs = a.join(b, cond).where(
        ((F.col("b_bucket") == F.col("a_bucket") + 1)
         | (F.struct("a_repo", "a_scan_ord", "a_unit_id") < F.struct("b_repo", "b_scan_ord", "b_unit_id")))
        & ~(F.col("a_repo").eqNullSafe(F.col("b_repo")) & (F.col("a_file") == F.col("b_file"))
            & (F.col("a_name") == F.col("b_name"))))
    if min_len_ratio is not None:
        la, lb = F.col("a_n_chars"), F.col("b_n_chars")
        pairs = pairs.where(2 * F.least(la, lb) >= (la + lb) * F.lit(float(min_len_ratio)) - _EPS)
    return pairs.drop("band")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row per unordered identity pair (repo, file, name, start_line).

    Units with equal identity collapse like the reference's ``seen_pairs``:
    the pair generated first (smallest scan orders) is kept.  An aggregate
    (``min`` of a struct led by the scan orders) rather than a window, so a
    hot identity is combined map-side.
    """
    ida = F.struct(F.col("a_repo").alias("r"), F.col("a_file").alias("f"), F.col("a_name").alias("n"), F.col("a_start_line").alias("l"))
    idb = F.struct(F.col("b_repo").alias("r"), F.col("b_file").alias("f"), F.col("b_name").alias("n"), F.col("b_start_line").alias("l"))
    rest = [c for c in pairs.columns]
    keyed = pairs.withColumn("_k1", F.least(ida, idb)).withColumn("_k2", F.greatest(ida, idb))
    best = (keyed.groupBy("_k1", "_k2")
            .agg(F.min(F.struct(F.col("a_scan_ord").alias("_o1"), F.col("b_scan_ord").alias("_o2"),
                                *[F.col(c) for c in rest])).alias("_p")))
    return best.select(*[F.col(f"_p.{c}").alias(c) for c in rest])


def _ratio_batches(threshold: float):
    def run(batches):
        import difflib

        import pandas as pd
        for pdf in batches:
            keep, sims = [], []
            for a, b in zip(pdf["a_code"].tolist(), pdf["b_code"].tolist()):
                if a == b:                       # identical texts: ratio is exactly 1.0
                    keep.append(1.0 >= threshold)
                    sims.append(1.0)
                    continue
                sm = difflib.SequenceMatcher(None, a, b)
                # quick bounds first (both are upper bounds of ratio())
                if sm.real_quick_ratio() < threshold or sm.quick_ratio() < threshold:
                    keep.append(False)
                    sims.append(0.0)
                    continue
                r = sm.ratio()
                keep.append(r >= threshold)          # threshold before rounding
                sims.append(round(r, 2))             # Python rounding (half-even on binary)
            out = pdf[["a_tk", "b_tk"]].copy()
            out["similarity"] = sims
            yield out[pd.Series(keep, index=pdf.index)]
    return run


def _cpu_partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, 4 * spark.sparkContext.defaultParallelism)


def similar_pairs_exact(units: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                        bucket_size: int = BUCKET_SIZE, within_repo: bool = False) -> DataFrame:
    """Reference-exact near-duplicate pairs (difflib ratio >= threshold).

    Text is fetched late: the band join and length bound run on ids and sizes,
    code is joined only to the distinct text pairs that survive, and the
    ratio runs in Arrow batches (``mapInPandas``); identical texts score 1.0
    without Python.  Output: ``a``/``b`` structs (file, name, line), the
    rounded similarity, and the scan orders used for stable ranking.
    """
    pairs = distinct_pairs(candidate_pairs(units, bucket_size, threshold, within_repo))
    # Texts are keyed by SHA-256: a pair of identical texts has ratio 1.0 and
    # never leaves the JVM, and each distinct ordered text pair is scored once
    # however many unit pairs share it (a hot group of copies costs no Python).
    tkey = units.select("unit_id", F.sha2("code", 256).alias("tk"))
    keyed = (pairs
             .join(tkey.select(F.col("unit_id").alias("a_unit_id"), F.col("tk").alias("a_tk")), "a_unit_id")
             .join(tkey.select(F.col("unit_id").alias("b_unit_id"), F.col("tk").alias("b_tk")), "b_unit_id"))
    texts = units.groupBy(F.sha2("code", 256).alias("tk")).agg(F.min_by("code", "unit_id").alias("code"))
    text_pairs = (keyed.filter(F.col("a_tk") != F.col("b_tk")).select("a_tk", "b_tk").distinct()
                  .join(texts.select(F.col("tk").alias("a_tk"), F.col("code").alias("a_code")), "a_tk")
                  .join(texts.select(F.col("tk").alias("b_tk"), F.col("code").alias("b_code")), "b_tk"))
    schema = T.StructType([T.StructField("a_tk", T.StringType()), T.StructField("b_tk", T.StringType()),
                           T.StructField("similarity", T.DoubleType())])
    # The ratio is CPU-bound while the rows are small, so AQE's byte-based
    # coalescing would leave few Python workers: spread by pair explicitly.
    text_pairs = text_pairs.repartition(_cpu_partitions(units), "a_tk", "b_tk")
    # the ratios are the expensive part: written once (small: two keys and a
    # score per surviving text pair), so no later stage re-runs Python
    scores = materialize(text_pairs.mapInPandas(_ratio_batches(float(threshold)), schema))
    same = keyed.filter(F.col("a_tk") == F.col("b_tk")).withColumn("similarity", F.lit(1.0))
    diff = keyed.join(scores, ["a_tk", "b_tk"])
    scored = same.unionByName(diff)
    return scored.select(
        F.col("a_lang_group").alias("lang_group"),
        F.struct(F.col("a_file").alias("file"), F.col("a_name").alias("name"),
                 F.col("a_start_line").alias("line")).alias("a"),
        F.struct(F.col("b_file").alias("file"), F.col("b_name").alias("name"),
                 F.col("b_start_line").alias("line")).alias("b"),
        "similarity", "a_repo", "b_repo", "a_unit_id", "b_unit_id", "a_scan_ord", "b_scan_ord")


def rank_pairs(pairs: DataFrame, score: str = "similarity",
               ties: tuple[str, ...] = ("a_scan_ord", "b_scan_ord")) -> DataFrame:
    """Order by score descending; ties by the two scan orders (stable)."""
    return pairs.orderBy(F.col(score).desc(), *ties)


# ---------------------------------------------------------------------------
# scale path: exact shingle Jaccard with copy collapse and prefix filtering
# ---------------------------------------------------------------------------

class Shingled(NamedTuple):
    """Units, and of each what places it and names its shingle set."""

    units: DataFrame
    keys: DataFrame


# What names a set: units that agree in these are copies.
_SET = ["lang_group", "scope", "bucket", "n", "set_key", "set_check"]


def shingled(units: DataFrame, k: int = 5, bucket_size: int = BUCKET_SIZE) -> Shingled:
    """The units with their sets' keys (128 bits and the size), written once to the
    checkpoint folder, for several calls of ``shingle_similar_pairs``, ``copy_groups``
    and ``near_families``.  A set takes more room than its text, so the sets are
    made again from the texts, not stored."""
    return Shingled(units, store(_keyed(units, k, bucket_size)))


def _placed(units: DataFrame, bucket_size: int) -> DataFrame:
    # Scan order restarts in every repo: the order of units is by repo first.
    place = F.struct("repo", "scan_ord", "unit_id").alias("place")
    return with_bucket(units, bucket_size).select("unit_id", "repo", place, "lang_group", "bucket", "code")


def _parts(batches):
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _with_keys(k: int):
    """Rows with ``code`` last -> n, set_key and set_check in its place."""
    def run(batches):
        for b in _parts(batches):
            sets = hashed_sets(b.column(b.num_columns - 1), k)
            keys = np.frombuffer(b"".join(_set_key(s) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([len(s) for s in sets], pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                names=[*b.schema.names[:-1], "n", "set_key", "set_check"])
    return run


def _keyed(units: DataFrame, k: int, bucket_size: int) -> DataFrame:
    ship_package(units.sparkSession)
    rows = _placed(units, bucket_size)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.IntegerType()),
                           T.StructField("set_key", T.LongType()), T.StructField("set_check", T.LongType())])
    return rows.mapInArrow(_with_keys(k), schema)


def _with_sets(k: int, first, wanted):
    """(lang_group, scope, bucket, ..., code) rows -> nid, n and sh in place of code: of
    each set its hashes ``first(set)``; of numbers whose bit is set in ``wanted`` only."""
    def run(batches):
        for b in _parts(batches):
            sets = hashed_sets(b.column(b.num_columns - 1), k)
            group, scope, bucket = (b.column(i).to_pylist() for i in range(3))
            nid = np.array([int.from_bytes(hashlib.blake2b(repr((g, sc, bu, len(s))).encode() + _set_key(s), digest_size=8).digest(), "little", signed=True)
                            for g, sc, bu, s in zip(group, scope, bucket, sets)], np.int64)
            keep = np.array([len(s) > 0 for s in sets], bool)
            if wanted is not None:
                slot = nid & (FILTER_BITS - 1)
                keep &= (wanted.value[slot >> 3] >> (slot & 7)) & 1 == 1
            at = np.flatnonzero(keep)
            b = b.take(pa.array(at))
            n = pa.array([len(sets[i]) for i in at], pa.int32())
            sh = pa.array([first(sets[i]).view(np.int64) for i in at], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, pa.array(nid[at]), sh], names=[*b.schema.names[:-1], "n", "nid", "sh"])
    return run


def _representatives(units: DataFrame | Shingled, k: int, bucket_size: int, within_repo: bool = False,
                     first=None, wanted=None) -> DataFrame:
    """One row per identical shingle set inside (group, bucket), and inside the
    repo when pairs are ``within_repo``; ``nid`` numbers it, ``sh`` has its
    hashes, or of them ``first(set)``.  With ``wanted``, a broadcast bitmap, only sets
    whose number it lets pass.

    Grouped on a number made of the set's key: the map-side partial aggregate
    collapses copies before the shuffle, so a copy group holding a third of all
    rows sends one row per map task, and later joins on ``nid`` keep this
    partitioning.  The representative is the member with the smallest scan order.
    Units without words have no row.
    """
    units = units.units if isinstance(units, Shingled) else units
    ship_package(units.sparkSession)
    scope = F.when(F.lit(within_repo), F.col("repo")).alias("scope")
    rows = _placed(units, bucket_size).select("lang_group", scope, "bucket", "place", "code")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.IntegerType()), T.StructField("nid", T.LongType()),
                           T.StructField("sh", T.ArrayType(T.LongType()))])
    rows = rows.mapInArrow(_with_sets(k, first or _whole, wanted), schema)
    # One struct: column pruning cannot drop parts of it, so all readers share one exchange.
    agg = rows.groupBy("nid").agg(
        F.struct(F.min("place").alias("place"), F.count(F.lit(1)).alias("n_copies"),
                 *[F.first(c).alias(c) for c in ("lang_group", "scope", "bucket", "n", "sh")]).alias("r"))
    return agg.select("nid", F.col("r.place.unit_id").alias("unit_id"), "r.*")


def _whole(s: np.ndarray) -> np.ndarray:
    return s


def copy_groups(units: DataFrame | Shingled, k: int = 5, bucket_size: int = BUCKET_SIZE,
                materialize_keys: bool = True, within_repo: bool = False) -> DataFrame:
    """Units grouped by identical shingle set inside (group, bucket).

    One row per unit: its representative and the group size.  Exact copies
    are reported here instead of as all-pairs, so a group holding a third of
    the rows costs one aggregate, not n^2 rows.  Units without words are left
    out.  The join back to the units is on a hashed set
    key; AQE's skew join splits a hot group's partition.
    """
    if isinstance(units, Shingled):
        keyed = units.keys
    else:
        keyed = _keyed(units, k, bucket_size)
        if materialize_keys:
            # two branches (aggregate, join back) read the keys: write the small
            # keyed table once instead of making the sets twice
            keyed = store(keyed)
    keyed = keyed.withColumn("scope", F.when(F.lit(within_repo), F.col("repo")))
    groups = (keyed.groupBy(*_SET)
              .agg(F.min("place")["unit_id"].alias("rep_id"),
                   F.count(F.lit(1)).alias("n_copies"),
                   F.max("n").alias("_n"))
              .filter(F.col("_n") > 0)       # aggregate output: not pushed down
              .drop("_n"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"g.{c}")) for c in _SET]
    return (keyed.alias("k").join(groups.alias("g"), same)
            .select("unit_id", "k.repo", "k.lang_group", "k.bucket", "rep_id", "n_copies"))


def prefix_length(n_col, threshold: float):
    """|x| - ceil(t*|x|) + 1: any set with Jaccard >= t shares a token in it."""
    return n_col - F.ceil(n_col * F.lit(float(threshold)) - F.lit(_EPS)) + 1


def _slot_counts(k: int):
    """Rows with ``code`` or ``sh`` -> this task's counts of shingles by slot, in blocks."""
    def run(batches):
        counts = np.zeros(_SLOTS, np.int32)
        for b in _parts(batches):
            c = b.column(0)
            sets = c.flatten().to_numpy() if pa.types.is_list(c.type) else np.concatenate(hashed_sets(c, k)).view(np.int64)
            counts += np.bincount(sets & (_SLOTS - 1), minlength=_SLOTS).astype(np.int32)
        blocks = counts.reshape(-1, _SLOT_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())],
                                         names=["block", "counts"])
    return run


def _add_counts(batches):
    sums: dict = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[i] = sums.get(i, 0) + np.frombuffer(v, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                     names=["block", "counts"])


def _heavy_tokens(rows: DataFrame, min_df: int, max_tokens: int | None, fraction: float, k: int = 5) -> list[int]:
    """Slots (the last bits) of the most frequent shingles, the most frequent first.

    Counted over ``fraction`` of the rows (with sets, or units), kept when the count
    reaches ``min_df * fraction``, at most ``max_tokens`` of them.  The list only
    orders tokens, so it cannot change any result; a task sends ``_SLOTS``
    counters at most, and so many reach the driver.
    """
    ship_package(rows.sparkSession)
    src = rows if fraction >= 1.0 else rows.sample(fraction=fraction, seed=17)
    blocks = src.select("sh" if "sh" in src.columns else "code").mapInArrow(_slot_counts(k), "block int, counts binary")
    counts = np.zeros((_SLOTS // _SLOT_BLOCK, _SLOT_BLOCK), np.int64)
    with shuffles_dropped(rows.sparkSession):
        for r in blocks.repartition(_SLOTS // _SLOT_BLOCK, "block").mapInArrow(_add_counts, "block int, counts binary").collect():
            counts[r["block"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    at = np.flatnonzero(counts >= max(1, math.ceil(min_df * min(fraction, 1.0))))
    return at[np.argsort(-counts[at], kind="stable")][:max_tokens].tolist()


def _first_tokens(spark, heavy: list[int], threshold: float):
    """The prefix of a set: its shingles by (how frequent, hash), the rarest first.  The
    order is one byte per slot, finer the more frequent, sent once to each executor."""
    level = np.zeros(_SLOTS, np.uint8)
    level[heavy] = 255 - (12 * np.log2(1 + np.arange(len(heavy)))).astype(np.uint8)
    sent = spark.sparkContext.broadcast(level)

    def first(s):
        order = np.argsort(sent.value[(s & np.uint64(_SLOTS - 1)).astype(np.int64)], kind="stable")
        return s[order][:prefix_len_py(len(s), threshold)]
    return first


def shingle_similar_pairs(units: DataFrame | Shingled, k: int = 5, threshold: float = SIMILARITY_THRESHOLD,
                          bucket_size: int = BUCKET_SIZE, heavy_min_df: int = 2, heavy_max: int | None = None,
                          heavy_fraction: float = 1.0, within_repo: bool = False) -> DataFrame:
    """Pairs of representatives with shingle Jaccard >= threshold, same band;
    of one repo only with ``within_repo``, else of all repos.

    Steps (sets are made by numpy in Arrow tasks, each time from the texts):
      1. shingles counted by slot over all units: the order of tokens;
      2. identical sets collapse per (group, bucket) -> representatives with the
         prefix of their shingles in that order, the rarest first;
      3. self-join of the prefixes on (group, shingle), one exchange for both
         sides, band rule, length and position bounds -> candidates, stored;
      4. the whole sets of candidates only, moved to the cells in which their pairs
         are checked (see ``_verified``).
    Output: ``lang_group, a_id, b_id, a_copies, b_copies, inter, union_size``
    with ``a`` the smaller (bucket, scan_ord).  ``inter``/``union_size`` are
    integers so both engines agree without rounding.
    """
    src = units.units if isinstance(units, Shingled) else units
    heavy = _heavy_tokens(src, heavy_min_df, heavy_max, heavy_fraction, k)
    reps = _representatives(src, k, bucket_size, within_repo, _first_tokens(src.sparkSession, heavy, threshold))
    cand = store(_candidates(_met(_prefixes(reps)), threshold))
    found = _verified(cand, src, k, bucket_size, within_repo, threshold)
    return found.select("lang_group", "a_id", "b_id", "a_copies", "b_copies", "inter", "union_size")


def _prefixes(reps: DataFrame) -> DataFrame:
    """tok, nid, bucket, n, pos: one row per representative and shingle of its
    prefix (``sh``), with the shingle's position in the set's order; ``tok`` stands for
    the shingle within its group and scope.

    Any order shared by all units of a group keeps prefix filtering exact; putting
    the frequent shingles last keeps the posting lists short.  Units without
    an id or a group are in no pair.
    """
    rows = reps.filter("unit_id is not null and lang_group is not null").select(
        "nid", "bucket", "n", "lang_group", F.coalesce("scope", F.lit("")).alias("scope"), F.posexplode("sh").alias("pos", "t"))
    return rows.select(F.xxhash64("lang_group", "scope", "t").alias("tok"), "nid", "bucket", "n", "pos")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("tok", *[F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "tok"])


def _met(prefix: DataFrame) -> DataFrame:
    """Pairs of rows of one token whose buckets are equal or neighbours, each once;
    both sides are the same exchange."""
    band = ((F.col("b_bucket") == F.col("a_bucket") + 1)
            | ((F.col("b_bucket") == F.col("a_bucket")) & (F.col("a_nid") < F.col("b_nid"))))
    return _side(prefix, "a").join(_side(prefix, "b"), "tok").where(band)


def _candidates(met: DataFrame, threshold: float, all_met: bool = True) -> DataFrame:
    """Of rows that met at a shared shingle, the pairs (a, b) that may be similar,
    with their sizes and the least ``tok`` of those shingles.

    Sizes must be near enough, and so must the positions: in one common order,
    what two sets share is at most the smaller number of shingles before the
    shared one, itself, and the smaller number after it.  Where ``all_met``, each
    pair met at every shingle that both prefixes hold: the prefix that ends first
    shares these and no others, so what two sets share is at most their number and
    what lies behind that prefix.
    """
    t = float(threshold)
    sizes = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(t) - F.lit(_EPS)
    most = (F.least("a_pos", "b_pos") + 1
            + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1)
    reach = most * F.lit(1 + t) >= (F.col("a_n") + F.col("b_n")) * F.lit(t) - F.lit(_EPS)
    pairs = (met.where(sizes & reach).groupBy(F.col("a_nid").alias("a"), F.col("b_nid").alias("b"), "a_n", "b_n")
             .agg(F.min("tok").alias("tok"), F.count(F.lit(1)).alias("c")))
    if all_met:
        behind = F.greatest(*[F.col(n) - prefix_length(F.col(n), t) for n in ("a_n", "b_n")])
        pairs = pairs.where((F.col("c") + behind) * F.lit(1 + t) >= (F.col("a_n") + F.col("b_n")) * F.lit(t) - F.lit(_EPS))
    return pairs.drop("c")


def _wanted(spark, cand: DataFrame):
    """The candidates' numbers as a bitmap of ``FILTER_BITS``, sent once to each executor."""
    at = F.col("nid").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1          # bit positions count from 1
    with shuffles_dropped(spark):
        filled = (cand.select(F.explode(F.array("a", "b")).alias("nid"))
                  .groupBy(F.bitmap_bucket_number(at).alias("part"))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in filled:
        start = (r["part"] - 1) * 4096
        bits[start:start + 4096] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits)


def _check_cells(threshold: float):
    """Rows (tok, lo, hi, node, mate, sh, m) sorted by cell, the sets (no mate) first ->
    of its pairs (node, mate) those that reach the threshold."""
    def run(batches):
        cell, held = None, {}
        for b in batches:
            tok, lo, hi, node = (b.column(i).to_pylist() for i in range(4))
            mate, sh, m = b.column(4).to_pylist(), b.column(5), b.column(6)
            out = []
            for i, mine in enumerate(zip(tok, lo, hi)):
                if mine != cell:
                    cell, held = mine, {}
                if mate[i] is None:
                    held[node[i]] = (np.array(sh[i].values.to_numpy()), m[i].as_py())
                    continue
                (x, mx), (y, my) = held[node[i]], held[mate[i]]
                if mx["lang_group"] == my["lang_group"] and mx["scope"] == my["scope"]:
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    if inter >= (len(x) + len(y) - inter) * threshold:
                        out.append((node[i], mate[i], mx, my, inter, len(x) + len(y) - inter))
            cols = [[r[c] for r in out] for c in range(6)]
            types = [pa.int64(), pa.int64(), m.type, m.type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["a", "b", "a_m", "b_m", "inter", "union_size"])
    return run


def _verified(cand: DataFrame, units: DataFrame, k: int, bucket_size: int, within_repo: bool, threshold: float) -> DataFrame:
    """Candidates (a, b) that reach the threshold on the full sets, with their
    units' ids in order and their counts.

    A pair is checked in the cell of its token, so a set is moved once for each token
    at which it has candidates, not for each pair.  Cells of more than
    ``BLOCK_TOKENS`` shingles or ``BLOCK_PAIRS`` pairs are parted: every pair of parts
    is a cell of its own.
    """
    spark = cand.sparkSession
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("node"), F.col("b_n").alias("n")))
    load = cand.select("tok", F.inline(ends)).distinct().groupBy("tok").agg(F.sum("n").alias("load"))
    many = cand.groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
    load = load.join(many, "tok").select(
        "tok", F.greatest(F.ceil(F.col("load") / BLOCK_TOKENS), F.ceil(F.sqrt(F.col("c") * 2 / BLOCK_PAIRS))).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int")
    pairs = store(cand.join(load, "tok").select("tok", F.least(part("a"), part("b")).alias("lo"),
                                                F.greatest(part("a"), part("b")).alias("hi"), "a", "b"))
    need = store(pairs.select("tok", "lo", "hi", F.explode(F.array("a", "b")).alias("node")).distinct())
    meta = ["place", "n_copies", "lang_group", "scope", "bucket"]
    reps = _representatives(units, k, bucket_size, within_repo, wanted=_wanted(spark, cand))
    sets = need.join(reps, F.col("node") == F.col("nid")).select(
        "tok", "lo", "hi", "node", F.lit(None).cast("long").alias("mate"), "sh", F.struct(*meta).alias("m"))
    blank = [F.lit(None).cast(sets.schema[c].dataType).alias(c) for c in ("sh", "m")]
    rows = sets.unionByName(pairs.select("tok", "lo", "hi", F.col("a").alias("node"), F.col("b").alias("mate"), *blank))
    m = sets.schema["m"].dataType
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("a_m", m),
                           T.StructField("b_m", m), T.StructField("inter", T.LongType()), T.StructField("union_size", T.LongType())])
    found = (rows.repartition("tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi", F.col("mate").asc_nulls_first())
             .mapInArrow(_check_cells(float(threshold)), schema))
    # ``a`` is the unit of the smaller bucket, else the first in scan order
    apart = F.col("b_m.bucket") - F.col("a_m.bucket")
    turned = (apart == -1) | ((apart == 0) & (F.col("b_m.place") < F.col("a_m.place")))
    pick = lambda x, y, c: F.when(turned, F.col(f"{y}_m.{c}")).otherwise(F.col(f"{x}_m.{c}"))
    found = found.where((F.abs(apart) == 1) | ((apart == 0) & (F.col("a_m.place") != F.col("b_m.place"))))
    return found.select("a", "b", F.col("a_m.lang_group").alias("lang_group"), pick("a", "b", "place.unit_id").alias("a_id"),
                        pick("b", "a", "place.unit_id").alias("b_id"), pick("a", "b", "n_copies").alias("a_copies"),
                        pick("b", "a", "n_copies").alias("b_copies"), "inter", "union_size")


# Rounds of pivots before what is left of the lists is compared between groups.
PIVOT_ROUNDS = 2


def near_families(units: DataFrame | Shingled, k: int = 5, threshold: float = SIMILARITY_THRESHOLD,
                  bucket_size: int = BUCKET_SIZE, within_repo: bool = False, rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """(unit_id, repo, lang_group, rep_id, family_id, family_size): units connected by
    chains of similar pairs, the same pairs that ``shingle_similar_pairs`` gives.

    A family of m near copies costs a few rows a unit instead of m * (m - 1) / 2
    pairs: in every posting list (shingle, size bucket) all are compared with
    one pivot, the first by bucket, and those found similar form a group.
    What the pivot does not take meets the next pivot, ``rounds`` times.  Only
    then are members of a list compared pair by pair, and only those that are
    still in different groups, so no link between groups is lost.  ``family_id`` is the
    smallest representative of the family; units without words are left out.
    """
    s = units if isinstance(units, Shingled) else shingled(units, k, bucket_size)
    heavy = _heavy_tokens(s.units, 2, None, 1.0, k)
    firsts = store(_representatives(s, k, bucket_size, within_repo, _first_tokens(s.units.sparkSession, heavy, threshold)))
    rows = _prefixes(firsts)
    # tokens of one representative are done; both sides of this join are one exchange
    shared = rows.groupBy("tok").agg(F.min("nid").alias("x"), F.max("nid").alias("y")).filter("x <> y").select("tok")
    prefix = store(rows.join(shared.hint("merge"), "tok", "left_semi"))
    reps = store(firsts.select("nid"))
    drop_stored(firsts)

    def verified(met, all_met):
        cand = store(_candidates(met, threshold, all_met))
        return _verified(cand, s.units, k, bucket_size, within_repo, threshold).select("a", "b", "a_id", "b_id")

    lists = ["tok", "meet"]
    # the left side holds every member of a list: a unit stands in those of its bucket and the next
    open_ = prefix.select("tok", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("meet"),
                          F.struct("bucket", "nid", "n", "pos").alias("u"))
    links = None
    groups = reps.select(F.col("nid").alias("node"), F.col("nid").alias("family"))
    for _ in range(rounds):
        pivots = open_.groupBy(*lists).agg(F.min("u").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
        met = open_.join(pivots, lists).filter(F.col("u.nid") != F.col("p.nid"))
        met = met.select("tok", *[F.col(f"p.{c}").alias(f"a_{c}") for c in ("nid", "n", "pos")], *[F.col(f"u.{c}").alias(f"b_{c}") for c in ("nid", "n", "pos")])
        # a pivot meets the others in some of their common lists only
        found = verified(met, False)
        links = store(found if links is None else links.unionByName(found))
        stars = connected(links, "a", "b")
        groups = store(reps.select("nid").join(stars, F.col("nid") == F.col("node"), "left")
                             .select(F.col("nid").alias("node"), F.coalesce("family", "nid").alias("family")))
        # lists whose members are all in one group are done; so are the pivot and its group
        grouped = open_.join(groups, F.col("u.nid") == F.col("node")).drop("node")
        pivot_group = pivots.join(groups, F.col("p.nid") == F.col("node")).select(*lists, F.col("family").alias("_done"))
        left = store(grouped.join(pivot_group, lists).filter("family <> _done").select(*lists, "u"))
        if left.isEmpty():
            break
        open_ = left
    in_list = prefix.join(groups, F.col("nid") == F.col("node")).drop("node")
    mixed = in_list.groupBy("tok").agg(F.min("family").alias("x"), F.max("family").alias("y")).filter("x <> y").select("tok")
    apart = store(in_list.join(mixed, "tok", "left_semi"))
    met = _met(apart).filter("a_family <> b_family")
    # lists of one family are gone: no two families meet in them
    links = store(links.unionByName(verified(met, True)))
    copies = copy_groups(s, k, bucket_size, within_repo=within_repo)
    named = copies.join(connected(links).withColumnRenamed("node", "rep_id"), "rep_id", "left").withColumn("family_id", F.coalesce("family", "rep_id"))
    sizes = named.groupBy("family_id").agg(F.count(F.lit(1)).alias("family_size"))
    return named.join(sizes, "family_id").select("unit_id", "repo", "lang_group", "rep_id", "family_id", "family_size")


def rank_in_repo(pairs: DataFrame, ties: tuple[str, ...] = ("a_id", "b_id")) -> DataFrame:
    """Pairs (repo, inter, union_size) with ``similarity``, rounded to two places as
    Python does, and ``rank``, from 1, within the repo's list: highest rounded
    similarity first, then ``ties``.  Numbered by ranges, so a repo with very
    many pairs is not one task."""
    scored = pairs.withColumn("similarity", rounded_ratio(F.col("inter"), F.col("union_size")))
    return number_in_order(scored.withColumn("_down", -F.col("similarity")), ["repo"], ["_down", *ties], out="rank").drop("_down")


def prefix_len_py(n: int, threshold: float) -> int:
    """Python twin of ``prefix_length`` (tests)."""
    return n - math.ceil(n * threshold - _EPS) + 1
