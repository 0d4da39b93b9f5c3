"""N-gram Jaccard join: groups of documents linked by shingle similarity.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of
distinct k-word shingles (A-Z lower-cased; a text of fewer than k words is one
shingle).  The join is exact and gives connected groups, not lists of pairs.

1. Documents with the same set collapse to one node (combined map-side), so
   copies are never compared.
2. A set that reaches the similarity with another one shares one of its first
   n - ceil(percent n / 100) + 1 tokens, in any order common to all.  Tokens
   come by how often a fixed-size count of all documents meets them, the rarest first.
   Tokens at which no two nodes can be similar are dropped.
3. Connecting: nodes with the same first token meet in signature trees (see
   ``signature_tree``) over their bitmaps.  A pair that the bitmaps allow is
   noted and its nodes count as one group from then on, so a family of near
   copies gives about one pair a copy; the pairs are checked on whole sets.
   Large buckets are cut into blocks of bounded size, and one node of each
   group found meets the others again.
4. Completing: wherever nodes of different (checked) groups share any prefix
   token, signature trees give pairs that the bitmaps and the token's places
   allow, again only as many as connect them, checked on whole sets.  Tokens
   with a pair that fails are looked at again by finer bitmaps, and those that
   fail then by trees over the whole sets, which note only pairs that hold.  A
   pair is looked at where it first meets: rows carry their node's first
   tokens, and tokens that follow one in common skip it.

Whole sets are read from the texts again, for the nodes of noted pairs and of
the tokens that failed twice only.

No link between different texts is lost: step 4 looks at every pair that the
prefixes allow and that step 3 has not already put into one group.

Defined cases: null, empty and blank texts have no shingles and link with
nothing; very long texts are read whole; of repeated rows each gets the same
answer; null ids are never a component's smallest id unless all are null; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shingles
from . import signature_tree as tree
from .common import FILTER_BITS, discard, fresh, save, without
from .graphs import components

SKETCH = 1 << 20           # counters of the token count, whatever the corpus size
SKETCH_BLOCK = 1 << 13
LEVELS = 8                 # steps of the tokens' order while a counter doubles
NODE_BITS = 4              # bitmap bits per token, connecting step
SMALL_BITS = 1             # the same, completing step: sent once per shared token
SMALL_WIDTH = 512          # bitmaps of the completing step have NODE_BITS a token up to this width
FINE_WIDTH = 4096          # the same, where its pairs failed
WHOLE_BITS = 16            # bitmap bits per token over whole sets, made where they are compared
EARLIER = 32               # tokens of a node that its rows carry
MAX_BITS = 1 << 16
BLOCK_TOKENS = 4_000_000   # tokens of the sets whose bitmaps one tree holds
BLOCK_NODES = 4096         # bitmaps one tree holds in the completing step
SLICE_BYTES = 1 << 20      # of texts whose words are hashed at once
SLICE_ROWS = 1 << 10       # of texts whose sets are held at once


def shingle_sets(texts, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text (an Arrow column or a list), A-Z lower-cased."""
    return shingles.hashed_sets(texts, k, lower=True, slice_bytes=SLICE_BYTES)


def _parts(batches):
    """The batches in parts of at most SLICE_ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


_FIRST_PASS = "doc_id long, n long, key binary, block int, counts binary"


def _keys_and_counts(k: int):
    """Every document's set size and key; then this task's token counts."""
    def run(batches):
        counts = np.zeros(SKETCH, np.int32)
        for b in _parts(batches):
            sets = shingle_sets(b.column(1), k)
            slots = np.concatenate(sets) & np.uint64(SKETCH - 1)
            counts += np.bincount(slots.view(np.int64), minlength=SKETCH).astype(np.int32)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([_key(x) for x in sets], pa.binary()),
                none.cast(pa.int32()), none.cast(pa.binary())], names=["doc_id", "n", "key", "block", "counts"])
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([
            none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used, pa.int32()),
            pa.array([blocks[i].tobytes() for i in used], pa.binary())],
            names=["doc_id", "n", "key", "block", "counts"])
    return run


def _add_counts(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(v, np.int32).astype(np.int64)
            sums[i] = sums[i] + v if i in sums else v
    levels = [np.minimum(LEVELS * np.log2(1 + v), 255).astype(np.uint8) for v in sums.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in levels], pa.binary())], names=["block", "levels"])


def frequency_levels(counts: DataFrame) -> np.ndarray:
    """Per counter the logarithm of what it holds.  Every step tells tokens apart: were all
    up to some multiple of the mean alike, their lists would grow with the corpus."""
    levels = counts.repartition(SKETCH // SKETCH_BLOCK, "block").mapInArrow(_add_counts, "block int, levels binary")
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint8)
    for r in levels.collect():          # SKETCH bytes
        out[r["block"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def prefix_length(n: int, percent: int) -> int:
    return n + 1 - -(-percent * n // 100)


def _node_rows(k: int, percent: int, levels):
    def run(batches):
        level = levels.value
        for b in _parts(batches):
            sets = shingle_sets(b.column(1), k)
            prefixes = []
            for s in sets:
                p = prefix_length(len(s), percent) if len(s) else 0
                first = s[np.argsort(level[s & np.uint64(SKETCH - 1)], kind="stable")][:p]
                prefixes.append(first.view(np.int64))
            bits = [_bits(s, NODE_BITS) for s in sets]
            small = [tree.fold(np.frombuffer(x, np.uint64), _narrow_width(len(s), SMALL_WIDTH) // 64).tobytes()
                     for s, x in zip(sets, bits)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_key(s) for s in sets], pa.binary()),
                pa.array(prefixes, pa.list_(pa.int64())),
                pa.array(bits, pa.binary()), pa.array(small, pa.binary())],
                names=["doc_id", "n", "key", "prefix", "bits", "small"])
    return run


def _bits(s: np.ndarray, per_token: int) -> bytes:
    return tree.bits_of(s, min(tree.width_for(max(len(s), 1), per_token), MAX_BITS)).tobytes()


def _narrow_width(n: int, fine: int) -> int:
    """Fine for small sets, whose bitmaps would else let too many pairs pass; coarse
    for large ones.  Widths of similar sets are equal or neighbours, as in ``_bits``."""
    n = max(n, 1)
    return min(max(tree.width_for(n, SMALL_BITS), min(tree.width_for(n, NODE_BITS), fine)), MAX_BITS)


def _small_bits(s: np.ndarray) -> bytes:
    return tree.bits_of(s, _narrow_width(len(s), SMALL_WIDTH)).tobytes()


def _fine(batches):
    """(nid, n, bits) rows with the bitmaps folded to their finer width in the completing step."""
    for b in batches:
        bits = [tree.fold(np.frombuffer(x, np.uint64), _narrow_width(n, FINE_WIDTH) // 64).tobytes()
                for n, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=b.schema.names)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _set_rows(k: int, wanted):
    """(slot, doc_id, text) rows whose slot is wanted -> their sets."""
    def run(batches):
        bits = wanted.value
        for b in _parts(batches):
            slot = np.asarray(b.column(0))
            b = b.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 == 1))
            sets = shingle_sets(b.column(2), k)
            yield pa.RecordBatch.from_arrays([
                b.column(1), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "key", "tokens"])
    return run


def runs(batches, n_keys: int):
    """Tables of the rows that agree in the first ``n_keys`` columns (batches
    come sorted by them).  A run is held whole; its size is bounded by blocks."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(i)) for i in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1, b.num_rows]
        for s, e in zip(starts[:-1], starts[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


_LINKS = "a long, b long"


def _links(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _changes(b: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Whether each row but the first differs from the one before in the first ``n_keys`` columns."""
    change = np.zeros(b.num_rows - 1, bool)
    for i in range(n_keys):
        c = np.asarray(b.column(i))
        change |= c[1:] != c[:-1]
    return change


def _whole_runs(batches, n_keys: int):
    """The rows in batches that end where a run of equal keys does."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.flatnonzero(_changes(b, n_keys))
        cut = int(change[-1]) + 1 if len(change) else 0        # the last run may go on
        if held and not cut and all(held[0].column(i)[0] == b.column(i)[0] for i in range(n_keys)):
            held.append(b)
            continue
        if held or cut:
            yield pa.concat_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def _row_runs(batches, n_keys: int, percent: int):
    """Lists of (nid, group, n, left, bits) rows, and what follows, in order of size, that
    agree in the first ``n_keys`` columns (batches come sorted by them); their size is
    bounded by blocks.  Rows that can be similar to no other by ``n`` and ``left`` are left out."""
    for b in _whole_runs(batches, n_keys):
        run = np.r_[0, np.cumsum(_changes(b, n_keys))]
        nid, n, left = (np.asarray(b.column(n_keys + i)) for i in (0, 2, 3))
        order = np.lexsort((nid, n, run))
        run, n, left = run[order], n[order], left[order]
        # what is shared is at most left, so another set's size is at most this
        most = np.clip(left * (100 + percent) // percent - n, 0, (1 << 40) - 1)
        same = run[1:] == run[:-1]
        keep = np.zeros(len(n), bool)
        keep[:-1] = same & (n[1:] <= most[:-1])
        reached = np.maximum.accumulate((run << 40) + most) & ((1 << 40) - 1)
        keep[1:] |= same & (n[1:] <= reached[:-1])
        run = run[keep]
        if not len(run):
            continue
        b = b.take(pa.array(order[keep]))
        rows = list(zip(*[b.column(i).to_pylist() for i in range(n_keys, b.num_columns)]))
        tokens = np.asarray(b.column(0))
        at = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
        for s, e in zip(at[:-1], at[1:]):
            yield int(tokens[s]), rows[s:e]


def _tree_pairs(rows: list[tuple], percent: int, connect: bool, note, whole: bool = False) -> None:
    """The pairs of rows (in order of size) that the bitmaps and ``left`` allow.  Rows may
    end in earlier tokens of theirs: pairs that share one of them are left out.  With
    ``whole`` rows hold their sets instead of bitmaps, and only similar pairs are noted."""
    nid = [r[0] for r in rows]
    sizes, left = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
    bits = sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    if whole:
        bits = [np.frombuffer(_bits(s, WHOLE_BITS), np.uint64) for s in sets]
    words = np.array([len(x) for x in bits])
    groups = tree.Groups([r[1] for r in rows])
    earlier = [frozenset(r[5]) for r in rows] if len(rows[0]) > 5 else None
    # sizes of similar sets are at most 100 / percent times each other, and so are widths
    steps = (-(-100 // percent) - 1).bit_length()
    widths = sorted(set(words.tolist()))
    for w in widths:
        at = list(range(len(rows))) if len(widths) == 1 else np.flatnonzero((words >= w) & (words <= w << steps)).tolist()
        if len(at) < 2:
            continue
        own = tree.Groups([groups.find(i) for i in at])

        def check(i, j):
            x, y = at[i], at[j]
            if (words[x] == w or words[y] == w) and (earlier is None or earlier[x].isdisjoint(earlier[y])) \
                    and (not whole or _similar(sets[x], sets[y], percent)):
                note(nid[x], nid[y])
                if connect:
                    own.join(i, j)
                    groups.join(x, y)

        tree.similar(sizes[at], left[at], np.stack([tree.fold(bits[i], w) for i in at]), percent, check, own)


_PAIRS = "token long, a long, b long"


def _pairs(percent: int, n_keys: int, whole: bool = False):
    """Runs of (keys, nid, group, n, left, bits) rows, with or without earlier tokens, the
    first key a token -> pairs that may be similar, as many as connect all such; with ``whole``
    sets instead of bitmaps, of those that are."""
    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(3)],
                                          names=["token", "a", "b"])

    def run(batches):
        out: list = []
        for token, rows in _row_runs(batches, n_keys, percent):
            _tree_pairs(rows, percent, True, lambda x, y: out.append((token, min(x, y), max(x, y))), whole)
            if len(out) > 50_000:
                yield flush(out)
                out.clear()
        yield flush(out)
    return run


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    return tree.reaches(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in range(4)])
            yield _links([(x, y) for x, y, s, t in rows
                          if _similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)])
    return run


class _Nodes:
    """The nodes of a join, and the texts that their sets are read from."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.rows, self.nodes, self.k, self.percent = rows, nodes, k, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """nid, tokens: the whole sets of the nodes ``ids``, read from their texts."""
        spark = ids.sparkSession
        wanted = save(self.nodes.select("nid", "key", "first").join(ids, "nid", "left_semi"))
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
        # A fixed-size bitmap of the wanted ids keeps most other texts from being
        # moved; which of those it lets pass are wanted, the join decides.
        at = slot(F.col("first")) + 1          # bit positions count from 1
        filled = wanted.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in filled:
            start = (r["part"] - 1) * 4096
            bits[start:start + 4096] = np.frombuffer(r["bits"], np.uint8)
        found = (self.rows.select(slot(F.col("doc_id")).alias("slot"), "doc_id", "text")
                 .mapInArrow(_set_rows(self.k, spark.sparkContext.broadcast(bits)), "doc_id long, key binary, tokens binary"))
        sets = save(found.join(wanted.hint("merge"), (found["key"] == wanted["key"]) & found["doc_id"].eqNullSafe(wanted["first"]))
                    .select("nid", "tokens"))
        discard(wanted)
        return sets

    def check(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the similarity, on whole sets."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct())
        one = sets.select(F.col("nid").alias("a"), F.col("tokens").alias("s"))
        two = sets.select(F.col("nid").alias("b"), F.col("tokens").alias("t"))
        found = save(pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(_verify(self.percent), _LINKS))
        discard(sets)
        return found


def _worth(rows: DataFrame, percent: int) -> DataFrame:
    """The tokens at which a pair of groups may be similar, with ``least``: rows of
    smaller n need not be looked at.  The first token that a similar pair shares
    is one of the smaller set's first n + 1 - 2 percent n / (100 + percent)."""
    first = F.col("pos") < F.col("n") + 1 - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    return (rows.groupBy("token").agg(
        F.min("group").alias("x"), F.max("group").alias("y"), F.count(F.lit(1)).alias("c"),
        F.sum("n").alias("load"), F.min(F.when(first, F.col("n"))).alias("least"))
        .filter("x < y and least is not null").select("token", "c", "load", "least"))


def _connecting(heads: DataFrame, nodes: _Nodes) -> DataFrame:
    """Step 3: links among nodes that share their first token."""
    members = heads.select("nid", F.col("head")[0]["token"].alias("bucket"), "n")
    links = None
    while True:
        load = members.groupBy("bucket").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        load = save(load.withColumn("blocks", F.ceil(F.col("load") / BLOCK_TOKENS)))
        rows = (members.select("bucket", "nid").join(load.select("bucket", "blocks"), "bucket")
                .withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
                .join(nodes.nodes.select("nid", "n", "bits"), "nid")
                .select("bucket", "block", "nid", F.col("nid").alias("group"), "n", F.col("n").alias("left"), "bits"))
        pairs = save(rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
                     .mapInArrow(_pairs(nodes.percent, 2), _PAIRS).select("a", "b").distinct())
        found = nodes.check(pairs)
        discard(pairs)
        links = found if links is None else save(links.union(found))
        if (load.agg(F.max("blocks")).first()[0] or 1) == 1:
            return links
        # what was cut into blocks meets again, one node for each group
        groups = components(links)
        split = members.join(load.filter("blocks > 1").select("bucket"), "bucket", "left_semi")
        left = save(split.join(groups, split["nid"] == groups["node"], "left")
                    .groupBy("bucket", F.coalesce("component", "nid").alias("g"))
                    .agg(F.min(F.struct("nid", "n")).alias("m")).select("bucket", "m.nid", "m.n"))
        if left.count() >= split.count():
            return links
        members = left


def _candidates(placed: DataFrame, nodes: _Nodes, heads: DataFrame, fine: bool = False, whole: bool = False) -> DataFrame:
    """token, a, b: pairs of different groups that share a prefix token and may be
    similar (``whole``: are, on whole sets), as many as connect all such pairs of the
    token.  Up to their first shared token two sets share nothing, so what they share
    is bounded by what follows it in both.  A similar pair meets at that token
    (``_worth`` keeps it), so pairs that share an earlier one are left out; the first
    EARLIER tokens tell nearly all of them."""
    blocks = F.ceil(F.col("c") / BLOCK_NODES)
    if whole:
        blocks = F.greatest(blocks, F.ceil(F.col("load") / BLOCK_TOKENS))
    mixed = _worth(placed, nodes.percent).select("token", "least", blocks.cast("int").alias("blocks"))
    kept = placed.join(mixed, "token").filter("n >= least")
    sets = None
    if whole:
        kept = save(kept)
        sets = nodes.sets(kept.select("nid").distinct())
        bits = sets.withColumnRenamed("tokens", "bits")
    elif fine:
        bits = nodes.nodes.select("nid", "n", "bits").mapInArrow(_fine, "nid long, n long, bits binary").drop("n")
    else:
        bits = nodes.nodes.select("nid", F.col("small").alias("bits"))
    own = F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")
    earlier = F.transform(F.filter("head", lambda h: h["pos"] < F.col("pos")), lambda h: h["token"])
    rows = (kept.withColumn("left", F.col("n") - F.col("pos")).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .join(bits.join(heads.select("nid", "head"), "nid"), "nid")
            .select("token", "lo", "hi", "nid", "group", "n", "left", "bits", earlier.alias("earlier")))
    pairs = save(rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
                 .mapInArrow(_pairs(nodes.percent, 3, whole), _PAIRS))
    if whole:
        discard(kept, sets)
    return pairs


def _completing(shared: DataFrame, heads: DataFrame, nodes: _Nodes, links: DataFrame) -> DataFrame:
    """Step 4: ``links`` and those between their groups."""
    def placed(rows):
        return save(rows.join(components(links), F.col("nid") == F.col("node"), "left").select(
            "token", "nid", "n", "pos", F.coalesce("component", "nid").alias("group")))

    rows = shared
    for fine in (False, True):
        rows = placed(rows)
        pairs = _candidates(rows, nodes, heads, fine)
        found = nodes.check(pairs.select("a", "b").distinct())
        links = save(links.union(found))
        # Where every noted pair holds, the pairs left out lie within one group, or share
        # an earlier token and are left to that.  The other tokens are looked at again, by
        # finer bitmaps, and at last on whole sets, where every noted pair holds.
        doubtful = save(pairs.join(found, ["a", "b"], "left_anti").select("token").distinct())
        discard(pairs, rows)
        if doubtful.isEmpty():
            return links
        rows = shared.join(doubtful, "token", "left_semi")
    rows = placed(rows)
    pairs = _candidates(rows, nodes, heads, whole=True)
    links = save(links.union(pairs.select("a", "b").distinct()))
    discard(pairs, rows)
    return links


def _linked(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text) rows: doc_id, n, key of each, and one row for each key of
    a set with tokens: key, group (its group's own number), component, first."""
    spark = rows.sparkSession
    table = save(rows.mapInArrow(_keys_and_counts(k), _FIRST_PASS))
    levels = spark.sparkContext.broadcast(frequency_levels(table.filter("block is not null").select("block", "counts")))
    every = table.filter("block is null").select("doc_id", "n", "key")
    first = save(every.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first")))
    made = rows.mapInArrow(_node_rows(k, percent, levels), "doc_id long, n long, key binary, prefix array<long>, bits binary, small binary")
    nodes = save(made.join(first.hint("merge"), (made["key"] == first["key"]) & made["doc_id"].eqNullSafe(first["first"]))
                 .select(made["key"], "first", "n", "prefix", "bits", "small").withColumn("nid", F.monotonically_increasing_id()))
    tokens = nodes.select("nid", "n", F.posexplode("prefix").alias("pos", "token"))
    common = _worth(tokens.withColumn("group", F.col("nid")), percent)
    shared = save(tokens.join(common.hint("merge"), "token").filter("n >= least").select("token", "nid", "n", "pos"))
    # a node's first EARLIER tokens, in order
    heads = save(shared.groupBy("nid", "n").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, EARLIER).alias("head")))
    own = _Nodes(rows, nodes, k, percent)
    links = _connecting(heads, own)
    links = _completing(shared, heads, own, links)
    discard(shared, heads)
    final = save(components(links))
    named = nodes.select("nid", "key", "first").join(final, F.col("nid") == F.col("node"), "left").select(
        "key", "first", F.coalesce("component", "nid").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component"))
    named = named.join(least, "group").groupBy("key").agg(
        F.min("group").alias("group"), F.min("component").alias("component"), F.min("first").alias("first"))
    return every.select("doc_id", "n", "key"), named


def linked_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (set size), key (of its set), component
    (smallest doc_id of its group), first (smallest doc_id with the same set)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every, named = _linked(rows, k, percent)
    out = every.join(named, "key", "left")
    return out.select("doc_id", "n", "key", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"),
                      F.col("first"))


def _with_key(k: int, text_at: int, name: str):
    def run(batches):
        for b in _parts(batches):
            keys = [_key(s) for s in shingle_sets(b.column(text_at), k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())],
                                             names=[*b.schema.names, name])
    return run


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: of the smallest id, null ids last; of
    equal ids any one.  Rows without shingles all stay."""
    key, number = fresh(docs, "shingle_key", "row_number")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{key}` binary"
    # the numbers are written beside the documents, so they are the same at each read
    rows = save(docs.mapInArrow(_with_key(k, docs.columns.index("text"), key), schema)
                .withColumn(number, F.monotonically_increasing_id()))
    _, named = _linked(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    members = save(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), F.col(number).alias("number"))
                   .join(named.select("key", "group"), "key").select("group", "doc_id", "number"))
    kept = members.groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("number")))["number"].alias("number"))
    gone = save(members.select("number").join(kept.select("number"), "number", "left_anti").withColumnRenamed("number", number))
    return without(rows, gone, number).select(*[F.col(f"`{c}`") for c in docs.columns])
