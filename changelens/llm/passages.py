"""Repeated passages: bytes of any string of ``MIN`` bytes that starts twice.

Finding candidates.  Every window of MIN bytes chooses its leftmost least-hash
gram of GRAM bytes, so equal windows choose equal grams at equal places: these
anchors are all that has to be compared.  An anchor's context holds the windows
that chose it.  Anchors that occur once in the corpus drop out; occurrences
with one and the same context are repeated as a whole, and one of them stands
for all.

Comparing.  The distinct contexts of an anchor meet in one task, many anchors
to a batch of bounded size, each cut to what it may share with another one.  A
batch's suffixes are sorted, and threshold-
bounded interval expansion works on its Burrows-Wheeler transform: intervals
of common prefixes are extended backward by one byte, breadth first, which
gives the borders between suffixes in the order of their common prefix length,
and it stops at MIN.  Suffixes between which no border was found share at
least MIN bytes; where such suffixes lie at different places of the corpus,
their windows are repeated.

Anchors with very many contexts are cut into blocks, and every pair of blocks
meets.  Texts that occur more than once are removed as a whole (from MIN bytes
on) and only the first takes part as a witness.

Defined cases: null text is empty; texts under MIN bytes lose nothing; very
long texts are worked on in slices; repeated rows are copies like any others;
null ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .jaccard_join import runs

MIN = 400
GRAM = 100
STEP = 25                     # bytes by which shared sides of contexts are measured
SLICE = 1 << 20               # bytes of a text worked on at once
BATCH = 1_000_000             # bytes of contexts in one transform
BLOCK = 1024                  # contexts of one anchor that meet in one batch
SEED = 20240501

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * _U(step)
        step = step * step % (1 << 64)
        k += m
    return out


_POWERS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWERS:
        n = SLICE + 3 * MIN
        _POWERS.extend([_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)])
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values."""
    n = len(x)
    p = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = x
    p = p.reshape(-1, w)
    before = np.minimum.accumulate(p, axis=1).ravel()
    after = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n - w + 1], before[w - 1:n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, context hash, position, sides) of a text's anchors; sides are
    the context's bytes before the position * 1024 + its bytes from there on."""
    n = len(data)
    power, inverse = _tables()
    place = _U((1 << 24) - 1)
    found: list[tuple] = []
    for start in range(0, max(n - MIN + 1, 0), SLICE):
        lo, hi = max(0, start - MIN), min(n, start + SLICE + 2 * MIN)
        b = data[lo:hi]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:len(b)], out=sums[1:])
        stop = min(n - MIN + 1, start + SLICE)          # windows start before this
        first, end = start - lo, stop - lo + MIN - GRAM
        grams = _mix((sums[first + GRAM:end + GRAM] - sums[first:end]) * inverse[first:end])
        ranked = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_least(ranked, MIN - GRAM + 1) & place).astype(np.int64)
        # neighbouring windows with one choice: the first and the last of them
        begin = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        end_ = np.r_[begin[1:], len(chosen)] - 1
        at = chosen[begin]
        left, right = at - begin, end_ + MIN - at
        l, r = begin + first, end_ + MIN + first
        sides = left * 1024 + right
        context = _mix((sums[r] - sums[l]) * inverse[l]) + _mix(sides.astype(np.uint64))
        found.append((grams[at], context, at + start, sides))
    if not found:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _digest(data: bytes) -> int:
    """56 bits of the MD5, as a number; ids and digests together name a text."""
    return int.from_bytes(hashlib.md5(data).digest()[:7], "big")


def _gram_rows(batches):
    for b in batches:
        found = [anchors(np.frombuffer(t or b"", np.uint8))[0] for t in b.column(0).to_pylist()]
        rows = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(rows.view(np.int64))], names=["gram"])


def _anchor_rows(batches):
    for b in batches:
        ids, sizes, digests, found = b.column(0), [], [], []
        for t in b.column(1).to_pylist():
            data = t or b""
            found.append(anchors(np.frombuffer(data, np.uint8)))
            sizes.append(len(found[-1][0]))
            digests.append(_digest(data) if sizes[-1] else 0)
        if not found:
            continue
        gram, context, pos, sides = (np.concatenate(x) for x in zip(*found))
        of = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_arrays([
            pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), ids.take(pa.array(of)),
            pa.array(np.array(digests, np.int64)[of]), pa.array(pos), pa.array(sides)],
            names=["gram", "context", "doc_id", "digest", "pos", "sides"])


def _contexts(batches):
    """(doc_id, digest, text, list of places) -> the bytes of each context."""
    names = ["gram", "lo", "hi", "context", "left", "place", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        rows: list[tuple] = []
        for doc_id, digest, text, places in zip(*[b.column(i).to_pylist() for i in range(4)]):
            # a place in the corpus, as one number
            base = _digest(f"{doc_id} {digest}".encode())
            for p in places:
                left, right = divmod(p["sides"], 1024)
                start = p["pos"] - left
                part = text[start:p["pos"] + right]
                for lo, hi in _block_pairs(p["context"], p["blocks"]):
                    rows.append((p["gram"], lo, hi, p["context"], left, base + start, part))
            if len(rows) > 4000:
                yield _batch(rows, names, types)
                rows = []
        yield _batch(rows, names, types)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _block_pairs(context: int, blocks: int):
    own = context % blocks
    return [(min(own, other), max(own, other)) for other in range(blocks)]


FIRST = 7                     # symbols of 9 bits that one number holds


def suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every suffix by its first FIRST and by its first ``depth`` symbols
    or more (equal ones share the rank of the first).  Symbol 0 closes a part of
    the text; no two of these are equal."""
    n, step = len(symbols), FIRST
    one = np.zeros(n + step, np.uint64)
    one[:n] = symbols
    two = (one[:-1] << _U(9)) | one[1:]
    four = (two[:-2] << _U(18)) | two[2:]
    key = (four[:n] << _U(27)) | (two[4:n + 4] << _U(9)) | one[6:n + 6]
    # what follows an end among these symbols does not count
    ends = np.flatnonzero(symbols == 0)
    near = (ends[:, None] - np.arange(step)).ravel()
    cut = np.tile(9 * (step - 1 - np.arange(step)), len(ends)).astype(np.uint64)
    start = np.r_[0, ends[:-1] + 1]
    own = near >= np.repeat(start, step)
    near, cut = near[own], cut[own]
    key[near] = (key[near] >> cut) << cut
    closed = np.zeros(n, bool)
    closed[near] = True
    order = np.argsort(key, kind="stable")
    sorted_key, closed = key[order], closed[order]
    border = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | closed[1:] | closed[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(border, np.arange(n), 0))
    short = rank.copy()
    while step < depth:
        size = np.bincount(rank, minlength=n)
        active = np.flatnonzero(size[rank] > 1)
        if not len(active):
            break
        old = rank[active]
        pair = old * n + rank[active + step]
        order = np.argsort(pair)
        active, old, pair = active[order], old[order], pair[order]
        at = np.arange(len(active))
        block = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        group = np.maximum.accumulate(np.where(np.r_[True, pair[1:] != pair[:-1]], at, 0))
        rank[active] = old + group - block
        step *= 2
    return short, rank


def borders(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, start: int, least: int) -> np.ndarray:
    """Flags of the places between neighbouring suffixes (``order``) that share
    fewer than ``least`` symbols, by backward extension of intervals.

    ``rank`` are the ranks by ``start`` symbols, whose borders are known; the
    borders of length ``start``, ``start`` + 1, ... follow breadth first.
    """
    n = len(symbols)
    border = np.zeros(n + 1, bool)
    first = rank[order]
    border[0] = border[n] = True
    border[1:n] = first[1:] != first[:-1]
    before = symbols[order - 1]              # the transform; symbol 0 is never extended
    image = np.empty(n, np.int64)            # where a suffix goes with the symbol before it
    image[np.argsort(before, kind="stable")] = np.arange(n)
    starts = np.flatnonzero(border[:-1])
    lo, hi = starts, np.r_[starts[1:], n]
    for length in range(start, least):
        # one suffix has no neighbours to part from, but ends an interval
        width = hi - lo
        total = int(width.sum())
        if not total:
            break
        of = np.repeat(np.arange(len(lo)), width)
        row = np.arange(total) - np.repeat(np.cumsum(width) - width, width) + lo[of]
        kept = before[row] != 0
        row, of = row[kept], of[kept]
        if not len(row):
            break
        to = image[row]
        symbol = before[row].astype(np.int64)
        # rows of one interval and symbol go to one interval
        group = np.argsort(to, kind="stable")
        key = (of * 512 + symbol)[group]
        to = to[group]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        left = to[new]
        right = to[np.r_[new[1:] - 1, len(to) - 1]] + 1
        fresh = ~border[right]
        left, right = left[fresh], right[fresh]
        border[right] = True
        lo, hi = left, right
    return border


def repeated_starts(parts: list[bytes], places: np.ndarray, least: int = MIN) -> list[np.ndarray]:
    """Per part the starts of its windows of ``least`` bytes that are in a part
    at another place too.  ``places`` are the parts' first places in the corpus."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    symbols = np.zeros(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    short, rank = suffix_ranks(symbols, least)
    order = np.argsort(rank, kind="stable")
    border = borders(symbols, order, short, FIRST, least)
    part_of = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(n) - (ends - sizes)[part_of]
    place = (places[part_of] + offset)[order]
    group = np.flatnonzero(border[:n])
    several = np.maximum.reduceat(place, group) != np.minimum.reduceat(place, group)
    rows = order[np.repeat(several, np.diff(np.r_[group, n]))]
    rows = np.sort(rows[sizes[part_of[rows]] - offset[rows] >= least])
    cut = np.searchsorted(part_of[rows], np.arange(1, len(parts)))
    return np.split(offset[rows], cut)


def _shared_sides(sides: list[bytes], tail: bool) -> list[int]:
    """Per string a length that no ending (``tail``) or beginning it shares with
    another one exceeds."""
    best, alive, size = [0] * len(sides), list(range(len(sides))), STEP
    while alive:
        same: dict[bytes, list[int]] = {}
        for i in alive:
            if len(sides[i]) >= size:
                same.setdefault(sides[i][-size:] if tail else sides[i][:size], []).append(i)
        alive = [i for group in same.values() if len(group) > 1 for i in group]
        for i in alive:
            best[i] = size
        size += STEP
    return [min(b + STEP - 1, len(s)) for b, s in zip(best, sides)]


def narrowed(rows: list[tuple]) -> list[tuple]:
    """(context, left, place, bytes) rows of one anchor, cut to the windows that
    another row may share; rows without such a window are left out."""
    before = _shared_sides([b[:left] for _, left, _, b in rows], True)
    after = _shared_sides([b[left + GRAM:] for _, left, _, b in rows], False)
    out = []
    for (context, left, place, b), x, y in zip(rows, before, after):
        if x + GRAM + y >= MIN:
            out.append((context, x, place + left - x, b[left - x:left + GRAM + y]))
    return out if len(out) > 1 else []


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) over sorted starts."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:] - 1, len(starts) - 1]] + length).tolist()))


_RANGES = "gram long, context long, start long, stop long"


def _compare(batches):
    held: list[tuple] = []
    size = 0

    def flush():
        rows: list[tuple] = []
        for (gram, context, left, _, _), starts in zip(
                held, repeated_starts([r[4] for r in held], np.array([r[3] for r in held], np.int64))):
            rows += [(gram, context, s - left, e - left) for s, e in covered(starts, MIN)]
        return _batch(rows, ["gram", "context", "start", "stop"], [pa.int64()] * 4)

    for t in runs(batches, 3):
        if t.num_rows < 2:
            continue
        gram = t["gram"][0].as_py()
        for context, left, place, b in narrowed(list(zip(*[t[c].to_pylist() for c in ("context", "left", "place", "bytes")]))):
            held.append((gram, context, left, place, b))
            size += len(b)
        if size >= BATCH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _remove(batches):
    """(digest, text, spans) -> what is left of a text."""
    for b in batches:
        out = []
        for key, text, spans in zip(*[b.column(i).to_pylist() for i in range(3)]):
            kept, removed, n_spans, at = hashlib.sha256(), 0, 0, 0
            stop = None
            for s, e in sorted((x["start"], min(x["stop"], len(text))) for x in spans):
                if stop is None or s > stop:
                    if stop is not None:
                        removed += stop - at
                        at = stop
                    kept.update(text[at:s])
                    at, stop, n_spans = s, e, n_spans + 1
                else:
                    stop = max(stop, e)
            if stop is not None:
                removed += stop - at
                at = stop
            kept.update(text[at:])
            out.append((key, removed, n_spans, kept.hexdigest()))
        yield _batch(out, ["key", "removed", "n_spans", "kept_sha"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("bytes"))
    every = save(rows.select("doc_id", F.unhex(F.md5("bytes")).alias("key"), F.octet_length("bytes").cast("long").alias("n_bytes"),
                             F.sha2("bytes", 256).alias("sha"))
                 .withColumn("digest", F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")))
    firsts = save(every.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    # anchors that occur at least twice
    grams = (rows.select("bytes").mapInArrow(_gram_rows, "gram long").groupBy("gram")
             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    met = (rows.mapInArrow(_anchor_rows, "gram long, context long, doc_id long, digest long, pos long, sides long")
           .join(save(grams).hint("merge"), "gram"))
    # of equal texts the first takes part
    others = (every.join(firsts.filter("copies > 1"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
              .select(F.col("doc_id").alias("_other"), F.col("digest").alias("_of")))
    met = save(met.join(others.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_other")) & (F.col("digest") == F.col("_of")),
                        "left_anti"))
    contexts = save(met.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "digest", "pos", "sides")).alias("at")))
    # anchors with several contexts, not all of them repeated as a whole
    several = (contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
               .filter("c > 1 and least = 1").select("gram", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    places = (contexts.join(several, "gram").groupBy("at.doc_id", "at.digest")
              .agg(F.collect_list(F.struct("gram", "context", F.col("at.pos").alias("pos"), F.col("at.sides").alias("sides"),
                                           "blocks")).alias("places")))
    ids = met.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    texts = save(rows.join(ids.hint("merge"), rows["doc_id"].eqNullSafe(ids["_id"]))
                 .mapInArrow(_same_text, "doc_id long, digest long, bytes binary"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    parts = texts.join(places, same(texts, places)).select(texts["doc_id"], texts["digest"], "bytes", "places")
    compared = (parts.mapInArrow(_contexts, "gram long, lo int, hi int, context long, left long, place long, bytes binary")
                .repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
                .mapInArrow(_compare, _RANGES))
    # one and the same context at several places: all of it
    left = F.floor(F.col("at.sides") / 1024)
    whole = contexts.filter("n > 1").select("gram", "context", (-left).alias("start"), (F.col("at.sides") % 1024).alias("stop"))
    ranges = save(compared.union(whole).groupBy("gram", "context").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")))
    moved = F.transform("ranges", lambda r: F.struct((F.col("pos") + r["start"]).alias("start"),
                                                     (F.col("pos") + r["stop"]).alias("stop")))
    spans = (met.join(ranges, ["gram", "context"]).select("doc_id", "digest", moved.alias("moved"))
             .groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("moved")).alias("spans")))
    left_over = save(texts.join(spans, same(texts, spans)).select(
        F.unhex(F.md5("bytes")).alias("key"), "bytes", "spans").mapInArrow(
        _remove, "key binary, removed long, n_spans long, kept_sha string").dropDuplicates(["key"]))
    by_key = firsts.join(left_over, "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= MIN)
    return every.join(by_key, "key", "left").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"))


def _same_text(batches):
    """Rows joined by id whose text has the digest that was asked for."""
    for b in batches:
        text = b.column(1).to_pylist()
        ok = pa.array([_digest(t) == d for t, d in zip(text, b.column(3).to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1)],
                                         names=["doc_id", "digest", "bytes"]).filter(ok)
