"""Best-fit packing by swap-based local search.

A document is its token ids and one end id; only documents longer than a
sequence are cut, into whole sequences and one shorter last piece.  Whole
pieces are sequences of their own.  The others are dealt, by a row number, into
groups of about ``GROUP`` pieces; a task puts a group best fit, longest first, and then
improves it by local search: the emptiest bins give documents away, one for
none or one, two for none or one, or one for two of a fuller bin with room.  Every such
exchange moves tokens into the fuller bin, so the sum of squared fills grows with
each and the search ends; a bin that gives its last document away is gone.
Bins still underfull meet those of other groups in the next round and go on
from the state they have, so a round never adds a bin.  Rounds end when the
open bins fit one group or ``ROUNDS`` are done.

The search stops early where the free room of a group is less than one bin,
since none can be emptied then.  A bin tries the ``TRIES`` bins with the most
room first to last, and a group gives up after ``PATIENCE`` bins in a row that
did not empty: bounds on the effort of a heuristic, no piece is left out.

Defined cases: null text is empty, so the document is its end id; very long
texts give whole sequences and one remainder; repeated rows are packed each; ties
go by row number; an empty table gives an empty result; a null id stays
null; other columns are not read.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

CAPACITY = 4096
END_ID = 1
GROUP = 8192           # pieces that one task packs
ROUNDS = 4
OPEN = 1 / 64          # share of a sequence that, left free, keeps a bin open for the next round
TRIES = 128
PATIENCE = 16
HELD = 600_000         # words kept with their ids, per worker
LONGEST_HELD = 64
LATIN = 0x250           # letters below need no composing
_END = np.asarray([END_ID], dtype="<u4").tobytes()


class WordEncoder(dict):
    """Ids of whole texts by a tokenizer that drops white space, through a cache of words.

    Its pre-tokenizer splits at white space and looks at nothing beyond it, so
    the ids of a text are those of its parts between blanks and line ends.
    Marks after a letter are a token sequence of their own.  A word of Latin
    letters is one token sequence that normalizing only lower-cases, so the
    tokenizer's model takes it at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(LATIN) if chr(c).isalpha()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = lru_cache(maxsize=10_000)(self.ids)

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ends_in_letter(self, word: str) -> bool:
        """Whether the normalized word does: some letters become a letter and a
        combining mark, which goes with the marks that follow."""
        last = word[-1]
        if last.isalpha():
            last = last.lower() if last < chr(LATIN) else self.tokenizer.normalizer.normalize_str(last)
        return last[-1:].isalpha()

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(string.punctuation)
        if stem != word and stem and self.ends_in_letter(stem) and not any(s in word for s in self.special):
            ids = self[stem] + self.marks(word[len(stem):])
        elif (low := word.lower()).isalpha() and max(word) < chr(LATIN) and len(low) == len(word):
            ids = np.asarray([t.id for t in self.model.tokenize(low.translate(self.letters))], dtype="<u4").tobytes()
        else:
            ids = self.ids(word) if word else b""
        if len(word) <= LONGEST_HELD:
            if len(self) >= HELD:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_batches(path: str, capacity: int):
    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(text.as_py() or "") + _END
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start:4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE)], schema=_PIECE)
    return run


class Bin:
    """A sequence being filled: its documents by length."""

    __slots__ = ("docs", "fill", "sums")

    def __init__(self):
        self.docs: dict[int, list[int]] = defaultdict(list)
        self.fill = 0
        self.sums = None

    def add(self, length: int, doc: int) -> None:
        self.docs[length].append(doc)
        self.fill += length
        self.sums = None

    def take(self, length: int) -> int:
        doc = self.docs[length].pop()
        if not self.docs[length]:
            del self.docs[length]
        self.fill -= length
        self.sums = None
        return doc

    def exchanges(self):
        """Sums of one and of two documents, ascending, each with its lengths.

        Distinct lengths of one bin add up to its fill at most, so there are
        fewer than ``sqrt(2 * capacity)`` of them.
        """
        if self.sums is None:
            ones = np.array(sorted(self.docs), dtype=np.int64)
            i, j = np.triu_indices(len(ones), 1)
            twice = np.array([x for x in ones.tolist() if len(self.docs[x]) > 1], dtype=np.int64)
            a, b = np.concatenate([ones[i], twice]), np.concatenate([ones[j], twice])
            order = np.argsort(a + b, kind="stable")
            self.sums = ones, (a + b)[order], a[order], b[order]
        return self.sums


def _largest(give: np.ndarray, back: np.ndarray, room: int) -> tuple[int, int, int]:
    """(gain, index in give, index in back): the largest give - back of at least 1 and at most ``room``."""
    at = np.searchsorted(give, back + room, side="right") - 1
    gain = np.where(at >= 0, give[at] - back, 0)
    best = int(gain.argmax())
    return int(gain[best]), int(at[best]), best


def _exchange(poor: Bin, rich: Bin, capacity: int) -> bool:
    """Make the exchange that moves most tokens from ``poor`` to ``rich``."""
    room = capacity - rich.fill
    ones, twos, first, second = poor.exchanges()
    r_ones, r_twos, r_first, r_second = rich.exchanges()
    none_or_one = np.concatenate([[0], r_ones])
    options = []
    for give, back, kind in ((ones, none_or_one, 0), (twos, none_or_one, 1), (ones, r_twos, 2)):
        if len(give) and len(back):
            options.append((*_largest(give, back, room), kind))
    gain, g, b, kind = max(options, key=lambda o: o[0])
    if gain < 1:
        return False
    out = [first[g], second[g]] if kind == 1 else [ones[g]]
    back = [r_first[b], r_second[b]] if kind == 2 else [none_or_one[b]] if b else []
    out, back = [(int(x), poor.take(int(x))) for x in out], [(int(x), rich.take(int(x))) for x in back]
    for x, doc in out:
        rich.add(x, doc)
    for x, doc in back:
        poor.add(x, doc)
    return True


def best_fit(docs: list[tuple[int, int]], capacity: int) -> list[Bin]:
    """Bins of (length, document): each, longest first, into the fullest bin that takes it."""
    bins: list[Bin] = []
    room: list[tuple[int, int]] = []
    for length, doc in sorted(docs, key=lambda d: (-d[0], d[1])):
        at = bisect_left(room, (length, -1))
        free, k = room.pop(at) if at < len(room) else (capacity, len(bins))
        if k == len(bins):
            bins.append(Bin())
        bins[k].add(length, doc)
        if free > length:
            insort(room, (free - length, k))
    return bins


def local_search(bins: list[Bin], capacity: int, tries: int = TRIES, patience: int = PATIENCE) -> list[Bin]:
    """The bins that are left after exchanges into fuller bins."""
    bins = sorted(bins, key=lambda b: b.fill)
    stuck, k = 0, 0
    while k < len(bins) and stuck < patience:
        if sum(capacity - b.fill for b in bins) < capacity:
            break
        poor = bins[k]
        moved = True
        while moved and poor.fill:
            moved = False
            others = sorted((b for b in bins if b is not poor and poor.fill <= b.fill < capacity), key=lambda b: b.fill)
            for rich in others[:tries]:
                while poor.fill and rich.fill < capacity and poor.fill <= rich.fill and _exchange(poor, rich, capacity):
                    moved = True
                if not poor.fill:
                    break
        if poor.fill:
            stuck, k = stuck + 1, k + 1
        else:
            stuck = 0
            del bins[k]
        bins[k:] = sorted(bins[k:], key=lambda b: b.fill)
    return bins


_PLACED = pa.schema([*_PIECE, ("row", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("free", pa.int64())])
_PLACED_SQL = _PIECES + ", row long, bin long, offset long, free long"


def _pack_group(capacity: int, round_no: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        lengths, held = table.column("length").to_pylist(), table.column("bin").to_pylist()
        if round_no == 0:
            bins = best_fit([(n, i) for i, n in enumerate(lengths)], capacity)
        else:
            by: dict[int, Bin] = defaultdict(Bin)
            for i, (n, b) in enumerate(zip(lengths, held)):
                by[b].add(n, i)
            bins = list(by.values())
        bins = local_search(bins, capacity)
        n = len(lengths)
        at, offset, free = [0] * n, [0] * n, [0] * n
        for k, b in enumerate(bins):
            place = 0
            for length in sorted(b.docs, reverse=True):
                for doc in sorted(b.docs[length]):
                    at[doc], offset[doc], free[doc] = k, place, capacity - b.fill
                    place += length
        # a bin's number is the row of one of its pieces, which is in no other bin
        rows = table.column("row").to_pylist()
        first = [min(d for ds in b.docs.values() for d in ds) for b in bins]
        cols = [table.column(f.name).combine_chunks() for f in _PIECE]
        cols += [pa.array(rows, pa.int64()), pa.array([rows[first[k]] for k in at], pa.int64()),
                 pa.array(offset, pa.int64()), pa.array(free, pa.int64())]
        return pa.Table.from_arrays(cols, schema=_PLACED)
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence is numbered by the row of one of its pieces.
    """
    pieces = save(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_cut_batches(tokenizer_path, capacity), _PIECES)
                  .withColumn("row", F.monotonically_increasing_id()))
    columns = [f.name for f in _PIECE]
    done = [pieces.filter(F.col("length") == capacity).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = pieces.filter(F.col("length") < capacity).withColumns({"bin": F.col("row"), "offset": F.lit(0).cast("long"),
                                                                  "free": F.lit(0).cast("long")})
    for k in range(rounds):
        groups = max(1, -(-left.count() // group))
        dealt = left.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)))
        placed = save(dealt.groupBy("group").applyInArrow(_pack_group(capacity, k), _PLACED_SQL))
        last = groups == 1 or k == rounds - 1
        is_open = F.lit(False) if last else F.col("free") > int(capacity * OPEN)
        done.append(placed.filter(~is_open).select(*columns, F.col("bin").alias("sequence_id"), "offset"))
        if last:
            break
        left = placed.filter(is_open)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
