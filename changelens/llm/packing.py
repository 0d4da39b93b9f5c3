"""Harmonic packing of documents into fixed-size sequences.

A document is its token ids and one end id.  It is cut into whole sequences,
then into pieces of capacity / j tokens (the largest such length that fits, j
a whole number), down to a tail of at most capacity / 32 tokens.  Pieces of
one length form a class whose bins all take the same number of pieces, so a
piece's place follows from its rank in its class alone: bin = rank div j,
offset = (rank mod j) * length.  Ranks come from counts per (class, hash part)
and a rank inside the part, so every part fills its bins on its own and no
task sees a whole class.

A full bin wastes less than j tokens, a tail bin less than 1/32 of the
capacity.  What is left of a class's last bin (fewer than j pieces a class,
about 10,000 pieces in all at most, whatever the corpus size) is packed first
fit, longest first.

Defined cases: null text is empty, so the document is its end id; very long
texts give whole sequences and one remainder; repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import string
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

CAPACITY = 2048
FINEST = 32            # pieces are cut at capacity / j for j up to this
END_ID = 1
PARTS = 4096           # hash parts of a class
_MARKS = string.punctuation
CACHE = 400_000        # words kept with their ids, per worker


def cut(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Piece lengths of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // finest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class _Irregular(Exception):
    """White space that the word-wise path does not cover."""


class _Words(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of a word after ``lead``."""

    def __init__(self, lead, encoder):
        super().__init__()
        self.lead, self.encoder = lead, encoder

    def __missing__(self, word):
        # A word ends in no white space of any kind: the pre-tokenizer then
        # splits before its blank and after its last character in any context.
        if not word or min(word[0], word[-1]) <= " " or word[0].isspace() or word[-1].isspace():
            raise _Irregular
        stem = word.rstrip(_MARKS)
        if stem and stem != word and stem[-1].isalpha():
            # marks after letters are a token sequence of their own
            ids = self[stem] + self.encoder.marks(word[len(stem):])
        else:
            ids = self.encoder.word(self.lead + word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, through a cache of words.

    ``ranks`` may name the same vocabulary as ranks: single words in Latin
    letters are then encoded from it, which is faster and gives the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                         special_tokens={})
        self.marks = lru_cache(maxsize=10_000)(self.word)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.first, self.later = _Words("", self), _Words(" ", self)
        self.newline = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, text: str) -> bytes:
        if self.bpe is None or max(text) >= "\u0250":
            return self.ids(text)
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.ids(text)
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                head = self.first[words[0]]
                lines.append(head + b"".join(map(self.later.__getitem__, words[1:])))
            return self.newline.join(lines)
        except _Irregular:
            return self.ids(text)


@lru_cache(maxsize=2)
def _encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
_END = np.asarray([END_ID], dtype="<u4").tobytes()


def _cut_batches(path: str, ranks: str | None, capacity: int, finest: int):
    def run(batches):
        encoder = _encoder(path, ranks)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode(text.as_py() or "") + _END
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity, finest):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n))
                    start += length
            cols = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_SCHEMA)
    return run


def _pack_rest(rest: list[tuple[int, int, int]], capacity: int, sequence: int) -> list[tuple]:
    """First fit, longest first, of (length, first rank, count): rows of
    (length, rank, sequence, offset) from sequence number ``sequence`` on."""
    free: list[int] = []
    out = []
    for length, rank, n in sorted(rest, reverse=True):
        k = 0
        for i in range(n):
            while k < len(free) and free[k] < length:
                k += 1
            if k == len(free):
                free.append(capacity)
            out.append((length, rank + i, sequence + k, capacity - free[k]))
            free[k] -= length
    return out


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
         finest: int = FINEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place in it, checksum, sequence and offset."""
    spark = docs.sparkSession
    pieces = save(docs.select(F.col(id_col).cast("long"), F.col(text_col))
                  .mapInArrow(_cut_batches(tokenizer_path, ranks_path, capacity, finest), _PIECES)
                  .withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(PARTS)).cast("int")))
    counts = save(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # one total per piece length: at most capacity / finest + finest rows
    totals = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    base, rest, sequence = {}, [], 0
    for length, n in totals:
        per_bin = capacity // length
        base[length] = sequence
        sequence += n // per_bin
        if n % per_bin:
            rest.append((length, n - n % per_bin, n % per_bin))
    placed = spark.createDataFrame(_pack_rest(rest, capacity, sequence) or [(0, 0, 0, 0)],
                                   "_length long, _rank long, _sequence long, _offset long")
    bases = F.create_map(*[F.lit(x).cast("long") for kv in (base or {0: 0}).items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = (pieces.withColumn("rank", rank).join(starts, ["length", "part"])
              .withColumn("rank", F.col("rank") + F.col("first")))
    per_bin = F.floor(F.lit(capacity) / F.col("length"))
    out = ranked.join(F.broadcast(placed), (F.col("length") == F.col("_length")) & (F.col("rank") == F.col("_rank")), "left")
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("_sequence", F.element_at(bases, F.col("length")) + F.floor(F.col("rank") / per_bin)).cast("long").alias("sequence_id"),
        F.coalesce("_offset", F.pmod(F.col("rank"), per_bin) * F.col("length")).cast("long").alias("offset"))
