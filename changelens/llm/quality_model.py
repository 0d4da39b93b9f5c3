"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every token has a fixed sparse random index vector; a token's
word vector is the sum of the index vectors of the tokens around it, over all
documents.  Tokens are hashed to a fixed number of rows, so the vectors are one
table of known size, added up by row block across tasks.  A word gives two
tokens, its letters and its shape (case, digits, marks).  A document is the
mean of its words' normalised vectors, letters and shapes apart.

A two-layer numpy network is fitted on a bounded sample of labelled documents
(``max_train``, chosen by id hash) and its temperature calibrated on a part of
that sample the weights never saw.  Ids of which crc32 mod 5 is 0 are held out
of all of it.  Labels, language, source and id are never inputs.

Defined cases: null and empty texts pool to the zero vector and get the score
the network gives it; very long texts are read whole; documents without labels
are scored like any other; without any usable label every score is 0.5; rows
with the same id are scored each; of several labels of an id the largest counts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

ROWS = 1 << 14          # rows of the vector table
DIM = 32
NONZERO = 4             # of an index vector
WINDOW = 2              # words on each side
BLOCK = 256             # rows added up together
HIDDEN = 24
MAX_TRAIN = 20_000
FOLDS = 5
THRESHOLD = 0.3
SEED = 20240229
CACHE = 300_000
SLICE = 100_000         # words worked on at once
_REPEAT = zlib.crc32(b"\0repeat") % ROWS

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_RUNS = [(re.compile(p), r) for p, r in ((rb"[a-z\x80-\xff]+", b"a"), (rb"[A-Z]+", b"A"), (rb"[0-9]+", b"9"),
                                         (rb"([^aA9])\1+", rb"\1"))]


class _Tokens(dict):
    """Word -> its two table rows, as one number."""

    def __missing__(self, word):
        shape = word
        for pattern, short in _RUNS:
            shape = pattern.sub(short, shape)
        core = word.strip(_MARKS).lower()
        rows = zlib.crc32(core) % ROWS * ROWS + zlib.crc32(b"\0" + shape) % ROWS
        if len(self) >= CACHE:
            self.clear()
        self[word] = rows
        return rows


_TOKENS = _Tokens()


def _rows_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Table rows (words x 2) of a batch of texts, and words per text."""
    parts, sizes = [], []
    for t in texts:
        t = t.as_py()
        words = t.encode().split() if t else []
        parts.append(np.fromiter(map(_TOKENS.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    codes, sizes = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(sizes, np.int64)
    rows = np.stack(np.divmod(codes, ROWS), axis=1).astype(np.uint16)
    # a word that repeats the one before it has a shape of its own
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (text_of[1:] == text_of[:-1])) + 1
    rows[again, 1] = _REPEAT
    return rows, sizes


def index_vectors() -> np.ndarray:
    """The sparse random index vector of every table row."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIM), np.float32)
    places, signs = rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice([-1.0, 1.0], (ROWS, NONZERO))
    for k in range(NONZERO):
        out[np.arange(ROWS), places[:, k]] += signs[:, k]
    return out


def _slices(n: int):
    """Pieces of n words, so that temporary arrays stay small."""
    return ((a, min(a + SLICE, n)) for a in range(0, n, SLICE))


def _sum_by(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """table[k] += the sum of the values with key k."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    table[keys[starts]] += np.add.reduceat(values[order], starts)


def _sum_contexts(batches):
    """Context sums of this task's documents, as blocks of table rows."""
    index = index_vectors()
    table = np.zeros((ROWS, DIM))
    for batch in batches:
        rows, sizes = _rows_of(batch.column(0))
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        for a, b in _slices(len(rows)):
            lo, hi = max(0, a - WINDOW), min(len(rows), b + WINDOW)
            own, of = index[rows[lo:hi, 0]] + index[rows[lo:hi, 1]], text_of[lo:hi]
            context = np.zeros_like(own)
            for gap in range(1, min(WINDOW, hi - lo - 1) + 1):
                near = (of[gap:] == of[:-gap]).astype(np.float32)[:, None]
                context[gap:] += own[:-gap] * near
                context[:-gap] += own[gap:] * near
            for token in (0, 1):
                _sum_by(table, rows[a:b, token], context[a - lo:b - lo])
    table = table.reshape(-1, BLOCK * DIM)
    used = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([table[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])


def _add_blocks(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            v = np.frombuffer(v.as_py())
            sums[k] = sums[k] + v if k in sums else v
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        names=["block", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The table of normalised word vectors (``ROWS`` x ``DIM``), from all documents."""
    schema = "block int, sums binary"
    sums = (docs.select(text_col).mapInArrow(_sum_contexts, schema)
            .repartition(ROWS // BLOCK, "block").mapInArrow(_add_blocks, schema))
    table = np.zeros((ROWS // BLOCK, BLOCK * DIM))
    for r in sums.collect():          # ROWS x DIM numbers, whatever the corpus size
        table[r["block"]] = np.frombuffer(r["sums"])
    table = table.reshape(ROWS, DIM)
    table -= table.mean(axis=0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(vectors):
    def run(batches):
        table = vectors.value
        for batch in batches:
            rows, sizes = _rows_of(batch.column(1))
            out = np.zeros((len(sizes), 2 * DIM))
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            for a, b in _slices(len(rows)):
                of = text_of[a:b]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                for token in (0, 1):
                    sums = np.add.reduceat(table[rows[a:b, token]], starts)
                    out[of[starts], token * DIM:(token + 1) * DIM] += sums
            out = (out / np.maximum(sizes, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(out), pa.list_(pa.float32()))], names=["doc_id", "vector"])
    return run


class Network:
    """Two layers, tanh between, one logit; standardised inputs; temperature."""

    def __init__(self, rng, width: int):
        self.w1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x, y, rng, rounds: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(rounds):
            order = rng.permutation(len(z))
            for i in range(0, len(z), batch):
                xb, yb = z[order[i:i + batch]], y[order[i:i + batch]]
                h = np.tanh(xb @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40)))
                g = (p - yb) / len(yb)
                gh = np.outer(g, params[2]) * (1 - h * h)
                grads = [xb.T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
                t += 1
                for k, gr in enumerate(grads):        # Adam
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.999 * v[k] + 0.001 * gr * gr
                    params[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = params[0], params[1], params[2], float(params[3][0])

    def calibrate(self, x, y):
        """The temperature with the least log loss on unseen rows."""
        z = self.logits(x)

        def loss(t):
            p = np.clip(1 / (1 + np.exp(-np.clip(z / t, -40, 40))), 1e-9, 1 - 1e-9)
            return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))


def train(x: np.ndarray, y: np.ndarray) -> Network | None:
    if len(y) < 10 or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    net = Network(rng, x.shape[1])
    net.fit(x[order[cut:]], y[order[cut:]], rng)
    net.calibrate(x[order[:cut]], y[order[:cut]])
    return net


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _score(net):
    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, 2 * DIM)
            s = net.score(x) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    vectors = spark.sparkContext.broadcast(word_vectors(rows))
    pooled = save(rows.mapInArrow(_pool(vectors), f"doc_id {id_type}, vector array<float>"))
    known = (labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.max("quality").alias("y")))
    n = known.count()
    if n > max_train:           # a bounded sample, by id hash
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    # one row of each id, however often it repeats
    sample = pooled.join(known, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.min("y").alias("y")).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["vector"]))
    net = train(np.array([r["vector"] for r in sample], np.float64).reshape(-1, 2 * DIM),
                np.array([r["y"] for r in sample], np.float64))
    out = pooled.mapInArrow(_score(net), f"doc_id {id_type}, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
