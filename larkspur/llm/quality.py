"""Document quality: random-indexing vectors pooled per document, and a small neural network on them.

Random indexing: every unit (a word, its shape, its ending, or the event that it
repeats the word before it) hashes to one of ROWS rows, and each row has a fixed
sparse random index vector. One pass over all documents adds to a row's context
vector the index vectors of the units beside it; the tables of all tasks are
added up, slice by slice, and the sum (ROWS x WIDTH numbers, whatever the corpus)
is normalised. A document is the mean of its units' context vectors and of its
shapes' index vectors, with the logarithm of its length.

The network (one hidden layer of HIDDEN tanh units, a sigmoid) is trained in
numpy on the driver on at most TRAIN_ROWS labelled documents (those of smallest
hash of doc_id), weighted so that both labels count alike; a fifth of them is
kept from training and sets the temperature that calibrates the scores.

Defined cases: a null text is empty, has a vector of zeros and a score like any
other; no usable labels, or labels of one kind only: every score is the share of
label 1 (0.5 without labels); columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import give_back, short_batches

ROWS, WIDTH, NONZERO = 1 << 12, 32, 4
HIDDEN, EPOCHS, TRAIN_ROWS, CUT = 24, 300, 20_000, 0.7
LOT, SLICES = 3 << 20, 8
#: Rows of the units that are not words: whether a word repeats the one before it.
REPEAT, FRESH = 0, 1
_SHAPES = 256  # rows 2 to 257 are shapes; endings and words hash over the rest


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary index vector of each row."""
    rng = np.random.default_rng(11)
    out = np.zeros((ROWS, WIDTH), np.float32)
    for r in range(ROWS):
        at = rng.choice(WIDTH, NONZERO, replace=False)
        out[r, at] = rng.choice((-1.0, 1.0), NONZERO)
    return out


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else "w" if c.isalpha() else c if c.isascii() else "?"


def _shape(word: str) -> str:
    """A word's character kinds, runs folded: Abc!! is A, a, ! and a mark for the doubling."""
    body, last = (word[:-1], word[-1]) if word[-1:] in ",." else (word, "")
    if body.isalpha() and (body.islower() or body[1:].islower() and body[0].isupper()):
        return ("a" if body.islower() else "Aa") + last
    out: list[str] = []
    for c in map(_kind, word):
        if not out or out[-1][0] != c:
            out.append(c)
        elif c not in "Aaw9":
            out[-1] = c + "+"
        elif c == "A":
            out[-1] = "A+"
    return "".join(out[:8])


def _plain_shape(word: bytes) -> str | None:
    """The shape of an ASCII word in lower case or with a capital, by its bytes; None: _shape tells."""
    body, last = (word[:-1], word[-1:].decode()) if word.endswith((b",", b".")) else (word, "")
    if not body.isalpha():
        return None
    return "a" + last if body.islower() else "Aa" + last if body[1:].islower() else None


def _units(words: list[bytes]) -> np.ndarray:
    """Rows of each distinct word, its shape and its ending."""
    digest, free = xxhash.xxh32_intdigest, ROWS - 2 - _SHAPES
    # Shapes and endings are few: each is hashed once.
    shapes: dict[str, int] = {}
    ends: dict[bytes, int] = {}
    own, shaped, ended = [], [], []
    for w in words:
        low = w.lower()
        own.append(digest(low) % free)
        shape = _plain_shape(w) or _shape(w.decode("utf-8", "replace"))
        at = shapes.get(shape)
        if at is None:
            at = shapes[shape] = digest(shape.encode()) % _SHAPES
        shaped.append(at)
        at = ends.get(low[-3:])
        if at is None:
            at = ends[low[-3:]] = digest(b"~" + low[-3:]) % free
        ended.append(at)
    return np.stack([np.array(own, np.int32) + 2 + _SHAPES, np.array(shaped, np.int32) + 2, np.array(ended, np.int32) + 2 + _SHAPES], axis=1)


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, distinct-word number of each token, rows of each distinct word)."""
    parts = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    flat = parts.flatten().cast(pa.large_binary())
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    bounds = upto[parts.offsets.to_numpy()]
    coded = flat.filter(full).dictionary_encode()
    return np.diff(bounds), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _units(coded.dictionary.to_pylist())


def _repeats(lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: whether it repeats the token before it, and whether it begins a text."""
    begins = np.zeros(len(ids), bool)
    firsts = np.cumsum(lens) - lens
    begins[firsts[lens > 0]] = True
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    return again & ~begins, begins


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    keys: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= LOT:
                yield keys, texts
                give_back()
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
        give_back()


def context_vectors(texts: DataFrame) -> np.ndarray:
    """The random-indexing table of all texts (doc_id, text): ROWS x WIDTH, rows of length one or zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((ROWS, WIDTH), np.float64)
        for _, texts in _lots(batches):
            lens, ids, rows = _folded(texts)
            if not len(ids):
                continue
            again, begins = _repeats(lens, ids)
            # A word's own signal: the index vectors of its three units, which its neighbours' rows take up.
            signal = np.concatenate([index[rows].sum(1), np.zeros((1, WIDTH), np.float32)])
            none, ends = len(rows), np.r_[begins[1:], True]
            left = np.where(begins, none, np.r_[none, ids[:-1]])
            right = np.where(ends, none, np.r_[ids[1:], none])
            near = np.zeros((len(rows), WIDTH), np.float32)
            order = np.argsort(ids, kind="stable")
            for k in range(0, len(order), 1 << 16):
                at = order[k : k + (1 << 16)]
                own = ids[at]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                near[own[first]] += np.add.reduceat(signal[left[at]] + signal[right[at]], first, axis=0)
            signal = signal[:-1]
            for u in range(3):
                _add_rows(total, rows[:, u], near)
            total[REPEAT] += signal.T @ np.bincount(ids[again], minlength=len(rows))
            total[FRESH] += signal.T @ np.bincount(ids[~again], minlength=len(rows))
        cut = np.array_split(total.astype(np.float32), SLICES)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "data": pa.array([x.tobytes() for x in cut], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        # In an order of their own, not of arrival: reruns give the same sums.
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(t.column("data").to_pylist()))
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    got = texts.mapInArrow(count, "slice int, data binary").groupBy("slice").applyInArrow(add, "slice int, data binary").collect()
    total = np.concatenate([np.frombuffer(r["data"]) for r in sorted(got, key=lambda r: r["slice"])]).reshape(ROWS, WIDTH) if got else np.zeros((ROWS, WIDTH))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    to[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def pooled(texts: list[str | None], table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    lens, ids, rows = _folded(texts)
    out = np.zeros((len(texts), 2 * WIDTH + 2), np.float32)
    if len(ids):
        again, _ = _repeats(lens, ids)
        own = np.concatenate([table[rows].sum(1), index[rows[:, 1]]], 1)
        full = np.flatnonzero(lens > 0)
        ends = np.cumsum(lens[full])
        for lo, hi in _spans(ends, 1 << 18):
            part = own[ids[(ends[lo - 1] if lo else 0) : ends[hi - 1]]]
            firsts = np.r_[0, ends[lo : hi - 1] - (ends[lo - 1] if lo else 0)]
            out[full[lo:hi], : 2 * WIDTH] = np.add.reduceat(part, firsts, axis=0) / lens[full[lo:hi], None]
        share = np.add.reduceat(again.astype(np.float32), np.r_[0, ends[:-1]]) / lens[full]
        out[full, :WIDTH] += share[:, None] * table[REPEAT] + (1 - share[:, None]) * table[FRESH]
        out[full, 2 * WIDTH] = share
    out[:, -1] = np.log1p(lens)
    return out


def _spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(ends):
        begun = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, begun + most, "right")))
        yield lo, hi
        lo = hi


class Network:
    """Two layers in numpy, with the scaling of the features and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, use = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.std
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        n = x.shape[1]
        p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(use), max(1, len(use) // 1024)):
                h = np.tanh(z[at] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) * weight[at] / len(at)
                back = np.outer(g, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                step += 1
                for k, q in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, truth = self.logits(x[held]), y[held]
        if len(held):
            tries = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def crc_remainder(doc_id: int | None, modulus: int = 4) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def train_labels(labels: DataFrame, fold: int = 2) -> DataFrame:
    """(doc_id, quality) of at most TRAIN_ROWS labels outside the held-out fold, one for each document."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != fold))
    return usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    judge = _fitted(texts, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for keys, own in _lots(batches):
            s = judge(own, index)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "held_out": pa.array([crc_remainder(k) == 2 for k in keys]), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= cut).astype(np.int32))})

    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, whole, whose score reaches cut."""
    judge = _fitted(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels)
    at = docs.columns.index("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(at).to_pylist(), index) >= cut))
                give_back()

    return docs.mapInArrow(pick, docs.schema)


def _fitted(texts: DataFrame, labels: DataFrame):
    """A function from (texts, index vectors) to scores, fitted on texts (doc_id, text) and labels."""
    spark = texts.sparkSession
    short_batches(spark)
    table = context_vectors(texts)
    # At most TRAIN_ROWS labels, whose documents' features (not texts) come to the driver.
    known = {r["doc_id"]: r["quality"] for r in train_labels(labels).collect()}
    chosen = spark.sparkContext.broadcast(known)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        for batch in batches:
            at = [k for k, x in enumerate(batch.column(0).to_pylist()) if x in chosen.value]
            if at:
                part = batch.take(pa.array(at))
                x = pooled(part.column(1).to_pylist(), table, index)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    # Rows that repeat a doc_id are one example, the first by its bytes: a row a label comes to the driver.
    rows = texts.mapInArrow(features, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).toPandas() if known else None
    model = None
    share = 0.5
    if rows is not None and len(rows):
        rows = rows.sort_values("doc_id")
        x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(np.float64)
        y = rows["doc_id"].map(known).to_numpy()
        share = float(y.mean())
        if 0 < share < 1:
            model = Network(x, y)
    return lambda own, index: model(pooled(own, table, index).astype(np.float64)) if model else np.full(len(own), share)
