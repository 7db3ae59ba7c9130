"""Language-model scores from a hierarchical Pitman-Yor model.

A token's context is the token before it, or the start of a text. Every context
that the corpus has is a restaurant of its own; all share one parent, the
restaurant of single words, whose base measure gives UNKNOWN to one unknown symbol
and spreads the rest over the training words. A context's customers are the
training tokens after it, a dish's tables are the customers of its parent.

Gibbs sampling, a block at a time: a sweep takes up all n customers of a dish in
a restaurant and seats them again. What counts of a seating is its number of
tables t, whose conditional distribution is proportional to S(n, t) times the
product over k < t of (a + g k): S are the generalised Stirling numbers of the
discount, a + g k is what opening a table weighs when the dish has k of them
(theta and discounted tables of the restaurant, times the parent's probability).
It is drawn from a table of those numbers up to EXACT customers. Beyond,
Metropolis steps keep the same distribution: where tables are few beside n ** d,
proposals are negative binomial and S comes from its asymptotic series; elsewhere a
proposal seats n customers by a Chinese restaurant process of its own strength
(customer by customer first, then by drawing how many come before the next new
table), where S cancels. No dish is cut or capped, and a dish is two numbers. The parent's dishes are seated alike. All dishes of a sweep
see the restaurants' totals after the sweep before. Dishes of one customer have one
table and are no part of the sweeps. Random numbers come from hashes of (dish,
sweep, step): results don't depend on how the data are dealt. The predictive
probabilities of SAMPLES sweeps, each with its own totals, are averaged.

Plan: a chunk (about CHUNK bytes of text) folds its tokens into distinct (word,
context) pairs with training counts, which go to the words' buckets [shuffle 1]. The
number of buckets follows the bytes of text; words that a bounded sample shows to be
hot are dealt over several buckets by context. A word's home bucket holds its count, its
tables as a context and its customers at the parent. Each sweep is two small jobs:
buckets seat the dishes of two customers and more and mail tables to the homes, homes
seat the parent's dishes and mail totals back. At last homes mail every bucket what
it needs, and the pairs' probabilities go back to the chunks. Nothing but
sums comes to the driver; every step reads written tables.

Defined cases: a null text is empty and has one token, the end; equal texts get
equal scores; with no training rows every word is unknown; no rows give no rows; a
null doc_id is hashed as an empty text; input columns but doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import discard, forget_shuffles, give_back, keep, short_batches

CHUNK, BUCKET, SAMPLE = 8 << 20, 12 << 20, 16 << 20
BURN_IN, SAMPLES = 2, 3
THETA, UNKNOWN = 1.0, 0.9
#: Customers that are seated one by one before waiting times are drawn; both ways give the same distribution.
SINGLY = 24
#: Up to so many customers the conditional is drawn from a table of Stirling numbers; beyond, by so many Metropolis steps a sweep.
EXACT, TRIES = 32, 4
#: Steps that tune a proposal; results are right whatever they are.
HALVINGS = 10
#: Stand for the hashes of the end and of the start of a text.
END_HASH, START_HASH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHORT = np.uint64(16)  # contexts travel as the upper 48 bits of their hashes
_MAIL = "key long, kind int, src long, data binary"
STATE, LETTER, PAIRS, DOCS = 0, 1, 2, 3


def held_out(doc_id: int | None, modulus: int = 10) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == 0


# --- numbers on the wire ----------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, byte plane by byte plane."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.kind), a.itemsize, len(a))], np.int64)
    body = head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a))
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    at, out = 8 + 24 * n, []
    for kind, size, length in np.frombuffer(body, np.int64, 3 * n, 8).reshape(n, 3).tolist():
        planes = np.frombuffer(body, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
        at += size * length
    return out


def _halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _row(key: int, kind: int, src: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "kind": pa.array([kind], pa.int32()), "src": pa.array([src], pa.int64()), "data": pa.array([data], pa.binary())})


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows) if rows else _row(0, 0, 0, b"").schema.empty_table()


def _sorted(t: pa.Table, kind: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(src, arrays) of the rows of a kind, by src."""
    kinds, src, data = t.column("kind").to_numpy(), t.column("src").to_numpy(), t.column("data")
    at = np.flatnonzero(kinds == kind)
    for k in at[np.argsort(src[at], kind="stable")].tolist():
        yield int(src[k]), _unpack(data[k].as_py())


def _folded(samples: list[np.ndarray]) -> list[np.ndarray]:
    """The first of several like arrays, and how each differs from the one before, signs last."""
    d = [(y.astype(np.int64) - x).astype(np.int32) for x, y in zip(samples, samples[1:])]
    return [*samples[:1], *[(x << 1 ^ x >> 31).view(np.uint32) for x in d]]


def _unfolded(folded: list[np.ndarray]) -> list[np.ndarray]:
    out = list(folded[:1])
    for x in folded[1:]:
        out.append(out[-1] + ((x >> np.uint32(1)).astype(np.int64) ^ -(x & np.uint32(1)).astype(np.int64)))
    return out


# --- seating ----------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-mixed bits of each number."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1), one for each key and step."""
    with np.errstate(over="ignore"):
        mixed = _mix(key + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series, eight further up."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def crp_tables(n: np.ndarray, theta: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """How many tables n customers take in a Chinese restaurant process of strength theta > -d and discount d."""
    order = np.argsort(-n, kind="stable")
    n, theta, key = n[order], theta[order], key[order]
    t = np.ones(len(n))
    most = int(n[0]) if len(n) else 0
    for i in range(1, min(most, SINGLY)):
        k = int(np.searchsorted(-n, -i, "left"))  # those with more than i customers
        p = (theta[:k] + d * t[:k]) / (theta[:k] + i)
        t[:k] += _uniform(key[:k], i) < p
    k = int(np.searchsorted(-n, -SINGLY, "left"))
    at, step = np.arange(k), SINGLY
    m = np.full(k, float(SINGLY))  # customers who sit
    while len(at):
        stay, new, left = m[at] - d * t[at], theta[at] + m[at], n[at] - m[at]
        wide, u = new - stay, _uniform(key[at], step)
        # Where every fifth customer or more opens a table, one comes at a time.
        often = wide * 5 > new
        k = np.ones(len(at))
        opens = u * new < wide
        far = np.flatnonzero(~often)
        if len(far):
            stay, new, wide, left, log_u = stay[far], new[far], wide[far], left[far], np.log(u[far])
            first = _lgamma(new) - _lgamma(stay)
            # The least k with a chance below u: Gamma(x + k) / Gamma(x + k + b) is about (x + k + (b - 1) / 2) ** -b, then Newton.
            middle = stay + (wide - 1) / 2
            wait = middle * np.expm1(np.minimum(-log_u / wide, 60))
            for _ in range(2):
                wait = np.clip(wait, 0, left)
                wait += (_lgamma(stay + wait) - _lgamma(new + wait) + first - log_u) * (middle + wait) / wide
            k[far] = np.maximum(1, np.ceil(wait))
            opens[far] = k[far] <= left
        m[at] += np.minimum(k, n[at] - m[at])
        t[at] += opens
        at = at[m[at] < n[at]]
        step += 1
    out = np.empty(len(n))
    out[order] = t
    return out.astype(np.int64)


def stirling(most: int, d: float) -> list[np.ndarray]:
    """Logarithms of the generalised Stirling numbers S(n, 1 ... n) of discount d, for n up to most."""
    rows = [np.zeros(0), np.zeros(1)]
    for n in range(1, most):
        stay = rows[n] + np.log(n - d * np.arange(1, n + 1))
        rows.append(np.logaddexp(np.r_[stay, -np.inf], np.r_[-np.inf, rows[n]]))
    return rows


def reseat(n: np.ndarray, t: np.ndarray, a: np.ndarray, g: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """New numbers of tables of dishes with n customers and t tables, where opening one beside k others weighs a + g k."""
    out = np.minimum(np.maximum(t, 1), n)
    small = np.flatnonzero((n > 1) & (n <= EXACT))
    small = small[np.argsort(n[small], kind="stable")]
    of_size = stirling(EXACT, d)
    cut = np.searchsorted(n[small], np.arange(2, EXACT + 2))
    for size, lo, hi in zip(range(2, EXACT + 1), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        for at in (small[k : min(k + 65536, hi)] for k in range(lo, hi, 65536)):
            steps = np.log(a[at][:, None] + g[at][:, None] * np.arange(1, size))
            logs = np.concatenate([np.zeros((len(at), 1)), np.cumsum(steps, axis=1)], axis=1) + of_size[size]
            chances = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
            out[at] = 1 + (chances < _uniform(key[at], 0)[:, None] * chances[:, -1:]).sum(1)
    mean = 1 + (a + g) / (d - g)
    few = mean + 4 * np.sqrt((a + g) * d) / (d - g) <= n**d
    for on, step, tries in ((few, _few, 2), (~few, _many, TRIES)):
        at = np.flatnonzero(on & (n > EXACT))
        for k in range(tries if len(at) else 0):
            with np.errstate(over="ignore"):
                out[at] = step(n[at], out[at], a[at], g[at], d, _mix(key[at] + np.uint64(k + 1)))
    return out


def _few(n: np.ndarray, t: np.ndarray, a: np.ndarray, g: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """A Metropolis step where tables are few beside n ** d: there S(n, t) is nearly 1 / (d ** (t - 1) (t - 1)!) times S(n, 1), so proposals are negative binomial."""
    r, odds = (a + g) / g, g / d
    new = np.ones(len(n), np.int64)
    mean = (a + g) / (d - g)
    for k in np.flatnonzero(mean > 64).tolist():
        new[k] += np.random.Generator(np.random.Philox(int(key[k]))).negative_binomial(r[k], 1 - odds[k])
    at = np.flatnonzero(mean <= 64)
    chance, left, j = np.exp(r[at] * np.log1p(-odds[at])), _uniform(key[at], 1), 0
    while len(at):
        on = left >= chance
        at, left, chance, j = at[on], (left - chance)[on], chance[on], j + 1
        chance *= (a[at] + g[at] * j) / (j * d)
        new[at] += 1
        if j > 1000:
            break
    new = np.minimum(new, n)

    def weight(tables: np.ndarray) -> np.ndarray:
        """S(n, t) over its leading term, by the alternating sum over Gamma(n - j d) / Gamma(1 - j d)."""
        total, ways, first = np.ones(len(n)), np.ones(len(n)), _lgamma(n - d)
        for i in range(1, 60):
            ways = ways * (tables - i) / i
            x = (i + 1) * d
            term = ways * np.exp(_lgamma(np.maximum(n - x, 1e-9)) - first) * (math.gamma(x) * math.sin(math.pi * x) / math.pi * math.gamma(1 - d) * (-1) ** i)
            total += term
            if not len(term) or np.abs(term).max() < 1e-13:
                break
        return np.maximum(total, 1e-300)

    reach = np.maximum(1, n**d).astype(np.int64)
    return np.where((_uniform(key, 0) * weight(np.minimum(t, reach)) < weight(np.minimum(new, reach))) & (new <= reach), new, np.minimum(t, reach))


def _many(n: np.ndarray, t: np.ndarray, a: np.ndarray, g: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """A Metropolis step where tables are many: proposals are a Chinese restaurant process's own numbers of tables."""
    # It weighs a table like the conditional where there are as many as it expects: theta + d m = a + g m for m = E(theta), by bisection.
    lo, hi, slope = np.full(len(n), -d), a.copy(), d - g
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        expected = (np.exp(_lgamma(mid + n + d) - _lgamma(mid + n) + _lgamma(mid + 1) - _lgamma(mid + d)) - mid) / d
        high = expected * slope > a - mid
        hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
    theta = (lo + hi) / 2
    new = crp_tables(n, theta, d, key)

    def log_weight(tables: np.ndarray) -> np.ndarray:
        k, x, y = tables.astype(np.float64), a / g, theta / d
        return (k - 1) * np.log(g / d) + _lgamma(x + k) - _lgamma(x + 1) - _lgamma(y + k) + _lgamma(y + 1)

    return np.where(np.log(_uniform(key, 0)) < log_weight(new) - log_weight(t), new, t)


# --- chunks -----------------------------------------------------------------------------------------


class Dealer:
    """Which bucket holds what: words at home by hash; a hot word's pairs over several buckets by context."""

    def __init__(self, buckets: int, hot: dict[int, int]):
        self.buckets = np.uint64(buckets)
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[h] for h in sorted(hot)] + [1], np.uint64)

    def home(self, short: np.ndarray) -> np.ndarray:
        """By ranges of hashes, so that a letter's sorted hashes share their upper bytes."""
        return ((short >> np.uint64(16)) * self.buckets >> np.uint64(32)).astype(np.int64)

    def pair(self, word: np.ndarray, short: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, word)
        hot = at < len(self.hot)
        hot[hot] = self.hot[at[hot]] == word[hot]
        parts = self.parts[np.where(hot, at, len(self.hot))]
        return (self.home(word >> _SHORT) + (short % parts).astype(np.int64)) % int(self.buckets)

    def homed(self, ids: np.ndarray, short: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids, by home and value; the place of each of ids among them; their homes."""
        u, inverse = np.unique(ids, return_inverse=True)
        home = self.home(u >> short)
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        return u[order], rank[inverse], home[order]


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words of each text, number of the distinct word at each place, distinct words)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = parts.flatten().cast(pa.large_binary())
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    coded = flat.filter(full).dictionary_encode()
    return np.diff(upto[parts.offsets.to_numpy()]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _chunk_rows(number: int, keys: list, texts: list[str | None], dealer: Dealer) -> Iterator[pa.RecordBatch]:
    """A chunk's rows: for each bucket its words and pairs, and one row of its documents."""
    held = np.array([held_out(k) for k in keys], bool)
    lens, ids, words = _tokens(texts)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words] + [int(END_HASH), int(START_HASH)], np.uint64)
    end, start, many = len(words), len(words) + 1, len(words) + 2
    del words
    short = hashes >> _SHORT
    home = dealer.home(short)
    order = np.lexsort((hashes, home))
    rank = np.empty(many, np.int64)
    rank[order] = np.arange(many)
    doc_ends = np.cumsum(lens)
    tokens = np.insert(ids, doc_ends, end)
    n_tokens = lens + 1
    context = np.empty(len(tokens), np.int64)
    context[1:] = tokens[:-1]
    context[np.cumsum(n_tokens) - n_tokens] = start
    train = np.repeat(~held, n_tokens)
    count = np.bincount(tokens[train], minlength=many)
    count[start] = int((~held).sum())
    distinct, at = np.unique(rank[tokens] * many + rank[context], return_inverse=True)
    n = np.bincount(at[train], minlength=len(distinct))
    w, c = order[distinct // many], order[distinct % many]
    bucket = dealer.pair(hashes[w], short[c])
    # Pairs by bucket, word and context; every word is also listed at home.
    places = bucket * many + rank[w]
    by = np.lexsort((short[c], places))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    listed = np.unique(np.concatenate([places, home * many + rank]))
    runs = np.searchsorted(places[by], listed, "right") - np.searchsorted(places[by], listed, "left")
    at_bucket, own = listed // many, order[listed % many]
    own_count = np.where(home[own] == at_bucket, count[own], 0)
    low, high = _halves(short[c[by]])
    n = n[by].astype(np.uint32)
    some = np.flatnonzero(np.r_[True, at_bucket[1:] != at_bucket[:-1]])
    pairs_upto = np.r_[0, np.cumsum(runs)]
    for lo, hi in zip(some.tolist(), [*some[1:].tolist(), len(listed)], strict=True):
        p, q = pairs_upto[lo], pairs_upto[hi]
        yield _row(int(at_bucket[lo]), PAIRS, number, _pack(hashes[own[lo:hi]], runs[lo:hi].astype(np.uint32), own_count[lo:hi].astype(np.uint32), low[p:q], high[p:q], n[p:q]))
    # A document's pairs, in order, by their distances.
    doc = np.repeat(np.arange(len(lens)), n_tokens)
    at = place[at]
    at = at[np.lexsort((at, doc))]
    steps = np.diff(at, prepend=0)
    firsts = np.cumsum(n_tokens) - n_tokens
    steps[firsts] = at[firsts]
    yield _row(number, DOCS, -1, _pack(np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys], np.uint8), held.astype(np.uint8), n_tokens.astype(np.int64), steps.astype(np.uint32)))


def _chunks(batches: Iterator[pa.RecordBatch], dealer: Dealer) -> Iterator[pa.RecordBatch]:
    number, keys, texts, size = None, [], [], 0
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column(2)[0].as_py() << 24
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= CHUNK:
                yield from _chunk_rows(number, keys, texts, dealer)
                number, keys, texts, size = number + 1, [], [], 0
                give_back()
    if keys:
        yield from _chunk_rows(number, keys, texts, dealer)
        give_back()


# --- buckets ----------------------------------------------------------------------------------------


def _merged(t: pa.Table) -> tuple[np.ndarray, ...]:
    """All chunks' pairs of one bucket: words with their counts; pairs' words, contexts and counts; the chunks, their numbers of pairs, and which pairs they ask for."""
    got = list(_sorted(t, PAIRS))
    words, own = np.unique(np.concatenate([g[0] for _, g in got]), return_inverse=True)
    c = np.bincount(own, weights=np.concatenate([g[2] for _, g in got]), minlength=len(words)).astype(np.int64)
    word = np.repeat(own, np.concatenate([g[1] for _, g in got]))
    context = np.concatenate([_whole(g[3], g[4]) for _, g in got])
    counts = np.concatenate([g[5] for _, g in got])
    chunks, sizes = np.array([k for k, _ in got], np.int64), np.array([len(g[5]) for _, g in got], np.int64)
    del got
    order = np.lexsort((context, word))
    word, context = word[order], context[order]
    first = np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])][: len(word)]
    asks = np.empty(len(order), np.int64)
    asks[order] = np.cumsum(first) - 1
    n = np.bincount(asks, weights=counts, minlength=int(first.sum())).astype(np.int64)
    return words, c, word[first], context[first], n, chunks, sizes, asks


def _letters(number: int, dealer: Dealer, contexts: tuple, words: tuple, more: list) -> list[pa.RecordBatch]:
    """Rows to the homes of (contexts, their homes, numbers ...) and (words, their homes, numbers ...); more: arrays that go home to the bucket itself."""
    ids, homes, *rest = contexts
    own, own_homes, *own_rest = words
    out = []
    for g in np.union1d(np.union1d(homes, own_homes), [number] if more else []).astype(np.int64).tolist():
        x, y = slice(*np.searchsorted(homes, [g, g + 1])), slice(*np.searchsorted(own_homes, [g, g + 1]))
        out.append(_row(g, LETTER, number, _pack(*_halves(ids[x]), *[r[x].astype(np.uint32) for r in rest], own[y], *[r[y].astype(np.uint32) for r in own_rest], *(more if g == number else [m[:0] for m in more]))))
    return out


def _first_rows(t: pa.Table, dealer: Dealer) -> pa.Table:
    """A bucket's first rows: its pairs; the state of the dishes that sweeps seat, and letters to the homes about those."""
    number = int(t.column("key")[0].as_py())
    words, c, word, context, n, chunks, sizes, asks = _merged(t)
    runs = np.bincount(word, minlength=len(words)).astype(np.uint32)
    steps = np.diff(asks, prepend=0).astype(np.int32)
    rows = [_row(number, PAIRS, number, _pack(words, runs, *_halves(context), n.astype(np.uint32), chunks, sizes, steps, c.astype(np.uint32)))]
    many = np.flatnonzero(n > 1)
    seated, w = np.unique(word[many], return_inverse=True)
    state = _row(number, STATE, number, _pack(words[seated], np.bincount(w, minlength=len(seated)).astype(np.uint32), *_halves(context[many]), n[many].astype(np.uint32), np.ones(len(many), np.uint32)))
    some = _state_letters(number, dealer, words[word[many]], context[many], np.ones(len(many), np.int64))
    ones = np.array([int((n == 1).sum()), int((n == 2).sum())])
    out = _table(rows + [state] + some)
    kind = ["pairs"] + ["state"] + ["some"] * len(some)
    out = out.append_column("what", pa.array(kind))
    return out.append_column("one", pa.array([int(ones[0])] + [0] * (len(kind) - 1), pa.int64())).append_column("two", pa.array([int(ones[1])] + [0] * (len(kind) - 1), pa.int64()))


def _whole_letters(number: int, blob: bytes, dealer: Dealer) -> list[pa.RecordBatch]:
    """A bucket's letters about all its pairs: their contexts and words, with how many dishes of one customer each has; to itself, its own words' counts."""
    words, runs, low, high, n, _, _, _, c = _unpack(blob)
    context, word = _whole(low, high), np.repeat(np.arange(len(words)), runs)
    u, at, homes = dealer.homed(context, np.uint64(0))
    v, of, word_homes = dealer.homed(words, _SHORT)
    mine, one = dealer.home(words >> _SHORT) == number, n == 1
    count = lambda place, size: np.bincount(place[one], minlength=size)
    return _letters(number, dealer, (u, homes, count(at, len(u))), (v, word_homes, count(of[word], len(v))), [words[mine], c[mine]])


def _state_letters(number: int, dealer: Dealer, words: np.ndarray, context: np.ndarray, t: np.ndarray) -> list[pa.RecordBatch]:
    u, at, homes = dealer.homed(context, np.uint64(0))
    v, of, word_homes = dealer.homed(words, _SHORT)
    return _letters(number, dealer, (u, homes, np.bincount(at, weights=t, minlength=len(u))), (v, word_homes, np.bincount(of, weights=t, minlength=len(v))), [])


class Totals:
    """What a sweep knows of the whole: training words and tokens, the two levels' discounts, customers and tables of the parent."""

    def __init__(self, words: int, tokens: int, discounts: tuple[float, float], customers: int, tables: int):
        self.words, self.tokens, self.discounts, self.customers, self.tables = words, tokens, discounts, customers, tables

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.where(known, (1 - UNKNOWN) / max(1, self.words), UNKNOWN)

    def parent(self, customers: np.ndarray, tables: np.ndarray, known: np.ndarray) -> np.ndarray:
        d = self.discounts[1]
        return (customers - d * tables + (THETA + d * self.tables) * self.base(known)) / (THETA + self.customers)


def _joined(replies: list[list[np.ndarray]], k: int, kind=np.float64) -> np.ndarray:
    return np.concatenate([r[k] for r in replies]).astype(kind) if replies else np.zeros(0, kind)


def _seat(t: pa.Table, dealer: Dealer, totals: Totals, sweep: int) -> pa.Table:
    """One sweep over a bucket's dishes: the new state, and letters to the homes."""
    number = int(t.column("key")[0].as_py())
    (_, (words, runs, low, high, n, now, *kept)) = next(_sorted(t, STATE))
    replies = [g for _, g in _sorted(t, LETTER)]
    context, word = _whole(low, high), np.repeat(words, runs)
    _, at, _ = dealer.homed(context, np.uint64(0))
    _, of, _ = dealer.homed(word, _SHORT)
    tables, customers, root = (_joined(replies, k) for k in range(3))
    d = totals.discounts[0]
    above = totals.parent(customers, root, np.ones(len(root), bool))[of]
    with np.errstate(over="ignore"):
        key = _mix(_mix(word ^ np.uint64(sweep + 1)) + context)
    old = now.astype(np.int64)
    new = reseat(n.astype(np.int64), old, (THETA + d * np.maximum(0, tables[at] - old)) * above, d * above, d, key).astype(np.uint32)
    kept = [*kept, *([new] if sweep >= BURN_IN else [])]
    # After the last sweep only the samples are asked for, in the order of the pairs.
    last = sweep == BURN_IN + SAMPLES - 1
    state = _row(number, STATE, number, _pack(*kept) if last else _pack(words, runs, low, high, n, new, *kept))
    return _table([state] + _state_letters(number, dealer, word, context, new))


def _home(t: pa.Table, totals: Totals | None, sweep: int) -> pa.Table:
    """Homes after a sweep: totals of contexts and words, the parent's dishes seated again; replies to the buckets; sums as columns.

    The first time (no totals yet) the letters about all pairs make the state; later they add to what single customers fixed.
    """
    number = int(t.column("key")[0].as_py())
    if totals is None:
        whole = [g for _, g in _sorted(t, PAIRS)]
        own, c = next(g[-2:] for g in whole if len(g[-2]))
        order = np.argsort(own)
        own, c = own[order], c[order].astype(np.int64)
        fixed_t, fixed_n, root, kept = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), []
        for low, high, single, words, w_single, _, _ in whole:
            fixed_t += np.bincount(np.searchsorted(own >> _SHORT, _whole(low, high)), weights=single, minlength=len(own)).astype(np.int64)
            fixed_n += np.bincount(np.searchsorted(own, words), weights=w_single, minlength=len(own)).astype(np.int64)
    else:
        own, *rest = next(_sorted(t, STATE))[1]
        c, fixed_t, fixed_n, root, *kept = (x.astype(np.int64) for x in rest)
    tables, customers = fixed_t.copy(), fixed_n.copy()
    asked = []
    for src, (low, high, some, words, w_some) in _sorted(t, LETTER):
        at, of = np.searchsorted(own >> _SHORT, _whole(low, high)), np.searchsorted(own, words)
        tables += np.bincount(at, weights=some, minlength=len(own)).astype(np.int64)
        customers += np.bincount(of, weights=w_some, minlength=len(own)).astype(np.int64)
        asked.append((src, at, of))
    root = np.minimum(np.maximum(root, customers > 0), customers)
    many = np.flatnonzero(customers > 1)
    if totals is not None and len(many):
        d = totals.discounts[1]
        base = totals.base(np.ones(len(many), bool))
        with np.errstate(over="ignore"):
            key = _mix(_mix(own[many] + np.uint64(sweep + 1)))
        root[many] = reseat(customers[many], root[many], (THETA + d * np.maximum(0, totals.tables - root[many])) * base, d * base, d, key)
    if totals is not None and sweep >= BURN_IN:
        kept = [*kept, tables, customers, root]
    rows = [_row(number, STATE, number, _pack(own, *[x.astype(np.uint32) for x in (c, fixed_t, fixed_n, root, *kept)]))]
    rows += [_row(src, LETTER, number, _pack(*[x.astype(np.uint32) for x in (tables[at], customers[of], root[of])])) for src, at, of in asked]
    out = _table(rows)
    real = own != START_HASH
    sums = {"customers": customers.sum(), "tables": root.sum(), "tokens": c[real].sum(), "words": (c[real] > 0).sum(), "one": (customers == 1).sum(), "two": (customers == 2).sum()}
    for name, x in sums.items():
        out = out.append_column(name, pa.array([int(x)] + [0] * (len(rows) - 1), pa.int64()))
    return out


def _last_letters(t: pa.Table) -> pa.Table:
    """Homes' replies to the letters about all pairs: counts, and each sample's tables and customers."""
    number = int(t.column("key")[0].as_py())
    state = next(_sorted(t, STATE), None)
    own, c, _, _, _, *kept = state[1]
    rows = []
    for src, (low, high, _, words, *_) in _sorted(t, PAIRS):
        at, of = np.searchsorted(own >> _SHORT, _whole(low, high)), np.searchsorted(own, words)
        rows.append(_row(src, LETTER, number, _pack(c[at], *_folded([x[at] for x in kept[0::3]]), c[of], *_folded([x[of] for x in kept[1::3]]), *_folded([x[of] for x in kept[2::3]]))))
    return _table(rows)


def _answers(t: pa.Table, dealer: Dealer, samples: list[Totals]) -> pa.Table:
    """For every chunk, the logarithms of its pairs' probabilities in this bucket, and their words' counts."""
    number = int(t.column("key")[0].as_py())
    words, runs, low, high, n, chunks, sizes, steps, _ = next(_sorted(t, PAIRS))[1]
    tables = next(_sorted(t, STATE))[1]
    replies = [g for _, g in _sorted(t, LETTER)]
    s, context, word = len(samples), _whole(low, high), np.repeat(np.arange(len(words)), runs)
    _, at, _ = dealer.homed(context, np.uint64(0))
    _, of, _ = dealer.homed(words, _SHORT)
    c_of = _joined(replies, s + 1, np.int64)[of]
    known, customers = c_of > 0, _joined(replies, 0)[at]
    of_context, of_word, at_root = (_unfolded([_joined(replies, k + x, np.uint32) for x in range(s)]) for k in (1, s + 2, 2 * s + 2))
    p = np.zeros(len(n))
    many = n > 1
    for k, totals in enumerate(samples):
        d = totals.discounts[0]
        here = np.minimum(n, 1).astype(np.float64)
        here[many] = tables[k]
        above = totals.parent(of_word[k].astype(np.float64)[of], at_root[k].astype(np.float64)[of], known)
        p += n - d * here + (THETA + d * of_context[k].astype(np.float64)[at]) * above[word]
    # Logarithms travel as the upper 24 bits of single precision: five digits.
    logs, count = np.log10(p / s / (THETA + customers)).astype(np.float32).view(np.uint32) + np.uint32(128), c_of[word].astype(np.uint32)
    low, high = (logs >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.uint16), (logs >> np.uint32(24)).astype(np.uint8)
    asks = np.cumsum(steps, dtype=np.int64)
    ends = np.cumsum(sizes)
    return _table([_row(chunk, LETTER, number, _pack(low[asks[lo:hi]], high[asks[lo:hi]], count[asks[lo:hi]])) for chunk, lo, hi in zip(chunks.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True) if lo < hi])


def _add_up(t: pa.Table, totals: Totals) -> pa.Table:
    """A chunk's documents with their sums."""
    keys, null, held, n_tokens, steps = next(_sorted(t, DOCS))[1]
    got = [g for _, g in _sorted(t, LETTER)]
    logs = (_joined(got, 1, np.uint32) << np.uint32(24) | _joined(got, 0, np.uint32) << np.uint32(8)).view(np.float32).astype(np.float64)
    c = _joined(got, 2, np.int64)
    firsts = np.cumsum(n_tokens) - n_tokens
    upto = np.cumsum(steps, dtype=np.int64)
    at = upto - np.repeat(upto[firsts] - steps[firsts], n_tokens)
    base = np.log10((c + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))
    score = np.add.reduceat(logs[at], firsts)
    out = {
        "doc_id": pa.array(keys, mask=null.astype(bool)),
        "held_out": pa.array(held.astype(bool)),
        "n_tokens": pa.array(n_tokens),
        "n_known": pa.array(np.add.reduceat((c > 0)[at].astype(np.int64), firsts)),
        "train_tokens": pa.array(np.full(len(keys), totals.tokens, np.int64)),
        "base_score": pa.array(np.add.reduceat(base[at], firsts)),
        "score": pa.array(score),
        "perplexity": pa.array(10 ** (-score / n_tokens)),
    }
    return pa.table(out)


# --- the operator -----------------------------------------------------------------------------------


def hot_words(texts: DataFrame, total: int, buckets: int) -> dict[int, int]:
    """Words that are more than half a bucket's share of a sample of about SAMPLE bytes: in how many buckets each is dealt. It steers the work, not the results."""
    if buckets < 2:
        return {}
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(1 << 20)) < max(1, (SAMPLE << 20) // max(total, SAMPLE)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, words = _tokens(batch.column(1).to_pylist())
            n = np.bincount(ids, minlength=len(words))
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)), "n": pa.array(n)})

    counted = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    all_of = counted.agg(F.sum("n")).first()[0] or 0
    # Shares add up to one, so at most 2 x buckets words pass.
    hot = counted.where(F.col("n") * 2 * buckets > all_of).collect()
    return {r["h"] % (1 << 64): min(buckets, -(-2 * buckets * r["n"] // all_of)) for r in hot}


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    dealer = Dealer(buckets, hot_words(texts, total, buckets))

    def first(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == DOCS:
            n = pa.array(np.zeros(t.num_rows, np.int64))
            return t.append_column("what", pa.array(["docs"] * t.num_rows)).append_column("one", n).append_column("two", n)
        out = _first_rows(t, dealer)
        give_back()
        return out

    # One shuffle deals out pairs by bucket; documents pass it by chunk, so that texts are read once.
    dealt = texts.mapInArrow(lambda batches: _chunks(batches, dealer), _MAIL)
    begun = keep(dealt.groupBy(F.when(F.col("kind") == DOCS, -1 - F.col("key")).otherwise(F.col("key"))).applyInArrow(first, _MAIL + ", what string, one long, two long"), "begun")
    forget_shuffles(docs.sparkSession)
    part = lambda what, kind: begun.where(F.col("what") == what).select("key", F.lit(kind).alias("kind"), "src", "data")
    ones = begun.agg(F.sum("one"), F.sum("two")).first()

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                yield from _whole_letters(key, blob.as_py(), dealer)
                give_back()

    # Made when they are asked for, at the start and at the end, rather than stored.
    whole = part("pairs", PAIRS).mapInArrow(letters, _MAIL).withColumn("kind", F.lit(PAIRS))

    def jobs(rows: DataFrame, fn, more: str = "") -> DataFrame:
        def run(t: pa.Table) -> pa.Table:
            out = fn(t)
            give_back()
            return out

        return rows.groupBy("key").applyInArrow(run, _MAIL + more)

    sums = ", customers long, tables long, tokens long, words long, one long, two long"

    def homes_after(rows: DataFrame, totals: Totals | None, sweep: int) -> tuple[DataFrame, dict]:
        out = keep(jobs(rows, lambda t: _home(t, totals, sweep), sums), "homes")
        got = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "tables", "tokens", "words", "one", "two")]).first().asDict()
        return out, got

    def discount(one: int | None, two: int | None) -> float:
        """From how many dishes have one and two customers."""
        return min(0.95, max(0.05, (one or 0) / max(1, (one or 0) + 2 * (two or 0))))

    def seating(totals: Totals, sweep: int):
        return lambda t: _seat(t, dealer, totals, sweep)

    rows_of = lambda df, kind: df.where(F.col("kind") == kind).select("key", "kind", "src", "data")
    homes, got = homes_after(whole.unionByName(part("some", LETTER)), None, 0)
    discounts = (discount(*ones), discount(got["one"], got["two"]))
    totals = Totals(got["words"], got["tokens"], discounts, got["customers"], got["tables"])
    state, samples = part("state", STATE), []
    for sweep in range(BURN_IN + SAMPLES):
        held = totals
        seated = keep(jobs(state.unionByName(rows_of(homes, LETTER)), seating(held, sweep)), "seated")
        before = homes
        homes, got = homes_after(rows_of(before, STATE).unionByName(rows_of(seated, LETTER)), held, sweep)
        discard(before, *([last] if sweep else []))
        state, last = rows_of(seated, STATE), seated
        totals = Totals(totals.words, totals.tokens, discounts, got["customers"], got["tables"])
        if sweep >= BURN_IN:
            samples.append(totals)
    forget_shuffles(docs.sparkSession)
    replies = keep(jobs(rows_of(homes, STATE).unionByName(whole), _last_letters), "replies")
    forget_shuffles(docs.sparkSession)
    answers = jobs(part("pairs", PAIRS).unionByName(state).unionByName(replies), lambda t: _answers(t, dealer, samples))
    return answers.unionByName(part("docs", DOCS)).groupBy("key").applyInArrow(
        lambda t: _add_up(t, totals), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
