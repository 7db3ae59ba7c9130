"""Personal data by fixed patterns and a skip-chain conditional random field.

The base finds emails, ip addresses, card and phone numbers by pattern and check
(base_spans); those spans stay whatever the model says. The model labels the
document's candidate words, those with a digit, an at sign or what a base span
covers: neighbours share chain potentials, and words of equal or similar form,
however far apart, share skip potentials: each with a hub, the first of them in a
base span of each kind, or where there is none with the first of all and the one
before, so a word repeated n times costs at most 5 n links, not n^2, and no distance matters. Sum-product messages run over the
loopy graph until they settle, for a whole batch of documents at once, with the
base's labels clamped. A run of words that the model labels alike, with a
probability of SURE or more, outside base spans, is added as a span if links of
one label between equal or similar forms tie it, over however many, to a base span.

Weights are fitted by pseudo-likelihood in numpy on the candidate words of about
TRAIN_DOCS documents and TRAIN_BYTES (a hash of id and text chooses them), labelled by the base; of
words in base spans that have skip links, half lose their own form's features
there, and words without a link get a twin that has none, so that the links'
potentials learn to carry the label.

Defined cases: a null or empty text has no spans; equal texts get equal spans; no
candidates to learn from: base spans only; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import short_batches

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_BYTES, SURE, STEPS = 4000, 32 << 20, 0.5, 300
#: Messages run until none changes by more than SETTLED; graphs whose loops never settle stop after ROUNDS, many times any path that still matters.
SETTLED, ROUNDS = 1e-3, 1000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9][0-9.]*")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = re.compile(r"[^\s0-9@]*[0-9@]\S*")
_WORD, _MARK = re.compile(r"\S+"), re.compile(r"[0-9@]")
_TRIM = "\"'()[]{}<>,;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kinds are numbers of KINDS, offsets code points."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        # A match takes the whole run of an address's characters before the sign, back to the last match; each is walked once.
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        found = _DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            out.append((0, lo, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for run in _NUMBERS.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                    out.append((1, run.start() + m.start(), run.start() + m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# --- the graph --------------------------------------------------------------------------------------

#: Features of a word: a constant, then the tests of _features.
FEATURES = 20


def _features(word: str, before: str, after: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    dots = word.count(".")
    return [1.0, "@" in word, word[:1] == "+", digits == 0, 0 < digits <= 3, 3 < digits <= 7, 7 < digits <= 15, 15 < digits <= 19, digits > 19, letters == 0, letters > 0 and digits > 0, dots == 3, dots > 3, "-" in word, "(" in word or ")" in word, "=" in word or '"' in word or "_" in word, 13 <= digits <= 19 and luhn("".join(c for c in word if "0" <= c <= "9")), bool(before) and before[-1:] in "0123456789)", bool(after) and after[:1] in "0123456789(+", "/" in word or ":" in word]


class Graph:
    """Candidate words of many texts: features, base labels (0: none), chain and skip links."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end = [], [], []
        rows, self.label, chain, skip, tie = [], [], [], [], []
        for k, (text, found) in enumerate(zip(texts, spans, strict=True)):
            if "@" not in text and not _DIGIT.search(text):
                continue
            mentions: dict[str, list[int]] = {}
            chained: set[int] = set()
            cover = sorted((s, e, kind + 1) for kind, s, e in found)
            at, prev_end, prev = 0, -1, -1
            # What stands before an at sign is a name that may come again on its own.
            names = {text[a:b].partition("@")[0].lower() for a, b, kind in cover if kind == 1}
            for m in (_WORD if names else _CANDIDATE).finditer(text):
                word = m[0].strip(_TRIM.replace(")", "").replace("(", "")) or m[0]
                if names and not (_MARK.search(word) or len(word) > 3 and word.lower() in names):
                    continue
                s = m.start() + m[0].index(word)
                e = s + len(word)
                i = len(self.doc)
                while at < len(cover) and cover[at][1] <= s:
                    at += 1
                label = next((c[2] for c in cover[at : at + 4] if c[0] < e and c[1] > s), 0)
                near = prev >= 0 and s - prev_end <= 2
                if near:
                    chain.append((prev, i))
                rows.append(_features(word, text[self.start[prev] : self.end[prev]] if near else "", text[e + 1 : e + 3]))
                self.doc.append(k), self.start.append(s), self.end.append(e), self.label.append(label)
                for key in _forms(word):
                    mentions.setdefault(key, []).append(i)
                if near:
                    chained.add(i)
                prev, prev_end = i, e
            # Mentions that share a key with a base span hear it alone, once for each key: many mentions don't outvote it.
            heard = {i for own in mentions.values() if any(self.label[j] for j in own) for i in own}
            for own in mentions.values():
                hubs: dict[int, int] = {}
                for i in own:
                    if self.label[i]:
                        hubs.setdefault(self.label[i], i)
                if hubs:
                    skip += [(hub, i) for hub in hubs.values() for i in own if i != hub]
                elif not heard & {*own}:
                    # Only a chain link that was really made stands for a link to the mention before; both tie.
                    after = list(zip(own, own[1:]))
                    skip += [(p, q) for p, q in after if q != p + 1 or q not in chained]
                    skip += [(own[0], i) for i in own[2:]]
                    tie += [(p, q) for p, q in after if q == p + 1 and q in chained]
        self.x = np.array(rows, np.float64).reshape(-1, FEATURES)
        self.y = np.array(self.label, np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.tie = np.array(skip + tie, np.int64).reshape(-1, 2)


def _forms(word: str) -> set[str]:
    """Keys under which a word meets equal and similar ones: its letters and digits, what stands before an at sign, its last seven digits."""
    plain = "".join(c for c in word.lower() if c.isalnum())
    out = {"=" + plain} if len(plain) > 3 else set()
    local = word.lower().partition("@")[0]
    if len(local) > 3:
        out.add("@" + local)
    digits = "".join(c for c in word if "0" <= c <= "9")
    if len(digits) >= 7:
        out.add("#" + digits[-7:])
    return out


class Field:
    """Weights: unary (features x labels), chain (labels x labels, in order), skip (labels x labels, symmetric)."""

    def __init__(self):
        n = len(KINDS) + 1
        self.unary, self.chain, self.skip = np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))

    def fit(self, g: Graph, seed: int = 3) -> Field:
        """Maximise the pseudo-likelihood of g's labels by gradient steps."""
        rng = np.random.default_rng(seed)
        x, labels, skip = g.x.copy(), g.y, g.skip
        linked = np.zeros(len(x), bool)
        linked[skip.reshape(-1)] = True
        x[linked & (labels > 0) & (rng.random(len(x)) < 0.5)] = 0
        # Words that nothing repeats get a twin of the same label without features: the weights of links must carry it.
        alone = np.flatnonzero(~linked)
        twins = np.concatenate([alone[labels[alone] > 0], rng.permutation(alone[labels[alone] == 0])[: int((labels[alone] > 0).sum())]])
        skip = np.concatenate([skip, np.stack([twins, len(x) + np.arange(len(twins))], 1)])
        x, labels = np.concatenate([x, np.zeros((len(twins), FEATURES))]), np.concatenate([labels, labels[twins]])
        y = np.eye(len(KINDS) + 1)[labels]
        # What shares a form with a base span but is none itself has no label to learn from.
        unsure = np.zeros(len(x), bool)
        for i, j in (skip.T, skip.T[::-1]):
            unsure[i[(labels[i] == 0) & (labels[j] > 0)]] = True
        y[unsure] = 0
        before, after, far = np.zeros_like(y), np.zeros_like(y), np.zeros_like(y)
        (ci, cj), (si, sj) = g.chain.T, skip.T
        np.add.at(after, ci, y[cj])
        np.add.at(before, cj, y[ci])
        np.add.at(far, si, y[sj])
        np.add.at(far, sj, y[si])
        weight = 1 / max(1, len(x))
        params = [self.unary, self.chain, self.skip]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            z = x @ self.unary + before @ self.chain + after @ self.chain.T + far @ self.skip
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            d = (p / p.sum(1, keepdims=True) - y) * weight * ~unsure[:, None]
            s = far.T @ d
            grads = [x.T @ d + 1e-5 * self.unary, before.T @ d + (after.T @ d).T + 1e-5 * self.chain, (s + s.T) / 2 + 1e-5 * self.skip]
            for k, q in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                params[k] -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)
        return self

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs of each word's label after loopy sum-product, base labels clamped."""
        unary = g.x @ self.unary
        known = g.y > 0
        unary[known] = -1e12
        unary[known, g.y[known]] = 0.0
        links = np.concatenate([g.chain, g.skip])
        pots = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), *self.chain.shape)), np.broadcast_to(self.skip, (len(g.skip), *self.skip.shape))])
        src, dst = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(links), 2 * len(links)), np.arange(len(links))]
        msg = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds if len(src) else 0):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pots
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            step = 0.5 * (new - new.max(1, keepdims=True) - msg)
            msg += step
            if np.abs(step).max() < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def model_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text's base spans."""
    g = Graph(texts, base)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(g.x):
        return out
    p = field.marginals(g)
    best = p.argmax(1)
    label = np.where(g.y > 0, g.y, np.where(p.max(1) >= SURE, best, 0))
    # Only what skip links tie to a base span of the same kind is added: a lone look-alike is left alone.
    tied = g.y > 0
    a, b = g.tie[label[g.tie[:, 0]] == label[g.tie[:, 1]]].T
    while (one := tied[a] != tied[b]).any():
        tied[a[one]] = tied[b[one]] = True
    pick = tied & (label > 0) & (g.y == 0)
    for i in np.flatnonzero(pick).tolist():
        k, kind, s, e = g.doc[i], int(best[i]) - 1, g.start[i], g.end[i]
        if any(a < e and b > s for _, a, b in base[k]):
            continue
        if out[k] and out[k][-1][0] == kind and s - out[k][-1][2] <= 2:
            out[k][-1] = (kind, out[k][-1][1], e)
        else:
            out[k].append((kind, s, e))
    return out


def fit_field(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """A field fitted on the candidate words of about train_docs documents, and about TRAIN_BYTES of text."""
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, train_docs / max(1, total), TRAIN_BYTES / max(1, size))
    # By id and text: rows without an id, or that share one, are chosen each for itself; equal rows count once.
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("field")), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and ("@" in t or _DIGIT.search(t))]
            # Only the neighbourhoods of candidates go on: the text around them is blanked and folded.
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([_bare(t) for _, t in rows], pa.string())})

    got = some.mapInArrow(lines, "doc_id long, text string").toPandas().sort_values(["doc_id", "text"])
    texts = got["text"].tolist()
    g = Graph(texts, [base_spans(t) for t in texts])
    return Field().fit(g) if len(g.x) else Field()


def _bare(text: str) -> str:
    return " ~ ".join(m[0] for m in re.finditer(r"(?:\S*[0-9@+]\S*\s?)+", text))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row of docs; the counts are the base's."""
    short_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    field = fit_field(texts)
    fitted = bool(np.any(field.unary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in own]
            more = model_spans(own, base, field) if fitted else [[] for _ in own]
            counts = np.array([np.bincount([k for k, _, _ in b], minlength=4) if b else np.zeros(4, int) for b in base], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    **{f"n_{kind}": pa.array(counts[:, k]) for k, kind in enumerate(KINDS)},
                    "base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                    "spans": pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string()),
                    "n_added": pa.array([len(m) for m in more], pa.int64()),
                }
            )

    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
