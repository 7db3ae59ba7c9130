"""Token ids in a binary format of interleaved static range asymmetric numeral systems.

One segment is a self-contained binary value: magic, sizes, the documents' ids
and lengths, one frequency table that all of its blocks share, and the blocks.
A block codes BLOCK ids over LANES interleaved 64-bit states that share one
stream of 32-bit words, stands alone, and carries a CRC-32 of its ids as
little-endian 32-bit integers, the states at its start, and a checkpoint (states
and stream position) every CHECKPOINT rows of LANES ids, from which a reader can
start in its middle. All lanes advance together in numpy.

Format, little endian: b"LKRA", u32 version, u32 lanes, u32 precision bits, u64
documents, u64 ids, u32 table size, u32 blocks; then the documents' ids (i64),
a byte for each that is 1 where the id is null, and their lengths (i64); the
table's symbols (u32) and frequencies (u32); then each block: u32 ids, u32 crc,
u32 words, u32 checkpoints, the checkpoints (u32 row, u32 word, lanes x u64), words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"LKRA", 1
LANES, BITS, BLOCK, CHECKPOINT = 1024, 18, 1 << 18, 128
_LOW, _U32 = np.uint64(1) << np.uint64(31), np.uint64(32)


def table_of(counts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): frequencies are at least 1 and add up to 2^bits."""
    symbols = np.flatnonzero(counts)
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError("more symbols than the table's precision holds")
    c = counts[symbols].astype(np.float64)
    freq = np.maximum(1, np.floor(c * (total - len(symbols)) / c.sum())).astype(np.int64) if len(symbols) else np.zeros(0, np.int64)
    gap = total - int(freq.sum())
    if len(symbols):
        by_size = np.argsort(-c, kind="stable")
        if gap > 0:
            freq[by_size[0]] += gap
        while gap < 0:
            can = by_size[freq[by_size] > 1][:-gap]
            freq[can] -= 1
            gap += len(can)
    return symbols.astype(np.uint32), freq.astype(np.uint32)


def _encode_block(ids: np.ndarray, slot: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int, bits: int) -> bytes:
    rows = -(-len(ids) // lanes)
    coded = np.zeros(rows * lanes, np.int64)
    coded[: len(ids)] = slot[ids]
    coded[len(ids) :] = coded[0]
    coded = coded.reshape(rows, lanes)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = [None] * rows
    at: dict[int, np.ndarray] = {}
    shift, m = np.uint64(63 - bits), np.uint64(bits)
    for r in range(rows - 1, -1, -1):
        f, s = freq[coded[r]], start[coded[r]]
        over = x >= (f << shift)
        words[r] = x[over].astype(np.uint32)
        x = np.where(over, x >> _U32, x)
        q = x // f
        x = (q << m) + (x - q * f) + s
        if r % CHECKPOINT == 0:
            at[r] = x
    sizes = np.r_[0, np.cumsum([len(w) for w in words])]
    stream = np.concatenate(words)
    out = [struct.pack("<IIII", len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(stream), len(at))]
    out += [struct.pack("<II", r, int(sizes[r])) + at[r].astype("<u8").tobytes() for r in sorted(at)]
    out.append(stream.astype("<u4").tobytes())
    return b"".join(out)


def encode(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, lanes: int = LANES, bits: int = BITS, block: int = BLOCK) -> bytes:
    """One segment of whole documents; ids is all of their token ids in order."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols, freqs = table_of(counts, bits)
    slot = np.zeros(len(counts) or 1, np.int64)
    slot[symbols] = np.arange(len(symbols))
    freq = freqs.astype(np.uint64)
    start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64) if len(freq) else freq
    blocks = [_encode_block(ids[k : k + block], slot, freq, start, lanes, bits) for k in range(0, len(ids), block)]
    head = MAGIC + struct.pack("<IIIQQII", VERSION, lanes, bits, len(lengths), len(ids), len(symbols), len(blocks))
    null = np.array([x is None for x in doc_ids], np.uint8)
    own = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([head, own.tobytes(), null.tobytes(), np.asarray(lengths, "<i8").tobytes(), symbols.astype("<u4").tobytes(), freqs.astype("<u4").tobytes(), *blocks])


def _decode_rows(words: np.ndarray, x: np.ndarray, rows: int, symbol: np.ndarray, freq: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """rows rows of ids from states x on; the states must end where coding began."""
    out = np.empty((rows, len(x)), np.uint32)
    mask, m, at = np.uint64((1 << bits) - 1), np.uint64(bits), 0
    for r in range(rows):
        low = x & mask
        k = symbol[low]
        out[r] = k
        x = freq[k] * (x >> m) + low - start[k]
        short = x < _LOW
        n = int(np.count_nonzero(short))
        if n:
            x[short] = (x[short] << _U32) | words[at : at + n]
            at += n
    if (x != _LOW).any():
        raise ValueError("wrong states at a block's end")
    return out


def decode(blob: bytes, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a segment, or only blocks first to last of its ids; a wrong checksum raises ValueError."""
    if blob[:4] != MAGIC:
        raise ValueError("not a segment")
    version, lanes, bits, docs, total, size, blocks = struct.unpack_from("<IIIQQII", blob, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    at = 4 + struct.calcsize("<IIIQQII")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    own, null, lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
    symbols, freqs = take("<u4", size), take("<u4", size)
    freq = freqs.astype(np.uint64)
    start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64) if size else freq
    symbol = np.repeat(np.arange(size), freqs)
    out = []
    for b in range(blocks):
        n, crc, n_words, n_checks = struct.unpack_from("<IIII", blob, at)
        at += 16
        checks = at
        at += n_checks * (8 + 8 * lanes)
        words = take("<u4", n_words)
        if b < first or last is not None and b >= last:
            continue
        states = np.frombuffer(blob, "<u8", lanes, checks + 8).copy()
        ids = symbols[_decode_rows(words.astype(np.uint64), states, -(-n // lanes), symbol, freq, start, bits).reshape(-1)[:n]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b}: wrong checksum")
        out.append(ids)
    return [None if z else int(x) for x, z in zip(own, null, strict=True)], lengths, np.concatenate(out) if out else np.zeros(0, np.uint32)


def decode_from_checkpoint(blob: bytes, block: int, checkpoint: int) -> np.ndarray:
    """The ids of one block from one of its checkpoints to its end."""
    _, lanes, bits, docs, _, size, _ = struct.unpack_from("<IIIQQII", blob, 4)
    at = 4 + struct.calcsize("<IIIQQII") + 17 * docs
    symbols, freqs = np.frombuffer(blob, "<u4", size, at), np.frombuffer(blob, "<u4", size, at + 4 * size)
    at += 8 * size
    for _ in range(block):
        _, _, n_words, n_checks = struct.unpack_from("<IIII", blob, at)
        at += 16 + n_checks * (8 + 8 * lanes) + 4 * n_words
    n, _, n_words, n_checks = struct.unpack_from("<IIII", blob, at)
    check = at + 16 + checkpoint * (8 + 8 * lanes)
    row, word = struct.unpack_from("<II", blob, check)
    states = np.frombuffer(blob, "<u8", lanes, check + 8).copy()
    words = np.frombuffer(blob, "<u4", n_words, at + 16 + n_checks * (8 + 8 * lanes))[word:].astype(np.uint64)
    freq = freqs.astype(np.uint64)
    start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    rows = -(-n // lanes) - row
    ids = _decode_rows(words, states, rows, np.repeat(np.arange(size), freqs), freq, start, bits).reshape(-1)
    return symbols[ids[: n - row * lanes]]
