"""Whole texts to token ids, and the ids in the files of rans.py, written and read by Spark.

A byte-level BPE never merges across the boundaries of its pre-tokenisation, and
none of those runs from a visible character into a space. So a batch of texts is
cut before each run of ASCII white space, equal pieces are folded (Arrow's
dictionary encoding), each distinct pre-token is encoded once by the tokenizers
library's BPE model, and the ids are laid out again. A text with other Unicode
white space or with the string of a special token goes whole to the tokenizer.

Documents are dealt by doc_id ranges and sorted, so a partition's segments
follow each other; a reader learns each partition's first id from one count a
partition. A segment closes at the end of the document that fills it, and is a
row of a Parquet table: Spark's commit makes rewriting after a loss safe.

Defined cases: a null text is an empty one (only the end id); a null doc_id comes
first; rows that share a doc_id stay together in an order fixed by their text;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import rans
from larkspur.session import give_back, shared_dir, short_batches

END = 2
#: Ids after which a segment closes, and characters of text that are tokenised at once.
SEGMENT, LOT = 1 << 20, 8 << 20
#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space, and what either regex dialect takes for it, outside ASCII's six.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Pre-tokens that a worker remembers between tasks.
_CACHE = 500_000


def _bytes_to_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class Encoder:
    """Texts to ids by one tokenizer file, remembering pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chars = _bytes_to_chars()
        self.space = self.chars[32]
        self.split = regex.compile(PATTERN).findall
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for a file in each worker process."""
        store = sys.modules.setdefault("_larkspur_encoders", types.ModuleType("_larkspur_encoders")).__dict__
        if path not in store:
            store[path] = cls(path)
        if len(store[path].known) > _CACHE:
            store[path].known.clear()
        return store[path]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece: white space and what follows it up to the next."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            parts = (piece,)
        elif body[-1:] in ",.!?;:" and body[:-1].isalpha():
            parts = (piece[:-1], piece[-1])
        else:
            parts = self.split(piece)
        if len(parts) == 1:
            return self._known(parts[0])
        out: tuple[int, ...] = ()
        for p in parts:
            out += self.known.get(p) or self._known(p)
        return out

    def _known(self, p: str) -> tuple[int, ...]:
        """The ids of one pre-token, from now on remembered."""
        body = p[1:] if p[:1] == " " else p
        if body.isascii() and body.isalpha():
            text = p if body is p else self.space + body
        else:
            text = p.encode().decode("latin-1").translate(self.chars)
        got = self.known[p] = tuple([t.id for t in self.model.tokenize(text)])
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of texts, each closed by END."""
        plain = [not (_ODD.search(t) or self.special and self.special.search(t)) for t in texts]
        raw = [t.encode() if ok else b"" for t, ok in zip(texts, plain, strict=True)]
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        space = _SPACE[data]
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[firsts[sizes > 0]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        # Most pieces are one pre-token, by which the ids are known; no pre-token is empty of ids.
        known, piece = self.known.get, self._piece
        ids = [known(p) or piece(p) for p in pieces.dictionary.cast(pa.string()).to_pylist()] + [(END,)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
        heads = np.cumsum(lens) - lens
        # The end of each text is one more piece.
        bounds = np.searchsorted(at, np.cumsum(sizes))
        stream = np.insert(pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, len(ids) - 1)
        counts = np.diff(np.r_[0, bounds + np.arange(1, len(bounds) + 1)]) if len(texts) else np.zeros(0, np.int64)
        each = lens[stream]
        upto = np.r_[0, np.cumsum(each)]
        out = np.empty(int(upto[-1]), np.uint32)
        for k in range(0, len(stream), 1 << 18):
            e = each[k : k + (1 << 18)]
            here = upto[k : k + len(e)]
            out[upto[k] : upto[k] + int(e.sum())] = flat[np.repeat(heads[stream[k : k + (1 << 18)]] - here, e) + np.arange(upto[k], upto[k] + int(e.sum()))]
        ends = np.cumsum(counts)
        lengths = upto[ends] - upto[ends - counts]
        odd = np.flatnonzero(~np.array(plain, bool))
        if len(odd):
            parts = np.split(out, np.cumsum(lengths)[:-1])
            for i in odd.tolist():
                parts[i] = np.array([*self.whole.encode(texts[i], add_special_tokens=False).ids, END], np.uint32)
            out, lengths = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return lengths, out


def write_ids(docs: DataFrame, path: str, tokenizer: str, segment: int = SEGMENT) -> None:
    """Encode every text of docs and write the segments, in ascending doc_id order, as a table of (part, place, first, ids, data)."""
    spark = docs.sparkSession
    short_batches(spark)
    dealt = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place, first = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        own: list[int | None] = []
        lens: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal place, first
            n = int(sum(x.sum() for x in lens))
            data = rans.encode(own, np.concatenate(lens), np.concatenate(ids))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "first": pa.array([first], pa.int64()), "ids": pa.array([n], pa.int64()), "data": pa.array([data], pa.binary())})
            place, first = place + 1, first + n
            own.clear(), lens.clear(), ids.clear()
            return out

        for keys, texts in _lots(batches):
            lengths, flat = encoder.encode(texts)
            ends = np.cumsum(lengths)
            at = 0
            while at < len(keys):
                room = segment - int(sum(len(x) for x in ids))
                begun = int(ends[at] - lengths[at])
                upto = min(len(keys), int(np.searchsorted(ends, begun + room)) + 1)
                own += keys[at:upto]
                lens.append(lengths[at:upto])
                ids.append(flat[begun : int(ends[upto - 1])])
                at = upto
                if sum(len(x) for x in ids) >= segment:
                    yield close()
        if own:
            yield close()

    dealt.mapInArrow(run, "part int, place int, first long, ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of about LOT characters."""
    keys: list = []
    texts: list[str] = []
    n = 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(k)
            texts.append(t)
            n += len(t)
            if n >= LOT:
                yield keys, texts
                give_back()
                keys, texts, n = [], [], 0
    if keys:
        yield keys, texts
        give_back()


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids if asked for."""
    files = spark.read.schema("part int, place int, first long, ids long, data binary").parquet(path)
    # One count a partition of the writer: as many as there were tasks.
    sums = {r[0]: r[1] for r in files.groupBy("part").agg(F.sum("ids")).collect()}
    before, starts = 0, {}
    for part in sorted(sums):
        starts[part], before = before, before + sums[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, blob in zip(*(batch.column(k) for k in range(3)), strict=True):
                own, lengths, ids = rans.decode(blob.as_py())
                ends = np.cumsum(lengths)
                parts = np.split(ids.astype("<u4"), ends[:-1])
                out = {"doc_id": pa.array(own, pa.int64()), "start": pa.array(starts[part.as_py()] + first.as_py() + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(parts, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("part", "first", "data").mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token ids to the shared folder and read (doc_id, start, n_tokens, ids_crc32) back from the files."""
    path = f"{shared_dir(docs.sparkSession)}/larkspur/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
