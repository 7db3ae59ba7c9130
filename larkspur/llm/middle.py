"""Fill-in-middle transformation of documents over numpy codepoint arrays.

A text is decoded to an array of code points (UTF-32). A token is a run of words' characters with the white
space before it, or the white space that ends a text; so a token begins at 0 and wherever
white space follows another character: neighbouring classes are compared, and flatnonzero of the
differences yields the boundaries. Two hashes of the document choose ranks among the boundaries,
the array is sliced there, and the pieces are encoded again. Nothing is read twice, no row depends on
another, and nothing is shuffled; a text's arrays, five bytes a code point, are the most that a task holds beside a batch.

Which documents are transformed, in which form, and where they are cut stands in the SHA-256 of a seed and the doc_id: reruns
and any partitioning agree. A text that holds one of the marks stays plain, so that restored() finds them.

Defined cases: a null text counts as empty; an empty text is plain with no tokens; a null doc_id counts as an
empty one in the hash; rows that share a doc_id are cut at the same ranks, each by its own length; bytes that are not UTF-8
become U+FFFD; texts of any length are cut whole; no rows give no rows; columns but doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import short_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of documents that are transformed, and of those in the form spm.
SEED, SHARE, SHARE_SPM = 42, 50, 80
#: Rows of a batch on its way out.
ROWS = 256


def edges(points: np.ndarray) -> np.ndarray:
    """Where a text's tokens begin, and its length: n + 1 edges of n tokens."""
    if not len(points):
        return np.zeros(1, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    return np.concatenate([[0], np.flatnonzero(space[1:] & ~space[:-1]) + 1, [len(points)]])


def _cut(text: bytes, form: str, one: int, two: int) -> tuple[int, int | None, int | None, str]:
    """The number of tokens, the code points of prefix and middle, and the output."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    at = edges(points)
    n = len(at) - 1
    if form == PLAIN:
        return n, None, None, text.decode("utf-8", "replace")
    low, high = sorted((int(at[one % (n + 1)]), int(at[two % (n + 1)])))
    prefix, middle, suffix = (x.tobytes().decode("utf-32-le") for x in (points[:low], points[low:high], points[high:]))
    out = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == PSM else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, low, high - low, out


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, share_spm: int = SHARE_SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs; the code points are null if the form is plain."""
    short_batches(docs.sparkSession)
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    rows = docs.select(own.alias("doc_id"), text.alias("text"), *[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= share), PLAIN).when(F.col("h4") % 100 < share_spm, SPM).otherwise(PSM)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), form.alias("form"), "h1", "h2")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids, forms = part.column(0).to_pylist(), part.column(2).to_pylist()
                cuts = [_cut(t.as_py(), f, a, b) for t, f, a, b in zip(part.column(1), forms, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                n, low, middle, out = zip(*cuts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((ids, n, forms, low, middle, out), kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: its pieces hold no mark."""
    piece = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.element_at(piece, k)
    return F.when(form == PSM, F.concat(at(2), at(4), at(3))).when(form == SPM, F.concat(at(3), at(4), at(2))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with SHA-256 digests of the output and of the text restored from it, in their place."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS toks, sha256('42:' || doc_id) AS h FROM documents),
e AS (SELECT doc_id, text, toks, len(toks) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
p AS (SELECT doc_id, text, n, form, array_to_string(toks[1:a], '') AS pre, array_to_string(toks[a + 1:b], '') AS mid, array_to_string(toks[b + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
