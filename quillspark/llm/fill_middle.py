"""Fill-in-middle transformation by rotations of blocks in place, and its inverse.

A text is cut into prefix, middle and suffix. All three are laid into one bytearray in that
order with a sentinel before each, and three reversals swap two neighbouring blocks where they
lie: the middle and the suffix (form psm), or prefix and middle together and the suffix (form
spm). The inverse looks the sentinels up, rotates back and takes them out. Cuts are in code
points; the bytes at which these begin are found by one scan of the UTF-8.

A text that holds a sentinel stays plain, so those of an output are its own: a sentinel begins
with its only '<' and ends with its only '>', so none arises where a block meets one. Null texts
count as empty, empty texts are plain. A null doc_id is hashed as an empty number. Equal rows
give equal rows. Each text is worked on whole, alone in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.llm.common import bound_batches
from quillspark.llm.words import buffers

P, S, M = b"<P>", b"<S>", b"<M>"
_ROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def rotate(block: np.ndarray, lo: int, mid: int, hi: int) -> None:
    """Swap block[lo:mid] and block[mid:hi] in place by three reversals."""
    for a, b in ((lo, mid), (mid, hi), (lo, hi)):
        block[a:b] = block[a:b][::-1]


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(digest, ">u4", 4).tolist()


def arranged(text: bytes, doc_id: int | None, seed: str, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix and middle in code points, output."""
    data = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(starts)
    h = draws(doc_id, seed)
    if not n or P in text or S in text or M in text or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    ends = [int(starts[i]) if i < n else len(text) for i in (lo, hi)]
    buffer = bytearray(len(text) + 9)
    middle, suffix = ends[0] + 3, ends[1] + 6
    buffer[:middle] = P + text[: ends[0]]
    buffer[middle:suffix] = M + text[ends[0] : ends[1]]
    buffer[suffix:] = S + text[ends[1] :]
    spm = h[3] % 100 < spm_below
    rotate(np.frombuffer(buffer, np.uint8), 0 if spm else middle, suffix, len(buffer))
    return n, "spm" if spm else "psm", lo, hi - lo, bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    block = np.frombuffer(buffer, np.uint8)
    if form == "spm":
        rotate(block, 0, output.index(P), len(buffer))
    else:
        rotate(block, output.index(S), output.index(M), len(buffer))
    m, s = buffer.index(M), buffer.index(S)
    return bytes(block[3:m]) + bytes(block[m + 3 : s]) + bytes(block[s + 3 :])


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = buffers(column)
    at = offsets.tolist()
    for lo, hi in zip(at, at[1:], strict=False):
        yield data[lo:hi].tobytes()


def transform(documents: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    Of all texts, plain_from of 100 are cut; of these, spm_below of 100 begin with the suffix.
    """
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [arranged(t, i, seed, plain_from, spm_below) for i, t in zip(ids, _texts(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if f.name != "output" else pa.array(c, pa.binary()).cast(pa.string()) for c, f in zip([ids, *columns], _ROW, strict=True)], schema=_ROW)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (form, output and more columns) with the text they were made of as restored; a column of that name is replaced."""
    bound_batches(outputs.sparkSession)
    outputs = outputs.drop("restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(t, f) for t, f in zip(_texts(batch.column("output")), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, StructType([*outputs.schema.fields, StructField("restored", StringType())]))


def op13(documents: DataFrame) -> DataFrame:
    made = restore(transform(documents))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM hashed
), formed AS (
  SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, '<P>' || substring(t, 1, lo) AS p, '<M>' || substring(t, lo + 1, hi - lo) AS m, '<S>' || substring(t, hi + 1) AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN lo END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN hi - lo END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
