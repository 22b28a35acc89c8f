"""Vectorised text work for Arrow-batched operators: words, hashes, shingles and winnowing over many texts at once.

Texts come in blocks of about BLOCK bytes, so memory follows the block or, where it is longer, the longest text
(about 20 times its bytes).
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BLOCK = 1 << 20
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LONG = 48


def lower_table(is_word: Callable[[int], bool]) -> bytes:
    """Translation that lower-cases A-Z and turns every byte outside words into a space."""
    return bytes((b + 32 if 65 <= b <= 90 else b) if is_word(b + 32 if 65 <= b <= 90 else b) else 32 for b in range(256))


#: Words are runs without ASCII white space.
PLAIN = lower_table(lambda b: b != 32 and not 9 <= b <= 13)
#: Words are runs of digits, letters a-z and bytes from 0x80.
ALNUM = lower_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """Words of a block of texts: start and end (in buf), their text's index (doc) and a 64-bit hash."""

    def __init__(self, texts: list[bytes], table: bytes) -> None:
        joined = b" ".join(texts).translate(table)
        self.buf = np.frombuffer(b" " + joined + b" ", np.uint8)
        gap = self.buf == 32
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        first = np.cumsum(sizes + 1) - sizes  # each text's first byte in buf
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        h = np.full(len(size), U(0x243F6A8885A308D3))
        live = np.arange(len(size))
        for k in range(min(int(size.max(initial=0)), _LONG)):
            live = live[size[live] > k]
            h[live] = h[live] * _MULT + _BYTE[self.buf[self.start[live] + k]]
        for i in np.flatnonzero(size > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return mix(h)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and which of these stay inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        h = np.full(n, U(k))
        for j in range(k):
            h = (h + self.hash[j : j + n]) * _MULT
            h ^= h >> U(29)
        return mix(h), self.doc[:n] == self.doc[k - 1 :]


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum (the last of equals) of each window of w neighbouring hashes; of all of h if it is shorter."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    at = w - 1 - np.argmin(view[:, ::-1], axis=1)
    return np.unique(at + np.arange(n - w + 1))


def blocks(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of rows of about BLOCK bytes."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > BLOCK:
            yield ids[at:i], texts[at:i]
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield ids[at:], texts[at:]


def map_texts(df: DataFrame, fn: Callable[[list[bytes]], dict[str, list]], schema: str, id_col: str = "doc_id", text_col: str = "text", id_name: str = "doc_id") -> DataFrame:
    """One row for each row of df: its id and what fn gives for its text (null: empty), a block of texts at a time.

    schema: the columns of fn, as DDL. Arrow batches are bounded in bytes by the session's setting for it, which this sets (to 16 MB).
    """
    spark = df.sparkSession
    with contextlib.suppress(PySparkException):  # an older Spark has no such setting
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "16m":
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    kind = df.schema[id_col].dataType.simpleString()
    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0)
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            at = 0
            for _, part in blocks(list(range(len(texts))), texts):
                out = fn(part)
                cols = {id_name: held.slice(at, len(part))} | {k: pa.array(v, types.field(k).type) for k, v in out.items()}
                at += len(part)
                yield pa.RecordBatch.from_pydict(cols)

    return df.selectExpr(f"`{id_col}`", f"encode(`{text_col}`, 'UTF-8') AS _t").mapInArrow(run, f"{id_name} {kind}, {schema}")
