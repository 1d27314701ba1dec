"""Vectorised access to the UTF-8 bytes of many texts at once.

All helpers treat a null text as an empty one and always look at whole texts.  Batches are cut by bytes, so the
memory of a Python worker depends on ``PIECE_BYTES`` and on the longest single text, never on the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at (a longer text is a step of its own).
PIECE_BYTES = 1 << 20
#: Rows and bytes that Spark puts into one Arrow batch for a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20

#: The white space that ends a word, as in ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 8 + 5
_MASK = 2**64 - 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have (whatever their case)."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"sw_{i}") not in taken:
            out.append(name)
        i += 1
    return out


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not the GNU C library
    _trim = None


def tidied(run: Callable) -> Callable:
    """Wraps a function over batches: when a partition is done, the worker gives its free memory back.

    Workers live on for later stages; without this the executor's memory is the sum of every stage's peaks.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def freed(work: Callable) -> Callable:
    """The same for a function of one group of rows."""

    def wrapped(*args) -> pa.Table:
        try:
            return work(*args)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns free memory to the system, tables of powers (which grow with the longest text) included."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts (one pass, one number)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0])


def shards_for(total_bytes: int, shard_bytes: int) -> int:
    """How many shards of about ``shard_bytes`` the input makes; grows in proportion to it, one at least."""
    return max(1, -(-total_bytes // shard_bytes))


def shard_of(id_col: Column, shards: int) -> Column:
    """Deals rows over shards by their id only, so that a re-run task sees the same rows."""
    return F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes each (or a single longer text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by ``gap``, and where each text starts (one entry more than texts)."""
    data = np.frombuffer(gap.join(texts) + gap, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return data, starts


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        have = len(_powers[0])
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, have, 2**64) & _MASK)])
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`range_hash` reads the hash of any byte range."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """64-bit hash of each byte range; depends on the bytes only, not on where they stand."""
    _, inverse = _power_tables(len(sums))
    return mixed((sums[end] - sums[start]) * inverse[: len(sums)][start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of a piece of texts: where they start and end, whose they are, and their hashes.

    ``first[d] : first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, texts: list[bytes], is_gap: np.ndarray = IS_SPACE, hashes: bool = True):
        self.data, self.starts = joined(texts)
        solid = np.empty(len(self.data) + 1, np.int8)
        solid[0] = 0
        solid[1:] = ~is_gap[self.data]
        edge = np.diff(solid)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.begin, self.starts)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        if hashes:
            self.sums = prefix_sums(self.data)
            self.hash = range_hash(self.sums, self.begin, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each window of ``size`` words inside one text, and the window's hash."""
        n = len(self.begin) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = mixed(h + self.hash[at + k] + np.uint64(k + 1))
        return at, h


def frame(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    """A record batch with the given columns."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, names_types, strict=True)], names=[n for n, _ in names_types])
