"""Messages between shards of documents and shards of keys.

A message is one row from one shard to another with up to three packed arrays.  Packing keeps the JVM from handling a
row for each key, and a shard speaks to another at most once in a step, so there are never more messages than keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_zstd = pa.Codec("zstd", compression_level=3)


def squeezed(data: bytes) -> bytes:
    """Compressed bytes, with their size in front; nothing for none."""
    return len(data).to_bytes(8, "little") + _zstd.compress(data, asbytes=True) if data else b""


def restored(packed: bytes) -> bytes:
    """What :func:`squeezed` has compressed."""
    return _zstd.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True) if packed else b""


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as their range needs: the least one, then differences from it."""
    x = x.astype(np.int64)
    if not len(x):
        return b""
    least = x.min()
    above = x.view(np.uint64) - least.view(np.uint64)
    width = -(-int(above.max()).bit_length() // 8)
    return least.tobytes() + above.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that :func:`narrow` has packed."""
    if not n:
        return np.zeros(0, np.int64)
    above = np.zeros((n, 8), np.uint8)
    width = (len(packed) - 8) // n
    above[:, :width] = np.frombuffer(packed, np.uint8, n * width, 8).reshape(n, width)
    return (above.view("<u8").ravel() + np.frombuffer(packed, np.uint64, 1)).view(np.int64)


MESSAGE = "shard int, source int, kind int, a binary, b binary, c binary"


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["shard", "source", "kind", "a", "b", "c"])


def bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


#: Most tasks of one exchange; beyond, a task has several shards, one after the other.
MOST_TASKS = 8192


def by_shard(df: DataFrame, shards: int) -> DataFrame:
    """``df`` partitioned by ``shard`` into as many tasks as there are shards, so that a task reads about a shard."""
    return df.repartition(min(shards, MOST_TASKS), "shard")


class Deal:
    """Entries dealt to the shards that they belong to; only shards that occur take part, however many there are."""

    def __init__(self, home: np.ndarray):
        self.order = np.argsort(home, kind="stable")
        self.homes, first = np.unique(home[self.order], return_index=True)
        self.edge = np.append(first, len(home))

    def __iter__(self):
        """Each shard that occurs, and its entries."""
        for i, shard in enumerate(self.homes.tolist()):
            yield shard, self.order[self.edge[i] : self.edge[i + 1]]

    def of(self, shard: int) -> np.ndarray:
        """The entries of a shard."""
        i = int(np.searchsorted(self.homes, shard))
        return self.order[self.edge[i] : self.edge[i + 1]] if i < len(self.homes) and self.homes[i] == shard else self.order[:0]
