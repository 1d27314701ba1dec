"""Reading again only those texts that are wanted, without shuffling texts while the wanted ones are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of the filter that is sent to all workers (8 MB: 4 million hashes of 16 bits each).
FILTER_BITS = 1 << 26


def hash_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` distinct 64-bit hashes (the one column of ``hashes``), 16 bits for each."""
    bits = 1 << 10
    while bits < 16 * n:
        bits *= 2
    h = hashes.toDF("h")
    at = F.explode(F.array(*[F.pmod(x, F.lit(bits)) for x in _places(F.col("h"))])).alias("at")
    words = h.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _places(h):
    """The places of a hash in the filter, before the remainder."""
    return [h, h.bitwiseXOR(F.shiftright(h, 29)) if not isinstance(h, np.ndarray) else h ^ (h >> 29)]


def in_filter(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for x in _places(h):
        at = (x % (64 * len(filter_))).astype(np.uint64)
        hit &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return hit


class Wanted:
    """Which rows of a table with a hash column may be wanted.

    Up to ``FILTER_BITS / 16`` hashes a filter of them is broadcast, and :meth:`keep` drops nearly all other rows where
    they are read.  Beyond, the rows are dealt by their hash and joined (:attr:`rows`), and :meth:`keep` keeps all.
    """

    def __init__(self, source: DataFrame, column: str, hashes: DataFrame):
        hashes = hashes.toDF(column).where(F.col(column).isNotNull()).distinct()
        n = hashes.count()
        if 16 * n <= FILTER_BITS:
            self.rows, self.filter = source, source.sparkSession.sparkContext.broadcast(hash_filter(hashes, n))
        else:
            self.rows, self.filter = source.join(hashes.hint("shuffle_merge"), column, "left_semi"), None
        self.at = self.rows.columns.index(column)

    def keep(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch if self.filter is None else batch.filter(pa.array(in_filter(self.filter.value, batch.column(self.at).to_numpy())))

    def __getstate__(self):
        return {"filter": self.filter, "at": self.at}
