"""Mixing sources to target weights with a splitting tree.

Each source's documents are put in a random order and form a stream of words, repeated as often as its target asks
for.  The stream up to the target is cut into blocks; a document belongs to the block in which it starts.  A binary tree
over the output shards splits the vector of block numbers: a node's left half takes its share of all blocks by a
multivariate hypergeometric draw, the right half gets the rest, so every source's number of blocks is met exactly and
each shard is a random sample of the mix.  A shard's blocks of a source are consecutive places of a permutation of that
source's blocks, so shards are disjoint; inside a shard the documents are shuffled.  All randomness comes from hashes
and seeded draws: a re-run gives the same mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import stored
from .texts import mixed, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources by code point (null last), repeating; the mix's size in relation to all sizes; most repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents whose places in a stream are worked out together, and cells whose sums are.
CELL_DOCUMENTS, CELLS = 512, 1024
#: numpy draws exactly from fewer than 10**9 blocks; larger mixes have larger blocks.
MOST_BLOCKS = 5 * 10**8
#: Sources whose table is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source: in proportion to weights, ``share`` of all sizes together, none above ``most`` times its size."""
    size = np.array(sizes, float)
    weight = np.resize(np.array(weights, float), len(size))
    out = np.zeros(len(size))
    free = np.ones(len(size), bool)
    rest = share * size.sum()
    while free.any():
        out[free] = rest * weight[free] / weight[free].sum()
        above = free & (out > most * size)
        if not above.any():
            break
        out[above] = most * size[above]
        rest -= out[above].sum()
        free &= ~above
    return out.tolist()


def permuted(place: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The block at each place of a seeded permutation of n blocks (a four-round Feistel network, walked until inside)."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    low, key = np.uint64((1 << half) - 1), mixed(np.arange(1, 5, dtype=np.uint64) + np.uint64(seed * 8))
    out = place.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in key:
            left, right = right, left ^ (mixed(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_quota(blocks: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Which places of each source's permuted blocks a shard gets: the first place and how many.

    Walks from the root of the splitting tree to the shard; every node draws with a seed of its own, so all shards see
    the same splits without anyone holding the whole tree.
    """
    lo, hi, node = 0, shards, 1
    start, quota = np.zeros(len(blocks), np.int64), np.array(blocks, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(quota.sum())
        left_total = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(quota, left_total, method="marginals")
        if shard < mid:
            quota, hi, node = left, mid, 2 * node
        else:
            start, quota, lo, node = start + left, quota - left, mid, 2 * node + 1
    return start, quota


class Mix:
    """The sized documents, the targets of their sources, and the copies that the mix takes, dealt to shards."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = 4096, shard_words: int = 32_768, seed: int = 9):
        """``most``: at most 2 (a document is never repeated more often than that).

        One row for each source reaches the driver: its name and size.  Sizes are whole-text word counts (null: 0);
        a null source is a source of its own, the last one.  Repeated rows are documents of their own.
        """
        spark = docs.sparkSession
        self.seed, self.id_col, self.text_col, self.source_col = seed, id_col, text_col, source_col
        text = F.col(f"`{text_col}`").cast("string")
        sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(text).alias("print"))
        sized = stored(sized)
        rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        goal = targets([r["size"] for r in rows], weights, share, most)
        self.words = [round(g) for g in goal]
        self.n_docs = sum(r["n"] for r in rows)
        sources = spark.createDataFrame([(i, r["source"], r["size"], float(g), w) for i, (r, g, w) in enumerate(zip(rows, goal, self.words, strict=True))], "src int, source string, source_size bigint, target double, quota bigint")
        self.sources = F.broadcast(sources) if len(rows) <= BROADCAST_SOURCES else sources
        self.block_words = max(block_words, -(-sum(self.words) // MOST_BLOCKS))
        self.blocks = np.array([-(-w // self.block_words) for w in self.words], np.int64)
        self.shards = max(1, -(-sum(self.words) // shard_words))
        self._place(sized)

    def _place(self, sized: DataFrame) -> None:
        """Where each document starts in its source's stream: sums of groups of cells, of cells, then inside each cell.

        No task sorts more than the documents of a cell, the cells of a group or the groups of a source.
        """
        cells = max(1, -(-self.n_docs // CELL_DOCUMENTS))
        named = sized.join(self.sources, sized.source.eqNullSafe(self.sources.source)).drop(sized.source)
        named = named.withColumn("order", F.xxhash64(F.lit(self.seed), "id", "size", "print")).withColumn("cell", F.pmod("order", F.lit(cells)))
        before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = named.groupBy("src", "cell").agg(F.sum("size").alias("inside")).withColumn("group", F.floor(F.col("cell") / CELLS))
        groups = sums.groupBy("src", "group").agg(F.sum("inside").alias("all")).withColumn("far", F.coalesce(F.sum("all").over(before("src", "group")), F.lit(0)))
        heads = sums.withColumn("near", F.coalesce(F.sum("inside").over(before("src", "group", "cell")), F.lit(0))).join(groups, ["src", "group"]).select("src", "cell", (F.col("near") + F.col("far")).alias("head"))
        running = Window.partitionBy("src", "cell").orderBy("order", "id", "size", "print").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = named.withColumn("end", F.sum("size").over(running)).join(heads, ["src", "cell"])
        self.placed = stored(placed.select("id", "print", "size", "src", "source_size", "target", "quota", (F.col("head") + F.col("end") - F.col("size")).alias("start")))

    def takes(self) -> DataFrame:
        """id, print, src, start, epoch (0 or 1), size, words: how many of its first words each copy gives; block."""
        copies = self.placed.where("size > 0").withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
        at = F.col("start") + F.col("epoch") * F.col("source_size")
        taken = copies.withColumn("words", F.least("size", F.col("quota") - at)).where("words > 0")
        return taken.select("id", "print", "size", "src", "start", "epoch", "words", F.floor(at / self.block_words).alias("block"))

    def plan(self) -> DataFrame:
        """src, block, shard: the blocks that the splitting tree draws for each shard."""
        seed, blocks, shards = self.seed, self.blocks, self.shards

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    start, quota = shard_quota(blocks, shards, shard, seed)
                    drawn = [permuted(start[src] + np.arange(quota[src]), int(blocks[src]), seed + src) for src in np.flatnonzero(quota).tolist()]
                    if drawn:
                        src, block = np.repeat(np.arange(len(quota)), quota).astype(np.int32), np.concatenate(drawn)
                        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(block), pa.array(np.full(len(block), shard, np.int64))], names=["src", "block", "shard"])

        return self.placed.sparkSession.range(shards).mapInArrow(draw, "src int, block bigint, shard bigint")

    def pieces(self) -> DataFrame:
        """The mix: :meth:`takes` with ``shard`` and ``place`` in it (from 1).

        The plan has a row for each block, so it is joined by a shuffle; a shard, which is sorted in one task, has a
        bounded number of words whatever the size of the mix.
        """
        dealt = self.takes().join(self.plan().hint("shuffle_merge"), ["src", "block"])
        inside = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed), "src", "start", "epoch"), "src", "start", "epoch")
        return dealt.withColumn("place", F.row_number().over(inside))

    def taken(self) -> DataFrame:
        """One row for each document: ``id_col``, ``size``, ``source_size``, ``target``, ``taken``, and where its copies are.

        ``n_copies`` (0 to 2), ``shard`` and ``place`` of the first copy (else null) and ``second_shard`` and
        ``second_place`` of a repeat.
        """
        at = lambda epoch, column: F.max(F.when(F.col("epoch") == epoch, F.col(column)))
        got = self.pieces().groupBy("src", "start").agg(
            F.sum("words").alias("taken"), F.count("*").alias("n_copies"),
            at(0, "shard").alias("shard"), at(0, "place").alias("place"), at(1, "shard").alias("second_shard"), at(1, "place").alias("second_place"),
        )
        some = self.placed.where("size > 0").join(got, ["src", "start"], "left")  # only documents without words share a start
        every = some.unionByName(self.placed.where("size = 0"), allowMissingColumns=True)
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return every.select(F.col("id").alias(self.id_col), "size", "source_size", "target", zero("taken"), zero("n_copies"), "shard", "place", "second_shard", "second_place")

    def documents(self, docs: DataFrame) -> DataFrame:
        """The mixed documents themselves: a row for each copy, with the columns of ``docs``, shard by shard, shuffled.

        Only the last document of a source's stream can be cut; its words are then joined by blanks.  Rows are told
        apart by id (null or not), text and source; of rows that are equal in these (whatever their other columns)
        each gives as many copies as its turn among them has.  Texts without words give nothing.  An empty table gives
        an empty one.  Texts are shuffled twice: to their copies' shards and places, and to the shards.
        """
        text, names = F.col(f"`{self.text_col}`"), unused(docs, 8)
        id_, print_, source, words, size, shard, place, nth = names
        keys = ["id", "print", "src"]
        several = self.placed.where("size > 0").groupBy(*keys).count().where("count > 1").limit(1).count() > 0
        turn = F.dense_rank().over(Window.partitionBy(*keys).orderBy("start")) if several else F.lit(1)
        copies = self.pieces().withColumn("turn", turn).join(self.sources.select("src", "source"), "src")
        copies = copies.select(*[F.col(a).alias(b) for a, b in zip(("id", "print", "source", "words", "size", "shard", "place", "turn"), names, strict=True)])
        same = F.col(f"`{self.id_col}`").eqNullSafe(F.col(id_)) & (F.xxhash64(text.cast("string")) == F.col(print_)) & F.col(f"`{self.source_col}`").cast("string").eqNullSafe(F.col(source))
        rows = docs
        if several:
            equal = Window.partitionBy(f"`{self.id_col}`", F.xxhash64(text.cast("string")), F.col(f"`{self.source_col}`").cast("string"))
            own = unused(docs, 9)[8]
            rows = docs.withColumn(own, F.row_number().over(equal.orderBy(F.lit(0))))
            same = same & (F.col(own) == F.col(nth))
        first = F.array_join(F.slice(F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), F.col(words).cast("int")), " ")
        joined = rows.join(copies.hint("shuffle_merge"), same).withColumn(self.text_col, F.when(F.col(words) < F.col(size), first).otherwise(text))
        return joined.repartition(shard).sortWithinPartitions(shard, place).select(*[f"`{c}`" for c in docs.columns])


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """How much of each document a mix of its sources takes; see :class:`Mix` for options and :meth:`Mix.taken`.

    Null texts and texts without words have size 0 and give nothing.  A source without words has a target of 0.  Rows
    that repeat are documents of their own; which of two equal rows comes first makes no difference.  An empty table
    gives an empty result; extra columns are ignored.
    """
    return Mix(docs, **options).taken()
