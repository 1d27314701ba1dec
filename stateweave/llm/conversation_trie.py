"""The trie of conversation openings: which turns conversations share, and what storing each shared opening once saves.

A node is a distinct sequence of first turns.  Its owner is its smallest member, so a conversation owns the nodes of its
path from some depth on: a suffix.  What a node's subtree saves is what its members' turns take from that depth on, less
the turns of the nodes that they own; leaves are counted at their owners.  Running windows along each conversation give
prefix keys and byte counts, a grouping finds owners, and one grouping by prefix adds everything up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.numbering import numbered
from .store import stored

#: Turns of a conversation that one window sees; longer conversations are put together from blocks of so many.
BLOCK_TURNS = 1024
#: A node with more than this part of all nodes as children is looked up from a broadcast table (at most so many rows).
HOT_PARENTS = 1000
#: Bytes of joined ids that one row of a node's ends carries.
ENDS_BYTES = 1 << 20
NODE = ["depth", "p", "q"]


def turn_rows(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, depth (from 1), a, b (halves of 128 bits of the turn's digest), bytes (of its text).

    Turns are ordered by number, null first; ties by digest.  Null roles and texts are empty; rows without a
    conversation's id take no part.  Texts don't travel.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda i: F.conv(F.substring(digest, i, 16), 16, -10).cast("bigint")
    conv = F.col(f"`{conv_col}`").cast("bigint")
    rows = convs.where(conv.isNotNull()).select(conv.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), half(1).alias("a"), half(17).alias("b"), F.octet_length(text).cast("bigint").alias("bytes"))
    return numbered(rows, [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "depth", ["conv"], first=1).drop("turn")


def with_openings(rows: DataFrame, base: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``opening`` turns are replaced by those of conversation ``base``, if it has them.

    ``base`` and ``opening`` (``most`` at most) are expressions of ``conv``.  Returns turns, and all conversations
    (``conv``), which may have lost all of their turns.
    """
    rows = stored(rows)
    sizes = rows.groupBy("conv").agg(F.max("depth").alias("n"))
    plan = sizes.select("conv", base.alias("base"), opening.cast("bigint").alias("h"))
    plan = plan.join(sizes.select(F.col("conv").alias("base"), "n"), "base", "left").withColumn("k", F.least("h", F.coalesce("n", F.lit(0))))
    first = rows.where(F.col("depth") <= most).withColumnRenamed("conv", "base")
    shared = plan.join(first, "base").where(F.col("depth") <= F.col("h")).select("conv", "depth", "a", "b", "bytes")
    own = rows.join(plan.select("conv", "h", "k"), "conv").where(F.col("depth") > F.col("h"))
    return shared.unionByName(own.withColumn("depth", F.col("depth") - F.col("h") + F.col("k")).drop("h", "k")), sizes.select("conv")


def _paths(rows: DataFrame) -> DataFrame:
    """Turns with the keys of the prefix that ends with them (p, q), of the one before (p0, q0), and bytes up to them.

    A prefix's key is the exclusive-or of 128-bit hashes of (place, turn), so blocks of a long conversation can be
    computed apart and put together.
    """
    hashed = rows.select("conv", "depth", "bytes", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "a", "depth").alias("y"), F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("block"))
    running = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = hashed.select("conv", "block", "depth", "bytes", "x", "y", F.bit_xor("x").over(running).alias("p"), F.bit_xor("y").over(running).alias("q"), F.sum("bytes").over(running).alias("upto"))
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("s"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select("conv", "block", F.bit_xor("x").over(before).alias("bx"), F.bit_xor("y").over(before).alias("by"), F.sum("s").over(before).alias("bs")).where("block > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    keyed = inside.join(ahead, ["conv", "block"], "left").select("conv", "depth", "bytes", "x", "y", F.col("p").bitwiseXOR(zero("bx")).alias("p"), F.col("q").bitwiseXOR(zero("by")).alias("q"), (F.col("upto") + zero("bs")).alias("upto"))
    return keyed.select("conv", "depth", "bytes", "p", "q", F.col("p").bitwiseXOR(F.col("x")).alias("p0"), F.col("q").bitwiseXOR(F.col("y")).alias("q0"), "upto")


def _ends(rows: DataFrame) -> DataFrame:
    """For each node where conversations end: SHA-256 of their ids, ascending and comma-joined.

    Ids are sorted by ranges, joined to texts of ``ENDS_BYTES``, and only those texts meet at their node, where they
    are digested one after the other: a node's ids are never in memory together.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out, waiting = None, [], 0, [], 0
        for batch in batches:
            for *key, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node is not None and (key != node or size >= ENDS_BYTES):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    waiting += size
                    ids, size = [], 0
                node = key
                ids.append(conv)
                size += 8
            if waiting >= ENDS_BYTES:
                yield rows_of(out, JOINED)
                out, waiting = [], 0
        if node is not None:
            yield rows_of([*out, (*node, ids[0], ",".join(map(str, ids)))], JOINED)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                else:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
            yield rows_of(done, DIGESTED)
        if node is not None:
            yield rows_of([(*node, sha.hexdigest())], DIGESTED)

    sorted_ = rows.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    texts = sorted_.mapInArrow(join, "depth bigint, p bigint, q bigint, first bigint, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth bigint, p bigint, q bigint, ends_sha256 string")


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KEY = [(c, pa.int64()) for c in NODE]
JOINED = pa.schema([*_KEY, ("first", pa.int64()), ("ids", pa.string())])
DIGESTED = pa.schema([*_KEY, ("ends_sha256", pa.string())])


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``convs`` (``conv``) with turns ``rows`` (as of :func:`turn_rows`).

    conv_id (smallest member), depth, parent_conv_id (that of the parent; null for the root), n_convs, n_children,
    n_leaves (of the subtree), saved_tokens (bytes of the subtree's turns that other members needn't store),
    ends_sha256 (digest of the ids of members that end here), all but the last long.
    """
    paths = stored(_paths(rows))
    lengths = paths.groupBy("conv").agg(F.max("depth").alias("length"), F.max("upto").alias("total"))
    lengths = convs.join(lengths, "conv", "left").select("conv", F.coalesce("length", F.lit(0).cast("bigint")).alias("length"), F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "bytes", "p", "q", "p0", "q0", "upto")]
    turns = paths.join(lengths.select("conv", "length"), "conv").unionByName(lengths.select("conv", *zero, "length"))
    turns = stored(turns)

    owners = turns.groupBy(*NODE).agg(F.min(F.struct("conv", (F.col("upto") - F.col("bytes")).alias("before"))).alias("first"), F.max("length").alias("deepest"))
    owned = owners.groupBy(F.col("first.conv").alias("conv")).agg(F.min(F.struct("depth", "first.before")).alias("from"), F.max((F.col("deepest") == F.col("depth")).cast("int")).alias("leaf"))
    # a conversation owns its path's nodes from depth d0 on (past its length: none); `before` are its bytes up to there
    own = lengths.join(owned, "conv", "left").select("conv", F.coalesce("from.depth", F.col("length") + 1).alias("d0"), F.coalesce("from.before", "total").alias("before"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = turns.join(own, "conv")
    # of its own turns from here on, those that it doesn't own
    shared = F.when(F.col("depth") < F.col("d0"), F.col("before") - F.col("upto") + F.col("bytes")).otherwise(F.lit(0))
    child = ((F.col("depth") + 1 >= F.col("d0")) & (F.col("depth") < F.col("length"))).cast("bigint")
    sums = [F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"), F.sum(shared).alias("saved_tokens")]
    nodes = stored(marked.groupBy(*NODE).agg(F.min(F.struct("conv", "d0", "p0", "q0")).alias("o"), *sums).select(*NODE, "o.*", "n_convs", "n_children", "n_leaves", "saved_tokens"))

    branches = nodes.where((F.col("depth") == F.col("d0")) & (F.col("depth") > 0)).select(*NODE, "p0", "q0")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("p0"), F.col("q").alias("q0"), F.col("conv").alias("parent"), "n_children")
    hot = F.col("n_children") > F.lit(nodes.count() / HOT_PARENTS)
    above = ["depth", "p0", "q0"]
    near = branches.join(F.broadcast(parents.where(hot).drop("n_children")), above, "left")
    far = near.where("parent IS NULL").drop("parent").join(parents.where(~hot).drop("n_children"), above)
    found = near.where("parent IS NOT NULL").unionByName(far).select(*NODE, "parent")
    out = nodes.join(found, NODE, "left").join(_ends(turns.where(F.col("depth") == F.col("length"))), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Column | None = None, opening: Column | None = None, most: int = 0) -> DataFrame:
    """The prefix trie of a table of turns, see :func:`trie`; with ``base`` and ``opening``, of :func:`with_openings`.

    Scale: what travels is about 50 bytes a turn.  No window sees more than ``BLOCK_TURNS`` turns (or a thousandth of a
    conversation's), turns are numbered by ranges, an opening that a third of all conversations share is combined
    before each shuffle, its children are looked up from a broadcast table of at most ``HOT_PARENTS`` rows, and its
    ends are digested in pieces.  A method that marks owners by a window over a node's members would sort all
    conversations for the root in one task; a grouping finds the same owners.

    Null turn numbers come first; turns with equal numbers are ordered by the digest of role and text; repeated rows are
    turns of their own.  Null roles and texts are empty.  Rows without an id take no part.  An empty table has no node.
    Other columns are ignored.
    """
    rows = turn_rows(convs, conv_col, turn_col, role_col, text_col)
    if base is None:
        rows = stored(rows)
        return trie(rows, rows.select("conv").distinct())
    return trie(*with_openings(rows, base, opening, most))
