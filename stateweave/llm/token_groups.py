"""Similarity join of shingle sets by a token-group matrix.

Sets are dealt to groups of similar sets.  A group's union of tokens bounds what any of its sets can share with a query,
so a group is opened, and the query compared with its sets one by one, only if the union holds enough of the query.

Which groups a query meets at all is decided exactly, too.  First by parts: if two sets are similar enough, they differ
in at most D tokens, so of more than D parts of the hash range some part holds the same tokens in both; sets that have
no part in common with another set have no link.  Then groups are opened on themselves, level by level, while this
joins components.  What is left apart although it has parts in common meets through the matrix: in the order of rising
number of groups with the token, a query's first tokens and those of a set that it links with have one in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import blob
from .graph import components, follow
from .probminhash import shingle_sets
from .store import discard, free_shuffles, stored
from .texts import as_bytes, bound_batches, freed, mixed, pieces, tidied
from .wanted import Wanted, in_filter

#: Sets and tokens of a group (on average; a longer set is a group's only long one, more or less).
GROUP_SETS, GROUP_TOKENS = 64, 1 << 16
#: Most levels on which groups of components are opened before the matrix is made for what is left.
LEVELS = 8
#: Ranges of keys that are looked at one after the other.
KEY_PARTS = 4
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@cache
def classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of set sizes: their smallest size, most differing tokens of linked sets, parts, and parts that may be empty.

    Sets of sizes a and b with ``100 * common >= percent * union`` differ in at most (a + b)(100 - p)/(100 + p) tokens.
    A class is wide enough that linked sets are of the same class or of neighbouring ones.
    """
    start, growth = [0, 1], max(1.42, 106 / percent)
    while start[-1] < 1 << 36:
        start.append(max(start[-1] + 1, int(np.ceil(start[-1] * growth))))
    largest = np.array([*start[1:], start[-1] * 2], np.int64) - 1
    differ = (100 - percent) * 2 * largest // (100 + percent)
    room = np.where(differ > 0, -(-differ // 10) + 1, 0)
    return np.array(start, np.int64), differ, differ + 1 + room, room


def signatures(doc: np.ndarray, h: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the set and 64-bit key of each of its parts, such that different linked sets have a key in common, and
    with how many of its keys, at least, a set meets others if it has a link.

    ``doc`` and ``h`` are the sets' tokens in order.  Parts are ranges of the hash; a set has those of its own class and,
    if a set of the next class can link with it, of that one.  Empty parts have no key.  A set with so many of them that
    only empty parts might be shared adds its lowest tokens as keys: by them it meets other such sets.

    A token that only one of two linked sets has changes one part.  So a set shares all its parts but as many as it can
    differ in from the largest set that it may link with, and those among them that have tokens have keys.
    """
    start, differ, parts, room = classes(percent)
    size = np.bincount(doc, minlength=n)
    level = np.searchsorted(start, size, side="right") - 1
    sparse, owners, keys, least = np.zeros(n, bool), [], [], np.full(n, np.iinfo(np.int64).max)
    for step in (0, 1):
        c = level + step
        takes_part = (size > 0) & (differ[c] > 0) & ((step == 0) | (100 * size >= percent * start[c]))
        own = takes_part[doc]
        d, x = doc[own], h[own]
        if not len(d):
            continue
        part = ((x >> np.uint64(32)) * parts[c[d]].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        tokens = np.add.reduceat(mixed(x + np.uint64(0x243F6A8885A308D3)), first)
        keys.append(mixed(mixed(tokens) + part[first] * np.uint64(0x9E3779B97F4A7C15) + mixed(c[d[first]].astype(np.uint64) + np.uint64(1))))
        owners.append(d[first])
        used = np.bincount(d[first], minlength=n)
        sparse |= takes_part & (parts[c] - used > room[c])
        most = (size + np.minimum(100 * size // percent, start[c + 1] - 1)) * (100 - percent) // (100 + percent)
        least = np.where(takes_part, np.minimum(least, np.maximum(used - most, 1)), least)
    if sparse.any():
        place = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
        lowest = sparse[doc] & (place < (size - (percent * size + 99) // 100 + 1)[doc])
        owners.append(doc[lowest])
        keys.append(mixed(h[lowest] ^ np.uint64(0x13198A2E03707344)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), least
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order], least


def set_digests(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """128 bits of each set; equal for equal sets only."""
    cut = np.searchsorted(doc, np.arange(n + 1))
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _read(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """row (unique), id, print (hash of the text), node (digest of the set), n (its size), keys, least (keys that a link needs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in pieces(texts):
                doc, h = shingle_sets(texts[a:b], size)
                owner, key, least = signatures(doc, h, b - a, percent)
                cut = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(cut, pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(set_digests(doc, h, b - a), pa.binary()), pa.array(np.bincount(doc, minlength=b - a), pa.int64()), lists, pa.array(least)], names=["id", "print", "node", "n", "keys", "least"])

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    return source.mapInArrow(tidied(run), f"id {id_type}, print bigint, node binary, n bigint, keys array<bigint>, least bigint").withColumn("row", F.monotonically_increasing_id())


def _in_common(read: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """For the given rows of ``read`` (row, keys) the number of keys that others of them have too: row, ``by``, parts.

    A few ranges of keys are taken one after the other, so that disk holds one of them.  ``by`` may name the lead, the
    smallest row that has a key.
    """
    found = []
    for part in range(KEY_PARTS):
        own = F.filter("keys", lambda k: F.pmod(k, F.lit(KEY_PARTS)) == part)  # noqa: B023
        entries = read.select("row", own.alias("keys")).join(rows.hint("shuffle_merge"), "row", "left_semi").select("row", F.explode("keys").alias("key"))
        buckets = entries.groupBy("key").agg(F.min("row").alias("lead"), F.max("row").alias("last")).where("lead < last").drop("last")
        found.append(stored(entries.join(buckets.hint("shuffle_merge"), "key").groupBy("row", *by).agg(F.count("*").alias("parts"))))
        free_shuffles(read.sparkSession)
    return reduce(DataFrame.unionByName, found)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, chosen: DataFrame) -> DataFrame:
    """row, g, tokens (packed, sorted) of the chosen (row, node, id, print, g): their texts are read again."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    one = lambda id_, print_: F.xxhash64(F.coalesce(id_.cast("string"), F.lit("")), print_)
    source = docs.select(text.alias("text"), one(F.col(f"`{id_col}`"), F.xxhash64(text)).alias("h"))
    wanted = Wanted(source, "h", chosen.select(one(F.col("id"), F.col("print"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(wanted.keep(batch).column("text"))
            for a, b in pieces(texts):
                doc, h = shingle_sets(texts[a:b], size)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(doc, h, b - a), pa.binary()), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "tokens"])

    read = wanted.rows.mapInArrow(tidied(run), "node binary, tokens binary")
    return read.join(chosen.select("row", "node", "g").hint("shuffle_merge"), "node").dropDuplicates(["node"]).select("row", "g", "tokens")


class Group:
    """Sets of a group: which label each has, their tokens, and the tokens' union."""

    def __init__(self, labels: np.ndarray, sets: list[np.ndarray]):
        self.labels, self.sets = labels, sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.union = np.unique(self.tokens)

    def links(self, queries: Group, percent: int, joined: dict) -> Iterator[tuple[int, int]]:
        """Links between labels that aren't joined yet; ``joined`` is grown."""
        for k, query in enumerate(queries.sets):
            mine = find(joined, queries.labels[k])
            room = (100 * self.size >= percent * len(query)) & (percent * self.size <= 100 * len(query))
            others = np.array([find(joined, x) != mine for x in self.labels.tolist()])
            if not (room & others).any() or 100 * held(query, self.union).sum() < percent * len(query):
                continue
            common = np.bincount(self.owner[held(self.tokens, query)], minlength=len(self.sets))
            for j in np.flatnonzero(room & others & (100 * common >= percent * (self.size + len(query) - common))):
                x, y = find(joined, queries.labels[k]), find(joined, self.labels[j])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    yield int(x), int(y)


def held(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values of ``x`` are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == x


def find(joined: dict, x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def _dealt(members: DataFrame, salt: int) -> DataFrame:
    """``members`` (row, n, lead, ...) with the group (``g``) that each is dealt to: as many groups for a lead as it needs."""
    sums = members.groupBy("lead").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    chunks = F.greatest(F.ceil(F.col("m") / GROUP_SETS), F.ceil(F.col("s") / GROUP_TOKENS))
    return members.join(sums, "lead").withColumn("g", F.xxhash64("lead", F.pmod(F.xxhash64("row", F.lit(salt)), chunks))).drop("m", "s")


_PACK = "g bigint, rows binary, sizes binary, tokens binary"


def _packs(sets: DataFrame, percent: int) -> DataFrame:
    """One row for each group of sets (row, g, tokens): g, rows, sizes, tokens (packed), and links between its rows."""

    def pack(t: pa.Table) -> pa.Table:
        rows, tokens = t.column("row").to_numpy(), t.column("tokens").to_pylist()
        group = Group(rows, [np.frombuffer(x, np.uint64) for x in tokens])
        links = [*group.links(group, percent, {})]
        row = {"g": t.column("g")[0].as_py(), "rows": blob(rows), "sizes": blob(group.size), "tokens": b"".join(tokens), "links": [{"a": x, "b": y} for x, y in links]}
        return pa.Table.from_pylist([row], schema=pa.schema([("g", pa.int64()), ("rows", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]))

    return sets.groupBy("g").applyInArrow(lambda t: freed(pack)(t), f"{_PACK}, links array<struct<a: bigint, b: bigint>>")


def _from_packs(packs: DataFrame, rows: DataFrame) -> DataFrame:
    """row, tokens of the given rows (``row``) and perhaps a few others."""
    wanted = Wanted(rows.select("row"), "row", rows.select("row"))
    member = wanted.filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sizes, tokens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, edge = np.frombuffer(own, np.int64), np.append(0, np.cumsum(np.frombuffer(sizes, np.int64))) * 8
                keep = np.flatnonzero(in_filter(member.value, own)) if member is not None else np.arange(len(own))
                for part in np.array_split(keep, -(-len(keep) // 64)) if len(keep) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(own[part]), pa.array([tokens[edge[i] : edge[i + 1]] for i in part.tolist()], pa.binary())], names=["row", "tokens"])

    return packs.select("rows", "sizes", "tokens").mapInArrow(tidied(run), "row bigint, tokens binary")


def _opened(members: DataFrame, packs: DataFrame, percent: int) -> DataFrame:
    """Links a, b between labels of members (row, label, g) of the same group."""

    def open_(rows: pa.Table) -> pa.Table:
        group = Group(rows.column("label").to_numpy(), [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()])
        return pa.Table.from_pylist([{"a": x, "b": y} for x, y in group.links(group, percent, {})], schema=_LINKS)

    return _from_packs(packs, members).join(members.hint("shuffle_merge"), "row").select("g", "label", "tokens").groupBy("g").applyInArrow(lambda t: freed(open_)(t), "a bigint, b bigint")


def _labelled(members: DataFrame, packs: DataFrame) -> DataFrame:
    """The groups of the members (row, label, g), with these alone: g, lo and hi (labels), labels, sizes, tokens (packed)."""

    def pack(t: pa.Table) -> pa.Table:
        tokens, labels = t.column("tokens"), t.column("label").to_numpy()
        sizes = np.array([len(x) // 8 for x in tokens.to_pylist()], np.int64)
        row = {"g": t.column("g")[0].as_py(), "lo": int(labels.min()), "hi": int(labels.max()), "labels": blob(labels), "sizes": blob(sizes), "tokens": b"".join(tokens.to_pylist())}
        return pa.Table.from_pylist([row], schema=pa.schema([("g", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("labels", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())]))

    named = _from_packs(packs, members).join(members.hint("shuffle_merge"), "row").select("g", "label", "tokens")
    return named.groupBy("g").applyInArrow(lambda t: freed(pack)(t), "g bigint, lo bigint, hi bigint, labels binary, sizes binary, tokens binary")


def unpacked(labels: bytes, sizes: bytes, tokens: bytes) -> Group:
    cut = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
    return Group(np.frombuffer(labels, np.int64), np.split(np.frombuffer(tokens, np.uint64), cut))


def first_tokens(group: Group, shared: np.ndarray, groups: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by which the group's sets ask for groups, and those by which they are found.

    ``shared`` (sorted) are the union's tokens that other groups have too, ``groups`` in how many they are.  A set that
    links with a larger one, or with one as large, has more tokens in common with it than one that links with a smaller.
    """
    asks, found = [], []
    for tokens in group.sets:
        n = len(tokens)
        at = np.searchsorted(shared, tokens)
        rarity = np.where(held(tokens, shared), groups[np.minimum(at, max(len(groups) - 1, 0))] if len(groups) else 1, 1)
        order = tokens[np.lexsort((tokens, rarity))]
        asks.append(order[: n - -(-percent * n // 100) + 1])
        found.append(order[: n - -(-2 * percent * n // (100 + percent)) + 1])
    asks, found = (np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in (asks, found))
    return asks[held(asks, shared)], found[held(found, shared)]


def _matrix_links(packs: DataFrame, percent: int) -> DataFrame:
    """Links between all labels of the packs (see :func:`_labelled`) that sets of the same or of different groups give."""

    def entries(part: int) -> DataFrame:
        """The matrix' tokens in one range: g, token."""

        def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = np.frombuffer(tokens, np.uint64)
                    union = np.unique(own[own % np.uint64(KEY_PARTS) == part]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(union), g)), pa.array(union)], names=["g", "token"])

        return packs.select("g", "tokens").mapInArrow(tidied(unions), "g bigint, token bigint")

    often = []  # tokens that several groups have, a few ranges after the other
    for part in range(KEY_PARTS):
        matrix = stored(entries(part))
        several = matrix.groupBy("token").agg(F.count("*").cast("int").alias("groups")).where("groups > 1")
        often.append(stored(matrix.join(several, "token").select("g", "token", "groups")))
        discard(matrix)
        free_shuffles(packs.sparkSession)

    def gather(t: pa.Table) -> pa.Table:
        token, n = t.column("token").to_numpy().view(np.uint64), t.column("groups").to_numpy()
        order = np.argsort(token)
        return pa.Table.from_pylist([{"g": t.column("g")[0].as_py(), "shared": blob(token[order]), "often": blob(n[order].astype(np.int32))}], schema=pa.schema([("g", pa.int64()), ("shared", pa.binary()), ("often", pa.binary())]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = first_tokens(unpacked(r["labels"], r["sizes"], r["tokens"]), np.frombuffer(r["shared"], np.uint64), np.frombuffer(r["often"], np.int32), percent)
                for asks, tokens in zip((True, False), found, strict=True):
                    n = len(tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["g"])), pa.array(np.full(n, r["lo"])), pa.array(np.full(n, r["hi"])), pa.array(tokens.view(np.int64)), pa.array(np.full(n, asks))], names=["g", "lo", "hi", "token", "asks"])

    known = reduce(DataFrame.unionByName, often).groupBy("g").applyInArrow(lambda t: freed(gather)(t), "g bigint, shared binary, often binary")
    first = stored(packs.join(known.hint("shuffle_merge"), "g").mapInArrow(tidied(choose), "g bigint, lo bigint, hi bigint, token bigint, asks boolean"))
    asking, asked = first.where("asks").drop("asks"), first.where("NOT asks").select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "lo", "hi")])
    meets = asking.join(asked, "token").where("g <> g2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)").select(F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2")).distinct()
    meets = meets.unionByName(packs.where("lo <> hi").select("g", F.col("g").alias("g2")))
    side = lambda x: packs.select(F.col("g").alias(f"g{x}"), F.struct("labels", "sizes", "tokens").alias(f"p{x}"))
    both = meets.join(side("").hint("shuffle_merge"), "g").join(side("2").hint("shuffle_merge"), "g2").select("p", "p2")

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, two, joined = unpacked(**row["p"]), unpacked(**row["p2"]), {}
                links = [*one.links(two, percent, joined), *two.links(one, percent, joined)]
                yield pa.RecordBatch.from_pylist([{"a": x, "b": y} for x, y in links], schema=_LINKS)

    return both.mapInArrow(tidied(open_), "a bigint, b bigint").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (row, label) after links between labels."""
    joined = components(links)
    return stored(follow(labels.withColumnRenamed("row", "node"), joined).withColumnRenamed("node", "row"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose ``size``-word shingle sets link: ``id_col``, n_shingles, component_id.

    Two documents link when ``100 * common >= percent * union`` of their distinct shingles; a text of fewer words has
    one shingle of all of them.  Exact but for collisions of 64-bit shingle hashes.

    Scale: equal sets are one node, by a grouping that combines before it shuffles.  Keys of parts are about a third of
    the tokens; sets that share fewer of them with others than a link takes are left out before anything else is done; texts don't travel (unless more than 4 million of them have parts in common, see :class:`Wanted`), only
    the sets of nodes with parts in common do.  A family of near copies, however large, is dealt to groups of about
    ``GROUP_SETS``; each level leaves one set of each component that groups have made, so that the levels' work shrinks
    by that factor.  Sets that share parts and never link meet through their rarest tokens only.  No cap: what levels
    leave apart goes through the matrix whole.

    A null text is an empty one; texts without words have no shingles, link with nothing and are their own component.
    Rows with a null id are linked as others are, but their id is no component's; a component without any other has a
    null one.  Rows that repeat an id with different texts are linked each by its own text.  Repeated rows stay.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    read = stored(_read(docs, id_col, text_col, size, percent))
    members = stored(read.select("row", "id", "print", "node", "n", "least"))
    nodes = stored(members.groupBy("node").agg(F.min("id").alias("smallest"), F.min(F.struct("row", "id", "print", "n", "least")).alias("first")).select("node", "smallest", "first.*"))
    members = members.drop("least")

    # sets that have as many parts in common with others as a link takes, so that a few parts that many texts have by
    # chance don't count
    meets = _in_common(read, nodes.where("n > 0").select("row"), []).groupBy("row").agg(F.sum("parts").alias("parts"))
    rows = stored(nodes.select("row", "least").join(meets.hint("shuffle_merge"), "row").where("parts >= least").select("row"))
    wanted = Wanted(read.select("row", "keys", F.xxhash64("row").alias("h")), "h", rows.select(F.xxhash64("row")))
    kept = stored(wanted.rows.mapInArrow(tidied(lambda batches: map(wanted.keep, batches)), wanted.rows.schema).select("row", "keys"))
    discard(read)
    # the smallest set that has a part (its lead)
    shared = stored(_in_common(kept, rows, ["lead"]).groupBy("row", "lead").agg(F.sum("parts").alias("parts")))
    discard(kept)

    # groups of the sets that share most of their parts with the same lead, and what is linked inside them
    leads = shared.groupBy("row").agg(F.max_by("lead", F.struct("parts", -F.col("lead"))).alias("lead"))
    chosen = stored(_dealt(leads.join(nodes.hint("shuffle_merge"), "row"), 0).select("row", "lead", "node", "id", "print", "n", "g"))
    packs = stored(_packs(_sets(docs, id_col, text_col, size, chosen), percent))
    free_shuffles(spark)
    labels = chosen.select("row", F.col("row").alias("label"))
    links = packs.select(F.explode("links").alias("l")).select("l.*")
    large = (F.col("m") > GROUP_SETS) | (F.col("s") > GROUP_TOKENS)
    wide = stored(chosen.groupBy("lead").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where(large).select("lead"))  # in several groups
    for level in range(1, LEVELS + 1):
        if not links.limit(1).count():
            break
        labels = _merged(labels, links)
        rows = chosen.select("row", "lead", "n").join(wide, "lead", "left_semi").join(labels.hint("shuffle_merge"), "row")
        one = stored(rows.groupBy("lead", "label").agg(F.min(F.struct(F.xxhash64("row", F.lit(level)), "row", "n")).alias("x")).select("x.row", "label", "x.n", "lead"))
        several = stored(one.groupBy("lead").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1"))
        wide = several.where(large).select("lead")
        links = stored(_opened(stored(_dealt(one.join(several.select("lead"), "lead", "left_semi"), level).select("row", "label", "g")), packs, percent))
        free_shuffles(spark)
    else:
        labels = _merged(labels, links)

    # what is left apart although it has parts in common: all sets around a lead that some of them are apart from
    rows = stored(chosen.select("row", "g").join(labels.hint("shuffle_merge"), "row"))
    names = rows.select("row", "label").hint("shuffle_merge")
    around = shared.select("row", "lead").join(names, "row").join(names.toDF("lead", "other"), "lead")
    around = stored(around.select("row", "lead", (F.col("label") != F.col("other")).alias("apart")))
    apart = stored(around.join(around.where("apart").select("lead").distinct(), "lead", "left_semi").select("row").distinct())
    if apart.limit(1).count():
        rest = stored(_labelled(rows.join(apart, "row", "left_semi"), packs))
        links = stored(_matrix_links(rest, percent))
        if links.limit(1).count():
            labels = _merged(labels, links)
    free_shuffles(spark)
    named = nodes.select("row", "node", "smallest").join(labels.hint("shuffle_merge"), "row", "left").withColumn("label", F.coalesce("label", "row"))
    smallest = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
    components_ = named.join(smallest, "label").select("node", "component_id")
    out = members.select("id", "node", "n").join(components_.hint("shuffle_merge"), "node")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
