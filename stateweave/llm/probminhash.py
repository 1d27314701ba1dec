"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Each element's arrivals form a Poisson process whose rate is its weight; every arrival falls on one of ``m`` registers,
a register keeps the element that arrives first, and an element stops as soon as its next arrival is later than the
latest register.  Two sets agree on each register, independently, with their probability Jaccard similarity.  A document
is the set of its word shingles, all of weight 1, so that this is the plain Jaccard similarity by which links are
decided: weights would hide pairs that differ in a few heavy shingles.  Registers are cut into bands; documents with an
equal band become candidates, and candidates are linked if the exact Jaccard similarity of their shingle sets reaches
the threshold.  Classes are the connected components of the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components, follow
from .store import discard, stored
from .texts import LOWER, Words, as_bytes, bound_batches, mixed, pieces, tidied, unused
from .wanted import Wanted

#: Members of a bucket of band values that are paired with each other; members of larger buckets are paired with a
#: leader and a neighbour first, and what that leaves apart is compared by an exact join afterwards.
SMALL_BUCKET = 8
#: Members of a bucket whose neighbours are looked for together.
WINDOW_ROWS = 4096
#: Candidates whose registers agree less than this are dropped unread: a pair at 0.8 does so with a probability of
#: 1 * 10**-8 (at most 52 of 96 independent registers of probability 0.8).
SKETCH_FLOOR = 0.55


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: index of the text, 64-bit hash.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text of fewer than ``size`` words has one shingle of all
    its words; a text without words has none.
    """
    w = Words([t.translate(LOWER) for t in texts])
    at, h = w.windows(size)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = w.counts[short] > k
            whole[more] = mixed(whole[more] + w.hash[w.first[:-1][short[more]] + k] + np.uint64(k + 1))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mixed(whole + w.counts[short].astype(np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first]


def digests(texts: list[bytes]) -> list[bytes]:
    """What texts with the same words have in common: 128 bits."""
    return [hashlib.blake2b(b" ".join(t.translate(LOWER).split()), digest_size=16).digest() for t in texts]


def sketch(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """``m`` registers for each of ``n`` weighted sets: the element that arrived first, 0 where a set is empty."""
    arrival = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    doc, element, rate = doc.astype(np.int64), element, weight.astype(float)
    time = np.zeros(len(doc))
    seed = element
    while len(doc):
        seed = mixed(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-(seed >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        register = doc * m + (mixed(seed ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(arrival, register, time)
        first = arrival[register] == time
        winner[register[first]] = element[first]
        open_docs, inverse = np.unique(doc, return_inverse=True)
        latest = arrival.reshape(n, m)[open_docs].max(axis=1)
        going = time < latest[inverse]
        doc, element, rate, time, seed = doc[going], element[going], rate[going], time[going], seed[going]
    return winner.reshape(n, m)


def _sketched(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, print (hash of the text), node (digest of the words), n_shingles, a value for each band, a byte of each register."""
    salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in pieces(texts):
                doc, h = shingle_sets(texts[a:b], size)
                regs = sketch(doc, h, np.ones(len(h)), b - a, bands * rows).reshape(b - a, bands, rows)
                key = np.broadcast_to(salt, (b - a, bands)).copy()
                for k in range(rows):
                    key = mixed(key + regs[:, :, k])
                low = mixed(regs).astype(np.uint8).reshape(b - a, bands * rows)
                n = np.bincount(doc, minlength=b - a)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests(texts[a:b]), pa.binary()), pa.array(n, pa.int32()), keys, pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "print", "node", "n_shingles", "bands", "registers"])

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"), text.alias("text"))
    return source.mapInArrow(tidied(run), f"id {id_type}, print bigint, node binary, n_shingles int, bands array<bigint>, registers binary")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose registers agree often enough to be worth reading."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("b").hint("shuffle_merge"), "b").join(side("a").hint("shuffle_merge"), "a").select("a", "b", "ra", "rb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= SKETCH_FLOOR))

    return joined.mapInArrow(tidied(compare), pairs.select("a", "b").schema)


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Shingle sets (packed, sorted) of the wanted (node, id).  Texts don't travel while the wanted ones are few."""
    node = F.col(f"`{id_col}`")
    source = docs.where(node.isNotNull()).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.xxhash64(node).alias("h"))
    member = Wanted(source, "h", wanted.select(F.xxhash64("id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(member.keep(batch).column("text"))
            for a, b in pieces(texts):
                doc, h = shingle_sets(texts[a:b], size)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([pa.array(digests(texts[a:b]), pa.binary()), pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    return member.rows.mapInArrow(tidied(sets), "node binary, shingles binary").join(wanted.select("node").hint("shuffle_merge"), "node", "left_semi").dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have at least the similarity ``threshold``, with the similarity."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    joined = pairs.join(side("b").hint("shuffle_merge"), "b").join(side("a").hint("shuffle_merge"), "a").select("a", "b", "sa", "sb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_py(), np.uint64), np.frombuffer(sb.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append(common / (len(both) - common) if len(both) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    id_type = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(tidied(compare), f"a {id_type}, b {id_type}, similarity double").where(F.col("similarity") >= threshold)


def _left_apart(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Every pair of members (node, label) of different components that can still reach the threshold, exactly.

    Shingles are ordered from rare to frequent.  The smaller set of such a pair has one of its first ``index`` shingles
    among the first ``probe`` of the larger one, so wording that many members share leads to no pairs unless it fills
    the sets.  Shingles that only one component has are left out.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in arrays])
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(n, n), pa.int32()), pa.array(np.concatenate(arrays) if len(n) else np.zeros(0, np.int64))], names=["node", "label", "size", "shingle"])

    id_type = sets.schema["node"].dataType.simpleString()
    rows = stored(members.join(sets, "node").select("node", "label", "shingles").mapInArrow(tidied(unpack), f"node {id_type}, label {id_type}, size int, shingle bigint"))
    frequency = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ranked = rows.join(frequency, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "shingle"))).where("lo <> hi")
    probe = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    index = F.col("size") - F.ceil(F.col("size") * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    first = stored(ranked.where(F.col("rank") <= probe).select("shingle", "node", "label", "size", "rank", (F.col("rank") <= index).alias("indexed")))
    small = first.where("indexed").drop("indexed")
    large = first.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "size", "rank")])
    order = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("node") < F.col("node2")))
    room = F.least(F.col("size") - F.col("rank"), F.col("size2") - F.col("rank2")) + 1  # shared at most, if this is the first shared
    enough = room >= (F.col("size") + F.col("size2")) * (threshold / (1 + threshold)) - 1e-9
    return small.join(large, "shingle").where(order & enough & (F.col("label") != F.col("label2"))).select(*_pair("node", "node2")).distinct()


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """id, print, class_id and whether the row is the one that stays: one row for each row."""
    spark = docs.sparkSession
    bound_batches(spark)
    all_docs = stored(_sketched(docs, id_col, text_col, size, bands, rows))
    members = stored(all_docs.select("id", "print", "node"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "print"))).alias("first")
    leaders = stored(members.groupBy("node").agg(first).select("node", F.col("first.id").alias("id"), F.col("first.print").alias("print")))
    chosen = leaders.where("id IS NOT NULL")
    alone = stored(all_docs.where("n_shingles > 0").join(chosen.hint("shuffle_merge"), ["node", "id", "print"], "left_semi").dropDuplicates(["node"]).drop("print"))
    discard(all_docs)

    entries = alone.select("node", "n_shingles", F.explode("bands").alias("key"))
    lead = F.min(F.struct("node", "n_shingles")).alias("lead")
    buckets = entries.groupBy("key").agg(F.count("*").cast("int").alias("n"), lead).where("n > 1")
    shared = stored(entries.join(buckets.hint("shuffle_merge"), "key"))
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * threshold  # noqa: E731  else the sets' sizes alone rule a link out
    stars = shared.where((F.col("node") != F.col("lead.node")) & fits("n_shingles", "lead.n_shingles")).select(*_pair("node", "lead.node"))
    near = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / WINDOW_ROWS))).orderBy(F.xxhash64("key", "node"), "node")
    before = F.array(*[F.when((F.lit(k) <= 1) | (F.col("n") <= SMALL_BUCKET + 1), F.lag(F.struct(F.col("node").alias("other"), F.col("n_shingles").alias("m")), k).over(near)) for k in range(1, SMALL_BUCKET + 1)])
    paths = shared.select("node", "n_shingles", before.alias("before")).select("node", "n_shingles", F.explode("before").alias("p")).where(F.col("p").isNotNull() & fits("n_shingles", "p.m")).select(*_pair("node", "p.other"))
    pairs = stored(_alike(stars.unionByName(paths).distinct(), alone))

    ends = lambda x: x.select(F.col("a").alias("node")).union(x.select(F.col("b").alias("node")))
    big = shared.where(F.col("n") > SMALL_BUCKET + 1).select("key", "node")
    wanted = stored(ends(pairs).union(big.select("node")).distinct().join(chosen.select("node", "id").hint("shuffle_merge"), "node"))
    sets = stored(_sets(wanted, docs, id_col, text_col, size))
    links = stored(_linked(pairs, sets, threshold))
    labels = components(links)

    labelled = big.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    apart = stored(labelled.join(split, "key", "left_semi").select("node", "label").distinct())
    if apart.limit(1).count():
        more = _linked(_left_apart(apart, sets, threshold).join(pairs, ["a", "b"], "left_anti"), sets, threshold)
        name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
        more = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        joined = components(more.where("a <> b"))
        grown = follow(labels, joined)
        labels = stored(grown.unionByName(joined.join(labels, "node", "left_anti")))
    named = chosen.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = named.groupBy("label").agg(F.min(F.struct("id", "print")).alias("best"))
    classes = named.join(best, "label").select("node", "best")
    return members.join(classes.hint("shuffle_merge"), "node", "left").select("id", "print", F.col("best.id").alias("class_id"), F.coalesce((F.col("id") == F.col("best.id")) & (F.col("print") == F.col("best.print")), F.lit(False)).alias("stays"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """The near-duplicate class of every document: ``id_col`` and ``class_id`` (the smallest id in the class).

    Links are between texts whose sets of ``size``-word shingles have a Jaccard similarity of ``threshold`` or more.
    With 24 bands of 4 registers a pair at 0.8 shares no band with a probability of about 3 in a million.

    Scale: exact copies (equal words) are collapsed to their smallest id first, by a grouping with map-side
    aggregation.  A band value's bucket never meets in one task: its leader and size come from such a grouping too,
    the join back can be split, and neighbours are looked for among at most about ``WINDOW_ROWS`` members.  Pairs grow
    with the number of documents times bands.  Members of buckets with more than ``SMALL_BUCKET + 1`` texts that the
    first links leave in different components go through an exact prefix-filtered join, so no link is given up.  Texts
    are read twice but never shuffled; only the shingle sets of candidates are.

    A null text is an empty one; texts without words are copies of each other.  Rows that repeat an id with different
    texts are classed each by its own text.  Rows with a null id get the class of their copies, or null.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, size, threshold, bands, rows).select(F.col("id").alias(id_col), "class_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class of :func:`near_duplicates` one document stays.

    It is the one with the smallest id (of rows that repeat it with different texts of the class, one of them).  Rows
    with a null id can't be told apart and all stay.  Of rows with equal ids and texts one stays.  Columns keep their
    names and values, whatever their names.
    """
    node, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    classes = stored(_classes(docs, id_col, text_col, size, threshold, bands, rows))
    own_id, own_print = unused(docs, 2)
    stay = stored(classes.where("stays").groupBy(F.col("id").alias(own_id), F.col("print").alias(own_print)).count())
    kept = docs.join(stay.select(own_id, own_print).hint("shuffle_merge"), (node == F.col(own_id)) & (F.xxhash64(text) == F.col(own_print)), "left_semi")
    if stay.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    if classes.where("id IS NULL").limit(1).count():
        kept = kept.unionByName(docs.where(node.isNull()))
    return kept
