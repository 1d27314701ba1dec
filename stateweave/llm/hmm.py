"""A hidden Markov language model whose states emit tokens.

Baum-Welch starts with emissions tied by classes of tokens (by their last bytes): P(token | state) = P(class | state)
P(token | class), where the second factor doesn't matter to the states.  Every partition computes expected counts with
the scaled forward-backward recursion, Spark sums them, the driver normalises them.  The last round unties the tokens:
its expected counts of each token in each state cover the whole training text and stay distributed in shards of tokens.
The tied emissions are what they are smoothed with.  The score of a text is its exact likelihood, from the scaled forward
recursion over all of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import MESSAGE, Deal, blob, by_shard, messages
from .store import discard, stored
from .texts import LOWER, Words, as_bytes, bound_batches, freed, pieces, range_hash, shard_of, shards_for, text_bytes, tidied

#: Bytes of text in a shard of documents; there are as many shards of tokens.
SHARD_BYTES = 8 << 20
#: Tokens that one forward-backward pass looks at together (a longer text is a pass of its own).
PASS_TOKENS = 1 << 19
#: Bytes at a token's end that decide its class.
SUFFIX = 3
#: Stands for the end of a text among token hashes.
END = np.uint64(0xE0D0E0D0E0D0E0D1)


@dataclass
class Model:
    """Probabilities: of first states, of the next state, and of each class (the last is the end) in each state."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def pack(self) -> np.ndarray:
        return np.concatenate([self.first, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def unpack(flat: np.ndarray, states: int) -> Model:
        return Model(flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, -1))


def start_model(class_counts: np.ndarray, states: int) -> Model:
    """Class frequencies, tilted differently (but always in the same way) for each state."""
    rng = np.random.default_rng(11)
    emit = (class_counts + 1.0) * rng.gamma(1.0, size=(states, len(class_counts))) + 1e-3
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def maximised(counts: Model, smoothing: float = 0.1) -> Model:
    """The M step: smoothed expected counts, normalised."""
    norm = lambda x: (x + smoothing) / (x + smoothing).sum(axis=-1, keepdims=True)
    return Model(norm(counts.first), norm(counts.move), norm(counts.emit))


class _Ragged:
    """Sequences side by side: at each step the longer ones come first, so that those still running are a prefix."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        self.rank = np.argsort(-lengths, kind="stable")
        long = lengths[self.rank]
        self.steps = int(long[0]) if len(long) else 0
        self.running = np.searchsorted(-long, -np.arange(self.steps), side="left")  # sequences longer than t
        self.cut = np.append(0, np.cumsum(self.running))
        begin = (np.cumsum(lengths) - lengths)[self.rank]
        t = np.repeat(np.arange(self.steps), self.running)
        self.seq = np.arange(self.cut[-1]) - self.cut[t]
        self.classes = classes[begin[self.seq] + t]


def forward(model: Model, r: _Ragged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, the scale of each step, and the emissions, step by step."""
    emission = np.ascontiguousarray(model.emit.T)[r.classes]
    alpha = np.empty_like(emission)
    scale = np.empty(len(r.classes))
    cut, ones = r.cut.tolist(), np.ones(len(model.first))
    for t in range(r.steps):
        a, b = cut[t], cut[t + 1]
        x, c = alpha[a:b], scale[a:b]
        if t:
            np.matmul(alpha[last : last + b - a], model.move, out=x)
            x *= emission[a:b]
        else:
            np.multiply(model.first, emission[a:b], out=x)
        np.matmul(x, ones, out=c)
        x /= c[:, None]
        last = a
    return alpha, scale, emission


def log10_likelihood(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of classes (0 for an empty one)."""
    r = _Ragged(classes, lengths)
    _, scale, _ = forward(model, r)
    out = np.zeros(len(lengths))
    out[r.rank] = np.bincount(r.seq, np.log10(scale), len(lengths)) if len(lengths) else 0
    return out


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> Model:
    """Expected first states, moves and emissions of the sequences (the E step)."""
    r = _Ragged(classes, lengths)
    alpha, scale, emission = forward(model, r)
    states, n_classes = model.emit.shape
    move, back, cut = np.zeros((states, states)), np.ascontiguousarray(model.move.T), r.cut.tolist()
    emission /= scale[:, None]
    for t in range(r.steps - 2, -1, -1):
        a, b, end = cut[t : t + 3]
        n, ahead = end - b, emission[b:end]  # times the backward probabilities, which are 1 at a sequence's last token
        move += alpha[a : a + n].T @ ahead
        beta = ahead @ back
        emission[a : a + n] *= beta
        alpha[a : a + n] *= beta  # from here on the probability of each state
    emit = np.stack([np.bincount(r.classes, alpha[:, s], n_classes) for s in range(states)])
    return Model(alpha[: r.running[0]].sum(axis=0) if r.steps else np.zeros(states), model.move * move, emit)


# tokens -----------------------------------------------------------------------------------------------------------


def tokens_of(texts: list[bytes], n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and classes of all texts, one after the other, each with its end; and how many tokens each has."""
    hashes, classes, counts = [], [], []
    for a, b in pieces(texts):
        w = Words([t.translate(LOWER) for t in texts[a:b]])
        suffix = range_hash(w.sums, np.maximum(w.begin, w.end - SUFFIX), w.end) % np.uint64(n_classes)
        hashes.append(np.insert(w.hash, w.first[1:], END))
        classes.append(np.insert(suffix.astype(np.uint16), w.first[1:], n_classes))
        counts.append(w.counts + 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(classes), np.concatenate(counts)


class _Shard:
    """The documents of a shard and their different tokens, in an order that depends on the tokens only."""

    def __init__(self, table: pa.Table, n_classes: int, n_shards: int):
        self.texts = as_bytes(table.column("text"))
        self.train = ~np.asarray(table.column("held_out").to_numpy(), bool)
        self.hash, self.cls, self.counts = tokens_of(self.texts, n_classes)
        self.keys, first, self.which = np.unique(self.hash, return_index=True, return_inverse=True)
        self.key_class = self.cls[first]
        self.deal = Deal((self.keys % np.uint64(n_shards)).astype(np.int64))


def tell_counts(table: pa.Table, model: Model, n_classes: int, n_shards: int) -> pa.Table:
    """A shard of documents: its tokens, their classes, their counts and expected counts by state in training texts."""
    if not table.num_rows:
        return messages([])
    source = table.column("shard")[0].as_py()
    s = _Shard(table, n_classes, n_shards)
    train = np.repeat(s.train, s.counts)
    n = np.bincount(s.which, train, len(s.keys)).astype(np.int64)
    which, lengths = s.which[train], s.counts[s.train]
    by_token = Model(model.first, model.move, model.emit[:, s.key_class])
    expected = np.zeros((len(s.keys), len(model.first)))
    edge = np.append(0, np.cumsum(lengths))
    for a, b in _passes(lengths):
        expected += expected_counts(by_token, which[edge[a] : edge[b]], lengths[a:b]).emit.T
    return messages([(k, source, 0, blob(s.keys[own]), blob(s.key_class[own]), _packed(n[own], expected[own])) for k, own in s.deal])


def _packed(n: np.ndarray, expected: np.ndarray) -> bytes:
    """Counts of tokens and their expected counts by state; those of the last state are what is left of the count."""
    return blob(n) + blob(expected[:, :-1].astype(np.float32))


def _both_counts(packed: bytes, states: int) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_packed` has packed."""
    k = len(packed) // (4 + 4 * states)
    n, e = np.frombuffer(packed, np.int64, k), np.frombuffer(packed, np.float32, k * (states - 1), 8 * k).reshape(k, states - 1)
    return n, np.column_stack([e, np.maximum(0.0, n - e.sum(axis=1, dtype=np.float64))])


def add_counts(table: pa.Table, states: int) -> pa.Table:
    """A shard of tokens: each sender's tokens' counts over all documents, sums for each class (2) and each state (3)."""
    shard = table.column("shard")[0].as_py()
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")]
    distinct, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total, expected = np.zeros(len(distinct), np.int64), np.zeros((len(distinct), states))
    out, start = [], 0
    for k, c in zip(keys, table.column("c"), strict=True):
        own = which[start : start + len(k)]  # a sender names a token once
        n, e = _both_counts(c.as_py(), states)
        total[own] += n
        expected[own] += e
        start += len(k)
    start = 0
    sums = expected.sum(axis=0)
    for source, k in zip(table.column("source").to_pylist(), keys, strict=True):
        own = which[start : start + len(k)]
        out.append((source, shard, 1, _packed(total[own], expected[own]), b"", b""))
        start += len(k)
    classes = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in table.column("b")])[first]
    mass, kinds = np.bincount(classes, total), np.bincount(classes, total > 0)
    known = np.flatnonzero(kinds)
    out.append((-1, shard, 2, blob(known.astype(np.int64)), blob(mass[known].astype(np.int64)), blob(kinds[known].astype(np.int64))))
    out.append((-1, shard, 3, blob(sums), b"", b""))
    return messages(out)


def token_emissions(model: Model, classes: np.ndarray, within: np.ndarray, expected: np.ndarray, state_sums: np.ndarray, distinct: int) -> np.ndarray:
    """P(token | state): expected counts, and half a count for each different token dealt out by the tied emissions."""
    prior = 0.5 * (distinct + 1)
    return (expected.T + prior * model.emit[:, classes] * within) / (state_sums[:, None] + prior)


def _state_sums(replies: DataFrame, states: int) -> np.ndarray:
    """Expected counts of each state over all tokens (one row for each state reaches the driver)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(states), pa.int32()), pa.array(np.frombuffer(a, np.float64))], names=["i", "x"])

    out = np.zeros(states)
    for r in replies.where("kind = 3").select("a").mapInArrow(unpack, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def _class_counts(sequences: DataFrame, n_classes: int) -> np.ndarray:
    """How often each class occurs in the training texts (one row for each class reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_classes + 1, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=n_classes + 1)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["i", "n"])

    out = np.zeros(n_classes + 1, np.int64)
    for r in sequences.select("classes").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return out


def _class_sums(replies: DataFrame, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different tokens of each class in the training texts (one row for each class reaches the driver)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (a, b, c)], names=["cls", "n", "v"])

    rows = replies.where("kind = 2").select("a", "b", "c").mapInArrow(unpack, "cls bigint, n bigint, v bigint").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(n_classes + 1, np.int64), np.zeros(n_classes + 1, np.int64)
    for r in rows:
        n[r["cls"]], v[r["cls"]] = r["n"], r["v"]
    return n, v


def _passes(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > PASS_TOKENS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sequences of several batches for one pass: long passes have fewer steps for each token."""
    seqs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for x in batch.column(0).to_pylist():
            seqs.append(np.frombuffer(x, np.uint16))
            size += len(seqs[-1])
            if size >= PASS_TOKENS:
                yield seqs
                seqs, size = [], 0
    if seqs:
        yield seqs


def _em_round(sequences: DataFrame, model: Model) -> Model:
    """Expected counts over all training texts."""
    states = len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.pack()))
        for seqs in _gathered(batches):
            lengths = np.array([len(x) for x in seqs], np.int64)
            total += expected_counts(model, np.concatenate(seqs), lengths).pack()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["i", "x"])

    flat = np.zeros(len(model.pack()))
    for r in sequences.select("classes").mapInArrow(tidied(run), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # the model's size
        flat[r["i"]] = r["x"]
    return Model.unpack(flat, states)


def default_held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id, as text, leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, states: int = 6, n_classes: int = 2048, rounds: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Learn from the documents that aren't held out and score all of them.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that occur in training), ``train_tokens``,
    ``base_score`` (log10, smoothed token frequencies) and ``score`` (log10 probability under the hidden Markov model).

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.  A null text is an empty one (its end
    alone).  A null id isn't held out.  Repeated rows count each.  Without training texts every token is unknown.  An
    empty table gives an empty result.  Other columns are ignored.

    Scale: texts are dealt once by id; what travels besides is one entry for each different token of a shard, there and
    back, with its counts by state.  A word that every text has costs one entry a shard.  The driver gets
    ``states * n_classes`` sums a round.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = shards_for(text_bytes(docs, text_col), shard_bytes)
    id_type = docs.schema[id_col].dataType.simpleString()
    held_out = default_held_out(id_col) if held_out is None else held_out
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out.alias("held_out"))
    dealt = by_shard(source.select(shard_of(F.col("id"), n).alias("shard"), "id", "text", "held_out"), n)

    def sequences_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in pieces(texts):
                _, cls, counts = tokens_of(texts[a:b], n_classes)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(cls, np.cumsum(counts)[:-1])], pa.binary())], names=["classes"])

    sequences = stored(source.where(~F.col("held_out")).select("text").mapInArrow(tidied(sequences_of), "classes binary"))
    before = model = start_model(_class_counts(sequences, n_classes), states)
    for _ in range(rounds):
        before, model = model, maximised(_em_round(sequences, model))
    discard(sequences)

    # the last round's expected counts once more, token by token
    told = dealt.groupBy("shard").applyInArrow(lambda t: freed(tell_counts)(t, before, n_classes, n), MESSAGE)
    replies = stored(by_shard(told, n).groupBy("shard").applyInArrow(lambda t: freed(add_counts)(t, states), MESSAGE))
    mass, kinds = _class_sums(replies, n_classes)
    state_sums = _state_sums(replies, states)
    total, distinct = int(mass.sum()), int(kinds.sum())

    def score(t: pa.Table, inbox: pa.Table) -> pa.Table:
        s = _Shard(t, n_classes, n)
        count, expected = np.zeros(len(s.keys), np.int64), np.zeros((len(s.keys), states))
        for home, a in zip(inbox.column("source").to_pylist(), inbox.column("a").to_pylist(), strict=True):
            own = s.deal.of(home)
            count[own], expected[own] = _both_counts(a, states)
        c = count[s.which]
        doc = np.repeat(np.arange(len(s.texts)), s.counts)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        within = (count + 0.5) / (mass[s.key_class] + 0.5 * (kinds[s.key_class] + 1))
        within[s.keys == END] = 1.0  # the only token of its class
        by_token = Model(model.first, model.move, token_emissions(model, s.key_class, within, expected, state_sums, distinct))
        summed = lambda x: np.bincount(doc, x, len(s.texts))
        model_score = np.zeros(len(s.texts))
        edge = np.append(0, np.cumsum(s.counts))
        for a, b in _passes(s.counts):
            model_score[a:b] = log10_likelihood(by_token, s.which[edge[a] : edge[b]], s.counts[a:b])
        columns = [t.column("id"), t.column("held_out"), pa.array(s.counts), pa.array(summed(c > 0).astype(np.int64)), pa.array(np.full(len(s.texts), total)), pa.array(summed(base)), pa.array(model_score)]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = dealt.groupBy("shard").cogroup(by_shard(replies.where("kind = 1"), n).groupBy("shard")).applyInArrow(lambda t, m: freed(score)(t, m), f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
