"""Quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains.  Expectation-maximisation estimates from the votes alone how
often each rule votes bad on good and on bad documents; the posterior probability of being good replaces
"all rules must pass".  Only counts of vote patterns (at most 3 to the power of the number of rules) reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored
from .texts import Words, as_bytes, bound_batches, mixed, pieces, range_hash, tidied, unused

#: Counts of a document, in this order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_marks", "n_letters", "n_marked"]
WINDOW = 5

_SYMBOL, _UPPER, _LOWER, _MARK, _LETTER = (np.zeros(256, np.int64) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER[0x41:0x5B] = 1
_LOWER[0x61:0x7B] = 1
_MARK[list(b"!")] = 1
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = 1


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte) over each text and its gap."""
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)


def _surplus(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many of its values equal an earlier one of its own."""
    key = np.sort(mixed(value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    distinct = len(key) and 1 + np.count_nonzero(key[1:] != key[:-1])
    if distinct == len(key):
        return np.zeros(n, np.int64)
    pair = np.rec.fromarrays([owner, value])
    _, first = np.unique(pair, return_index=True)
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def count_texts(texts: list[bytes]) -> np.ndarray:
    """``COUNTS`` of each text."""
    w = Words(texts)
    n, data, starts = len(texts), w.data, w.starts
    solid = np.zeros(len(data) + 1, np.int64)
    edges = np.zeros(len(data) + 1, np.int8)
    edges[w.begin] += 1
    edges[w.end] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8)
    np.cumsum(inside, out=solid[1:])
    begins_char = (data & 0xC0) != 0x80

    newline = data == 0x0A
    newline[starts[1:] - 1] = True  # the gap after a text ends its last line
    line_end = np.flatnonzero(newline)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    with_word = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = np.searchsorted(starts, line_start, side="right") - 1
    dup_lines = _surplus(line_doc, range_hash(w.sums, line_start, line_end), n)

    marked = (_SYMBOL[data[w.begin]] | _SYMBOL[data[w.end - 1]]) > 0  # words that begin or end with a symbol
    at, h = w.windows(WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(at):
        key = mixed(h + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        cover = np.zeros(len(w.begin) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        repeat = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return np.stack([
        w.counts, _per_text(inside * begins_char, starts), _per_text(_SYMBOL[data], starts), dup_lines, repeat, np.bincount(line_doc, minlength=n),
        _per_text(_UPPER[data], starts), _per_text(_LOWER[data], starts), _per_text(_MARK[data], starts), _per_text(_LETTER[data] * begins_char, starts), np.bincount(w.doc[marked], minlength=n),
    ], axis=1).astype(np.int64)


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTS`` of every whole text (null: all zero), one row for each row, no shuffle."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in pieces(texts):
                counts = count_texts(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c) for c in counts.T)], names=[id_col, *COUNTS])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidied(run), f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, good where ``good`` holds and ``bad`` doesn't, else abstains."""

    name: str
    bad: str
    good: str


RULES = [
    Rule("length", "n_words < 10", "n_words >= 20"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    Rule("capitals", "n_upper > n_lower", "n_upper + n_lower > 0 AND 4 * n_upper <= n_lower"),
    Rule("marks", "4 * n_marks > n_words", "50 * n_marks <= n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words", "word_chars >= 3 * n_words AND word_chars <= 12 * n_words"),
    Rule("letters", "4 * n_letters < 3 * word_chars", "10 * n_letters >= 9 * word_chars"),
    Rule("symbol_words", "10 * n_marked > n_words", "50 * n_marked <= n_words"),
]


_NAMES = re.compile(r"\b(?:" + "|".join(COUNTS) + r")\b")


def vote_pattern(rules: list[Rule], inside: str = "") -> Column:
    """All votes as one number in base 3: 0 abstains, 1 good, 2 bad.  ``inside``: the struct that holds the counts."""
    say = lambda x: F.expr(_NAMES.sub(lambda m: f"{inside}{m[0]}", x))
    votes = [F.when(say(r.bad), 2).when(say(r.good), 1).otherwise(0) * F.lit(3**i) for i, r in enumerate(rules)]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total.cast("int")


#: Belief before any document is seen: how often a rule that votes calls a good and a bad document bad, as so many votes.
BELIEF, BELIEF_VOTES = (0.01, 0.25), 20.0
#: Where estimation starts: probability of being bad with no, one, two and more bad votes.
START = (0.02, 0.3, 0.9, 0.98)


def estimate(patterns: np.ndarray, counts: np.ndarray, n_rules: int, bad_share: float = 0.15, belief_votes: float = BELIEF_VOTES, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Posterior probability of being good for each vote pattern, by expectation-maximisation.

    Estimated are the share of bad documents and, for every rule, how often it votes bad where it votes, on good and on
    bad documents.  ``BELIEF`` counts as ``belief_votes`` votes on each side, so it fades as documents are added.
    Estimation starts from the number of bad votes and ends when no posterior moves by more than ``tolerance``.  A bad
    vote never speaks for a document: a rule found to vote bad more often on good documents gets one rate for both.
    Without any documents there is nothing to estimate and the result is empty.
    """
    if not len(patterns):
        return np.zeros(0)
    votes = patterns[:, None] // 3 ** np.arange(n_rules) % 3
    says_bad, says_good = (votes == 2).astype(float), (votes == 1).astype(float)
    bad = np.array(START)[np.minimum(says_bad.sum(axis=1), 3).astype(int)]
    for _ in range(rounds):
        share = (counts @ bad + belief_votes * bad_share) / (counts.sum() + belief_votes)
        mass = np.stack([(1 - bad) * counts, bad * counts])
        voted_bad = mass @ says_bad + belief_votes * np.array(BELIEF)[:, None]
        voted = mass @ (says_bad + says_good) + belief_votes
        rate = voted_bad / voted
        rate = np.where(rate[0] > rate[1], voted_bad.sum(axis=0) / voted.sum(axis=0), rate)
        odds = np.log(share / (1 - share)) + says_bad @ np.log(rate[1] / rate[0]) + says_good @ np.log((1 - rate[1]) / (1 - rate[0]))
        last, bad = bad, 1 / (1 + np.exp(-odds))
        if np.abs(bad - last).max() <= tolerance:
            break
    return 1 - bad


def _failed(inside: str = "") -> Column:
    words, repeats = F.col(f"{inside}n_words"), F.col(f"{inside}n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def _posterior(votes: DataFrame, n_rules: int) -> DataFrame:
    """votes, quality: a row for each pattern that occurs."""
    seen = sorted(votes.groupBy("votes").count().collect())  # at most 3 ** n_rules rows; sorted, so that sums are the same in every run
    patterns = np.array([r["votes"] for r in seen], np.int64)
    good = estimate(patterns, np.array([r["count"] for r in seen], float), n_rules)
    return votes.sparkSession.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, good, strict=True)], "votes int, quality double")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts of each document, ``quality`` (posterior probability of being good), ``base_failed`` and ``kept``.

    One row for each row of ``docs``; the counts are written once to the shared folder, as they are read twice (for
    the estimate and for the result).  ``base_failed``: under 10 words, or over 20 % of them in repeated 5-word
    windows; such documents aren't kept, others are if ``quality`` is at least ``threshold``.  All documents have a
    part in the estimate.  A null or empty text has no words and fails; an empty table gives an empty result; repeated
    rows are judged each; other columns are ignored.
    """
    rules = rules or RULES
    counted = stored(count_documents(docs, id_col, text_col).withColumn("votes", vote_pattern(rules)))
    failed = _failed()
    table = _posterior(counted, len(rules))
    return (
        counted.join(F.broadcast(table), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
        .drop("votes")
    )


def keep_documents(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_documents` keeps, with all of their columns, whatever their names.

    Reads the texts twice (for the estimate and for the result) and shuffles none of them.  Rows whose text is null,
    empty or too short go; repeated rows stay or go together; an empty table gives an empty one.
    """
    rules = rules or RULES
    bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    inside, votes, quality = unused(docs, 3)
    counted = count_documents(docs.select(F.lit(0).alias(votes), F.col(f"`{text_col}`").alias("text")), votes, "text").withColumn("votes", vote_pattern(rules))
    table = _posterior(counted, len(rules)).toDF(votes, quality)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at).cast(pa.string()))
            for a, b in pieces(texts):
                counts = pa.StructArray.from_arrays([pa.array(c) for c in count_texts(texts[a:b]).T], names=COUNTS)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), counts], names=[*names, inside])

    judged = docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(inside, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))]))
    judged = judged.where(~_failed(f"{inside}.")).withColumn(votes, vote_pattern(rules, f"{inside}."))
    return judged.join(F.broadcast(table), votes).where(F.col(quality) >= threshold).select(*[f"`{c}`" for c in names])
