"""Token counts of texts under a unigram model, with dynamic programming shared along a trie.

The distinct pre-tokens of a batch are put in order, which walks the trie of their letters depth first.  The best
score and the number of tokens of every prefix are computed once, when the walk enters the prefix's node, and used for
all pre-tokens below it; what stands at a pre-token's last node is its count.  A text's count is the sum over its
pre-tokens.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_LENGTH, byte_letters
from .texts import as_bytes, bound_batches, tidied

#: Pre-tokens whose counts a worker remembers; a full memory starts anew (results don't depend on it).
CACHE_ENTRIES = 400_000


def zipf_scores(definition: bytes) -> dict[bytes, float]:
    """Log probabilities for the tokens of a byte-level vocabulary (JSON): in inverse proportion to rank.

    Ids of such a vocabulary are in the order in which tokens were found to be frequent; the single bytes come first.
    """
    vocab: dict[str, int] = json.loads(definition)["model"]["vocab"]
    value_of = {c: b for b, c in enumerate(byte_letters())}
    total = math.log(sum(1 / (i + 3) for i in range(len(vocab))))
    return {bytes(value_of[c] for c in piece): -math.log(rank + 3) - total for rank, (piece, _) in enumerate(sorted(vocab.items(), key=lambda x: x[1]))}


class Counter:
    """Best segmentations of pre-tokens under token scores (ties: the one with fewer tokens)."""

    def __init__(self, scores: dict[bytes, float]):
        self.tails: dict[bytes, float | None] = {}  # ends of tokens, with the token's score if the end is the whole token
        for token in scores:
            for k in range(1, len(token)):
                self.tails.setdefault(token[k:], None)
        self.tails.update(scores)
        self.known: dict[bytes, tuple[int, float]] = {}

    def learn(self, pre_tokens: set[bytes]) -> None:
        """Works out pre-tokens that aren't known yet, in one walk over their trie."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = sorted(pre_tokens - self.known.keys())
        tails = self.tails
        best, count = [0.0], [0]  # for each node on the path from the root
        last = b""
        for word in new:
            depth = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                depth += 1
            del best[depth + 1 :], count[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                top, n = -math.inf, 0
                for begin in range(end - 1, -1, -1):
                    score = tails.get(word[begin:end], False)
                    if score is False:
                        break
                    if score is not None:
                        s, k = best[begin] + score, count[begin] + 1
                        if s > top or (s == top and k < n):
                            top, n = s, k
                best.append(top)
                count.append(n)
            self.known[word] = (count[-1], best[-1])
            last = word

    def count(self, texts: list[bytes]) -> list[tuple[int, int, float]]:
        """For each text: pre-tokens, tokens, log probability."""
        words = [[b" " + w for w in t.split()] for t in texts]
        self.learn(set().union(*words))
        out = []
        for w in words:
            found = [self.known[x] for x in w]
            out.append((len(w), sum(n for n, _ in found), math.fsum(s for _, s in found)))
        for x in {x for w in words for x in w if len(x) > CACHE_LENGTH}:
            del self.known[x]
        return out


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, definition_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_col``, ``n_pre_tokens``, ``n_tokens``, ``log_probability``; no shuffle.

    Pre-tokens are words ``[^\\x20\\x09-\\x0D]+``, each with one blank before it; white space besides isn't counted.  The
    vocabulary must hold every byte.  A null text is an empty one (0 tokens), a null id stays null, repeated rows are
    counted each, other columns are ignored, an empty table gives an empty result.  The driver reads the vocabulary
    and sends it to the workers; its size doesn't grow with the data.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(definition_path, "rb") as f:
        content = f.read()
    key, definition = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters[key] = Counter(zipf_scores(definition.value))
        counter = _counters[key]
        for batch in batches:
            texts = as_bytes(batch.column(1))
            rows = [r for a in range(0, len(texts), 256) for r in counter.count(texts[a : a + 256])]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=[id_col, "n_pre_tokens", "n_tokens", "log_probability"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidied(run), f"`{id_col}` {id_type}, n_pre_tokens bigint, n_tokens bigint, log_probability double")
