"""Byte-pair encoding by backtracking, and decoding by an offset table.

A text is cut into pre-tokens.  In each, an Aho-Corasick automaton over all token strings finds the longest token at
every place in one pass.  The encoder takes the longest token, checks it against its left neighbour in the
pair-compatibility table and, where the two would not stand side by side after the merges, falls back to the next
shorter token or drops the left neighbour.  A prefix has one valid encoding at most, so a place that failed once is
never tried again and the work is linear in the text.  The result equals applying the merges in order.

Decoding copies byte ranges out of one array that holds all tokens, found by each token's offset.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import bound_batches, tidied

#: Entries that a worker's caches of words, of pairs of tokens, of pre-tokens and of tokens' edges hold at most; a full cache starts
#: anew (results don't depend on it).
WORDS, CACHE_ENTRIES, PRE_TOKENS, EDGES = 400_000, 150_000, 80_000, 20_000

#: How a byte-level vocabulary writes bytes as printable characters, and how it splits texts.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that Unicode has got after version 16 (or hasn't assigned), which count as neither.
LATER_LETTERS = (
    "558, 58B-58C, 88F, C5C, CDC, 208F, 209D-209F, A7CE-A7CF, A7D2, A7D4, A7DD, A7E2, A7F1, AB6C-AB6D, 107BB-107BF, 10940-10959, "
    "10EC5-10EC7, 10ED9-10EEE, 11B0A, 11DB0-11DDB, 11DF1, 16EA0-16EB8, 16EBB-16ED3, 16FF2-16FF3, 187F8-187FF, 18CD6-18CDA, "
    "18D09-18D20, 18D80-18DF2, 18E00-19191, 191A0-191D2, 1B123-1B128, 1B168, 1D6A6, 1DF1F-1DF24, 1DF2B-1DF81, 1DF90-1DF96, "
    "1DFCD-1DFFF, 1E6C0-1E6DE, 1E6E0-1E6E2, 1E6E4-1E6E5, 1E6E7-1E6ED, 1E6F0-1E6F4, 1E6FE-1E6FF, 2B73A-2B73F, 2B81E, 2CEA2-2CEAD, 323B0-33479, 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9, 1246F, 12475-1247F, 12550-12686, 16FF4-16FF6"
#: Longest chunk of text that a worker's caches keep, and longest word (longer ones hardly come twice).
CACHE_LENGTH, WORD_LENGTH = 256, 64


def later_class(ranges: str = f"{LATER_LETTERS}, {LATER_NUMBERS}") -> str:
    """A class of characters (regex syntax) from a list of hexadecimal ranges."""
    return "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in ranges.split(", ")) + "]"


def split_pattern(later_letters: str = LATER_LETTERS, later_numbers: str = LATER_NUMBERS) -> str:
    """``SPLIT`` with letters and numbers as they were before the later ones (regex syntax, version 1)."""
    letters, numbers = later_class(later_letters), later_class(later_numbers)
    old = {"L": rf"[\p{{L}}--{letters}]", "N": rf"[\p{{N}}--{numbers}]"}
    other = rf"[[^\s\p{{L}}\p{{N}}]||{letters}||{numbers}]"
    return "(?V1)" + SPLIT.replace(r"[^\s\p{L}\p{N}]", other, 1).replace(r"?\p{L}+", f"?{old['L']}+").replace(r"?\p{N}+", f"?{old['N']}+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return [chr(b) if b in set(PRINTABLE) else chr(256 + others.index(b)) for b in range(256)]


class _Cache(dict):
    """A dictionary that computes what it lacks and starts anew when it is full; long texts aren't kept."""

    def __init__(self, compute, limit: int = CACHE_ENTRIES, longest: int = CACHE_LENGTH):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > self.longest:
            return self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.compute(key)
        return value


class Codec:
    """Encoder and decoder for the content of a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE definition without a normalizer is needed")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("only splitting by the pattern, without a prefix space, is supported")
        letters = byte_letters()
        self.letters = dict(zip(range(256), letters, strict=True))
        value_of = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.length = [0] * size
        raw = [b""] * size
        for piece, i in vocab.items():
            self.length[i] = len(piece)
            raw[i] = bytes(value_of[c] for c in piece)
        for piece, i in special.items():
            raw[i] = piece.encode()
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.offset = np.cumsum([0, *map(len, raw)])
        self.special = special
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        self.vocab = vocab
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocab.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ids = (vocab[a], vocab[b])
            whole = vocab[a + b]
            self.merge[ids] = (rank, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = ids, rank
        self.split, self.split_any = regex.compile(SPLIT), regex.compile(split_pattern())
        self.later = regex.compile(later_class())
        self.shorter = _Cache(self._shorter)
        self.compatible = _Cache(self._compatible)
        self.pre_token = _Cache(self._pre_token, PRE_TOKENS)
        self.left_edge, self.right_edge = (_Cache(lambda token, side=side: self._edge(token, side), EDGES) for side in (0, 1))
        self.after_space = _Cache(self._after_space, WORDS, WORD_LENGTH)
        self.at_start = _Cache(self._run, 20_000)

    # the two tables -----------------------------------------------------------------------------------------------

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        piece = self.piece(token)
        for end in range(len(piece) - 1, 0, -1):
            if (i := self.vocab.get(piece[:end])) is not None:
                return i
        return -1

    def piece(self, token: int) -> str:
        return "".join(map(self.letters.__getitem__, self.bytes[self.offset[token] : self.offset[token + 1]].tolist()))

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of ``token`` while its merges happen, each with the rank that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out
            ends = self.rank[token]
            token = self.parts[token][side]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two.

        It fails if some merge across the seam comes up while both of its parts stand at the seam.  Of equal merges
        the left one goes first: inside the left token before the seam, at the seam before the right token.
        """
        right = self.left_edge[pair[1]]
        for a, a_ends in self.right_edge[pair[0]]:
            for b, b_ends in right:
                found = self.merge.get((a, b))
                if found and found[0] < a_ends and found[0] <= b_ends:
                    return False
        return True

    # encoding -----------------------------------------------------------------------------------------------------

    def _pre_token(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            s = word.replace(" ", self.letters[0x20])  # other printable ASCII stands for itself
        else:
            s = "".join(map(self.letters.__getitem__, word.encode()))
        whole = self.vocab.get(s)
        if whole is not None:
            return whole.to_bytes(4, "little")
        n, length, compatible, shorter = len(s), self.length, self.compatible, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(s):
            longest[end - length[token] + 1] = token  # of tokens with one start, the longest comes last
        if min(longest) < 0:
            raise ValueError("the vocabulary lacks a byte")
        out: list[int] = []
        open_ = [True] * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0 and not (open_[at + length[token]] and (not out or compatible[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = False
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return pack(f"<{len(out)}I", *out)

    def _run(self, chunk: str) -> bytes:
        return b"".join(map(self.pre_token.__getitem__, self.split.findall(chunk)))

    def _after_space(self, part: str) -> bytes:
        """A blank and what follows it up to the next blank; plain words, which are one pre-token, don't need the pattern."""
        if part.isalpha() and max(part) < "\u0100":
            return self._pre_token(" " + part)
        word, last = part[:-1], part[-1:]
        if word.isalpha() and max(word) < "\u0100" and last.isascii() and last.isprintable() and not last.isalnum():
            return self.after_space[word] + self.pre_token[last]
        return self._run(" " + part)

    #: A blank before other white space: only then do the splits on its two sides depend on each other.
    _TANGLED = re.compile(r" (?:[\s\x1c-\x1f\x85᠎​﻿]|$)")

    def _has_later(self, text: str) -> bool:
        """Whether the common pattern, which is faster, would split the text wrongly."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.later.search(text) is not None
        return False

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self._has_later(text):
            return b"".join(map(self.pre_token.__getitem__, self.split_any.findall(text)))
        if self._TANGLED.search(text):
            return self._run(text)
        head, *rest = text.split(" ")
        return (self.at_start[head] if head else b"") + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Token ids (little-endian unsigned 32-bit) of a whole text; strings of special tokens become those tokens."""
        if self.special_at is None or not self.special_at.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.special_at.split(text)
        return np.frombuffer(b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(start - ends + size, size) + np.arange(total)].tobytes().decode("utf-8", "replace")


    def forget(self) -> None:
        """Empties the caches."""
        for cache in (self.shorter, self.compatible, self.left_edge, self.right_edge, self.pre_token, self.after_space, self.at_start):
            cache.clear()


_codecs: dict[str, Codec] = {}


def codec(definition: bytes) -> Codec:
    """A worker's codec, built once in each process."""
    key = hashlib.sha256(definition).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(definition)
    return _codecs[key]


def encode_documents(docs: DataFrame, definition_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode every whole text; one row for each input row, no shuffle.

    Returns ``id_col``, ``n_tokens`` and, if asked for, ``ids`` (array of int), ``ids_sha256`` and ``decoded_sha256``
    (digests of the ids and of the text that decoding them gives).  A null text is an empty one (0 tokens), a null id
    stays null, repeated rows are encoded each, other columns are ignored.  The driver reads the definition (its size
    is that of the vocabulary, which doesn't grow with the data) and sends it to the workers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(definition_path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition.value)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = {id_col: batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            if digests:
                columns["ids_sha256"] = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        c.forget()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidied(run), schema)
