"""The conversation trie against one built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stateweave.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def order(role, text):
    return [int.from_bytes(hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[i : i + 8], "big", signed=True) for i in (0, 8)]


def brute(rows, rebuild=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0, *order(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = (own.get(c - c % 5, [])[:h] + ts[h:]) if rebuild else ts
    nodes = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(1 for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(path))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids(path), sum(kids(p) == 0 for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, convs, hot):
    rnd, rows = random.Random(seed), []
    for c in convs:
        for i in range(rnd.randint(1, 12)):
            text = f"opening {i}" if hot and rnd.random() < 0.8 else rnd.choice(["", None, "é", f"text {i}", f"own {c} {i}"])
            rows.append((c, rnd.choice([None, i, i, i, 3]), rnd.choice(["user", "assistant", None, ""]) if rnd.random() < 0.2 else "user", text))
    return rows + rows[:4] + [(None, 1, "user", "nobody's"), (None, None, None, None)]


def result(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed, hot, block, parents, ends", [(1, False, 1024, 1000, 1 << 20), (2, True, 3, 4, 16), (3, True, 1, 10**9, 8)])
def test_against_brute_force(spark, monkeypatch, seed, hot, block, parents, ends):
    """Nulls, ties, repeated rows, absent openings, turnless conversations, hot openings, blocks and pieces of ends."""
    for name, value in (("BLOCK_TURNS", block), ("HOT_PARENTS", parents), ("ENDS_BYTES", ends)):
        monkeypatch.setattr(ct, name, value)
    rows = made(seed, [*range(0, 60, 2), *range(61, 95), -7, 10**15], hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("depth", F.lit("x")).withColumn("conv", F.lit(1)).withColumn("p", F.lit(2))
    conv = F.col("conv")
    rows = [r for r in rows if r[0] != -7]  # SQL's remainder of a negative number differs from Python's
    assert result(ct.conversation_trie(df.where("conv_id <> -7 OR conv_id IS NULL"), base=conv - conv % 5, opening=F.crc32(conv.cast("string")) % 9, most=8)) == brute(rows)
    assert result(ct.conversation_trie(df.where("conv_id <> -7 OR conv_id IS NULL"))) == brute(rows, rebuild=False)


def test_copies_long_conversations_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK_TURNS", 16)
    rows = [(c, i, "user", f"t{i}") for c in range(150) for i in range(3)] + [(900 + c, i, "user", f"t{i}" * (i % 5)) for c in range(2) for i in range(150)]
    rows.append((2000, 0, "user", "word " * 1_000_000))
    assert result(ct.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, rebuild=False)
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ct.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
