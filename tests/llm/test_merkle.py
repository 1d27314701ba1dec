"""The Merkle manifest against a tree built row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stateweave.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes):
    """The top, and for each node its siblings and on which side they are."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(level):
                paths[i].append((level[k ^ 1], k & 1))
            else:
                paths[i].append((None, 0))
        level = [H(*level[j : j + 2]) for j in range(0, len(level), 2)]
        at = [k >> 1 for k in at]
    return level[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = [sorted(((r, leaf(r)) for r in rows if r[2] == x), key=lambda y: (y[0][0] is not None, y[0][0] or 0, y[1])) for x in langs]
    tops = [tree([y[1] for y in part]) for part in parts]
    root, above = tree([t[0] for t in tops]) if tops else (None, [])
    out = []
    for part, (subroot, paths), more in zip(parts, tops, above, strict=True):
        for (r, own), path in zip(part, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4])) if bad else own
            for other, right in path + more:
                node = H(*([other, node] if right else [node, other] if other else [node]))
            out.append((r[0], own, subroot, root, H(*[o for o, _ in path + more if o]), node, node == root))
    return sorted(out, key=str)


def made(n, langs, seed=1):
    rnd = random.Random(seed)
    rows = [(i * 3 % (n + 7), rnd.choice(["a", "b", None]), rnd.choice(langs), rnd.choice([None, 5, 17]), rnd.choice(["", None, "é 1:x", "text " * 3, str(i)])) for i in range(n)]
    return rows + rows[:3] + [(None, None, langs[0], None, None), (None, "x", langs[0], 4, "t"), (0, "s", langs[0], 1, "first"), (0, "s", langs[0], 1, "second")]


@pytest.mark.parametrize("n, langs, span", [(40, ["en", None, "de", ""], 10), (75, ["en"], 2), (90, ["en", "en", "en", "fr", "ü", "z", None, "k"], 1), (33, ["b", "a"], 3)])
def test_against_brute_force(spark, monkeypatch, n, langs, span):
    """Nulls, repeats, ties, odd runs, one language and many; spans so small that trees take several persisted levels."""
    monkeypatch.setattr(merkle, "SPAN", span)
    rows = made(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("leaf", F.lit(1)).withColumn("place", F.lit("x")).withColumn("__n0", F.lit(2))
    out = merkle.manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, when=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_single_row_empty_table_and_long_text(spark):
    one = [(7, None, "en", None, "word " * 2_000_000)]
    got = merkle.manifest(spark.createDataFrame(one, SCHEMA)).collect()[0]
    assert (got.leaf, got.subroot, got.root, got.proof_sha256, got.verified) == (leaf(one[0]), leaf(one[0]), leaf(one[0]), H(), True)
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_changing_any_byte_is_seen(spark):
    rows = made(30, ["en", "de"])
    changed = [(*r[:4], (r[4] or "") + "!") if i == 11 else r for i, r in enumerate(rows)]
    roots = {merkle.manifest(spark.createDataFrame(x, SCHEMA)).first().root for x in (rows, changed)}
    assert len(roots) == 2
