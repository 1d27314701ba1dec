"""The similarity join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.llm import token_groups as tg
from stateweave.llm import wanted

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and linked(sets[i], sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(best.get(root(i), k), k)
    return sorted(((k, len(s), best.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(rnd, words, share):
    out = list(words)
    for i in rnd.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"e{rnd.randrange(10**6)}"
    return out


def made(seed):
    """Families at, above and below the threshold, chains, shared passages, short texts, nulls, repeats."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = [[word() for _ in range(rnd.choice([1, 2, 3, 5, 8, 20, 60, 200]))] for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([12, 40, 120, 400]))]
        texts += [base, *(edited(rnd, base, rnd.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(14))]
    chain = [word() for _ in range(150)]
    for _ in range(25):
        chain = edited(rnd, chain, 0.012)
        texts.append(chain)
    passage = [word() for _ in range(70)]
    texts += [[word() for _ in range(rnd.randint(0, 30))] + passage + [word() for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[i][1].upper()) for i in range(10)] + [(5, rows[70][1]), (2000, None), (2001, ""), (2002, " \t"), (None, rows[3][1]), (None, "only here once"), (None, None)] + rows[:3]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, sets, tokens, levels", [(1, 64, 1 << 16, 4), (2, 4, 600, 2), (3, 2, 100, 0), (4, 8, 1000, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, sets, tokens, levels):
    """Also where groups are so small, and levels so few, that most is left to the matrix."""
    for name, value in (("GROUP_SETS", sets), ("GROUP_TOKENS", tokens), ("LEVELS", levels)):
        monkeypatch.setattr(tg, name, value)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("row", F.lit("x")).withColumn("n", F.lit(1)).withColumn("node", F.lit(2))
    out = tg.similar_sets(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_texts_dealt_instead_of_filtered(spark, monkeypatch):
    monkeypatch.setattr(wanted, "FILTER_BITS", 16)
    rows = made(5)
    assert sorted(map(tuple, tg.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_empty_table_and_a_very_long_text(spark):
    assert tg.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0
    rnd = random.Random(1)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:290_000])), (3, " ".join(long[:200_000])), (4, "w1 w2")]
    got = {r.doc_id: r.component_id for r in tg.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("percent", [75, 85, 95])
def test_linked_sets_have_a_key_in_common(percent):
    """Whatever the sizes: pairs made to link just so."""
    rng = np.random.default_rng(percent)
    pairs = 0
    for n in [*range(1, 60), *range(60, 400, 7), 1000, 5000]:
        for extra in {0, int(n * (100 - percent) / percent)}:
            a = rng.integers(0, 2**64, n, np.uint64)
            new = rng.integers(0, 2**64, extra, np.uint64)
            swap = max(0, (2 * n + extra) * (100 - percent) // (100 + percent) - extra) // 2
            b = np.concatenate([a[swap:], rng.integers(0, 2**64, swap, np.uint64), new])
            common = n - swap
            if not (swap or extra) or 100 * common < percent * (len(a) + len(b) - common):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            owner, key, *_ = tg.signatures(doc, np.concatenate([np.sort(a), np.sort(b)]), 2, percent)
            assert set(key[owner == 0]) & set(key[owner == 1])
            pairs += 1
    assert pairs > 80


@pytest.mark.parametrize("percent", [75, 85, 95])
def test_linked_sets_share_as_many_keys_as_a_link_takes(percent):
    """At the threshold, whatever the sizes; and larger sets that link need more than one key."""
    rng = np.random.default_rng(percent)
    pairs, most = 0, 0
    for n in [*range(1, 60), *range(60, 400, 7), 1000, 5000]:
        for extra in {0, int(n * (100 - percent) / percent / 2), int(n * (100 - percent) / percent)}:
            swap = max(0, (2 * n + extra) * (100 - percent) // (100 + percent) - extra) // 2
            a = rng.integers(0, 2**64, n, np.uint64)
            b = np.concatenate([a[swap:], rng.integers(0, 2**64, swap + extra, np.uint64)])
            if not (swap or extra) or 100 * (n - swap) < percent * (n + swap + extra):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            owner, key, least = tg.signatures(doc, np.concatenate([np.sort(a), np.sort(b)]), 2, percent)
            assert len(set(key[owner == 0]) & set(key[owner == 1])) >= least.max() >= 1
            pairs, most = pairs + 1, max(most, least.max())
    assert pairs > 80 and most > 5


def test_sets_with_few_parts_in_common_are_left_out(spark, monkeypatch):
    """A passage that texts share, but too little for a link, brings none of them into the groups."""
    seen = []
    monkeypatch.setattr(tg, "_sets", lambda *a, f=tg._sets: seen.append(a[-1].count()) or f(*a))
    rnd = random.Random(2)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    twin = words(300)
    texts = [words(170) + passage + words(170) for _ in range(100)] + [twin, edited(rnd, twin, 0.01)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sorted(map(tuple, tg.similar_sets(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert 2 <= seen[0] < 10
