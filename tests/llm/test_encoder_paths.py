"""Chunks that the encoder of ``op1`` cuts without its pattern, and ``op8``'s expected counts against all paths of states."""

import itertools

import numpy as np
import public_tokenizers
import pytest

from stateweave.llm import bpe, hmm


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return bpe.Codec(f.read())


def test_plain_words_need_no_pattern(codec):
    parts = ["word", "words,", "Straße", "déjà.", "x'", "can't", "a1", "1a", "12,", "ǅ", "naïve;", "ªº", "x²", "²", ",", "a,b", "a,,", "", "é́", "中文", "a\x7f", "a\n", "ab…", "µ!"]
    want = [codec._run(" " + p) for p in parts]
    codec.forget()
    assert [codec._after_space(p) for p in parts] == want
    asked, codec.split = [], type("Pattern", (), {"findall": lambda self, x, f=codec.split.findall: asked.append(x) or f(x)})()
    codec.forget()
    assert [codec._after_space(p) for p in parts] == want
    assert not {" word", " words,", " Straße", " déjà.", " x'"} & set(asked)


def test_words_of_a_large_vocabulary_are_encoded_once(codec):
    codec.forget()
    cache, asked = codec.after_space, []
    compute, cache.compute = cache.compute, lambda part: asked.append(part) or b""
    text = " " + " ".join(f"w{i}" for i in range(200_000))
    codec.encode(text + text)
    assert len(asked) == 200_000
    codec.encode(2 * (" " + "x" * (bpe.WORD_LENGTH + 1)))
    assert len(asked) == 200_002 and max(map(len, cache)) <= bpe.WORD_LENGTH
    cache.compute = compute
    codec.forget()


def test_expected_counts_against_all_paths():
    rng = np.random.default_rng(2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    seqs = [[0], [2, 1, 0, 2], [1, 1], [0, 2, 2]]
    first, move, emit, logs = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), []
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        p = np.array([m.first[z[0]] * np.prod([m.move[x] for x in itertools.pairwise(z)]) * np.prod([m.emit[x, c] for x, c in zip(z, s, strict=True)]) for z in paths])
        logs.append(np.log10(p.sum()))
        for z, q in zip(paths, p / p.sum(), strict=True):
            first[z[0]] += q
            for x in itertools.pairwise(z):
                move[x] += q
            for x, c in zip(z, s, strict=True):
                emit[x, c] += q
    classes, lengths = np.array(sum(seqs, []), np.uint16), np.array([len(s) for s in seqs])
    got = hmm.expected_counts(m, classes, lengths)
    assert np.allclose(got.first, first) and np.allclose(got.move, move) and np.allclose(got.emit, emit)
    assert np.allclose(hmm.log10_likelihood(m, classes, lengths), logs)
    empty = hmm.expected_counts(m, classes[:0], lengths[:0])
    assert not empty.first.any() and not empty.move.any() and not empty.emit.any()
