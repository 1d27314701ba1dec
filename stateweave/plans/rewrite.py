"""Exact rewrites of programs: the same scores from fewer and smaller tables.

Catalyst can't look into arrays, so these passes run on the program before any Column exists: a feature's tables are
summed, pairs get one orientation and are summed, their rows and columns that a single table can hold move there,
constants move to the intercept, tables of zeros and features without tables go (then their raw columns aren't read).
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from .program import Program, slot_bytes

ZERO = 1e-12


def optimised(program: Program) -> Program:
    program = program.dense()
    order = {f: i for i, f in enumerate(program.features)}
    card = {f: x.cardinality for f, x in program.features.items()}
    single = {f: np.zeros(card[f]) for f in program.features}
    for f, t in program.unary:
        single[f] += _padded(t, card[f])
    joint: dict[tuple[str, str], np.ndarray] = {}
    for a, b, t in program.pairs:
        m = np.zeros((card[a], card[b]))
        m[: len(t), : len(t[0])] = t
        if order[a] > order[b]:
            a, b, m = b, a, m.T
        joint[a, b] = joint.get((a, b), 0) + m
    intercept = program.intercept
    pairs = []
    for (a, b), m in sorted(joint.items(), key=lambda x: (order[x[0][0]], order[x[0][1]])):
        if a == b:
            single[a] += np.diag(m)
            continue
        intercept += m[0, 0]
        single[a] += m[:, 0] - m[0, 0]
        single[b] += m[0] - m[0, 0]
        rest = m - m[:, :1] - m[:1] + m[0, 0]
        if np.abs(rest).max() > ZERO:
            pairs.append((a, b, rest.tolist()))
    unary = []
    for f, t in single.items():
        intercept += t[0]
        t = t - t[0]
        if np.abs(t).max(initial=0) > ZERO:
            unary.append((f, t.tolist()))
    used = {f for f, _ in unary} | {f for a, b, _ in pairs for f in (a, b)} | {f for *c, _ in program.cubes for f in c}
    linear = [x for x in program.linear if abs(x[4]) > 0]
    return replace(program, intercept=float(intercept), unary=unary, pairs=pairs, linear=linear, features={f: x for f, x in program.features.items() if f in used})


def compacted(program: Program) -> Program:
    """The same scores from tables of pairs whose equal rows are stored once, where that takes fewer bytes.

    A table is read by rows of its first feature or of its second, whichever is smaller; ties go to the first.  A block
    (one state of a gate, or none, in which another feature counts) keeps two rows.  Entries stay as they are; only the
    order in which a score's terms are added changes.
    """
    cell = 8 if program.bits is None else program.bits // 8
    pairs, sparse = [], []
    for a, b, table in program.dense().pairs:
        best, size = None, cell * len(table) * len(table[0])
        for first, second, rows in ((a, b, table), (b, a, list(zip(*table, strict=True)))):
            distinct = list(dict.fromkeys(map(tuple, rows)))
            taken = cell * len(distinct) * len(rows[0]) + slot_bytes(distinct) * len(rows)
            if taken < size:
                at = {r: i for i, r in enumerate(distinct)}
                best, size = (first, second, [at[tuple(r)] for r in rows], list(map(list, distinct))), taken
        (sparse if best else pairs).append(best or (a, b, table))
    return replace(program, pairs=pairs, sparse=sparse)


def _padded(t: list[float], n: int) -> np.ndarray:
    out = np.zeros(n)
    out[: len(t)] = t[:n]
    return out
