"""Binary classifiers with conditional blocks, and the refinement of a fitted one by structure that it lacks."""

from __future__ import annotations

from dataclasses import replace
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..keys import hashed_fold
from ..operators import quantiles, rank, refine, solve, stats
from ..plans.program import Feature, Program
from ..plans.rewrite import compacted, optimised
from ..schema import ParameterError, ValidationError, quoted
from .base import Adapter
from .classify import StateClassifier, program_of, ranked_structure

#: Kinds of block rankings.
BLOCKS = ("none", "full", "stable", "hybrid")


def block_columns(hessian: np.ndarray, shrink: float) -> tuple[list[float], list[float]]:
    """Centres and scales of a block's columns from the Hessian of each target state inside the gate (last state left out)."""
    total = hessian.sum()
    share = hessian / total if total else hessian
    spread = total * share * (1 - share)  # 0: a state that no row of the gate has, or all: its column stays 0
    return share[:-1].tolist(), np.sqrt(np.divide(spread, spread + shrink, out=np.zeros(len(spread)), where=spread > 0))[:-1].tolist()


def ranked_blocks(states: DataFrame, adapter: Adapter, features: list[str], target: str, probability, key: str, kind: str, most: int, near_ties: list | None = None) -> list[tuple[str, int, str]]:
    """The best conditional blocks (gate, gate state, target feature) among some features, on a score's residuals.

    "full" ranks by the gain on all rows, "stable" by what holds in both halves of the key, "hybrid" takes them in turn.
    One pass over the rows gives the cells of both.
    """
    f = adapter.by_name()
    name = {f[n].state_column: n for n in features}
    columns = list(name)
    weight = F.col(quoted(adapter.weight)).cast("double") if adapter.weight else None
    w = weight if weight is not None else F.lit(1.0)
    data = states.withColumn("half", hashed_fold(F.col(quoted(key)), 2, 23)).withColumn("__pb", probability)
    directed = [(a, b) for a in columns for b in columns if a != b]
    if not directed or most < 1:
        return []
    cells = stats.tuple_cells(data, directed, ["half"], sums={"g": w * (F.col(target) - F.col("__pb")), "h": w * F.col("__pb") * (1 - F.col("__pb"))}, weight=weight).persist()
    try:
        n = data.agg(F.sum(w)).first()[0]
        size = max(x.cardinality for x in adapter.features)
        full, stable, near = rank.full_and_stable(cells, columns, int(n), size, most)
        if near_ties is not None:
            near_ties.append(near)
        pick = lambda d: [(name[r["f0"]], r["gate_state"], name[r["f1"]]) for r in d.orderBy("rank").collect()]
        one, two = pick(full), pick(stable)
    finally:
        cells.unpersist()
    if kind == "full":
        return one
    if kind == "stable":
        return two
    return in_turn(one, two)[:most]


def in_turn(one: list, two: list) -> list:
    """Items of two rankings in turn, each once; when the shorter one has ended, the rest of the longer."""
    return list(dict.fromkeys(x for pair in zip_longest(one, two) for x in pair if x is not None))


class BlockClassifier(StateClassifier):
    """A binary classifier of main effects, pairs and conditional blocks.

    A block is one state of a gate feature and the centred effects of another feature's states inside it.  Blocks are
    ranked on the residuals of the best design without them.  Numbers of blocks are compared on held-out keys
    (``selection="holdout"``: on half of these; the other half has to confirm a gain of ``least_gain`` on no blocks) or
    by the mean loss over three folds (``"crossfit"``).  Of candidates within ``near_tie`` the one with the fewest bytes
    is taken.
    """

    @classmethod
    def defaults(cls) -> dict:
        return super().defaults() | {"blocks": "hybrid", "max_blocks": 8, "selection": "holdout", "least_gain": 0.0015, "shrink": 10.0}

    def fit(self, df: DataFrame, features: list[str], target: str, key: str) -> BlockClassifier:
        if self.blocks not in BLOCKS or self.selection not in ("holdout", "crossfit"):
            raise ParameterError(f"blocks {self.blocks!r}, selection {self.selection!r}")
        if df.select(target).distinct().limit(3).count() > 2:
            raise ValidationError("two classes are needed")
        return super().fit(df, features, target, key)

    def _head(self, data: DataFrame, target: str, adapter: Adapter) -> Program:
        states = adapter.fit(data, self.columns_, self.key_, target)
        part = F.pmod(F.xxhash64(F.lit(self.seed), F.col(quoted(self.key_))), F.lit(10_000))
        held = F.when(part < int(self.holdout * 5_000), 1).when(part < int(self.holdout * 10_000), 2).otherwise(0)
        states = states.withColumn("__held", held if self.selection == "holdout" else hashed_fold(F.col(quoted(self.key_)), 3, self.seed)).persist()
        try:
            mains, pairs = ranked_structure(states, adapter, target, self.max_features, self.pair_features, self.max_pairs, self.pair_ranking, self.key_)
            f = adapter.by_name()
            named = {x.name: F.col(x.state_column) for x in adapter.features}
            near = mains[: self.pair_features]
            wide = self._design(adapter, mains, pairs)
            rows = solve.Rows(states, list(dict.fromkeys([*wide.columns, *(f[n].state_column for n in near)])), [target], self.weight, extra=["__held"])
            train = rows.part("__held", 0) if self.selection == "holdout" else rows

            # the best design without blocks, and the blocks that its residuals call for
            structures = self._structures(mains, pairs)
            losses, fits = self._losses(rows, [self._design(adapter, m, p) for m, p in structures], target)
            i, c = min(losses, key=lambda t: (losses[t], len(structures[t[0]][0]), len(structures[t[0]][1]), t[1]))
            m, p = structures[i]
            base = self._design(adapter, m, p)
            backbone = program_of(adapter, m, p, fits[i, c] if self.selection == "holdout" else solve.logistic_l2(train, base, target, c), base, "logit")
            self.near_ties_: list = []
            seen = states.where("__held = 0") if self.selection == "holdout" else states
            blocks = ranked_blocks(seen, adapter, near, target, fn.sigmoid(backbone.score(named)), self.key_, self.blocks, self.max_blocks, self.near_ties_) if self.blocks != "none" else []
            columns = self._columns(seen, adapter, blocks, fn.sigmoid(backbone.score(named)))

            numbers = sorted({0, *[k for k in (2, 4, 8, 16) if k < len(blocks)], len(blocks)})
            designs = [replace(base, blocks=columns[:k]) for k in numbers]
            losses, fits = self._losses(rows, designs, target)
            bytes_ = {(i, c): program_of(adapter, m, p, w, designs[i], "logit", blocks=blocks[: numbers[i]]).size_bytes() for (i, c), w in fits.items()}
            compared = [(losses[t], bytes_[t], numbers[t[0]], t[1]) for t in losses]
            best = min(t[0] for t in compared)
            loss, size, k, c = min((t for t in compared if t[0] <= best + self.near_tie), key=lambda t: (t[1], t[0]))
            none = min((t for t in compared if t[2] == 0), key=lambda t: t[0])
            if k:
                i = numbers.index(k)
                confirmed = self._confirmed(rows, (designs[i], fits[i, c]), (designs[0], fits[0, none[3]]), target) if self.selection == "holdout" else none[0] - loss
                if confirmed < (self.least_gain if self.selection == "holdout" else 0.001):
                    loss, size, k, c = none
            i = numbers.index(k)
            w = solve.logistic_l2(rows, designs[i], target, c, start=fits[i, c])
            self.diagnostics_.append({"held_out_loss": loss, "best_loss": best, "bytes": size, "mains": m, "pairs": p, "blocks": blocks[:k], "c": c, "candidates": len(compared)})
            return compacted(optimised(program_of(adapter, m, p, w, designs[i], "logit", blocks=blocks[:k])))
        finally:
            states.unpersist()

    def _columns(self, states: DataFrame, adapter: Adapter, blocks: list[tuple[str, int, str]], probability) -> list[tuple[str, int, str, list[float], list[float]]]:
        """The design's columns of each block; the Hessians inside all gates come from one pass."""
        if not blocks:
            return []
        f = adapter.by_name()
        w = F.col(quoted(adapter.weight)).cast("double") if adapter.weight else F.lit(1.0)
        entries = F.array(*[F.when(F.col(f[g].state_column) == s, F.struct(F.lit(i).alias("i"), F.col(f[t].state_column).alias("s"))) for i, (g, s, t) in enumerate(blocks)])
        inside = states.select((w * probability * (1 - probability)).alias("h"), F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        hessian = [np.zeros(f[t].cardinality) for *_, t in blocks]
        for r in inside.groupBy("e.i", "e.s").agg(F.sum("h").alias("h")).collect():
            hessian[r["i"]][r["s"]] = r["h"]
        return [(f[g].state_column, s, f[t].state_column, *block_columns(h, self.shrink)) for (g, s, t), h in zip(blocks, hessian, strict=True)]

    def _losses(self, rows: solve.Rows, designs: list[solve.Design], target: str) -> tuple[dict[tuple[int, float], float], dict[tuple[int, float], np.ndarray]]:
        """Loss of each design (by index) at each penalty, on the first half of the held-out keys or as the mean of three folds, and a fit of each.

        All designs, folds and penalties share their passes over the rows.
        """
        if self.selection == "holdout":
            fits = solve.logistic_path(rows, designs, target, self._penalties, ("__held", 0, False))
            found = solve.mean_losses(rows, [(designs[i], w) for (i, _), w in fits.items()], target, solve.logistic, [("__held", 1, False)] * len(fits))
            return dict(zip(fits, map(float, found), strict=True)), fits
        start: list = [None] * (3 * len(designs))
        out: dict = {}
        fits = {}
        for c in sorted(set(self._penalties)):
            start = solve.newton_many(rows, [solve.Problem(d, 1.0 / c, True, start[3 * i + k], ("__held", k, True)) for i, d in enumerate(designs) for k in range(3)], target, solve.logistic)
            each = solve.mean_losses(rows, [(d, start[3 * i + k]) for i, d in enumerate(designs) for k in range(3)], target, solve.logistic, [("__held", k, False) for _ in designs for k in range(3)])
            for i in range(len(designs)):
                out[i, c], fits[i, c] = float(np.mean(each[3 * i : 3 * i + 3])), start[3 * i]
        return out, fits

    def _confirmed(self, rows: solve.Rows, one: tuple[solve.Design, np.ndarray], other: tuple[solve.Design, np.ndarray], target: str) -> float:
        """By how much one fit beats another on the second half of the held-out keys."""
        mine, theirs = solve.mean_losses(rows, [one, other], target, solve.logistic, [("__held", 2, False)] * 2)
        return float(theirs - mine)


class Refinement:
    """What a fitted binary program lacks on numeric columns: finer states of single features and a triple.

    Candidates come from the residuals on half of the keys; they are frozen and accepted only if a lower confidence bound
    (Bernstein) of the mean gain in log loss on the other half is above 0.
    """

    def __init__(self, columns: list[str], coarse: int = 4, fine: int = 16, alpha: float = 0.001, budget: int = 2, l2: float = 20.0, rate: float = 0.5, max_gain: float = 4.0, triad_features: int = 8, seed: int = 29):
        self.columns, self.coarse, self.fine, self.alpha, self.budget, self.l2, self.rate, self.max_gain, self.triad_features, self.seed = columns, coarse, fine, alpha, budget, l2, rate, max_gain, triad_features, seed

    def fit(self, df: DataFrame, program: Program, target: str, key: str) -> Refinement:
        """``program_`` is the refined program (the given one if nothing is accepted), ``accepted_`` whether it is."""
        y = F.col(quoted(target)).cast("double")
        half = hashed_fold(F.col(quoted(key)), 2, self.seed)
        middle = {c: q[0] for c, q in quantiles.exact_quantiles(df, self.columns, [0.5]).items() if q}
        cuts = quantiles.nested_thresholds(df.where(half == 0), list(middle), (self.coarse, self.fine), digits=9)
        full = [c for c in middle if len(cuts[c][self.fine]) == self.fine - 1 and len(cuts[c][self.coarse]) == self.coarse - 1]
        # shadow encoding: coarse states are read off the fine ones, so both nest exactly
        features = {(c, b): Feature(f"{'fine' if b == self.fine else 'coarse'}:{c}", "numeric", c, b, middle[c], cuts[c][self.fine] if b == self.fine else cuts[c][self.fine][self.fine // self.coarse - 1 :: self.fine // self.coarse]) for c in full for b in (self.coarse, self.fine)}
        data = df.select("*", program.score().alias("__z"), half.alias("__half"), *[f.expression().alias(f.state_column) for f in features.values()]).withColumn("__p", fn.sigmoid(F.col("__z"))).persist()
        try:
            self.violations_ = {r["fine"]: r["violations"] for r in refine.nested_violations(data, [(features[c, self.fine].state_column, features[c, self.coarse].state_column, self.fine // self.coarse) for c in full]).collect()} if full else {}
            train = data.where("__half = 0")
            g, h = F.col("__p") - y, F.col("__p") * (1 - F.col("__p"))
            bases = refine.resolution_candidates(train, [(features[c, self.fine].state_column, self.fine) for c in full], self.coarse, g, h, self.alpha)
            triad = refine.best_triad(train, [features[c, self.coarse].state_column for c in full][: self.triad_features], g, h, self.coarse, self.alpha)
            bases += [triad] if triad is not None else []
            model = refine.JointModel.of(train, bases, h)
            model = model.part(model.select(self.budget, self.alpha))
            picked, tables = model.bases, model.tables(self.l2, self.rate)
            self.bases_, self.accepted_, self.program_, self.lower_ = [b.name for b in picked], False, program, None
            if not picked:
                return self
            by_column = {f.state_column: f for f in features.values()}
            used = [by_column[c] for b in picked for c in b.columns]
            merged = replace(program, features=program.features | {f.name: f for f in used})
            for b, table in zip(picked, tables, strict=True):
                names = [by_column[c].name for c in b.columns]
                merged = replace(merged, unary=[*merged.unary, (names[0], table.tolist())]) if len(names) == 1 else replace(merged, cubes=[*merged.cubes, (*names, table.tolist())])
            loss = lambda z: fn.softplus(z) - y * z
            named = {n: (F.col(f.state_column) if f.state_column in by_column and n not in program.features else f.expression()) for n, f in merged.features.items()}
            gain = F.greatest(F.least(loss(F.col("__z")) - loss(merged.score(named)), F.lit(self.max_gain)), F.lit(-self.max_gain))
            row = stats.bernstein_bound(data.where("__half = 1"), gain, self.max_gain).first()
            self.gain_, self.lower_ = row["mean"], row["lower"]
            self.accepted_ = row["lower"] is not None and row["lower"] > 0
            self.program_ = merged if self.accepted_ else program
            return self
        finally:
            data.unpersist()


__all__ = ["BLOCKS", "BlockClassifier", "Refinement", "block_columns", "ranked_blocks"]
