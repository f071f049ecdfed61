"""Hidden Markov models over sequences: forward, backward, Viterbi and Baum-Welch.

The step from one row to the next is a matrix over states, and the recurrences are products of
such matrices: sums of products for forward and backward, greatest products for Viterbi.  As
products are associative, a sequence is cut into blocks of rows, blocks are reduced to a matrix
each, the few matrices are chained, and each block is then finished on its own from what comes
in at its ends.  So one long sequence spreads over many tasks; no task holds more than a block of
rows, or the matrices of one partition, or one matrix for each partition of a sequence.  Inside a
block the same products are taken pairwise, level by level, over whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import emissions as em
from .distributions import log_poisson
from .mixture import converged
from .special import log_sum_exp


@dataclass(frozen=True)
class PoissonHmm:
    """States with Poisson emissions; `rates` may name one emission for several states."""

    prior: np.ndarray
    transition: np.ndarray
    rates: np.ndarray
    emission_of: tuple[int, ...]

    def log_emissions(self, x: np.ndarray) -> np.ndarray:
        each = np.stack([log_poisson(x, max(r, 1e-9)) for r in self.rates], axis=1)
        return each[:, list(self.emission_of)]

    def forward(self, e: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            t, out = np.log(self.transition), np.empty_like(e)
            out[0] = np.log(self.prior) + e[0]
        for i in range(1, len(e)):
            out[i] = log_sum_exp(out[i - 1][:, None] + t, axis=0) + e[i]
        return out

    def backward(self, e: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            t = np.log(self.transition)
        out = np.zeros_like(e)
        for i in range(len(e) - 2, -1, -1):
            out[i] = log_sum_exp(t + (e[i + 1] + out[i + 1])[None], axis=1)
        return out

    def log_likelihood(self, x: np.ndarray) -> float:
        return float(log_sum_exp(self.forward(self.log_emissions(x))[-1])) if len(x) else 0.0

    def posterior(self, x: np.ndarray) -> np.ndarray:
        e = self.log_emissions(x)
        g = self.forward(e) + self.backward(e)
        return np.exp(g - log_sum_exp(g, axis=1)[:, None])

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e = self.log_emissions(x)
        with np.errstate(divide="ignore"):
            t, best = np.log(self.transition), np.log(self.prior) + e[0]
        back = np.zeros(e.shape, np.int64)
        for i in range(1, len(e)):
            ways = best[:, None] + t
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + e[i]
        out = np.empty(len(e), np.int64)
        out[-1] = best.argmax()
        for i in range(len(e) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def statistics(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood, first memberships, transitions, memberships, weighted values)."""
        e = self.log_emissions(x)
        a, b = self.forward(e), self.backward(e)
        ll = float(log_sum_exp(a[-1]))
        g = np.exp(a + b - ll)
        with np.errstate(divide="ignore"):
            xi = a[:-1, :, None] + np.log(self.transition)[None] + (e[1:] + b[1:])[:, None, :] - ll
        return ll, g[0], np.exp(xi).sum(axis=0), g.sum(axis=0), (g * x[:, None]).sum(axis=0)

    def sample_states(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """States drawn from their joint posterior: forward sums, then draws from the end."""
        a, out = self.forward(self.log_emissions(x)) if len(x) else None, np.empty(len(x), np.int64)
        with np.errstate(divide="ignore"):
            t = np.log(self.transition)
        for i in range(len(x) - 1, -1, -1):
            w = a[i] if i == len(x) - 1 else a[i] + t[:, out[i + 1]]
            p = np.exp(w - w.max())
            out[i] = rng.choice(len(p), p=p / p.sum())
        return out

    def sample(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        s = np.empty(n, np.int64)
        for i in range(n):
            s[i] = rng.choice(len(self.prior), p=self.prior if i == 0 else self.transition[s[i - 1]])
        return s, rng.poisson(self.rates[list(self.emission_of)][s])


@dataclass(frozen=True)
class Hmm:
    """States with emission schemes by dimension, free or shared."""

    prior: np.ndarray
    transition: np.ndarray
    emissions: em.Emissions

    def refitted(self, first: np.ndarray, trans: np.ndarray, rows: list[tuple]) -> Hmm:
        prior = first / first.sum() if first.sum() else self.prior
        sums = trans.sum(axis=1, keepdims=True)
        return Hmm(prior, np.where(sums > 0, trans / np.maximum(sums, 1e-300), self.transition), self.emissions.refitted(rows))


def _general(m: PoissonHmm | Hmm) -> Hmm:
    return m if isinstance(m, Hmm) else Hmm(m.prior, m.transition, em.Emissions(tuple(em.Poisson(float(r)) for r in m.rates), tuple((j,) for j in m.emission_of)))


def _as(start: PoissonHmm | Hmm, m: Hmm) -> PoissonHmm | Hmm:
    return m if isinstance(start, Hmm) else PoissonHmm(m.prior, m.transition, np.array([p.rate for p in m.emissions.schemes]), start.emission_of)


# ---- products of matrices, in logarithms ------------------------------------------------


def _sum(a: np.ndarray, axis: int) -> np.ndarray:
    return log_sum_exp(a, axis=axis)


def _top(a: np.ndarray, axis: int) -> np.ndarray:
    return a.max(axis=axis)


def _times(plus):
    """(matrix by matrix, vector by matrix) for stacks of them, with `plus` as the sum."""
    return lambda a, b: plus(a[..., :, :, None] + b[..., None, :, :], -2), lambda v, b: plus(v[..., :, None] + b, -2)


#: The composition of functions on states, and a state's image.
_COMPOSED = (lambda f, g: np.take_along_axis(g, f, -1), lambda v, f: np.take_along_axis(f, np.asarray(v)[..., None], -1)[..., 0])


def total(steps: np.ndarray, mul) -> np.ndarray:
    """The product of all steps in order, pairwise."""
    while len(steps) > 1:
        even = len(steps) // 2 * 2
        steps = np.concatenate([mul(steps[0:even:2], steps[1:even:2]), steps[even:]])
    return steps[0]


def scan(steps: np.ndarray, start: np.ndarray, mul, act) -> np.ndarray:
    """start times the first, the first two, ... all of the steps: pairs are scanned, and give
    the places in between."""
    n = len(steps)
    if n == 1:
        return act(start, steps[0])[None]
    odd = scan(mul(steps[0 : n // 2 * 2 : 2], steps[1::2]), start, mul, act)
    out = np.empty((n, *odd.shape[1:]), odd.dtype)
    out[1::2], out[0] = odd, act(start, steps[0])
    out[2::2] = act(odd[: (n - 1) // 2], steps[2::2])
    return out


def _ends(steps: np.ndarray, tops: np.ndarray | None, a: np.ndarray, b: np.ndarray, d: np.ndarray | None, last: int | None):
    """For each of the steps: what comes in from before (a, d) and from behind (b), and the state at
    its end on the best path (last: that of the whole, None if it is free)."""
    before = np.concatenate([a[None], scan(steps, a, *_times(_sum))[:-1]])
    turned = steps[::-1].transpose(0, 2, 1)
    behind = np.concatenate([b[None], scan(turned, b, *_times(_sum))[:-1]])[::-1]
    if tops is None:
        return before, behind, None, None
    best = np.concatenate([d[None], scan(tops, d, *_times(_top))])
    return before, behind, best[:-1], _path(tops, best, last)


def _path(steps: np.ndarray, best: np.ndarray, last: int | None) -> np.ndarray:
    """States at the ends of the steps on the best path; best has what comes in, then each end's."""
    end = np.int64(best[-1].argmax() if last is None else last)
    back = (best[:-1, :, None] + steps).argmax(axis=1)[:0:-1]  # the state before, of the state after
    return np.concatenate([[end], scan(back, end, *_COMPOSED)])[::-1] if len(back) else np.array([end])


def _steps(model: Hmm, x: np.ndarray, first: bool) -> np.ndarray:
    with np.errstate(divide="ignore"):
        e, t, p = model.emissions.log_densities(x), np.log(model.transition), np.log(model.prior)
    s = t[None] + e[:, None, :]
    if first:
        s[0] = p[None, :] + e[0][None, :]
    return s


# ---- sequences in blocks ----------------------------------------------------------------

#: Rows of a block.
BLOCK = 1 << 16


def blocks(df: DataFrame, key: str, order: str, values: Sequence[str], rows: int = BLOCK, tiles: int | None = None) -> DataFrame:
    """(key, block, head, at, x): blocks of at most `rows` rows of a sequence, staged.

    Rows are dealt by ranges of (key, order), so that a long sequence has many partitions; block
    numbers rise along a sequence, head is the sequence's first block in the partition.  at has
    the places in order, x the values, missing ones as NaN.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    held = df.select(F.col(key).alias("key"), F.col(order).alias("at"), *[F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)])
    tiles = tiles or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(parts):
        number, head, now, kept, size, seen = TaskContext.get().partitionId() << 32, None, None, [], 0, False

        def made():
            nonlocal number, head, kept, size
            head = number if head is None else head
            t = pa.Table.from_batches(kept).combine_chunks()
            x = np.stack([c.fill_null(np.nan).to_numpy() for c in t.columns[2:]], axis=1)
            at = t.column(1).combine_chunks()
            lists = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            out = pa.RecordBatch.from_arrays([t.column(0).combine_chunks().slice(0, 1), pa.array([number]), pa.array([head]), lists(at), lists(pa.array(x.ravel()))], ["key", "block", "head", "at", "x"])
            number, kept, size = number + 1, [], 0
            return out

        for b in parts:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(0))
            begin = 0
            for end, k in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if not seen or k != now:
                    if kept:
                        yield made()
                    head, now, seen = None, k, True
                while begin < end:
                    part = b.slice(begin, min(end - begin, rows - size))
                    kept.append(part)
                    size, begin = size + part.num_rows, begin + part.num_rows
                    if size == rows:
                        yield made()
        if kept:
            yield made()

    dealt = held.repartitionByRange(tiles, "key", "at").sortWithinPartitions("key", "at")
    return staged(dealt.mapInArrow(run, f"key {kinds[key]}, block long, head long, at array<{kinds[order]}>, x array<double>"), "blocks")


def _rows(b: pa.RecordBatch, dims: int):
    """(row, rows by dimensions) of a batch of blocks."""
    names = b.schema.names
    for i in range(b.num_rows):
        x = b.column(names.index("x"))[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        yield {n: b.column(c)[i] for c, n in enumerate(names) if n != "x"}, x


def _array(v) -> list[float] | None:
    return None if v is None else np.asarray(v, float).ravel().tolist()


def _grid(v, k: int) -> np.ndarray:
    return np.stack([np.asarray(m, float).reshape(k, k) for m in v])


def carried(held: DataFrame, model: Hmm, dims: int, paths: bool) -> DataFrame:
    """(block, first, a, b, d, s): what comes into each block, in logarithms: forward, backward and
    best sums by state, and the best path's state at the block's end; first: of its sequence."""
    k = len(model.prior)
    key_kind = held.schema["key"].dataType.simpleString()
    none = np.full(k, -np.inf)
    none[0] = 0.0  # any weights that sum to one, as a sequence's first step doesn't depend on them

    def totals(parts):
        for b in parts:
            out = []
            for row, x in _rows(b, dims):
                s = _steps(model, x, False)
                head = row["head"].as_py() == row["block"].as_py()
                s0 = _steps(model, x[:1], True) if head else None
                for plus in (_sum, _top) if paths else (_sum,):
                    mul = _times(plus)[0]
                    rest = total(s[1:], mul) if len(s) > 1 else None
                    whole = lambda f: f if rest is None else mul(f, rest)  # noqa: B023, E731
                    out += [_array(whole(s[0])), _array(whole(s0[0])) if head else None]
            n, w = b.num_rows, 4 if paths else 2
            cols = [pa.array(out[i::w], pa.list_(pa.float64())) if n else pa.array([], pa.list_(pa.float64())) for i in range(w)] + [pa.nulls(n, pa.list_(pa.float64()))] * (4 - w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["key", "block", "head", "m", "m0", "t", "t0"])

    mats = "m array<double>, m0 array<double>, t array<double>, t0 array<double>"
    each = staged(held.mapInArrow(totals, f"key {key_kind}, block long, head long, {mats}"), "products")

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        out = {"key": [rows["key"].iloc[0]], "head": [rows["head"].iloc[0]]}
        for name, plus in (("m", _sum), ("t", _top)):
            if name == "t" and not paths:
                out |= {"t": [None], "t0": [None]}
                continue
            mul, own = _times(plus)[0], _grid(rows[name], k)
            rest = own[1:]
            first = np.asarray(rows[f"{name}0"].iloc[0], float).reshape(k, k)
            out[name] = [_array(total(own, mul))]
            out[f"{name}0"] = [_array(mul(first, total(rest, mul)) if len(rest) else first)]
        return pd.DataFrame(out)[["key", "head", "m", "m0", "t", "t0"]]

    def chained(rows: pd.DataFrame, by: str, first: bool, a, b, d, s) -> pd.DataFrame:
        rows = rows.sort_values(by)
        own, tops = _grid(rows["m"], k), _grid(rows["t"], k) if paths else None
        if first:
            own[0] = np.asarray(rows["m0"].iloc[0], float).reshape(k, k)
            if paths:
                tops[0] = np.asarray(rows["t0"].iloc[0], float).reshape(k, k)
        before, behind, best, ends = _ends(own, tops, a, b, d, s)
        n = len(rows)
        return pd.DataFrame({by: rows[by].to_numpy(), "first": [first and i == 0 for i in range(n)], "a": [_array(v) for v in before], "b": [_array(v) for v in behind], "d": [_array(v) for v in best] if paths else [None] * n, "s": ends if paths else np.full(n, -1)})

    ends = "first boolean, a array<double>, b array<double>, d array<double>, s long"
    over = each.groupBy("key", "head").applyInPandas(product, f"key {key_kind}, head long, {mats}")
    tops = over.groupBy("key").applyInPandas(lambda r: chained(r, "head", True, none, np.zeros(k), none, None), f"head long, {ends}")
    names = ["first", "a", "b", "d", "s"]
    joined = each.join(tops.select("head", *[F.col(c).alias(f"in_{c}") for c in names]), "head")

    def inner(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        vec = lambda v: None if v is None else np.asarray(v, float)
        return chained(rows, "block", bool(r["in_first"]), vec(r["in_a"]), vec(r["in_b"]), vec(r["in_d"]), int(r["in_s"]) if paths else None)

    return staged(joined.groupBy("head").applyInPandas(inner, f"block long, {ends}"), "carried")


def _inside(model: Hmm, row: dict, x: np.ndarray):
    """Steps, forward and backward logarithms of a block, and what comes in."""
    s = _steps(model, x, row["first"].as_py())
    a_in, b_in = (np.array(row[c].as_py(), float) for c in "ab")
    a = scan(s, a_in, *_times(_sum))
    b = np.concatenate([scan(s[:0:-1].transpose(0, 2, 1), b_in, *_times(_sum))[::-1], b_in[None]]) if len(s) > 1 else b_in[None]
    return s, a, b, a_in


def fit(df: DataFrame, key: str, order: str, value: str | Sequence[str], start: PoissonHmm | Hmm, threshold: float = 1e-4, iterations: int = 30, block: int = BLOCK) -> tuple[PoissonHmm | Hmm, list[float]]:
    """Baum-Welch over all sequences: the model and the log likelihood before each step.

    The input is read once, into blocks; a step sums statistics over them, of which the driver
    sees numbers for each state, scheme and (for schemes that need them) value.
    """
    values = [value] if isinstance(value, str) else list(value)
    held, model, trace, k = blocks(df, key, order, values, block), _general(start), [-np.inf], len(start.prior)
    for _ in range(iterations):

        def expect(parts, model=model):
            sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(3))

            def add(kind, i, v, *w):
                sums[kind, i, v][: len(w)] += w

            for b in parts:
                for row, x in _rows(b, len(values)):
                    s, a, b_, a_in = _inside(model, row, x)
                    ll = float(log_sum_exp(a[0] + b_[0]))
                    g = np.exp(a + b_ - ll)
                    if first := row["first"].as_py():
                        add(0, 0, None, ll)
                        for i in range(k):
                            add(1, i, None, g[0, i])
                    before = np.concatenate([a_in[None], a[:-1]])
                    xi = np.exp(before[:, :, None] + s + b_[:, None, :] - ll)[1 if first else 0 :].sum(axis=0)
                    for i in range(k * k):
                        add(2, i, None, xi.ravel()[i])
                    for j, v, *w in model.emissions.weigh(x, g):
                        add(3, j, v, *w)
            if sums:
                kind, i, v = zip(*sums)
                w = np.stack(list(sums.values()))
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.float64()), *[pa.array(w[:, c]) for c in range(3)]], ["kind", "i", "v", "w", "wx", "wxx"])

        whole = held.join(carried(held, model, len(values), False).drop("d", "s"), "block")
        stats = whole.mapInArrow(expect, "kind int, i int, v double, w double, wx double, wxx double").groupBy("kind", "i", "v").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wxx")]).collect()
        one = lambda kind, n: np.array([sum(r["w"] for r in stats if r["kind"] == kind and r["i"] == i) for i in range(n)], float)  # noqa: E731, B023
        if not stats:
            raise ValueError("no sequences to fit")
        trace.append(float(one(0, 1)[0]))
        if converged(trace[-2], trace[-1], threshold):
            break
        model = model.refitted(one(1, k), one(2, k * k).reshape(k, k), [tuple(r)[1:] for r in stats if r["kind"] == 3])
    return _as(start, model), trace[1:]


def predict(df: DataFrame, key: str, order: str, value: str | Sequence[str], model: PoissonHmm | Hmm, block: int = BLOCK) -> DataFrame:
    """(key, order, state, null): the Viterbi states, and the posterior of state 0."""
    values = [value] if isinstance(value, str) else list(value)
    held, model = blocks(df, key, order, values, block), _general(model)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def states(parts):
        for b in parts:
            for row, x in _rows(b, len(values)):
                s, a, b_, _ = _inside(model, row, x)
                d_in = np.array(row["d"].as_py(), float)
                best = np.concatenate([d_in[None], scan(s, d_in, *_times(_top))])
                path = _path(s, best, row["s"].as_py())
                g = np.exp(a + b_ - log_sum_exp(a + b_, axis=1)[:, None])[:, 0]
                n = len(x)
                same = pa.array([row["key"].as_py()] * n, row["key"].type)
                yield pa.RecordBatch.from_arrays([same, row["at"].values, pa.array(path.astype(np.int64)), pa.array(g)], [key, order, "state", "null"])

    whole = held.join(carried(held, model, len(values), True), "block")
    return whole.mapInArrow(states, f"{key} {kinds[key]}, {order} {kinds[order]}, state long, null double")
