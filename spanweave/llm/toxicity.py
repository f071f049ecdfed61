"""Toxicity of texts whose offensive words may be disguised.

The noisy channel: a writer meant a word and typed leetspeak, stretched letters or spaced
letters.  Each disguised stretch becomes a lattice of what each sign may stand for; Viterbi
decoding under a character trigram model of the whole corpus picks the likeliest reading.
The restored text is scored by words: weights are log odds of a word among toxic and other
labelled documents, and a logistic regression turns their sums into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, one_text_each, slices, staged, table, utf8

#: Most labelled documents the fit reads, and most words it keeps (documented bounds).
ROWS, WORDS = 20_000, 2_000
#: Least log likelihood ratio of a word that is kept, above the log of the number of words.
EVIDENCE = 2.0

#: What a sign may stand for, with the channel's log probability.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il",
    "|": "li", "+": "t", "*": "aeiou", "(": "c", "€": "e",
}
_LEET = "".join(map(re.escape, LEET))
#: Stretches that may hide a word: signs among letters, a letter three times or more, and
#: single letters set apart.
DISGUISED = re.compile(
    rf"(?<![^\s\"'(])(?:[{_LEET}]{{1,2}}[^\W\d_]|[^\W\d_]+(?:[{_LEET}]+[^\W\d_]|[013457](?![\w{_LEET}])))[\w{_LEET}]*"
    r"|(?<!\w)\w*?([^\W\d_])\1\1+\w*"
    r"|(?<!\w)[^\W\d_](?:([ .\-_*~])[^\W\d_])(?:\2[^\W\d_])+(?!\w)"
)
_WORD = re.compile(r"[^\W\d_]+")
_APART = re.compile(r"[^\W\d_](?:([ .\-_*~])[^\W\d_])(?:\1[^\W\d_])+")
#: Steps of a lattice after which the part that all readings share is written down, and the
#: longest stretch whose reading is kept for reuse; neither changes a reading.
SETTLE, REUSED = 1024, 64
#: The only option of a sign that says nothing: a letter after the second of a run.
NOTHING = [("", 0.0)]


# ---- the character model ----------------------------------------------------------------

_SIZE = 28  # 0 is everything between words, 1 to 26 are letters, 27 are other letters


def _codes() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    out[128:] = 27
    return out


CODES = _codes()


def _code(c: str) -> int:
    return int(CODES[ord(c)]) if ord(c) < 128 else 27 if c.isalpha() else 0


@dataclass(frozen=True)
class Letters:
    """log p(c | a, b) of letter codes, interpolated with shorter contexts."""

    logp: np.ndarray

    @staticmethod
    def from_counts(counts: np.ndarray, pull: float = 20.0) -> Letters:
        c3 = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        c2 = c3.sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + _SIZE)
        p2 = (c2 + pull * p1) / (c2.sum(1, keepdims=True) + pull)
        p3 = (c3 + pull * p2[None]) / (c3.sum(2, keepdims=True) + pull)
        return Letters(np.log(p3))


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts.  Each partition sends its own table of at most
    28 ** 3 cells; the sum has a fixed size."""

    def run(parts):
        total = np.zeros(_SIZE**3, np.int64)
        for b in parts:
            at, data = utf8(b.column(1))
            for i, j in slices(at):
                c = CODES[data[at[i] : at[j]]].astype(np.int64)
                total += np.bincount(c[:-2] * 784 + c[1:-1] * 28 + c[2:], minlength=len(total)) if len(c) > 2 else 0
        cell = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    rows = id_text(docs).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SIZE**3, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


# ---- the channel ------------------------------------------------------------------------


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each sign of a disguised stretch what it may have been, with log probabilities.

    A letter is itself; of three or more equal ones the second may be nothing and the rest
    are; letters set apart may or may not start a word; a sign of leetspeak is one of its
    letters; anything else ends a word.
    """
    s = stretch.lower()
    if _APART.fullmatch(s):
        return [[(s[0], 0.0)]] + [[(c, -0.3), (" " + c, -1.5)] for c in s[2::2]]
    out: list[list[tuple[str, float]]] = []
    places = [(c, run, length) for c, same in groupby(s) for length in (len(list(same)),) for run in range(length)]
    for c, run, length in places:
        if c in LEET and run == 0 or c in LEET and length < 3:
            options = [(x, -0.5 - 0.2 * k) for k, x in enumerate(LEET[c])]
        elif c in LEET:
            options = NOTHING
        elif c.isalpha():
            options = [(c, 0.0)]
        else:
            options = [(" ", 0.0)]
        if length >= 3 and run == 1:
            options = [*options, ("", -0.3)]
        elif length >= 3 and run > 1:
            options = NOTHING
        out.append(options)
    return out


def viterbi(steps: list[list[tuple[str, float]]], letters: Letters) -> str:
    """The likeliest reading of a lattice between two word ends; ties go to the earlier option.

    Back pointers lead from each state to the one before it; where all of them lead to one state,
    the reading up to it is settled, so a long lattice holds few of them.
    """
    logp = letters.logp
    states: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    settled: list[str] = []

    def trace(state: tuple[int, int], stop: int) -> list[str]:
        out = []
        for step in reversed(back[:stop]):
            state, emitted = step[state]
            out.append(emitted)
        return out[::-1]

    due = SETTLE
    for options in steps:
        if options == NOTHING:
            continue
        new: dict[tuple[int, int], float] = {}
        best: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), score in states.items():
            for emitted, cost in options:
                u, v, total = a, b, score + cost
                for c in emitted:
                    w = _code(c)
                    total += logp[u, v, w]
                    u, v = v, w
                if (u, v) not in new or total > new[u, v]:
                    new[u, v], best[u, v] = total, ((a, b), emitted)
        states = new
        back.append(best)
        if len(back) >= due:
            alive, at = set(states), len(back)
            while len(alive) > 1 and at:
                at -= 1
                alive = {back[at][x][0] for x in alive}
            if at:
                settled += trace(*alive, at)
                del back[:at]
            due = SETTLE + 2 * len(back)  # so that all walks back take as long as the way on
    last = max(states, key=lambda x: states[x] + logp[x[0], x[1], 0])
    return "".join(settled + trace(last, len(back)))


class Restorer:
    """Restores texts with one character model; readings of stretches are kept for reuse."""

    def __init__(self, letters: Letters):
        self.letters = letters
        self.known = lru_cache(100_000)(self._read)

    def _read(self, stretch: str) -> str:
        return viterbi(lattice(stretch), self.letters)

    def read(self, stretch: str) -> str:
        return self.known(stretch) if len(stretch) <= REUSED else self._read(stretch)

    def text(self, text: str | None) -> str:
        return DISGUISED.sub(lambda m: self.read(m[0]), text) if text else ""


def words(restored: str) -> set[str]:
    return set(_WORD.findall(restored.lower()))


# ---- the score --------------------------------------------------------------------------


@dataclass(frozen=True)
class ToxicModel:
    letters: Letters
    weights: dict[str, float]
    coefficients: tuple[float, ...]

    def features(self, restored: str) -> tuple[float, float, float]:
        """Sum and maximum of the weights of known words, and log of how many there are."""
        w = [self.weights[x] for x in words(restored) & self.weights.keys()]
        return (sum(w), max(w, default=0.0), float(np.log1p(len(w))))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.coefficients[:-1]) + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most_words: int = WORDS) -> ToxicModel:
    """Learn `toxic` from labels outside the held-out fold: at most `rows` of them, those with
    the least hashed ids.  The character model reads every document and no label.  Without
    labelled rows, or with one class only, each score is 0.5 or that class's share.
    """
    spark = docs.sparkSession
    letters = Letters.from_counts(letter_counts(docs))
    l = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("double").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("i")))
    picked = l.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)
    picked = spark.createDataFrame(picked.collect(), "i long, y double")  # at most `rows` pairs

    def restore(parts):
        read = Restorer(letters)
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read.text(t) for t in b.column(1).to_pylist()], pa.string())], ["y", "text"])

    sample = staged(one_text_each(docs, picked).select("y", "text").mapInArrow(restore, "y double, text string"), "restored")

    def count(parts):
        for b in parts:
            seen: dict[str, list[int]] = {"": [0, 0]}
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in (*words(text), ""):
                    seen.setdefault(w, [0, 0])[int(y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(c, pa.int64()) for c in zip(*seen.values()))], ["word", "other", "toxic"])

    totals = sample.mapInArrow(count, "word string, other long, toxic long").groupBy("word").agg(F.sum("other").alias("n"), F.sum("toxic").alias("p"))
    whole = totals.agg(F.count("*"), F.max(F.when(F.col("word") == "", F.struct("n", "p")))).first()
    n, p = whole[1] or (0, 0)
    if not n or not p:
        share = 0.5 if n + p == 0 else 0.99 if p else 0.01
        return ToxicModel(letters, {}, (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))))
    odds = F.log((F.col("p") + 0.5) / (p - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (n - F.col("n") + 0.5))
    # how much likelier the word's labels are under its own share of toxic ones than under all's
    share, rest = F.col("p") / (F.col("p") + F.col("n")), F.col("n") / (F.col("p") + F.col("n"))
    part = lambda k, r, q: F.when(k > 0, k * F.log(r / F.lit(q))).otherwise(0.0)
    evidence = part(F.col("p"), share, p / (p + n)) + part(F.col("n"), rest, n / (p + n))
    known = totals.where("word <> '' AND p > 0").select("word", odds.alias("w"), evidence.alias("z"))
    top = known.where((F.col("w") > 0) & (F.col("z") >= EVIDENCE + float(np.log(whole[0])))).orderBy(F.desc("z"), "word").limit(most_words).collect()
    model = ToxicModel(letters, {r["word"]: r["w"] for r in top}, ())

    def measure(parts):
        for b in parts:
            x = [(y, *model.features(t)) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*x)], ["y", "a", "b", "c"])

    got = np.array(sorted(map(tuple, sample.mapInArrow(measure, "y double, a double, b double, c double").collect())))
    return ToxicModel(letters, model.weights, tuple(_logistic(got[:, 1:], got[:, 0])))


def toxicity_scores(docs: DataFrame, model: ToxicModel, keep_text: bool = False) -> DataFrame:
    """(doc_id, score) of each document row, with keep_text also the restored text; null and
    empty texts get the score of a text without any known word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed table and at most WORDS words

    def run(parts):
        m = shared.value
        read = Restorer(m.letters)
        for b in parts:
            at, _ = utf8(b.column(1))
            for i, j in slices(at):
                texts = [read.text(t) for t in b.column(1).slice(i, j - i).to_pylist()]
                cols = [b.column(0).slice(i, j - i), pa.array(m.score(np.array([m.features(t) for t in texts])))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(texts)] if keep_text else []), ["doc_id", "score"] + ["restored"] * keep_text)

    return id_text(docs).mapInArrow(run, "doc_id long, score double" + ", restored string" * keep_text)


def op4_noisy_channel(spark, sf_dir: str) -> DataFrame:
    """A score for each row of documents.  Null and empty texts get that of a text without known
    words; a null id is held out as the empty string's checksum says; repeated rows are scored
    each; words of any length are read whole; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
