"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on labelled rows; every path in them is a rule, a
conjunction of bounds on statistics.  Logistic weights for the rules are fitted with an L1
penalty (accelerated proximal gradient), which leaves few of them, and those are compiled
into one Spark column expression.  Scoring is a single scan without Python.

The rows for fitting are bounded: at most `rows` labelled documents, those with the smallest
hashed ids (a documented parameter); all documents are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_text_each, table
from .trees import edges, grow, paths, predict

#: Most labelled rows that the fit reads.
ROWS = 20_000
TREES, DEPTH, RATE = 40, 3, 0.3
PENALTY = 2e-3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, all defined for the empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(F.lower(t), r"[ \n\t]+")
    lines = F.split(t, "\n")
    count = F.size(words).cast("double")
    per = lambda c: c.cast("double") / count
    return {
        "chars": F.log1p(F.length(t).cast("double")),
        "word_chars": n / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "line_words": count / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
        "capitals": per(F.regexp_count(t, F.lit(r"\p{Lu}{2,}"))),
        "signs": per(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:'()\-]+"))),
        "digits": per(F.regexp_count(t, F.lit("[0-9]+"))),
        "stops": per(F.regexp_count(t, F.lit(r"[.,]"))),
        "bars": per(F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))),
        "bangs": per(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))),
    }


Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, from 0 to 1, as a Spark expression over columns of statistics."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            hit = F.lit(True)
            for f, low, t in rule:
                c = stats[self.names[f]]
                hit = hit & ((c <= t) if low else (c > t))
            z = z + F.when(hit, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, low, t in rule:
            out[:, j] *= (x[:, f] <= t) if low else (x[:, f] > t)
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the bias is not penalised."""
    n, m = a.shape
    a1 = np.hstack([a, np.ones((n, 1))])
    v = np.ones(m + 1)
    for _ in range(30):  # the largest curvature, by power iteration
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4.0 * n / (v @ (a1.T @ (a1 @ v)) + 1e-12)
    w = np.zeros(m + 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(rate / (1 - rate))
    u, k = w.copy(), 1.0
    for _ in range(steps):
        g = a1.T @ (1 / (1 + np.exp(-np.clip(a1 @ u, -40, 40))) - y) / n
        new = u - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        u, w, k = new + (k - 1) / k2 * (new - w), new, k2
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 7) -> RuleModel:
    """Fit on rows of statistics; with no rows or one class only, the model is a constant."""
    if len(y) == 0:
        return RuleModel(tuple(names), (), (), 0.0)
    rng = np.random.default_rng(seed)
    z, cuts = np.zeros(len(y)), edges(x)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, y - p, rng.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float), depth, rng, None, max(3.0, len(y) / 400), cuts)
        z += RATE * 4 * predict(tree, x)
        rules |= dict.fromkeys(paths(tree))
    kept = list(rules)
    a = _matrix(kept, x)
    w, bias = _lasso(a, y, penalty)
    on = np.nonzero(np.abs(w) > 1e-6)[0]
    return RuleModel(tuple(names), tuple(kept[j] for j in on), tuple(float(w[j]) for j in on), bias)


def held_out(id_col: Column, fold: int = 1, folds: int = 3) -> Column:
    """crc32 of the id as text, by remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> RuleModel:
    """Learn `quality` from labels outside the held-out fold (rows with a null label or id are no labels)."""
    spark = docs.sparkSession
    l = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("double").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("i")))
    picked = l.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)
    picked = spark.createDataFrame(picked.toArrow())  # at most `rows` pairs; from a list Spark would start Python workers of another kind
    stats = statistics(F.col("text"))
    got = one_text_each(docs, picked).select("i", "y", *[c.alias(k) for k, c in stats.items()]).toArrow()
    order = np.lexsort([got[k].to_numpy() for k in ("chars", "i")]) if got.num_rows else np.zeros(0, int)
    x = np.stack([got[k].to_numpy() for k in stats], axis=1)[order]
    return fit(x, got["y"].to_numpy()[order], list(stats))


def quality_scores(docs: DataFrame, model: RuleModel, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id by default) and `score`; one row for each document, null texts as empty."""
    stats = statistics(F.col("text"))
    keep = ["doc_id"] if keep is None else keep
    # a generator of one row: filters on the score aren't pushed below it, where each rule would
    # compute its statistics anew
    once = docs.select(F.struct(*keep).alias("__row"), *[c.alias(f"__s_{k}") for k, c in stats.items()])
    held = once.select("__row", F.inline(F.array(F.struct(*[f"__s_{k}" for k in stats]))))
    return held.select(*[F.col("__row")[k].alias(k) for k in keep], model.column({k: F.col(f"__s_{k}") for k in stats}).alias("__score"))


def op9_rule_quality(spark, sf_dir: str) -> DataFrame:
    """A score for each row of documents.  Null texts count as empty ones, whose statistics are
    defined; a null id is held out as the empty string's checksum says; repeated rows are scored
    each; texts of any length are read whole; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score under 0.5 go.  The model is fitted on the whole
    table of labelled documents in `sf_dir`, so what the stage sees doesn't change it.  Each row
    is judged by its own text (null as empty), whatever its id; an empty table stays empty."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_scores(docs, model, docs.columns).where("__score >= 0.5").drop("__score")
