"""Ranked lexical search by scoring windows of documents at a time.

One pass over the documents writes an index of the terms that the queries use, dealt and sorted by
fixed windows of document ids.  A task traverses the postings of one window after another: the
terms of a query are scatter-added into an array with a slot for each document of the window,
small enough for a core's cache; a bitset tells which slots were touched, so that only those are
harvested, and a heap for each query keeps the best.  Tasks pass on a heap's rows only.

Queries go in blocks of bounded bytes, each with a pass of its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import id_array, id_text, ids, staged, table

#: Documents in a window, about; scores of one take 16 KB.
WINDOW = 2048
#: Results for each query.
BEST = 10
#: Bytes of query texts that one pass takes; more queries mean more passes.
BLOCK_BYTES = 8 << 20

#: By byte: ASCII digits and letters, A-Z lowered, and all bytes of other letters; else a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order; a null text has none."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass(frozen=True)
class Queries:
    """A block of queries: their ids, and their terms as (number, times)."""

    ids: tuple
    vocabulary: dict
    asked: tuple

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Queries:
        counts = [Counter(terms(t)) for _, t in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        return Queries(tuple(i for i, _ in rows), vocabulary, tuple(tuple((vocabulary[t], q) for t, q in c.items()) for c in counts))


def _blocks(queries: DataFrame, limit: int):
    """Lists of (item id, text) of about `limit` bytes each, one at a time; equal rows are one."""
    items = queries.select(F.col("item_id").cast("long").alias("i"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // limit)
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()]


_INDEX = "doc_id long, shift long, n long, term array<int>, tf array<int>"


def index(docs: DataFrame, queries: Queries, window: int = WINDOW) -> DataFrame:
    """(window, doc_id, n, term, tf) for each document: its number of terms, and the numbers and
    occurrences of those that queries use; dealt by window, in order of window and id.

    A window is a range of ids of one width, about `window` documents where ids are dense.
    Documents without an id are dealt to windows by a hash.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(queries.vocabulary)  # at most BLOCK_BYTES of text

    def run(parts):
        get, size = held.value.get, len(held.value)
        for b in parts:
            n, rows, found = [], [], []
            for k, text in enumerate(b.column(1)):
                all_terms = terms(text.as_py())
                n.append(len(all_terms))
                here = np.fromiter((get(t, -1) for t in all_terms), np.int64, len(all_terms))
                here = here[here >= 0]
                found.append(here)
                rows.append(np.full(len(here), k))
            if not n:
                continue
            pairs, tf = np.unique(np.concatenate(rows) * max(size, 1) + np.concatenate(found), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(n) + 1) * max(size, 1)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), lists(pairs % max(size, 1)), lists(tf)], ["doc_id", "shift", "n", "term", "tf"])

    low, high, rows = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count("*")).first()
    width = min(1 << 62, max(1, (high - low + 1) * window // max(rows, 1))) if low is not None else 1
    spread = F.pmod(F.xxhash64("text"), F.lit(max(1, rows // window)))  # only documents without an id use it
    made = id_text(docs).select("doc_id", "text", spread.cast("long").alias("shift")).mapInArrow(run, _INDEX)
    dealt = made.select(F.coalesce(F.expr(f"doc_id div {width}L"), "shift").alias("window"), "doc_id", "n", "term", "tf")
    return staged(dealt.hint("rebalance", "window").sortWithinPartitions("window", "doc_id"), "postings")


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class _Scorer:
    """Scores windows one after the other and keeps the best documents of each query."""

    def __init__(self, queries: Queries, w: np.ndarray, n_docs: int, n_terms: int, best: int, window: int):
        self.queries, self.w, self.n_docs, self.n_terms, self.best = queries, w, n_docs, n_terms, best
        self.scores = np.zeros(window, np.int64)
        self.touched = np.zeros(-(-window // 64), np.uint64)
        self.heaps: list[list] = [[] for _ in queries.ids]

    def window(self, doc: np.ndarray, n: np.ndarray, slot: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Score documents in slots 0, 1, ... of a window by their postings (slot, term, tf)."""
        sizes, back = np.unique(n, return_inverse=True)
        m = np.array([25 + 75 * x * self.n_docs // self.n_terms for x in sizes.tolist()], np.int64)[back]
        by = np.argsort(term, kind="stable")
        slot, term, tf = slot[by], term[by], tf[by]
        gain = self.w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[slot]))
        # a term's bits: words of 64 slots
        word = slot >> 6
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (word[1:] != word[:-1]))[: len(term)])
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), new) if len(new) else np.zeros(0, np.uint64)
        word = word[new]
        there, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        first_bit, last_bit = np.searchsorted(new, first), np.searchsorted(new, last)
        span = {t: (slot[a:z], gain[a:z], word[i:j], bits[i:j]) for t, a, z, i, j in zip(there.tolist(), first.tolist(), last.tolist(), first_bit.tolist(), last_bit.tolist())}
        scores, touched = self.scores, self.touched
        for heap, asked in zip(self.heaps, self.queries.asked):
            any_term = False
            for t, q in asked:
                if (held := span.get(t)) is not None:
                    at, add, words, marks = held
                    scores[at] += add if q == 1 else q * add
                    touched[words] |= marks
                    any_term = True
            if any_term:
                at = np.flatnonzero(np.unpackbits(touched.view(np.uint8), bitorder="little"))
                got = scores[at]
                scores[at] = 0
                touched[:] = 0
                self._harvest(heap, doc[at], got)

    def _harvest(self, heap: list, doc: np.ndarray, got: np.ndarray) -> None:
        least = heap[0][0] if len(heap) == self.best else 1
        good = np.flatnonzero(got >= least)
        if len(good) > self.best:  # the best of this window, equal ones at the end of them too
            good = good[got[good] >= np.partition(got[good], len(good) - self.best)[len(good) - self.best]]
        for s, d in zip(got[good].tolist(), doc[good].tolist()):
            if len(heap) < self.best:
                heapq.heappush(heap, (s, -d))
            elif (s, -d) > heap[0]:
                heapq.heapreplace(heap, (s, -d))


def _search(spark: SparkSession, docs: DataFrame, queries: Queries, best: int, window: int) -> DataFrame:
    held = index(docs, queries, window)
    n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.greatest(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(queries.vocabulary), np.int64)
    for t, k in held.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[t] = k
    shared = spark.sparkContext.broadcast((queries, weights(df, n_docs), n_docs, n_terms))

    def run(parts):
        scorer = _Scorer(*shared.value, best, window)
        kept: list[tuple] = []

        def score(rows):
            doc, n, sizes, term, tf = (np.concatenate(c) for c in zip(*rows))
            for a in range(0, len(doc), window):  # more than a window's documents only if ids repeat or are uneven
                z = min(a + window, len(doc))
                i, j = sizes[:a].sum(), sizes[:z].sum()
                scorer.window(doc[a:z], n[a:z], np.repeat(np.arange(z - a), sizes[a:z]), term[i:j], tf[i:j])

        now = None
        for b in parts:
            t = b.column(3)
            at = t.offsets.to_numpy()
            term, tf = (b.column(c).values.to_numpy().astype(np.int64) for c in (3, 4))
            which, doc, n = b.column(0).to_numpy(), ids(b.column(1)), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(which)] if len(which) else []
            for a, z in zip(cuts, cuts[1:]):
                if kept and (which[a] != now or sum(len(r[0]) for r in kept) >= 8 * window):
                    score(kept)
                    kept = []
                now = which[a]
                kept.append((doc[a:z], n[a:z], np.diff(at[a : z + 1]), term[at[a] : at[z]], tf[at[a] : at[z]]))
        if kept:
            score(kept)
        rows = [(k, -d, s) for k, heap in enumerate(scorer.heaps) for s, d in heap]
        if rows:
            k, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), id_array(np.array(d, np.int64)), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    found = held.mapInArrow(run, "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(queries.ids)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents (doc_id, text) of each query (item_id, text).

    Scores are sums of integers over the query's terms, repeats included, by term frequency,
    document length and rarity.  Equal scores come in order of ids, a null id first.  Equal query
    rows are one query; queries that share an id are ranked apart; queries or documents without
    terms (null, empty) find or are nothing.  Repeated documents are ranked each.  Tables without
    rows give none.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if docs.isEmpty():
        return out
    for block in _blocks(queries, block_bytes):
        held = Queries.of(block)
        if held.vocabulary:
            out = out.unionAll(_search(spark, docs, held, best, window))
    return out


def op12_windowed_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each item of `benchmark`; rules as in search()."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same ranking over whole tables, for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, w, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1, 2),
one AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::bigint AS n_terms FROM d),
tf AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY 1, 2),
weight AS (SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint AS weight FROM (SELECT w, count(*) AS df FROM tf GROUP BY 1), one),
scored AS (SELECT item_id, doc_id, tf.r, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n_docs) // n_terms))))::bigint AS score FROM q JOIN tf USING (w) JOIN weight USING (w) JOIN d ON d.r = tf.r, one GROUP BY 1, 2, 3),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
