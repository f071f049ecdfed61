"""Spelling variants, ranked search and the suffix tree against plain Python."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import lexical, spelling, suffix_states

SF = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def frame(spark, rows):
    """Documents with extra columns that carry working names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "id", "mark", "window", "term", "tf", "slice", "held", "uid", "item_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- 11 ---------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(40))
def test_near_pairs_within_and_across_stretches(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choices("abé"[: r.randint(1, 3)], k=r.randint(0, 7) if seed % 3 else r.randint(48, 60))) for _ in range(r.randint(7, 60))})
    want = {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if near(words[i], words[j])}
    a, b = spelling.near_pairs(words)
    assert sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())) == sorted(want)
    cut = len(words) // 2
    found, groups = set(), collections.defaultdict(list)
    for part, first in ((words[:cut], 0), (words[cut:], cut)):
        a, b = spelling.near_pairs(part)
        found |= {tuple(sorted((x + first, y + first))) for x, y in zip(a.tolist(), b.tolist())}
        for place, *node, letter, spent in spelling.open_nodes(part):
            groups[tuple(node)].append((first, place + first, letter, spent))
    for g in groups.values():
        found |= {tuple(sorted((x[1], y[1]))) for x in g for y in g if x[3] and x[0] != y[0] and x[2] != y[2]}
    assert found == want


def plain_variants(rows):
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    groups, close = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            groups[w[:i] + w[i + 1 :], i].add(w)
    for (rest, _), g in groups.items():
        for w in g:
            close[w] |= g - {w}
            if rest in words:
                close[w].add(rest)
                close[rest].add(w)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(close[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("stretch", [60, 100_000])
def test_variants_equal_plain_python(spark, stretch):
    rows = texts(spark) + [(None, "WORDS Wörds wordss " * 4), (5, None), (6, ""), (7, "ab" * 40_000), (7, "ab" * 40_000), (8, "ab" * 40_000), (8, "ab" * 39_999 + "b"), (8, "ab" * 39_999 + "b"), (9, "ab" * 39_999 + "b"), (None, "Wörds" * 1)]
    got = spelling.variants(spelling.vocabulary(frame(spark, rows)), stretch).collect()
    assert {tuple(r) for r in got} == plain_variants(rows) and len(got) == len({r.word for r in got})


def test_variants_of_nothing(spark):
    assert spelling.variants(spelling.vocabulary(frame(spark, []))).collect() == []


# ---- 12 ---------------------------------------------------------------------------------


def plain_search(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    held = [(d, collections.Counter(cut(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for i, t in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w, q in collections.Counter(cut(t)).items() if c[w])
            scores.append((-s, -(2**63) if d is None else d))
        out += [(i, k + 1, None if d == -(2**63) else d, -s) for k, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:10])]
    return sorted(out, key=str)


def test_search_equals_plain_python(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcü7", k=r.randint(1, 3))) for _ in range(60)]
    docs = [(r.choice([i * 1000, i, 7, None]), r.choice([" ".join(r.choices(words, k=r.randint(0, 40))), None, "", "-- !", "A,b;" * 3000])) for i in range(90)]
    docs += docs[:30] + [(2**63 - 1, "abc"), (-(2**63) + 1, "abc abc")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(25)] + [(None, "a b"), (3, None), (4, "..."), (5, words[0].upper() + " zzzz " + words[0])]
    items = list(dict.fromkeys(items))
    for window, block in ((2048, 8 << 20), (4, 700)):
        got = lexical.search(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=window, block_bytes=block).collect()
        assert sorted((tuple(x) for x in got), key=str) == plain_search(docs, items)


def test_search_matches_its_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.register(t, spark.read.parquet(f"{SF}/{t}.parquet").toArrow())
    want = c.sql(lexical.SQL).fetchall()
    assert sorted(tuple(r) for r in lexical.op12_windowed_search(spark, SF).collect()) == sorted(want)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(none, items).collect() == [] and lexical.search(frame(spark, [(1, "a"), (2, None)]), items.limit(0)).collect() == []
    assert lexical.search(frame(spark, [(1, ""), (2, None)]), items).collect() == []


# ---- 13 ---------------------------------------------------------------------------------


def plain_tree(rows, least, gain):
    """The same tree by dictionaries: (tokens, known, N, base, score) of each row."""
    docs = [([*re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""], held) for t, held in rows]
    c0, c1, c2 = collections.Counter(), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)

    def places(words):
        for i, w in enumerate(words):
            yield w, words[i - 1] if i else "", ((words[i - 2] if i > 1 else "") if i else None, words[i - 1] if i else "")

    for words, held in docs:
        if not held:
            for w, a, ab in places(words):
                c0[w] += 1
                c1[a][w] += 1
                if ab[0] is not None:
                    c2[ab][w] += 1
    n, v = sum(c0.values()), len(c0)
    tot1, tot2 = {a: sum(c.values()) for a, c in c1.items()}, {a: sum(c.values()) for a, c in c2.items()}

    def smooth(c, total, w, below, out):
        f = len(c) - (1 if out and c[w] == 1 else 0)
        f = max(f, 1) if out else f
        return (max(c[w] - out, 0) + f * below) / (total - out + f)

    def chain(w, a, ab, out):
        p0 = (max(c0[w] - out, 0) + 1) / (n + v + 1)
        p1 = smooth(c1[a], tot1[a], w, p0, out) if tot1.get(a, 0) >= least else None
        p2 = smooth(c2[ab], tot2[ab], w, p1, out) if p1 is not None and tot2.get(ab, 0) >= least else None
        return p0, p1, p2

    g1, g2 = collections.Counter(), collections.Counter()
    for words, held in docs:
        if not held:
            for w, a, ab in places(words):
                p0, p1, p2 = chain(w, a, ab, 1)
                if p1 is not None:
                    g1[a] += math.log(p1 / p0)
                if p2 is not None:
                    g2[ab] += math.log(p2 / p1)
    out = []
    for words, _ in docs:
        base = score = 0.0
        for w, a, ab in places(words):
            p0, p1, p2 = chain(w, a, ab, 0)
            two = p2 is not None and g2[ab] >= gain
            one = p1 is not None and (g1[a] >= gain or two)
            base += math.log10((c0[w] + 1) / (n + 1 * (v + 1)))
            score += math.log10(p2 if two else p1 if one else p0)
        out.append((len(words), sum(c0[w] > 0 for w in words), n, base, score))
    return out


def test_distinct_keys_equal_numpy_and_take_less_time():
    r = np.random.default_rng(3)
    alike = (np.uint64(7) << np.uint64(60)) | r.integers(0, 50, 3000).astype(np.uint64)  # told apart by low bits only
    spread = r.integers(0, 1 << 63, 400_000).astype(np.uint64) << np.uint64(1)
    runs = np.concatenate([np.sort(spread[a : a + 20_000]) for a in range(0, len(spread), 20_000)])
    took = {}
    for name, keys, merged in (("none", spread[:0], False), ("one", spread[:1], False), ("alike", alike, False), ("alike", alike, True), ("spread", np.repeat(spread[::4], 4), False), ("runs", runs, True)):
        for f in (lambda k: np.unique(k, return_inverse=True), lambda k: suffix_states._distinct(k, merged)):
            begun = time.process_time()
            took.setdefault(name, []).append((f(keys), time.process_time() - begun))
        (want, _), (got, _) = took[name][-2:]
        assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    assert took["runs"][1][1] < took["runs"][0][1]


@pytest.mark.parametrize("tokens, chunk", [(400, 200), (1_500_000, 4 << 20)])
def test_tree_equals_plain_python(spark, tokens, chunk):
    rows = texts(spark)[:120] + [(None, "The the THE end"), (None, None), (7, ""), (7, " \x0b\x1f a"), (9, "many words " * 900), (9, "many words " * 900)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    df = frame(spark, rows)
    got = suffix_states.scored(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, 0.0, 12, 2.0, tokens, chunk).collect()
    want = plain_tree([((t or ""), held(d)) for d, t in rows], 12, 2.0)
    by_share = suffix_states.scored(df, F.lit(False), 0.001, 5, 2.0, tokens, chunk).agg(F.sum("score"), F.max("train_tokens")).first()
    assert abs(by_share[0] - sum(w[4] for w in plain_tree([((t or ""), False) for _, t in rows], 0.001 * by_share[1], 2.0))) < 1e-3
    key = lambda r: (str(r[0]), *[round(float(x), 5) for x in r[2:]])
    a = sorted((key((r.doc_id, 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got), key=str)
    b = sorted((key((d, 0, *w)) for (d, _), w in zip(rows, want)), key=str)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and np.allclose(x[1:], y[1:], atol=1e-4)
    assert {(r.doc_id, r.held_out) for r in got} == {(d, held(d)) for d, _ in rows}


def test_tree_gains_on_held_out_documents(spark):
    got = suffix_states.op13_suffix_tree_scores(spark, SF).toPandas()
    out = got[got.held_out]
    assert len(out) and out.score.sum() > out.base_score.sum()
    assert suffix_states.scored(frame(spark, []), F.lit(False)).collect() == []


def test_suffix_tree_leaves_no_rare_context_out(spark):
    """By default all contexts are judged by what they gain, however rare and however large the corpus."""
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(60))) for i in range(300)] + [(1000 + i, f"rare{i % 40} phrase{i % 40} comes{i % 40} back{i % 40}") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda *cut: {x["doc_id"]: x["score"] for x in suffix_states.scored(df, F.lit(False), *cut).collect()}
    got, every = scores(), scores(0.0, 1)
    assert all(math.isclose(got[i], every[i]) for i, _ in rows)
    assert all(got[i] > scores_few + 1 for few in [scores(0.0, 8)] for i, scores_few in few.items() if i >= 1000)
