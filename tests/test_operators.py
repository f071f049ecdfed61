"""Small cases with known results, and randomised ones against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import distributions as di
from spanweave.functions import emissions as em
from spanweave.functions import hmm, mixture, special
from spanweave.functions import hypothesis_tests as ts
from spanweave.operators import coverage, enrichment, frame, intervals, methylome, nearest, prefix, search, transcripts


def ranges(spark, rows, chrom="chr1", strand="+"):
    return spark.createDataFrame([(chrom, strand, a, b) for a, b in rows], "chrom string, strand string, start long, stop long")


def spans(df, a="start", b="stop"):
    return sorted((r[a], r[b]) for r in df.collect())


def test_inner_merge(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "x int, y int, z string")
    b = spark.createDataFrame([(3, 3), (4, 4), (5, 5)], "x int, y int")
    out = frame.merge_inner("x", a, b)
    assert out.columns == ["y1", "z", "y2", "x"] and [tuple(r) for r in out.collect()] == [(3, "c", 3, 3)]


def test_outer_merge(spark):
    a = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "c")], "x int, y int, z string")
    b = spark.createDataFrame([(5, 5), (4, 4), (3, -3)], "x int, y int")
    got = [tuple(r) for r in frame.merge_outer("x", a, b).collect()]
    assert got == [(1, "a", 0, 1), (2, "b", 0, 2), (3, "c", -3, 3), (0, None, 4, 4), (0, None, 5, 5)]


def test_duplicate_keys_are_an_error(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    with pytest.raises(ValueError, match="duplicate"):
        frame.merge_inner("x", a, a)


def test_merge_complement_subtract_intersect(spark):
    r = ranges(spark, [(4, 6), (4, 9), (4, 7), (6, 10)])
    assert spans(intervals.merged(r)) == [(4, 10)]
    u = spark.createDataFrame([("chr1", "+", 100)], "chrom string, strand string, length long")
    gaps = lambda x: spans(intervals.complement(intervals.merged(ranges(spark, x)), u))
    assert gaps([(0, 2), (4, 6), (10, 100)]) == [(2, 4), (6, 10)]
    assert gaps([(3, 6), (14, 16), (40, 90)]) == [(0, 3), (6, 14), (16, 40), (90, 100)]
    assert gaps([(0, 100)]) == []
    empty = ranges(spark, [(1, 2)]).where("false")
    assert spans(intervals.complement(intervals.merged(empty), u)) == [(0, 100)]
    whole = ranges(spark, [(0, 100)]).withColumn("id", F.lit(1))
    assert spans(intervals.subtract(whole, ranges(spark, [(20, 40)]), "id")) == [(0, 20), (40, 100)]
    assert spans(intervals.intersections(ranges(spark, [(0, 40), (50, 100)]), ranges(spark, [(20, 70)])), "i_start", "i_stop") == [(20, 40), (50, 70)]


def test_overlap_metrics(spark):
    a, b = ranges(spark, [(5, 10), (6, 11), (20, 21)]), ranges(spark, [(9, 12), (20, 21)])
    number = lambda x, y: intervals.overlap_number(x, y).first()[0]
    assert number(intervals.merged(a), intervals.merged(b)) == 2 and number(a, b) == 3
    a = intervals.merged(ranges(spark, [(5, 15), (6, 11), (18, 21), (22, 23), (23, 24), (26, 28)]))
    b = intervals.merged(ranges(spark, [(6, 7), (9, 12), (20, 26), (30, 36)]))
    assert number(a, b) == 3 and intervals.overlap_fraction(a, b).first()[0] == 0.75


def test_runs_of_bits(spark):
    pos = lambda p: spark.createDataFrame([("c", x) for x in p], "chrom string, pos long")
    assert spans(intervals.runs(pos([1, 2, 3, 4, 10, 15, 17, 30, 35, 40]), ("chrom",), "pos", 5)) == [(1, 18), (30, 41)]
    assert spans(intervals.runs(pos([1, 2, 4, 5]), ("chrom",), "pos", 0)) == [(1, 3), (4, 6)]
    assert spans(intervals.runs(pos([1, 2, 4, 5]), ("chrom",), "pos", 1)) == [(1, 6)]


def test_range_join_with_all_sizes(spark):
    r = random.Random(4)
    make = lambda n: [(s, s + r.choice([0, 1, 40, 3000, 70000, 5_000_000])) for s in (r.randrange(9_000_000) for _ in range(n))]
    a, b = make(150), make(150)
    da, db = (ranges(spark, x).withColumn("id", F.monotonically_increasing_id()) for x in (a, b))
    got = sorted((x.start, x.stop, x.b_start, x.b_stop) for x in intervals.range_join(da, db).collect())
    assert got == sorted((*x, *y) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
    inside = sorted((x.start, x.stop, x.b_start, x.b_stop) for x in intervals.range_join(da, db, how="within").collect())
    assert inside == sorted((*x, *y) for x in a for y in b if y[0] <= x[0] and x[1] <= y[1])


def test_prefix_scan_over_tiles(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(100), i, r.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x long, i long, v long").withColumn("t", F.expr("x div 10"))
    got = {x.i: x.m for x in prefix.prefix(df, ["k"], "t", [F.col("x"), F.col("i")], F.col("v"), "m", "max").collect()}
    for k, x, i, _ in rows:
        before = [v for kk, xx, ii, v in rows if kk == k and (xx, ii) < (x, i)]
        assert got[i] == (max(before) if before else None)


def test_nearest_takes_ties_from_both_sides(spark):
    q = spark.createDataFrame([("c", 1, 10), ("c", 2, 100), ("d", 3, 5)], "chrom string, id long, mid long")
    p = spark.createDataFrame([("c", 8), ("c", 8), ("c", 12), ("c", 90)], "chrom string, pos long")
    assert sorted((x.id, x.pos, x.distance) for x in nearest.nearest(q, p).collect()) == [(1, 8, 2), (1, 8, 2), (1, 12, 2), (2, 90, 10)]


def test_fragment_size(spark):
    reads = [("+", p) for p in (0, 0, 0, 10, 20)] + [("-", p) for p in (150, 150, 150, 160, 170)]
    tags = spark.createDataFrame([("chr1", s, p) for s, p in reads], "chrom string, strand string, pos long")
    genome = spark.createDataFrame([("chr1", 10_000_000)], "chrom string, length long")
    assert coverage.fragment_size(tags, genome, 20.0).first()[0] == 150


def test_histogram_median(spark):
    hist = lambda x: coverage.histogram(spark.createDataFrame([(v,) for v in x], "v long"), F.col("v"))
    assert coverage.histogram_median(hist([1, 2])).first()[0] == 2
    assert coverage.histogram_median(hist([0, 0, 0, 2, 2, 3, 4, 4, 4, 4, 4])).first()[0] == 3
    assert coverage.histogram_median(hist([1]).where("false")).first()[0] == -1


def test_methylome_frame(spark):
    m = spark.createDataFrame([("c", "+", 100, 0, 1, 10), ("c", "-", 200, 0, 2, 10), ("c", "+", 200, 1, 2, 10)], "chrom string, strand string, pos long, tag int, k int, n int")
    got = sorted((x.pos, x.k, x.n, x.d) for x in methylome.frame(m, None, 0).collect())
    assert got == [(100, 1, 10, 2147483647), (200, 2, 10, 100)]


def test_cpg_classes(spark):
    from spanweave.functions.sequence import cpg_class

    for seq, width, want in (("aaaaaa", 3, "LCP"), ("cccccc", 5, "LCP"), ("ccccgccc", 5, "HCP"), ("ccccgccc", 8, "ICP"), ("cgcgcg", 5, "HCP")):
        assert spark.createDataFrame([(seq,)], "s string").select(cpg_class(width)("s")).first()[0] == want


def test_locus_texts():
    assert [transcripts.parse_locus(x)[0] for x in ("tss500", "tss[500]", "tes[-500..500]", "TSS", "utr3")] == ["tss[-500..500]", "tss[-500..500]", "tes[-500..500]", "tss[-2000..2000]", "utr3"]
    with pytest.raises(ValueError):
        transcripts.parse_locus("promoter")


def test_benjamini_hochberg_and_fisher(spark):
    p = spark.createDataFrame([(0, 0.2), (1, 0.42), (2, 0.8), (3, 0.01)], "id long, p double")
    assert [round(r.q, 6) for r in ts.benjamini_hochberg(p).orderBy("id").collect()] == [0.4, 0.56, 0.8, 0.04]
    t = spark.createDataFrame([(3, 1, 1, 3)], "a int, b int, c int, d int")
    assert round(t.select(ts.fisher("two_sided")("a", "b", "c", "d")).first()[0], 6) == 0.485714


def test_fdr_control_matches_qvalues(spark):
    r = random.Random(3)
    d = spark.createDataFrame([(i, np.log(r.random() ** 4 + 1e-9).item()) for i in range(200)], "id long, logpep double")
    q = ts.pep_qvalues(ts.fdr_control(d, alpha=0.1))
    assert all(x.rejected == (x.q <= 0.1) for x in q.collect())


def test_special_functions():
    assert abs(float(special.digamma(1.0)) + 0.5772156649) < 1e-9 and abs(float(special.trigamma(1.0)) - np.pi**2 / 6) < 1e-9
    assert abs(special.beta_inc(2, 3, 0.4) - 0.5248) < 1e-10


def test_negative_binomial():
    d = di.NegativeBinomial(4.0, 3.0)
    p = np.exp(d.log_probability(np.arange(400)))
    assert abs(p.sum() - 1) < 1e-9 and abs(d.cumulative(5) - p[:6].sum()) < 1e-9
    fit = di.NegativeBinomial.fit(d.sample(40_000, np.random.default_rng(1)))
    assert abs(fit.mean - 4) < 0.1 and abs(fit.failures - 3) < 0.3
    assert abs(di.IntNormal(3.0, 4.0).probability(np.arange(-60, 60)).sum() - 1) < 1e-9


def test_mixture_finds_its_parts(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([rng.poisson(1, 500), rng.poisson(20, 500)])], "x long")
    model, trace = mixture.fit(df, "x", mixture.Mixture((0.5, 0.5), (mixture.Poisson(3), mixture.Poisson(9))))
    assert abs(model.parts[0].rate - 1) < 0.2 and abs(model.parts[1].rate - 20) < 1 and trace == sorted(trace)


def test_hmm_against_all_paths(spark):
    m = hmm.PoissonHmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([1.0, 5.0]), (0, 1))
    x = np.array([0, 1, 6, 4, 0])
    e = m.log_emissions(x)
    paths = {}
    for bits in range(2 ** len(x)):
        s = [bits >> i & 1 for i in range(len(x))]
        paths[tuple(s)] = np.log(m.prior[s[0]]) + e[0, s[0]] + sum(np.log(m.transition[a, b]) + e[i + 1, b] for i, (a, b) in enumerate(zip(s, s[1:])))
    assert abs(m.log_likelihood(x) - np.logaddexp.reduce(list(paths.values()))) < 1e-9
    assert tuple(m.viterbi(x)) == max(paths, key=paths.get)
    states, seen = m.sample(300, np.random.default_rng(2))
    df = spark.createDataFrame([("a" if i < 150 else "b", i, int(v)) for i, v in enumerate(seen)], "k string, i long, v long")
    fitted, trace = hmm.fit(df, "k", "i", "v", hmm.PoissonHmm(np.array([0.5, 0.5]), np.array([[0.7, 0.3], [0.3, 0.7]]), np.array([2.0, 4.0]), (0, 1)), iterations=8)
    assert all(b >= a - 1e-6 for a, b in zip(trace, trace[1:])) and fitted.rates[1] > fitted.rates[0]


def test_placed_ranges_are_apart_and_inside():
    lengths = np.array([5, 10, 3, 20, 8] * 20)
    begin, size, limit, chrom = np.array([100, 0]), np.array([1500, 2000]), np.array([2000, 2000]), np.array([0, 1])
    row, start = enrichment.place(lengths, chrom, begin, size, limit, np.random.default_rng(1), 1000)
    got = sorted(zip(chrom[row], start, start + lengths))
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(got, got[1:]))
    assert all(begin[r] <= s < begin[r] + size[r] and s + k <= limit[r] for r, s, k in zip(row, start, lengths))


def test_search_skips_the_end():
    find = lambda s, p, k: search.find_in(np.frombuffer(s.encode(), np.uint8), search._wanted(p), k).tolist()
    assert find("acgtacgt", "acgt", 0) == [0] and find("acgtacgta", "acgt", 0) == [0, 4] and find("aacttt", "anct", 0) == [0] and find("agttt", "anct", 0) == [] and find("aactta", "anct", 1) == [0, 1]


def test_stream_of_events_matches_batch(spark, tmp_path):
    from spanweave.streaming import binning

    events = spark.range(200).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) as ts", "id % 5 as user_id", "'t' as event_type", "1.5D as value")
    events.write.parquet(str(tmp_path / "in"))
    q = binning.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, binning.tumbling(events).collect()))


def _paths(model, x):
    """All paths of states with their log probabilities, by the definition."""
    with np.errstate(divide="ignore"):
        e, t, p = model.emissions.log_densities(x), np.log(model.transition), np.log(model.prior)
    return {s: p[s[0]] + e[0, s[0]] + sum(t[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(s, s[1:]))) for s in itertools.product(range(len(p)), repeat=len(x))}


def test_blocks_of_hmm_equal_all_paths(spark):
    """Sequences cut into blocks of 2 rows over several partitions, against every path."""
    schemes = (em.Poisson(1.0), em.NegativeBinomial(6.0, 2.0), em.Normal(0.0, 1.0), em.Normal(2.0, 0.5))
    model = hmm.Hmm(np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.2, 0.0], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]]), em.Emissions(schemes, ((0, 2), (1, 2), (1, 3))))
    rng, rows = np.random.default_rng(4), []
    for k, n in (("a", 9), ("b", 1), ("c", 7), (None, 3)):
        rows += [(k, 10 * i, int(rng.poisson(3)), None if i == 4 else float(rng.normal(1, 1))) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, v long, w double")
    got = hmm.predict(df, "k", "at", ["v", "w"], model, block=2).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", "c", None):
        x = np.array([[v, math.nan if w is None else w] for key, _, v, w in rows if key == k], float)
        paths, own = _paths(model, x), sorted((r for r in got if r["k"] == k), key=lambda r: r["at"])
        assert abs(paths[tuple(r["state"] for r in own)] - max(paths.values())) < 1e-9
        whole = np.logaddexp.reduce(list(paths.values()))
        for i, r in enumerate(own):
            assert abs(r["null"] - sum(math.exp(v - whole) for s, v in paths.items() if s[i] == 0)) < 1e-9
    _, trace = hmm.fit(df, "k", "at", ["v", "w"], model, iterations=1, block=2)
    want = sum(np.logaddexp.reduce(list(_paths(model, np.array([[v, math.nan if w is None else w] for key, _, v, w in rows if key == k], float)).values())) for k in ("a", "b", "c", None))
    assert abs(trace[0] - want) < 1e-8


def test_hmm_recovers_constrained_emissions_over_many_tasks(spark):
    truth = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), em.Emissions((em.Poisson(2.0), em.NegativeBinomial(12.0, 3.0)), ((0,), (1,))))
    rng, s, rows = np.random.default_rng(8), 0, []
    for i in range(20_000):
        s = int(rng.choice(2, p=truth.transition[s]))
        rows.append(("one", i, int(rng.poisson(2.0) if s == 0 else rng.poisson(rng.gamma(3.0, 4.0)))))
    df = spark.createDataFrame(rows, "k string, at long, v long")
    held = hmm.blocks(df, "k", "at", ["v"], 1000)
    assert held.count() >= 20 and held.select("head").distinct().count() > 1  # one sequence, many partitions
    start = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.8, 0.2], [0.2, 0.8]]), em.Emissions((em.Poisson(1.0), em.NegativeBinomial(8.0, 1.0)), ((0,), (1,))))
    model, trace = hmm.fit(df, "k", "at", "v", start, threshold=1e-6, iterations=12, block=1000)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(trace, trace[1:]))
    low, high = model.emissions.schemes
    assert abs(low.rate - 2) < 0.2 and abs(high.mean - 12) < 0.8 and 2 < high.failures < 4.5 and abs(model.transition[0, 1] - 0.05) < 0.02


def test_scan_of_products_equals_one_after_the_other():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 65):
        steps = rng.normal(size=(n, 3, 3))
        for plus in (hmm._sum, hmm._top):
            mul, act = hmm._times(plus)
            v, want, m = rng.normal(size=3), [], None
            start = v
            for s in steps:
                v = act(v, s)
                m = s if m is None else mul(m, s)
                want.append(v)
            assert np.allclose(hmm.scan(steps, start, mul, act), want) and np.allclose(hmm.total(steps, mul), m)


def test_blend_over_values_recovers_its_parts(spark):
    rng = np.random.default_rng(3)
    part = rng.random(6000) < 0.4
    a = np.where(part, rng.poisson(rng.gamma(2.0, 10.0, 6000)), rng.poisson(3.0, 6000))
    b = np.where(part, rng.normal(5, 1, 6000), rng.normal(0, 1, 6000)).round(1)
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(a, b)], "a long, b double")
    start = mixture.Blend((0.5, 0.5), em.Emissions((em.Poisson(2.0), em.NegativeBinomial(15.0, 1.0), em.Normal(1.0, 2.0), em.Normal(4.0, 2.0)), ((0, 2), (1, 3))))
    model, trace = mixture.fit_values(df, ["a", "b"], start)
    assert all(y >= x - 1e-9 * abs(x) for x, y in zip(trace, trace[1:]))
    poisson, negative, low, high = model.emissions.schemes
    assert abs(model.weights[1] - 0.4) < 0.03 and abs(poisson.rate - 3) < 0.2 and abs(negative.mean - 20) < 1.5 and 1.6 < negative.failures < 2.5 and abs(low.mean) < 0.1 and abs(high.mean - 5) < 0.1
    got = [r[0] for r in df.select(model.predict("a", "b")).collect()]
    assert np.mean(np.array(got) == part) > 0.97
    shared = mixture.Blend((0.5, 0.5), em.Emissions((em.NegativeBinomial(3.0, 2.0), em.Normal(0.0, 1.0), em.Normal(3.0, 1.0)), ((0, 1), (0, 2))))
    model, trace = mixture.fit_values(df, ["a", "b"], shared, iterations=6)
    assert all(y >= x - 1e-9 * abs(x) for x, y in zip(trace, trace[1:])) and abs(model.emissions.schemes[0].mean - a.mean()) < 1e-6


def test_log_gamma_equals_the_scalar_one():
    x = np.concatenate([np.linspace(1e-3, 30, 3000), [1e2, 1e5, 1e9, 1e15]])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12) and special.lgamma(-0.5) == math.lgamma(-0.5)


def test_registered_permutations_equal_plain_python(spark):
    """The registered query itself: what is seen exactly, simulated metrics by their distribution."""
    from spanweave.plans import catalog_models, derive, registry

    sf, wide = "/root/testdata/sf0.001", catalog_models.WIDE
    got = {r["name"]: r for r in registry.QUERIES["permutation_enrichment"](spark, sf).collect()}
    loci = [(r[0], r[1] * wide, r[1] * wide + r[2] - r[1]) for r in derive.relation(spark, sf, "loci").select("chrom", "start", "stop").collect()]
    sets = {}
    for n, c, a, z in derive.relation(spark, sf, "regions").select("name", "chrom", "start", "stop").collect():
        sets.setdefault(n, {}).setdefault(c, []).append((a * wide, a * wide + z - a))
    sets = {n: {c: np.array(sorted(v)) for c, v in by.items()} for n, by in sets.items()}
    meets = lambda ranges, by: sum(c in by and bool(((by[c][:, 0] < z) & (by[c][:, 1] > a)).any()) for c, a, z in ranges)
    length, names, rng = derive.CHROM_LENGTH * wide, sorted({c for c, _, _ in loci}), np.random.default_rng(5)
    drawn = []
    for _ in range(25):
        at = rng.integers(0, 5 * length, len(loci))
        drawn.append([(f"chr{1 + p // length}", p % length, p % length + z - a) for p, (_, a, z) in zip(at.tolist(), loci)])
    assert set(got) == set(sets) and len(names) == 5
    for n, by in sets.items():
        r, plain = got[n], [meets(d, by) for d in drawn]
        assert r["seen"] == meets(set(loci), by) and r["simulations"] == 1000 and 1000 <= r["above"] + r["below"] <= 2000
        assert abs(r["mean"] - np.mean(plain)) < 5 * np.sqrt(np.var(plain, ddof=1) / 25) and 0.3 < r["variance"] / np.var(plain, ddof=1) < 3
        assert r["p"] == 2 * min(r["above"] + 1, r["below"] + 1) / 1001 and abs(r["median"] - r["mean"]) < 1.5


def test_placement_over_many_stretches(spark, monkeypatch):
    loci = spark.createDataFrame([("a", 0, n) for n in (1, 4, 9, 30) for _ in range(250)], "chrom string, start long, stop long")
    genome = spark.createDataFrame([("a", 2_000_000), ("b", 900_000), ("c", 40)], "chrom string, length long")
    base = spark.createDataFrame([(1, "a", 100, 1_500_000), (2, "b", 0, 900_000), (3, "c", 0, 10)], "id long, chrom string, start long, stop long")
    for each in (50, 10**6):
        units = enrichment._units(loci, base, genome, 3, None, each)
        assert (len(units[3]) > 10) == (each == 50) and units[3].sum() == 1_499_900 + 900_000 + 10
        rows = enrichment.shuffled(loci, base, genome, 3, loci_each=each).collect()
        for sim in range(3):
            own = sorted((r["chrom"], r["start"], r["stop"]) for r in rows if r["sim"] == sim)
            assert sorted(z - a for _, a, z in own) == sorted([1, 4, 9, 30] * 250)
            assert all(x[0] != y[0] or x[2] <= y[1] for x, y in zip(own, own[1:]))
            assert all(z <= {"a": 2_000_000, "b": 900_000, "c": 40}[c] and (c != "a" or 100 <= a < 1_500_000) and (c != "c" or a < 10) for c, a, z in own)
            assert 0.5 < sum(c == "a" for c, _, _ in own) / 625 < 1.5
        sets = spark.createDataFrame([("long", "a", 0, 2_000_000), ("long", "b", 0, 900_000), ("part", "a", 0, 750_000), ("far", "z", 0, 9)], "name string, chrom string, start long, stop long")
        for metric in ("overlap", "intersection_number"):
            got = enrichment.simulated_counts(loci, sets, base, genome, "name", 20, metric, loci_each=each).collect()
            assert {r["set"] for r in got} == {"long", "part"} and all(sum(r["n"] for r in got if r["set"] == s) == 20 for s in ("long", "part"))
            assert all(990 <= r["metric"] <= 1000 if r["set"] == "long" else 200 < r["metric"] < 430 for r in got)


def test_share_is_a_multinomial():
    bases, counts = np.array([5, 0, 3, 2]), np.array([1000, 40])
    dealt = np.stack([enrichment.share(counts, bases, i, [1, 7]) for i in range(4)])
    assert (dealt.sum(axis=0) == counts).all() and (dealt[1] == 0).all() and abs(dealt[0, 0] - 500) < 80


def _cut_at_random(r, rows):
    """Chunks of sequences at any places, single bases among them."""
    out = []
    for i, s in rows:
        cuts = sorted({0, len(s), *r.choices(range(len(s) + 1), k=r.choice([0, 3, 30]))})
        out += [(i, a, s[a:z]) for a, z in zip(cuts, cuts[1:])] or [(i, 0, s)]
    return out


def test_chunks_with_halos_equal_whole_sequences(spark):
    from spanweave.functions import sequence
    from spanweave.operators import chunks

    r = random.Random(6)
    rows = [(i, "".join(r.choices(["acgt", "cg", "at", "cgn"][i % 4], k=r.choice([0, 1, 5, 40, 160])))) for i in range(24)]
    df, cut = spark.createDataFrame(rows, "id long, seq string"), spark.createDataFrame(_cut_at_random(r, rows), "id long, at long, seq string")
    plain = dict(rows)
    for x in chunks.haloed(cut, 7).collect():
        assert x["halo"] == plain[x["id"]][x["at"] + len(x["seq"]) :][:7]
    found = lambda d: sorted(map(tuple, search.search(d, ["acgta", "cgn", "c"], 1).collect()))
    want = sorted((i, p, x, strand) for i, s in rows for p in ("acgta", "cgn", "c") for strand, w in (("+", search._wanted(p)), ("-", search._reverse(p))) for x in range(len(s) - len(p)) if sum(not search._MASK[ord(s[x + j])] & w[j] for j in range(len(p))) <= 1)
    assert found(df) == want and found(chunks.haloed(cut, 5)) == want and found(chunks.haloed(chunks.chunked(df, 3), 5)) == want
    kinds = {x["id"]: x["kind"] for x in df.select("id", sequence.cpg_class(20)("seq").alias("kind")).collect()}
    assert {x["id"]: x["kind"] for x in sequence.cpg_classes(chunks.haloed(cut, 19), 20).collect()} == kinds and set(kinds.values()) >= {None, "HCP", "LCP"}
    bins = {(x["id"], x["bin"]): x["gc"] for x in sequence.gc_bins(df, 10).collect()}
    assert {(x["id"], x["bin"]): x["gc"] for x in sequence.gc_bins_of_chunks(cut, 10).collect()} == bins


@pytest.mark.parametrize("alternative", ["less", "greater", "two_sided"])
def test_fisher_by_recurrence(spark, alternative):
    r = random.Random(2)
    tables = [tuple(r.randint(0, r.choice([1, 5, 40])) for _ in range(4)) for _ in range(300)] + [(0, 0, 0, 0), (3, 3, 3, 3), (2, 4, 5, 7), (10, 0, 0, 10)]
    got = ts.fisher_p(*np.array(tables).T, alternative)
    for (a, b, c, d), p in zip(tables, got):
        total, k, n = a + b + c + d, a + b, a + c
        mass = {x: math.comb(k, x) * math.comb(total - k, n - x) for x in range(max(0, n - total + k), min(n, k) + 1)}
        chosen = [m for x, m in mass.items() if (x <= a if alternative == "less" else x >= a if alternative == "greater" else m <= mass[a] * (1 + 1e-7))]
        assert abs(p - sum(chosen) / math.comb(total, n)) < 1e-10
    big = np.array([[250_000_000, 250_010_000, 250_000_000, 250_000_000], [10, 10**9, 30, 10**9], [5 * 10**8, 10, 10, 5 * 10**8]]).T
    p = ts.fisher_p(*big, alternative)
    z = 250_000_000 - (500_010_000 * 500_000_000) / 1_000_010_000
    sd = math.sqrt(500_010_000 * 500_000_000 / 1_000_010_000**2 * 500_000_000 * 500_010_000 / 1_000_010_000)
    low = 0.5 * math.erfc(-(z + 0.5) / sd / math.sqrt(2))
    assert abs(p[0] - {"less": low, "greater": 1 - low, "two_sided": 2 * min(low, 1 - low)}[alternative]) < 2e-4 and (p[1] < 0.01) == (alternative != "greater") and (p[2] < 1e-300) == (alternative != "less")
    df = spark.createDataFrame([(1, 2, 3, 4), (None, 1, 1, 1)], "a long, b long, c long, d long").select(ts.fisher(alternative)("a", "b", "c", "d").alias("p"))
    assert sum(x["p"] is None for x in df.collect()) == 1


def test_ranks_split_equal_values(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") / 30_000).otherwise(1.0).alias("p"))
    tiles = [x["count"] for x in prefix.ranges(df, ts._up("p", "id"), 8).groupBy("__tile").count().collect()]
    assert len(tiles) == 8 and max(tiles) < 2 * 20_000 / 8
    got = {x["id"]: x["q"] for x in ts.benjamini_hochberg(df).collect()}
    order, low, m = sorted(((r["p"], r["id"]) for r in df.collect()), reverse=True), 1.0, 20_000
    for k, (p, i) in enumerate(order):
        low = min(low, p * m / (m - k))
        assert abs(got[i] - low) < 1e-12


def test_randomized_loci_miss_gaps(spark):
    loci = spark.createDataFrame([(i, "ab"[i % 2], 0, 1 + i % 9) for i in range(200)], "id long, chrom string, start long, stop long")
    genome = spark.createDataFrame([("a", 400), ("b", 90)], "chrom string, length long")
    gaps = spark.createDataFrame([("a", 0, 150), ("b", 40, 41), ("b", 60, 85)], "chrom string, start long, stop long")
    got = enrichment.randomized(loci, genome, gaps).collect()
    assert sorted((r["id"], r["chrom"], r["stop"] - r["start"]) for r in got) == [(i, "ab"[i % 2], 1 + i % 9) for i in range(200)]
    assert all(0 <= r["start"] and r["stop"] <= (400 if r["chrom"] == "a" else 90) for r in got) and {r["strand"] for r in got} == {"+", "-"}
    assert not any(r["start"] < z and a < r["stop"] for r in got for c, a, z in (("a", 0, 150), ("b", 40, 41), ("b", 60, 85)) if c == r["chrom"])
    with pytest.raises(ValueError):
        enrichment.randomized(loci, genome.where("chrom = 'b'").withColumn("length", F.lit(3)), gaps)
    one, two = (sorted(map(tuple, enrichment.sample_locations(spark, genome, 300, 5, gaps=gaps.repartition(n)).collect())) for n in (1, 7))
    assert one == two and len(one) == 300 and all(s[3] - s[2] == 5 for s in one)
    assert not any(s < z and a < e for _, k, s, e, _ in one for c, a, z in (("a", 0, 150), ("b", 40, 41), ("b", 60, 85)) if c == k)


def test_slices_of_rows_and_kinds(spark):
    df = frame.with_row(spark.range(5).withColumn("v", F.lit(1)), "id")
    assert frame.iloc(df, 1, 5, 3).count() == 2 and frame.slice_as(df, "v", "int").count() == 5
    with pytest.raises(Exception, match="slice to 6"):
        frame.iloc(df, 0, 6).collect()
    with pytest.raises(TypeError):
        frame.slice_as(df, "v", "long")


def test_fitter_guesses_and_models_are_stored(spark, tmp_path):
    from spanweave.sources import stores

    rng = np.random.default_rng(12)
    part = rng.random(4000) < 0.3
    rows = [(int(rng.poisson(rng.gamma(3.0, 8.0)) if p else rng.poisson(2.0)), int(rng.poisson(rng.gamma(3.0, 8.0)) if p else rng.poisson(2.0))) for p in part]
    df = spark.createDataFrame(rows, "a long, b long")
    for shared in (True, False):
        model, trace = mixture.BlendFitter(2, shared).fit(df, ["a", "b"], attempts=2)
        assert all(y >= x - 1e-9 * abs(x) for x, y in zip(trace, trace[1:])) and len(model.emissions.schemes) == (2 if shared else 4)
        assert abs(model.weights[1] - 0.3) < 0.04 and abs(model.emissions.schemes[-1].mean - 24) < 2
    with pytest.raises(ValueError):
        mixture.BlendFitter().guess(df.where("a < 0"), ["a"])
    chain = hmm.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), model.emissions)
    for m in (model, chain):
        stores.save_model(spark, m, str(tmp_path / type(m).__name__))
        assert stores.model_text(stores.load_model(spark, str(tmp_path / type(m).__name__))) == stores.model_text(m)


# ---- scans in place of pairs --------------------------------------------------------------


def odd_ranges(spark, seed, n=60):
    """Ranges over several tiles, some empty, inverted, touching or equal, some with a null."""
    rng = random.Random(seed)
    near = lambda: rng.choice((0, 65_530, 131_070, 400_000)) + rng.randrange(30)
    rows = [(i, rng.choice(("c1", "c2")), rng.choice("+-"), p := near(), p + rng.choice((-4, 0, 0, 3, 9, 70_000)), rng.choice("xyz")) for i in range(n)]
    rows += [(n, None, "+", 0, 90, "x"), (n + 1, "c1", "+", None, 90, "y"), (n + 2, "c1", "+", 0, None, None), (n + 3, "c1", "+", 0, 20, None), (n + 3, "c1", "+", 0, 20, None)]
    return rows, spark.createDataFrame(rows, "id long, chrom string, strand string, start long, stop long, name string")


def meets(a, b):
    return None not in a[:5] and None not in b[:5] and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4]


def no_pairs(df):
    """Whether the plan joins no bins of ranges."""
    return "bin#" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_is_a_scan(spark):
    for seed in range(3):
        (x, a), (y, b) = odd_ranges(spark, seed), odd_ranges(spark, seed + 10)
        got = intervals.overlapping(a, b)
        assert no_pairs(got) and got.columns == a.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in x if any(meets(r, s) for s in y))


def test_fraction_and_numbers_are_scans(spark):
    (x, a), (y, b) = odd_ranges(spark, 3), odd_ranges(spark, 13)
    met = sum(any(meets(r, s) for s in y) for r in x)
    for got, want in ((intervals.overlap_number(a, b), met), (intervals.overlap_fraction(a, b), met / len(x))):
        assert no_pairs(got) and got.first()[0] == want


def test_overlapping_widened_and_on_both_strands(spark):
    (x, a), (y, b) = odd_ranges(spark, 4), odd_ranges(spark, 14)
    wide = [(*r[:3], None if r[3] is None else max(r[3] - 7, 0), None if r[4] is None else r[4] + 7) for r in x]
    got = intervals.overlapping(a.where("start IS NOT NULL"), b, 7)
    assert no_pairs(got) and sorted(r["id"] for r in got.collect()) == sorted(r[0] for r, w in zip(x, wide) if any(meets(w, s) for s in y))
    plus = lambda rows: [(r[0], r[1], "+", *r[3:]) for r in rows]
    got = intervals.overlapping(a, b, keys=("chrom",))
    assert no_pairs(got) and sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in plus(x) if any(meets(r, s) for s in plus(y)))


def test_metric_matrix_is_a_scan(spark, monkeypatch):
    (x, a), (y, b) = odd_ranges(spark, 5), odd_ranges(spark, 15)
    want = {(m, n): sum(any(meets(r, s) for s in y if s[5] == n) for r in x if r[5] == m) if m and n else 0 for m in ("x", "y", "z", None) for n in ("x", "y", "z", None)}
    for batch in (32, 2):
        monkeypatch.setattr(intervals, "_SETS", batch)
        got = intervals.metric_matrix(a.withColumnRenamed("name", "p"), b.withColumnRenamed("name", "q"), "p", "q")
        assert no_pairs(got) and {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_common_length_is_additive_without_pairs(spark):
    (_, a), (_, b) = odd_ranges(spark, 6), odd_ranges(spark, 16)
    a, b = (d.where("start <= stop") for d in (a, b))
    got = intervals.common_length(a, b)
    want = {tuple(r) for r in intervals.additive(a, b, F.col("i_stop") - F.col("i_start")).collect()}
    assert no_pairs(got) and want and {tuple(r) for r in got.collect()} == want


def test_overlap_per_locus_counts_without_pairs(spark):
    for seed, fair in ((7, True), (8, False)):
        (x, a), (y, b) = odd_ranges(spark, seed), odd_ranges(spark, seed + 10)
        if fair:  # no empty or inverted ranges, which are paired
            x, y = ([r for r in rows if None not in r[:5] and r[3] < r[4]] for rows in (x, y))
            a, b = a.dropna(subset=["chrom", "start", "stop"]).where("start < stop"), b.dropna(subset=["chrom", "start", "stop"]).where("start < stop")
        got = enrichment.overlap_per_locus(a, b)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((r[0], r[1], r[3], r[4], sum(meets(r, s) for s in y))) for r in x)
        by = enrichment.overlap_per_locus(a, b, set_col="name")
        assert sorted(map(str, map(tuple, by.collect()))) == sorted(str((r[0], r[1], r[3], r[4], n, sum(meets(r, s) and s[5] == n for s in y))) for r in x for n in "xyz")
        assert not fair or no_pairs(got) and no_pairs(by)


def test_crowded_places_and_their_counts(monkeypatch):
    """A third of the background taken; counts of sets, empty ranges among them, against plain Python."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 40, 2000)
    chrom, begin, size = np.array([1, 0, 0]), np.array([0, 60_000, 0]), np.array([60_000, 20_000, 40_000])
    at, who = enrichment.places(lengths, chrom, begin, size, np.array([60_000, 80_000, 80_000]), rng, 1000)
    stop = at + lengths[who]
    assert sorted(who) == list(range(2000)) and (at[1:] >= stop[:-1]).all()
    start, on = at & ((1 << enrichment._APART) - 1), at >> enrichment._APART
    assert all(s + n <= (60_000 if c else 80_000) and (c or not 40_000 <= s < 60_000) for s, n, c in zip(start, lengths[who], on))
    rows = [{"set": f"s{k % 3}", "chrom": rng.choice(["a", "b", "far"]), "start": int(p), "stop": int(p + n)} for k, (p, n) in enumerate(zip(rng.integers(0, 80_000, 300), rng.integers(0, 200, 300)))]
    want = {n: sum(any(r["set"] == n and r["chrom"] == "ab"[c] and r["start"] < s + k and s < r["stop"] for r in rows) for c, s, k in zip(on, start, lengths[who])) for n in ("s0", "s1", "s2")}
    for cells in (1 << 22, 1):
        monkeypatch.setattr(enrichment, "_CELLS", cells)
        index = enrichment._Index(pa.array([rows])[0], np.array(["a", "b"], object))
        assert dict(index.counts(on, start, start + lengths[who], False)) == want and len(index.blocks) == (1 if cells > 1 else 3)


def test_points_in_ranges(spark):
    """Pairs against plain Python; bins follow the ranges' size, so most points of a bin are in them."""
    rng = random.Random(5)
    spans_ = [(i, rng.choice("ab"), p := rng.randrange(60_000), p + rng.choice((0, -3, 1, 700, 6_000, 50_000))) for i in range(80)] + [(80, None, 0, 9), (81, "a", None, 9)]
    points = [(rng.choice("ab"), rng.randrange(100_000), i) for i in range(300)] + [(None, 3, 300), ("a", None, 301)]
    a, b = spark.createDataFrame(spans_, "id long, chrom string, start long, stop long"), spark.createDataFrame(points, "chrom string, pos long, n long")
    want = sorted((i, n) for i, c, x, y in spans_ for d, p, n in points if None not in (c, x, p) and c == d and x <= p < y)
    for size in (1, 6_000, 1 << 20):
        assert sorted((r["id"], r["b_n"]) for r in nearest.holding(a, b, size).collect()) == want
    text = nearest.holding(a, b, 6_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright(start#" in text.replace("cast(", "").lower() and ", 11)" in text


def test_basal_domains_are_looked_up(spark, monkeypatch):
    """Midpoints without a domain are found by a scan; the pairs are made once, by strand."""
    made = []
    real = nearest.within_distance
    monkeypatch.setattr(nearest, "within_distance", lambda q, p, low, high, **more: made.append((low, high)) or real(q, p, low, high, **more))
    loci = spark.createDataFrame([(i, "c", m, m + 2) for i, m in enumerate((0, 4_999, 5_000, 5_001, 20_000, 23_999, 24_001, 25_001, 90_000))], "id long, chrom string, start long, stop long")
    tss = spark.createDataFrame([("c", 10_000, 1, "+"), ("c", 20_000, 2, "-")], "chrom string, pos long, tid long, t_strand string")
    got = sorted(tuple(r) for r in nearest.associated_basal(loci, tss).collect())
    basal = [(i, t) for i, m in enumerate((1, 5_000, 5_001, 5_002, 20_001, 24_000, 24_002, 25_002, 90_001)) for p, t, low, high in ((10_000, 1, 1_000, 5_000), (20_000, 2, 5_000, 1_000)) if m - low <= p <= m + high]
    assert made == [(1_000, 5_000), (5_000, 1_000)] and [x for x in got if x[0] in {i for i, _ in basal}] == sorted(basal)
    assert {x[0] for x in got} == set(range(9))
