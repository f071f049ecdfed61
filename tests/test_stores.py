"""Stored tables, models and matrices; paths, bits, augmented frames, sampling around gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.functions import hmm as hm
from spanweave.functions import mixture as mx
from spanweave.functions import text as tx
from spanweave.operators import enrichment as en
from spanweave.operators import frame as fr
from spanweave.operators import intervals as iv
from spanweave.operators import transcripts as tr
from spanweave.sources import stores


def test_store_checks_kind_version_and_chromosomes(spark, tmp_path, monkeypatch):
    tags = spark.createDataFrame([("1", "+", 5), ("1", "-", 7), ("2", "+", 1)], "chrom string, strand string, pos long")
    path = str(tmp_path / "tags")
    stores.write_store(tags, path, "tags", fragment=150)
    rows, about = stores.read_store(spark, path, "tags", ["1"])
    assert sorted(map(tuple, rows.select("chrom", "strand", "pos").collect())) == [("1", "+", 5), ("1", "-", 7)] and about == {"fragment": 150}
    with pytest.raises(ValueError):
        stores.read_store(spark, path, "tags", ["1", "3"])
    assert stores.read_store(spark, path, "tags", ["1", "3"], strict=False)[0].count() == 2
    with pytest.raises(ValueError):
        stores.read_store(spark, path, "methylome")
    monkeypatch.setitem(stores.STORES, "tags", (5, stores.STORES["tags"][1]))
    with pytest.raises(ValueError):
        stores.read_store(spark, path, "tags")


def test_empty_store(spark, tmp_path):
    none = spark.createDataFrame([], "chrom string, strand string, pos long")
    stores.write_store(none, str(tmp_path / "none"), "tags")
    assert stores.read_store(spark, str(tmp_path / "none"), "tags")[0].count() == 0


def test_models_come_back_as_they_were(spark, tmp_path):
    mixture = mx.Mixture((0.3, 0.7), (mx.Poisson(2.5), mx.Normal(1.0, 4.0)))
    stores.save_model(spark, mixture, str(tmp_path / "m"))
    assert stores.load_model(spark, str(tmp_path / "m")) == mixture
    chain = hm.PoissonHmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([1.0, 6.0]), (0, 1))
    back = stores.model_of(stores.model_text(chain))
    assert back.emission_of == (0, 1) and (back.transition == chain.transition).all() and (back.rates == chain.rates).all()
    text = stores.model_text(mixture)
    for bad in (text.replace('"version": 1', '"version": 2'), text.replace("Mixture", "Other")):
        with pytest.raises(ValueError):
            stores.model_of(bad)


def test_sampled_mixture_and_states_follow_the_model():
    rng = np.random.default_rng(1)
    part, x = mx.Mixture((0.25, 0.75), (mx.Poisson(1.0), mx.Normal(50.0, 1.0))).sample(4000, rng)
    assert abs((part == 1).mean() - 0.75) < 0.03 and abs(x[part == 0].mean() - 1) < 0.1 and abs(x[part == 1].mean() - 50) < 0.1
    chain = hm.PoissonHmm(np.array([0.6, 0.4]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([1.0, 3.0]), (0, 1))
    x = np.array([0, 2, 3, 1, 4])
    drawn = np.stack([chain.sample_states(x, rng) for _ in range(4000)])
    assert np.abs((drawn == 0).mean(axis=0) - chain.posterior(x)[:, 0]).max() < 0.03
    assert len(chain.sample_states(np.array([]), rng)) == 0


def test_matrix_file(spark, tmp_path):
    values = spark.createDataFrame([("a,1", "x", 2), ("a,1", "y", 0), ("b", "x", 5), ("b", "y", 7)], "a string, b string, value long")
    a, b = spark.createDataFrame([("a,1", 3), ("b", 9)], "a string, merged long"), spark.createDataFrame([("x", 4)], "b string, merged long")
    stores.write_matrix(values, a, b, str(tmp_path / "m.csv"))
    got = sorted(map(tuple, stores.read_matrix(spark, str(tmp_path / "m.csv")).collect()))
    assert got == [("a,1", "x", 2.0, 3, 4), ("a,1", "y", 0.0, 3, 0), ("b", "x", 5.0, 9, 4), ("b", "y", 7.0, 9, 0)]


def test_paths(spark):
    p = F.col("p")
    df = spark.createDataFrame([("/a/x.bed.GZ",), ("x.tar",), ("/a.b/none",), ("/q/.hidden",), ("__A  b__.txt",), (None,)], "p string")
    rows = df.select(tx.stem(p), tx.stem(p, True), tx.extension(p), tx.path_safe(p)).collect()
    assert [tuple(r)[:3] for r in rows[:4]] == [("x.bed", "x", "GZ"), ("x", "x", "tar"), ("none", "none", ""), ("", "", "hidden")]
    assert rows[4][3] == "a_b.txt" and tuple(rows[5]) == (None,) * 4
    assert df.sparkSession.range(1).select(tx.short_digest(F.lit("a"))).first()[0] == "#86f7e"


def test_bits_outside_are_an_error(spark):
    bits = spark.createDataFrame([(1,), (1,), (3,)], "pos long")
    assert sorted(r[0] for r in iv.bits_joined(iv.bits_set(bits, 4), 4, bits).collect()) == [1, 3, 5, 5, 7]
    with pytest.raises(Exception, match="no such bit"):
        iv.bits_set(bits, 3).collect()


def test_cells_ratios_and_equality(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 3, 0), (2, 0, 0), (3, None, 1)], "_row long, a int, b int")
    assert fr.cell(df, 1, "a") == 3
    with pytest.raises(IndexError):
        fr.cell(df, 9, "a")
    got = [r[0] for r in df.orderBy("_row").select(fr.ratio(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [0.5, math.inf] and math.isnan(got[2]) and got[3] is None
    assert fr.same(df, df.orderBy(F.desc("_row"))) and not fr.same(df, df.where("_row < 3")) and not fr.same(df, df.withColumn("a", F.col("a").cast("long")))
    assert not fr.same(df.unionAll(df), df)
    assert dict(fr.doubles(df, "a").dtypes)["a"] == "double"
    with pytest.raises(TypeError):
        fr.doubles(df.withColumn("s", F.lit("x")), "s")


def test_binomial_step_is_seeded_and_has_its_mean(spark):
    df = spark.range(4000).select(F.col("id").alias("_row"), (F.col("id") % 2).alias("state"))
    step = fr.with_binomial("k", "n", F.lit(9), (0.2, 0.7), seed=3)
    out = df.transform(fr.chained(step)).persist()
    assert out.agg(F.min("n"), F.max("n")).first()[:] == (10, 10)
    means = {r[0]: r[1] for r in out.groupBy("state").agg(F.avg("k")).collect()}
    assert abs(means[0] - 2) < 0.12 and abs(means[1] - 7) < 0.12
    assert fr.same(out, df.repartition(7).transform(step).select(*out.columns))
    assert df.limit(1).withColumn("state", F.lit(None).cast("long")).transform(step).first()["k"] is None


def test_samples_keep_out_of_gaps(spark):
    genome = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 5)], "chrom string, length long")
    gaps = spark.createDataFrame([("a", 0, 300), ("a", 500, 940), ("b", 10, 20), ("a", 940, 1000)], "chrom string, start long, stop long")
    got = en.sample_locations(spark, genome, 2000, 20, seed=2, gaps=gaps).collect()
    assert len(got) == 2000 and {r.chrom for r in got} == {"a", "b"} and {r.strand for r in got} == {"+", "-"}
    for r in got:
        assert r.stop - r.start == 20 and (300 <= r.start <= 480 if r.chrom == "a" else 20 <= r.start <= 80)
    share = sum(r.chrom == "a" for r in got) / 2000
    assert abs(share - 181 / (181 + 61)) < 0.04
    with pytest.raises(ValueError):
        en.sample_locations(spark, genome, 5, 20, gaps=spark.createDataFrame([("a", 0, 1000), ("b", 0, 100)], "chrom string, start long, stop long"))


def test_descriptions(spark):
    t = spark.createDataFrame([(1, "g"), (2, "h")], "tid long, gid string")
    d = spark.createDataFrame([("g", "old"), ("g", "one"), ("h", "")], "name string, description string")
    assert sorted(map(tuple, tr.described(t, d).select("tid", "description").collect())) == [(1, "one"), (2, None)]


def test_enrichment_metrics(spark):
    loci = spark.createDataFrame([("a", 10, 30), ("a", 50, 60)], "chrom string, start long, stop long")
    sets = spark.createDataFrame([("whole", "a", 0, 500), ("whole", "a", 500, 1000), ("two", "a", 12, 15), ("two", "a", 20, 22), ("none", "b", 0, 9)], "name string, chrom string, start long, stop long")
    genome = spark.createDataFrame([("a", 1000), ("b", 20)], "chrom string, length long")
    base = spark.createDataFrame([(1, "a", 0, 1000)], "id long, chrom string, start long, stop long")
    for metric, two in (("overlap", 1), ("intersection_number", 2)):
        got = {r["name"]: r for r in en.permutation_test(loci, sets, base, genome, simulations=19, metric=metric).collect()}
        assert got["two"]["seen"] == two and got["none"]["seen"] == 0 and got["none"]["mean"] == 0 and got["none"]["above"] == 19
    assert got["whole"]["seen"] == 2 and got["whole"]["median"] in (2, 3)
    with pytest.raises(ValueError):
        en.permutation_test(loci, sets, base, genome, metric="length")
    with pytest.raises(ValueError):
        en.permutation_test(loci, sets, base, genome, simulations=0)
    named, strand = loci.withColumn("id", F.col("start")).withColumn("strand", F.lit("+")), sets.withColumn("strand", F.lit("+"))
    each = {(r["id"], r["name"]): r["metric"] for r in en.overlap_per_locus(named, strand, set_col="name").collect()}
    assert each == {(10, "whole"): 1, (10, "two"): 2, (10, "none"): 0, (50, "whole"): 1, (50, "two"): 0, (50, "none"): 0}
    assert en.overlap_per_locus(named, strand.where("false"), set_col="name").isEmpty()


def test_store_of_many_sequences_has_few_files(spark, tmp_path):
    """Files follow the rows, not the number of sequences; stores with a folder for each are read as before."""
    rows = spark.range(3000).selectExpr("concat('s', id div 2) AS chrom", "if(id % 2 = 0, '+', '-') AS strand", "id AS pos")
    stores.write_store(rows, path := str(tmp_path / "tags"), "tags")
    assert len(list((tmp_path / "tags" / "rows").rglob("*.parquet"))) <= 8
    assert fr.same(stores.read_store(spark, path, "tags")[0], rows)
    assert sorted(map(tuple, stores.read_store(spark, path, "tags", ["s7", "s1499"])[0].collect())) == [("s1499", "+", 2998), ("s1499", "-", 2999), ("s7", "+", 14), ("s7", "-", 15)]
    small = rows.where("pos < 6")
    small.write.mode("overwrite").partitionBy("chrom", "strand").parquet(f"{path}/rows")
    assert sorted(r["pos"] for r in stores.read_store(spark, path, "tags", ["s1"])[0].collect()) == [2, 3]
