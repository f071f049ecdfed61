"""SimHash near duplicates, found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves.  If two fingerprints differ in at most two
bits, one half differs in at most one.  So each half is indexed as it is, and in 32 variants
with one bit masked out; fingerprints that meet in a bucket are candidates and are verified
by the count of differing bits.  Equal fingerprints are one node from the start, so a group
of exact copies costs one signature set whatever its size.

The pipeline stage links texts by the Jaccard similarity of their sets of five-word shingles.
SimHash links of those shingles come first, each verified by its exact similarity; an index of
prefixes of the sets adds the pairs that two bits don't reach, so that none is missed.  Pairs
of the index whose bitmaps of parities differ in too many bits can't be similar and are not made;
bitmaps as wide as a set is large part most others before sets are compared.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, partitions, small_batches, staged, table, utf8
from .graph import connected_components

SEED = 42
WORDS = 3
#: A bucket with more distinct fingerprints is not compared in pairs: it is re-indexed by
#: variants that imply a link, and its members are tied to one of them (same components).
BUCKET = 64
#: The pipeline stage compares sets of shingles of this many words.
STAGE_WORDS = 5
#: Texts whose shingles are counted to order them, and counted shingles kept; both save work only.
SAMPLE, COMMON = 8000, 100_000
#: Sets after a set in a bucket, and of those in all its buckets, that it is compared with before
#: its component is known; all others that fit are compared after that, unless they are in its
#: component by then.
AHEAD, BESIDE = 4, 8
#: Texts whose sets go back to Spark at a time.
BATCH = 500
#: Bits of the bitmap that bounds the shingles two sets don't share.
BITS = 512
#: Input bytes for each partition of the prefix index; most rows of a broadcast side.
PARTITION, SMALL = 24 << 20, 1_000_000


def _hashes(text: bytes, words: int) -> np.ndarray:
    w = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(w) - words + 1)


def _majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; taken in blocks, so long texts stay small."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a UTF-8 text; 0 if it has no words."""
    h = _hashes(text, words)
    return _majority(h) if len(h) else 0


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, th) for each row of (doc_id, text); th is a hash of the text."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(1))
            raw = data.tobytes()
            out = [fingerprint(raw[at[i] : at[i + 1]], words) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64()), b.column(2)], ["doc_id", "fp", "th"])

    return id_text(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, th long")


def _signatures(d: DataFrame) -> DataFrame:
    """(k, fp): both halves as they are (j = 32) and with bit j masked out."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    keys = []
    for seg, half in ((0, low), (1, high)):
        for j in range(33):
            kept = half if j == 32 else half.bitwiseAND(0xFFFFFFFF ^ (1 << j))
            keys.append(kept + F.lit((seg * 33 + j) << 32))
    spread = d.repartition(partitions(d.sparkSession), "fp")  # few small files become 66 rows each
    return spread.select("fp", F.explode(F.array(*keys)).alias("k"))


def links(d: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges whose components are those of "at most two bits differ", for distinct `fp`.

    Cold buckets give each verified pair.  In a hot bucket each fingerprint gets finer
    variants (two bits of the other half masked, or one where this half has a masked bit);
    sharing such a variant implies a link, so tying all to the least member loses none.
    """
    sig = _signatures(d).repartition(partitions(d.sparkSession), "k")
    met = staged(sig.withColumn("n", F.count("*").over(Window.partitionBy("k"))).where("n > 1"), "signatures")
    kind = F.shiftright("k", 32)  # seg * 33 + j
    bit = F.when(kind >= 33, kind - 33 + 32).otherwise(kind).cast("int")
    cold = met.where(F.col("n") <= bucket).select("k", "fp", F.pmod(kind, F.lit(33)).alias("j"), bit.alias("bit"))
    other = cold.select("k", F.col("fp").alias("gp"))
    apart = F.col("fp").bitwiseXOR(F.col("gp"))
    pairs = (
        cold.join(other, "k")
        .where((F.col("fp") < F.col("gp")) & (F.bit_count(apart) <= 2))
        .where((F.col("j") == 32) | (F.call_function("shiftrightunsigned", apart, "bit").bitwiseAND(1) == 1))
        .select(F.col("fp").alias("u"), F.col("gp").alias("v"))
    )
    hot = met.where(F.col("n") > bucket).select("k", "fp", F.pmod(kind, F.lit(33)).alias("j"), F.when(kind >= 33, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32)).alias("o"))
    two = [(1 << a) | (1 << b) for a in range(32) for b in range(a)]
    one = [1 << a for a in range(32)]
    variants = F.when(F.col("j") == 32, F.array(*[F.lit(m) for m in two])).otherwise(F.array(*[F.lit(m) for m in one]))
    fine = hot.select("k", "fp", "o", F.explode(variants).alias("mask")).select("k", "mask", F.col("o").bitwiseAND(F.bitwise_not("mask")).alias("o"), "fp")
    least = fine.groupBy("k", "mask", "o").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = fine.join(least, ["k", "mask", "o"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionAll(stars).distinct()


def simhash_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id, component, th) for each row of documents.

    component_id is the smallest doc_id that can be reached over links of at most two
    differing bits.  Texts without words share fingerprint 0 and link like any other.  A null
    doc_id is never a component's name unless all of its rows have one; `component` tells such
    components apart, and th is a hash of the text.
    """
    fps = staged(fingerprints(docs, words), "fingerprints")
    d = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comp = staged(connected_components(links(d)), "components")
    named = d.join(comp, d.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = named.join(least, "component").select("fp", "component", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id", "component", "th")


def fp_hex(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of documents; null and empty texts have fingerprint
    zero and are linked like any other; null ids and repeated rows as in simhash_components;
    long texts are read whole; no documents give no rows."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fp_hex().alias("fingerprint"), "component_id")


def _shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order; a shorter text is one shingle."""
    return np.unique(_hashes(text, STAGE_WORDS))


def _bitmap(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each hash mod `bits` whether an odd number of the set's hashes fall there, as longs.
    Each shingle that only one of two sets has flips one bit, so bitmaps differ in at most as
    many bits as the sets differ in shingles."""
    odd = np.bincount((h % bits).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _wide(h: np.ndarray) -> np.ndarray:
    """A bitmap of two bits for each shingle or more, of a power of two, so that it stays sparse
    for sets of any size; halves xored are the bitmap of half the size."""
    return _bitmap(h, max(BITS, 1 << (2 * len(h) - 1).bit_length()))


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) if len(h) else 0


def _texts(batch: pa.RecordBatch, column: int):
    at, data = utf8(batch.column(column))
    raw = data.tobytes()
    return (raw[at[i] : at[i + 1]] for i in range(batch.num_rows))


def _rows(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that a sample of the texts repeats, by hash."""

    def run(parts):
        for b in parts:
            for t in _texts(b, 1):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t).view(np.int64))], ["h"])

    some = id_text(docs).sample(min(1.0, SAMPLE / max(docs.count(), 1)), SEED)
    got = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).collect()
    h, c = np.array([r.h for r in got], np.int64).view(np.uint64), np.array([r.c for r in got], np.int64)
    return h[np.argsort(h)], c[np.argsort(h)]


def _reach(n):
    """How many shingles of a set are indexed: two sets with a similarity of at least 4/5 share
    at least 4/5 of the places of either, so one of these whatever the order is."""
    return n - (4 * n + 4) // 5 + 1


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n, sim, th, bits, first, wide) for each row: fp names the set of its n shingles,
    sim is the SimHash of the shingles, th a hash of the text, bits and wide the set's bitmaps.

    first has the shingles to index, rare ones before common ones; the order is one for all
    sets and saves work only.  It and the bitmaps are null for copies that a task has met already.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_common(docs))  # at most COMMON pairs of numbers

    def run(parts):
        common, counts = shared.value
        seen: set[int] = set()
        for b in parts:
            out = []
            for t in _texts(b, 1):
                all_h = _hashes(t, STAGE_WORDS)
                h, first, bits, wide, fp = np.unique(all_h), None, None, None, 0
                if len(h) and (fp := _set_id(h)) not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(fp)
                    order = np.arange(len(h))
                    if len(common):
                        i = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        order = np.where(common[i] == h, counts[i], 0).argsort(kind="stable")
                    first, bits, wide = h[order[: _reach(len(h))]].view(np.int64), _bitmap(h), _wide(h)
                out.append((fp, len(h), _majority(all_h) if len(h) else 0, bits, first, wide))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            fp, n, sim, bits, first, wide = (pa.array([o[c] for o in out], t) for c, t in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([b.column(0), fp, n, sim, b.column(2), bits, first, wide], ["doc_id", "fp", "n", "sim", "th", "bits", "first", "wide"])

    return _rows(docs).mapInArrow(run, "doc_id long, fp long, n int, sim long, th long, bits array<long>, first array<long>, wide array<long>")


def _fits(n: str, i: str, m: str, j: str):
    """Whether sets of n and m shingles whose first common one has the places i and j can share
    enough: that one, and at most what follows it in either.  Each similar pair fits there."""
    return F.expr(f"5 * least({n}, {m}) >= 4 * greatest({n}, {m}) AND 9 * least({n} - {i}, {m} - {j}) >= 4 * ({n} + {m})")


def _near_bits(n: str, a: str, m: str, b: str):
    """Whether bitmaps a and b let sets of n and m shingles be similar: a similarity of at least
    4/5 leaves at most a ninth of n + m that one of them has alone."""
    apart = " + ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(BITS // 64))
    return F.expr(f"9 * ({apart}) <= {n} + {m}")


def _index(fps: DataFrame, parts: int) -> DataFrame:
    """(k, fp, n, i): the indexed shingles k of each set, at place i, without those that one set
    alone has."""
    dealt = fps.where("first IS NOT NULL").select("fp", "n", F.posexplode("first").alias("i", "k")).repartition(parts, "k")
    one = dealt.groupBy("k", "fp").agg(F.first("n").alias("n"), F.first("i").alias("i"))  # dealt by k already: no shuffle
    w = Window.partitionBy("k")
    return one.withColumns({"least": F.min("fp").over(w), "most": F.max("fp").over(w)}).where("least <> most").drop("least", "most")


def _beside(met: DataFrame) -> DataFrame:
    """(u, v): pairs that fit of each set and those AHEAD of it in its buckets, each bucket in an
    order of its own; at most BESIDE for a set.  In proportion to the index, whatever its groups."""
    w = Window.partitionBy("k").orderBy(F.xxhash64("k", "fp"), "fp")
    ahead = F.array_compact(F.array(*[F.lead(F.struct("fp", "n", "i"), t).over(w) for t in range(1, AHEAD + 1)]))
    pairs = met.select("k", "fp", "n", "i", ahead.alias("o")).select("k", "fp", "n", "i", F.explode("o").alias("o")).where(_fits("n", "i", "o.n", "o.i"))
    nth = F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("k", "fp", "o.fp"), "k"))
    return _pairs(pairs.withColumn("nth", nth).where(F.col("nth") <= BESIDE), "fp", "o.fp")


def _parts(docs: DataFrame) -> int:
    """Partitions of a shuffle of about as many bytes as the texts have."""
    size = id_text(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(partitions(docs.sparkSession), size // PARTITION + 1)


def _small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """Marked for broadcast if its rows (of two or three numbers) are counted to be few; a larger
    one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _same_row(i: str, t: str):
    return F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("th") == F.col(t))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _possible(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of sets (u, v) whose sizes and wide bitmaps let them be similar.  Sizes
    that do differ by a quarter at most, so one bitmap is as wide as the other or twice as wide,
    and that is folded."""
    a, b = (nodes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "uv")
    sized = pairs.join(a, "u").join(b, "v").where("5 * least(nu, nv) >= 4 * greatest(nu, nv)").withColumn("s", F.expr("least(size(wu), size(wv))"))
    folded = " ^ ".join(f"w{x}[i] ^ if(size(w{x}) > s, get(w{x}, i + s), 0L)" for x in "uv")
    apart = F.expr(f"aggregate(sequence(0, s - 1), 0, (t, i) -> t + bit_count({folded}))")
    return sized.where(9 * apart <= F.col("nu") + F.col("nv")).select("u", "v")


def _alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs of sets (u, v) that have a similarity of at least 0.8, exactly.  Sets are
    made again and dealt for the pairs that their wide bitmaps leave, so that the shuffle grows
    with the links, not with pairs of long texts that share a passage."""

    def run(parts):
        for b in (b.slice(i, BATCH) for b in parts for i in range(0, b.num_rows, BATCH)):
            sets = [_shingles(t) for t in _texts(b, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["fp", "hs"])

    pairs = staged(_possible(nodes, pairs), "possible")
    ends = pairs.select(F.col("u").alias("fp")).unionAll(pairs.select(F.col("v").alias("fp"))).distinct()
    reps = staged(nodes.join(ends, "fp", "left_semi").select(F.col("rep.doc_id").alias("i"), F.col("rep.th").alias("t")), "ends")
    found = _rows(docs).join(_small(reps), _same_row("i", "t"), "left_semi").select("text").mapInArrow(run, "fp long, hs array<long>")
    sets = found.dropDuplicates(["fp"])  # dealt by fp, which both joins use
    a, b = (sets.select(F.col("fp").alias(x), F.col("hs").alias(f"h{x}")) for x in "uv")
    common = F.size(F.array_intersect("hu", "hv"))
    return pairs.join(a, "u").join(b, "v").where(9 * common >= 4 * (F.size("hu") + F.size("hv"))).select("u", "v")


def _across(met: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): all pairs of sets of different components that meet in a bucket and fit, by place
    and by bitmap.

    In a bucket every such pair has a side outside the largest component that is met there, so
    a large group of near copies, once it is one component, makes no pairs with itself.  Two sets
    whose indexed shingles just before k are one, p, meet there too and fit there at least as well,
    so they are a pair there and not here: a shared passage makes few rows, not one a shingle.
    """
    size = comp.groupBy("component").agg(F.count("*").alias("z"))
    names = comp.join(size, "component").select(F.col("node").alias("fp"), F.col("component").alias("c"), "z")
    sets = nodes.select("fp", "bits").join(names, "fp", "left")
    before = met.withColumn("p", F.lag("k").over(Window.partitionBy("fp").orderBy("i")))
    rows = before.join(sets, "fp").select("k", "p", "fp", "n", "i", "bits", F.coalesce("c", "fp").alias("c"), F.coalesce("z", F.lit(1)).alias("z"))
    w = Window.partitionBy("k")
    mixed = rows.withColumns({"top": F.max(F.struct("z", "c")).over(w), "low": F.min("c").over(w), "high": F.max("c").over(w)}).where("low <> high")
    outside = mixed.where("c <> top.c").select("k", "p", "fp", "n", "i", "bits", "c")
    other = mixed.select("k", F.col("p").alias("q"), F.col("fp").alias("g"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("bits").alias("b"), F.col("c").alias("d"), (F.col("c") == F.col("top.c")).alias("inner"))
    return _pairs(outside.join(other, "k").where("c <> d AND (inner OR fp < g) AND coalesce(p <> q, true)").where(_fits("n", "i", "m", "j") & _near_bits("n", "bits", "m", "b")), "fp", "g")


def jaccard_components(docs: DataFrame, near: bool = True) -> DataFrame:
    """(doc_id, fp, th, component): rows linked, also over others, by a Jaccard similarity of
    at least 0.8 of their sets of five-word shingles.  Texts without words are one component.

    Links are verified exactly.  Candidates are SimHash links of the shingles and, with `near`,
    neighbours in the buckets of the index, both in proportion to the input; then all pairs of
    the index that fit and are in different components still, so that none is lost.
    """
    fps = staged(shingle_sets(docs), "sets")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep")
    nodes = staged(fps.groupBy("fp").agg(rep, F.min("sim").alias("sim"), F.min("n").alias("n"), F.first("bits", True).alias("bits"), F.first("wide", True).alias("wide")), "nodes")
    sims = staged(nodes.where("n > 0").groupBy("sim").agg(F.min("fp").alias("lead")), "fingerprints")
    signed = links(sims.select(F.col("sim").alias("fp")))
    lead = lambda x: sims.select(F.col("sim").alias(x), F.col("lead").alias(f"l{x}"))
    linked = _pairs(signed.join(lead("u"), "u").join(lead("v"), "v"), "lu", "lv")
    equal = _pairs(nodes.where("n > 0").join(sims, "sim").where("fp <> lead"), "fp", "lead")
    met = staged(_index(fps, _parts(docs)), "index")
    first = linked.unionAll(equal).unionAll(_beside(met)).distinct() if near else linked.unionAll(equal)
    comp = staged(connected_components(_alike(docs, nodes, staged(first, "candidates"))), "components")
    named = fps.join(comp, fps.fp == comp.node, "left").select("doc_id", "fp", "th", F.coalesce("component", "fp").alias("component"))
    rest = staged(_across(met, comp, nodes), "candidates")
    more = _alike(docs, nodes, rest)
    for x in "uv":  # links between components
        name = comp.select(F.col("node").alias(x), F.col("component").alias("c"))
        more = more.join(name, x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    joined = staged(connected_components(more), "joined").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return named.join(joined, "component", "left").select("doc_id", "fp", "th", F.coalesce("whole", "component").alias("component"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of jaccard_components stays, that with the
    smallest doc_id.

    Of rows with one id the one with the least set and text hash counts, and of rows
    that are the same any one; a row without an id stays only if its component has no id.
    Null texts count as empty ones, and all texts without words are one component.  An empty
    table gives an empty one.  Columns are those of `docs`.
    """
    small_batches(spark)
    found = staged(jaccard_components(docs), "components")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "th")
    heads = found.groupBy("component").agg(F.min(rank).alias("h"))  # h sorts null ids last
    times = found.groupBy("component", "doc_id", "th").agg(F.count("*").alias("times"), F.min("fp").alias("fp"))
    judged = times.join(heads, "component").withColumn("head", rank.eqNullSafe(F.col("h")))
    marks = staged(judged.where(~F.col("head") | (F.col("times") > 1)).select(F.col("doc_id").alias("__i"), F.col("th").alias("__t"), F.col("head").alias("__head")), "marks")
    cols = [F.col(c) for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    kept = rows.join(_small(marks), _same_row("__i", "__t"), "left_anti").select("__row.*")
    twice = marks.where("__head")
    if twice.isEmpty():
        return kept
    one = rows.join(_small(twice), _same_row("__i", "__t"), "left_semi").groupBy("doc_id", "th").agg(F.first("__row").alias("__row"))
    return kept.unionAll(one.select("__row.*"))
