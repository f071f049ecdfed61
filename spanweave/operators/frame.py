"""Typed tabular operations: projection, predicates, stable order, slices, key joins, binding.

Row order is significant in this model.  Positional operations work on an explicit `_row`
column (0-based), which `with_row` makes from a unique ordering key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import prefix

ROW = "_row"
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def default_of(kind: T.DataType) -> Column:
    """What fills a gap: 0, false, or null for strings."""
    if isinstance(kind, _NUMBERS):
        return F.lit(0).cast(kind)
    return F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)


def with_row(df: DataFrame, by: str, *ties: str) -> DataFrame:
    """Number the rows by a numeric column and further columns, without a single-task window."""
    return prefix.row_number(df, by, [F.col(t) for t in ties])


# ---- projection -------------------------------------------------------------------------


def only(df: DataFrame, *labels: str) -> DataFrame:
    """Keep and order columns; an unknown one is an error."""
    return df.select(*labels)


def omit(df: DataFrame, *labels: str) -> DataFrame:
    """Drop columns; unknown ones are ignored."""
    return df.drop(*labels)


def with_column(df: DataFrame, label: str, value: Column) -> DataFrame:
    """Add a column, or replace one at its place."""
    return df.withColumn(label, value)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"unknown column {old}; columns are {df.columns}")
    return df.withColumnRenamed(old, new)


def row_as_double(df: DataFrame, out: str = "vector") -> DataFrame:
    """All columns but `_row` as one array of doubles; true is 1, strings are an error."""
    cols = [f for f in df.schema if f.name != ROW]
    if bad := [f.name for f in cols if not isinstance(f.dataType, (*_NUMBERS, T.BooleanType))]:
        raise TypeError(f"not numeric: {bad}")
    cast = [F.col(f.name).cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast("double") for f in cols]
    return df.select(*[c for c in df.columns if c == ROW], F.array(*cast).alias(out))


# ---- predicates and filters -------------------------------------------------------------


def every(*predicates: Column) -> Column:
    """The conjunction; true without predicates."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def mask(df: DataFrame, predicate: Column, out: str = "mask") -> DataFrame:
    return df.select(ROW, F.coalesce(predicate, F.lit(False)).alias(out))


def where(df: DataFrame, predicate: Column, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows that pass, of those with start <= _row < stop; rows outside are dropped."""
    for bound, keep in ((start, lambda b: F.col(ROW) >= b), (stop, lambda b: F.col(ROW) < b)):
        if bound is not None:
            predicate = keep(bound) & predicate
    return df.where(predicate)


def where_mask(df: DataFrame, masks: DataFrame, column: str = "mask") -> DataFrame:
    """Rows whose `_row` has a true mask."""
    return df.join(masks.where(column).select(ROW), ROW, "left_semi")


#: Kinds of typed columns.
KINDS = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "string": "string"}


def slice_as(df: DataFrame, column: str, kind: str) -> DataFrame:
    """(row, value) of a column of the given kind; a column of another kind is an error, not a cast."""
    held = df.schema[column].dataType.simpleString()
    if held != KINDS[kind]:
        raise TypeError(f"{column} is {held}, not {kind}")
    return df.select(ROW, F.col(column).alias("value"))


def iloc(df: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, which lies within the rows: a one-row count rides
    along and raises where it doesn't."""
    if start < 0 or step <= 0 or stop < start:
        raise IndexError(f"bad slice {start}:{stop}:{step}")
    rows = df.agg(F.count("*").alias("__rows")).select(F.when(F.col("__rows") >= stop, True).otherwise(F.raise_error(F.concat(F.lit(f"slice to {stop} of rows: "), F.col("__rows").cast("string"))).cast("boolean")).alias("__ok"))
    return df.crossJoin(F.broadcast(rows)).where("__ok").drop("__ok").where((F.col(ROW) >= start) & (F.col(ROW) < stop) & ((F.col(ROW) - start) % step == 0))


# ---- order ------------------------------------------------------------------------------


def ordering(df: DataFrame, on: str, reverse: bool = False) -> list[Column]:
    """Sort keys of reorder(): ties by row, backwards when reversed, but never for booleans."""
    flag = isinstance(df.schema[on].dataType, T.BooleanType)
    return [F.col(on).desc() if reverse else F.col(on).asc(), F.col(ROW).desc() if reverse and not flag else F.col(ROW).asc()]


def reorder(df: DataFrame, on: str, reverse: bool = False) -> DataFrame:
    return df.orderBy(*ordering(df, on, reverse))


def permutation(df: DataFrame, on: str, reverse: bool = False) -> DataFrame:
    """(_row, position): where each row goes when sorted by a column.

    Strings are ordered by their first four characters as a number, then by all of them, so they
    are dealt into tiles like numbers are.
    """
    if isinstance(df.schema[on].dataType, T.StringType):
        head = F.conv(F.hex(F.rpad(F.substring(F.col(on).cast("binary"), 1, 4), 4, F.lit("\0").cast("binary"))), 16, 10).cast("long")
        return prefix.row_number(df.withColumn("__on", head), "__on", ordering(df, on, reverse), "position", descending=reverse).select(ROW, "position")
    flag = isinstance(df.schema[on].dataType, T.BooleanType)
    held = df.withColumn("__on", F.col(on).cast("int")) if flag else df.withColumn("__on", F.col(on))
    return prefix.row_number(held, "__on", [ordering(df, on, reverse)[1]], "position", descending=reverse).select(ROW, "position")


def permute(df: DataFrame, moves: DataFrame) -> DataFrame:
    """Give rows their new positions (_row, position)."""
    return df.join(moves, ROW).withColumn(ROW, F.col("position")).drop("position")


def resize(df: DataFrame, rows: int) -> DataFrame:
    """Cut to `rows` rows, or fill up with defaults."""
    whole = df.sparkSession.range(rows).withColumnRenamed("id", ROW)
    joined = whole.join(df.withColumn("__in", F.lit(True)), ROW, "left")
    fill = lambda f: F.when(F.col("__in"), F.col(f.name)).otherwise(default_of(f.dataType)).alias(f.name)
    return joined.select(*[F.col(ROW) if f.name == ROW else fill(f) for f in df.schema])


# ---- joins and binding ------------------------------------------------------------------


def _suffixed(columns: Sequence[Sequence[str]]) -> list[list[str]]:
    """Labels that occur in several inputs get 1, 2, ... in order, the first one too."""
    flat = [c for cols in columns for c in cols]
    many, seen, out = {c for c in flat if flat.count(c) > 1}, {}, []
    for cols in columns:
        out.append([])
        for c in cols:
            seen[c] = seen.get(c, 0) + 1
            out[-1].append(f"{c}{seen[c]}" if c in many else c)
    return out


def check_unique(df: DataFrame, on: str) -> None:
    """Raise with up to ten examples if a key occurs twice."""
    twice = [r[0] for r in df.groupBy(on).count().where("count > 1").orderBy(on).limit(10).collect()]
    if twice:
        raise ValueError(f"duplicate values in {on}: {twice}")


def _keyed(on: str, dfs: Sequence[DataFrame]) -> list[DataFrame]:
    if len(dfs) < 2:
        raise ValueError("at least two frames are needed")
    names = _suffixed([[c for c in d.columns if c != on] for d in dfs])
    return [d.select(*[F.col(c).alias(n) for c, n in zip([c for c in d.columns if c != on], new)], on) for d, new in zip(dfs, names)]


def merge_inner(on: str, *dfs: DataFrame, check: bool = True) -> DataFrame:
    """Rows of the keys that all frames have, sorted by key, the key last; keys are unique."""
    parts = _keyed(on, dfs)
    for d in dfs if check else ():
        check_unique(d, on)
    out = reduce(lambda a, b: a.join(b, on, "inner"), parts)
    return out.select(*[c for d in parts for c in d.columns if c != on], on).orderBy(on)


def merge_outer(on: str, *dfs: DataFrame, check: bool = True) -> DataFrame:
    """Rows of the keys that any frame has; gaps are defaults, null for strings; the key last."""
    parts = _keyed(on, dfs)
    if check:
        check_unique(dfs[0], on)
    marked = [d.withColumn(f"__in{i}", F.lit(True)) for i, d in enumerate(parts)]
    out = reduce(lambda a, b: a.join(b, on, "full"), marked)
    cols = []
    for i, d in enumerate(parts):
        for f in d.schema:
            if f.name != on:
                cols.append(F.when(F.col(f"__in{i}"), F.col(f.name)).otherwise(default_of(f.dataType)).alias(f.name))
    return out.select(*cols, on).orderBy(on)


def column_bind(*dfs: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Put frames side by side by `_row`; their row numbers must be the same."""
    kept = [[c for c in d.columns if c != ROW and c not in exclude] for d in dfs]
    sizes = [d.count() for d in dfs]
    if len(set(sizes)) > 1:
        raise ValueError(f"different number of rows: {sizes}")
    parts = [d.select(ROW, *[F.col(c).alias(n) for c, n in zip(cols, new)]) for d, cols, new in zip(dfs, kept, _suffixed(kept))]
    return reduce(lambda a, b: a.join(b, ROW), parts)


def row_bind(*dfs: DataFrame) -> DataFrame:
    """Rows one frame after another; labels must be the same in the same order."""
    for d in dfs[1:]:
        if d.columns != dfs[0].columns:
            raise ValueError(f"different columns: {dfs[0].columns} and {d.columns}")
    return reduce(DataFrame.unionAll, dfs)


def column_merge(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The different values of a and then those of b that a lacks, by their first `_row`."""
    first = a.select(column, F.lit(0).alias("side"), ROW).unionAll(b.select(column, F.lit(1).alias("side"), ROW))
    return first.groupBy(column).agg(F.min(F.struct("side", ROW)).alias("at")).select(column, "at.side", F.col(f"at.{ROW}").alias(ROW))


def column_semi(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Rows whose value the other frame has too."""
    if isinstance(df.schema[column].dataType, T.BooleanType):
        raise TypeError("booleans can't be intersected")
    return df.join(other.select(column).distinct(), column, "left_semi")


# ---- building ---------------------------------------------------------------------------


def build(spark: SparkSession, schema: T.StructType | str, rows: Sequence[tuple]) -> DataFrame:
    """A frame from rows; a value of the wrong type is an error."""
    return spark.createDataFrame(list(rows), schema, verifySchema=True)


def multi_labels(prefix_: str, n: int) -> list[str]:
    return [prefix_] if n == 1 else [f"{prefix_}_{i}" for i in range(1, n + 1)]


def head_text(df: DataFrame, n: int, by: str = ROW) -> str:
    """The first rows as typed tab-separated text; asking for more rows than there are is an error."""
    rows = df.orderBy(by).limit(n).collect()
    if len(rows) < n:
        raise ValueError(f"{n} rows asked for, {len(rows)} there")
    from ..sources.typed_csv import format_rows

    return format_rows(df.drop(ROW).schema, [[r[c] for c in df.columns if c != ROW] for r in rows], "\t")


def cell(df: DataFrame, row: int, label: str):
    """One value by its place, for looking at data; a row that isn't there is an error."""
    found = df.where(F.col(ROW) == row).select(label).head(2)
    if len(found) != 1:
        raise IndexError(row)
    return found[0][0]


def doubles(df: DataFrame, *labels: str) -> DataFrame:
    """Number columns as doubles, for vectors; other kinds are an error."""
    for label in labels:
        if not isinstance(df.schema[label].dataType, _NUMBERS):
            raise TypeError(f"{label} isn't a number")
    return df.withColumns({label: F.col(label).cast("double") for label in labels})


def ratio(part: Column, total: Column) -> Column:
    """part / total in single precision; infinite, or not a number, where the total is 0."""
    a, b = part.cast("float"), total.cast("float")
    none = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, none).otherwise(F.try_divide(a, b)).cast("float")


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same columns, kinds and rows; with a `_row` column in both
    their order counts too.  Only one row comes to the driver."""
    kinds = lambda df: [(f.name, f.dataType) for f in df.schema]
    return kinds(a) == kinds(b) and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ---- sampled and augmented frames -------------------------------------------------------


def chained(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Steps from frame to frame as one, from the left; none change nothing."""
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


def with_log_choose(n: str, k: str, out: str) -> Callable[[DataFrame], DataFrame]:
    """A step that adds the logarithm of the ways to choose k of n."""
    from ..functions.hypothesis_tests import log_choose

    return lambda df: df.withColumn(out, log_choose(F.col(n).cast("double"), F.col(k).cast("double")))


def uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) that follows from the seed and the columns, whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def with_binomial(k: str, n: str, extra: Column, chances: Sequence[float], seed: int, row: str = ROW, state: str = "state") -> Callable[[DataFrame], DataFrame]:
    """A step that adds n = extra + 1 trials, so never none, and k successes among them; the
    chance of success is that of the row's state.  Rows with a null state have null successes."""

    def step(df: DataFrame) -> DataFrame:
        chance = F.get(F.array(*map(F.lit, chances)), F.col(state).cast("int"))
        trials = F.sequence(F.lit(1).cast("long"), F.col(n))
        hits = F.size(F.filter(trials, lambda i: uniform(seed, F.col(row), i) < chance)).cast("long")
        return df.withColumn(n, (extra + 1).cast("long")).withColumn(k, F.when(chance.isNotNull(), hits))

    return step
