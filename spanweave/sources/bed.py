"""BED files: formats, detection, parsing with a count of bad lines, writing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .typed_csv import _lines

#: The columns of BED, in order.
FIELDS = ("chrom", "start", "stop", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts")
_INT = {"start", "stop", "score", "thick_start", "thick_end", "block_count"}
_HEADS = ("#", "track", "browser")


@dataclass(frozen=True)
class BedFormat:
    """bedN+K: N standard columns and K (-1: any number of) further ones, with a delimiter."""

    fields: int = 12
    extra: int | None = 0
    sep: str = "\t"

    @staticmethod
    def parse(text: str) -> BedFormat:
        m = re.fullmatch(r"(?:bed)?(\d+)(\+(\d+)?)?", text.strip().lower())
        if not m or not 3 <= int(m[1]) <= 12:
            raise ValueError(f"not a BED format: {text!r}")
        return BedFormat(int(m[1]), 0 if not m[2] else int(m[3]) if m[3] else None)

    def __str__(self) -> str:
        return f"bed{self.fields}" + ("+" if self.extra is None else f"+{self.extra}" if self.extra else "")


DEFAULT, MACS2, RGB = BedFormat(12), BedFormat(6, 3), BedFormat(9)


def _fits(i: int, v: str) -> bool:
    name = FIELDS[i]
    if name in _INT:
        return bool(re.fullmatch(r"-?\d+", v)) or v == "."
    if name == "strand":
        return v in ("+", "-", ".")
    if name == "item_rgb":
        return bool(re.fullmatch(r"\d+(,\d+,\d+)?|\.", v))
    if name in ("block_sizes", "block_starts"):
        return bool(re.fullmatch(r"(\d+,?)+|\.", v))
    return True


def detect_line(line: str) -> BedFormat:
    """The format of a record: the first delimiter that gives three columns, then as many
    standard columns as fit."""
    sep = next((s for s in ("\t", ",", " ") if len(line.strip().split(s)) >= 3), None)
    if sep is None:
        raise ValueError(f"not a BED record: {line!r}")
    cells = line.strip().split(sep)
    n = 0
    while n < min(len(cells), 12) and _fits(n, cells[n]):
        n += 1
    if n < 3:
        raise ValueError(f"not a BED record: {line!r}")
    return BedFormat(n, len(cells) - n, sep)


def detect(spark: SparkSession, path: str) -> BedFormat:
    """From the first lines; one that doesn't parse may be a header."""
    top = [r[0] for r in _lines(spark, path).limit(1000).collect()]
    rows = [x for x in top if x.strip() and not x.startswith(_HEADS)][:2]
    for i, line in enumerate(rows):
        try:
            return detect_line(line)
        except ValueError:
            if i == len(rows) - 1:
                raise
    return BedFormat(3)


def ints(column: Column, size: Column | None = None) -> Column:
    """A comma list as integers, filled up with zeros to a size."""
    got = F.transform(F.filter(F.split(column, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    return got if size is None else F.slice(F.concat(got, F.array_repeat(F.lit(0), size)), F.lit(1), size)


def read(spark: SparkSession, path: str, fmt: BedFormat | None = None, strict: bool = False) -> DataFrame:
    """Records with their standard columns, `extras` (an array) and `bad` (the line, where a
    record doesn't parse; all else is null).  Strict reading raises at a bad record."""
    fmt = fmt or detect(spark, path)
    head = " OR ".join(f"startswith(trim(value), '{h}')" for h in _HEADS)
    lines = _lines(spark, path).where("trim(value) <> ''").where(f"NOT ({head})")
    cells = lines.select("value", F.split(F.trim("value"), "[ ]+" if fmt.sep == " " else re.escape(fmt.sep)).alias("c"))
    at = lambda i: F.try_element_at("c", F.lit(i + 1))
    number = lambda i: F.when(at(i) == ".", 0).otherwise(at(i).try_cast("int"))
    cols: dict[str, Column] = {}
    for i, name in enumerate(FIELDS[: fmt.fields]):
        if name in _INT:
            cols[name] = number(i)
        elif name == "strand":
            cols[name] = F.when(at(i) == "-", "-").otherwise("+")
        elif name == "item_rgb":
            rgb = F.split(at(i), ",")
            part = lambda k: F.try_element_at(rgb, F.lit(k)).try_cast("int")  # noqa: B023, E731
            cols[name] = F.when(at(i).isin("0", "."), 0).otherwise(F.lit(-16777216) + part(1) * 65536 + part(2) * 256 + part(3))
        elif name in ("block_sizes", "block_starts"):
            cols[name] = F.when(at(i) != ".", ints(at(i)))
        else:
            cols[name] = at(i)
    ok = (F.size("c") >= fmt.fields) & number(1).isNotNull() & number(2).isNotNull()
    for i, name in enumerate(FIELDS[: fmt.fields]):
        if name in _INT:
            ok = ok & number(i).isNotNull()
        if name == "strand":
            ok = ok & at(i).isin("+", "-", ".")
    bad = F.raise_error(F.concat(F.lit("bad BED record: "), F.col("value"))).cast("string") if strict else F.col("value")
    extras = F.slice("c", fmt.fields + 1, F.greatest(F.size("c") - fmt.fields, F.lit(0)))
    out = cells.withColumn("__ok", ok)
    return out.select(*[F.when(F.col("__ok"), c).alias(n) for n, c in cols.items()], F.when(F.col("__ok"), extras).alias("extras"), F.when(~F.col("__ok"), bad).alias("bad"))


def locations(records: DataFrame) -> DataFrame:
    """(chrom, strand, start, stop) of good records; without strand all are on plus."""
    good = records.where("bad IS NULL")
    strand = F.col("strand") if "strand" in records.columns else F.lit("+")
    return good.select("chrom", strand.alias("strand"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def reads(records: DataFrame) -> DataFrame:
    """Records as reads: at least one base long."""
    return locations(records).withColumn("stop", F.greatest(F.col("start") + 1, "stop"))


def lines(df: DataFrame, fields: int = 6, sep: str = "\t") -> DataFrame:
    """Records as text; columns that are missing get their defaults."""
    default = {"name": ".", "score": "0", "strand": "+", "thick_start": "0", "thick_end": "0", "item_rgb": "0", "block_count": "0", "block_sizes": ".", "block_starts": "."}

    def text(name: str) -> Column:
        if name not in df.columns:
            return F.lit(default[name])
        c = F.col(name)
        if name in ("block_sizes", "block_starts"):
            return F.coalesce(F.array_join(c, ","), F.lit("."))
        if name == "item_rgb":
            return F.when(c == 0, "0").otherwise(F.concat_ws(",", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (16, 8, 0)]))
        return F.coalesce(c.cast("string"), F.lit(default.get(name, ".")))

    return df.select(F.concat_ws(sep, *[text(n) for n in FIELDS[:fields]]).alias("value"))


def write(df: DataFrame, path: str, fields: int = 6) -> None:
    lines(df, fields).write.mode("overwrite").text(path)


def with_unique_names(df: DataFrame) -> DataFrame:
    """Names made different by chromosome and place."""
    return df.withColumn("name", F.concat_ws("_", F.coalesce("name", F.lit("peak")), "chrom", "start", "stop"))
