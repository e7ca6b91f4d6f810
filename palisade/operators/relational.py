"""First- and last-wins dedup, snapshot diff, coverage and source preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.schema import EXIT_ERROR, EXIT_FOUND, EXIT_OK


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. A max_by-like aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[f"__row.{c}" if c in rest else c for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*[f"__row.{c}" if c in rest else c for c in df.columns])


def present(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` isn't null. A filter would be moved below the column's expression, which then is computed for the filter and again for the result."""
    each = F.explode(F.when(F.col(column).isNotNull(), F.array(column))).alias(column)
    return df.select(*[each if c == column else c for c in df.columns])


def snapshot(deps: DataFrame) -> DataFrame:
    """What a diff needs of dependencies."""
    return deps.select("ecosystem", "name", "version", "integrity", "ord")


def diff_snapshots(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("ecosystem", "name")) -> DataFrame:
    """``keys``, ``status`` (added, removed, changed, unchanged), ``from``, ``to``, ``integrity_changed``.

    The last row of a key counts, by ``ord``. A package of the same version has changed if both sides have an integrity and
    these differ.
    """
    old = last_wins(before.select(*keys, "version", "integrity", "ord"), list(keys), ["ord"]).select(*keys, F.col("version").alias("from"), F.col("integrity").alias("i0"), F.lit(True).alias("was"))
    new = last_wins(after.select(*keys, "version", "integrity", "ord"), list(keys), ["ord"]).select(*keys, F.col("version").alias("to"), F.col("integrity").alias("i1"), F.lit(True).alias("is"))
    both = old.join(new, list(keys), "full_outer")
    tampered = F.coalesce(F.col("from").eqNullSafe(F.col("to")) & (F.col("i0") != F.col("i1")), F.lit(False))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("from").eqNullSafe(F.col("to")) | tampered, "changed").otherwise("unchanged")
    return both.select(*keys, status.alias("status"), "from", "to", (tampered & F.col("was").isNotNull() & F.col("is").isNotNull()).alias("integrity_changed"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: counts of each status, ``has_changes`` and the summary text."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    n = diff.agg(*[count(s) for s in ("added", "removed", "changed", "unchanged")])
    part = lambda s: F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}")))
    text = F.concat_ws(", ", part("added"), part("removed"), part("changed"))
    return n.withColumn("has_changes", F.col("added") + F.col("removed") + F.col("changed") > 0).withColumn("summary", F.when(text == "", "no changes").otherwise(text))


def changed_packages(diff: DataFrame) -> DataFrame:
    """Packages whose new version must be looked at: added and changed ones, with ``is_new``."""
    return diff.filter(F.col("status").isin("added", "changed")).select("ecosystem", "name", F.col("to").alias("version"), (F.col("status") == "added").alias("is_new"))


def prefer(df: DataFrame, keys: list[str], preferred: Column) -> DataFrame:
    """Of each key the preferred rows if it has any, else all; ``fallback`` tells which."""
    w = Window.partitionBy(*keys)
    has = F.max(preferred.cast("int")).over(w) == 1
    return df.withColumns({"__has": has, "__is": preferred}).filter(~F.col("__has") | F.col("__is")).withColumn("fallback", ~F.col("__has")).drop("__has", "__is")


def left_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` and ``covered``, which tells a row without a match from one that matched nulls."""
    return left.join(right.withColumn("covered", F.lit(True)), keys, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def completeness(coverage: DataFrame, failed: Column | None = None) -> DataFrame:
    """One row: ``expected``, ``checked``, ``failed``, ``complete``. Nothing unchecked is ever called clean."""
    bad = failed if failed is not None else F.lit(False)
    n = coverage.agg(F.count("*").alias("expected"), F.count_if("covered").alias("checked"), F.count_if(bad).alias("failed"))
    return n.withColumn("complete", (F.col("expected") == F.col("checked")) & (F.col("failed") == 0))


def exit_code(complete: Column, findings: Column) -> Column:
    return F.when(~complete, EXIT_ERROR).when(findings > 0, EXIT_FOUND).otherwise(EXIT_OK)


#: Bits of the bitmap in bitmap_filtered(); as rows of 4 KB it is 8 MB, whatever the tables' sizes.
BITS = 1 << 26


def bitmap_filtered(large: DataFrame, small: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The rows of ``large`` that may have a partner in ``small`` by ``keys``: all that have one, and few others, as long as ``small`` has fewer keys than ``bits``.

    The hashes of the smaller side's keys are bits of a map of fixed size, which is broadcast, so the larger side loses its other rows
    where it is read, before any join. A key with a null has no partner.
    """
    place = lambda rows: rows.withColumn("__at", F.when(~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.pmod(F.xxhash64(*keys), F.lit(bits))))
    bitmap = place(small.select(*keys)).filter("__at is not null").groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("__bits"))
    met = place(large).withColumn("__bucket", F.bitmap_bucket_number("__at")).join(F.broadcast(bitmap), "__bucket")
    position = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__at) % 8 as int))")) != 0).select(*large.columns)
