"""Values carried along an order, as-of and interval joins: by ranges of the order and bins, never a key to a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from startline.operators import store


def last_so_far(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], own: bool = True) -> DataFrame:
    """rows and, under each name, the last of a value that is not null, up to and with the row, or before it.

    Rows are dealt to ranges of (by, order) and looked through there; each range then hears what the last of the
    ranges before it had for its first key. Rows of a key with equal order columns have no order among them.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store.settle(rows.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(width, *by, *order).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = ranged.groupBy("_range", *by).agg(*[F.max_by(F.when(F.col(f"_v_{n}").isNotNull(), F.col(f"_v_{n}")), F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_b_{b}") for b in by], *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_e_{n}") for n in values])
    found = ranged.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(here) for n in values})
    same = F.col("_range") == F.col("_r")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    return found.join(ends, same, "left").withColumns({n: F.coalesce(n, f"_e_{n}") for n in values}).select(*rows.columns, *values)


def carried_forward(history: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """history with <column>_known: the last value so far that is not null."""
    found = last_so_far(history, [key], [order], {f"{c}_known": F.when(F.col(c).isNotNull(), F.struct(c)) for c in columns})
    return found.withColumns({f"{c}_known": F.col(f"{c}_known.{c}") for c in columns})


def changed(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """history with `changed`: whether the value differs from the one before; the first row of a key has changed."""
    found = last_so_far(history, [key], [order], {"_before": F.struct(F.col(value).alias("v"))}, own=False)
    return found.withColumn("changed", F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_before")


def as_of_join(left: DataFrame, right: DataFrame, by: str, at: str, name: str = "found", tie: str | None = None) -> DataFrame:
    """left with a struct of the last row of right that is not after it, by key; null if there is none.

    Both have the columns by and at; of right rows of one time the larger `tie` is last. Rows of a null key meet
    those of a null key.
    """
    order = F.struct(tie) if tie else F.lit(None)
    points = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"))
    facts = right.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), order.alias("_tie"), F.struct(*right.columns).alias("_fact"))
    both = facts.unionByName(points, allowMissingColumns=True)
    found = last_so_far(both, ["_by"], ["_at", "_kind", "_tie"] if tie else ["_at", "_kind"], {"_last": F.col("_fact")})
    return found.where("_kind = 1").select("_row.*", F.col("_last").alias(name))


def bins(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a span that holds it (start <= at < end), by equal bins of `width`: a point is in one bin."""
    by = by or []
    spans = spans.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    points = points.withColumn("_bin", F.floor(F.col(at) / width))
    return points.join(spans, ["_bin", *by]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, start: str, end: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of spans (columns of a; those of b as the struct `other`) that overlap, each in the bin of the later start."""
    by = by or []
    deal = lambda df: df.where(F.col(start) < F.col(end)).withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width)))
    other = deal(b).select("_bin", *by, F.struct(*b.columns).alias("other"))
    met = deal(a).join(other, ["_bin", *by]).where((F.col(start) < F.col(f"other.{end}")) & (F.col(f"other.{start}") < F.col(end)))
    return met.where(F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(f"other.{start}")) / width)).drop("_bin")
