"""Contributions as history: versions with validity, edits that must know the last version, reverts of one contributor.

A contribution changes one field of one entity: entity, field, version (rising by entity), contributor, at, old, new.
All is aggregation by entity and field, so no entity is put in order in one task but for its intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity", "field"]


def intervals(contributions: DataFrame) -> DataFrame:
    """Contributions with valid_from and valid_to: a value holds until the next of its field; the last one has no end."""
    w = Window.partitionBy(*KEY).orderBy("version")
    return contributions.withColumns({"valid_from": F.col("at"), "valid_to": F.lead("at").over(w)})


def as_of(contributions: DataFrame, moment: Column) -> DataFrame:
    """entity, field, value as they stood at a moment: the last change that is not after it."""
    return contributions.where(F.col("at") <= moment).groupBy(*KEY).agg(F.max_by("new", "version").alias("value"))


def accepted(writes: DataFrame, stored: DataFrame) -> DataFrame:
    """writes with `outcome`: stored, or why not.

    From writes (entity, base, at, id) and stored (entity, version). A write is stored if its base is the version of
    its entity and no earlier one (by at, then id) has that base too; of others the entity is unknown or changed since.
    """
    now = writes.join(stored.select("entity", "version"), "entity", "left")
    fits = F.col("base") == F.col("version")
    first = now.where(fits).groupBy("entity").agg(F.min(F.struct("at", "id")).alias("_first"))
    outcome = F.when(F.col("version").isNull(), F.lit("unknown")).when(fits & (F.struct("at", "id") == F.col("_first")), F.lit("stored")).otherwise(F.lit("changed since"))
    return now.join(first, "entity", "left").withColumn("outcome", outcome).drop("_first", "version")


def reverted(contributions: DataFrame, contributor: Column) -> DataFrame:
    """What taking back all that a contributor did makes of each field they touched: entity, field, value, action, version.

    A field whose last change is theirs goes back to the last value of another, or to what it was before the first
    change (`restored`). Where another has changed it since, that value stays; it is a `conflict` to look at if the
    other's change starts from a value that is taken back, else it is `kept`. version is that of the field's last change.
    """
    theirs = F.coalesce(F.col("contributor") == contributor, F.lit(False))
    change = F.struct("version", "new", theirs.alias("theirs"))
    by = contributions.groupBy(*KEY).agg(
        F.max(change).alias("last"),
        F.max(F.when(~theirs, change)).alias("other"),
        F.max(F.when(theirs, F.struct("version", "new"))).alias("own"),
        F.min_by("old", "version").alias("before"),
    )
    by = by.where("own IS NOT NULL")
    later = contributions.where(~theirs).join(by.select(*KEY, "own"), KEY).where(F.col("version") > F.col("own.version"))
    later = later.groupBy(*KEY).agg(F.min_by("old", "version").eqNullSafe(F.min_by("own.new", "version")).alias("built_on"))
    value = F.when(~F.col("last.theirs"), F.col("last.new")).when(F.col("other").isNotNull(), F.col("other.new")).otherwise(F.col("before"))
    action = F.when(F.col("last.theirs"), F.lit("restored")).when(F.col("built_on"), F.lit("conflict")).otherwise(F.lit("kept"))
    return by.join(later, KEY, "left").select(*KEY, value.alias("value"), action.alias("action"), F.col("last.version").alias("version"))


def taking_back(found: DataFrame, current: DataFrame, moderator: Column, at: Column) -> DataFrame:
    """The contributions that carry out reverted(): one more version of each restored field; history stays whole.

    current holds entity, field, value as they are now.
    """
    rows = found.where("action = 'restored'").join(current.withColumnRenamed("value", "old"), KEY, "left")
    return rows.select(*KEY, (F.col("version") + 1).alias("version"), moderator.alias("contributor"), at.alias("at"), "old", F.col("value").alias("new"))
