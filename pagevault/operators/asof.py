"""As-of join by a sorted merge: each left row gets the last right row of its key at or before its time.

Both sides are united, sorted by time within their key, and read once in that order: no pair of rows is formed. A key with very
many rows is split along time: rows are merged within spans of `span`, and what a span inherits, the last right row before it, comes
from one row for each key and span that has a right row, so the window that carries it on reads few rows. Both shuffles spread a
hot key over its spans.

Defined results: of right rows with one key and time the greatest by `order` wins (by default by its values); left rows with a
null key or time, and those before the first right row of their key, get nulls; right rows with a null key or time match nothing; repeated left
rows stay; an empty side gives nulls or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a day.
DAY = 86_400_000_000


def micros(time: Column, kind: str) -> Column:
    """Whole microseconds; a time without zone counts as UTC, whatever the session's zone is. Numbers stay what they are."""
    if kind == "timestamp_ntz":
        days, part = F.unix_date(time.cast("date")), time - time.cast("date").cast("timestamp_ntz")
        seconds = F.extract(F.lit("HOUR"), time) * 3600 + F.extract(F.lit("MINUTE"), time) * 60
        return (days.cast("long") * 86_400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")
    return F.unix_micros(time) if kind == "timestamp" else time.cast("double") if kind in ("double", "float") else time.cast("long")


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], left_time: str, right_time: str, values: list[str], order: list[str] | None = None, span: float = DAY) -> DataFrame:
    """left's columns, then right's `values`. Times are timestamps or numbers; span is in microseconds, or in their unit."""
    keys = [f"k{i}" for i in range(len(by))]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row")
    told = F.struct(*[F.col(f"`{c}`") for c in values])
    taken = F.struct(F.struct(*[F.col(f"`{c}`") for c in order or values]).alias("order"), told.alias("told")).alias("value")
    no_row, no_value = (F.lit(None).cast(df.select(c).schema[0].dataType) for df, c in ((left, row), (right, taken)))
    sides = []
    for df, time, is_right in ((left, left_time, False), (right, right_time, True)):
        at = micros(F.col(f"`{time}`"), df.schema[time].dataType.typeName())
        known = [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)]
        payload = [no_row.alias("row"), taken] if is_right else [row, no_value.alias("value")]
        sides.append(df.select(*known, at.alias("at"), F.lit(is_right).alias("is_right"), *payload))
    usable = F.col("at").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    numbers = all(df.schema[c].dataType.typeName() in ("double", "float") for df, c in ((left, left_time), (right, right_time)))
    bucket = F.floor(F.col("at") / span) if numbers else ((F.col("at") - F.pmod("at", F.lit(span))) / span).cast("long")
    rows = sides[0].where(usable).unionAll(sides[1].where(usable)).withColumn("bucket", bucket)
    # right rows of one time in the order of their values, before left rows of that time
    merged = Window.partitionBy(*keys, "bucket").orderBy("at", F.desc("is_right"), "value").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("found", F.last("value", ignorenulls=True).over(merged)).where("not is_right")
    last = sides[1].where(usable).withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.max(F.struct("at", "value")).alias("last"))
    # the spans of both sides, each once, and what each inherits
    spans = rows.where("not is_right").select(*keys, "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)).unionByName(last)
    before = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)["value"]).where("last is null and carried is not null").select(*keys, "bucket", "carried")
    out = within.join(carried, [*keys, "bucket"], "left").select("row", F.coalesce("found", "carried").alias("found"))
    rest = sides[0].where(~F.coalesce(usable, F.lit(False))).select("row", F.col("value").alias("found"))
    out = out.unionAll(rest)
    return out.select(*[F.col("row").getField(c).alias(c) for c in left.columns], *[F.col("found")["told"].getField(c).alias(c) for c in values])

