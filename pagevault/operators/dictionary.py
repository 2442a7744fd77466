"""Versioned dictionaries: the entries that were valid at a time, made from the changes that were told.

A change names an entry, its value and when it holds from. Changes that tell what already holds make no version; the others are
numbered and each is valid until the next one.

Defined results: of changes of one entry and time the last by value counts; a null value is a version of its own, which ends the entry; changes
without entry or time are left out; an empty table gives no versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of


def versions(changes: DataFrame, *, entry: str, time: str, value: str) -> DataFrame:
    """entry, version (from 1), value, valid_from, valid_to (null: still valid)."""
    told = changes.select(F.col(entry).alias("entry"), F.col(time).alias("valid_from"), F.col(value).alias("value")).where("entry is not null and valid_from is not null")
    told = told.groupBy("entry", "valid_from").agg(F.max(F.struct(F.col("value").isNotNull(), "value"))["value"].alias("value"))
    order = Window.partitionBy("entry").orderBy("valid_from")
    known = told.withColumn("first", F.row_number().over(order) == 1).withColumn("same", F.lag("value").over(order).eqNullSafe(F.col("value")))
    new = known.where("first or not same")
    return new.select("entry", F.row_number().over(order).alias("version"), "value", "valid_from", F.lead("valid_from").over(order).alias("valid_to"))


def normalised(facts: DataFrame, dictionary: DataFrame, *, entry: str, time: str) -> DataFrame:
    """facts with the version and the value of their entry that were valid at their time; null where none was."""
    named = dictionary.withColumnRenamed("entry", entry)
    return as_of(facts, named, by=[entry], left_time=time, right_time="valid_from", values=["version", "value", "valid_from"], order=["version"])
