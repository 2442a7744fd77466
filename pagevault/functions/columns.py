from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.schemas import METADATA


def digest(content: Column) -> Column:
    """SHA-256 of bytes as lower-case hex."""
    return F.sha2(content, 256)


def size_bytes(content: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(content).cast("long")


def lower_headers(headers: Column) -> Column:
    """A header map with lower-case names. Names that differ only by case are one header, values joined by `, ` in the
    map's order; a plain transform of the keys would raise on them."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    values = F.transform(names, lambda n: F.array_join(F.transform(F.filter(entries, lambda e: e["name"] == n), lambda e: e["value"]), ", "))
    return F.map_from_arrays(names, values)


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name, or null."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda e: e["value"]), ", "))


def iso_utc(at: Column, *, instant: bool = True) -> Column:
    """ISO 8601 text with +00:00; six digits of fraction unless it is zero. Years have four digits at least, and as many as they need.

    instant: the column is an instant, shown in UTC; else it has no zone and is taken as UTC. Neither depends on the
    session's zone: the text of a timestamp without zone does not, while date_format would.
    """
    if instant:
        micros, day = F.unix_micros(at), F.lit(86_400_000_000)
        seconds = ((micros % day).cast("decimal(12,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
        at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.call_function("div", micros, day).cast("int"), F.lit(0), F.lit(0), seconds)
    text = F.ltrim(at.cast("timestamp_ntz").cast("string"), F.lit("+"))  # years of more than four digits come with a sign
    date, time = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
    fraction = F.when(F.length(time) > 8, F.concat(F.lit("."), F.rpad(F.substring(time, 10, 6), 6, "0"))).otherwise("")
    return F.concat(date, F.lit("T"), F.substring(time, 1, 8), fraction, F.lit("+00:00"))


def metadata_json(columns: dict[str, Column] | None = None) -> Column:
    """One line of JSON with sorted keys; nulls are kept. columns: by key, or the columns of the same names."""
    columns = columns or {f.name: F.col(f.name) for f in METADATA}
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def metadata_line(columns: dict[str, Column] | None = None) -> Column:
    """The line as UTF-8 bytes, ended by a line feed."""
    return F.encode(F.concat(metadata_json(columns), F.lit("\n")), "UTF-8")


def parse_metadata(text: Column) -> Column:
    return F.from_json(text, METADATA)


def store_path(root: str | Column, patch: Column, locale: Column, *names: str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", root, patch, locale, *map(F.lit, names))
