import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pagevault.functions import header, iso_utc, lower_headers, metadata_json, metadata_line
from pagevault.operators import integrity, last_write_wins, metadata, quarantined, raw_pages, require_success, successful
from pagevault.operators.records import last_write_wins_wide
from pagevault.schemas import METADATA, RAW_PAGE
from pagevault.service import create_engine
from pagevault.sources import targets, through_table
from pagevault.streaming import metadata_stream

BODY = b"<html><body>Page 3.1</body></html>"
AT = datetime(2025, 3, 4, 5, tzinfo=UTC)


def raw_row(patch="3.1", locale="pt_br", body=BODY, status=200, at=AT, etag='"tag-7"', modified=None):
    return ((patch, locale, "https://example.test/page-26-1/"), at, status, "text/html; charset=utf-8", etag, modified, body, hashlib.sha256(body).hexdigest())


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([raw_row()], RAW_PAGE)


def test_raw_pages_from_a_table(spark):
    wanted = targets(spark, [("3.1", "pt_br", "u1"), ("3.10", "pt_br", "u2"), ("1", "x", "nowhere")])
    pages = spark.createDataFrame([("u1", AT, 200, {"Content-Type": "text/html", "ETAG": "e"}, BODY), ("u2", AT, 200, {}, b"")], "url string, fetched_at timestamp, status_code int, headers map<string,string>, content binary")
    with pytest.raises(Exception, match="no answer for nowhere"):
        through_table(wanted, pages).collect()
    pages = pages.unionAll(pages.where("url = 'u1'").withColumn("fetched_at", F.col("fetched_at") - F.expr("interval 1 day")).withColumn("content", F.lit(b"older")))
    kept = through_table(wanted, pages, missing="keep")
    assert kept.count() == 3 and [r.source_url for r in quarantined(kept).collect()] == ["nowhere"]
    got = {r.target.patch: r for r in raw_pages(successful(kept)).collect()}
    assert set(got) == {"3.1", "3.10"}
    assert got["3.1"].sha256 == hashlib.sha256(BODY).hexdigest() and got["3.1"].etag == "e" and got["3.1"].content_type == "text/html" and got["3.1"].last_modified is None
    assert got["3.10"].content == b"" and got["3.10"].etag is None


def test_metadata_has_all_keys(raw):
    assert metadata(raw).schema.names == METADATA.names
    assert [f.dataType for f in metadata(raw).schema] == [f.dataType for f in METADATA]
    r = metadata(raw).first()
    assert (r.schema_version, r.collector_version, r.patch, r.fetched_at, r.size_bytes, r.last_modified) == (1, "0.1.0", "3.1", "2025-03-04T05:00:00+00:00", len(BODY), None)


def test_json_is_sorted_and_keeps_nulls(spark):
    rows = spark.createDataFrame([raw_row(modified=None, etag='"é "')], RAW_PAGE)
    text = metadata(rows).select(metadata_json().alias("j"), metadata_line().alias("b")).first()
    values = metadata(rows).first().asDict()
    assert text.j == json.dumps(values, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert bytes(text.b) == (text.j + "\n").encode()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_iso_text_does_not_follow_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30, 0, 120, UTC),), (datetime(2024, 11, 3, 6, 30, tzinfo=UTC),), (None,)], "t timestamp")
        assert [r[0] for r in rows.select(iso_utc(F.col("t"))).collect()] == ["2024-03-10T02:30:00.000120+00:00", "2024-11-03T06:30:00+00:00", None]
        local = spark.sql("select timestamp_ntz '2024-03-10 02:30:00.5' as t")
        assert local.select(iso_utc(F.col("t"), instant=False)).first()[0] == "2024-03-10T02:30:00.500000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_iso_of_long_years(spark):
    """Years of five and six digits, far from 1970 on both sides; a time of seconds beyond 10**12."""
    micros = [253_402_300_799_999_999, 253_402_300_800_000_000, 9_000_000_000_000_000_000, -1, -61_000_000_007]
    want = ["9999-12-31T23:59:59.999999+00:00", "10000-01-01T00:00:00+00:00", "287168-08-24T16:00:00+00:00", "1969-12-31T23:59:59.999999+00:00", "1969-12-31T07:03:19.999993+00:00"]
    rows = spark.createDataFrame(list(enumerate(micros)), "i int, m long").select("i", F.timestamp_micros("m").alias("t")).orderBy("i")
    assert [r[0] for r in rows.select(iso_utc(F.col("t"))).collect()] == want
    assert [r[0] for r in rows.select(iso_utc(F.col("t").cast("timestamp_ntz"), instant=False)).collect()] == want


def test_headers_whatever_their_case(spark):
    rows = spark.sql("select map('ETag', 'a', 'Set-Cookie', 'x', 'set-cookie', 'y') as h union all select map() union all select null")
    got = rows.select(header(F.col("h"), "etag").alias("e"), header(F.col("h"), "Set-Cookie").alias("c"), lower_headers(F.col("h")).alias("m")).collect()
    assert (got[0].e, got[0].c, got[0].m) == ("a", "x, y", {"etag": "a", "set-cookie": "x, y"})
    assert got[1].e is None and got[1].m == {} and got[2].e is None


def test_status_check_fires_under_pruning(spark):
    rows = spark.createDataFrame([raw_row(), raw_row(status=404), raw_row(status=304), raw_row(status=500)], RAW_PAGE)
    with pytest.raises(Exception, match="status"):
        require_success(rows).count()
    with pytest.raises(Exception, match="status"):
        require_success(rows).select("etag").collect()
    assert require_success(rows.where("status_code = 200")).count() == 1
    assert (successful(rows).count(), quarantined(rows).count()) == (1, 3)


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("3.1", "a", 1), ("3.10", "a", 2), ("3.1", "a", 3), ("3.1", "b", 0)], "patch string, locale string, n int")
    got = {(r.patch, r.locale): r.n for r in last_write_wins(rows, ["patch", "locale"], [F.col("n")]).collect()}
    assert got == {("3.1", "a"): 3, ("3.10", "a"): 2, ("3.1", "b"): 0}
    assert last_write_wins(rows.limit(0), ["patch", "locale"], [F.col("n")]).count() == 0


def test_last_writes_with_bodies_are_read_and_shuffled_once(spark):
    """A key with half of the rows, ties, nulls in keys and order, a column of maps; each task sends one row a key at most."""
    rows = [(f"{i % 2 and i % 17}" if i % 50 else None, i % 9 if i % 7 else None, i % 3, {"n": str(i)}, b"%d" % i) for i in range(900)]
    pages = spark.createDataFrame(rows, "key string, at int, status int, headers map<string,string>, content binary").repartition(4)
    got = last_write_wins_wide(pages, ["key"], [F.col("at"), F.col("status")])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    best = {k: max((-1 if a is None else a, s) for key, a, s, _, _ in rows if key == k) for k in {r[0] for r in rows}}
    kept = got.collect()
    assert got.columns == pages.columns and len(kept) == len(best) and {r.key: (-1 if r["at"] is None else r["at"], r.status) for r in kept} == best
    assert all(rows[int(r.content)][0] == r.key and r.headers == {"n": r.content.decode()} for r in kept)


def test_integrity_finds_changes(spark):
    rows = spark.createDataFrame([(BODY, hashlib.sha256(BODY).hexdigest(), len(BODY)), (BODY + b"!", hashlib.sha256(BODY).hexdigest(), len(BODY))], "content binary, sha256 string, size_bytes long")
    assert sorted((r.hash_ok, r.size_ok) for r in integrity(rows).collect()) == [(False, False), (True, True)]


def test_health(spark):
    engine = create_engine(spark)
    assert [r.status for r in engine.live().collect()] == ["ok"] and [r.status for r in engine.ready().collect()] == ["ok"]
    assert engine.live().columns == ["status"]


def test_projections_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([raw_row(), raw_row(patch="3.10", status=404)], RAW_PAGE).write.parquet(str(tmp_path / "in"))
    query = metadata_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("pages_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.patch for r in spark.table("pages_out").collect()] == ["3.1"]
