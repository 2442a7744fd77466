import json
import os

import pytest
from pyspark.sql import functions as F

from pagevault.operators import integrity, metadata, report_lines
from pagevault.schemas import METADATA, RAW_PAGE
from pagevault.sinks import read_table, save_pages, write_table
from pagevault.sinks.store import folder, local_path, move, stage, tidy
from pagevault.sources import read_bodies, read_metadata, read_store

from conftest import SF
from test_records import AT, BODY, raw_row


def test_save_writes_bytes_and_metadata(spark, tmp_path):
    raw = spark.createDataFrame([raw_row(etag='"ü\x01"')], RAW_PAGE)
    saved = save_pages(raw, str(tmp_path))
    receipts = saved.collect()
    assert receipts[0].html_path == f"{tmp_path}/3.1/pt_br/page.html"
    assert open(receipts[0].html_path, "rb").read() == BODY
    values = {k: v for k, v in metadata(raw).first().asDict().items()}
    assert open(receipts[0].metadata_path, "rb").read() == (json.dumps(values, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()
    assert [r.line for r in report_lines(saved).sort("n").collect()] == [f"HTML saved: {receipts[0].html_path}", f"Metadata saved: {receipts[0].metadata_path}", f"SHA-256: {receipts[0].sha256}"]
    assert sorted(os.listdir(tmp_path)) == ["3.1"]


def test_versions_stay_text_and_last_write_wins(spark, tmp_path):
    rows = [raw_row(), raw_row(patch="3.10", body=b"ten"), raw_row(body=b"later", at=AT.replace(hour=20))]
    save_pages(spark.createDataFrame(rows, RAW_PAGE), str(tmp_path))
    assert {(r.patch, bytes(r.content)) for r in read_bodies(spark, str(tmp_path)).collect()} == {("3.1", b"later"), ("3.10", b"ten")}
    save_pages(spark.createDataFrame([raw_row(body=b"again")], RAW_PAGE), str(tmp_path))
    got = {r.patch: r for r in integrity(read_store(spark, str(tmp_path))).collect()}
    assert bytes(got["3.1"].content) == b"again" and all(r.hash_ok and r.size_ok for r in got.values())
    assert read_metadata(spark, str(tmp_path)).schema.names == METADATA.names


def test_names_cannot_leave_the_root(tmp_path):
    for bad in ("..", ".", "a/b", "", None, "x" * 200):
        with pytest.raises(ValueError):
            folder(str(tmp_path), bad, "l")


def test_roots(spark, tmp_path):
    assert [local_path(x) for x in ("/a/b/", "file:/a/b", "file:///a/b", "a/b")] == ["/a/b", "/a/b", "/a/b", "a/b"]
    for bad in ("s3a://a/b", "hdfs:/a"):
        with pytest.raises(ValueError, match="not a folder"):
            local_path(bad)
    for n, root in enumerate((f"file:{tmp_path}/0", f"file://{tmp_path}/1")):
        assert save_pages(spark.createDataFrame([raw_row()], RAW_PAGE), root).first().html_path == f"{root}/3.1/pt_br/page.html"
        assert (tmp_path / str(n) / "3.1/pt_br/page.html").read_bytes() == BODY and read_store(spark, root).count() == 1


def test_without_a_checkpoint_folder_the_warehouse_is_used(tmp_path):
    """In a session of its own, run from an empty folder; nothing is left behind."""
    code = f"""
import os
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
from pagevault.plans import registry
from pagevault.shared import shared_folder, use_checkpoints
use_checkpoints(spark)
assert shared_folder(spark).endswith('/spark-warehouse/_shared')
assert registry.QUERIES['raw_store_roundtrip'](spark, {SF!r}).where('hash_ok').count() > 0
assert os.listdir('spark-warehouse/_shared')
spark.stop()
"""
    import subprocess
    import sys

    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))}
    env["SPARK_CONF_DIR"] = str(tmp_path / "conf")  # no defaults
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.listdir(tmp_path / "spark-warehouse/_shared") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([raw_row(), raw_row(patch="..")], RAW_PAGE)
    with pytest.raises(Exception, match="not a name"):
        save_pages(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_repeated_attempts_leave_one_copy(tmp_path):
    row = {n: None for n in METADATA.names} | {"patch": "1", "locale": "l", "content": b"x"}
    staging, root = str(tmp_path / "s"), str(tmp_path / "r")
    places = [next(stage([row | {"content": data}], staging))[2] for data in (b"x", b"x", b"later", b"last")]
    assert len(set(places)) == 4
    move(places[0], root, "1", "l")
    move(places[0], root, "1", "l")  # the attempt that did it was not heard of
    move(places[2], root, "1", "l")
    assert sorted(os.listdir(f"{root}/1/l")) == ["metadata.json", "page.html"] and open(f"{root}/1/l/page.html", "rb").read() == b"later"
    os.replace(f"{places[3]}/1/l/page.html", f"{root}/1/l/page.html")  # an attempt lost between its two renames
    move(places[3], root, "1", "l")
    assert open(f"{root}/1/l/page.html", "rb").read() == b"last" and not os.listdir(f"{places[3]}/1/l")
    with pytest.raises(FileNotFoundError):
        move(places[3], root, "2", "l")


def test_saving_runs_the_plan_once_and_again_over_a_store(spark, tmp_path):
    fetched = spark.sparkContext.accumulator(0)

    def fetch(batches):
        for batch in batches:
            fetched.add(batch.num_rows)
            yield batch

    raw = spark.createDataFrame([raw_row(patch=str(i)) for i in range(20)], RAW_PAGE).select("target.patch", "target", *[f.name for f in RAW_PAGE][1:])
    raw = raw.mapInArrow(fetch, raw.schema).drop("patch").checkpoint()
    assert save_pages(raw, str(tmp_path)).count() == save_pages(raw, str(tmp_path)).count() == 20
    assert fetched.value == 20 and len(os.listdir(tmp_path)) == 20


def test_partitioned_table(spark, tmp_path):
    at = str(tmp_path / "t")
    write_table(metadata(spark.createDataFrame([raw_row(), raw_row(patch="3.10")], RAW_PAGE), "content"), at)
    write_table(metadata(spark.createDataFrame([raw_row(body=b"new")], RAW_PAGE), "content"), at)
    got = {r.patch: bytes(r.content) for r in read_table(spark, at).collect()}
    assert got == {"3.1": b"new", "3.10": BODY}
    plan = read_table(spark, at).where(F.col("patch") == "3.1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(patch" in plan


def test_shared_folder_of_one_machine_is_refused_on_a_cluster():
    from pagevault.shared import shared_folder

    class Session:
        def __init__(self, master, **settings):
            self.sparkContext, self.settings = type("Context", (), {"master": master}), settings
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, *rest: settings.get(key, *rest))})

    local = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    assert shared_folder(Session("local[4]", **local)) == "file:/tmp/warehouse/_shared"
    assert shared_folder(Session("spark://host:7077", **local, **{"spark.checkpoint.dir": "file:/mnt/shared/"})) == "file:/mnt/shared"
    assert shared_folder(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://host/warehouse"})) == "hdfs://host/warehouse/_shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn", **local))


def test_tasks_list_and_read_the_store(spark, tmp_path):
    """Every page is read once, by whichever task; no file is listed in the driver, and nothing is joined."""
    patches = [f"{i}.{i % 7}" for i in range(60)] + ["_x", ".y", "a +b"]
    save_pages(spark.createDataFrame([raw_row(patch=p, body=p.encode()) for p in patches], RAW_PAGE), str(tmp_path))
    os.makedirs(tmp_path / "half" / "l")
    (tmp_path / "half/l/page.html").write_bytes(b"no metadata")
    (tmp_path / "file").write_bytes(b"")
    back = read_store(spark, str(tmp_path))
    assert sorted((r.patch, bytes(r.content).decode()) for r in back.collect()) == sorted((p, p) for p in patches)
    assert read_metadata(spark, str(tmp_path)).count() == len(patches) and read_bodies(spark, str(tmp_path)).count() == len(patches) + 1
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Join" not in plan and "Exchange" not in plan


def test_what_moving_leaves_is_removed_by_tasks(tmp_path):
    row = {n: None for n in METADATA.names} | {"patch": "1", "locale": "l", "content": b"x"}
    staging, root = str(tmp_path / "s"), str(tmp_path / "r")
    place = [p for _, _, p, _ in stage([row, row | {"locale": "m"}], staging)][0]
    for locale in "lm":
        move(place, root, "1", locale)
        tidy(place, "1", locale)
    tidy(place, "1", "l")  # a repeated attempt
    assert os.listdir(place) == [] and sorted(os.listdir(f"{root}/1")) == ["l", "m"]


def test_a_new_patch_is_moved_by_one_rename(tmp_path, monkeypatch):
    """All that a place holds of it, so that nothing is left to remove; beside folders that are there, a page at a time."""
    row = {n: None for n in METADATA.names} | {"patch": "1", "locale": "l", "content": b"x"}
    staging, root = str(tmp_path / "s"), str(tmp_path / "r")
    os.makedirs(root)
    first = [p for _, _, p, _ in stage([row, row | {"locale": "m"}], staging)][0]
    made = []
    for name in ("rename", "replace", "mkdir", "rmdir"):
        monkeypatch.setattr(os, name, lambda *a, f=getattr(os, name), name=name, **b: (f(*a, **b), made.append(name))[0])
    for locale in "lm":
        move(first, root, "1", locale)
        tidy(first, "1", locale)
    assert made == ["rename"] and os.listdir(first) == [] and sorted(os.listdir(f"{root}/1")) == ["l", "m"]
    second = [p for _, _, p, _ in stage([row | {"content": b"later"}, row | {"locale": "n"}], staging)][0]
    for locale in "ln":
        move(second, root, "1", locale)
        tidy(second, "1", locale)
    assert os.listdir(second) == [] and {x: open(f"{root}/1/{x}/page.html", "rb").read() for x in os.listdir(f"{root}/1")} == {"l": b"later", "m": b"x", "n": b"x"}


def test_tasks_that_share_patches_lose_no_page(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    row = {n: None for n in METADATA.names}
    staging, root = str(tmp_path / "s"), str(tmp_path / "r")
    tasks = [[x[:3] for x in stage((row | {"patch": str(p), "locale": f"l{k}", "content": b"%d" % k} for p in range(40)), staging)] for k in range(8)]

    def run(rows):
        for patch, locale, place in rows:
            move(place, root, patch, locale)
            tidy(place, patch, locale)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(run, tasks))
    assert {(p, x): open(f"{root}/{p}/{x}/page.html", "rb").read() for p in os.listdir(root) for x in os.listdir(f"{root}/{p}")} == {(str(p), f"l{k}"): b"%d" % k for p in range(40) for k in range(8)}


def test_moving_a_new_patch_asks_nothing_else_of_the_root(tmp_path, monkeypatch):
    """Tasks wait for each other at the root: no look at what is there, nothing to tidy; beside folders that are there, both."""
    row = {n: None for n in METADATA.names} | {"patch": "1", "locale": "l", "content": b"x"}
    staging, root = str(tmp_path / "s"), str(tmp_path / "r")
    os.makedirs(root)
    places = [next(stage([row], staging))[2] for _ in range(2)]
    asked = []
    monkeypatch.setattr(os, "stat", lambda at, *a, f=os.stat, **b: (asked.append(str(at)), f(at, *a, **b))[1])
    assert move(places[0], root, "1", "l") is True and not [x for x in asked if x.startswith(root)]
    assert move(places[0], root, "1", "l") is False and move(places[1], root, "1", "l") is False
    assert sorted(os.listdir(f"{root}/1/l")) == ["metadata.json", "page.html"]


def test_saving_fetches_once_without_a_checkpoint(spark, tmp_path):
    fetched = spark.sparkContext.accumulator(0)

    def fetch(batches):
        for batch in batches:
            fetched.add(batch.num_rows)
            yield batch

    raw = spark.createDataFrame([raw_row(patch=str(i % 15)) for i in range(20)], RAW_PAGE)
    assert save_pages(raw.mapInArrow(fetch, raw.schema), str(tmp_path)).count() == 15 and fetched.value == 20


def test_names_of_any_bytes_are_dealt_to_one_share(tmp_path):
    from pagevault.sources.store import names

    made = sorted([*map(str, range(50)), "ü", os.fsdecode(b"\xff"), "a +b"])
    for name in (*made, ".staging-1"):
        os.mkdir(tmp_path / name)
    (tmp_path / "file").write_bytes(b"")
    assert sorted(names(str(tmp_path))) == sorted(x for n in range(4) for x in names(str(tmp_path), n, 4)) == made
