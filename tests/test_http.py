import gzip
import hashlib
import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from conftest import ROOT
from pagevault import collect
from pagevault.schemas import USER_AGENT
from pagevault.sources import HttpPages, fetch_pages, targets
from pagevault.sources.http import KEEP, Limits, StatusError, get

BODY = "<html><body>Página</body></html>".encode()


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        Handler.seen.append((self.path, self.headers.get("User-Agent")))
        plain = {"/ok": 200, "/missing": 404, "/broken": 500, "/same": 304}
        if self.path == "/moved":
            return self.answer(302, b"", {"Location": "/ok"})
        if self.path == "/loop":
            return self.answer(302, b"", {"Location": "/loop"})
        if self.path == "/slow":
            time.sleep(3)
        if self.path == "/zip":
            return self.answer(200, gzip.compress(BODY), {"Content-Encoding": "gzip"})
        if self.path == "/empty":
            return self.answer(200, b"", {})
        return self.answer(plain.get(self.path, 200), b"" if self.path == "/same" else BODY, {"ETag": '"e"', "Content-Type": "text/html"}, twice=self.path == "/twice")

    def answer(self, status, body, headers, twice=False):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        if twice:
            self.send_header("etag", '"f"')
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_get(base):
    answer = get(base + "/ok")
    assert (answer.status, answer.content, answer.headers["etag"]) == (200, BODY, '"e"')
    assert Handler.seen[-1][1] == USER_AGENT and Handler.seen[-1][1].startswith("pagevault/")
    assert get(base + "/moved").content == BODY
    assert get(base + "/zip").content == BODY
    assert get(base + "/empty").content == b""
    assert get(base + "/twice").headers["etag"] == '"e", "f"'
    assert get(base + "/straße?q=ü").status == 200


@pytest.mark.parametrize("path", ["/missing", "/broken", "/same", "/loop"])
def test_other_statuses_fail(base, path):
    with pytest.raises(StatusError):
        get(base + path)


def test_statuses_can_be_kept(base):
    assert get(base + "/missing", Limits(on_status=KEEP)).status == 404


def test_timeout(base):
    with pytest.raises(TimeoutError):
        get(base + "/slow", Limits(timeout=0.3))


def test_data_source(spark, base):
    spark.dataSource.register(HttpPages)
    wanted = [{"patch": p, "locale": "l", "source_url": base + u} for p, u in (("3.1", "/ok"), ("3.10", "/moved"))]
    rows = {r.target.patch: r for r in spark.read.format("http_pages").option("targets", json.dumps(wanted)).load().collect()}
    assert rows["3.10"].target.source_url.endswith("/moved") and rows["3.10"].status_code == 200 and bytes(rows["3.10"].content) == BODY
    assert rows["3.1"].fetched_at != rows["3.10"].fetched_at
    bad = spark.read.format("http_pages").option("targets", json.dumps([{"patch": "1", "locale": "l", "source_url": base + "/missing"}]))
    with pytest.raises(Exception, match="404"):
        bad.load().select("etag").collect()
    assert bad.option("onStatus", "keep").load().first().status_code == 404


def test_filters_on_targets_prevent_fetches(spark, base):
    from pyspark.sql import functions as F

    spark.dataSource.register(HttpPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        wanted = [{"patch": str(i), "locale": "de" if i % 2 else "fr", "source_url": f"{base}/ok?{i}"} for i in range(12)]
        source = spark.read.format("http_pages").option("targets", json.dumps(wanted)).option("pushFilters", "true")
        cases = [
            (F.col("target.patch") == "3", [3]),
            (F.col("target.patch").isin("3", "4", "99"), [3, 4]),
            ((F.col("target.locale") == "de") & F.col("target.source_url").endswith("?11"), [11]),
            (F.col("target.patch").startswith("1") & (F.col("status_code") == 200), [1, 10, 11]),
            (F.col("target.source_url").contains("?7") & F.col("etag").isNotNull(), [7]),
            (F.col("target.patch") == "none", []),
        ]
        for condition, kept in cases:
            Handler.seen.clear()
            assert sorted(int(r.patch) for r in source.load().where(condition).select("target.patch").collect()) == kept
            assert sorted(int(path.partition("?")[2]) for path, _ in Handler.seen) == kept
        Handler.seen.clear()
        assert source.load().where("length(target.patch) = 2").count() == 2 and len(Handler.seen) == 12  # not pushed, and still right
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_relation_of_targets(spark, base):
    wanted = targets(spark, [(str(i), "l", base + "/ok") for i in range(5)])
    rows = fetch_pages(wanted, partitions=2).collect()
    assert len(rows) == 5 and {bytes(r.content) for r in rows} == {BODY}
    assert fetch_pages(wanted.limit(0)).count() == 0
    assert fetch_pages(wanted, partitions=4, per_host=3).count() == 5


def test_collecting_one_page_reports_it(spark, base, tmp_path, capsys, monkeypatch):
    root = str(tmp_path / "raw")
    assert collect.main(["3.10", "pt_br", base + "/ok", root]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines == [f"HTML saved: {root}/3.10/pt_br/page.html", f"Metadata saved: {root}/3.10/pt_br/metadata.json", f"SHA-256: {hashlib.sha256(BODY).hexdigest()}"]
    monkeypatch.setattr(collect, "default_root", lambda: str(tmp_path / "default"))
    assert collect.main(["1", "l", base + "/zip"]) == 0 and (tmp_path / "default/1/l/page.html").read_bytes() == BODY
    monkeypatch.undo()
    assert collect.default_root() == os.path.join(ROOT, "data", "raw", "pages")
