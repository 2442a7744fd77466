import http.client
import json
import threading
from wsgiref.simple_server import WSGIRequestHandler, make_server

import pytest

from pagevault.service import create_engine
from pagevault.web import ROUTES, create_app


class Quiet(WSGIRequestHandler):
    def log_message(self, *args):
        pass


@pytest.fixture
def ask(spark):
    with make_server("127.0.0.1", 0, create_app(create_engine(spark)), handler_class=Quiet) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def ask(path, method="GET"):
            link = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=30)
            link.request(method, path)
            answer = link.getresponse()
            return answer.status, answer.getheader("Content-Type"), answer.read()

        yield ask
        server.shutdown()


def test_health_over_http(ask):
    for path in ("/health/live", "/health/ready"):
        status, kind, body = ask(path)
        assert (status, kind, json.loads(body)) == (200, "application/json", {"status": "ok"})
        assert ask(path, "HEAD") == (200, "application/json", b"") and ask(path, "POST")[0] == 405
    assert ask("/health")[0] == ask("/")[0] == 404
    status, kind, body = ask("/docs")
    assert status == 200 and kind.startswith("text/html") and all(path in body.decode() for path in ROUTES)


def test_nothing_is_created_before_a_request_asks():
    answers = []
    assert create_app()({"PATH_INFO": "/nowhere", "REQUEST_METHOD": "GET"}, lambda *a: answers.append(a)) == [b'{"detail":"Not Found"}']
    assert answers[0][0] == "404 Not Found"
