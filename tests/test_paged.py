"""The paged source against a server on this machine."""

import json
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera.sources import paged

ITEMS = {"one": list(range(25)), "two é": list(range(3)), "none": [], "bad": [1]}


class Service(BaseHTTPRequestHandler):
    calls: list = []
    limited: set = set()

    def do_GET(self):  # noqa: N802
        url = urllib.parse.urlparse(self.path)
        ask = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        Service.calls.append((self.path, self.headers["User-Agent"]))
        if self.path not in Service.limited and ask.get("limit"):
            Service.limited.add(self.path)
            return self.answer(403, b"", {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": str(time.time() + 0.2)})
        if ask["q"] == "bad":
            return self.answer(500, b"oops")
        at = int(ask["p"]) * 10 - 10 if "p" in ask else 0 if ask["c"] == "*" else int(ask["c"])
        items = ITEMS[ask["q"]][at : at + 10]
        following = at + 10 if at + 10 < len(ITEMS[ask["q"]]) else None
        return self.answer(200, json.dumps({"data": {"rows": [{"k": k} for k in items]}, "meta": {"next": following}}).encode())

    def answer(self, status, body, headers=()):
        self.send_response(status)
        for k, v in dict(headers).items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    service = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{service.server_port}"
    service.shutdown()


def rows(df):
    return sorted(((r.query, r.page, json.loads(r.item)["k"] if r.item else None, r.error is not None) for r in df.collect()), key=str)


def expected(names, most=10**9):
    return sorted(((q, k // 10 + 1, k, False) for q in names for k in ITEMS[q][:most]), key=str)


def test_cursors_quotas_and_cache(spark, server, tmp_path):
    options = {"url": server + "/?q={query}&c={cursor}&limit=1", "items": "data.rows", "next": "meta.next", "cache": str(tmp_path / "cache"), "agent": "tester"}
    got = rows(paged.read_paged(spark, ["one", "two é", "none"], **options))
    assert got == expected(["one", "two é"]) and all(agent == "tester" for _, agent in Service.calls)
    calls = len(Service.calls)
    assert rows(paged.read_paged(spark, ["one", "two é", "none"], **options)) == got and len(Service.calls) == calls  # from the cache
    assert rows(paged.read_paged(spark, ["one"], per_query=12, **options)) == expected(["one"], 12)
    assert not [p for p in (tmp_path / "cache").iterdir() if "." in p.name]


def test_page_numbers_and_errors(spark, server):
    options = {"url": server + "/?q={query}&p={page}", "paging": "page", "items": "data.rows"}
    df = paged.read_paged(spark, ["one", "bad", "none"], **options)
    assert rows(df) == sorted([*expected(["one"]), ("bad", 1, None, True)], key=str)
    wide = paged.read_paged(spark, ["one", "none"], pages=4, **options)
    assert wide.rdd.getNumPartitions() == 8 and rows(wide) == expected(["one"])
    lost = paged.read_paged(spark, ["x"], url="http://127.0.0.1:9/{query}", timeout=2).collect()
    assert len(lost) == 1 and lost[0].error


def test_half_files_are_never_seen(tmp_path):
    paged.write_atomically(f"{tmp_path}/a/b", b"one")
    paged.write_atomically(f"{tmp_path}/a/b", b"two")
    assert (tmp_path / "a/b").read_bytes() == b"two" and len(list((tmp_path / "a").iterdir())) == 1
    assert paged.file_get(f"{tmp_path}/none", {}, 1).body == b"{}" and paged.dig({"a": [1]}, "a.b") is None
