"""The paged source against a local server that fails on some pages."""

import threading
from collections import Counter
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.sources import paged

NEWEST = date(2024, 6, 30)


def html(k):
    days = [NEWEST - timedelta(days=2 * k), NEWEST - timedelta(days=2 * k + 1)]
    return "".join(f'<div data-zonedgrouping-entry-unix="{(d - date(1970, 1, 1)).days * 86_400_000 + 3_600_000}">{k}</div>' for d in days)


@pytest.fixture
def site():
    """60 pages: 3 fails twice, 7 always, 9 is a challenge once; past the end pages are empty."""
    asked, down = Counter(), {"on": True}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            k = int(self.path.rsplit("=", 1)[1]) // 100
            asked[k] += 1
            bad = (k == 3 and asked[k] <= 2) or (k == 7 and down["on"])
            body = "<title>Just a moment...</title>" if k == 9 and asked[k] == 1 else html(k) if k < 60 else "<p>none</p>"
            self.send_response(503 if bad else 200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/r?offset={{offset}}", asked, down
    server.shutdown()


FAST = {"sleepmin": 0, "sleepmax": 0, "backoff": 0, "retries": 3, "pertask": 4}


def read(spark, url, **more):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").options(url=url, **{k: str(v) for k, v in (FAST | more).items()}).load()


def test_retry_and_quarantine(spark, site):
    url, asked, _ = site
    rows = read(spark, url, pages=12)
    assert rows.rdd.getNumPartitions() == 3
    got = {r.page_idx: r for r in rows.collect()}
    assert sorted(got) == list(range(12))
    assert (got[3].attempts, got[9].attempts, got[0].attempts) == (3, 2, 1)
    assert got[7].html is None and "503" in got[7].error and asked[7] >= 4
    assert all((r.newest, r.oldest) == (NEWEST - timedelta(days=2 * k), NEWEST - timedelta(days=2 * k + 1)) for k, r in got.items() if k != 7)


@pytest.mark.parametrize("pushed", [True, False])
def test_stop_by_date(spark, site, pushed):
    url, asked, _ = site
    start = NEWEST - timedelta(days=60)
    if pushed:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read(spark, url, pages=500, pushdown=True) if pushed else read(spark, url, pages=500, since=start)
        got = rows.filter(F.col("newest") >= F.lit(start)).collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r.page_idx for r in got) == [k for k in range(31) if k != 7]
    assert not [k for k in asked if 32 < k < 60 and asked[k] > 2] and len(asked) < 60


def test_resumption(spark, site, tmp_path):
    url, asked, down = site
    target = str(tmp_path / "pages")
    first = paged.fetch(spark, target, url=url, pages=10, **FAST)
    assert first.filter("error is not null").count() == 1
    before, down["on"] = dict(asked), False
    got = {r.page_idx: r for r in paged.fetch(spark, target, url=url, pages=12, **FAST).collect()}
    assert sorted(got) == list(range(12)) and all(r.error is None for r in got.values())
    assert {k for k in asked if asked[k] > before.get(k, 0)} == {7, 10, 11}


def test_options(spark):
    with pytest.raises(ValueError, match="offset"):
        paged.PagedReader({"url": "http://x"})
    assert paged.PagedReader({"url": "{offset}", "pages": "0"}).partitions() == [paged.Pages(0, 0)]
    assert paged.page_dates("<p>no entry</p>") == (None, None)
