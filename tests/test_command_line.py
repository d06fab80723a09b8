"""The command line: options, and a listing from a server to raw matches and on to the final dataset."""

import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarry import __main__ as cli
from quarry.config import JobConfig


def test_options():
    config = cli.configured(cli.parser().parse_args(["build", "--cutoff-date", "2024-01-02", "--enriched-dirs", "a", "b", "--compat"]))
    assert (config.cutoff_date, config.enriched_dirs, config.compat) == (date(2024, 1, 2), ("a", "b"), True)
    assert cli.configured(cli.parser().parse_args(["load", "--pages", "p"])) == JobConfig()
    for bad in ([], ["load"], ["load", "--pages", "p", "--start-date", "x"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def result(k, day):
    at = (day - date(1970, 1, 1)).days * 86_400_000
    return (
        f'<div class="result-con" data-zonedgrouping-entry-unix="{at}"><a class="a-reset" href="/matches/{k}/x"><div class="team1"><div class="team">A{k}</div></div>'
        f'<div class="team2"><div class="team">B{k}</div></div><span class="event-name">E</span><td class="result-score"><span>2</span><span>1</span></td></a></div>'
    )


def test_fetch_load_build(spark, tmp_path):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            k = int(self.path.rsplit("=", 1)[1]) // 100
            self.send_response(200)
            self.end_headers()
            rows = "".join(result(10 * k + j, date(2024, 5, 20 - 3 * k)) for j in range(3)) if k < 4 else ""
            self.wfile.write(f'<div class="allres"><div class="results-sublist">{rows}</div></div>'.encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    raw, run = str(tmp_path / "raw.csv"), lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    try:
        said = run("fetch", "--url", f"http://127.0.0.1:{server.server_port}/?offset={{offset}}", "--target", tmp_path / "pages", "--max-pages", 20, "--sleep-min", 0, "--sleep-max", 0, "--start-date", "2024-01-01")
        assert said == "4 pages, 0 of them failed"
    finally:
        server.shutdown()
    assert run("load", "--pages", tmp_path / "pages", "--raw-path", raw, "--start-date", "2024-01-01", "--end-date", "2024-06-01").startswith("12 matches of 4 pages")
    assert "matches_final: 12 rows" in run("build", "--raw-path", raw, "--enriched-dirs", tmp_path / "none", "--output-dir", tmp_path / "out", "--cutoff-date", "2024-01-01")
