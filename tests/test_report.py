import json
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from seqloom.__main__ import main
from seqloom.operators import panels
from seqloom.operators.findings import stars
from seqloom.plans import report as report_module
from seqloom.plans.report import duration, html_table
from seqloom.sources.landing import MOST_BYTES, Landing, serve


def test_duration_and_stars(spark):
    assert [duration(s) for s in (5, 65, 3700, 90000)] == ["5s", "1m 5s", "1h 1m", "1d 1h"]
    df = spark.createDataFrame([(0.001,), (0.02,), (0.07,), (0.5,)], "p double")
    assert [r[0] for r in df.select(stars(F.col("p"))).collect()] == ["***", "**", "*", ""]


def test_values_are_escaped(spark):
    df = spark.createDataFrame([("<script>&'",)], "`a<b` string")
    text = html_table(df)
    assert "<script>" not in text and "&lt;script&gt;" in text and "<th>a&lt;b</th>" in text


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    lines = [json.dumps({"__req": format(i + 1, "x"), "__crn": f"r{i % 3}", "__spin_t": 1_600_000_000 + 20 * i, "__user": "u", "fb_api_req_friendly_name": ["OddTitleQuery", "OddTitleThing", "SendMessageMutation", "Hovercard"][i % 4]}) for i in range(80)]
    (tmp_path / "a.ndjson").write_text("\n".join(lines))
    (tmp_path / "b.ndjson").write_text("\n".join(lines[:60]))
    a, b = str(tmp_path / "a.ndjson"), str(tmp_path / "b.ndjson")
    assert main([a, "-o", str(tmp_path / "r.html")]) == 0 and all(x in (tmp_path / "r.html").read_text() for x in ("<h2>Hooks</h2>", "Sending a message", "<svg"))
    assert main(["diff", a, b, "-o", str(tmp_path / "d.html")]) == 0 and "Hook lifts" in (tmp_path / "d.html").read_text()
    assert main(["discover", a, "--html", str(tmp_path / "p.html")]) == 0 and "OddTitle" in capsys.readouterr().out and "OddTitle" in (tmp_path / "p.html").read_text()
    monkeypatch.setattr(report_module, "SECTIONS", {"Header": panels.header_stats, "Hours": panels.diurnal})
    store = str(tmp_path / "store")
    assert main(["store", "ingest", store, a]) == 0 and main(["store", "list", store]) == 0 and "a.ndjson\t80" in capsys.readouterr().out
    assert main(["store", "report", store, f"file:{a}", "-o", str(tmp_path / "s.html")]) == 0 and main(["store", "report", store, "none"]) == 1


def test_landing(tmp_path):
    landing = Landing(str(tmp_path / "in"), lines=2)
    server = serve(landing)
    url = f"http://127.0.0.1:{server.server_port}"

    def post(data: bytes):
        return json.loads(urllib.request.urlopen(urllib.request.Request(f"{url}/ingest", data), timeout=10).read())

    try:
        assert post(b'{"__crn":"r"}') == {"ok": True, "relay_seq": 1} and post(b'{"__kind":"input"}')["relay_seq"] == 2
        for bad in (b"{bad", b"[1]", b"x" * (MOST_BYTES + 1)):
            with pytest.raises((urllib.error.HTTPError, urllib.error.URLError)):
                post(bad)
        health = json.loads(urllib.request.urlopen(f"{url}/health", timeout=10).read())
        assert health["counts"] == {"request": 1, "input": 1}
    finally:
        server.shutdown()
        server.server_close()
    files = list((tmp_path / "in").glob("[0-9]*.ndjson"))
    assert len(files) == 1 and [json.loads(x)["__relay_seq"] for x in files[0].read_text().splitlines()] == [1, 2]


def test_landing_goes_on_after_a_loss(tmp_path):
    folder = tmp_path / "in"
    lost = Landing(str(folder), seconds=60)
    assert [lost.add({"__crn": "r"}) for _ in range(3)] == [1, 2, 3]
    lost.closed.set()  # its process is gone, the file left open
    again = Landing(str(folder), seconds=0.2)
    assert again.add({"__crn": "s"}) == 4
    deadline = time.monotonic() + 20
    while len(list(folder.glob("[0-9]*.ndjson"))) < 2 and time.monotonic() < deadline:
        time.sleep(0.05)
    again.close()
    numbers = [json.loads(x)["__relay_seq"] for f in sorted(folder.glob("[0-9]*.ndjson")) for x in f.read_text().splitlines()]
    assert numbers == [1, 2, 3, 4] and not list(folder.glob("_*"))


def test_tables_sequence_and_panels_in_sql(spark, data, capsys):
    assert main(["sql", data, "SELECT count(*) AS n, sum(h.n_events) AS m FROM header_stats h JOIN captures c USING (capture_id)", "--panel", "header_stats"]) == 0
    assert "|n " in capsys.readouterr().out
    assert spark.sql("SELECT count(*) FROM sequence s JOIN dim_route r ON s.route = r.route WHERE s.surface IS NULL").head()[0] == 0
