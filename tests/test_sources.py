"""The REST data source and the streaming ingest, end to end."""

import http.server
import json
import threading
import urllib.parse

from quillspark.__main__ import main
from quillspark.sources.rest import RestSource
from quillspark.streaming.ingest import stream_works, write_works

PAGES = {"*": ([{"id": "a"}, {"id": "b"}], "next"), "next": ([{"id": "c"}], None)}


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        cursor = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["cursor"][0]
        results, following = PAGES[cursor]
        body = json.dumps({"results": results, "meta": {"next_cursor": following}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_rest_source(spark):
    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestSource)
    options = {"base": f"http://127.0.0.1:{server.server_port}", "endpoint": "works", "filter": "x:1"}
    rows = spark.read.format("rest_pages").options(**options).load().collect()
    server.shutdown()
    assert [json.loads(r.record)["id"] for r in rows] == ["a", "b", "c"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"id": f"https://openalex.org/W{i % 3}", "title": "t"}) for i in range(5)] + ["", "{broken"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    write_works(stream_works(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["W0", "W1", "W2"]


def test_command_line(spark, tmp_path, capsys):
    """What was fetched before is normalized, profiled and made into a graph."""
    out = tmp_path / "out"
    (out / "raw").mkdir(parents=True)
    work = {"id": "https://openalex.org/W1", "title": "Reeds", "publication_year": 2001, "authorships": [{"author": {"id": None, "display_name": "R. Moor"}}]}
    (out / "raw" / "part.json").write_text(json.dumps(work) + "\n{broken\n")
    main(["ingest", "--out", f"file://{out}", "--skip-fetch"])
    main(["graph", "--out", f"file://{out}"])
    present = {r.field: r.present for r in spark.read.json(f"file://{out}/metrics").collect()}
    assert len(present) == 18 and present["Title"] == 1 and present["DOI"] == 0
    assert spark.read.parquet(f"file://{out}/graph/edges").count() == 2
    assert "| Title | 1 | 1 |" in spark.read.text(f"file://{out}/report", wholetext=True).first().value
    main(["list"])
    assert "bm25_topk" in capsys.readouterr().out
