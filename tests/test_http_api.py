"""JSON services read in batch and as a stream, from a server in this process, and recorded snapshots."""

import json
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from homelens.sources import controller, dns_log, http_api


@pytest.fixture()
def service():
    start = time.time()
    rows = [{"id": i, "time": start - 100 + i, "domain": f"d{i}.example", "client": "10.0.0.2", "type": "A", "status": "FORWARDED"} for i in range(90)]

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body, code=200):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.answer({"session": {"sid": "s1"}} if said == {"password": "secret"} else {}, 200)

        def do_GET(self):
            url = urlparse(self.path)
            asked = parse_qs(url.query)
            if url.path == "/queries" and self.headers["sid"] == "s1":
                since = float(asked.get("from", [0])[0])
                self.answer({"queries": [r for r in list(rows) if r["time"] >= since]})
            elif url.path == "/clients" and asked.get("auth") == ["t1"]:
                self.answer([{"mac": "aa:bb:cc:dd:ee:ff"}, {"mac": "aa:bb:cc:dd:ee:00"}])
            elif url.path == "/events" and asked.get("auth") == ["t1"]:
                self.answer({"data": [{"_id": "e1"}]})
            else:
                self.answer({"error": "no"}, 401)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", rows
    server.shutdown()


def test_paths_in_batch(spark, service):
    http_api.register(spark)
    read = spark.read.format("json_api").option("url", service[0]).option("paths", "clients,events").option("auth", "token")
    got = read.option("token", "t1").load()
    assert sorted((r["path"], json.loads(r["payload"]).get("mac")) for r in got.collect()) == [("clients", "aa:bb:cc:dd:ee:00"), ("clients", "aa:bb:cc:dd:ee:ff"), ("events", None)]
    with pytest.raises(Exception, match="401"):
        read.option("token", "wrong").load().collect()
    with pytest.raises(ValueError):
        http_api.Api({"url": service[0], "auth": "magic"})


def test_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    url, rows = service
    http_api.register(spark)

    def poll():
        stream = spark.readStream.format("json_api").option("url", url).option("auth", "password").option("password", "secret")
        stream = stream.option("since", str(rows[0]["time"])).option("slice", "30").option("lag", "0").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["source_id"] for r in dns_log.normalize_queries(spark.read.parquet(str(tmp_path / "out")).select("payload")).filter("error IS NULL").collect())

    assert poll() == sorted(str(i) for i in range(90))
    rows.append({**rows[0], "id": 90, "time": time.time()})
    time.sleep(0.2)
    assert poll() == sorted(str(i) for i in range(91))


def test_recorded_snapshot(spark, tmp_path):
    (tmp_path / "clients.json").write_text(json.dumps({"data": [{"_id": "c1", "mac": "AA-BB-CC-DD-EE-FF", "hostname": "tablet"}]}))
    (tmp_path / "events.json").write_text(json.dumps({"data": [{"_id": "e1", "key": "x", "msg": "y", "time": 1700000000}]}))
    clients, events = controller.read_snapshot(spark, str(tmp_path), "2026-01-01 00:00:00")
    assert [(r["controller_id"], r["mac"], r["hostname"]) for r in clients.collect()] == [("c1", "aa:bb:cc:dd:ee:ff", "tablet")]
    assert [r["id"] for r in events.collect()] == ["e1"]
    with pytest.raises(Exception):
        controller.read_snapshot(spark, str(tmp_path / "none"), "2026-01-01 00:00:00")[0].collect()


def test_lines_of_a_socket(spark):
    from homelens.streaming import live

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        with link:
            link.sendall(b"<30>Jan  1 00:00:00 gw kernel: first\n\n<30>Jan  1 00:00:01 gw kernel: second\n")
            time.sleep(20)

    threading.Thread(target=serve, daemon=True).start()
    query = live.stream_socket(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("socket_lines").start()
    try:
        until = time.time() + 20
        while time.time() < until and spark.table("socket_lines").count() < 2:
            query.processAllAvailable()
        assert spark.table("socket_lines").count() == 2
    finally:
        query.stop()
        server.close()
