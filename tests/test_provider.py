import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docspark.sources import provider as P


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        order, drop, shift = -1, 0, 0

        def _send(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._send({"models": [{"name": "m:v2", "digest": "d2"}, {"name": "m:v1", "digest": "d1"}, {"name": "n:latest", "digest": "d3"}, {"name": "bare"}]})

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            rows = [{"index": i + Handler.shift, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)]
            self._send({"data": rows[:: Handler.order][Handler.drop :]})

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{s.server_port}/", Handler
    s.shutdown()


def test_order_prefix_and_errors(server):
    url, handler = server
    p = P.HttpProvider(url, "m", prefix="xx")
    assert p.embed(["a", "bbb"]) == [[3.0, 1.0], [5.0, 1.0]]
    assert p.embed([]) == []
    handler.drop = 1
    with pytest.raises(ValueError):
        p.embed(["a", "bbb"])
    handler.drop, handler.shift = 0, 1
    with pytest.raises(ValueError):
        p.embed(["a", "bbb"])


def test_identity_and_health(server):
    url, _ = server
    assert [P.HttpProvider(url, m).identity() for m in ("m:v1", "m", "n")] == ["d1", "d2", "d3"]
    with pytest.raises(LookupError):
        P.HttpProvider(url, "bare").identity()
    assert P.HttpProvider(url, "m").healthy()
    assert not P.HttpProvider("127.0.0.1:1", "m", timeout=1).healthy()


def test_text_forms():
    assert P.base_url(" host:1/ ") == "http://host:1"
    assert P.base_url("https://h//") == "https://h"
    assert P.model_dims("a:b:512") == ("a:b", 512)
    for bad in ("m", ":5", "m:", "m:x", "m:0", "m:-1"):
        with pytest.raises(ValueError):
            P.model_dims(bad)
    assert P.agent(" a , d , http://x/ ") == P.Agent("a", "d", "http://x")
    for bad in ("a,b", "a,,c", ""):
        with pytest.raises(ValueError):
            P.agent(bad)
