"""The engine over HTTP, with JSON bodies."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .plans.query import QuerySyntaxError

#: Request fields of the ranker route and the parameters they set.
RANKER_FIELDS = {"BM25_K1": "k1", "BM25_B": "b", "PHRASE_BOOST": "phrase_boost", "EXACT_MATCH_WEIGHT": "exact_match_weight"}

PAGE = """<!doctype html><title>Search</title><h1>Routes</h1><ul>
<li>GET /search?query=&amp;accuracy=</li><li>PUT /setThreadsNumber {"threads"}</li><li>POST /crawl {"seedUrls", "numberOfPages", "clear"}</li>
<li>PUT /crawl_terminate {"clearDocumentsHistory"}</li><li>POST /indexDocuments {"clear"}</li><li>PUT /indexDocuments_terminate {"clearIndexHistory"}</li>
<li>POST /crawlAndIndexDocument {"seedUrls", "numberOfPages", "clear"}</li><li>DELETE /clearCrawlHistory</li>
<li>PUT /setRankerParameters {"BM25_K1", "BM25_B", "PHRASE_BOOST", "EXACT_MATCH_WEIGHT"}</li></ul>"""


def answer(engine: Engine, method: str, target: str, body: str = "") -> tuple[int, str, str]:
    """(status, content type, text) of one request."""
    parts = urlsplit(target)
    query = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    kind = "application/json"
    try:
        data = json.loads(body) if body.strip() else {}
        match method, parts.path:
            case "GET", "/":
                return 200, "text/html", PAGE
            case "GET", "/search":
                out = engine.search_json(query["query"], float(query.get("accuracy", 0.5)))
                return 200, kind, json.dumps(out, ensure_ascii=False)
            case "PUT", "/setThreadsNumber":
                engine.set_parallelism(int(data["threads"]))
            case "POST", "/crawl":
                engine.crawl(list(data["seedUrls"]), int(data["numberOfPages"]), bool(data.get("clear", False)))
            case "PUT", "/crawl_terminate":
                engine.terminate_crawl(bool(data.get("clearDocumentsHistory", False)))
            case "POST", "/indexDocuments":
                engine.index_documents(bool(data.get("clear", False)))
            case "PUT", "/indexDocuments_terminate":
                engine.terminate_index(bool(data.get("clearIndexHistory", False)))
            case "POST", "/crawlAndIndexDocument":
                engine.crawl_and_index(list(data["seedUrls"]), int(data["numberOfPages"]), bool(data.get("clear", False)))
            case "DELETE", "/clearCrawlHistory":
                engine.clear_crawl_history()
            case "PUT", "/setRankerParameters":
                engine.set_ranker_parameters(**{p: float(data[f]) for f, p in RANKER_FIELDS.items() if f in data})
            case _:
                return 404, kind, json.dumps({"error": "no such route"})
    except (KeyError, TypeError, ValueError, QuerySyntaxError) as e:
        return 404, kind, json.dumps({"error": f"{type(e).__name__}: {e}"})
    except Exception as e:  # a job that failed is answered too
        return 500, kind, json.dumps({"error": f"{type(e).__name__}: {str(e)[:500]}"})
    return 200, kind, json.dumps({"status": "done"})


def serve(engine: Engine, host: str = "0.0.0.0", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the engine; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, kind, text = answer(engine, self.command, self.path, body)
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_PUT = do_POST = do_DELETE = _any

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
