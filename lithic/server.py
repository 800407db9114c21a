"""HTTP: POST /sql, /mutate and /index with JSON bodies, GET /tables; transactions under /tx."""

from __future__ import annotations

import json
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .database import Database, Transaction
from .errors import LithicError, TableNotFound
from .operators import unique
from .sources.formats import to_json_lines


class Service:
    """Requests against one database; changes run one at a time."""

    def __init__(self, db: Database):
        self.db, self.lock = db, threading.Lock()
        self.open: dict[str, Transaction] = {}

    def handle(self, path: str, body: dict) -> dict:
        match path:
            case "/tables":
                return {"tables": self.db.tables()}
            case "/sql":
                db = self.db if body.get("snapshot") is None else self.db.at(int(body["snapshot"]))
                return {"rows": [json.loads(x) for x in to_json_lines(db.sql(body["sql"]))]}
            case "/mutate":
                with self.lock:
                    return {"rows": self.db.mutate(body["sql"])}
            case "/index":
                with self.lock:
                    unique.create_index(self.db.table(body["table"]), body["name"], body["column"], bool(body.get("unique")))
                return {}
            case "/tx/begin":
                name = uuid.uuid4().hex
                self.open[name] = self.db.transaction()
                return {"tx": name}
            case "/tx/insert":
                t = self.db.table(body["table"])
                self.open[body["tx"]].insert(body["table"], self.db.spark.createDataFrame([tuple(r) for r in body["rows"]], t.schema()))
                return {}
            case "/tx/commit":
                with self.lock:
                    return {"rows": self.open.pop(body["tx"]).commit()}
            case "/tx/rollback":
                self.open.pop(body["tx"]).rollback()
                return {}
        raise TableNotFound(path)


def serve(db: Database, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A running server; stop it with ``shutdown()``."""
    service = Service(db)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                code, out = 200, service.handle(self.path, json.loads(self.rfile.read(size) or b"{}"))
            except (LithicError, KeyError, ValueError) as e:
                code, out = 400, {"error": type(e).__name__, "message": str(e)}
            except Exception as e:  # Spark's own errors
                code, out = 500, {"error": type(e).__name__, "message": str(e)[:2000]}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
