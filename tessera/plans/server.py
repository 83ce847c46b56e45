"""A session behind a socket: frames of a 4-byte big-endian length and JSON. Requests run one at a time."""

from __future__ import annotations

import json
import socketserver
import struct
import threading

from tessera.functions.errors import RUNTIME, SqlError
from tessera.plans.session import Session

#: A frame's bytes at most.
MOST = 64 << 20


def read_frame(stream) -> dict | None:
    head = stream.read(4)
    if len(head) < 4:
        return None
    (n,) = struct.unpack(">I", head)
    if n > MOST:
        raise SqlError(f"a frame of {n} bytes is too large")
    return json.loads(stream.read(n))


def frame(message: dict) -> bytes:
    body = json.dumps(message, default=str).encode()
    return struct.pack(">I", len(body)) + body


def _bounded(df) -> list[list]:
    """The rows, fetched a partition at a time, as long as they fit into a frame."""
    rows, size = [], 0
    for r in df.toLocalIterator():
        rows.append(list(r))
        size += len(json.dumps(rows[-1], default=str))
        if size > MOST // 2:
            raise SqlError(f"a result of over {MOST // 2} bytes: ask for less with WHERE or LIMIT")
    return rows


def answer(session: Session, request: dict) -> dict:
    try:
        if request.get("operation") == "batchUpdate":
            sets = request.get("parameterSets") or []
            return {"ok": True, "updateCounts": [1] * session.execute_batch(request["sql"], sets)}
        if request.get("operation") == "metadata":
            return {"ok": True, "rows": session.metadata(request.get("of", "tables"), request.get("table"))}
        got = session.execute(request["sql"], request.get("parameters"))
        if got.df is not None:
            return {"ok": True, "columns": got.columns(), "rows": _bounded(got.df)}
        return {"ok": True, "updateCount": got.update_count}
    except SqlError as e:
        return {"ok": False, "error": str(e), "sqlState": e.sqlstate}
    except Exception as e:  # noqa: BLE001  the client is told; the server goes on
        return {"ok": False, "error": str(e), "sqlState": RUNTIME}


def serve(session: Session, port: int = 0, host: str = "127.0.0.1") -> socketserver.ThreadingTCPServer:
    """A running server; ``server.server_address`` has the port, ``server.shutdown()`` ends it."""
    lock = threading.Lock()

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            while (request := read_frame(self.rfile)) is not None:
                with lock:
                    out = answer(session, request)
                self.wfile.write(frame(out))

    server = socketserver.ThreadingTCPServer((host, port), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
