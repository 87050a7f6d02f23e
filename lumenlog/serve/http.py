"""The HTTP/JSON interface."""

from __future__ import annotations

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from .state import NotFound, Service, Unpublished

LARGEST_FILE = 2_000_000


def route(service: Service, method: str, path: str, body: bytes) -> tuple[int, dict | list | None]:
    """A status and what to send as JSON."""
    parts = [unquote(p) for p in path.split("?", 1)[0].strip("/").split("/") if p]
    if method == "OPTIONS":
        return 204, None
    try:
        if parts[:1] == ["query"]:
            return _query(service, method, parts[1:], body)
        if method != "GET":
            return 405, {"error": f"{method} isn't allowed here"}
        match parts:
            case [] | ["relations"]:
                return 200, {"relations": service.listing()}
            case ["relations", name]:
                rows = service.rows(name)
                return 200, {"name": name, "count": len(rows), "rows": rows}
            case ["program"]:
                return 200, {"path": service.path, "files": [{"path": p, "source": t} for p, t in service.program.texts.items()]}
            case ["spec"]:
                return _spec(service)
            case ["files"]:
                return 200, {"roots": list(service.roots), "files": sorted(_files(service))}
            case ["file", *rest]:
                return _file(service, "/".join(rest))
        return 404, {"error": f"there is nothing at /{'/'.join(parts)}"}
    except NotFound as e:
        return 404, {"error": e.said}


def _query(service: Service, method: str, parts: list[str], body: bytes) -> tuple[int, dict | None]:
    live = service.live
    match method, parts:
        case "GET", []:
            return 200, {"queries": sorted(live.queries)}
        case "POST", []:
            try:
                told = json.loads(body)
                name, program = told["id"], told["program"]
                if not isinstance(name, str) or not isinstance(program, str):
                    raise TypeError("id and program are strings")
            except (ValueError, KeyError, TypeError) as e:
                return 400, {"error": f"the body must be JSON with id and program: {e}"}
            try:
                made = live.add(name, program)
            except Unpublished as e:
                return 503, {"error": str(e)}
            except ValueError as e:
                return 400, {"error": str(e)}
            return 200, {"id": name, "relations": sorted(made.derived)}
        case _, [name, *_] if name not in live.queries:
            return 404, {"error": f"there is no query {name}"}
        case "GET", [name]:
            text, typed = live.queries[name]
            return 200, {"id": name, "program": text, "relations": sorted(typed.program.derived)}
        case "DELETE", [name]:
            live.drop(name)
            return 200, {"id": name, "dropped": True}
        case "GET", [name, "relations"]:
            decls = live.queries[name][1].program.derived
            return 200, {"relations": [{"name": n, "count": df.count(), "columns": service.columns(decls[n])} for n, df in sorted(service.query_relations(name).items())]}
        case "GET", [name, "relations", relation]:
            rows = service.query_rows(name, relation)
            return 200, {"name": relation, "count": len(rows), "rows": rows}
    return 405, {"error": f"{method} isn't allowed here"}


def _spec(service: Service) -> tuple[int, dict]:
    side = os.path.splitext(service.path)[0] + ".viz.json" if service.path else ""
    if not os.path.isfile(side):
        raise NotFound("the program has no spec beside it")
    with open(side, encoding="utf-8") as f:
        return 200, json.load(f)


def _files(service: Service):
    from ..sources.fs import walk

    for root in service.roots:
        yield from walk(root, [])


def _file(service: Service, path: str) -> tuple[int, dict]:
    """A file below a root, and nothing above it."""
    for root in map(os.path.realpath, service.roots):
        full = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([full, root]) == root and os.path.isfile(full):
            if os.path.getsize(full) > LARGEST_FILE:
                return 413, {"error": f"{path} is larger than {LARGEST_FILE} bytes"}
            with open(full, encoding="utf-8", errors="replace") as f:
                return 200, {"path": path, "content": f.read()}
    raise NotFound(f"there is no file {path}")


def serve(service: Service, address: str = "127.0.0.1:7777") -> ThreadingHTTPServer:
    """A server on a thread of its own; shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, told = route(service, self.command, self.path, body)
            except Exception as e:  # a query's failure mustn't end the server
                status, told = 500, {"error": str(e)[:2000]}
            sent = b"" if told is None else json.dumps(told).encode()
            self.send_response(status)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(sent)), "Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, DELETE, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(sent)

        do_GET = do_POST = do_DELETE = do_PUT = do_PATCH = do_OPTIONS = answer

        def log_message(self, *_: object) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host or "127.0.0.1", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
