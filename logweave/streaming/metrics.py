"""Counters of stages: observed in the plan, collected by a listener, read over HTTP."""

from __future__ import annotations

import http.server
import json
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observe(df: DataFrame, stage: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """Counts all records of a stage, and those of the given tags, as they pass."""
    return df.observe(stage, F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("tag") == t).alias(f"n:{t}") for t in tags])


class Registry(StreamingQueryListener):
    """Latest metrics by name; values may also be functions that are called when read."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._of: dict[str, object] = {}
        self._total: dict[tuple[str, str], int] = {}

    def add(self, name: str, fn: Callable[[], object]) -> None:
        with self._lock:
            self._of[name] = fn

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._put(f"query:{event.id}", {"started": time.time()})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self._put(f"query:{p.id}", {"batch": p.batchId, "rows": p.numInputRows, "rows_per_sec": p.processedRowsPerSecond})
        for name, row in (p.observedMetrics or {}).items():
            counts = row.asDict()
            self._put(name, counts)
            with self._lock:
                for k, n in counts.items():
                    self._total[name, k] = self._total.get((name, k), 0) + (n or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(f"query:{event.id}", {"ended": time.time(), "error": event.exception})

    def _put(self, name: str, value: object) -> None:
        with self._lock:
            self._of[name] = value

    def read(self) -> dict[str, object]:
        with self._lock:
            return {k: v() if callable(v) else v for k, v in self._of.items()}

    def to_json(self) -> str:
        return json.dumps(self.read(), default=str)

    def to_prometheus(self) -> str:
        """Totals of observed stages, and the values of functions that return numbers."""
        with self._lock:
            totals, named = sorted(self._total.items()), [(k, v) for k, v in sorted(self._of.items()) if callable(v)]
        out = ["# TYPE logweave_rows_total counter"]
        for (stage, k), n in totals:
            tag = f",tag={_quoted(k[2:])}" if k.startswith("n:") else ""
            name = "logweave_tag_rows_total" if tag else "logweave_rows_total"
            out.append(f"{name}{{stage={_quoted(stage)}{tag}}} {n}")
        for k, v in named:
            if isinstance(x := v(), (int, float)):
                out.append(f"logweave_value{{name={_quoted(k)}}} {float(x):g}")
        return "\n".join(out) + "\n"


def _quoted(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def serve(registry: Registry, addr: str) -> http.server.ThreadingHTTPServer:
    """Answer ``/health``, ``/monitor`` (JSON) and ``/metrics`` (for scrapers) at ``host:port``, until ``shutdown()``."""
    pages = {"/health": (lambda: "ok", "text/plain"), "/monitor": (registry.to_json, "application/json"), "/metrics": (registry.to_prometheus, "text/plain; version=0.0.4")}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body, kind = pages.get(self.path.partition("?")[0], (None, ""))
            if body is None:
                self.send_error(404)
                return
            data = body().encode()
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    host, _, port = addr.rpartition(":")
    server = http.server.ThreadingHTTPServer((host, int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def heartbeat(registry: Registry, seconds: float) -> Callable[[], None]:
    """Log what the registry holds every ``seconds``; the returned function ends it."""
    done = threading.Event()

    def beat() -> None:
        while not done.wait(seconds):
            logging.getLogger("logweave").info("heartbeat threads=%d %s", threading.active_count(), registry.to_json())

    threading.Thread(target=beat, daemon=True).start()
    return done.set
