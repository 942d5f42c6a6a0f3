"""Ingest over HTTP: a payload in, its record out.

A request's payload goes through the same batch plan as any other, is added to the
catalog's table as a generation of its own, and the answer holds the record and the
catalog as it then is.  For a stream of payloads drop files instead (see `ingest`).
"""

from __future__ import annotations

import json
import threading
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import catalog_totals, published
from ..plans.fusion import tables_in
from ..sources.sinks import read_table
from ..workers import shared_folder
from .ingest import PAYLOAD, ingest, latest

ROUTE = "/api/ingest"


class Refused(ValueError):
    """A payload that names no product, no known category or no text."""


class Gateway:
    """Takes payloads one at a time into the tables under a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.turn = spark, folder.rstrip("/"), threading.Lock()

    def _table(self, name: str) -> DataFrame | None:
        found = read_table(self.spark, f"{self.folder}/{name}")
        return None if found is None else latest(found)

    def take(self, payload: dict) -> dict:
        """The record, the catalog's totals, and the ids of all products published so far."""
        row = json.dumps({k: payload.get(k) for k in ("product_id", "category", "sources")})
        one = self.spark.createDataFrame([(row,)], "row string").select(F.from_json("row", PAYLOAD).alias("p")).select("p.*")
        with self.turn:
            records, catalog, rejected = ingest(one, tables_in(shared_folder(self.spark, "gateway")))
            refused = rejected.first()
            if refused is not None:
                raise Refused(refused["reason"])
            known = self._table("catalog")
            batch = 0 if known is None else known.agg(F.max("batch")).first()[0] + 1
            for name, table in (("records", records), ("catalog", catalog)):
                table.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
            known, kept = self._table("catalog"), self._table("records")
            record = kept.where(F.col("batch") == batch).first()
            ids = [r["product_id"] for r in published(known, kept).select("product_id").orderBy("product_id").collect()]
            return {"ok": True, "record": json.loads(record["json"]), "totals": catalog_totals(known).first().asDict(), "products": ids}

    def serve(self, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
        """A server in a thread of its own; its address is server_address, shutdown() ends it."""
        gateway = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, status: HTTPStatus, body: dict) -> None:
                data = json.dumps(body, ensure_ascii=False).encode()
                self.send_response(status)
                for name, value in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), ("Cache-Control", "no-store")):
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(data)

            def do_POST(self) -> None:  # noqa: N802
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path.partition("?")[0] != ROUTE:
                    return self._answer(HTTPStatus.NOT_FOUND, {"ok": False, "error": "not found"})
                try:
                    payload = json.loads(body or b"{}")
                    if not isinstance(payload, dict):
                        raise ValueError("the payload must be a JSON object")
                except ValueError as e:
                    return self._answer(HTTPStatus.BAD_REQUEST, {"ok": False, "error": f"bad request: {e}"})
                try:
                    return self._answer(HTTPStatus.OK, gateway.take(payload))
                except Exception as e:
                    return self._answer(HTTPStatus.INTERNAL_SERVER_ERROR, {"ok": False, "error": f"{type(e).__name__}: {e}"})

            def do_GET(self) -> None:  # noqa: N802
                self._answer(HTTPStatus.NOT_FOUND, {"ok": False, "error": "not found"})

            def log_message(self, *args) -> None:
                """Requests aren't logged."""

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
