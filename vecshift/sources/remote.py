"""Collections behind HTTP services.

Requests go through a ``transport(method, url, headers, body) -> dict``, by default over HTTPS; tests give their own. Ids
are listed by cursor, one page after the other, which is all that such services offer; the driver holds a bounded number of
them and writes them to the shared folder part by part. Records are fetched, written and searched by the executors, a bounded
number per request, so vectors never pass through the driver.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.functions.ids import point_id
from vecshift.functions.staging import staging_path
from vecshift.sources.contract import FALSE, RECORD, TRUE, UNKNOWN, ResourceInfo, Store

#: Ids listed by one request, records moved by one request.
LIST_IDS, BATCH_RECORDS = 100, 100
#: Listed ids held by the driver before they are written to the shared folder.
HELD_IDS = 100_000
TIMEOUT_S, ATTEMPTS, FIRST_WAIT_S = 60, 3, 2.0

Transport = Callable[[str, str, dict, dict | None], dict]


class HttpError(RuntimeError):
    def __init__(self, status: int, text: str = ""):
        super().__init__(f"HTTP {status} {text[:200]}")
        self.status = status


def https(method: str, url: str, headers: dict, body: dict | None) -> dict:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.loads(answer.read() or b"{}")
    except urllib.error.HTTPError as error:
        raise HttpError(error.code, error.read().decode(errors="replace")) from None


def retried(call: Callable[[], dict], wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer of ``call``; time-outs, 429 and server errors are tried ATTEMPTS times, other errors once."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except (TimeoutError, urllib.error.URLError, HttpError) as error:
            final = isinstance(error, HttpError) and error.status != 429 and error.status < 500
            if final or attempt == ATTEMPTS - 1:
                raise
            wait(FIRST_WAIT_S * 2**attempt)
    raise AssertionError


class RemoteStore(Store):
    def __init__(self, spark: SparkSession, endpoint: str, credential: str | None, transport: Transport = https):
        super().__init__(spark)
        self.endpoint, self.transport = (endpoint or "").rstrip("/"), transport
        self.headers = {self.key_header: credential} if credential else {}

    key_header = "Api-Key"

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        return retried(lambda: self.transport(method, f"{self.endpoint}{path}", self.headers, body))

    def _ids(self, name: str, namespace: str | None, cursor: str | None) -> tuple[list[str], str | None]:
        """One page of ids and the cursor after it."""
        raise NotImplementedError

    def _records(self, answer: dict, namespace: str | None) -> list[tuple]:
        raise NotImplementedError

    def _fetch_request(self, name: str, ids: list[str], namespace: str | None) -> tuple[str, str, dict | None]:
        raise NotImplementedError

    def _write_request(self, name: str, rows: list[dict], namespace: str | None) -> tuple[str, str, dict]:
        raise NotImplementedError

    def _delete_request(self, name: str, ids: list[str], namespace: str | None) -> tuple[str, str, dict]:
        raise NotImplementedError

    def listed(self, name: str, namespace: str | None = None, cursor: str | None = None) -> Iterator[tuple[str, str | None]]:
        """(id, cursor of its page's end) of every record; only ids, page by page."""
        while True:
            ids, cursor = self._ids(name, namespace, cursor)
            yield from ((i, cursor) for i in ids)
            if cursor is None:
                return

    def _got(self, name: str, ids: DataFrame, namespace: str | None) -> DataFrame:
        call, request, records = self._call, self._fetch_request, self._records

        def get(batches):
            import pandas as pd

            for frame in batches:
                wanted = frame["id"].dropna().tolist()
                for start in range(0, len(wanted), BATCH_RECORDS):
                    rows = records(call(*request(name, wanted[start : start + BATCH_RECORDS], namespace)), namespace)
                    yield pd.DataFrame(rows, columns=RECORD.names)

        return ids.select(F.col("id").cast("string").alias("id")).distinct().mapInPandas(get, RECORD)

    def _query_request(self, name: str, vector: list[float], k: int, width: int | None, namespace: str | None) -> tuple[str, str, dict]:
        raise NotImplementedError

    def _matches(self, answer: dict) -> list[tuple[str, float]]:
        raise NotImplementedError

    def listed_ids(self, name: str, namespace: str | None = None) -> DataFrame:
        """``(id)`` of every record, as a table in the shared folder."""
        path, every = staging_path(self.spark, "ids"), self.listed(name, namespace)
        while True:
            part = [(i,) for i, _ in itertools.islice(every, HELD_IDS)]
            self.spark.createDataFrame(part, "id string").write.mode("append").parquet(path)
            if len(part) < HELD_IDS:
                return self.spark.read.schema("id string").parquet(path)

    def read(self, name: str, namespace: str | None = None) -> DataFrame:
        return self._got(name, self.listed_ids(name, namespace), namespace)

    def query(self, name: str, queries: DataFrame, k: int = 10, width: int | None = None, namespace: str | None = None) -> DataFrame:
        """As the service answers; a request for each query, sent by the executors."""
        call, request, matches = self._call, self._prepared_query(name), self._matches

        def ask(batches):
            import pandas as pd

            for frame in batches:
                rows = []
                for query, vector in zip(frame["id"], frame["vector"], strict=True):
                    found = matches(call(*request(_floats(vector), k, width, namespace)))
                    rows += [(query, i, score, n) for n, (i, score) in enumerate(found, 1)]
                yield pd.DataFrame(rows, columns=["query_id", "id", "score", "rank"])

        return queries.select("id", "vector").where("id is not null and vector is not null").mapInPandas(ask, f"query_id {queries.schema['id'].dataType.simpleString()}, id string, score double, rank bigint")

    def _prepared_query(self, name: str):
        make = self._query_request
        return lambda vector, k, width, namespace: make(name, vector, k, width, namespace)

    def scan(self, name: str, size: int, cursor: str | None = None, namespace: str | None = None) -> tuple[DataFrame, str | None]:
        """Chains list pages until there are ``size`` ids or no more; the cursor is that of the last page."""
        ids: list[str] = []
        while len(ids) < size:
            some, cursor = self._ids(name, namespace, cursor)
            ids += some
            if cursor is None:
                break
        return self.fetch(name, self.spark.createDataFrame([(i,) for i in ids], "id string"), namespace), cursor

    def fetch(self, name: str, ids: DataFrame, namespace: str | None = None) -> DataFrame:
        return self._got(name, ids, namespace)

    def _sent(self, frame: DataFrame, request) -> int:
        call = self._call

        def send(batches):
            import pandas as pd

            for part in batches:
                rows = part.astype(object).where(part.notna(), None).to_dict("records") if len(part) else []
                for start in range(0, len(rows), BATCH_RECORDS):
                    call(*request(rows[start : start + BATCH_RECORDS]))
                yield pd.DataFrame({"n": [len(rows)]})

        return frame.mapInPandas(send, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def upsert(self, name: str, records: DataFrame, batch: int, namespace: str | None = None) -> int:
        """Services replace by id, so a batch sent again changes nothing."""
        make = self._write_request
        return self._sent(records.select("id", "vector", "payload", *(["namespace"] if "namespace" in records.columns else [])), lambda rows: make(name, rows, namespace))

    def delete(self, name: str, ids: DataFrame, batch: int, namespace: str | None = None) -> int:
        make = self._delete_request
        return self._sent(ids.select("id").distinct(), lambda rows: make(name, [r["id"] for r in rows], namespace))


def _floats(vector) -> list[float] | None:
    return None if vector is None else [float(x) for x in vector]


class PagedIndex(RemoteStore):
    """An index service whose ids can be listed (serverless indexes only) and whose namespaces are part of requests."""

    provider = "index"
    abilities = {
        "connectivity": {"tls": TRUE},
        "data": {"list_vectors": UNKNOWN, "scan_vectors": UNKNOWN, "retrieve_vectors": TRUE, "retrieve_payload": TRUE, "cdc": FALSE},
        "representation": {"dimension": TRUE, "metric": TRUE, "datatype": TRUE, "dense_vectors": TRUE, "sparse_vectors": TRUE, "named_vectors": FALSE},
        "index": {"retrieve_config": TRUE, "configure_index": TRUE},
        "migration": {"resumable_scan": UNKNOWN, "export": FALSE, "cdc": FALSE},
    }

    def validate(self) -> bool:
        try:
            self._call("GET", "/indexes")
            return True
        except Exception:
            return False

    def info(self, name: str, namespace: str | None = None) -> ResourceInfo:
        about = self._call("GET", f"/indexes/{name}")
        counts = self._call("POST", f"/{name}/describe_index_stats", {})
        count = (counts.get("namespaces", {}).get(namespace) or {}).get("vectorCount", 0) if namespace else counts.get("totalVectorCount")
        return ResourceInfo(name, about.get("dimension"), about.get("metric", "unknown"), "float32", UNKNOWN, count)

    def _ids(self, name, namespace, cursor):
        about = self._call("GET", f"/indexes/{name}")
        if "pod" in about.get("spec", {}):
            raise ValueError(f"{name} is a pod index; its ids can't be listed")
        query = "".join(f"&{k}={v}" for k, v in (("namespace", namespace), ("paginationToken", cursor)) if v)
        answer = self._call("GET", f"/{name}/vectors/list?limit={LIST_IDS}{query}")
        return [v["id"] for v in answer.get("vectors", [])], (answer.get("pagination") or {}).get("next")

    def _fetch_request(self, name, ids, namespace):
        from urllib.parse import urlencode

        return "GET", f"/{name}/vectors/fetch?" + urlencode([("ids", i) for i in ids] + ([("namespace", namespace)] if namespace else [])), None

    def _records(self, answer, namespace):
        return [(v["id"], namespace, _floats(v.get("values")), None, None, json.dumps(v.get("metadata") or {})) for v in answer.get("vectors", {}).values()]

    def _write_request(self, name, rows, namespace):
        vectors = [{"id": r["id"], "values": _floats(r["vector"]), "metadata": json.loads(r.get("payload") or "{}")} for r in rows]
        return "POST", f"/{name}/vectors/upsert", {"vectors": vectors} | ({"namespace": namespace} if namespace else {})

    def _delete_request(self, name, ids, namespace):
        return "POST", f"/{name}/vectors/delete", {"ids": ids} | ({"namespace": namespace} if namespace else {})

    def _query_request(self, name, vector, k, width, namespace):
        """The service chooses its own search width."""
        return "POST", f"/{name}/query", {"vector": vector, "topK": k} | ({"namespace": namespace} if namespace else {})

    def _matches(self, answer):
        return [(m["id"], float(m["score"])) for m in answer.get("matches", [])]

    def create(self, name, metric="cosine", datatype="float32", dimension=None):
        self._call("POST", "/indexes", {"name": name, "metric": metric, "dimension": dimension, "spec": {"serverless": {}}})

    def drop(self, name):
        self._call("DELETE", f"/indexes/{name}")


#: Names of metrics in a point store (fixed values).
DISTANCES = {"Cosine": "cosine", "Dot": "dot", "Euclid": "euclidean", "Manhattan": "manhattan"}


class PointStore(RemoteStore):
    """A store of points that takes digits and UUIDs as ids only: others are derived, the original kept in the payload; so
    is the namespace. A collection may name its vectors: the first dense one is used."""

    provider = "points"
    key_header = "api-key"
    abilities = {
        "data": {"list_vectors": TRUE, "scan_vectors": TRUE, "retrieve_vectors": TRUE, "retrieve_payload": TRUE, "cdc": FALSE},
        "representation": {"dimension": TRUE, "metric": TRUE, "datatype": TRUE, "dense_vectors": TRUE, "sparse_vectors": TRUE, "named_vectors": TRUE},
        "index": {"retrieve_config": TRUE, "configure_index": TRUE},
        "migration": {"resumable_scan": TRUE, "export": FALSE, "cdc": FALSE},
    }

    def validate(self) -> bool:
        try:
            self._call("GET", "/collections")
            return True
        except Exception:
            return False

    def _config(self, name: str) -> dict:
        return self._call("GET", f"/collections/{name}").get("result", {})

    def vector_name(self, name: str) -> tuple[str | None, dict]:
        """(name of the vector in use, or null for the unnamed one; its settings)."""
        vectors = self._config(name).get("config", {}).get("params", {}).get("vectors", {})
        return (None, vectors) if "size" in vectors or not vectors else next(iter(vectors.items()))

    def info(self, name: str, namespace: str | None = None) -> ResourceInfo:
        config = self._config(name)
        _, vector = self.vector_name(name)
        metric = DISTANCES.get(vector.get("distance"), "unknown")
        return ResourceInfo(name, vector.get("size"), metric, "float32", TRUE if config.get("config", {}).get("quantization_config") else FALSE, config.get("points_count"))

    @staticmethod
    def _filter(namespace):
        return {"filter": {"must": [{"key": "__namespace", "match": {"value": namespace}}]}} if namespace else {}

    def _ids(self, name, namespace, cursor):
        """Cursors keep the kind of the id: ``int:5`` or ``str:...``."""
        offset = {} if cursor is None else {"offset": int(cursor[4:]) if cursor.startswith("int:") else cursor[4:]}
        answer = self._call("POST", f"/collections/{name}/points/scroll", {"limit": LIST_IDS, "with_payload": False, "with_vector": False} | offset | self._filter(namespace))["result"]
        after = answer.get("next_page_offset")
        return [str(p["id"]) for p in answer["points"]], None if after is None else f"{'int' if isinstance(after, int) else 'str'}:{after}"

    def _fetch_request(self, name, ids, namespace):
        return "POST", f"/collections/{name}/points", {"ids": [int(i) if i.isdigit() else i for i in ids], "with_payload": True, "with_vector": True}

    def _records(self, answer, namespace):
        rows = []
        for point in answer.get("result", []):
            payload = dict(point.get("payload") or {})
            space, original = payload.pop("__namespace", None), payload.pop("__source_id", str(point["id"]))
            vector = point.get("vector")
            if isinstance(vector, dict):
                vector = next((v for v in vector.values() if isinstance(v, list)), None)
            if namespace is None or space == namespace:
                rows.append((original, space, _floats(vector), None, None, json.dumps(payload)))
        return rows

    def _prepared_query(self, name):
        named = self.vector_name(name)[0]

        def make(vector, k, width, namespace):
            body = {"vector": {"name": named, "vector": vector} if named else vector, "limit": k, "with_payload": ["__source_id"]} | self._filter(namespace)
            return "POST", f"/collections/{name}/points/search", body | ({"params": {"hnsw_ef": width}} if width else {})

        return make

    def _matches(self, answer):
        return [((p.get("payload") or {}).get("__source_id", str(p["id"])), float(p["score"])) for p in answer.get("result", [])]

    def create(self, name, metric="cosine", datatype="float32", dimension=None):
        distance = {v: k for k, v in DISTANCES.items()}[metric]
        self._call("PUT", f"/collections/{name}", {"vectors": {"size": dimension, "distance": distance}})

    def drop(self, name):
        self._call("DELETE", f"/collections/{name}")

    def fetch(self, name, ids, namespace=None):
        return self._got(name, ids.select(point_id(F.col("id").cast("string")).alias("id")), namespace)

    def _sendable(self, records):
        return records.withColumn("point", point_id(F.col("id")))

    def upsert(self, name, records, batch, namespace=None):
        rows = self._sendable(records).select("id", "point", "vector", "payload", (F.coalesce(F.col("namespace"), F.lit(namespace)) if "namespace" in records.columns else F.lit(namespace)).cast("string").alias("namespace"))
        named = self.vector_name(name)[0]

        def make(part):
            points = []
            for r in part:
                extra = ({"__source_id": r["id"]} if r["point"] != r["id"] else {}) | ({"__namespace": r["namespace"]} if r["namespace"] else {})
                vector = _floats(r["vector"])
                points.append({"id": int(r["point"]) if r["point"].isdigit() else r["point"], "vector": {named: vector} if named else vector, "payload": json.loads(r["payload"] or "{}") | extra})
            return "PUT", f"/collections/{name}/points?wait=true", {"points": points}

        return self._sent(rows, make)

    def delete(self, name, ids, batch, namespace=None):
        points = ids.select(point_id(F.col("id").cast("string")).alias("id")).distinct()
        return self._sent(points, lambda rows: ("POST", f"/collections/{name}/points/delete?wait=true", {"points": [int(r["id"]) if r["id"].isdigit() else r["id"] for r in rows]}))
