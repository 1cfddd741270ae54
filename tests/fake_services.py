"""Services kept as JSON files, so that executors' requests meet the same state."""

import json
import re
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from vecshift.sources.remote import HttpError


def similarity(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


class FakeIndex:
    def __init__(self, folder, n=0, pod=False):
        self.folder, self.pod = Path(folder), pod
        for i in range(n):
            self.put({"id": f"id-{i:04d}", "values": [0.1, 0.2, 0.3], "metadata": {"n": i}})

    def put(self, v):
        (self.folder / f"{v['id']}.json").write_text(json.dumps(v))

    def __call__(self, method, url, headers, body):
        with (self.folder / "calls.log").open("a") as log:
            log.write(f"{method} {url}\n")
        parts, query = urlsplit(url), parse_qs(urlsplit(url).query)
        names = sorted(p.stem for p in self.folder.glob("*.json"))
        if parts.path == "/indexes":
            return {}
        if parts.path.startswith("/indexes/"):
            return {"dimension": 3, "metric": "cosine", "spec": {"pod": {}} if self.pod else {"serverless": {}}}
        if parts.path.endswith("describe_index_stats"):
            return {"totalVectorCount": len(names), "namespaces": {"ns": {"vectorCount": 2}}}
        if parts.path.endswith("vectors/list"):
            start, limit = int(query.get("paginationToken", ["0"])[0]), int(query["limit"][0])
            assert limit <= 100
            after = start + limit
            return {"vectors": [{"id": n} for n in names[start:after]]} | ({"pagination": {"next": str(after)}} if after < len(names) else {})
        if parts.path.endswith("vectors/fetch"):
            there = [json.loads((self.folder / f"{i}.json").read_text()) for i in query["ids"] if i in names]
            return {"vectors": {v["id"]: v for v in there}}
        if parts.path.endswith("/query"):
            every = [json.loads((self.folder / f"{n}.json").read_text()) for n in names]
            best = sorted(((similarity(v["values"], body["vector"]), v["id"]) for v in every), key=lambda x: (-x[0], x[1]))
            return {"matches": [{"id": i, "score": s} for s, i in best[: body["topK"]]]}
        if parts.path.endswith("vectors/upsert"):
            for v in body["vectors"]:
                self.put(v)
            return {}
        if parts.path.endswith("vectors/delete"):
            for i in body["ids"]:
                (self.folder / f"{i}.json").unlink(missing_ok=True)
            return {}
        raise HttpError(404, url)


class FakePoints:
    def __init__(self, folder, named=False):
        self.folder, self.named = Path(folder), named

    def __call__(self, method, url, headers, body):
        path = urlsplit(url).path
        files = {p.stem: p for p in self.folder.glob("*.json")}
        if path == "/collections":
            return {}
        if method == "GET" and re.fullmatch(r"/collections/\w+", path):
            one = {"size": 3, "distance": "Cosine"}
            return {"result": {"points_count": len(files), "config": {"params": {"vectors": {"dense-vector": one} if self.named else one}}}}
        if path.endswith("/points/scroll"):
            every = sorted(files)
            start = every.index(str(body["offset"])) if "offset" in body else 0
            points = [json.loads(files[i].read_text()) for i in every[start : start + body["limit"]]]
            rest = every[start + body["limit"] :]
            return {"result": {"points": points, "next_page_offset": (int(rest[0]) if rest[0].isdigit() else rest[0]) if rest else None}}
        if method in ("PUT", "DELETE") and re.fullmatch(r"/collections/\w+", path):
            return {"result": True}
        if path.endswith("/points/search"):
            vector = body["vector"]["vector"] if isinstance(body["vector"], dict) else body["vector"]
            every = [json.loads(p.read_text()) for p in files.values()]
            best = sorted(((similarity(next(iter(p["vector"].values())) if isinstance(p["vector"], dict) else p["vector"], vector), str(p["id"]), p) for p in every), key=lambda x: (-x[0], x[1]))
            return {"result": [{"id": p["id"], "score": s, "payload": p.get("payload")} for s, _, p in best[: body["limit"]]]}
        if path.endswith("/points/delete"):
            for i in body["points"]:
                files[str(i)].unlink()
            return {}
        if method == "PUT":
            for p in body["points"]:
                (self.folder / f"{p['id']}.json").write_text(json.dumps(p))
            return {}
        return {"result": [json.loads(files[str(i)].read_text()) for i in body["ids"] if str(i) in files]}
