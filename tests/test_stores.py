import json

import numpy as np
import pytest
from fake_services import FakeIndex, FakePoints
from pyspark.sql import functions as F

from vecshift.operators.migrate import CollisionError
from vecshift.plans import embed, state, strategies
from vecshift.plans.pipeline import Migration
from vecshift.sources import contract, pages, remote
from vecshift.sources.files import FileStore
from vecshift.streaming.sync import sync


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, namespace string, vector array<float>, payload string")


def clustered(spark, n=300, d=32, seed=0):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(8, d)) * 3
    matrix = centres[random.integers(0, 8, n)] + random.normal(size=(n, d)) * 0.3
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    return records(spark, [(f"doc-{i:04d}", None, [float(x) for x in v], json.dumps({"seq": i, "text": f"word{i % 40} topic{i % 8} number{i}"})) for i, v in enumerate(matrix)])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_file_store(spark, tmp_path):
    store = FileStore(spark, f"file://{tmp_path}/s")
    assert store.validate() and store.read("c").count() == 0 and store.info("c").dimension is None
    store.create("c", "dot")
    rows = records(spark, [("a", "x", [1.0, 0.0], "{}"), ("a", "y", [0.0, 1.0], "{}"), ("b", "x", [1.0, 1.0], None), ("b", "x", [1.0, 1.0], None)])
    assert store.upsert("c", rows, 1) == store.upsert("c", rows, 1) == 3
    assert store.read("c").count() == 3 and ids(store.read("c", "x")) == ["a", "b"]
    info = store.info("c")
    assert (info.dimension, info.metric, info.count) == (2, "dot", 3)
    before = sorted(map(str, store.read("c").collect()))
    store.upsert("c", records(spark, [("a", "x", [9.0, 9.0], "{}"), ("n", "x", [1.0, 2.0], "{}")]), 2)
    assert store.delete("c", spark.createDataFrame([("b",), ("zz",)], "id string"), 3) == 1
    assert ids(store.read("c", "x")) == ["a", "n"] and ids(store.fetch("c", spark.createDataFrame([("n",)], "id string"))) == ["n"]
    store.undo("c", [2, 3])
    assert sorted(map(str, store.read("c").collect())) == before
    store.upsert("c", records(spark, [("n", "x", [1.0, 2.0], "{}")]), 4)
    store.compact("c")
    assert ids(store.read("c")) == ["a", "a", "b", "n"] and store.log("c").select("batch").distinct().count() == 1
    with pytest.raises(ValueError):
        store.upsert("c", records(spark, [(None, None, [1.0], None)]), 5)
    store.drop("c")
    assert store.read("c").count() == 0


def test_scan_without_loss(spark, tmp_path):
    store = FileStore(spark, f"file://{tmp_path}/s")
    store.upsert("c", records(spark, [(f"i{n:03d}", None, [float(n)], None) for n in range(105)]), 1)
    seen, cursor, calls = [], None, 0
    while True:
        page, cursor = store.scan("c", 50, cursor)
        seen += ids(page)
        calls += 1
        if cursor is None:
            break
    assert calls == 3 and seen == [f"i{n:03d}" for n in range(105)]


def test_capabilities_are_unknown_unless_told(spark, tmp_path):
    rows = {(r["group"], r["capability"]): r["state"] for r in FileStore(spark, f"file://{tmp_path}").capabilities().collect()}
    assert len(rows) == sum(map(len, contract.CAPABILITIES.values())) and rows["connectivity", "connect"] == "TRUE" and rows["representation", "embedding_model"] == "UNKNOWN"


def test_paged_index(spark, tmp_path, monkeypatch):
    store = contract.build_store(spark, " Index ", "https://x", "MY_KEY", transport=FakeIndex(tmp_path, 250))
    assert store.validate() and store.info("c").count == 250 and store.info("c", "ns").count == 2
    page, cursor = store.scan("c", 250)
    assert page.count() == 250 and cursor is None
    page, cursor = store.scan("c", 100)
    rest, end = store.scan("c", 200, cursor)
    assert page.count() == 100 and rest.count() == 150 and end is None and not set(ids(page)) & set(ids(rest))
    assert store.upsert("c", records(spark, [("new", None, [1.0, 2.0, 3.0], '{"a": 1}')] * 1), 1) == 1
    got = store.fetch("c", spark.createDataFrame([("new",), ("none",)], "id string")).collect()
    assert [(r.id, r.vector, json.loads(r.payload)) for r in got] == [("new", [1.0, 2.0, 3.0], {"a": 1})]
    assert store.delete("c", spark.createDataFrame([("new",)], "id string"), 2) == 1 and store.read("c").count() == 250
    with pytest.raises(ValueError, match="pod"):
        remote.PagedIndex(spark, "https://x", None, FakeIndex(tmp_path, pod=True)).scan("c", 10)

    def refuse(*_):
        raise remote.HttpError(401)

    assert remote.PagedIndex(spark, "https://x", None, refuse).validate() is False
    monkeypatch.setenv("MY_KEY", "s3cret")
    assert contract.resolve_secret("MY_KEY") == "s3cret" and contract.resolve_secret("literal") == "literal" and contract.require_secret("MY_KEY") == "s3cret"
    with pytest.raises(contract.CredentialError):
        contract.require_secret("NOT_SET")
    with pytest.raises(ValueError):
        contract.build_store(spark, "other")


@pytest.mark.parametrize("named", [False, True])
def test_point_store(spark, tmp_path, named):
    store = remote.PointStore(spark, "https://x", None, FakePoints(tmp_path, named))
    rows = records(spark, [("cooking-6", "t1", [1.0, 0.0, 0.0], '{"topic": "cooking"}'), ("12", None, [0.0, 1.0, 0.0], None)])
    assert store.upsert("c", rows, 1) == store.upsert("c", rows, 1) == 2
    assert store.info("c").count == 2 and store.info("c").metric == "cosine" and store.info("c").dimension == 3
    got = {r.id: r for r in store.fetch("c", spark.createDataFrame([("cooking-6",), ("12",)], "id string")).collect()}
    assert got["cooking-6"].namespace == "t1" and json.loads(got["cooking-6"].payload) == {"topic": "cooking"} and got["12"].vector == [0.0, 1.0, 0.0]
    assert ids(store.read("c")) == ["12", "cooking-6"]
    assert store.delete("c", spark.createDataFrame([("cooking-6",)], "id string"), 2) == 1 and ids(store.read("c")) == ["12"]


def test_retries():
    for errors, calls, fails in (([TimeoutError()], 2, False), ([remote.HttpError(429)], 2, False), ([remote.HttpError(401)], 1, True), ([TimeoutError()] * 3, 3, True)):
        left, made, waits = list(errors), [], []

        def call():
            made.append(1)
            if left:
                raise left.pop(0)
            return {"ok": True}

        if fails:
            with pytest.raises(Exception):
                remote.retried(call, waits.append)
        else:
            assert remote.retried(call, waits.append) == {"ok": True}
        assert len(made) == calls


def test_page_source_and_stream_sync(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    for n in range(4):
        (folder / f"p{n}.json").write_text(json.dumps({"records": [{"id": f"i{n}-{k}", "vector": [n, k], "payload": {"n": n}} for k in range(3)]}))
    (folder / "p4.json").write_text("broken")
    (folder / "p5.json").write_text('{"records": null}')
    assert pages.read_pages(spark, str(folder)).count() == 12 and pages.read_pages(spark, str(folder)).first()["payload"].startswith('{"n":')
    store = FileStore(spark, f"file://{tmp_path}/s")
    store.upsert("c", records(spark, [("i0-0", None, [7.0, 7.0], "{}")]), 0)

    def run(policy):
        stream = pages.stream_pages(spark, str(folder), 2)
        query = sync(stream, store, "c", str(tmp_path / "checkpoint"), policy, once=False)
        query.processAllAvailable()
        query.stop()

    run("skip")
    assert store.read("c").count() == 12 and store.fetch("c", spark.createDataFrame([("i0-0",)], "id string")).first()["vector"] == [7.0, 7.0]
    (folder / "p6.json").write_text(json.dumps({"records": [{"id": "late", "vector": [1, 1]}, {"id": None, "vector": [1, 1]}]}))
    run("skip")
    assert store.read("c").count() == 13
    (folder / "p2-late.json").write_text(json.dumps({"records": [{"id": "between", "vector": [1, 1]}]}))  # a name before those seen
    run("skip")
    assert store.read("c").count() == 14 and store.fetch("c", spark.createDataFrame([("between",)], "id string")).count() == 1


def test_scan_over_namespaces_without_loss(spark, tmp_path):
    store = FileStore(spark, f"file://{tmp_path}/s")
    rows = [(i, space, [1.0], None) for i in ("a", "b", "c") for space in (None, "x", "y")]
    store.upsert("c", records(spark, rows), 1)
    for size in (1, 2, 4, 9, 10):
        seen, cursor = [], None
        while True:
            page, cursor = store.scan("c", size, cursor)
            seen += [(r.id, r.namespace) for r in page.collect()]
            if cursor is None:
                break
        assert sorted(seen, key=str) == sorted(((i, s) for i, s, _, _ in rows), key=str)


def test_batches_are_held_by_one_owner(spark, tmp_path):
    store = FileStore(spark, f"file://{tmp_path}/s")
    one = lambda i: records(spark, [(i, None, [1.0], None)])
    first = store.reserve("c", "m1")
    assert store.reserve("c", "m1") == first and store.reserve("c", "m2") == first + 1
    store.upsert("c", one("a"), first, owner="m1")
    with pytest.raises(ValueError, match="held"):
        store.upsert("c", one("z"), first, owner="m2")
    assert store.reserve("c", "m1") == first + 2 and store.batches("c") == [first]
    store.upsert("c", one("b"), first + 1, owner="m2")
    store.undo("c", [first])
    assert ids(store.read("c")) == ["b"] and store.reserve("c", "m3") == first + 3


@pytest.mark.parametrize("step", [0, 1, 2])
def test_compact_broken_off(spark, tmp_path, monkeypatch, step):
    store = FileStore(spark, f"file://{tmp_path}/s")
    for n in range(3):
        store.upsert("c", records(spark, [(f"i{n}", None, [float(n)], None), ("same", None, [float(n)], None)]), n + 1)
    before, moved, move = sorted(map(str, store.read("c").collect())), [], store._move

    def broken(old, new):
        if len(moved) == step:
            raise OSError("lost")
        moved.append(old)
        move(old, new)

    monkeypatch.setattr(store, "_move", broken)
    with pytest.raises(OSError):
        store.compact("c")
    again = FileStore(spark, f"file://{tmp_path}/s")
    assert sorted(map(str, again.read("c").collect())) == before
    again.compact("c")
    assert sorted(map(str, again.read("c").collect())) == before and again.batches("c") == [0]


@pytest.fixture
def stores(spark, tmp_path):
    source, target = FileStore(spark, f"file://{tmp_path}/a"), FileStore(spark, f"file://{tmp_path}/b")
    source.create("c")
    target.create("d")
    source.upsert("c", clustered(spark), 1)
    return source, target


def request(**options):
    return state.Request(**({"migration_id": "m/1", "source_provider": "files", "source_resource": "c", "target_provider": "files", "target_resource": "d"} | options))


def test_direct_copy_end_to_end(spark, stores, tmp_path):
    source, target = stores
    golden = source.sample("c", 5).select(F.col("id").alias("query_id"), "vector", F.array("id").alias("expected_ids"))
    work = Migration(spark, request(embedding_provider="p", embedding_model="m"), source, target, str(tmp_path / "work"), golden=golden)
    result = work.run()
    assert result.status == "success", result.summary
    best = work.selected_result()
    assert best["strategy"] == "direct_copy" and best["recall_at_k"] > 0.99 and result.report["written"] == 300
    assert result.report["validation"]["expected_id_recall"] == 1.0 and result.report["validation"]["integrity"]["within_tolerance"]
    assert target.read("d").count() == 300 and result.report["provenance"]["confidence"] == pytest.approx(1.0)
    path = work.checkpoints.path("m/1")
    assert path.exists() and path.stat().st_mode & 0o777 == 0o600 and ".." not in path.name and work.checkpoints.all() == ["m/1"]
    again = Migration(spark, request(resume=True), source, target, str(tmp_path / "work"))
    assert again.run().status == "success" and target.read("d").count() == 300
    assert work.rollback() == 1 and target.read("d").count() == 0
    other = Migration(spark, request(migration_id="none"), source, target, str(tmp_path / "work"))
    assert other.rollback() == 0


def test_policy_fail_and_exact_rollback(spark, stores, tmp_path):
    source, target = stores
    target.upsert("d", records(spark, [("doc-0003", None, [0.1] * 32, '{"pre_existing": true}')]), 0)
    before = target.read("d").collect()
    options = {"embedding_provider": "p", "embedding_model": "m"}
    failed = Migration(spark, request(migration_id="f", **options), source, target, str(tmp_path / "w")).run()
    assert failed.state == "FAILED" and "doc-0003" in failed.summary and target.read("d").collect() == before
    work = Migration(spark, request(migration_id="o", id_collision_policy="overwrite", **options), source, target, str(tmp_path / "w"))
    assert work.run().status == "success" and target.read("d").count() == 300
    work.rollback()
    assert target.read("d").collect() == before
    with pytest.raises(ValueError):
        request(id_collision_policy="merge")


def test_smaller_target_is_gated(spark, stores, tmp_path):
    source, target = stores
    strict = Migration(spark, request(migration_id="s", target_dimension=4), source, target, str(tmp_path / "w")).run()
    assert strict.state == "FAILED" and "no candidate" in strict.summary
    loose = Migration(spark, request(migration_id="l", target_dimension=16, minimum_recall=0.3, minimum_ndcg=0.3, maximum_overlap_drop=0.95, document_field="text"), source, target, str(tmp_path / "w"), embed.HashEmbedder(16))
    result = loose.run()
    assert result.status == "success", result.summary
    rows = {r["strategy"]: r for r in loose.state["results"]}
    assert rows["pca"]["recall_at_k"] > rows["random_projection"]["recall_at_k"] and not rows["residual_mlp_mapping"]["passed"]
    assert {"ridge_mapping", "low_rank_affine_mapping", "re_embedding"} <= set(rows) and "procrustes_mapping" not in rows
    assert len(target.read("d").first()["vector"]) == 16


def test_strategies():
    facts = strategies.Facts(1536, 512, {}, "text-embedding-3-small")
    found = {c["strategy"]: c["status"] for c in strategies.candidates(facts)}
    assert len(found) == 16 and found["mrl"] == found["pca"] == "possible" and found["direct_copy"] == found["ridge_mapping"] == found["smec"] == "impossible"
    good = dict.fromkeys(("dimension", "datatype", "metric", "vector_type"), "exact")
    assert not strategies._direct(strategies.Facts(8, 8, good | {"semantic_space": "unknown"}))[0] and strategies._direct(strategies.Facts(8, 8, good, strict_space=False))[0]
    assert strategies._vec2vec(strategies.Facts(8, 8))[0] and not strategies._vec2vec(strategies.Facts(8, 8, model="m"))[0]
    for s in strategies.STRATEGIES:
        if s.is_stub:
            with pytest.raises(NotImplementedError):
                s.fit(None, 4)


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "  "), (4, "a b")], "n int, t string")
    rows = {r.n: r.vector for r in embed.embed(df, "t", embed.HashEmbedder(8)).collect()}
    assert rows[2] is None and rows[3] is None and rows[1] == rows[4] and np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6)
    assert embed.without_text(df, "t").count() == 2
    assert [embed.resolve_dimension(*x) for x in (("text-embedding-3-small", None, 768), ("text-embedding-3-small", 512, 768), ("ada-002", None, 768))] == [768, 512, None]
    calls = []

    def transport(method, url, headers, body):
        calls.append(len(body["input"]))
        return {"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(body["input"])))]}

    remote_model = embed.RemoteEmbedder("https://x", "m", 2, "key", transport)
    assert remote_model(["a", "bb", "ccc"])[:, 0].tolist() == [1, 2, 3] and calls == [3]


class Interrupted(Exception):
    pass


def broken_after(store, n, monkeypatch):
    """Lets n batches through, then writes half of one and fails."""
    write, calls = store.upsert, []

    def upsert(name, rows, batch, *args, **kwargs):
        calls.append(batch)
        if len(calls) > n:
            write(name, rows.orderBy("id").limit(max(1, rows.count() // 2)), batch, *args, **kwargs)
            raise Interrupted("connection lost")
        return write(name, rows, batch, *args, **kwargs)

    monkeypatch.setattr(store, "upsert", upsert)


@pytest.mark.parametrize("kind", ["files", "index", "points"])
@pytest.mark.parametrize("policy", ["fail", "overwrite"])
def test_paged_copy_goes_on_where_it_broke_off_and_is_rolled_back_exactly(spark, tmp_path, monkeypatch, kind, policy):
    source = FileStore(spark, f"file://{tmp_path}/a")
    source.create("c")
    source.upsert("c", records(spark, [(str(n), None, [float(np.cos(n)), float(np.sin(n)), 0.0], json.dumps({"n": n})) for n in range(50)]), 1)
    (tmp_path / "services").mkdir()
    make = {"files": lambda: FileStore(spark, f"file://{tmp_path}/b"), "index": lambda: remote.PagedIndex(spark, "https://x", None, FakeIndex(tmp_path / "services")), "points": lambda: remote.PointStore(spark, "https://x", None, FakePoints(tmp_path / "services"))}[kind]
    target = make()
    old = [("9000", None, [0.5, 0.5, 0.0], '{"old": 1}')] + ([("7", None, [0.1, 0.2, 0.3], '{"old": 2}')] if policy == "overwrite" else [])
    target.upsert("c", records(spark, old), 0)
    plain = lambda df: sorted((r.id, [round(x, 5) for x in r.vector], json.loads(r.payload or "{}")) for r in df.collect())
    before = plain(target.read("c"))
    options = {"target_provider": kind, "target_resource": "c", "embedding_provider": "p", "embedding_model": "m", "page_records": 20, "id_collision_policy": policy, "migration_id": f"{kind}-{policy}"}
    broken_after(target, 1, monkeypatch)
    first = Migration(spark, request(**options), source, target, str(tmp_path / "w")).run()
    assert first.state == "FAILED" and "connection lost" in first.summary
    target = make()
    work = Migration(spark, request(resume=True, **options), source, target, str(tmp_path / "w"))
    result = work.run()
    assert result.status == "success", result.summary
    assert ids(target.read("c")) == sorted([str(n) for n in range(50)] + ["9000"]) and result.report["written"] == 50
    assert [(r.vectors_read, r.total_written) for r in work.progress().orderBy("batch").collect()] == [(20, 20), (20, 40), (10, 50)]
    assert work.rollback() == 3 and plain(target.read("c")) == before and work.rollback() == 0


def test_store_search(spark, tmp_path):
    rows = records(spark, [(f"r{n}", None, [float(np.cos(n / 9)), float(np.sin(n / 9)), 0.0], "{}") for n in range(20)])
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "id string, vector array<double>")
    (tmp_path / "i").mkdir(), (tmp_path / "p").mkdir()
    for store in (contract.build_store(spark, "memory"), remote.PagedIndex(spark, "https://x", None, FakeIndex(tmp_path / "i")), remote.PointStore(spark, "https://x", None, FakePoints(tmp_path / "p"))):
        with store.ephemeral("cosine", 3) as name:
            store.upsert(name, rows, 1)
            found = store.query(name, queries, 3, width=64).orderBy("rank").collect()
            assert [r.id for r in found] == ["r0", "r1", "r2"] and found[0].score == pytest.approx(1.0) and [r["rank"] for r in found] == [1, 2, 3]
        assert not isinstance(store, FileStore) or store.read(name).count() == 0


def test_a_kept_fit_is_applied_again(spark, stores, tmp_path, monkeypatch):
    source, target = stores
    options = {"migration_id": "k", "target_dimension": 16, "minimum_recall": 0.3, "minimum_ndcg": 0.3, "maximum_overlap_drop": 0.95, "page_records": 200}
    broken_after(target, 1, monkeypatch)
    first = Migration(spark, request(**options), source, target, str(tmp_path / "w"))
    assert first.run().state == "FAILED" and first.state["fit"]["strategy"] in ("pca", "random_projection")
    source.upsert("c", clustered(spark, 60, seed=9), 2)  # the source changes meanwhile
    work = Migration(spark, request(resume=True, **options), source, FileStore(spark, target.root), str(tmp_path / "w"))
    result = work.run()
    assert result.status == "success", result.summary
    assert work.state["fit"] == first.state["fit"] == result.report["provenance"]["fit"]
    assert (work.function().__self__.matrix == first.function().__self__.matrix).all()
    kept = tmp_path / "w" / "fits" / "k.json"
    kept.write_text(kept.read_text().replace("before", "before", 1).replace("0.", "1.", 1))
    with pytest.raises(RuntimeError, match="fit"):
        Migration(spark, request(resume=True, **options), source, target, str(tmp_path / "w"))._load().function()


def test_approval_and_golden_gate(spark, stores, tmp_path):
    source, target = stores
    options = {"migration_id": "g", "embedding_provider": "p", "embedding_model": "m", "needs_approval": True}
    work = Migration(spark, request(**options), source, target, str(tmp_path / "w"))
    waiting = work.run()
    assert waiting.status == "waiting" and waiting.report["ready"] and target.read("d").count() == 0
    with pytest.raises(ValueError):
        work.approve("never-run")
    work.approve(None)
    assert Migration(spark, request(resume=True, **options), source, target, str(tmp_path / "w")).run().status == "waiting"
    work.approve(waiting.report["benchmark_id"])
    wrong = source.sample("c", 5).select(F.col("id").alias("query_id"), "vector", F.array("id").alias("expected_ids"))
    again = Migration(spark, request(resume=True, **options), source, target, str(tmp_path / "w"), golden=wrong)
    again._metric = lambda: "cosine"
    assert again.run().status == "success" and again.state["validation"]["retrieval"]["passed"] and again.state["validation"]["mode"] == "golden"
    # a target whose records are not those of the source fails the gate
    target.upsert("d", records(spark, [(f"doc-{n:04d}", None, [float(x) for x in np.random.default_rng(n).normal(size=32)], None) for n in range(300)]), 99)
    again.state["next_state"] = "VERIFY"
    again.state["selected"]["strategy"] = "pca"
    with pytest.raises(RuntimeError, match="golden"):
        again._verify()


def test_weights_decide(spark):
    from vecshift.operators import selection

    rows = spark.createDataFrame([("a", "pca", True, 0.9, 10.0), ("b", "mrl", True, 0.95, 500.0)], "benchmark_id string, strategy string, passed_quality_gate boolean, quality double, latency_ms double")
    assert selection.select(rows).first()["benchmark_id"] == "b"
    assert selection.select(rows, weights={"quality": 0.1, "latency_ms": 0.9}).first()["benchmark_id"] == "a"
    with pytest.raises(ValueError):
        request(weights={"beauty": 1.0})


def test_command_line(spark, tmp_path):
    from vecshift.__main__ import main

    source, target = (FileStore(spark, f"file://{tmp_path}/{n}") for n in "ab")
    source.create("c")
    target.create("d")
    source.upsert("c", clustered(spark, 120), 1)
    places = [f"files:file://{tmp_path}/a#c", f"files:file://{tmp_path}/b#d"]
    state_folder = str(tmp_path / "w")
    done = main(["migrate", *places, "--id", "m", "--state", state_folder, "--embedding-provider", "p", "--embedding-model", "m", "--page", "100"], spark)
    assert done["status"] == "success" and done["written"] == 120 and done["selected"]["strategy"] == "direct_copy"
    same = main(["compare", *places, "--queries", "10", "--k", "5"], spark)
    assert same["sample_size"] == 10 and same["recall_at_k"] == same["topk_overlap"] == 1.0
    assert len(main(["compare", *places, "--text", "word1 topic1 number1", "--k", "3"], spark)["matches"]) == 3
    assert main(["rollback", *places, "--id", "m", "--state", state_folder], spark) == {"batches_undone": 2} and target.read("d").count() == 0
    with pytest.raises(SystemExit):
        main(["compare", "nowhere", places[1]], spark)
