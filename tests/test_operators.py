import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.functions import ids, redaction, vectors
from vecshift.functions.staging import broadcast_within, stage
from vecshift.operators import compat, fusion, knn, migrate, ranking, selection, stats, transforms


def rankings(spark, lists, scores=None):
    rows = [(q, i, n, (scores or {}).get(q, {}).get(i)) for q, l in lists.items() for n, i in enumerate(l, 1)]
    return spark.createDataFrame(rows, "query_id string, id string, rank bigint, score double")


def measures(spark, s, t, k, ss=None, st=None):
    return ranking.per_query(rankings(spark, {"q": s}, {"q": ss or {}}), rankings(spark, {"q": t}, {"q": st or {}}), k).first()


@pytest.mark.parametrize(
    ("s", "t", "k", "name", "value"),
    [
        ("abc", "abc", 3, "recall_at_k", 1.0), ("abcd", "axyz", 4, "recall_at_k", 0.25), ("", "a", 5, "recall_at_k", 0.0), ("ab", "abcd", 4, "topk_overlap", 0.5), ("ab", "abcd", 4, "recall_at_k", 1.0),
        ("abc", "abc", 3, "ndcg_at_k", 1.0), ("abc", "xba", 3, "mrr", 0.5), ("abc", "xyz", 3, "mrr", 0.0), ("", "abc", 3, "mrr", 0.0), ("a", "b", 3, "rank_correlation", None), ("abcdefghij", "xyjzwvutas", 10, "rank_correlation", -1.0),
    ],
)
def test_measures(spark, s, t, k, name, value):
    found = measures(spark, list(s), list(t), k)[name]
    assert found is None if value is None else found == pytest.approx(value)


def test_measures_of_order_and_scores(spark):
    assert measures(spark, list("abc"), list("cba"), 3)["ndcg_at_k"] < 1.0
    row = measures(spark, list("abc"), list("ab"), 3, {"a": 0.9, "b": 0.8, "c": 0.1}, {"a": 0.9, "b": 0.7})
    assert row["score_drift"] == pytest.approx(0.05)
    assert measures(spark, ["a"], ["b"], 3, {"a": 1.0}, {"b": 1.0})["score_drift"] is None


def test_equivalence_and_gate(spark):
    s, t = {"q1": ["a", "b"], "q2": ["c", "d"]}, {"q1": ["a", "b"], "q2": ["x", "y"]}
    mean = ranking.equivalence(ranking.per_query(rankings(spark, s), rankings(spark, t), 2))
    assert mean.first()["sample_size"] == 2 and mean.first()["recall_at_k"] == 0.5
    gate = lambda r, n, o, **k: ranking.gate(spark.createDataFrame([(r, n, o)], "recall_at_k double, ndcg_at_k double, topk_overlap double"), 0.99, 0.98, 0.05, **k).first()
    failed = gate(0.90, 0.99, 1.0)
    assert not failed["passed"] and len(failed["reasons"]) == 1 and "recall" in failed["reasons"][0]
    assert gate(0.995, 0.99, 0.98)["passed"] and not gate(float("nan"), 0.99, 0.98)["passed"] and not gate(None, 0.99, 0.98)["passed"]
    assert not gate(0.995, 0.99, 0.98, latency=F.lit(25.0), latency_percent=20.0)["passed"]
    empty = ranking.equivalence(ranking.per_query(rankings(spark, {}), rankings(spark, {}), 2)).first()
    assert empty["recall_at_k"] == 0.0 and empty["rank_correlation"] is None


def test_fusion(spark):
    dense, sparse = rankings(spark, {"q": list("abcd")}), rankings(spark, {"q": list("baef")})
    top = fusion.fuse([dense, sparse]).orderBy("rank").collect()
    assert {r["id"] for r in top[:2]} == {"a", "b"} and len(top) == 6
    many = rankings(spark, {"q": [f"d{i}" for i in range(20)]})
    assert fusion.recover(many, rankings(spark, {"q": [f"d{i}" for i in range(19, -1, -1)]}), 5).count() == 5
    with pytest.raises(ValueError):
        fusion.fuse([dense], [1.0, 2.0])


def test_selection(spark):
    values = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    assert [r[0] for r in values.select(selection.normalize(F.col("v"), "maximize").alias("n"), "v").orderBy("v").collect()] == [0, 0.5, 1]
    assert [r[0] for r in values.select(selection.normalize(F.col("v"), "minimize").alias("n"), "v").orderBy("v").collect()] == [1, 0.5, 0]
    assert {r[0] for r in values.select(selection.normalize(F.col("v") * 0 + 3, "minimize")).collect()} == {1.0}
    with pytest.raises(ValueError):
        selection.normalize(F.col("v"), "up")
    kinds = "benchmark_id string, strategy string, passed_quality_gate boolean, quality double, cost double, latency_ms double"
    one = spark.createDataFrame([("1", "cheap", False, 0.4, 0.0, 0.0), ("2", "good", True, 0.9, 9.0, 0.0)], kinds)
    assert [r["strategy"] for r in selection.score(one).collect()] == ["good"]
    two = spark.createDataFrame([("1", "a", True, 0.990, 1.0, 0.0), ("2", "b", True, 0.999, 500.0, 0.0)], kinds)
    assert selection.score(two, {"quality": 0.9, "cost": 0.1, "latency_ms": 0, "migration_time_s": 0, "storage_bytes": 0, "risk": 0}).orderBy(F.desc("score")).first()["strategy"] == "b"
    tie = spark.createDataFrame([("1", "direct_copy", True, 0.99, 0.0, 999.0), ("2", "random_projection", True, 0.99, 0.0, 1.0)], kinds)
    assert selection.select(tie).first()["strategy"] == "direct_copy" and selection.select(tie, "2").first()["strategy"] == "random_projection" and selection.select(tie, "9").first() is None
    with pytest.raises(ValueError):
        selection.require_executed("9", tie)
    lit = lambda x: F.lit(x).cast("double")
    row = spark.range(1).select(selection.confidence(lit(0.9), lit(1.0), lit(0.8), lit(None)).alias("a"), selection.confidence(lit(None)).alias("b")).first()
    assert row["a"] == pytest.approx(0.9) and row["b"] is None
    assert selection.adaptive_retrieval(True, True, 64, 512) and selection.adaptive_retrieval(True, False, 64, 512) is None


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_compatibility(spark):
    t = lambda x, kind="string": F.lit(x).cast(kind)
    dim = lambda a, b: one(spark, compat.dimension(t(a, "int"), t(b, "int")))
    assert [dim(1536, 1536), dim(1536, 768), dim(None, 768), dim(1536, None)] == ["exact", "incompatible", "unknown", "unknown"]
    kind = lambda a, b, q: one(spark, compat.datatype(t(a), t(b), t(q)))
    assert [kind("float32", "float32", "FALSE"), kind("float32", "float16", "FALSE"), kind("int8", "float32", "TRUE"), kind("?", "float32", None)] == ["exact", "compatible", "transformable", "unknown"]
    metric = lambda a, b, n: one(spark, compat.metric(t(a), t(b), t(n)))
    assert [metric("cosine", "cosine", None), metric("cosine", "dot", "confirmed"), metric("cosine", "dot", "unknown")] == ["exact", "compatible", "unknown"]
    assert [metric("euclidean", "cosine", n) for n in ("confirmed", "not_normalized", "unknown")] == ["transformable", "incompatible", "unknown"]
    assert metric("manhattan", "cosine", "confirmed") == "incompatible"
    assert [one(spark, compat.vector_type(t("dense"), t(x))) for x in ("dense", "sparse")] == ["exact", "incompatible"]
    assert [one(spark, compat.quantization(t(x))) for x in ("UNKNOWN", "TRUE", "FALSE", None)] == ["unknown", "transformable", "exact", "unknown"]
    space = lambda p, a, b: one(spark, compat.semantic_space(F.lit(p), t(a), t(b)))
    assert [space(False, "a", None), space(True, "a", None), space(True, "a", "a"), space(True, "a", "b")] == ["exact", "unknown", "exact", "incompatible"]
    assert compat.mrl_support("text-embedding-3-small") == "TRUE" and compat.mrl_support("other") == "UNKNOWN"
    assert [compat.embedding_identity(None, None, False)["confidence"], compat.embedding_identity("p", "m", False)["confidence"], compat.embedding_identity("p", None, True)["confidence"]] == [0.0, 1.0, 0.5]


def frame(spark, matrix, name="vector"):
    return spark.createDataFrame([(f"r{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)], f"id string, {name} array<float>")


def test_vector_expressions(spark):
    row = spark.createDataFrame([([127, -127, 0], [1, 0, 5, -3], [3.0, 4.0], [0.0, 0.0], [1.0, None])], "a array<int>, b array<int>, c array<float>, z array<float>, n array<float>")
    assert row.select(vectors.dequantize(F.col("a"), "int8")).first()[0] == [1, -1, 0]
    assert row.select(vectors.dequantize(F.col("b"), "binary")).first()[0] == [1, -1, 1, -1]
    assert row.select(vectors.renormalize(F.col("c"))).first()[0] == pytest.approx([0.6, 0.8]) and row.select(vectors.renormalize(F.col("z"))).first()[0] == [0, 0]
    assert [row.select(vectors.is_usable(F.col(c), 2)).first()[0] for c in "czn"] == [True, False, False]
    assert row.select(vectors.cosine(F.col("c"), F.col("z"))).first()[0] == 0.0


@pytest.mark.parametrize("metric", knn.METRICS)
def test_search_against_brute_force(spark, metric):
    random = np.random.default_rng(0)
    matrix = random.normal(size=(120, 6)).astype(np.float32)
    matrix[7] = matrix[3]
    corpus = frame(spark, matrix).union(spark.createDataFrame([("null", None), ("short", [1.0]), ("nan", [float("nan")] * 6), (None, [1.0] * 6)], "id string, vector array<float>"))
    queries = corpus.where("id in ('r003', 'r007', 'r050', 'null')")
    found = knn.knn(corpus.repartition(5), queries, 9, metric).orderBy("query_id", "rank").collect()
    wide = matrix.astype(float)
    for q in (3, 7, 50):
        score = knn.scores(wide[[q]], wide, metric)[0]
        expected = sorted(range(120), key=lambda j: (-round(score[j], 12), j))[:9]
        assert [r["id"] for r in found if r["query_id"] == f"r{q:03d}"] == [f"r{j:03d}" for j in expected]
    assert {r["query_id"] for r in found} == {"r003", "r007", "r050"}


def test_search_cases(spark, monkeypatch):
    corpus = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0]), ("c", [5.0, 5.0])], "id string, vector array<float>")
    query = spark.createDataFrame([("q", [0.1, 0.1])], "id string, vector array<float>")
    assert [r["id"] for r in knn.knn(corpus, query, 3, "euclidean").orderBy("rank").collect()] == ["a", "b", "c"]
    assert knn.knn(corpus.where("false"), query).count() == 0 and knn.knn(corpus, query.where("false")).count() == 0
    with pytest.raises(ValueError):
        knn.knn(corpus, query, 3, "angle")
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 1)
    assert knn.knn(corpus, corpus, 2, "dot").count() == 6
    spaces = corpus.withColumn("s", F.when(F.col("id") == "a", "x").otherwise("y"))
    assert {(r["query_id"], r["id"]) for r in knn.knn(spaces, spaces, 5, "dot", same="s").collect()} == {("a", "a"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c")}


def test_statistics(spark):
    random = np.random.default_rng(0)
    unit = random.normal(size=(50, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert stats.normalization(frame(spark, unit)).first()["status"] == "detected"
    assert stats.normalization(frame(spark, unit * random.uniform(2, 10, (50, 1)))).first()["status"] == "not_normalized"
    assert stats.normalization(frame(spark, unit).where("false")).first()["status"] == "unknown"
    bad = unit.copy()
    bad[2, 1] = np.nan
    row = stats.distribution(frame(spark, bad)).first()
    assert row["has_nan"] and not row["has_inf"] and row["count"] == 50 and row["dimension"] == 8
    same = stats.integrity(frame(spark, unit), frame(spark, unit)).first()
    assert same["within_tolerance"] and same["max_abs_diff"] == 0
    moved = stats.integrity(frame(spark, unit), frame(spark, unit[:40] + 1)).first()
    assert not moved["within_tolerance"] and moved["ids_missing"] == 10 and moved["mean_abs_diff"] == pytest.approx(1, abs=1e-6)
    assert stats.integrity(frame(spark, unit), frame(spark, unit[:, :4])).first()["shape_mismatches"] == 50
    assert not stats.integrity(frame(spark, bad), frame(spark, bad)).first()["within_tolerance"]
    payloads = ['{"language": "en"}', '{"lang": "fr"}', '{"language_code": "de"}', '{"locale": "en"}', "{}", '{"language": 123}', '{"lang": null}', '{"language": 5, "lang": "es"}', "no json", None, '{"lang": ""}']
    found = spark.createDataFrame([(p,) for p in payloads], "p string").select(stats.language(F.col("p")).alias("l")).collect()
    assert [r.l for r in found] == ["en", "fr", "de", "en", None, None, None, "es", None, None, None]
    assert [stats.validation_mode(*x) for x in ((True, False, False), (False, True, True), (False, True, False))] == ["golden", "synthetic", "unavailable"]


def pairs(spark, x, y):
    rows = [(f"r{i:03d}", [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id string, vector array<double>, target array<double>")


def test_known_maps_are_recovered(spark):
    random = np.random.default_rng(0)
    x = random.normal(size=(220, 6))
    m = random.normal(size=(6, 4))
    fitted = transforms.fit_ridge(pairs(spark, x, x @ m + 0.5), alpha=1e-6)
    assert np.allclose(fitted(x), x @ m + 0.5, atol=1e-2)
    again = transforms.Affine.from_json(fitted.to_json())
    assert np.array_equal(again(x), fitted(x)) and again.checksum() == fitted.checksum()
    turn = np.linalg.qr(random.normal(size=(6, 6)))[0]
    assert np.allclose(transforms.fit_procrustes(pairs(spark, x, x @ turn + 2))(x), x @ turn + 2, atol=1e-2)
    signs = np.array([1, -1, 1, 1, -1, -1])
    assert np.allclose(transforms.fit_procrustes_diagonal(pairs(spark, x, x * signs + 3))(x), x * signs + 3, atol=1e-2)
    low = random.normal(size=(6, 2)) @ random.normal(size=(2, 6))
    assert np.allclose(transforms.fit_low_rank(pairs(spark, x, x @ low + 1), rank=2, alpha=1e-6)(x), x @ low + 1, atol=1e-1)
    with pytest.raises(ValueError):
        transforms.fit_ridge(pairs(spark, x[:5], x[:5]))
    ridge = transforms.fit_ridge(pairs(spark, x, x @ m))
    xc, yc = x - x.mean(0), x @ m - (x @ m).mean(0)
    assert np.allclose(ridge.matrix, np.linalg.solve(xc.T @ xc + np.eye(6), xc.T @ yc))


def test_projections(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(60, 16)) * np.linspace(3, 0.1, 16)
    fitted = transforms.fit_pca(frame(spark, x), 5)
    values, basis = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(np.abs(fitted.matrix), np.abs(basis[:, ::-1][:, :5]), atol=1e-3)
    assert fitted.report["explained_variance"] == pytest.approx(values[::-1][:5].sum() / values.sum(), rel=1e-4)
    full = transforms.fit_pca(frame(spark, x), 16)
    assert np.allclose(full.inverse(full(x)), x, atol=1e-6)
    with pytest.raises(ValueError):
        transforms.fit_pca(frame(spark, x[:10]), 24)
    expand = transforms.fit_random_projection(16, 24)
    assert np.allclose(expand(x) @ expand(x).T, x @ x.T, atol=1e-4) and transforms.fit_random_projection(16, 4)(x).shape == (60, 4)
    moved = expand.apply(frame(spark, x).union(spark.createDataFrame([("n", None), ("s", [1.0])], "id string, vector array<float>"))).orderBy("id").collect()
    assert [r["vector"] for r in moved[:2]] == [None] * 2 or sum(r["vector"] is None for r in moved) == 2
    assert np.allclose([r["vector"] for r in moved if r["vector"]], expand(x.astype(np.float32)), atol=1e-5)


def test_copying(spark):
    kinds = "id string, v int"
    source, target = spark.createDataFrame([("a", 1), ("b", 2)], kinds), spark.createDataFrame([("b", 9), ("c", 9)], kinds)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(migrate.resolve(source, target, "overwrite")) == [("a", 1), ("b", 2)]
    assert rows(migrate.resolve(source, target, "skip")) == [("a", 1)]
    assert rows(migrate.resolve(source, target, "rename")) == rows(migrate.resolve(source, target, "prefix")) == [("a", 1), ("b__migrated", 2)]
    with pytest.raises(migrate.CollisionError, match="b"):
        migrate.resolve(source, target, "fail")
    assert rows(migrate.resolve(source, target, "fail", written=target)) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        migrate.resolve(source, target, "merge")
    after = migrate.upsert(target, source)
    assert rows(after) == rows(migrate.upsert(after, source)) == [("a", 1), ("b", 2), ("c", 9)]
    entries = migrate.ledger(target, source, "m", 0)
    assert rows(migrate.rollback(after, entries)) == rows(target)
    assert rows(migrate.rollback(target, entries.where("false"))) == rows(target)
    assert rows(migrate.delete(target, source)) == [("c", 9)]


def test_ids_and_redaction(spark):
    import uuid

    known = ["cooking-6", "sku-9981", "", "größe/1", "12345", str(uuid.uuid4())]
    rows = spark.createDataFrame([(k,) for k in known], "id string").select("id", ids.point_id(F.col("id")).alias("p"), ids.file_safe(F.col("id")).alias("f")).collect()
    for r in rows[:4]:
        assert r.p == str(uuid.uuid5(uuid.UUID(ids.ID_NAMESPACE), r.id))
    assert [r.p for r in rows[4:]] == known[4:] and rows[3].f == "größe_1"
    value = {"api_key": "x", "secret_ref": "y", "credential": {"a": 1}, "region": "eu", "tokenizer": "bpe", "notes": ["Bearer abcdefghijklmnop", {"token": "t"}]}
    assert redaction.redact(value) == {"api_key": redaction.HIDDEN, "secret_ref": redaction.HIDDEN, "credential": redaction.HIDDEN, "region": "eu", "tokenizer": "bpe", "notes": ["Bearer " + redaction.HIDDEN, {"token": redaction.HIDDEN}]}
    texts = ["key sk-abcdefghijklm end", "Authorization: Bearer abcdefghijklmnop", "api_key = 'abcdefgh'", None, ""]
    hidden = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redaction.redact_text(F.col("t"))).collect()]
    assert hidden == [f"key {redaction.HIDDEN} end", f"Authorization: Bearer {redaction.HIDDEN}", f"api_key = {redaction.HIDDEN}", None, ""]
    assert hidden == [redaction.redact(t) for t in texts]


def test_staging(spark):
    df = spark.range(10)
    assert stage(df, "t").count() == 10
    assert "ResolvedHint" in broadcast_within(df, 10)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in broadcast_within(df, 9)._jdf.queryExecution().analyzed().toString()


def test_ann_searches_again_where_nothing_is_near(spark):
    # random directions: most of the 10 nearest are further away than the threshold
    vectors = np.random.default_rng(4).normal(size=(40, 64))
    df = spark.createDataFrame([(f"r{i:02d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, vector array<double>")
    found = {(r.query_id, r["rank"]): (r.id, r.distance) for r in knn.ann(df, df, 10).collect()}
    exact = {(r.query_id, r["rank"]): (r.id, r.score) for r in knn.knn(df, df, 10).collect()}
    assert len(found) == 400 and {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in exact.items()}
    assert all(abs(found[k][1] ** 2 - (2 - 2 * exact[k][1])) < 1e-6 for k in exact)


def test_renormalisation_is_linear_in_the_dimension(spark):
    import time

    def seconds(d, n):
        df = spark.range(n).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda x: (x + F.col("id")).cast("float")).alias("v"))
        times = []
        for _ in range(3):
            began = time.perf_counter()
            df.select(F.sum(vectors.norm(vectors.renormalize(F.col("v"))))).collect()
            times.append(time.perf_counter() - began)
        return min(times)

    assert seconds(1536, 1_000) < 5 * seconds(64, 24_000)  # as many elements; quadratic would be 24 times


def test_approximate_search(spark):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.normal(size=(3000, 48)))] + [(9001, None), (9002, [0.0] * 48), (9003, [float("nan")] * 48)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = df.where("id % 100 = 0 or id > 9000")
    near = {(r.query_id, r.id) for r in knn.ann(df, asked, 10).collect()}
    exact = {(r.query_id, r.id) for r in knn.knn(df.where("id < 9000"), asked.where("id < 9000"), 10).collect()}
    assert len(near) == len(exact) == 300 and len(near & exact) >= 0.9 * 300
    assert knn.ann(df.where("false"), asked, 10).count() == 0 and knn.ann(df, asked.where("false"), 10).count() == 0


def test_search_of_several_lengths(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [1.0, 0.0, 0.0]), ("d", [0.0, 1.0, 0.0]), ("e", [])], "id string, vector array<double>")
    found = {(r.query_id, r.id, r["rank"]) for r in knn.knn(df, df.where("id in ('a', 'c', 'e')"), 2).collect()}
    assert found == {("a", "a", 1), ("a", "b", 2), ("c", "c", 1), ("c", "d", 2)}
