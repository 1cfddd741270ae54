"""The registered queries over the tables of a folder, each beside the SQL that states the same.

``SQL`` texts are in the dialect of DuckDB, over the same Parquet tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.functions import ids, redaction, vectors
from vecshift.functions.current import current_rows
from vecshift.functions.staging import checkpoint
from vecshift.operators import compat, fusion, knn, migrate, ranking, reconcile, selection, stats, transforms
from vecshift.plans import embed, strategies
from vecshift.sources import remote

FLAGSHIP = "quality_gate"
QUERIES: dict = {}
SQL: dict[str, str] = {}

K, SHORT = 10, 32
#: The stated query set: every row whose id is divisible by this.
EVERY = 100


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def _t(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _r(column, digits=6):
    return F.round(column, digits) + F.lit(0.0)


def _long(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("pos", "value")).select(key, F.col("pos").cast("bigint").alias("pos"), _r(F.col("value")).alias("value"))


# ---- collections -------------------------------------------------------------------------------------------------

CURRENT = "current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n FROM vector_records WHERE id IS NOT NULL) WHERE n = 1)"
TARGET_ALL = "target_all AS (SELECT coalesce(json_extract_string(payload, '$.__source_id'), id) AS id, * EXCLUDE (id) FROM target_records)"
TARGET = TARGET_ALL + ", target AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n FROM target_all) WHERE n = 1)"
USABLE = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


def _current(spark, folder):
    return current_rows(_t(spark, folder, "vector_records"))


def _target(spark, folder):
    rows = _t(spark, folder, "target_records")
    return current_rows(rows.withColumn("id", reconcile.record_key(F.col("id"), F.col("payload"))))


@query("""SELECT resource_name, count(*) AS n_rows, count(DISTINCT id) AS n_records, max(len(vector))::BIGINT AS dimension, count(DISTINCT namespace) AS n_namespaces FROM vector_records GROUP BY resource_name""")
def resource_info(spark, folder):
    rows = _t(spark, folder, "vector_records")
    return rows.groupBy("resource_name").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_records"), F.max(F.size("vector")).cast("bigint").alias("dimension"), F.countDistinct("namespace").alias("n_namespaces"))


@query("""SELECT name, lower(trim(provider)) AS provider, dimension::BIGINT AS dimension, CASE WHEN lower(trim(metric)) IN ('cosine','dot','euclidean','manhattan') THEN lower(trim(metric)) ELSE 'unknown' END AS metric,
    CASE WHEN lower(trim(datatype)) IN ('float32','float16','bfloat16','int8','binary') THEN lower(trim(datatype)) ELSE 'unknown' END AS datatype, CASE WHEN quantized IN ('TRUE','FALSE') THEN quantized ELSE 'UNKNOWN' END AS quantized, CASE WHEN approximate_count >= 0 THEN approximate_count END AS approximate_count
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY observed_at DESC) AS n FROM (SELECT DISTINCT * FROM resource_infos)) WHERE n = 1""")
def resource_metadata(spark, folder):
    rows = current_rows(_t(spark, folder, "resource_infos").distinct(), "name", "observed_at", None)
    tri = F.when(F.col("quantized").isin("TRUE", "FALSE"), F.col("quantized")).otherwise("UNKNOWN")
    count = F.when(F.col("approximate_count") >= 0, F.col("approximate_count"))
    return rows.select("name", F.lower(F.trim("provider")).alias("provider"), F.col("dimension").cast("bigint").alias("dimension"), compat.known(F.col("metric"), compat.METRICS).alias("metric"), compat.known(F.col("datatype"), compat.DATATYPES).alias("datatype"), tri.alias("quantized"), count.alias("approximate_count"))


@query("""SELECT resource_name, count(*) AS n_received, count(DISTINCT r.id) AS n_records, count(DISTINCT page_no) AS n_pages FROM (SELECT resource_name, page_no, unnest(records) AS r FROM scan_pages) GROUP BY resource_name""")
def scan_records(spark, folder):
    rows = _t(spark, folder, "scan_pages").select("resource_name", "page_no", F.explode("records").alias("r"))
    return rows.groupBy("resource_name").agg(F.count("*").alias("n_received"), F.countDistinct("r.id").alias("n_records"), F.countDistinct("page_no").alias("n_pages"))


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id > 99 ORDER BY vec_id LIMIT 200""")
def scan_page(spark, folder):
    return migrate.page(_t(spark, folder, "embeddings"), 99, 200, "vec_id").select("vec_id", "label")


@query(f"""WITH {CURRENT} SELECT id, resource_name, namespace, load_no FROM current ORDER BY id LIMIT 400""")
def sample_first_n(spark, folder):
    return migrate.page(_current(spark, folder), None, 400).select("id", "resource_name", "namespace", "load_no")


@query(f"""WITH {CURRENT} SELECT id, resource_name, row_number() OVER (ORDER BY id) <= 40 AS is_query FROM (SELECT * FROM current WHERE len(vector) > 0 ORDER BY id LIMIT 400)""")
def dry_run_sample(spark, folder):
    return migrate.dry_run(_current(spark, folder)).select("id", "resource_name", "is_query")


@query(f"""WITH {CURRENT} SELECT id, resource_name, updated_at FROM current WHERE id IN (SELECT record_id FROM documents)""")
def fetch_by_ids(spark, folder):
    wanted = _t(spark, folder, "documents").select(F.col("record_id").alias("id"))
    return _current(spark, folder).join(wanted, "id", "left_semi").select("id", "resource_name", "updated_at")


@query("""SELECT id, resource_name, load_no, updated_at, ingested_at FROM vector_records WHERE namespace = 'tenant-0042'""")
def namespace_filter(spark, folder):
    return knn.in_namespace(_t(spark, folder, "vector_records"), "tenant-0042").select("id", "resource_name", "load_no", "updated_at", "ingested_at")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events""")
def payload_extract(spark, folder):
    return _t(spark, folder, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))


@query("""WITH d AS (SELECT DISTINCT id, sha1(unhex('6f0c2f1e2e355f1a8b1b7a1f6e8c9d2a') || encode(id)) AS h FROM vector_records WHERE id IS NOT NULL),
    f AS (SELECT id, h, regexp_matches(id, '^[0-9]+$') OR regexp_matches(id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS native FROM d)
    SELECT id, native, CASE WHEN native THEN id ELSE substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) END AS point_id FROM f""")
def uuid5_point_id(spark, folder):
    rows = _t(spark, folder, "vector_records").select("id").where("id is not null").distinct()
    return rows.select("id", ids.is_native_id(F.col("id")).alias("native"), ids.point_id(F.col("id")).alias("point_id"))


@query("""SELECT DISTINCT id, regexp_replace(id, '[^\\p{L}\\p{N}_-]', '_', 'g') AS file_name FROM vector_records""")
def file_safe_id(spark, folder):
    return _t(spark, folder, "vector_records").select("id", ids.file_safe(F.col("id")).alias("file_name")).distinct()


# ---- search ------------------------------------------------------------------------------------------------------

DUCK_SCORE = {
    "cosine": "list_dot_product(q.v, c.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-9) * greatest(sqrt(list_dot_product(c.v, c.v)), 1e-9))",
    "dot": "list_dot_product(q.v, c.v)",
    "euclidean": "list_distance(q.v, c.v)",
    "manhattan": "list_sum(list_transform(list_zip(q.v, c.v), lambda z: abs(z[1] - z[2])))",
}


def _knn_sql(metric: str, corpus: str, name: str = "ranked", k: int = K, same: bool = False) -> str:
    """CTEs that rank ``corpus(id, v, label)`` for each row of it that is a query."""
    order = "ASC" if metric in ("euclidean", "manhattan") else "DESC"
    return (
        f"{name} AS (SELECT query_id, id, score, rank FROM (SELECT q.id AS query_id, c.id AS id, s.score, row_number() OVER (PARTITION BY q.id ORDER BY s.score {order}, c.id) AS rank "
        f"FROM (SELECT * FROM {corpus} WHERE id % {EVERY} = 0) q JOIN {corpus} c ON {'q.label = c.label' if same else 'TRUE'}, LATERAL (SELECT {DUCK_SCORE[metric]} AS score) s) WHERE rank <= {k})"
    )


FULL = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
CUT = f"raw AS (SELECT vec_id AS id, embedding[1:{SHORT}]::DOUBLE[] AS v, label FROM embeddings), cut AS (SELECT id, list_transform(v, lambda x: x / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS v, label FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM raw))"
RANKINGS = f"{FULL}, {CUT}, {_knn_sql('cosine', 'emb', 'src')}, {_knn_sql('cosine', 'cut', 'tgt')}"


def _asked(df):
    return df.where(F.col("vec_id") % EVERY == 0)


def _search(df, metric="cosine", k=K, same=None):
    return knn.knn(df, _asked(df), k, metric, "vec_id", "embedding", same)


def _cut(df, k=SHORT):
    return df.withColumn("embedding", vectors.truncated(F.col("embedding"), k))


def _rankings(spark, folder):
    df = _t(spark, folder, "embeddings")
    return _search(df), _search(_cut(df))


def _shown(ranked):
    return ranked.select("query_id", "id", _r(F.col("score")).alias("score"), "rank")


def _knn_query(metric):
    def run(spark, folder):
        return _shown(_search(_t(spark, folder, "embeddings"), metric))

    run.__name__ = f"knn_{metric}"
    return query(f"WITH {FULL}, {_knn_sql(metric, 'emb')} SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM ranked")(run)


for _metric in knn.METRICS:
    _knn_query(_metric)


@query(f"WITH {FULL}, {_knn_sql('cosine', 'emb', same=True)} SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM ranked")
def knn_filtered(spark, folder):
    return _shown(_search(_t(spark, folder, "embeddings"), same="label"))


@query(f"""WITH {FULL}, {CUT}, {_knn_sql('cosine', 'cut', 'listed', 50)}, full_score AS (SELECT l.query_id, l.id, {DUCK_SCORE['cosine']} AS score FROM listed l JOIN emb q ON q.id = l.query_id JOIN emb c ON c.id = l.id)
    SELECT query_id, id, round(score, 6) + 0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM full_score) WHERE rank <= {K}""")
def two_stage_rerank(spark, folder):
    df = _t(spark, folder, "embeddings")
    return _shown(knn.two_stage(df, _asked(df), K, 50, SHORT, "vec_id", "embedding"))


@query(f"SELECT count(*) AS sample_size, TRUE AS reached FROM embeddings WHERE vec_id % {EVERY} = 0")
def ann_recall(spark, folder):
    """Whether the approximate search reaches a recall of 0.9 against the exact one."""
    df = _t(spark, folder, "embeddings")
    near = knn.ann(df, _asked(df), K, "vec_id", "embedding").select("query_id", "id", "rank")
    return ranking.equivalence(ranking.per_query(_search(df), near, K)).select("sample_size", (F.col("recall_at_k") >= 0.9).alias("reached"))


# ---- agreement of rankings ---------------------------------------------------------------------------------------

MEASURES = f"""pairs AS (SELECT coalesce(s.query_id, t.query_id) AS query_id, coalesce(s.id, t.id) AS id, s.rank AS rs, t.rank AS rt, s.score AS ss, t.score AS st FROM src s FULL JOIN tgt t ON s.query_id = t.query_id AND s.id = t.id),
    common AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rs) AS ds, row_number() OVER (PARTITION BY query_id ORDER BY rt) AS dt FROM pairs WHERE rs IS NOT NULL AND rt IS NOT NULL),
    spear AS (SELECT query_id, CASE WHEN count(*) >= 2 THEN corr(ds, dt) END AS rank_correlation FROM common GROUP BY query_id),
    measures AS (SELECT query_id, count(*) FILTER (rs IS NOT NULL AND rt IS NOT NULL) / count(rs)::DOUBLE AS recall_at_k, coalesce(sum(({K} + 1 - rs) / log2(rt + 1)) FILTER (rt IS NOT NULL), 0) / sum(({K} + 1 - rs) / log2(rs + 1)) AS ndcg_at_k,
        count(*) FILTER (rs IS NOT NULL AND rt IS NOT NULL) / count(*)::DOUBLE AS topk_overlap, coalesce(1.0 / min(rt) FILTER (rs IS NOT NULL), 0) AS mrr, avg(abs(ss - st)) AS score_drift FROM pairs GROUP BY query_id)"""


def _measures(spark, folder):
    return ranking.per_query(*_rankings(spark, folder), K)


def _measure_query(name, sql):
    def run(spark, folder):
        return _measures(spark, folder).select("query_id", _r(F.col(name)).alias(name))

    run.__name__ = name
    return query(f"WITH {RANKINGS}, {MEASURES} {sql}")(run)


for _name in ("recall_at_k", "ndcg_at_k", "topk_overlap", "mrr", "score_drift"):
    _measure_query(_name, f"SELECT query_id, round({_name}, 6) + 0.0 AS {_name} FROM measures")
_measure_query("rank_correlation", "SELECT query_id, round(rank_correlation, 6) + 0.0 AS rank_correlation FROM measures LEFT JOIN spear USING (query_id)")

MEANS = "means AS (SELECT count(*) AS sample_size, coalesce(avg(recall_at_k), 0) AS recall_at_k, coalesce(avg(ndcg_at_k), 0) AS ndcg_at_k, coalesce(avg(topk_overlap), 0) AS topk_overlap, coalesce(avg(mrr), 0) AS mrr, avg(rank_correlation) AS rank_correlation, avg(score_drift) AS score_drift FROM measures LEFT JOIN spear USING (query_id))"
MEAN_NAMES = ("recall_at_k", "ndcg_at_k", "topk_overlap", "mrr", "rank_correlation", "score_drift")


@query(f"WITH {RANKINGS}, {MEASURES}, {MEANS} SELECT sample_size, {', '.join(f'round({m}, 6) + 0.0 AS {m}' for m in MEAN_NAMES)} FROM means")
def retrieval_equivalence(spark, folder):
    return ranking.equivalence(_measures(spark, folder)).select("sample_size", *[_r(F.col(m)).alias(m) for m in MEAN_NAMES])


@query(f"""WITH {RANKINGS}, {MEASURES}, {MEANS} SELECT sample_size, round(recall_at_k, 6) AS recall_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, round(topk_overlap, 6) AS topk_overlap, recall_at_k >= 0.8 AND ndcg_at_k >= 0.9 AND 1 - topk_overlap <= 0.15 AS passed,
    (recall_at_k < 0.8)::BIGINT + (ndcg_at_k < 0.9)::BIGINT + (1 - topk_overlap > 0.15)::BIGINT AS n_reasons FROM means""")
def quality_gate(spark, folder):
    gated = ranking.gate(ranking.equivalence(_measures(spark, folder)))
    return gated.select("sample_size", *[_r(F.col(m)).alias(m) for m in MEAN_NAMES[:3]], "passed", F.size("reasons").cast("bigint").alias("n_reasons"))


@query(f"""WITH {RANKINGS}, {MEASURES} SELECT query_id, (SELECT count(*) FROM pairs p WHERE p.query_id = m.query_id AND rs IS NOT NULL AND rt IS NOT NULL) AS n_common, round(recall_at_k, 6) + 0.0 AS recall, round(ndcg_at_k, 6) + 0.0 AS ndcg, round(topk_overlap, 6) + 0.0 AS overlap, round(mrr, 6) + 0.0 AS mrr FROM measures m""")
def doc_neighbors_compare(spark, folder):
    source, target = _rankings(spark, folder)
    both = source.join(target, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n_common"))
    rows = ranking.per_query(source, target, K).join(both, "query_id", "left").fillna(0, ["n_common"])
    return rows.select("query_id", "n_common", *[_r(F.col(m)).alias(n) for m, n in (("recall_at_k", "recall"), ("ndcg_at_k", "ndcg"), ("topk_overlap", "overlap"), ("mrr", "mrr"))])


@query(f"""WITH {RANKINGS}, expected AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id AND q.vec_id + 2 WHERE q.vec_id % {EVERY} = 0)
    SELECT query_id, round(count(t.id) / count(*)::DOUBLE, 6) AS expected_id_recall FROM expected e LEFT JOIN tgt t USING (query_id, id) GROUP BY query_id""")
def expected_id_recall(spark, folder):
    df = _t(spark, folder, "embeddings")
    steps = F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + 2))
    expected = _asked(df).select(F.col("vec_id").alias("query_id"), steps.alias("id")).join(df.select(F.col("vec_id").alias("id")), "id", "left_semi")
    found = ranking.expected_recall(expected, _search(_cut(df)), K)
    return found.select("query_id", _r(F.col("expected_id_recall")).alias("expected_id_recall"))


@query(f"""WITH {RANKINGS}, parts AS (SELECT query_id, id, rank, 1.0 / (60 + rank) AS part FROM src UNION ALL SELECT query_id, id, rank, 0.5 / (60 + rank) FROM tgt),
    fused AS (SELECT query_id, id, sum(part) AS score, min(rank) AS best FROM parts GROUP BY query_id, id) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, id) AS rank FROM fused""")
def rrf_fusion(spark, folder):
    return _shown(fusion.fuse(list(_rankings(spark, folder)), [1.0, 0.5]))


@query(f"""WITH {RANKINGS}, parts AS (SELECT query_id, id, rank, 1.0 / (60 + rank) AS part FROM tgt UNION ALL SELECT query_id, id, rank, 1.0 / (60 + rank) FROM src),
    fused AS (SELECT query_id, id, sum(part) AS score, min(rank) AS best FROM parts GROUP BY query_id, id) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, id) AS rank FROM fused) WHERE rank <= 5""")
def rrf_recovery(spark, folder):
    source, target = _rankings(spark, folder)
    return fusion.recover(target, source, 5).select("query_id", "id", "rank")


# ---- statistics --------------------------------------------------------------------------------------------------

NORMS = "WITH v AS (SELECT resource_name, vector::DOUBLE[] AS v FROM vector_records WHERE len(vector) > 0), s AS (SELECT resource_name, len(v) AS d, len(list_filter(v, lambda x: isnan(x))) > 0 AS nan, len(list_filter(v, lambda x: isinf(x))) > 0 AS inf, CASE WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 THEN sqrt(list_dot_product(v, v)) END AS n FROM v)"


@query(NORMS + " SELECT resource_name, count(*) AS count, max(d)::BIGINT AS dimension, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, bool_or(nan) AS has_nan, bool_or(inf) AS has_inf FROM s GROUP BY resource_name")
def distribution_stats(spark, folder):
    rows = stats.distribution(_t(spark, folder, "vector_records"), by=("resource_name",))
    return rows.withColumn("mean_norm", _r(F.col("mean_norm"))).withColumn("std_norm", _r(F.col("std_norm")))


@query(NORMS + ", a AS (SELECT resource_name, avg(coalesce((abs(n - 1) < 0.01)::DOUBLE, 0)) AS confidence, avg(n) AS mean_norm, stddev_pop(n) AS std_norm FROM s GROUP BY resource_name) SELECT resource_name, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.95 THEN 'detected' ELSE 'not_normalized' END AS status, CASE WHEN confidence >= 0.95 THEN 'l2' ELSE 'none' END AS method, confidence >= 0.95 AS confirmed, round(mean_norm, 6) AS mean_norm, round(std_norm, 6) AS std_norm FROM a")
def analyze_normalization(spark, folder):
    rows = stats.normalization(_t(spark, folder, "vector_records"), by=("resource_name",))
    return rows.select("resource_name", _r(F.col("confidence")).alias("confidence"), "status", "method", "confirmed", _r(F.col("mean_norm")).alias("mean_norm"), _r(F.col("std_norm")).alias("std_norm"))


@query(NORMS + " SELECT resource_name, bool_or(nan) OR bool_or(inf) AS rejected, count(*) FILTER (nan OR inf) AS n_bad FROM s GROUP BY resource_name")
def fidelity_gate(spark, folder):
    return stats.fidelity(_t(spark, folder, "vector_records"), by=("resource_name",))


@query(f"""WITH {CURRENT}, {TARGET}, p AS (SELECT s.id, s.vector::DOUBLE[] AS s, t.vector::DOUBLE[] AS t, t.id IS NOT NULL AS there FROM current s LEFT JOIN target t USING (id)),
    d AS (SELECT *, (s IS NULL AND t IS NULL) OR coalesce(len(s) = len(t), FALSE) AS same FROM p),
    e AS (SELECT id, unnest(list_transform(list_zip(s, t), lambda z: abs(z[1] - z[2]))) AS diff FROM d WHERE there AND same AND s IS NOT NULL), w AS (SELECT id, unnest(list_transform(list_zip(s, t), lambda z: NOT isnan(abs(z[1] - z[2])) AND abs(z[1] - z[2]) <= 1e-5 + 1e-5 * abs(z[2]))) AS ok FROM d WHERE there AND same AND s IS NOT NULL)
    SELECT (SELECT count(*) FROM d WHERE there) AS ids_checked, (SELECT count(*) FROM d WHERE NOT there) AS ids_missing, (SELECT count(*) FROM d WHERE there AND NOT same) AS shape_mismatches,
    (SELECT round(max(diff), 6) FROM e WHERE NOT isnan(diff) AND NOT isinf(diff)) AS max_abs_diff, (SELECT round(avg(diff), 6) FROM e WHERE NOT isnan(diff) AND NOT isinf(diff)) AS mean_abs_diff,
    (SELECT coalesce(bool_and(ok), TRUE) FROM w) AND (SELECT count(*) = 0 FROM d WHERE there AND NOT same) AS within_tolerance""")
def integrity_diff(spark, folder):
    found = stats.integrity(_current(spark, folder), _target(spark, folder))
    return found.withColumn("max_abs_diff", _r(F.col("max_abs_diff"))).withColumn("mean_abs_diff", _r(F.col("mean_abs_diff")))


@query(f"WITH {CURRENT}, {TARGET} SELECT id, resource_name FROM current WHERE id NOT IN (SELECT id FROM target WHERE id IS NOT NULL)")
def missing_in_target(spark, folder):
    return _current(spark, folder).join(_target(spark, folder), "id", "left_anti").select("id", "resource_name")


@query("SELECT datatype, CASE datatype WHEN 'float16' THEN 1e-2 WHEN 'bfloat16' THEN 1e-2 WHEN 'int8' THEN 0.05 WHEN 'binary' THEN 0.0 ELSE 1e-5 END::DOUBLE AS atol, CASE datatype WHEN 'float16' THEN 1e-2 WHEN 'bfloat16' THEN 1e-2 WHEN 'int8' THEN 0.0 WHEN 'binary' THEN 0.0 ELSE 1e-5 END::DOUBLE AS rtol FROM (SELECT DISTINCT datatype FROM resource_infos UNION SELECT unnest(['float32','float16','bfloat16','int8','binary','unknown']))")
def dtype_tolerance(spark, folder):
    all_types = spark.createDataFrame([(t,) for t in (*compat.DATATYPES, "unknown")], "datatype string")
    rows = _t(spark, folder, "resource_infos").select("datatype").union(all_types).distinct()
    atol, rtol = stats.tolerance(F.col("datatype"))
    return rows.select("datatype", atol.alias("atol"), rtol.alias("rtol"))


@query("""WITH k AS (SELECT resource_name, payload, unnest(['language','lang','language_code','locale']) AS key, generate_subscripts(['language','lang','language_code','locale'], 1) AS n FROM vector_records WHERE payload IS NOT NULL),
    f AS (SELECT resource_name, payload, first(json_extract_string(payload, '$.' || key) ORDER BY n) AS language FROM k WHERE json_type(payload, '$.' || key) = 'VARCHAR' AND json_extract_string(payload, '$.' || key) <> '' GROUP BY resource_name, payload)
    SELECT DISTINCT resource_name, language FROM f""")
def detect_languages(spark, folder):
    rows = _t(spark, folder, "vector_records").select("resource_name", stats.language(F.col("payload")).alias("language"))
    return rows.where("language is not null").distinct()


@query("""SELECT round(avg(l2), 6) AS mean_l2_error, round(avg(cos), 6) AS mean_cosine_similarity FROM (SELECT list_distance(v, r) AS l2, list_dot_product(v, r) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(r, r))) AS cos FROM (SELECT embedding::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: round(127 * x) / 127.0) AS r FROM embeddings))""")
def reconstruction_error(spark, folder):
    rebuilt = vectors.dequantize(vectors.quantize_int8(F.col("embedding")), "int8")
    error, angle = stats.reconstruction(F.col("embedding"), rebuilt)
    return _t(spark, folder, "embeddings").agg(_r(F.avg(error)).alias("mean_l2_error"), _r(F.avg(angle)).alias("mean_cosine_similarity"))


# ---- transforms --------------------------------------------------------------------------------------------------


@query("SELECT vec_id, unnest(range(64)) AS pos, round(unnest(list_transform(embedding::DOUBLE[], lambda x: round(127 * x)::INT / 127.0)), 6) + 0.0 AS value FROM embeddings")
def dequantize_int8(spark, folder):
    quantized = _t(spark, folder, "embeddings").select("vec_id", vectors.quantize_int8(F.col("embedding")).alias("q"))
    return _long(quantized.select("vec_id", vectors.dequantize(F.col("q"), "int8").alias("v")), "vec_id", "v")


@query("SELECT vec_id, unnest(range(64)) AS pos, unnest(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END::DOUBLE)) AS value FROM embeddings")
def dequantize_binary(spark, folder):
    return _long(_t(spark, folder, "embeddings").select("vec_id", vectors.dequantize(F.col("embedding"), "binary").alias("v")), "vec_id", "v")


@query(f"WITH {CUT} SELECT id AS vec_id, unnest(range({SHORT})) AS pos, round(unnest(v), 6) + 0.0 AS value FROM cut")
def mrl_truncate(spark, folder):
    return _long(_cut(_t(spark, folder, "embeddings")), "vec_id", "embedding")


@query(f"WITH {CURRENT}, u AS (SELECT id, vector::DOUBLE[] AS v FROM current WHERE {USABLE}) SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm_before, round(sqrt(list_dot_product(w, w)), 6) AS norm_after, round(w[1], 6) + 0.0 AS first FROM (SELECT *, list_transform(v, lambda x: x / n) AS w FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM u))")
def renormalize_on_write(spark, folder):
    rows = _current(spark, folder).where(vectors.is_usable(F.col("vector"), 64)).withColumn("w", vectors.renormalize(F.col("vector")))
    return rows.select("id", _r(vectors.norm(F.col("vector"))).alias("norm_before"), _r(vectors.norm(F.col("w"))).alias("norm_after"), _r(F.get("w", F.lit(0))).alias("first"))


def _matrix_sql(matrix: np.ndarray) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in column) + "]" for column in matrix.T) + "]"


def _projected(spark, folder, target):
    fitted = transforms.fit_random_projection(64, target)
    return _long(fitted.apply(_t(spark, folder, "embeddings"), "embedding", "double"), "vec_id", "embedding")


def _projection_sql(target):
    matrix = _matrix_sql(transforms.fit_random_projection(64, target).matrix)
    return f"WITH m AS (SELECT unnest(range({target})) AS pos, unnest({matrix}) AS c) SELECT vec_id, pos, round(list_dot_product(embedding::DOUBLE[], c::DOUBLE[]), 6) + 0.0 AS value FROM embeddings, m"


@query(_projection_sql(SHORT))
def random_projection(spark, folder):
    return _projected(spark, folder, SHORT)


@query(_projection_sql(96))
def random_projection_expand(spark, folder):
    return _projected(spark, folder, 96)


def _flipped(v):
    """A known map: every other axis turned, and a translation that grows by axis."""
    return F.transform(F.col(v).cast("array<double>"), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x) + (i + 1) / F.lit(100.0))


@query("""WITH e AS (SELECT unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings), p AS (SELECT pos, x, CASE WHEN pos % 2 = 0 THEN x ELSE -x END + (pos + 1) / 100.0 AS y FROM e)
    SELECT pos, CASE WHEN covar_pop(x, y) >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign, round(avg(x), 6) + 0.0 AS source_mean, round(avg(y), 6) + 0.0 AS target_mean FROM p GROUP BY pos""")
def procrustes_diag(spark, folder):
    df = _t(spark, folder, "embeddings").withColumn("target", _flipped("embedding"))
    fitted = transforms.fit_procrustes_diagonal(df, "embedding")
    rows = [(j, float(fitted.matrix[j, j]), float(fitted.before[j]), float(fitted.after[j])) for j in range(len(fitted.before))]
    return spark.createDataFrame(rows, "pos bigint, sign double, source_mean double, target_mean double").select("pos", "sign", _r(F.col("source_mean")).alias("source_mean"), _r(F.col("target_mean")).alias("target_mean"))


def _matrix_rows(spark, **matrices):
    first = next(iter(matrices.values()))
    rows = [(i, j, *(float(m[i, j]) for m in matrices.values())) for i in range(first.shape[0]) for j in range(first.shape[1])]
    df = spark.createDataFrame(rows, "i bigint, j bigint, " + ", ".join(f"{n} double" for n in matrices))
    return df.select("i", "j", *[_r(F.col(n)).alias(n) for n in matrices])


AXES = "WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"


@query(AXES + " SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) + 0.0 AS product FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def gram_matrix(spark, folder):
    return _matrix_rows(spark, product=transforms.moments(_t(spark, folder, "embeddings"), "embedding").xx)


@query(AXES + " SELECT a.i, b.i AS j, round(covar_pop(a.x, b.x), 6) + 0.0 AS covariance, round(avg(a.x), 6) + 0.0 AS mean_i FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i")
def covariance_mean(spark, folder):
    m = transforms.moments(_t(spark, folder, "embeddings"), "embedding")
    return _matrix_rows(spark, covariance=m.own / m.n, mean_i=np.repeat((m.x / m.n)[:, None], len(m.x), axis=1))


# Fits are checked on a design whose answer is known in closed form: every row of the table becomes a vector along the axis
# ``vec_id % 32``, as long as its place, once in either direction. Its axes are uncorrelated and its mean is zero.
DESIGN = "design AS (SELECT vec_id, side, (vec_id % 32)::BIGINT AS axis, (vec_id % 32 + 1) * side::DOUBLE AS x FROM embeddings, (SELECT unnest([1, -1])::BIGINT AS side)), axes AS (SELECT axis, sum(x * x) AS m FROM design GROUP BY axis), ranked AS (SELECT axis, m, row_number() OVER (ORDER BY m DESC) AS place FROM axes)"


def _design(spark, folder):
    axis = (F.col("vec_id") % 32).cast("int")
    rows = _t(spark, folder, "embeddings").select("vec_id", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).alias("side"), axis.alias("axis"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("axis"), (F.col("axis") + 1.0) * F.col("side")).otherwise(0.0))
    # the target: axis j comes out at 63 - j, scaled by 2 + j % 5
    target = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == 63 - F.col("axis"), (F.col("axis") + 1.0) * F.col("side") * (2.0 + F.col("axis") % 5)).otherwise(0.0))
    return rows.select("vec_id", "side", vector.alias("vector"), target.alias("target"))


def _nonzero(df):
    rows = df.select("vec_id", "side", F.posexplode("vector").alias("pos", "value"))
    return rows.select("vec_id", "side", F.col("pos").cast("bigint").alias("pos"), _r(F.col("value")).alias("value")).where("value <> 0")


@query(f"WITH {DESIGN} SELECT vec_id, side, place - 1 AS pos, round(x, 6) AS value FROM design JOIN ranked USING (axis) WHERE place <= 16")
def pca(spark, folder):
    df = _design(spark, folder)
    return _nonzero(transforms.fit_pca(df, 16).apply(df, element="double"))


@query(f"WITH {DESIGN} SELECT round(avg(CASE WHEN place > 16 THEN abs(x) ELSE 0 END), 6) AS mean_l2_error, round(avg(CASE WHEN place > 16 THEN 0.0 ELSE 1.0 END), 6) AS mean_cosine_similarity, round((SELECT sum(m) FILTER (place <= 16) / sum(m) FROM ranked), 6) AS explained FROM design JOIN ranked USING (axis)")
def pca_reconstruction(spark, folder):
    df = _design(spark, folder)
    fitted = transforms.fit_pca(df, 16)
    back = transforms.Affine("inverse", fitted.after, fitted.matrix.T, fitted.before)
    both = back.apply(fitted.apply(df.withColumn("z", F.col("vector")), "z", "double"), "z", "double")
    error, angle = stats.reconstruction(F.col("vector"), F.col("z"))
    return both.agg(_r(F.avg(error)).alias("mean_l2_error"), _r(F.avg(angle)).alias("mean_cosine_similarity"), F.lit(round(fitted.report["explained_variance"], 6)).alias("explained"))


@query(f"WITH {DESIGN} SELECT vec_id, side, 63 - axis AS pos, round(x * (2 + axis % 5) * m / (m + 1), 6) AS value FROM design JOIN axes USING (axis)")
def ridge_mapping(spark, folder):
    """The penalty of one on each coefficient shrinks axis j by m / (m + 1)."""
    df = _design(spark, folder)
    return _nonzero(transforms.fit_ridge(df).apply(df, element="double"))


@query(f"WITH {DESIGN}, strength AS (SELECT axis, m, row_number() OVER (ORDER BY (2 + axis % 5) * m / (m + 1) DESC) AS nth FROM axes) SELECT vec_id, side, 63 - axis AS pos, round(x * (2 + axis % 5) * m / (m + 1), 6) AS value FROM design JOIN strength USING (axis) WHERE nth <= 12")
def low_rank_affine(spark, folder):
    """The twelve axes of the greatest coefficients stay, the others are lost."""
    df = _design(spark, folder)
    return _nonzero(transforms.fit_low_rank(df, rank=12).apply(df, element="double"))


@query("SELECT vec_id, unnest(range(64)) AS pos, round(unnest(list_transform(list_zip(range(64), embedding::DOUBLE[]), lambda z: CASE WHEN z[1] % 2 = 0 THEN z[2] ELSE -z[2] END + (z[1] + 1) / 100.0)), 6) + 0.0 AS value FROM embeddings")
def procrustes_mapping(spark, folder):
    """A known reflection and translation is recovered."""
    df = _t(spark, folder, "embeddings").withColumn("target", _flipped("embedding"))
    return _long(transforms.fit_procrustes(df, "embedding").apply(df, "embedding", "double"), "vec_id", "embedding")


#: White space as the embedder parts words by it, and its vectors.
SPACES_SQL = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
EMBEDDED_SQL = (
    f"words AS (SELECT doc_id, md5(w) AS h FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{SPACES_SQL}')) AS w FROM documents) WHERE w <> ''), "
    "places AS (SELECT doc_id, (('0x' || substr(h, 15, 2))::INT % 64)::BIGINT AS pos, sum(CASE WHEN substr(h, 1, 1) >= '8' THEN 1.0 ELSE -1.0 END) AS n FROM words GROUP BY ALL), "
    "sizes AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM places GROUP BY doc_id), hashed AS (SELECT doc_id, pos, n / (CASE WHEN size = 0 THEN 1 ELSE size END) AS value FROM places JOIN sizes USING (doc_id))"
)


def _embedded(spark, folder):
    documents = _t(spark, folder, "documents").select("doc_id", "text")
    return embed.embed(documents, "text", embed.HashEmbedder(64), "embedding")


@query(f"WITH {EMBEDDED_SQL} SELECT doc_id, pos, round(value::FLOAT::DOUBLE, 5) AS value FROM hashed WHERE value <> 0")
def re_embedding(spark, folder):
    """The vectors of documents embedded anew; documents without text have none."""
    rows = _embedded(spark, folder).select("doc_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 5).alias("value")).where("value <> 0")


@query(f"""WITH {EMBEDDED_SQL}, pairs AS (SELECT q.doc_id AS query_id, c.doc_id AS id, sum(q.value * c.value) AS score FROM hashed q JOIN hashed c USING (pos) WHERE q.doc_id % {EVERY} = 0 GROUP BY ALL)
    SELECT query_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs) WHERE rank <= {K}""")
def text_query(spark, folder):
    """Search by text: each document of the query set, embedded as a free text, against all documents. Texts repeat, so the
    scores of the ranks are what is given."""
    rows = checkpoint(_embedded(spark, folder).where("embedding is not null").select("doc_id", "embedding"))
    found = knn.knn(rows, rows.where(F.col("doc_id") % EVERY == 0), K, "cosine", "doc_id", "embedding")
    return found.select("query_id", F.round("score", 5).alias("score"), "rank")


STRATEGY_SQL = """CASE strategy WHEN 'mrl' THEN coalesce(td IN (32, 64, 128, 256, 512, 768, 1024) AND td < d, FALSE) WHEN 'random_projection' THEN coalesce(d > 0 AND td > 0, FALSE) WHEN 'knowledge_distillation' THEN coalesce(d > 0 AND td > 0, FALSE)
    WHEN 'pca' THEN coalesce(td > 0 AND td < d, FALSE) WHEN 'matryoshka_adaptor' THEN coalesce(td > 0 AND td < d, FALSE) WHEN 'learned_projection' THEN coalesce(td > 0 AND td < d, FALSE) WHEN 'retrieval_aware_projection' THEN coalesce(td > 0 AND td < d, FALSE)
    WHEN 'ridge_mapping' THEN TRUE WHEN 'low_rank_affine_mapping' THEN TRUE WHEN 're_embedding' THEN TRUE WHEN 'residual_mlp_mapping' THEN TRUE ELSE FALSE END"""


@query(f"""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY observed_at DESC) AS n FROM (SELECT DISTINCT * FROM resource_infos)) WHERE n = 1), r AS (SELECT name AS resource_name, dimension AS d, dimension // 2 AS td FROM latest),
    s AS (SELECT * FROM (VALUES ('direct_copy', FALSE), ('mrl', FALSE), ('pca', FALSE), ('random_projection', FALSE), ('ridge_mapping', FALSE), ('procrustes_mapping', FALSE), ('procrustes_diag_mapping', FALSE), ('low_rank_affine_mapping', FALSE), ('re_embedding', FALSE),
    ('residual_mlp_mapping', TRUE), ('matryoshka_adaptor', TRUE), ('learned_projection', TRUE), ('retrieval_aware_projection', TRUE), ('knowledge_distillation', TRUE), ('vec2vec', TRUE), ('smec', TRUE)) AS v(strategy, is_stub))
    SELECT resource_name, strategy, CASE WHEN {STRATEGY_SQL} THEN 'possible' ELSE 'impossible' END AS status, is_stub FROM r, s""")
def strategy_candidates(spark, folder):
    """Which strategies apply to carrying each resource, as last observed, into half its dimension."""
    latest = current_rows(_t(spark, folder, "resource_infos").distinct(), "name", "observed_at", None).select("name", "dimension").collect()  # metadata of resources
    rows = [(r["name"], c["strategy"], c["status"], c["is_stub"]) for r in latest for c in strategies.candidates(strategies.Facts(r["dimension"], r["dimension"] and r["dimension"] // 2, model="jina-embeddings-v3", documents=True))]
    return spark.createDataFrame(rows, "resource_name string, strategy string, status string, is_stub boolean")


# ---- compatibility -----------------------------------------------------------------------------------------------

PAIRS = "WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY observed_at DESC) AS n FROM (SELECT DISTINCT * FROM resource_infos)) WHERE n = 1), p AS (SELECT s.name AS source, t.name AS target, s.dimension AS sd, t.dimension AS td, s.metric AS sm, t.metric AS tm, s.datatype AS st, t.datatype AS tt, s.quantized AS q FROM latest s, latest t)"


def _pairs(spark, folder):
    """Every pair of resources, as last observed: a fixed table of metadata, of which only the latest rows are paired."""
    rows = current_rows(_t(spark, folder, "resource_infos").distinct(), "name", "observed_at", None)
    s = rows.select(F.col("name").alias("source"), F.col("dimension").alias("sd"), F.col("metric").alias("sm"), F.col("datatype").alias("st"), F.col("quantized").alias("q"))
    t = rows.select(F.col("name").alias("target"), F.col("dimension").alias("td"), F.col("metric").alias("tm"), F.col("datatype").alias("tt"))
    return s.crossJoin(t)


DIMENSION_SQL = "CASE WHEN sd IS NULL OR td IS NULL THEN 'unknown' WHEN sd = td THEN 'exact' ELSE 'incompatible' END"
DATATYPE_SQL = "CASE WHEN st = 'unknown' OR tt = 'unknown' THEN 'unknown' WHEN st = tt THEN 'exact' WHEN q = 'TRUE' OR st IN ('int8','binary') OR tt IN ('int8','binary') THEN 'transformable' WHEN st IN ('float32','float16','bfloat16') AND tt IN ('float32','float16','bfloat16') THEN 'compatible' ELSE 'unknown' END"
METRIC_SQL = "CASE WHEN sm = 'unknown' OR tm = 'unknown' THEN 'unknown' WHEN sm = tm THEN 'exact' WHEN sm IN ('cosine','dot') AND tm IN ('cosine','dot') THEN CASE WHEN norm = 'confirmed' THEN 'compatible' ELSE 'unknown' END WHEN (sm = 'euclidean' AND tm IN ('cosine','dot')) OR (tm = 'euclidean' AND sm IN ('cosine','dot')) THEN CASE norm WHEN 'confirmed' THEN 'transformable' WHEN 'unknown' THEN 'unknown' ELSE 'incompatible' END ELSE 'incompatible' END"
NORMS3 = "(SELECT unnest(['confirmed','not_normalized','unknown']) AS norm)"


@query(f"{PAIRS} SELECT source, target, {DIMENSION_SQL} AS classification FROM p")
def compat_dimension(spark, folder):
    return _pairs(spark, folder).select("source", "target", compat.dimension(F.col("sd"), F.col("td")).alias("classification"))


@query(f"{PAIRS} SELECT source, target, {DATATYPE_SQL} AS classification FROM p")
def compat_datatype(spark, folder):
    return _pairs(spark, folder).select("source", "target", compat.datatype(F.col("st"), F.col("tt"), F.col("q")).alias("classification"))


@query(f"{PAIRS} SELECT source, target, norm, {METRIC_SQL} AS classification FROM p, {NORMS3}")
def compat_metric(spark, folder):
    rows = _pairs(spark, folder).withColumn("norm", F.explode(F.array(*map(F.lit, ("confirmed", "not_normalized", "unknown")))))
    return rows.select("source", "target", "norm", compat.metric(F.col("sm"), F.col("tm"), F.col("norm")).alias("classification"))


@query("SELECT s, t, CASE WHEN s = t THEN 'exact' ELSE 'incompatible' END AS classification FROM (SELECT unnest(['dense','sparse']) AS s), (SELECT unnest(['dense','sparse']) AS t)")
def compat_vector_type(spark, folder):
    rows = spark.createDataFrame([(s, t) for s in ("dense", "sparse") for t in ("dense", "sparse")], "s string, t string")
    return rows.withColumn("classification", compat.vector_type(F.col("s"), F.col("t")))


@query("SELECT DISTINCT name, quantized, CASE quantized WHEN 'TRUE' THEN 'transformable' WHEN 'FALSE' THEN 'exact' ELSE 'unknown' END AS classification FROM resource_infos")
def compat_quantization(spark, folder):
    return _t(spark, folder, "resource_infos").select("name", "quantized", compat.quantization(F.col("quantized")).alias("classification")).distinct()


SPACES = [(False, "a/m", "b/m"), (False, "a/m", None), (True, "a/m", None), (True, "a/m", "a/m"), (True, "a/m", "b/m"), (True, None, "a/m")]


@query("SELECT populated, s, t, CASE WHEN NOT populated THEN 'exact' WHEN t IS NULL THEN 'unknown' WHEN s = t THEN 'exact' ELSE 'incompatible' END AS classification FROM (VALUES (FALSE, 'a/m', 'b/m'), (FALSE, 'a/m', NULL), (TRUE, 'a/m', NULL), (TRUE, 'a/m', 'a/m'), (TRUE, 'a/m', 'b/m'), (TRUE, NULL, 'a/m')) AS v(populated, s, t)")
def compat_semantic_space(spark, folder):
    rows = spark.createDataFrame(SPACES, "populated boolean, s string, t string")
    return rows.withColumn("classification", compat.semantic_space(F.col("populated"), F.col("s"), F.col("t")))


@query(f"{PAIRS} SELECT source, target, norm, {DIMENSION_SQL} IN ('exact','compatible') AND {DATATYPE_SQL} IN ('exact','compatible') AND {METRIC_SQL} IN ('exact','compatible') AS possible FROM p, {NORMS3}")
def direct_copy_possible(spark, folder):
    rows = _pairs(spark, folder).withColumn("norm", F.explode(F.array(*map(F.lit, ("confirmed", "not_normalized", "unknown")))))
    c = F.col
    classes = [compat.dimension(c("sd"), c("td")), compat.datatype(c("st"), c("tt"), c("q")), compat.metric(c("sm"), c("tm"), c("norm")), compat.vector_type(F.lit("dense"), F.lit("dense")), compat.semantic_space(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"))]
    return rows.select("source", "target", "norm", compat.direct_copy_possible(*classes).alias("possible"))


@query("""SELECT model, CASE WHEN model IN ('text-embedding-3-small', 'text-embedding-3-large', 'nomic-embed-text-v1.5', 'jina-embeddings-v3') THEN 'TRUE' ELSE 'UNKNOWN' END AS may_be_cut
    FROM (VALUES ('text-embedding-3-small'), ('text-embedding-3-large'), ('nomic-embed-text-v1.5'), ('jina-embeddings-v3'), ('text-embedding-ada-002'), ('Jina-embeddings-v3'), (NULL)) AS v(model)""")
def mrl_support(spark, folder):
    models = ("text-embedding-3-small", "text-embedding-3-large", "nomic-embed-text-v1.5", "jina-embeddings-v3", "text-embedding-ada-002", "Jina-embeddings-v3", None)
    return spark.createDataFrame([(m, compat.mrl_support(m)) for m in models], "model string, may_be_cut string")


@query("""SELECT provider, model, measured, CASE WHEN provider <> '' AND model <> '' THEN provider || '/' || model END AS space, CASE WHEN provider <> '' AND model <> '' THEN 1.0 WHEN measured THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
    FROM (VALUES ('a', 'm'), ('a', NULL), (NULL, 'm'), ('', 'm'), (NULL, NULL)) AS v(provider, model), (VALUES (TRUE), (FALSE)) AS w(measured)""")
def embedding_identity(spark, folder):
    asked = [(p, m, t) for p, m in (("a", "m"), ("a", None), (None, "m"), ("", "m"), (None, None)) for t in (True, False)]
    rows = [(p, m, t, found["space"], found["confidence"]) for p, m, t in asked for found in [compat.embedding_identity(p, m, t)]]
    return spark.createDataFrame(rows, "provider string, model string, measured boolean, space string, confidence double")


@query("""SELECT 'index' AS provider, g AS "group", c AS capability, s AS state FROM (VALUES ('connectivity', 'connect', 'FALSE'), ('connectivity', 'tls', 'TRUE'), ('data', 'list_vectors', 'UNKNOWN'), ('data', 'scan_vectors', 'UNKNOWN'), ('data', 'retrieve_vectors', 'TRUE'), ('data', 'retrieve_payload', 'TRUE'),
    ('data', 'retrieve_documents', 'UNKNOWN'), ('data', 'cdc', 'FALSE'), ('representation', 'dimension', 'TRUE'), ('representation', 'metric', 'TRUE'), ('representation', 'datatype', 'TRUE'), ('representation', 'dense_vectors', 'TRUE'), ('representation', 'sparse_vectors', 'TRUE'), ('representation', 'named_vectors', 'FALSE'),
    ('representation', 'normalization', 'UNKNOWN'), ('representation', 'embedding_model', 'UNKNOWN'), ('representation', 'quantized_storage', 'UNKNOWN'), ('index', 'retrieve_config', 'TRUE'), ('index', 'configure_index', 'TRUE'), ('migration', 'resumable_scan', 'UNKNOWN'), ('migration', 'export', 'FALSE'), ('migration', 'cdc', 'FALSE')) AS v(g, c, s)""")
def store_capabilities(spark, folder):
    """What an index service that can't be reached is known to be able to do."""

    def unreachable(*_):
        raise remote.HttpError(403)

    return remote.PagedIndex(spark, "https://nowhere.invalid", None, unreachable).capabilities()


@query("""SELECT has_golden, has_model, has_documents, CASE WHEN has_golden THEN 'golden' WHEN has_model AND has_documents THEN 'synthetic' ELSE 'unavailable' END AS mode FROM (VALUES (TRUE), (FALSE)) AS a(has_golden), (VALUES (TRUE), (FALSE)) AS b(has_model), (VALUES (TRUE), (FALSE)) AS c(has_documents)""")
def validation_mode(spark, folder):
    flags = (True, False)
    return spark.createDataFrame([(g, m, d, stats.validation_mode(g, m, d)) for g in flags for m in flags for d in flags], "has_golden boolean, has_model boolean, has_documents boolean, mode string")


# ---- selection ---------------------------------------------------------------------------------------------------

BENCH_SQL = "bench AS (SELECT * FROM (VALUES ('b1','direct_copy',TRUE,0.99,0.0,180.0), ('b2','pca',TRUE,0.91,12.0,150.0), ('b3','random_projection',FALSE,0.49,1.0,1.0), ('b4','mrl',TRUE,0.95,3.0,999.0), ('b5','ridge_mapping',TRUE,0.99,500.0,150.0)) AS v(benchmark_id, strategy, passed_quality_gate, quality, cost, latency_ms)), g AS (SELECT * FROM bench WHERE passed_quality_gate), x AS (SELECT max(quality) AS qh, min(quality) AS ql, max(cost) AS ch, min(cost) AS cl, max(latency_ms) AS lh, min(latency_ms) AS ll FROM g)"
NORMAL_SQL = "n AS (SELECT benchmark_id, strategy, CASE WHEN qh - ql <= 1e-4 THEN 1 ELSE (quality - ql) / (qh - ql) END AS nq, CASE WHEN ch - cl <= 1e-4 THEN 1 ELSE (ch - cost) / (ch - cl) END AS nc, CASE WHEN lh - ll <= 1e-4 THEN 1 ELSE (lh - latency_ms) / (lh - ll) END AS nl FROM g, x)"
SCORED_SQL = "s AS (SELECT benchmark_id, strategy, 0.5 * nq + 0.15 * nc + 0.15 * nl + 0.1 + 0.05 + 0.05 AS score FROM n)"


def _bench(spark):
    rows = [("b1", "direct_copy", True, 0.99, 0.0, 180.0), ("b2", "pca", True, 0.91, 12.0, 150.0), ("b3", "random_projection", False, 0.49, 1.0, 1.0), ("b4", "mrl", True, 0.95, 3.0, 999.0), ("b5", "ridge_mapping", True, 0.99, 500.0, 150.0)]
    return spark.createDataFrame(rows, "benchmark_id string, strategy string, passed_quality_gate boolean, quality double, cost double, latency_ms double")


@query("WITH x AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), r AS (SELECT min(v) AS lo, max(v) AS hi FROM x) SELECT l_returnflag, l_linestatus, round(CASE WHEN hi - lo <= 1e-4 THEN 1 ELSE (v - lo) / (hi - lo) END, 6) AS best_high, round(CASE WHEN hi - lo <= 1e-4 THEN 1 ELSE (hi - v) / (hi - lo) END, 6) AS best_low FROM x, r")
def minmax_normalize(spark, folder):
    rows = _t(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_extendedprice").alias("v"))
    return rows.select("l_returnflag", "l_linestatus", _r(selection.normalize(F.col("v"), "maximize")).alias("best_high"), _r(selection.normalize(F.col("v"), "minimize")).alias("best_low"))


@query(f"WITH {BENCH_SQL}, {NORMAL_SQL}, {SCORED_SQL} SELECT benchmark_id, strategy, round(score, 6)::DOUBLE AS score FROM s")
def score_candidates(spark, folder):
    return selection.score(_bench(spark)).withColumn("score", _r(F.col("score")))


@query(f"WITH {BENCH_SQL}, {NORMAL_SQL}, {SCORED_SQL} SELECT benchmark_id, strategy, round(score, 6)::DOUBLE AS score FROM s ORDER BY strategy = 'direct_copy' DESC, s.score DESC, strategy LIMIT 1")
def select_strategy(spark, folder):
    return selection.select(_bench(spark)).withColumn("score", _r(F.col("score")))


@query(f"WITH {RANKINGS}, {MEASURES}, {MEANS} SELECT round((recall_at_k + ndcg_at_k + topk_overlap + 0.0) / 4, 6) AS confidence FROM means")
def confidence_score(spark, folder):
    means = ranking.equivalence(_measures(spark, folder))
    value = selection.confidence(F.col("recall_at_k"), F.col("ndcg_at_k"), F.col("topk_overlap"), F.lit(None).cast("double"), within=F.lit(False))
    return means.select(_r(value).alias("confidence"))


# ---- copying -----------------------------------------------------------------------------------------------------

FIELDS = ["id", "resource_name", "payload", "updated_at"]
SOURCE_ROWS = "src AS (SELECT id, resource_name, payload, updated_at FROM current)"
TARGET_ROWS = "tgt AS (SELECT id, resource_name, payload, updated_at FROM target)"
BOTH = f"WITH {CURRENT}, {TARGET}, {SOURCE_ROWS}, {TARGET_ROWS}"


def _both(spark, folder):
    return _current(spark, folder).select(*FIELDS), _target(spark, folder).select(*FIELDS)


@query(f"{BOTH} SELECT * FROM src")
def collision_overwrite(spark, folder):
    return migrate.resolve(*_both(spark, folder), "overwrite")


@query(f"{BOTH} SELECT id FROM src WHERE id IN (SELECT id FROM tgt)")
def collision_fail(spark, folder):
    return migrate.colliding(*_both(spark, folder)).select("id")


@query(f"{BOTH} SELECT * FROM src WHERE id NOT IN (SELECT id FROM tgt WHERE id IS NOT NULL)")
def collision_skip(spark, folder):
    return migrate.resolve(*_both(spark, folder), "skip")


@query(f"{BOTH} SELECT CASE WHEN id IN (SELECT id FROM tgt WHERE id IS NOT NULL) THEN id || '__migrated' ELSE id END AS id, resource_name, payload, updated_at FROM src")
def collision_rename(spark, folder):
    return migrate.resolve(*_both(spark, folder), "rename")


@query(f"{BOTH} SELECT * FROM tgt WHERE id NOT IN (SELECT id FROM src) UNION ALL SELECT * FROM src")
def upsert_overwrite(spark, folder):
    source, target = _both(spark, folder)
    return migrate.upsert(target, source)


@query(f"{BOTH} SELECT * FROM tgt")
def rollback_exact(spark, folder):
    source, target = _both(spark, folder)
    entries = migrate.ledger(target, source, "m", 0)
    return migrate.rollback(migrate.upsert(target, source), entries)


@query(f"""{BOTH}, w AS (SELECT load_no AS batch, count(*) AS vectors_read, count(*) FILTER (len(vector) > 0) AS vectors_written FROM current GROUP BY load_no)
    SELECT batch::BIGINT AS batch, vectors_read, vectors_written, (sum(vectors_read) OVER (ORDER BY batch))::BIGINT AS total_read, (sum(vectors_written) OVER (ORDER BY batch))::BIGINT AS total_written FROM w""")
def migrate_progress(spark, folder):
    rows = _current(spark, folder).withColumn("batch", F.col("load_no").cast("bigint"))
    return migrate.progress(rows.where(vectors.has_vector(F.col("vector"))), rows.groupBy("batch").agg(F.count("*").alias("vectors_read")))


@query(f"""WITH {CURRENT}, {TARGET}, u AS (SELECT id, resource_name, vector[1:{SHORT}]::DOUBLE[] AS v FROM current WHERE {USABLE}), m AS (SELECT id, resource_name, round(list_sum(list_transform(v, lambda x: x / (CASE WHEN n = 0 THEN 1 ELSE n END))), 5) + 0.0 AS total FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM u))
    SELECT id, resource_name, total FROM m WHERE id NOT IN (SELECT id FROM target WHERE id IS NOT NULL)""")
def migrate_full(spark, folder):
    rows = _current(spark, folder).where(vectors.is_usable(F.col("vector"), 64)).withColumn("vector", vectors.truncated(F.col("vector"), SHORT))
    kept = migrate.resolve(rows, _target(spark, folder), "skip")
    return kept.select("id", "resource_name", _r(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"""WITH {RANKINGS}, {MEASURES}, {MEANS}, expected AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id AND q.vec_id + 2 WHERE q.vec_id % {EVERY} = 0),
    found AS (SELECT query_id, count(t.id) / count(*)::DOUBLE AS share FROM expected e LEFT JOIN tgt t USING (query_id, id) GROUP BY query_id)
    SELECT sample_size, round(recall_at_k, 6) AS recall_at_k, round(ndcg_at_k, 6) AS ndcg_at_k, round(topk_overlap, 6) AS topk_overlap, round(mrr, 6) AS mrr, recall_at_k >= 0.3 AND ndcg_at_k >= 0.5 AND 1 - topk_overlap <= 0.9 AS passed, (SELECT round(avg(share), 6) FROM found) AS expected_id_recall FROM means""")
def verify_golden(spark, folder):
    """Golden queries after the copy: carried through the same transform, searched on both sides, gated."""
    df = _t(spark, folder, "embeddings")
    steps = F.explode(F.sequence(F.col("vec_id"), F.col("vec_id") + 2))
    expected = _asked(df).select(F.col("vec_id").alias("query_id"), steps.alias("id")).join(df.select(F.col("vec_id").alias("id")), "id", "left_semi")
    target = checkpoint(_search(_cut(df)))
    gated = ranking.gate(ranking.equivalence(ranking.per_query(_search(df), target, K)), 0.3, 0.5, 0.9)
    share = ranking.expected_recall(expected, target, K).agg(_r(F.avg("expected_id_recall")).alias("expected_id_recall"))
    return gated.select("sample_size", *[_r(F.col(m)).alias(m) for m in MEAN_NAMES[:4]], "passed").crossJoin(share)  # one row each


# ---- text and state ----------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9]{10,}', '***REDACTED***', 'g'), '(Bearer\s+)[A-Za-z0-9._-]{10,}', '\1***REDACTED***', 'gi'), '((?:api[_-]?key)\s*[:=]\s*)[\"'']?[A-Za-z0-9._-]{6,}[\"'']?', '\1***REDACTED***', 'gi') AS text FROM documents""")
def redact_text(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", redaction.redact_text(F.col("text")).alias("text"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN '***REDACTED***' ELSE props END AS value FROM events""")
def redact_keys(spark, folder):
    key = F.when(F.col("event_type") == "purchase", F.lit("api_key")).otherwise(F.lit("region"))
    rows = _t(spark, folder, "events").select("event_id", redaction.redact_map(F.create_map(key, F.col("props"))).alias("m"))
    return rows.select("event_id", F.get(F.map_values("m"), F.lit(0)).alias("value"))


@query("""SELECT user_id, count(*) AS n_events, arg_max(event_type, event_id) AS last_state, max(event_id) AS last_event FROM events GROUP BY user_id""")
def history_summary(spark, folder):
    return _t(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.max_by("event_type", "event_id").alias("last_state"), F.max("event_id").alias("last_event"))


def _payload_sql(table: str, name: str) -> str:
    """One row per record: the payload as a sorted list of (path, kind, value), numbers as doubles."""
    kinds = "CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN j.type WHEN j.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN 'n' || (j.atom::DOUBLE)::VARCHAR ELSE j.type || coalesce(j.atom->>'$', '') END"
    return (
        f"{name} AS (SELECT id, list(leaf ORDER BY leaf) AS payload FROM (SELECT t.id, j.fullkey || ' ' || {kinds} AS leaf FROM {table} t, LATERAL (SELECT * FROM json_tree(t.payload)) j "
        f"WHERE j.fullkey <> '$' AND j.fullkey NOT IN ('$.__source_id', '$.__namespace', '$.\"__source_id\"', '$.\"__namespace\"')) GROUP BY id)"
    )


@query(f"""WITH {CURRENT}, {TARGET}, {_payload_sql("current", "sp")}, {_payload_sql("target", "tp")},
    both_sides AS (SELECT s.id, s.vector::DOUBLE[] AS s, t.vector::DOUBLE[] AS t FROM current s JOIN target t USING (id)),
    wrong AS (SELECT id FROM both_sides WHERE (s IS NULL) <> (t IS NULL) OR len(s) <> len(t) OR len(list_filter(list_zip(s, t), lambda z: NOT (z[1] = z[2] OR (NOT isinf(z[1]) AND NOT isinf(z[2]) AND NOT isnan(z[1]) AND NOT isnan(z[2]) AND abs(z[1] - z[2]) <= 1e-5 + 1e-5 * abs(z[2]))))) > 0)
    SELECT id, 'missing_in_target' AS diff FROM current WHERE id NOT IN (SELECT id FROM target) UNION ALL SELECT id, 'missing_in_source' FROM target WHERE id NOT IN (SELECT id FROM current)
    UNION ALL SELECT id, 'vector' FROM wrong UNION ALL SELECT b.id, 'payload' FROM both_sides b LEFT JOIN sp USING (id) LEFT JOIN tp USING (id) WHERE sp.payload IS DISTINCT FROM tp.payload""")
def p4_found(spark, folder):
    return reconcile.differences(_t(spark, folder, "vector_records"), _t(spark, folder, "target_records"))
