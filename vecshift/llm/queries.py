"""The queries of this subpackage and their SQL, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecshift.functions.staging import stage
from vecshift.llm import clusters, fixed_sample, leakage, mixing, neighbours, spam, stable_sample


def _t(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_sample(spark, folder):
    return fixed_sample.sample_pages(_t(spark, folder, "scan_pages"), _t(spark, folder, "transform_contexts"))


def p1_report(spark, folder):
    return fixed_sample.sample_report(*(_t(spark, folder, t) for t in ("scan_pages", "transform_contexts", "resource_infos")))


def p2_sample(spark, folder):
    return stable_sample.stable_sample(_t(spark, folder, "vector_records"), _t(spark, folder, "transform_contexts"))


#: Weight of a delivered version: damaged vectors count for less, so that a record's weight rises and falls over its versions.
WEIGHT = "CASE WHEN vector IS NULL THEN 0.25 WHEN size(vector) < 64 THEN 0.5 ELSE 1.5 END"


def p2_weighted(spark, folder):
    """Weighted, with the weights kept from the first loads: records chosen then stay chosen though their weight may have fallen."""
    records, weight = _t(spark, folder, "vector_records"), F.expr(WEIGHT)
    kept = stage(stable_sample.running_weights(records.where("load_no <= 5"), weight), "weights")
    return stable_sample.stable_sample(records, _t(spark, folder, "transform_contexts"), weight, kept)


def p3_found(spark, folder):
    return clusters.Clusters(_t(spark, folder, "vector_records")).found()


def p3_clusters(spark, folder):
    return clusters.Clusters(_t(spark, folder, "vector_records")).described()


def p5_found(spark, folder):
    return neighbours.neighbour_pairs(_t(spark, folder, "vector_records"))


def p6_found(spark, folder):
    return leakage.contaminated(_t(spark, folder, "documents"), _t(spark, folder, "eval_items"))


def p6_items(spark, folder):
    return leakage.leaked_items(_t(spark, folder, "documents"), _t(spark, folder, "eval_items"))


def p7_selection(spark, folder):
    return mixing.Mixture(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets")).selection()


def p7_shares(spark, folder):
    return mixing.Mixture(_t(spark, folder, "documents"), _t(spark, folder, "mix_targets")).shares()


def p8_found(spark, folder):
    return spam.spam_pages(_t(spark, folder, "documents"))


def p8_scores(spark, folder):
    return spam.page_scores(_t(spark, folder, "documents"))


def queries():
    return {f.__name__: f for f in (p1_sample, p1_report, p2_sample, p2_weighted, p3_found, p3_clusters, p5_found, p6_found, p6_items, p7_selection, p7_shares, p8_found, p8_scores)}


#: Current records with usable vectors, over unit vectors in doubles; pairs of them by cosine, rounded as the operators do.
PAIRS = """current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n FROM vector_records WHERE id IS NOT NULL) WHERE n = 1),
    usable AS (SELECT id, vector::DOUBLE[] AS v FROM current WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
    normed AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM usable),
    pairs AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (a.n * b.n) AS cosine FROM normed a JOIN normed b ON a.id <> b.id)"""


def oracle_sql():
    return {
        "p3_found": f"""
            WITH {PAIRS}, near AS (SELECT a, b FROM pairs WHERE cosine >= 0.85 UNION ALL SELECT id, id FROM normed),
            sets AS (SELECT a AS id, list(b ORDER BY b) AS members FROM near GROUP BY a),
            whole AS (SELECT members FROM sets GROUP BY members HAVING count(*) = len(members) AND len(members) >= 3)
            SELECT id, members[1] AS cluster_id FROM sets JOIN whole USING (members)""",
        "p3_clusters": f"""
            WITH {PAIRS}, near AS (SELECT a, b FROM pairs WHERE cosine >= 0.85 UNION ALL SELECT id, id FROM normed),
            sets AS (SELECT a AS id, list(b ORDER BY b) AS members FROM near GROUP BY a),
            whole AS (SELECT members FROM sets GROUP BY members HAVING count(*) = len(members) AND len(members) >= 3),
            found AS (SELECT s.id, s.members[1] AS cluster_id, list_transform(n.v, lambda x: x / n.n) AS u FROM sets s JOIN whole USING (members) JOIN normed n ON n.id = s.id),
            long AS (SELECT cluster_id, generate_subscripts(u, 1) AS j, unnest(u) AS x FROM found),
            sums AS (SELECT cluster_id, j, avg(x) AS mean, 2 * sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS step FROM long GROUP BY cluster_id, j),
            means AS (SELECT cluster_id, list(mean ORDER BY j) AS mean, list(step ORDER BY j) AS step FROM sums GROUP BY cluster_id),
            placed AS (SELECT id, cluster_id, round(list_dot_product(u, mean) / sqrt(list_dot_product(mean, mean)), 9) AS close, list_transform([1, 2], lambda j: floor(round(CASE WHEN step[j] > 1e-7 THEN (u[j] - mean[j]) / step[j] ELSE 0 END + 0.5, 6))) AS cell FROM found JOIN means USING (cluster_id)),
            cells AS (SELECT cluster_id, cell, count(*) AS n FROM placed GROUP BY ALL), sizes AS (SELECT cluster_id, sum(n)::BIGINT AS size, max(n) AS densest_cell_size FROM cells GROUP BY cluster_id),
            top AS (SELECT cluster_id, id AS member, row_number() OVER (PARTITION BY cluster_id ORDER BY close DESC, id) AS place FROM placed)
            SELECT cluster_id, size, densest_cell_size, place, member FROM top JOIN sizes USING (cluster_id) WHERE place <= 3""",
        "p5_found": f"""
            WITH {PAIRS}, ranked AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS n FROM pairs WHERE round(cosine, 9) >= 0.85)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM ranked WHERE n <= 5""",
        "p1_report": """
            WITH records AS (SELECT DISTINCT resource_name, r.id AS id FROM (SELECT resource_name, unnest(records) AS r FROM scan_pages) WHERE r.id IS NOT NULL AND resource_name IS NOT NULL),
            totals AS (SELECT resource_name, count(*) AS records FROM records GROUP BY resource_name),
            latest AS (SELECT name AS resource_name, approximate_count AS reported FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY observed_at DESC, approximate_count DESC NULLS LAST) AS n FROM resource_infos) WHERE n = 1),
            asked AS (SELECT DISTINCT context_id, resource_name, coalesce(sample_size, 0) AS wished FROM transform_contexts)
            SELECT context_id, resource_name, wished, coalesce(records, 0) AS records, greatest(least(wished, coalesce(records, 0)), 0) AS drawn, reported
            FROM asked LEFT JOIN totals USING (resource_name) LEFT JOIN latest USING (resource_name)""",
        "p2_weighted": """
            WITH contexts AS (SELECT DISTINCT context_id, resource_name, coalesce(seed, 42) AS seed, greatest(coalesce(sample_rate, 0), 0) AS rate FROM transform_contexts),
            weighed AS (SELECT resource_name, id, load_no, CASE WHEN vector IS NULL THEN 0.25 WHEN len(vector) < 64 THEN 0.5 ELSE 1.5 END::DOUBLE AS w FROM vector_records WHERE id IS NOT NULL AND resource_name IS NOT NULL),
            drawn AS (SELECT resource_name, id, load_no, w FROM weighed UNION ALL SELECT resource_name, id, NULL, max(w) FROM weighed WHERE load_no <= 5 GROUP BY resource_name, id),
            keyed AS (SELECT c.context_id, c.seed, c.rate, r.*, ('0x' || substr(md5(c.seed::VARCHAR || chr(31) || r.id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM drawn r JOIN contexts c USING (resource_name))
            SELECT context_id, seed, resource_name, id, max(w) AS weight, min(load_no)::INT AS first_load FROM keyed WHERE u < w * rate GROUP BY context_id, seed, resource_name, id""",
        "p2_sample": """
            WITH contexts AS (SELECT DISTINCT context_id, resource_name, coalesce(seed, 42) AS seed, greatest(coalesce(sample_rate, 0), 0) AS rate FROM transform_contexts),
            keyed AS (SELECT c.context_id, c.seed, c.rate, r.resource_name, r.id, r.load_no, ('0x' || substr(md5(c.seed::VARCHAR || chr(31) || r.id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM vector_records r JOIN contexts c USING (resource_name) WHERE r.id IS NOT NULL)
            SELECT context_id, seed, resource_name, id, 1.0::DOUBLE AS weight, min(load_no)::INT AS first_load FROM keyed WHERE u < rate GROUP BY ALL""",
    }
