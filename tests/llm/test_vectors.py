from datetime import datetime, timedelta

import numpy as np
import pytest

from vecshift.llm import cells, clusters, neighbours

SCHEMA = "id string, vector array<float>, updated_at timestamp, ingested_at timestamp, key string, num bigint"
AT = datetime(2025, 1, 1)


def table(spark, vectors, extra=()):
    rows = [(f"v{i:04d}", None if v is None else [float(x) for x in v], AT, AT, "clash", 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def planted(seed=0, d=16, spread=0.08):
    random = np.random.default_rng(seed)
    groups = []
    for size in (1, 1, 2, 3, 5, 12, 40, 90):
        centre = random.normal(size=d)
        noise = random.normal(size=(size, d)) * spread * np.linalg.norm(centre)
        groups.append(centre + noise)
    out = np.concatenate([*groups, random.normal(size=(150, d)), np.repeat(groups[5][:1], 9, axis=0), groups[4][:1] * 3.0])
    return out[random.permutation(len(out))].astype(np.float32)


def brute_pairs(vectors, names, k=5, least=0.85):
    u = cells.units(np.asarray(vectors))
    s = np.rint(u @ u.T * 1e9)
    pairs = set()
    for i in range(len(u)):
        order = sorted((j for j in range(len(u)) if j != i and s[i, j] >= least * 1e9), key=lambda j: (-s[i, j], names[j]))[:k]
        pairs |= {tuple(sorted((names[i], names[j]))) for j in order}
    return pairs


def brute_clusters(vectors, names, least=0.85):
    u = cells.units(np.asarray(vectors))
    near = u @ u.T >= least
    out = {}
    for i in range(len(u)):
        group = np.flatnonzero(near[i])
        if len(group) >= 3 and all((near[j] == near[i]).all() for j in group):
            out[names[i]] = min(names[j] for j in group)
    return out


ODD = [("odd1", None, AT, AT, "", 0), ("odd2", [], AT, AT, "", 0), ("odd3", [1.0] * 5, AT, AT, "", 0), ("odd4", [0.0] * 16, AT, AT, "", 0), ("odd5", [float("nan")] + [1.0] * 15, AT, AT, "", 0), ("odd6", [float("inf")] * 16, AT, AT, "", 0), ("odd7", [None] + [1.0] * 15, AT, AT, "", 0), (None, [1.0] * 16, AT, AT, "", 0)]


NAMES = [f"v{i:04d}" for i in range(1000)]


def test_neighbours_against_brute_force(spark):
    vectors = planted()
    df, expected = table(spark, vectors, ODD), brute_pairs(vectors, NAMES)
    found = neighbours.neighbour_pairs(df, dimension=16, visits=9, probes=16, reach=1.0).collect()
    assert {(r.id_a, r.id_b) for r in found} == expected and len(found) == len(expected)
    usual = {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df, dimension=16).collect()}
    assert len(usual & expected) >= 0.95 * max(len(expected), len(usual))


def test_clusters_against_brute_force(spark):
    vectors = planted(5, spread=0.05)
    work = clusters.Clusters(table(spark, vectors, ODD), dimension=16)
    expected = brute_clusters(vectors, NAMES)
    assert {r.id: r.cluster_id for r in work.found().collect()} == expected and len(set(expected.values())) >= 3
    described = {}
    for r in work.described().collect():
        described.setdefault(r.cluster_id, []).append(r)
    assert {c: rows[0]["size"] for c, rows in described.items()} == {c: list(expected.values()).count(c) for c in set(expected.values())}
    for cluster, rows in described.items():
        ids = [i for i, c in expected.items() if c == cluster]
        u = cells.units(vectors[[int(i[1:]) for i in ids]])
        mean = u.mean(0)
        close = np.rint(u @ mean / np.linalg.norm(mean) * 1e9)
        assert [r.member for r in sorted(rows, key=lambda r: r.place)] == sorted(ids, key=lambda i: (-close[ids.index(i)], i))[:3]
        assert len(ids) < 40 or 3 <= rows[0].densest_cell_size <= 0.8 * len(ids)


def test_many_cells_with_the_settings_of_the_queries(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST_ROWS", 30)  # outer cells of about 45 rows, inner ones of about 20
    vectors = planted(5, spread=0.05)
    df = table(spark, vectors)
    work = clusters.Clusters(df, dimension=16, target=20)
    plan, stuck = work.vectors.outer(*work.outer)
    assert plan._used() >= 3 and not stuck and any(map(len, plan.divided))
    found, expected = {(r.id, r.cluster_id) for r in work.found().collect()}, set(brute_clusters(vectors, NAMES).items())
    assert len(found & expected) >= 0.95 * max(len(expected), len(found))
    pairs, expected = {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df, dimension=16, target=20).collect()}, brute_pairs(vectors, NAMES)
    assert len(pairs & expected) >= 0.8 * max(len(expected), len(pairs))


def test_hot_cells_are_divided_and_rows_sent_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST_ROWS", 100)
    random = np.random.default_rng(3)
    centre = random.normal(size=16)
    sent = {}
    for n in (1000, 3000):  # two thirds within one tight cluster: far more than a cell should have
        vectors = np.concatenate([centre + random.normal(size=(2 * n // 3, 16)) * 0.1, random.normal(size=(n // 3, 16))]).astype(np.float32)
        work = cells.Vectors(table(spark, vectors), 16)
        plan, stuck = work.outer(3, 0.08, 100)
        visits = work.visits(plan, lambda m: m)
        sent[n] = visits.count()
        sizes = sorted((r["count"] for r in visits.groupBy("key").count().collect()), reverse=True)
        assert not stuck and sizes[0] < 900
    assert sent[3000] <= 3 * 3000 and sent[3000] <= 3.3 * sent[1000]


def test_cells_that_cannot_be_divided_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(cells, "LEAST_ROWS", 20)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 40)
    monkeypatch.setattr(clusters, "GROUP_ROWS", 40)  # groups are checked by their mean direction
    vectors = np.ones((150, 8), np.float32)
    vectors[:, 0] += np.arange(150, dtype=np.float32) * 1e-6
    df = table(spark, vectors)
    work = cells.Vectors(df, 8)
    assert work.outer(3, 0.08, 20)[1]
    assert {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df, dimension=8, most=20).collect()} == brute_pairs(vectors, NAMES)
    assert {r.cluster_id for r in clusters.Clusters(df, dimension=8, most=20).found().collect()} == {"v0000"}


@pytest.mark.parametrize("spread", [0.02, 0.09, 0.13])
def test_large_groups_are_checked_by_their_mean(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "GROUP_ROWS", 25)
    vectors = planted(7, spread=spread)
    found = {r.id: r.cluster_id for r in clusters.Clusters(table(spark, vectors), dimension=16, reach=1.0, visits=9).found().collect()}
    assert found == brute_clusters(vectors, NAMES)


def test_long_chains_cost_one_pass(spark, monkeypatch):
    monkeypatch.setattr(clusters, "GROUP_ROWS", 25)
    angles = np.deg2rad(np.concatenate([np.arange(0, 150, 2), np.full(40, 220) + np.linspace(0, 3, 40)]))
    vectors = np.stack([np.cos(angles), np.sin(angles), 0 * angles], axis=1).astype(np.float32)
    compared, signed = [], clusters.Clusters._signed

    def counted(self, rows, hot):
        compared.append(rows.where("key is not null").count())
        return signed(self, rows, hot)

    monkeypatch.setattr(clusters.Clusters, "_signed", counted)
    found = {r.id: r.cluster_id for r in clusters.Clusters(table(spark, vectors), dimension=3).found().collect()}
    assert found == brute_clusters(vectors, NAMES) and len(found) == 40 and sum(compared) == 0


def test_classes_of_copies(spark):
    random = np.random.default_rng(9)
    base = random.normal(size=(40, 16)).astype(np.float32)
    near = base[:10] + random.normal(size=(10, 16)).astype(np.float32) * 0.05
    vectors = np.concatenate([base, near, np.repeat(base[:1], 30, axis=0), np.repeat(base[20:21], 1, axis=0), np.repeat(base[30:31], 2, axis=0), np.repeat(near[1:2], 3, axis=0)])
    vectors = vectors[random.permutation(len(vectors))]
    df = table(spark, vectors)
    assert {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df, dimension=16, visits=9, probes=16, reach=1.0).collect()} == brute_pairs(vectors, NAMES)
    assert {r.id: r.cluster_id for r in clusters.Clusters(df, dimension=16, visits=9, reach=1.0).found().collect()} == brute_clusters(vectors, NAMES)


def test_a_chain_is_no_cluster(spark):
    angles = np.deg2rad([0, 20, 40, 60])
    chain = np.stack([np.cos(angles), np.sin(angles), 0 * angles], axis=1)
    assert clusters.Clusters(table(spark, chain), dimension=3).found().count() == 0


def test_old_versions_do_not_count(spark):
    later = AT + timedelta(days=1)
    rows = [("a", [1.0, 0.0], AT, AT, "", 0), ("b", [1.0, 0.01], AT, AT, "", 0), ("c", [1.0, 0.0], AT, AT, "", 0), ("c", [0.0, 1.0], later, AT, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in neighbours.neighbour_pairs(df, dimension=2).collect()] == [("a", "b")]
    assert clusters.Clusters(df, dimension=2).found().count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.neighbour_pairs(empty, dimension=16).count() == 0
    assert clusters.Clusters(empty, dimension=16).found().count() == 0
    assert neighbours.neighbour_pairs(table(spark, [[1.0] * 16]), dimension=16).count() == 0


def test_ties():
    # all but equal similarities take the dense way
    many = np.ones((700, 8), np.float32) * (1 + np.arange(700, dtype=np.float32))[:, None]
    a, b, _ = neighbours.cell_neighbours(np.arange(700), many, 5, 0.85, target=1000)
    assert [list(b[a == n]) for n in (0, 3, 699)] == [[1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [0, 1, 2, 3, 4]]
    row, other, cosine = neighbours.best_of(np.array([1, 1, 1, 0, 1]), np.array([9, 4, 4, 7, 5]), np.array([5, 8, 7, 1, 8]), 2)
    assert (row.tolist(), other.tolist(), cosine.tolist()) == ([0, 1, 1], [7, 4, 5], [1, 8, 8])


def test_propagation(spark):
    random = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in random.integers(0, 400, (300, 2))] + [(n, n + 1) for n in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = clusters.propagate_minimum(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.label for r in found} == {x: root(x) for x in nodes} and len(found) == len(nodes)


def test_visits():
    vectors = cells.units(np.random.default_rng(2).normal(size=(500, 16)))
    plan = cells.Cells.fit(vectors, 100_000, 5_000, tables=3, visits=9, reach=1.0)
    rows, keys = plan.keys(vectors)
    assert len(rows) == 9 * 500 and len(set(zip(rows, keys))) == len(rows)
    home, level = plan.homes(vectors)
    assert set(zip(np.tile(np.arange(500), 3), home)) <= set(zip(rows, keys)) and (level >= 1).any()
    count = np.unique(home, return_counts=True)[1]
    assert count.max() * 200 <= 5_000 or level.max() == len(plan.divided) - 1
    assert len(cells.Cells.fit(vectors, 500, 10_000).homes(vectors)[0]) == 500 and len(np.unique(cells.Cells.fit(vectors, 500, 10_000).homes(vectors)[0])) > 1


def test_joined_labels():
    random = np.random.default_rng(4)
    a, b = random.integers(0, 200, (2, 150))
    label = clusters.joined_labels(200, a, b)
    for _ in range(200):
        before = label.copy()
        assert (label[a] == label[b]).all()
        break
    assert all(label[x] <= x and label[label[x]] == label[x] for x in range(200))
