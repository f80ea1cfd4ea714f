import numpy as np
import pytest
from pyspark.sql import functions as F

from sievector.operators import encode, evaluate, graph, profile, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def queries(base, n=20):
    return base.where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_blocks_equal_columns(base):
    for metric in ("l2", "ip"):
        a = rows(search.knn(base, queries(base), 7, "label < 6", metric, method="columns"), "query_id", "rank", "vec_id")
        assert a == rows(search.knn_blocks(base, queries(base), 7, "label < 6", metric), "query_id", "rank", "vec_id")


def test_blocks_of_queries(base, monkeypatch):
    want = rows(search.knn(base, queries(base), 3), "query_id", "rank", "vec_id")
    monkeypatch.setattr(search, "QUERY_CELLS", 64 * 6)
    with pytest.raises(ValueError):
        search.scored(base, queries(base))
    assert rows(search.knn_blocks(base, queries(base), 3), "query_id", "rank", "vec_id") == want


def test_ties_go_to_the_lower_id(spark):
    base = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, q array<float>")
    for method in ("auto", "columns"):
        assert [r[2] for r in sorted(search.knn(base, q, 4, method=method).collect())] == [0, 2, 4, 6]


def test_fewer_rows_than_k(base):
    assert search.knn(base, queries(base, 2), 10, "vec_id < 3").count() == 6
    assert search.knn_blocks(base, queries(base, 2), 10, "vec_id < 0").count() == 0


@pytest.mark.parametrize("label,cap", [(3, 40), (3, 500), (99, 40), (0, 7)])
def test_post_filter_loop(base, label, cap):
    """The closed form against the loop that it stands for."""
    data = [(r["vec_id"], np.array(r["embedding"], float), r["label"]) for r in base.collect()]
    got = {}
    for r in search.post_filter(base, queries(base, 5), 10, f"label == {label}", cap).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(5):
        order = sorted((((v - data[q][1]) ** 2).sum(), i, own) for i, v, own in data)
        c = min(10, cap)
        while True:
            kept = [i for _, i, own in order[:c] if own == label][:10]
            if len(kept) >= 10 or c >= cap:
                break
            c = min(2 * c, cap)
        assert [v for _, v in sorted(got.get(q, []))] == kept


def test_beam_recall(base):
    edges = graph.knn_graph(base, 16).cache()
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    q = queries(base)
    found = search.beam(base, both, q, 10, F.col("label") < 5, F.lit(True), 80, 14)
    per_query = evaluate.recall(found, search.knn(base, q, 10, "label < 5"), q, 10)
    assert evaluate.recall_summary(per_query, 10).first()["avg_recall"] >= 0.9
    assert found.join(base, "vec_id").where("label >= 5").count() == 0


def test_recall_of_empty_truth(spark):
    none = spark.createDataFrame([], "query_id long, vec_id long, rank int")
    one = spark.createDataFrame([(1, 5, 1)], "query_id long, vec_id long, rank int")
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r["query_id"]: r["recall_at_k"] for r in evaluate.recall(one, none, q, 3).collect()} == {1: 0.0, 2: 1.0}
    assert evaluate.recall_by_position(one, one, 3).first()["recall_at_k"] == 1.0


def test_graph_invariants(base):
    edges = graph.knn_graph(base, 4).cache()
    buckets = base.select("vec_id", F.col("label").alias("bucket"))
    alone = graph.isolated(edges, buckets)
    near = graph.neighbour_buckets(edges, buckets)
    assert alone.join(near, ["node_id", "bucket"]).count() == 0
    targets, paths = graph.first_same_bucket(edges, buckets, alone, 2, 3)
    assert targets.join(paths, (targets["start"] == paths["start"]) & (targets["target"] == paths["node"]), "left_anti").count() == 0
    held = graph.bits(buckets, paths.select(F.col("node").alias("node_id"), "bucket"), n_buckets=8)
    assert held.where("bucket >= 8").count() == 0
    assert graph.by_bucket(held).agg(F.sum("n")).first()[0] == held.count()
    assert graph.terminals(buckets.select(F.col("vec_id").alias("node_id"), F.col("bucket").alias("cluster")), 3, 1).groupBy("cluster").count().where("count > 3").count() == 0


def prim(points, weight):
    """Prim's tree over a few points; pairs without a weight are not joined."""
    left, tree, inside = set(points[1:]), [], set(points[:1])
    while left:
        best = min(((w, a, b) for a in inside for b in left if (w := weight.get((min(a, b), max(a, b)))) is not None), default=None)
        tree += [best[1:]] if best else []
        new = best[2] if best else min(left)
        inside.add(new)
        left.discard(new)
    return tree


def test_spanning_forest(spark):
    """Against Prim's tree of each bucket, with many ties and pairs that are not joined."""
    rng = np.random.default_rng(4)
    weights = {(k, int(a), int(b)): int(w) for k in (1, 2, 3) for a, b, w in rng.integers(0, (60, 60, 4), (90, 3)) if a < b}
    got = rows(graph.spanning_forest(spark.createDataFrame([(*key, w) for key, w in weights.items()], "bucket int, a long, b long, weight int")), "bucket", "a", "b")
    assert len(got) == len(set(got))
    for k in (1, 2, 3):
        own = {(a, b): w for (bucket, a, b), w in weights.items() if bucket == k}
        mine = {(a, b): own[a, b] for bucket, a, b in got if bucket == k}
        want = prim(sorted({x for pair in own for x in pair}), own)
        assert len(mine) == len(want) == len(prim(sorted({x for pair in own for x in pair}), mine))
        assert sum(mine.values()) == sum(own[min(e), max(e)] for e in want)
    assert graph.spanning_forest(spark.createDataFrame([], "bucket int, a long, b long, weight int")).count() == 0


def test_more_terminals_than_a_driver_takes(spark):
    """5000 pairs of a bucket with a node of another between them: 10,000 clusters, joined two by two."""
    ids = spark.range(15000)
    buckets = ids.select(F.col("id").alias("vec_id"), (F.col("id") % 3 == 1).cast("int").alias("bucket"))
    steps = ids.where("id % 3 < 2").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = steps.union(steps.select("dst", "src"))
    clusters = graph.bucket_components(edges, buckets)
    tree = graph.connecting_tree(edges, clusters, 1, 2).where("bucket = 0")
    assert tree.count() == 15000 and tree.where("node_id % 3 = 1").count() == 5000


def test_components(spark):
    from sievector.plans.components import connected_components

    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("values,buckets", [([], 256), ([None, None], 256), (["a"], 256), ([str(i) for i in range(254)], 256), ([str(i) for i in range(255)], 256), ([str(i) for i in range(256)], 256), (["1", "1"], 1), (["x", "y", None, "3"], 3)])
def test_encoder_edges(spark, values, buckets):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    (a,) = encode.manifest(df, ["v"], buckets)
    for r in encode.encode(df, [a]).collect():
        assert 0 <= r["fid_v"] <= a.usable_bins
        assert r["v"] is not None or r["fid_v"] == a.usable_bins
    assert a.numeric == (len({v for v in values if v is not None}) > a.usable_bins)


def test_upsert_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(2, "B", False), (3, "C", True), (4, "d", False)], "k long, v string, deleted boolean")
    assert rows(encode.upsert(base, changes, "k"), "k", "v") == [(1, "a"), (2, "B"), (4, "d")]
    logged = spark.createDataFrame([(1, 0, "a"), (1, 2, "z"), (1, 1, "b")], "k long, n long, v string")
    assert rows(encode.last_wins(logged, "k", "n"), "v") == [("z",)]


def test_flatten(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', array(1, 2))) as x, 'y' as z")
    flat = df.select(*profile.flatten(df.schema))
    assert flat.columns == ["x.a", "x.b.c", "z"] and tuple(flat.first()) == ("1", "[1,2]", "y")


def test_connecting_tree(spark):
    """Two clusters of bucket 1 on a path through bucket 0, and a cluster of bucket 2 with nothing to join."""
    path = [(i, i + 1) for i in range(6)]
    edges = spark.createDataFrame([(a, b) for x in path for a, b in (x, x[::-1])], "src long, dst long")
    marks = {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 1, 6: 2}
    buckets = spark.createDataFrame(sorted(marks.items()), "vec_id long, bucket int")
    clusters = graph.bucket_components(edges, buckets)
    assert rows(clusters.where("bucket = 1"), "node_id", "component") == [(0, 0), (1, 0), (5, 5)]
    tree = {r["node_id"] for r in graph.connecting_tree(edges, clusters, 2, 6).where("bucket = 1").collect()}
    assert {2, 3, 4, 5} <= tree and 6 not in tree
    joined = graph.bucket_components(edges, buckets, graph.bits(buckets, graph.connecting_tree(edges, clusters, 2, 6), n_buckets=256))
    assert {r["component"] for r in joined.where("bucket = 1").collect()} == {0}
    entry = spark.createDataFrame([(3,)], "node_id long")
    reached = {b for b, n in rows(graph.entry_paths(edges, buckets, entry, 1, 6), "bucket", "node_id") if marks[n] == b}
    assert reached == {0, 1, 2}


def test_heuristic_and_integrity(base):
    edges = graph.knn_graph(base, 8)
    kept = graph.select_neighbours(edges, base, 4)
    assert kept.groupBy("src").count().where("count > 4").count() == 0
    assert kept.where("pos = 1").join(edges.where("pos = 1"), ["src", "dst"]).count() == base.count()
    assert tuple(graph.integrity(edges, base, 8).first()) == (8 * base.count(), 0, 0, 0, 0)


def test_cells(base):
    from sievector.operators import ivf

    centroids = ivf.train(base, 12)
    cells = ivf.assign(base, centroids).cache()
    q = queries(base)
    exact = search.knn(base, q, 10, "label < 5")
    assert rows(ivf.search_cells(cells, q, centroids, 10, 12, "label < 5"), "query_id", "rank", "vec_id") == rows(exact, "query_id", "rank", "vec_id")
    some = ivf.search_cells(cells, q, centroids, 10, 9, "label < 5")
    assert evaluate.recall_summary(evaluate.recall(some, exact, q, 10), 10).first()["avg_recall"] > 0.8


def test_cells_for_blocks_of_queries(base, monkeypatch):
    from sievector.operators import ivf

    centroids = ivf.train(base, 12)
    cells = ivf.assign(base, centroids)
    want = rows(ivf.search_cells(cells, queries(base), centroids, 5, 4, "label < 5"), "query_id", "rank", "vec_id")
    monkeypatch.setattr(search, "QUERY_CELLS", 64 * 6)
    assert rows(ivf.search_cells(cells, queries(base), centroids, 5, 4, "label < 5"), "query_id", "rank", "vec_id") == want


@pytest.mark.parametrize("name", ["beam_search_gated", "ivf_search"])
def test_every_fiftieth_vector_is_a_query(spark, base, name):
    from sievector.plans import catalogue

    got = {r["query_id"] for r in catalogue.QUERIES[name](spark, SF).collect()}
    assert got == {r["vec_id"] for r in base.where("vec_id % 50 = 0").collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_registered_cells(spark, sf):
    from sievector.plans import catalogue

    sf_dir = f"/root/testdata/{sf}"
    vectors = catalogue.vectors(spark, sf_dir)
    q = catalogue.every_fiftieth(vectors)
    exact = search.knn(vectors, q, catalogue.K, "label < 5")
    found = catalogue.QUERIES["ivf_search"](spark, sf_dir)
    assert evaluate.recall_summary(evaluate.recall(found, exact, q, catalogue.K), catalogue.K).first()["avg_recall"] >= 0.9


def test_small_helpers(spark):
    from sievector.functions import scalars

    r = spark.sql("select 'a' as t, 12345678901 as n, 5 as v").select(scalars.fnv1a(F.col("t")).alias("h"), scalars.block_hash(F.col("n"), 97).alias("b"), scalars.pow2_bin(F.col("v")).alias("p")).first()
    assert r["h"] == 0xAF63DC4C8601EC8C - (1 << 64) and r["b"] == 12345678901 * 2654435761 % 97 and r["p"] == 8
    bins = spark.createDataFrame([(1, 10.0), (4, 40.0), (16, None), (64, 640.0)], "bin long, v double")
    assert rows(scalars.fill_bins(bins, "bin", "v"), "bin", "v") == [(1, 10.0), (4, 40.0), (16, 160.0), (64, 640.0)]
    text = spark.createDataFrame([("  field: a  unique: 3",), ("  values: x, y, z",), ("noise",)], "value string")
    assert rows(profile.parse_profile(text), "attr", "unique_count") == [("a", 3)]
    made = profile.synthetic(spark, 1000, 7)
    assert made.count() == 1000 and made.where("symbol not between 1 and 16 or number not between 0 and 255").count() == 0
    top = made.groupBy("symbol").count().orderBy(F.desc("count")).first()
    assert top["symbol"] == 1 and rows(made, "id", "symbol") == rows(profile.synthetic(spark, 1000, 7), "id", "symbol")


@pytest.mark.parametrize("enough", [None, 40])
def test_walks_alone_and_together_agree(base, monkeypatch, enough):
    edges = graph.knn_graph(base, 8)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().cache()
    q = queries(base)
    run = lambda: rows(search.beam(base, both, q, 10, F.col("label") < 5, F.col("label") != 9, 16, enough=enough), "query_id", "rank", "vec_id")
    alone = run()
    monkeypatch.setattr(search, "GRAPH_CELLS", 0)
    assert run() == alone and len(alone) == 10 * q.count()


def test_early_stop_counts_accepted_results_beyond_ef(spark):
    """On a line, a walk towards its far end goes on until all that were asked for are accepted, not just ``ef``."""
    line = spark.createDataFrame([(i, [float(i)]) for i in range(100)], "vec_id long, embedding array<float>")
    edges = spark.createDataFrame([(i, j) for i in range(100) for j in range(max(0, i - 4), min(100, i + 5)) if i != j], "src long, dst long")
    q = spark.createDataFrame([(1, [100.0])], "query_id long, q array<float>")
    found = search.beam(line, edges, q, 10, F.lit(True), F.lit(True), 8, 30, enough=20)
    assert 20 <= found.agg(F.max("vec_id")).first()[0] < 60


def test_merge_keeps_the_best_of_many_batches():
    import numpy as np

    rng = np.random.default_rng(2)
    q, x, k = rng.integers(0, 3, (7, 4)).astype(float), rng.integers(0, 3, (5000, 4)).astype(float), 9
    d, v = np.full((7, k), np.inf), np.full((7, k), np.iinfo(np.int64).max)
    for at in range(0, 5000, 1700):
        for who in (np.arange(0, 3), np.arange(3, 7)):
            search.merge(d, v, who, q, np.arange(at, min(at + 1700, 5000)), x[at : at + 1700], "l2")
    for i in range(7):
        own = ((x - q[i]) ** 2).sum(1)
        want = np.lexsort((np.arange(5000), own))[:k]
        assert v[i].tolist() == want.tolist() and d[i].tolist() == own[want].tolist()
