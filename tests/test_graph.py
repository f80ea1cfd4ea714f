import numpy as np
import pytest
from pyspark.sql import functions as F

from sievector.functions.filters import parse
from sievector.operators import encode, evaluate, gates, graph, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def links(df):
    return sorted((r["src"], r["dst"], r["pos"]) for r in df.collect())


def test_refresh_is_a_new_build(base):
    """Rows that come, move and go at once."""
    moved = base.withColumn("embedding", F.when(F.col("vec_id") % 9 == 4, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    before, after = base.where("vec_id % 9 <> 1"), moved.where("vec_id % 9 <> 2")
    changed = base.where("vec_id % 9 IN (1, 2, 4)").select("vec_id")
    assert links(graph.refresh(graph.knn_graph(before, 6), after, changed, 6)) == links(graph.knn_graph(after, 6))
    assert links(graph.refresh(graph.knn_graph(before, 6), before, changed.limit(0), 6)) == links(graph.knn_graph(before, 6))


def test_cells_and_hot_cells(spark, base):
    """All probes: the exact graph, also where a third of the rows are one vector and cells fall into blocks."""
    some = base.select("vec_id", "embedding")
    one = base.first()["embedding"]
    hot = some.unionByName(spark.range(1000, 1100).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(x)) for x in one]).cast("array<float>").alias("embedding")))
    for rows, size in ((some, 4096), (hot, 32)):
        made = graph.cell_graph(rows, 5, 6, 6, rows=size)
        assert links(made) == links(graph.knn_graph(rows, 5))
    few = graph.cell_graph(some, 5, 6, 4)
    assert few.join(graph.knn_graph(some, 5), ["src", "dst"], "left_semi").count() > 0.8 * 5 * some.count()


def test_save_and_load(spark, base, tmp_path):
    edges = graph.knn_graph(base, 4)
    graph.save(edges, base, f"{tmp_path}/g")
    got, nodes = graph.load(spark, f"{tmp_path}/g")
    assert links(got) == links(edges) and nodes.count() == base.count()
    row = base.first()
    assert graph.vector_of(nodes, row["vec_id"]) == row["embedding"]
    with pytest.raises(KeyError):
        graph.vector_of(nodes, -1)


def parts(base):
    coded = base.withColumn("side", (F.col("vec_id") % 3).cast("string"))
    attributes = {a.key: a for a in encode.manifest(coded, ["label", "side"])}
    nodes = encode.encode(coded, list(attributes.values())).cache()
    edges = graph.knn_graph(base, 12)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().cache()
    held = {k: graph.bits(own := nodes.select("vec_id", F.col(f"fid_{k}").alias("bucket")), graph.neighbour_buckets(both, own), n_buckets=256).cache() for k in attributes}
    return nodes, both, attributes, held


def test_connected_or_reported(spark):
    """A path with no bound on its hops, and two islands."""
    line = [(i, i + 1) for i in range(4)] + [(20, 21)]
    edges = spark.createDataFrame([(a, b) for x in line for a, b in (x, x[::-1])], "src long, dst long")
    buckets = spark.createDataFrame([(i, 1 if i in (0, 4) else 0) for i in range(5)] + [(20, 1), (21, 2)], "vec_id long, bucket int")
    starts = spark.createDataFrame([(0, 1)], "node_id long, bucket int")
    for hops, reach in ((3, []), (None, [(4, 4)])):
        found, paths = graph.first_same_bucket(edges, buckets, starts, 1, hops)
        assert [(r["target"], r["hop"]) for r in found.collect()] == reach
    held = graph.bits(buckets, paths.select(F.col("node").alias("node_id"), "bucket"), n_buckets=256)
    assert {r["bucket"]: r["components"] for r in graph.unconnected(edges, buckets, held).collect()} == {0: 1, 1: 2, 2: 1}


def test_places(spark, base):
    """Against the rank among all rows, with equal vectors under other ids."""
    rows = base.select("vec_id", "label", "embedding")
    rows = rows.unionByName(rows.where("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 10000))
    queries = base.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    every = {(r["query_id"], r["vec_id"]): r["rank"] for r in search.knn(rows, queries, 10**4).collect()}
    got = search.places(rows, queries, search.knn(rows, queries, 7, "label == 3")).collect()
    assert len(got) == 42 and all(every[r["query_id"], r["vec_id"]] == r["place"] for r in got)


def test_gates(base):
    """Against sets in Python: own bucket or bitmap, by the tree; bitmaps alone; and any leaf at all."""
    nodes, _, attributes, held = parts(base)
    label = {r["vec_id"]: r["label"] for r in nodes.collect()}
    side = {r["vec_id"]: r["side"] for r in nodes.collect()}
    bits = {k: {} for k in held}
    for k, df in held.items():
        names = {b: v for v, b in attributes[k].categories.items()}
        for r in df.collect():
            bits[k].setdefault(r["node_id"], set()).add(names[r["bucket"]])
    text = "(label == 3 AND side == 1) OR label == 5"
    got = {g: {r["vec_id"] for r in gates.traversal(nodes, held, parse(text), attributes, g).where("gate").collect()} for g in ("fid_or_tb", "tb", "any")}
    fid = lambda v: (label[v] == 3, side[v] == "1", label[v] == 5)
    tb = lambda v: ("3" in bits["label"].get(v, ()), "1" in bits["side"].get(v, ()), "5" in bits["label"].get(v, ()))
    for v in label:
        f, t = fid(v), tb(v)
        e = [a or b for a, b in zip(f, t)]
        assert (v in got["tb"]) == (t[0] and t[1] or t[2]) and (v in got["fid_or_tb"]) == (e[0] and e[1] or e[2]) and (v in got["any"]) == any(e)
    with pytest.raises(ValueError, match="gate"):
        gates.traversal(nodes, held, parse(text), attributes, "none")


def test_graph_search_stops(spark, base):
    nodes, both, attributes, held = parts(base)
    queries = base.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = search.knn(nodes, queries, 5, "label < 5 AND side == 1")
    found = gates.graph_search(nodes, both, held, queries, 5, "label < 5 AND side == 1", attributes, 64, 20, "any")
    assert evaluate.recall_summary(evaluate.recall(found, exact, queries, 5), 5).first()["avg_recall"] >= 0.9
    allowed = {r["vec_id"] for r in nodes.where("label < 5 AND side = '1'").collect()}
    for kept in (found, gates.graph_search(nodes, both, held, queries, 5, "label < 5 AND side == 1", attributes, 64, 20, "any", break_factor=1.0)):
        assert {r["vec_id"] for r in kept.collect()} <= allowed
    halt = lambda results: results.groupBy("query_id").agg(F.max("hop").alias("hop")).where("hop >= 1")
    short = gates.graph_search(nodes, both, held, queries, 100, "label < 100", attributes, 200, 20, "any", done=halt)
    long = gates.graph_search(nodes, both, held, queries, 100, "label < 100", attributes, 200, 20, "any")
    assert 0 < short.count() < long.count()
    entries = gates.descend(base, queries)
    assert entries.count() == 5 and gates.descend(base, queries, shrink=1).where("query_id = vec_id").count() == 5


def test_validators(base):
    edges, buckets = graph.knn_graph(base, 4), base.select("vec_id", F.col("label").alias("bucket"))
    alone = graph.isolated(edges, buckets)
    held = graph.bits(buckets, n_buckets=256)
    wrong = buckets.select(F.col("vec_id").alias("node_id"), "bucket")
    own = wrong.withColumnRenamed("node_id", "node")
    assert tuple(graph.unsound(edges, buckets, alone, own, held).first()) == (0, 0)
    assert tuple(graph.unsound(edges, buckets, wrong, own.withColumn("bucket", F.col("bucket") + 1), held).first()) == (base.count() - alone.count(), base.count())


def test_null_and_ragged_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], kind)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    for method in ("auto", "columns"):
        got = [(r["query_id"], r["vec_id"]) for r in search.knn(rows, queries, 2, method=method).orderBy("query_id", "rank").collect()]
        assert got == [(1, 1), (1, 3), (3, 3), (3, 1)]
    assert graph.knn_graph(rows, 1).count() == 2
    from sievector.operators import ivf

    assert ivf.assign(rows, ivf.train(rows, 2)).count() == 2
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], kind)
    asked = ragged.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    with pytest.raises(Exception, match="a vector has 1 elements, not 2"):
        search.knn(ragged, asked, 1).collect()
    with pytest.raises(search.VectorError, match="1 to 2"):
        search.knn(ragged, ragged.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 1)


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = [(r["v"], r["place"]) for r in encode.numbered(rows, "v").collect()]
    assert sorted(got) == [(i, i) for i in range(1000)]
    assert encode.numbered(rows.limit(0), "v").count() == 0


def test_blocks_of_zero_queries(spark, base):
    none = base.limit(0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    assert search.knn(base, none, 3).count() == 0 and np.isfinite(search.candidates_needed(5))


def test_missing_groups_in_blocks_of_entries(base, monkeypatch):
    """Entries past one block, which was an error, and every bucket that an entry lacks."""
    monkeypatch.setattr(search, "QUERY_CELLS", 64 * 3)
    edges, buckets = graph.knn_graph(base, 4).cache(), base.select("vec_id", F.col("label").alias("bucket"))
    entries = base.where("vec_id < 10").select(F.col("vec_id").alias("node_id"))
    got = {}
    for r in graph.missing_groups(base.drop("label"), buckets, edges, entries, 2).collect():
        got.setdefault((r["entry"], r["bucket"]), []).append((r["rank"], r["vec_id"]))
    data = {r["vec_id"]: (r["label"], np.array(r["embedding"], float)) for r in base.collect()}
    near = {}
    for r in edges.where("src < 10").collect():
        near.setdefault(r["src"], set()).add(data[r["dst"]][0])
    want = {}
    for e in range(10):
        for bucket in {b for b, _ in data.values()} - near[e] - {data[e][0]}:
            best = sorted((((x - data[e][1]) ** 2).sum(), i) for i, (b, x) in data.items() if b == bucket)[:2]
            want[e, bucket] = [(n + 1, i) for n, (_, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want
