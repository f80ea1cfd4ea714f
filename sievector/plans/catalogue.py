"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievector.functions import scalars
from sievector.functions.filters import Attribute, Between, allowed_buckets, bucket_column, numeric_value, parse, to_column
from sievector.operators import encode, evaluate, gates, graph, ivf, profile, search
from sievector.plans import sql
from sievector.plans.staging import stage
from sievector.sources.sinks import topk_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EVERY, K, BUCKETS = 50, 10, 16


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_set(base: DataFrame) -> DataFrame:
    """All vectors whose id is divisible by ``EVERY`` as queries (query_id, q)."""
    return base.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the attributes of the event of the same number, and of the part of the same key if there is one."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), "event_type", "user_id", "value", "props")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_brand", "p_size", "p_retailprice")
    return vectors(spark, sf_dir).join(events, "vec_id").join(parts, "vec_id", "left")


def shown(found: DataFrame, *extra: str) -> DataFrame:
    """Results with distances rounded to six digits, for comparisons across engines."""
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"), *extra)


L2 = "list_sum(list_transform(list_zip(q, embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))"
IP = "1.0 - list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::double * x[2]::double))"
QS = f"q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % {EVERY} = 0)"
ATTRS = """a AS (SELECT e.vec_id, e.embedding, e.label, v.event_type, v.user_id, v.value, v.props, p.p_brand, p.p_size, p.p_retailprice
 FROM embeddings e JOIN events v ON v.event_id = e.vec_id LEFT JOIN part p ON p.p_partkey = e.vec_id)"""


def knn_sql(condition: str = "true", dist: str = L2, source: str = "embeddings", k: int = K, before: str = "") -> str:
    return f"""WITH {before}{QS}, d AS (SELECT query_id, vec_id, {dist} AS dist FROM {source}, q WHERE {condition}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, round(dist, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"""


# -- exact search -----------------------------------------------------------------------------------------


def _knn(name: str, predicate: str | None, condition: str, metric: str = "l2", attributes: bool = False) -> None:
    sql = knn_sql(condition, IP if metric == "ip" else L2, "a" if attributes else "embeddings", before=ATTRS + ", " if attributes else "")

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = vectors(spark, sf_dir)
        return shown(search.knn(with_attributes(spark, sf_dir) if attributes else base, query_set(base), K, predicate, metric))


_NUMBER = "regexp_matches({0}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')"
_knn("knn_exact_l2", None, "true")
_knn("knn_exact_ip", None, "true", "ip")
_knn("knn_filter_eq", "label == 3", "label = 3")
_knn("knn_filter_ne", "label != 3", "label <> 3")
_knn("knn_filter_in", "label IN [1, 4, 7]", "label IN (1, 4, 7)")
_knn("knn_filter_range", "2 <= label < 5", "label >= 2 AND label < 5")
_knn("knn_filter_between", "vec_id BETWEEN 100 AND 300", "vec_id BETWEEN 100 AND 300")
_knn("knn_filter_and", "label == 3 AND vec_id < 400", "label = 3 AND vec_id < 400")
_knn("knn_filter_or", "label == 3 OR label == 8", "label = 3 OR label = 8")
_knn("knn_filter_nested", "(label == 3 OR label > 7) AND (vec_id < 200 OR vec_id >= 400)", "(label = 3 OR label > 7) AND (vec_id < 200 OR vec_id >= 400)")
_knn("knn_filter_string_attr", "event_type == click AND value >= 10.5", "event_type = 'click' AND value >= 10.5", attributes=True)
_knn("knn_filter_string_order", 'event_type > "m" AND label != 0', "event_type > 'm' AND label <> 0", attributes=True)
_knn("knn_filter_missing_attr", "p_size != 7", "p_size <> 7", attributes=True)
_knn("knn_filter_two_attr_and", "event_type == click AND label == 3", "event_type = 'click' AND label = 3", attributes=True)
_knn("knn_filter_two_attr_or", "event_type == click OR label == 3", "event_type = 'click' OR label = 3", attributes=True)


@query(knn_sql("label < 8"))
def knn_arrow_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return shown(search.knn_blocks(base, query_set(base), K, "label < 8"))


@query(knn_sql(f"least(vec_id // CAST(ceil((SELECT count(*) FROM embeddings) / {float(BUCKETS)}) AS BIGINT), {BUCKETS - 1}) = 5"))
def knn_computed_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter on a bucket computed from the id, with no metadata table."""
    base = vectors(spark, sf_dir)
    bucket = scalars.bucket_ceil(F.col("vec_id"), base.count(), BUCKETS)
    return shown(search.knn(base, query_set(base), K, bucket == 5))


@query(
    f"""WITH {QS}, d AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(q, embedding), lambda x:
 (CAST(floor((x[1]::double + 1) * 100) AS BIGINT) - CAST(floor((x[2]::double + 1) * 100) AS BIGINT)) * (CAST(floor((x[1]::double + 1) * 100) AS BIGINT) - CAST(floor((x[2]::double + 1) * 100) AS BIGINT)))) AS dist FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) SELECT query_id, rank, vec_id, CAST(dist AS BIGINT) AS dist FROM r WHERE rank <= {K}"""
)
def knn_uint8_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unsigned bytes, read as small integers; distances are whole numbers."""
    base = vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("smallint")))
    found = search.knn(base, query_set(base), K, metric="l2_int")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "dist")


def _rank_all(condition: str) -> str:
    return f"""WITH {QS}, d AS (SELECT query_id, vec_id, ({condition}) AS ok, {L2} AS dist FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d),
n AS (SELECT count(*) AS n FROM embeddings), cap AS (SELECT least(160, n) AS cap FROM n),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM r, cap WHERE ok AND rank <= cap),
kth AS (SELECT *, max(CASE WHEN nth = {K} THEN rank END) OVER (PARTITION BY query_id) AS kth FROM s),
c AS (SELECT *, CASE WHEN kth <= 10 THEN 10 WHEN kth <= 20 THEN 20 WHEN kth <= 40 THEN 40 WHEN kth <= 80 THEN 80 ELSE cap END AS candidates FROM kth),
found AS (SELECT query_id, nth AS rank, vec_id, dist, candidates FROM c WHERE rank <= candidates AND nth <= {K})"""


@query(_rank_all("label = 3") + " SELECT query_id, rank, vec_id, round(dist, 6) AS dist, CAST(candidates AS BIGINT) AS candidates FROM found")
def knn_post_filter_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    found = search.post_filter(base, query_set(base), K, "label == 3", 160)
    return shown(found.withColumn("candidates", F.col("candidates").cast("long")), "candidates")


@query(
    f"""WITH {QS}, d AS (SELECT query_id, vec_id, {L2} AS dist FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d WHERE dist <= 1.5)
SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM r WHERE rank <= 25"""
)
def radius_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return shown(search.radius(base, query_set(base), 1.5, 25))


@query(
    f"""WITH {QS}, d AS (SELECT query_id, vec_id % 50 AS doc, {L2} AS dist FROM embeddings, q), m AS (SELECT query_id, doc, min(dist) AS dist FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc) AS rank FROM m) SELECT query_id, rank, doc, round(dist, 6) AS dist FROM r WHERE rank <= {K}"""
)
def multivector_doc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).withColumn("doc", F.col("vec_id") % 50)
    found = search.documents(base, query_set(base), K)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc", F.round("dist", 6).alias("dist"))


@query()
def beam_search_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate walk on the neighbour graph; nodes pass if their bucket is allowed or they hold its bit."""
    base = vectors(spark, sf_dir)
    edges = stage(graph.knn_graph(base, 16), "graph")
    held = graph.neighbour_buckets(edges, base.select("vec_id", F.col("label").alias("bucket"))).where("bucket = 3").select(F.col("node_id").alias("vec_id"), F.lit(True).alias("held"))
    nodes = base.join(held, "vec_id", "left")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    gate = (F.col("label") == 3) | F.coalesce("held", F.lit(False))
    queries = query_set(base)
    return shown(search.beam(nodes, both, queries, K, F.col("label") == 3, gate, search.candidates_needed(K, ef=64), entry=gates.descend(base, queries)))


# -- evaluation -------------------------------------------------------------------------------------------


@query(
    _rank_all("label = 3")
    + f""", truth AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d WHERE ok) WHERE rank <= {K}),
t AS (SELECT query_id, count(*) AS enns_size FROM truth GROUP BY 1), f AS (SELECT query_id, count(*) AS anns_size FROM found GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits FROM found JOIN truth USING (query_id, vec_id) GROUP BY 1)
SELECT q.query_id, coalesce(enns_size, 0) AS enns_size, coalesce(anns_size, 0) AS anns_size, coalesce(hits, 0) AS hits,
CASE WHEN coalesce(enns_size, 0) > 0 THEN coalesce(hits, 0)::double / least({K}, enns_size) WHEN coalesce(anns_size, 0) = 0 THEN 1.0 ELSE 0.0 END AS recall_at_k
FROM q LEFT JOIN t USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN h USING (query_id)"""
)
def recall_post_filter_vs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    queries = query_set(base)
    return evaluate.recall(search.post_filter(base, queries, K, "label == 3", 160), search.knn(base, queries, K, "label == 3"), queries, K)


_TRUE = "(SELECT count(*) AS n, count(*) FILTER (vec_id % 50 = 0) AS asked, least(count(*) FILTER ({0}), 10) AS true_rows FROM embeddings)"


@query(f"SELECT asked AS queries, 1.0::double AS avg_recall, CASE WHEN true_rows < 10 THEN asked ELSE 0 END AS short_queries FROM {_TRUE.format('label = 3')}")
def recall_summary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block search against the exact one: recall 1 for every query."""
    base = vectors(spark, sf_dir)
    queries = query_set(base)
    per_query = evaluate.recall(search.knn_blocks(base, queries, K, "label == 3"), search.knn(base, queries, K, "label == 3"), queries, K)
    return evaluate.recall_summary(per_query, K)


@query(
    """SELECT name, CAST(matched AS BIGINT) AS matched, CAST(total AS BIGINT) AS total, matched::double / total AS ratio FROM (
SELECT 'cheap' AS name, count(*) FILTER (l_extendedprice <= 2000) AS matched, count(*) AS total FROM lineitem UNION ALL
SELECT 'returned', count(*) FILTER (l_returnflag = 'R'), count(*) FROM lineitem UNION ALL
SELECT 'few', count(*) FILTER (l_quantity BETWEEN 1 AND 5), count(*) FROM lineitem UNION ALL
SELECT 'mixed', count(*) FILTER (l_linestatus = 'O' AND (l_discount > 0.05 OR l_tax IN (0.01, 0.02))), count(*) FROM lineitem)"""
)
def selectivity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    texts = {"cheap": "l_extendedprice <= 2000", "returned": "l_returnflag == R", "few": "l_quantity BETWEEN 1 AND 5", "mixed": "l_linestatus == O AND (l_discount > 0.05 OR l_tax IN [0.01, 0.02])"}
    return evaluate.selectivity(lines, {k: to_column(parse(t), lines.schema) for k, t in texts.items()})


@query(
    """SELECT count(*) AS total, count(*) FILTER (event_type = 'click' AND json_extract_string(props, '$.k') = '7' AND value >= 20 AND value < 80) AS and_matched,
count(*) FILTER ((event_type = 'click' OR json_extract_string(props, '$.k') = '7') AND value >= 20 AND value < 80) AS or_matched FROM events"""
)
def json_selectivity_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    exact = [F.col("event_type") == "click", profile.json_field(F.col("props"), "$.k") == "7"]
    return evaluate.joint_selectivity(events, exact, [(F.col("value") >= 20) & (F.col("value") < 80)])


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
round(count(*) * 1e9 / sum(value), 3) AS qps FROM events GROUP BY 1"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.latency(table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumns({"mean": F.round("mean", 6), "qps": F.round("qps", 3)})


@query("SELECT CAST(pow(2, ceil(log2(l_quantity))) AS BIGINT) AS bin, count(*) AS n, median(l_extendedprice) AS median_value FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def pow2_bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.medians_by_bin(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


_RUNS = "SELECT {} AS method, p_size AS selectivity, length(p_type) AS ef, {}(p_retailprice) AS qps FROM part GROUP BY ALL"


@query(
    f"""WITH a AS ({_RUNS.format("'old'", "min")}), b AS ({_RUNS.format("'new'", "max")}),
g AS (SELECT a.selectivity, a.ef, (b.qps - a.qps) / a.qps AS gain FROM a JOIN b USING (selectivity, ef))
SELECT selectivity, round(avg(gain), 9) AS mean_gain, round(median(gain), 9) AS median_gain, round(max(gain), 9) AS best_gain, round(min(gain), 9) AS worst_gain,
arg_max(ef, (gain, ef)) AS best_ef, arg_min(ef, (gain, ef)) AS worst_ef FROM g GROUP BY 1"""
)
def method_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("selectivity"), F.length("p_type").cast("long").alias("ef")).agg(F.min("p_retailprice").alias("old"), F.max("p_retailprice").alias("new"))
    runs = part.select("selectivity", "ef", F.explode(F.create_map(F.lit("old"), F.col("old"), F.lit("new"), F.col("new"))).alias("method", "qps"))
    out = evaluate.method_deltas(runs, "old", "new")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_gain", "median_gain", "best_gain", "worst_gain")})


# -- buckets and encoding ---------------------------------------------------------------------------------


def _synthetic(name: str, column: Callable[[Column, int, int], Column], expression: str) -> None:
    @query(f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST({expression} AS BIGINT) AS bucket, count(*) AS n_rows, min(vec_id) AS first_id FROM embeddings, n GROUP BY 1", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = vectors(spark, sf_dir)
        return base.groupBy(column(F.col("vec_id"), base.count(), 7).cast("long").alias("bucket")).agg(F.count("*").alias("n_rows"), F.min("vec_id").alias("first_id"))


_synthetic("synth_bucket_ceil", scalars.bucket_ceil, "least(vec_id // CAST(ceil(n / 7.0) AS BIGINT), 6)")
_synthetic("synth_bucket_floor", scalars.bucket_floor, "least(vec_id // (n // 7), 6)")
_synthetic("synth_bucket_scaled", scalars.bucket_scaled, "vec_id * 7 // n")


@query(
    """SELECT 'p_brand' AS attr, CAST(p_brand AS VARCHAR) AS value, dense_rank() OVER (ORDER BY CAST(p_brand AS VARCHAR)) - 1 AS bucket, count(*) AS n FROM part GROUP BY p_brand UNION ALL
SELECT 'p_size', CAST(p_size AS VARCHAR), dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1, count(*) FROM part GROUP BY p_size"""
)
def encode_categorical_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    attributes = encode.manifest(part, ["p_brand", "p_size"])
    coded = encode.encode(part, attributes)
    parts = [coded.groupBy(F.lit(a.key).alias("attr"), F.col(a.key).cast("string").alias("value"), F.col(f"fid_{a.key}").cast("long").alias("bucket")).agg(F.count("*").alias("n")) for a in attributes]
    return parts[0].unionByName(parts[1])


@query(
    """WITH v AS (SELECT DISTINCT p_type AS value FROM part) SELECT value, row_number() OVER (ORDER BY CASE value WHEN 'STANDARD' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, value) - 1 AS bucket FROM v"""
)
def encode_categorical_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode.dictionary(table(spark, sf_dir, "part"), "p_type", ["STANDARD", "ECONOMY"])
    return found.select("value", F.col("bucket").cast("long").alias("bucket"))


@query("SELECT token, row_number() OVER (ORDER BY first, token) - 1 AS bucket FROM (SELECT source || '/' || lang AS token, min(doc_id) AS first FROM documents GROUP BY 1)")
def encode_first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode.first_come(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang"), "doc_id", 256)
    return found.select("token", F.col("bucket").cast("long").alias("bucket"))


@query(
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(greatest(floor((l_extendedprice - lo) / (hi - lo) * 255), 0), 254) AS BIGINT) AS bucket, count(*) AS n FROM lineitem, m GROUP BY 1"""
)
def encode_numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    coded = encode.encode(lines.select("l_extendedprice"), encode.manifest(lines, ["l_extendedprice"]))
    return encode.histogram(coded, "fid_l_extendedprice").withColumn("bucket", F.col("bucket").cast("long"))


def _narrow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Attribute]:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    attributes = encode.manifest(events, ["value"], buckets=64)
    return encode.encode(events, attributes), attributes[0]


@query(
    """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT value, CAST(least(greatest(floor((value - lo) / (hi - lo) * 63), 0), 62) AS BIGINT) AS bucket, least(greatest(floor((50 - lo) / (hi - lo) * 63), 0), 62) AS b0, least(greatest(floor((95 - lo) / (hi - lo) * 63), 0), 62) AS b1 FROM events, m)
SELECT bucket, count(*) FILTER (value BETWEEN 50 AND 95) AS true_rows, count(*) FILTER (value NOT BETWEEN 50 AND 95) AS false_positives FROM b WHERE bucket BETWEEN b0 AND b1 GROUP BY 1"""
)
def bucket_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a bucket test admits, by whether the exact range admits them."""
    coded, attribute = _narrow(spark, sf_dir)
    gate = sorted(allowed_buckets(Between("value", "50", "95"), attribute))
    exact = F.col("value").between(50, 95)
    admitted = coded.where(F.col("fid_value").between(gate[0], gate[-1]))
    return admitted.groupBy(F.col("fid_value").cast("long").alias("bucket")).agg(F.count_if(exact).alias("true_rows"), F.count_if(~exact).alias("false_positives"))


@query("SELECT event_id, value FROM events WHERE (value > 100 AND value <= 130) OR value < 5")
def bucket_pruned_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket test first, exact filter after it: no row is lost."""
    coded, attribute = _narrow(spark, sf_dir)
    node = parse("(value > 100 AND value <= 130) OR value < 5")
    return coded.where(bucket_column(node, {"value": attribute}) & to_column(node, coded.schema)).select("event_id", "value")


_PROFILED = {"p_brand": "NULL", "p_size": "p_size", "p_retailprice": "p_retailprice", "p_name": "NULL"}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS attr, count(DISTINCT {c}) AS unique_non_missing, count(*) - count({c}) AS missing, CAST(min({x}) AS DOUBLE) AS min_value, CAST(max({x}) AS DOUBLE) AS max_value, CAST({'count(' + c + ')' if x == 'NULL' else '0'} AS BIGINT) AS unparsable FROM part"
        for c, x in _PROFILED.items()
    )
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.profile(table(spark, sf_dir, "part"), list(_PROFILED))


@query(
    """WITH m AS (SELECT min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem)
SELECT (l_partkey - lo) * 255 // (hi - lo) AS code, CASE WHEN hi - lo < 256 THEN l_partkey - lo ELSE least(255, (l_partkey - lo) // CAST(ceil((hi - lo + 1) / 256.0) AS BIGINT)) END AS step_code, count(*) AS n FROM lineitem, m GROUP BY ALL"""
)
def binary_code_255(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    low, high = lines.agg(F.min("l_partkey"), F.max("l_partkey")).first()
    codes = [f(F.col("l_partkey"), F.lit(low), F.lit(high)).cast("long").alias(name) for name, f in (("code", encode.code_255), ("step_code", encode.byte_code))]
    return lines.groupBy(*codes).agg(F.count("*").alias("n"))


_VALUES = ["10", "10.0", "9", "abc", " 5", "5 ", "", "1.5d", "inf", "0x10", "-3e2", None]
_FILTERS = ["v == 10", "v == '10.0'", "v != 10", "v > 9", "v >= abc", "v < 10.5", "v <= '5 '", "v IN [10, abc]", "v BETWEEN 5 AND 10", "v BETWEEN 5 AND b"]


def _truth(f: str) -> str:
    """DuckDB condition of one of the filters above."""
    n, x = _NUMBER.format("v"), "TRY_CAST(trim(v) AS DOUBLE)"
    number = lambda op, lit: f"CASE WHEN {n} THEN {x} {op} {lit} ELSE v {op} '{lit}' END"
    return {
        "v == 10": number("=", "10"), "v == '10.0'": number("=", "10.0"), "v != 10": number("<>", "10"), "v > 9": number(">", "9"), "v >= abc": "v >= 'abc'",
        "v < 10.5": number("<", "10.5"), "v <= '5 '": "v <= '5 '", "v IN [10, abc]": f"({number('=', '10')}) OR v = 'abc'",
        "v BETWEEN 5 AND 10": f"CASE WHEN {n} THEN {x} BETWEEN 5 AND 10 ELSE v BETWEEN '5' AND '10' END", "v BETWEEN 5 AND b": "v BETWEEN '5' AND 'b'",
    }[f]


@query(
    "WITH t(i, v) AS (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(_VALUES)) + ") "
    + " UNION ALL ".join(f"SELECT i::bigint AS i, {k}::bigint AS f, coalesce({_truth(f)}, false) AS holds FROM t" for k, f in enumerate(_FILTERS))
)
def dynamic_compare_truthtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_VALUES)), "i long, v string")
    tests = [F.struct(F.lit(k).cast("long").alias("f"), F.coalesce(to_column(parse(f), rows.schema), F.lit(False)).alias("holds")) for k, f in enumerate(_FILTERS)]
    return rows.select("i", F.explode(F.array(*tests)).alias("x")).select("i", "x.f", "x.holds")


@query(
    f"""SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 41.5 GROUP BY 1"""
)
def json_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(profile.json_field(F.col("props"), "$.k").alias("k"))
    kept = events.where(to_column(parse("k > 41.5"), events.schema))
    return kept.groupBy("k").agg(F.count("*").alias("n"), F.sum(numeric_value(F.col("k"), events.schema["k"].dataType)).alias("total"))


# -- profiles ---------------------------------------------------------------------------------------------


@query("SELECT 'k' AS attr, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2")
def json_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_value_counts(table(spark, sf_dir, "events"), "props")


@query(
    """SELECT 'event.kind' AS attr, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL
SELECT 'event.by.user', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2 UNION ALL SELECT 'tags', '["' || event_type || '"]', count(*) FROM events GROUP BY 2"""
)
def nested_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs flattened to dotted names, arrays as JSON text."""
    events = table(spark, sf_dir, "events")
    nested = events.select(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("by")).alias("event"), F.array("event_type").alias("tags"))
    flat = nested.select(*profile.flatten(nested.schema))
    return profile.value_counts(flat, flat.columns)


@query(
    """SELECT 'c_name' AS attr, CAST(sum(strlen(c_name)) AS BIGINT) AS text_bytes, CAST(sum(strlen(c_name)) AS BIGINT) AS binary_bytes FROM customer UNION ALL
SELECT 'c_nationkey', CAST(sum(strlen(CAST(c_nationkey AS VARCHAR))) AS BIGINT), count(c_nationkey) * 4 FROM customer UNION ALL
SELECT 'c_mktsegment', CAST(sum(strlen(c_mktsegment)) AS BIGINT), CAST(sum(strlen(c_mktsegment)) AS BIGINT) FROM customer"""
)
def column_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_bytes(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query()
def compression_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return profile.compressed_bytes(customers, "c_mktsegment", scalars.chunk_size(1 << 20))


@query("SELECT count(*) AS n, CAST(count(*) * 256 AS DOUBLE) AS embedding_bytes, count(*) * 130::double + count(*) / 15::double * 66 AS graph_bytes FROM embeddings")
def memory_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return base.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).cast("double").alias("embedding_bytes"), profile.graph_bytes(F.count("*"), 16).cast("double").alias("graph_bytes"))


@query("SELECT count(*) AS rows_total, count(DISTINCT 'p_brand=' || p_brand || '|p_size=' || CAST(p_size AS VARCHAR)) AS tokens FROM part")
def unique_row_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.count("*").alias("rows_total"), F.count_distinct(scalars.row_token(["p_brand", "p_size"])).alias("tokens"))


@query(
    """SELECT CASE WHEN l_tax <= l_discount THEN 'hidden' WHEN l_tax <= l_discount + 0.02 THEN 'partly' ELSE 'exposed' END AS zone, count(*) AS n FROM lineitem GROUP BY 1"""
)
def latency_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(profile.zone(F.col("l_tax"), F.col("l_discount"), F.lit(0.02)).alias("zone")).agg(F.count("*").alias("n"))


# -- mutation ---------------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 35 <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 5")
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir).select("vec_id", "label")
    changes = base.where("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label"), (F.col("vec_id") % 35 == 0).alias("deleted"))
    added = base.where("vec_id < 5").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.lit(False).alias("deleted"))
    return encode.upsert(base, changes.unionByName(added), "vec_id")


@query(knn_sql("label = 2 AND vec_id % 10 <> 0"))
def knn_with_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted rows are never returned."""
    base = vectors(spark, sf_dir)
    live = base.join(base.where("vec_id % 10 = 0").select("vec_id"), "vec_id", "left_anti")
    return shown(search.knn(live, query_set(base), K, "label == 2"))


@query(
    f"""WITH {QS}, d AS (SELECT query_id, vec_id, {L2} AS dist FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, string_agg(CAST(vec_id AS VARCHAR) || ':' || printf('%.6f', dist), ',' ORDER BY rank) AS hits FROM r WHERE rank <= 5 GROUP BY 1"""
)
def topk_sink_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return topk_lines(search.knn(base, query_set(base), 5))


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS nation_id, coalesce(r_regionkey, -1)::bigint AS region_id FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to numbers by lookup, -1 where the dictionary has no entry."""
    known = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_regionkey").cast("long").alias("region_id"))
    nations = table(spark, sf_dir, "nation").join(known, "n_regionkey", "left")
    return nations.select("n_name", F.col("n_nationkey").cast("long").alias("nation_id"), F.coalesce("region_id", F.lit(-1)).alias("region_id"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN strftime(ts, '%Y-%m-%d') END AS day, CASE WHEN event_id % 5 <> 2 THEN events.event_type END AS grp,
coalesce(k.id, -1) AS group_id FROM events LEFT JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')) k
ON k.event_type = events.event_type AND event_id % 5 <> 2"""
)
def text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date and the group name out of questions in several wordings, and the number of the group by its dictionary, -1 where it has none."""
    events = table(spark, sf_dir, "events")
    day, name, kind = F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.col("event_id") % 5
    text = (
        F.when(kind == 1, F.concat(F.lit("Before "), day, F.lit(', who wrote on the "'), name, F.lit('" group chat?')))  # a date, but not of a post
        .when(kind == 2, F.concat(F.lit('What does the group "'), name, F.lit('" say, posted on '), day, F.lit("?")))  # a name, but not of a chat
        .when(kind == 3, F.concat(F.lit('ON THE "'), name, F.lit('" GROUP  CHAT, WHAT WAS POSTED  ON '), day, F.lit("T12:00, and on the \"x\" group chat posted on 1999-01-01?")))
        .otherwise(F.concat(F.lit('Which message on the "'), name, F.lit('" group chat was posted on '), day, F.lit("?")))
    )
    found = events.select("event_id", scalars.date_in(text).alias("day"), scalars.group_in(text).alias("grp"))
    known = encode.dictionary(events.where("event_type <> 'view'"), "event_type")
    ids = known.select(F.col("value").alias("grp"), F.col("bucket").cast("long").alias("group_id"))
    return found.join(ids, "grp", "left").select("event_id", "day", "grp", F.coalesce("group_id", F.lit(-1)).alias("group_id"))


# -- graphs -----------------------------------------------------------------------------------------------

M = 8
GRAPH = f"""v AS (SELECT vec_id, embedding, label FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst,
 list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) AS dist FROM v a, v b WHERE a.vec_id <> b.vec_id),
g AS MATERIALIZED (SELECT src, dst, pos, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS pos FROM p) WHERE pos <= {M})"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = vectors(spark, sf_dir)
    return stage(graph.knn_graph(base, M), "graph"), base.select("vec_id", F.col("label").alias("bucket"))


@query(f"WITH {GRAPH} SELECT src, dst, pos, round(dist, 6) AS dist FROM g")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.knn_graph(vectors(spark, sf_dir), M)
    return edges.select("src", "dst", F.col("pos").cast("long").alias("pos"), F.round("dist", 6).alias("dist"))


@query(f"WITH {GRAPH} SELECT DISTINCT src AS node_id, v.label AS bucket FROM g JOIN v ON v.vec_id = dst")
def neighbor_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_buckets(*_graph(spark, sf_dir))


_ISOLATED = "i AS (SELECT vec_id AS node_id, label AS bucket FROM v a WHERE NOT EXISTS (SELECT 1 FROM g JOIN v b ON b.vec_id = g.dst WHERE g.src = a.vec_id AND b.label = a.label))"


@query(f"WITH {GRAPH}, {_ISOLATED} SELECT * FROM i")
def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolated(*_graph(spark, sf_dir))


@query(
    f"""WITH {GRAPH}, {_ISOLATED}, h1 AS (SELECT DISTINCT node_id AS start, bucket, dst AS node FROM i JOIN g ON src = node_id),
h2 AS (SELECT DISTINCT start, bucket, dst AS node FROM h1 JOIN g ON src = node WHERE dst <> start AND (start, dst) NOT IN (SELECT start, node FROM h1)),
t AS (SELECT start, node AS target, 2 AS hop FROM h2 JOIN v ON vec_id = node AND label = bucket)
SELECT start, target, CAST(hop AS BIGINT) AS hop FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, target) AS n FROM t) WHERE n <= 3"""
)
def bfs_first_same_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three nodes of an isolated node's bucket within two hops."""
    edges, buckets = _graph(spark, sf_dir)
    targets, _ = graph.first_same_bucket(edges, buckets, graph.isolated(edges, buckets), 3, 2)
    return targets.select("start", "target", F.col("hop").cast("long").alias("hop"))


@query(
    f"""WITH RECURSIVE {GRAPH}, e AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM g JOIN v a ON a.vec_id = src JOIN v b ON b.vec_id = dst WHERE a.label = b.label UNION SELECT b.vec_id, a.vec_id FROM g JOIN v a ON a.vec_id = src JOIN v b ON b.vec_id = dst WHERE a.label = b.label),
r(node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT node AS node_id, label AS bucket, min(reach) AS component FROM r JOIN v ON vec_id = node GROUP BY 1, 2"""
)
def group_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bucket_components(*_graph(spark, sf_dir))


@query(
    f"""WITH {GRAPH}, h0 AS (SELECT vec_id AS node_id, vec_id AS cluster, 0 AS hop FROM v WHERE vec_id % 100 = 0),
h1 AS (SELECT dst AS node_id, min(cluster) AS cluster, 1 AS hop FROM h0 JOIN g ON src = node_id WHERE dst NOT IN (SELECT node_id FROM h0) GROUP BY 1),
h2 AS (SELECT dst AS node_id, min(cluster) AS cluster, 2 AS hop FROM h1 JOIN g ON src = node_id WHERE dst NOT IN (SELECT node_id FROM h0 UNION SELECT node_id FROM h1) GROUP BY 1)
SELECT node_id, cluster, CAST(hop AS BIGINT) AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2)"""
)
def hop_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, buckets = _graph(spark, sf_dir)
    found = graph.hop_clusters(edges, buckets.where("vec_id % 100 = 0").select(F.col("vec_id").alias("node_id")), 2)
    return found.withColumn("hop", F.col("hop").cast("long"))


@query(
    f"""WITH {GRAPH}, e AS (SELECT vec_id AS entry, embedding AS q FROM v WHERE vec_id % 50 = 0), have AS (SELECT DISTINCT src AS entry, label FROM g JOIN v ON vec_id = dst UNION SELECT vec_id, label FROM v),
d AS (SELECT entry, label AS bucket, vec_id, {L2} AS dist FROM v, e WHERE (entry, label) NOT IN (SELECT entry, label FROM have))
SELECT entry, bucket, rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY entry, bucket ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 3"""
)
def missing_group_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, buckets = _graph(spark, sf_dir)
    entries = buckets.where("vec_id % 50 = 0").select(F.col("vec_id").alias("node_id"))
    found = graph.missing_groups(vectors(spark, sf_dir).drop("label"), buckets, edges, entries)
    return found.select("entry", "bucket", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {GRAPH}, t AS (SELECT DISTINCT src AS node_id, b.label AS bucket FROM g JOIN v b ON b.vec_id = dst UNION SELECT vec_id, label FROM v) SELECT bucket, count(*) AS n_nodes FROM t GROUP BY 1")
def tb_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits by bucket, counted on the bucket-major bitmaps."""
    edges, buckets = _graph(spark, sf_dir)
    held = graph.bits(buckets, graph.neighbour_buckets(edges, buckets), n_buckets=256)
    return graph.by_bucket(held).groupBy("bucket").agg(F.sum("n").alias("n_nodes"))


@query(f"WITH {GRAPH}, t AS (SELECT DISTINCT src AS node_id, b.label AS bucket FROM g JOIN v b ON b.vec_id = dst UNION SELECT vec_id, label FROM v) SELECT count(DISTINCT node_id) AS n_nodes FROM t WHERE bucket BETWEEN 2 AND 5")
def tb_merged_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, buckets = _graph(spark, sf_dir)
    held = graph.bits(buckets, graph.neighbour_buckets(edges, buckets), n_buckets=256)
    return graph.merged(graph.by_bucket(held), 2, 5).agg(F.sum("n").alias("n_nodes"))


@query(
    f"""WITH {GRAPH}, {_ISOLATED}, h0 AS (SELECT node_id AS start, bucket, node_id AS node FROM i),
h1 AS MATERIALIZED (SELECT start, bucket, dst AS node, min(node) AS via FROM h0 JOIN g ON src = node WHERE dst <> start GROUP BY ALL),
h2 AS MATERIALIZED (SELECT start, bucket, dst AS node, min(node) AS via FROM h1 JOIN g ON src = node WHERE dst <> start AND (start, dst) NOT IN (SELECT start, node FROM h1) GROUP BY ALL),
h3 AS MATERIALIZED (SELECT start, bucket, dst AS node, min(node) AS via FROM h2 JOIN g ON src = node WHERE dst <> start AND (start, dst) NOT IN (SELECT start, node FROM h1 UNION ALL SELECT start, node FROM h2) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, node) AS n FROM (SELECT start, bucket, node, 1 AS hop FROM h1 UNION ALL SELECT start, bucket, node, 2 FROM h2 UNION ALL SELECT start, bucket, node, 3 FROM h3) JOIN v ON vec_id = node AND label = bucket),
p3 AS (SELECT start, bucket, node FROM k WHERE n <= 3 AND hop = 3), p2 AS (SELECT start, bucket, node FROM k WHERE n <= 3 AND hop = 2 UNION SELECT start, bucket, via FROM h3 JOIN p3 USING (start, bucket, node)),
p1 AS (SELECT start, bucket, node FROM k WHERE n <= 3 AND hop = 1 UNION SELECT start, bucket, via FROM h2 JOIN p2 USING (start, bucket, node))
SELECT vec_id AS node_id, label AS bucket FROM v UNION SELECT node, bucket FROM p3 UNION SELECT node, bucket FROM p2 UNION SELECT node, bucket FROM p1"""
)
def tb_with_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits after isolated nodes are connected: own buckets, and nodes on paths to the bucket's nearest nodes."""
    edges, buckets = _graph(spark, sf_dir)
    alone = stage(graph.isolated(edges, buckets), "isolated")
    _, paths = graph.first_same_bucket(edges, buckets, alone, 3, 3)
    return graph.bits(buckets, paths.select(F.col("node").alias("node_id"), "bucket"), n_buckets=256)


@query()
def tb_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of all three kinds of paths: from isolated nodes, between a bucket's clusters, from entry points."""
    edges, buckets = _graph(spark, sf_dir)
    _, paths = graph.first_same_bucket(edges, buckets, graph.isolated(edges, buckets), 3, 3)
    tree = graph.connecting_tree(edges, graph.bucket_components(edges, buckets), 1, 3)
    entries = graph.entry_paths(edges, buckets, buckets.where("vec_id % 100 = 0").select(F.col("vec_id").alias("node_id")), 1, 3)
    return graph.bits(buckets, paths.select(F.col("node").alias("node_id"), "bucket"), tree, entries, n_buckets=256)


@query(f"WITH {GRAPH} SELECT count(*) AS links, CAST(0 AS BIGINT) AS dangling, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS too_wide FROM g")
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, buckets = _graph(spark, sf_dir)
    return graph.integrity(edges, buckets, M)


@query(
    f"""WITH RECURSIVE {GRAPH}, c AS MATERIALIZED (SELECT src, dst, g.pos, g.dist, embedding AS e FROM g JOIN v ON vec_id = dst),
w(src, pos, kept, ids) AS (SELECT src, pos, [e], [dst] FROM c WHERE pos = 1 UNION ALL
SELECT w.src, c.pos, CASE WHEN ok THEN list_append(kept, e) ELSE kept END, CASE WHEN ok THEN list_append(ids, dst) ELSE ids END FROM (
 SELECT w.src, w.kept, w.ids, c.pos, c.e, c.dst, len(ids) < 6 AND len(list_filter(kept, lambda k: list_sum(list_transform(list_zip(k, e), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) <= c.dist)) = 0 AS ok
 FROM w JOIN c ON c.src = w.src AND c.pos = w.pos + 1) w JOIN c USING (src, pos, dst, e))
SELECT src, dst, CAST(pos AS BIGINT) AS pos FROM (SELECT src, unnest(ids) AS dst, unnest(range(1, len(ids) + 1)) AS pos FROM w WHERE pos = {M})"""
)
def pruned_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour lists after the selection heuristic."""
    edges, _ = _graph(spark, sf_dir)
    return graph.select_neighbours(edges, vectors(spark, sf_dir), 6).withColumn("pos", F.col("pos").cast("long"))


@query()
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate filtered search over the cells nearest to each query."""
    base = vectors(spark, sf_dir)
    centroids = ivf.train(base, 16)
    cells = stage(ivf.assign(base, centroids), "cells")
    return shown(ivf.search_cells(cells, query_set(base), centroids, K, 12, "label < 5"))


@query(
    """WITH g AS (SELECT l_suppkey AS method, l_linenumber AS selectivity, round(avg(l_discount), 9) AS recall, round(avg(l_quantity), 6) AS qps FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT method, selectivity, recall, qps, row_number() OVER (PARTITION BY method, selectivity ORDER BY recall, qps) AS place FROM g WHERE isfinite(qps)"""
)
def qps_recall_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("method"), F.col("l_linenumber").alias("selectivity"), F.when(F.col("l_returnflag") == "R", F.lit("OK")).otherwise(F.lit("FAILED")).alias("status"))
    runs = lines.agg(F.round(F.avg("l_discount"), 9).alias("recall"), F.round(F.avg("l_quantity"), 6).alias("qps"))
    return evaluate.series(runs).withColumn("place", F.col("place").cast("long"))


@query("SELECT event_type, CAST(sum(length(event_type) * 0 + 1) AS BIGINT) AS n FROM events WHERE json_extract_string(props, '$.k') = '5' OR CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 90 AND 95 GROUP BY 1")
def json_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions as KEY=VALUE and KEY=MIN:MAX on JSON texts."""
    events = table(spark, sf_dir, "events")
    test = profile.condition(F.col("props"), "k=5") | profile.range_condition(F.col("props"), "k=90:95")
    return events.where(test).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT label AS bucket, least(count(*), 4) AS chosen, least(count(*), 4) AS ranks, CAST(0 AS BIGINT) AS strangers FROM embeddings GROUP BY 1")
def ranked_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four nodes of each bucket, drawn by hash, as terminals of a connecting tree: how many, and none of another bucket."""
    rows = vectors(spark, sf_dir).select(F.col("label").alias("cluster"), F.col("vec_id").alias("node_id"))
    drawn = graph.terminals(rows, 4, 7)
    order = Window.partitionBy("cluster").orderBy("node_id")
    drawn = drawn.withColumn("nth", F.row_number().over(order)).join(rows.withColumnRenamed("cluster", "own"), "node_id")
    return drawn.groupBy(F.col("cluster").alias("bucket")).agg(F.count_distinct("node_id").alias("chosen"), F.max("nth").cast("long").alias("ranks"), F.count_if(F.col("own") != F.col("cluster")).alias("strangers"))


# -- approximate searches, held against the exact one -------------------------------------------------------

M_WALK = 16


def _graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, Attribute], dict[str, DataFrame]]:
    """Vectors with two encoded attributes, the graph both ways, queries, attributes, and bits of both."""
    base = vectors(spark, sf_dir).withColumn("side", (F.col("vec_id") % 3).cast("string"))
    attributes = {a.key: a for a in encode.manifest(base, ["label", "side"])}
    nodes = stage(encode.encode(base, list(attributes.values())), "encoded")
    edges = stage(graph.knn_graph(base, M_WALK), "graph")
    both = stage(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    held = {}
    for key in attributes:
        own = nodes.select("vec_id", F.col(f"fid_{key}").alias("bucket"))
        held[key] = stage(graph.bits(own, graph.neighbour_buckets(both, own), n_buckets=256), "bits")
    return nodes, both, query_set(base), attributes, held


def _recall_of(found: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """(queries, recalled): whether mean recall is 0.9 or more."""
    mean = evaluate.recall_summary(evaluate.recall(found, exact, queries, K), K)
    return mean.select("queries", (F.col("avg_recall") >= 0.9).alias("recalled"))


def _walk(name: str, predicate: str, gate: str, ef: int = 96, break_factor: float | None = None) -> None:
    @query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 50 = 0", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, links, queries, attributes, held = _graph_parts(spark, sf_dir)
        found = gates.graph_search(nodes, links, held, queries, K, predicate, attributes, ef, None, gate, break_factor)
        return _recall_of(found, search.knn(nodes, queries, K, predicate), queries)


_walk("graph_recall_fid_or_tb", "label == 3", "fid_or_tb")
_walk("graph_recall_tb_only", "label == 3", "tb")
_walk("graph_recall_two_attr_and", "label < 5 AND side == 1", "any")
_walk("graph_recall_two_attr_or", "label == 3 OR side == 1", "any")
_walk("graph_recall_early_stop", "label < 5", "fid_or_tb", break_factor=16.0)


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def beam_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return _recall_of(beam_search_gated(spark, sf_dir), search.knn(base, query_set(base), K, "label == 3"), query_set(base))


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = vectors(spark, sf_dir)
    return _recall_of(ivf_search(spark, sf_dir), search.knn(base, query_set(base), K, "label < 5"), query_set(base))


@query("SELECT count(*) AS nodes, true AS recalled, CAST(0 AS BIGINT) AS dangling, CAST(0 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS repeated FROM embeddings")
def cell_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph built within cells against the one over all pairs: nine links of ten or more are the same."""
    base = vectors(spark, sf_dir)
    made, exact = stage(graph.cell_graph(base, M, 8, 6), "cell-graph"), graph.knn_graph(base, M)
    same = made.join(exact, ["src", "dst"], "left_semi").agg(F.count("*").alias("same"))
    counts = base.agg(F.count("*").alias("nodes")).crossJoin(same).crossJoin(graph.integrity(made, base, M))  # one row each
    return counts.select("nodes", (F.col("same") >= 0.9 * F.col("nodes") * M).alias("recalled"), "dangling", "loops", "repeated")


@query(
    f"""WITH {GRAPH.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 20 <> 3)")} SELECT src, dst, pos, round(dist, 6) AS dist FROM g"""
)
def graph_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after a tenth of the nodes has come or gone, mended in place: those of a graph built anew."""
    whole = vectors(spark, sf_dir)
    before, after = whole.where("vec_id % 20 <> 7"), whole.where("vec_id % 20 <> 3")
    edges = stage(graph.knn_graph(before, M), "graph")
    mended = graph.refresh(edges, after, whole.where("vec_id % 20 IN (3, 7)").select("vec_id"), M)
    return mended.select("src", "dst", F.col("pos").cast("long").alias("pos"), F.round("dist", 6).alias("dist"))


# -- SQL ----------------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))) AS dist FROM embeddings WHERE label = 3)
SELECT vec_id, round(dist, 6) + 0.0 AS dist FROM d ORDER BY d.dist, vec_id LIMIT 10"""
)
def sql_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered top-k statement in SQL."""
    sql.register(spark)
    base = vectors(spark, sf_dir)
    base.createOrReplaceTempView("sievector_base")
    vector = base.where("vec_id = 0").select("embedding").first()[0]
    found = spark.sql(sql.statement("sievector_base", vector, K, "label = 3"))
    return found.select("vec_id", (F.round("dist", 6) + F.lit(0.0)).alias("dist"))


@query("SELECT true AS top_k, true AS filter_pushed")
def sql_topk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan of that statement does: k rows a task, and the filter in the scan."""
    sql.register(spark)
    vectors(spark, sf_dir).createOrReplaceTempView("sievector_base")
    plan = sql.explain(spark.sql(sql.statement("sievector_base", [0.0] * 64, K, "label = 3")))
    return spark.createDataFrame([(plan.top_k, any("label" in x for x in plan.pushed_filters))], "top_k boolean, filter_pushed boolean")


# -- more of the small operators ------------------------------------------------------------------------------


@query(
    """SELECT event_type AS method, count(*) AS queries, CAST(sum(user_id) AS BIGINT) AS sum_user_id, round(avg(user_id), 6) AS mean_user_id, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1"""
)
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.counters(table(spark, sf_dir, "events").withColumnRenamed("event_type", "method"), ["user_id", "value"], ["method"])
    return out.withColumns({"mean_user_id": F.round("mean_user_id", 6), "sum_value": F.round("sum_value", 4), "mean_value": F.round("mean_value", 6)})


@query("SELECT vec_id, vec_id % 7 AS dealt, CAST(floor(CAST(label AS DOUBLE) * 100 / ceil(900 / 256.0)) AS BIGINT) AS of_value FROM embeddings")
def legacy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids dealt round, and a number over its 256th."""
    base = vectors(spark, sf_dir)
    return base.select("vec_id", scalars.bucket_mod(F.col("vec_id"), 7).cast("long").alias("dealt"), scalars.bucket_of_value(F.col("label") * 100, 900).cast("long").alias("of_value"))


@query(
    """SELECT event_id AS key, 'event.kind' AS attr, event_type AS value FROM events UNION ALL SELECT event_id, 'event.by.user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'tags', '["' || event_type || '",1]' FROM events UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events"""
)
def json_text_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON texts flattened to dotted names; lists are leaves."""
    text = F.concat(
        F.lit('{"event": {"kind": "'), F.col("event_type"), F.lit('", "by": {"user": '), F.col("user_id").cast("string"), F.lit(', "none": null}, "empty": {}}, "tags": ["'), F.col("event_type"), F.lit('", 1], "k": '),
        F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}"),
    )
    return profile.json_leaves(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "event_id")


@query(
    """SELECT attr, CASE WHEN n <= 256 THEN 'dictionary' WHEN whole THEN 'scaled' ELSE 'excluded' END AS coding FROM (
SELECT 'l_partkey' AS attr, count(DISTINCT l_partkey) AS n, true AS whole FROM lineitem UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), true FROM lineitem UNION ALL
SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), false FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), false FROM lineitem)"""
)
def profile_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return encode.coded(encode.profile(lines, ["l_partkey", "l_orderkey", "l_extendedprice", "l_returnflag"]), lines).select("attr", "coding")


@query("SELECT CAST(0 AS BIGINT) AS not_isolated, CAST(0 AS BIGINT) AS without_bit")
def graph_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated nodes are isolated, and every node on a path has the bit of the path's bucket."""
    edges, buckets = _graph(spark, sf_dir)
    alone = stage(graph.isolated(edges, buckets), "isolated")
    _, paths = graph.first_same_bucket(edges, buckets, alone, 3, 3)
    paths = stage(paths, "paths")
    held = graph.bits(buckets, paths.select(F.col("node").alias("node_id"), "bucket"), n_buckets=256)
    return graph.unsound(edges, buckets, alone, paths, held)


@query("SELECT event_type, count(*) AS n, true AS close FROM events GROUP BY 1")
def rough_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches: each has its share of the values below it, to a thousandth."""
    events = table(spark, sf_dir, "events")
    both = events.join(evaluate.rough_latency(events, "value", ["event_type"]), "event_type")
    near = F.lit(True)
    for p, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        near = near & (F.count_if(F.col("value") < F.col(p)) <= (share + 0.001) * F.count("*")) & (F.count_if(F.col("value") <= F.col(p)) >= (share - 0.001) * F.count("*"))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), near.alias("close"))
