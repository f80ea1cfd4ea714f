"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its pairs of neighbouring words (the last word stands alone), weighted by how often
they occur.  For each coordinate a term draws r and c from Gamma(2, 1) and b from U(0, 1), all from one
hash of (term, coordinate); with t = floor(ln(weight) / r + b) the least ln(c) - r * (t - b + 1) is the
sample.  Two texts agree in a coordinate with the probability of their generalised Jaccard similarity,
sum of lesser weights over sum of greater ones.

Defined cases: a very long text is one row whose terms are all sampled; a null or wordless text has no terms, and such texts are alike (1) and unlike all others
(0); rows that repeat a document's id and text are one document in the order and each get its result;
equal ids are ordered by a hash of the text, null ids come first; one document alone is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievector.llm.rules import bound, words_of
from sievector.plans.staging import stage

COORDINATES = 32


def weighted_terms(text: Column) -> Column:
    """array<struct<term, weight>> of a text: hashes are sorted, and a run's length is its weight."""

    def runs(h: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: ~F.get(h, i).eqNullSafe(F.get(h, i + 1)))
        body = lambda e: F.transform(e, lambda x, j: F.struct(F.get(h, x).alias("term"), (x - F.coalesce(F.get(e, j - 1), F.lit(-1))).alias("weight")))
        return F.when(F.size(h) > 0, bound(ends, body))

    hashes = bound(words_of(text), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
    return bound(F.sort_array(hashes), runs)


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The logarithm whose least value over all terms is coordinate ``k``."""
    z = F.xxhash64(term, F.lit(k))

    def uniform(bit: int, bits: int) -> Column:
        part = F.shiftrightunsigned(z, bit).bitwiseAND(F.lit((1 << bits) - 1))
        return (part.cast("double") + F.lit(0.5)) * F.lit(1.0 / (1 << bits))

    r = -F.log(uniform(0, 13) * uniform(13, 13))
    log_c = F.log(-F.log(uniform(26, 13) * uniform(39, 13)))
    b = uniform(52, 12)
    t = F.floor(log_weight / r + b)
    return log_c - r * (t.cast("double") - b + F.lit(1.0))


def signatures(texts: DataFrame, keys: list[str], text: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """``keys`` and ``signature``, an array of 32-bit marks; texts without terms have null marks.

    A text's terms stay in its task: they are reduced to one row before the shuffle.
    """
    terms = texts.select(*keys, F.explode_outer(weighted_terms(F.col(text))).alias("x")).select(*keys, "x.term", F.log(F.col("x.weight").cast("double")).alias("log_weight"))
    least = terms.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(coordinates)])
    marks = [F.when(F.col(f"s{k}").isNotNull(), F.hash(F.col(f"s{k}"))) for k in range(coordinates)]
    return least.select(*keys, F.array(*marks).alias("signature"))


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits a coordinate; empty without terms."""
    digits = F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of coordinates in which two signatures agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return same.cast("double") / F.size(a).cast("double")


def in_order(keyed: DataFrame) -> DataFrame:
    """Each distinct (doc_id, a, b, n_chars) with ``next_a`` and ``next_b`` of the next one in ascending order.

    Only ids and hashes are sorted.  Rows are numbered within range partitions; the first and last
    number of each partition, one row a partition, link the partitions into a ring.
    """
    spark = keyed.sparkSession
    ids = keyed.select("doc_id", "a", "b", "n_chars").distinct()
    ranged = ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "b").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "b")
    rows = stage(ranged.withColumn("rid", F.monotonically_increasing_id()), "order")
    ends = sorted(tuple(r) for r in rows.groupBy(F.shiftright("rid", 33)).agg(F.min("rid"), F.max("rid")).collect())
    if not ends:
        return rows.selectExpr("doc_id", "a", "b", "n_chars", "a next_a", "b next_b")
    pairs = [(last, ends[(i + 1) % len(ends)][1]) for i, (_, _, last) in enumerate(ends)]
    jumps = F.broadcast(spark.createDataFrame(pairs, "rid long, jump long"))
    linked = rows.join(jumps, "rid", "left").withColumn("next_rid", F.coalesce("jump", F.col("rid") + 1)).drop("jump")
    other = rows.select(F.col("rid").alias("next_rid"), F.col("a").alias("next_a"), F.col("b").alias("next_b"))
    return stage(linked.join(other, "next_rid").select("doc_id", "a", "b", "n_chars", "next_a", "next_b"), "neighbours")


def fingerprint(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likenesses.

    The edited text has its last quarter replaced by as many first characters of the next document.
    Documents go by two hashes, ``a`` of the id and ``b`` of the text.  Both joins on texts read the same
    columns by the same keys, so texts are shuffled once.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("b"), F.length("text").cast("long").alias("n_chars"), "text")
    order = in_order(keyed)
    body = keyed.select("a", "b", "text")

    # The start that each document lends to the one before it: a quarter of that one's length.
    lent = order.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), "n_chars")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    starts = body.join(lent, ["a", "b"]).select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), "n_chars", F.left(F.col("text"), quarter).alias("start"))
    starts = starts.groupBy("a", "b").agg(F.max("n_chars").alias("n_chars"), F.max("start").alias("start"))
    both = body.join(starts, ["a", "b"]).select("a", "b", "text", F.concat(F.left(F.col("text"), (F.col("n_chars") - quarter).cast("int")), "start").alias("edited"))
    own = F.struct(F.lit(0).alias("side"), F.lit("").alias("sha"), F.col("text"))
    changed = F.struct(F.lit(1).alias("side"), F.sha2("edited", 256).alias("sha"), F.col("edited").alias("text"))
    sides = both.select("a", "b", F.explode(F.array(own, changed)).alias("x")).select("a", "b", "x.*")
    signed = stage(signatures(sides, ["a", "b", "side", "sha"], coordinates=coordinates), "signatures")

    own = signed.where("side = 0").select("a", "b", F.col("signature").alias("own"))
    edited = signed.where("side = 1").select("a", "b", F.col("sha").alias("edited_sha256"), F.col("signature").alias("edited"))
    after = own.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("own").alias("after"))
    pairs = order.select("a", "b", "next_a", "next_b").join(after, ["next_a", "next_b"]).select("a", "b", "after")
    known = own.join(edited, ["a", "b"]).join(pairs, ["a", "b"])
    known = known.select("a", "b", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
    return keyed.select("doc_id", "a", "b", "n_chars").join(known, ["a", "b"]).drop("a", "b")
