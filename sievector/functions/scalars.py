"""Scalar helpers: bucket arithmetic, hashes, binning, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_ceil(id_: Column, n: int, buckets: int) -> Column:
    """Blocks of ceil(n / buckets) ids; the last block is short."""
    return F.least(F.floor(id_ / F.lit(-(-n // buckets))), F.lit(buckets - 1)).cast("int")


def bucket_floor(id_: Column, n: int, buckets: int) -> Column:
    """Blocks of floor(n / buckets) ids; the last block takes the remainder."""
    return F.least(F.floor(id_ / F.lit(max(1, n // buckets))), F.lit(buckets - 1)).cast("int")


def bucket_scaled(id_: Column, n: int, buckets: int) -> Column:
    """floor(id * buckets / n)."""
    return F.floor(id_ * F.lit(buckets) / F.lit(n)).cast("int")


def bucket_mod(id_: Column, buckets: int) -> Column:
    """Ids dealt round: id mod buckets."""
    return F.pmod(id_, F.lit(buckets)).cast("int")


def bucket_of_value(value: Column, highest: float) -> Column:
    """A number over ceil(highest / 256), cut to a whole number."""
    return F.try_divide(value.cast("double"), F.ceil(F.lit(float(highest)) / F.lit(256.0))).cast("int")


def clean_value(text: Column) -> Column:
    """A text without the white space around it, and without one pair of equal quotes around that."""
    bare = F.trim(text)
    quoted = (F.length(bare) >= 2) & F.substring(bare, 1, 1).isin("'", '"') & (F.substring(bare, 1, 1) == F.right(bare, F.lit(1)))
    return F.when(quoted, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare)


def clean_key(text: Column) -> Column:
    """A key as part of a file name: everything but letters, digits, ``_``, ``-`` and ``.`` becomes ``_``."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def bucket_numeric(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bucket by truncation, clamped; 0 where the range is empty."""
    place = F.floor(F.try_divide(value - low, high - low) * F.lit(bins))
    return F.when(high > low, F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def pow2_bin(value: Column) -> Column:
    """The least power of two that is not below the value."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(value))).cast("long")


def block_hash(id_: Column, buckets: int) -> Column:
    """Multiplicative hash of an id."""
    return F.pmod(id_.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(10,0)"), F.lit(buckets)).cast("int")


def share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def row_token(columns: list[str], missing: str = "<missing>") -> Column:
    """``k=v`` of each column, joined by a bar; names in order."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(missing))) for c in sorted(columns)])


def date_in(text: Column) -> Column:
    """The first ISO date after the words "posted on", in any case, or null."""
    return F.nullif(F.regexp_extract(text, r"(?i)posted\s+on\s+(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def group_in(text: Column) -> Column:
    """The name in double quotes of the first: on the "name" group chat, in any case, or null."""
    return F.nullif(F.regexp_extract(text, r'(?i)on\s+the\s+"(.*?)"\s+group\s+chat\b', 1), F.lit(""))


def chunk_size(n_bytes: int) -> int:
    """The least power of two that is an eighth of the bytes or more, from 1 KB to 2 MB."""
    size = 1024
    while size < n_bytes / 8 and size < 2 << 20:
        size *= 2
    return size


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes, as a signed integer.

    The prime is 2 ** 40 + 435, so the product is a shift and a sum of halves that can't overflow."""
    pairs = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), r"(?<=\G..)"), lambda x: x != "")
    codes = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))
    word = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        mixed = h.bitwiseXOR(b)
        low, high = mixed.bitwiseAND(word), F.shiftrightunsigned(mixed, 32)
        upper = (high * 435 + F.shiftrightunsigned(low * 435, 32) + F.shiftleft(low, 8)).bitwiseAND(word)
        return F.shiftleft(upper, 32).bitwiseOR((low * 435).bitwiseAND(word))

    return F.aggregate(codes, F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long"), step)


def fill_bins(rows: DataFrame, size: str, value: str) -> DataFrame:
    """Missing values of a binned series by linear interpolation between the nearest present bins."""
    before, after = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(size).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(size).cast("double").alias("x"), F.col(value).alias("y")))
    ends = rows.withColumns({"__a": F.last(point, ignorenulls=True).over(before), "__b": F.first(point, ignorenulls=True).over(after)})
    slope = F.try_divide(F.col("__b.y") - F.col("__a.y"), F.col("__b.x") - F.col("__a.x"))
    made = F.coalesce(F.col(value), F.col("__a.y") + slope * (F.col(size) - F.col("__a.x")), F.col("__a.y"), F.col("__b.y"))
    return ends.withColumn(value, made).drop("__a", "__b")
