"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a hash of the key. A bucket whose bytes exceed the limit splits on the
next bit, and only such buckets split, until every shard fits. Bits 1 to 60 come from the key, bits 61 to 120 from the
row's own number, so that rows that share one key can still be split.

Defined results: a null size counts as 0 bytes and a null key as the empty string; repeated rows are placed one by
one; a single row larger than the limit gets a shard of its own; an empty table gives an empty result; rows that agree
in all bits and do not fit one shard are an error, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.plans.materialize import materialize

BITS = 60
#: Bytes of text in a shard, at most.
LIMIT = 16 << 20


def _bits60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _prefix(depth: Column | int) -> Column:
    both = F.concat(F.lpad(F.bin("_b1"), BITS, "0"), F.lpad(F.bin("_b2"), BITS, "0"))
    return both.substr(F.lit(1), F.lit(depth))


def _leaves(rows: DataFrame, shallow: int, deep: int, limit: int) -> DataFrame:
    """For each cell of ``deep`` bits the shallowest depth, from ``shallow`` on, at which its bucket fits."""
    cells = rows.groupBy(_prefix(deep).alias("_cell")).agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"))
    paths = cells.select("*", F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth")).withColumn("shard", F.expr("substring(_cell, 1, depth)"))
    buckets = paths.groupBy("depth", "shard").agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"))
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    found = paths.select("_cell", "depth", "shard").join(fits, ["depth", "shard"])
    return found.groupBy("_cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("_leaf"))


def extendible_shards(df: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = LIMIT, spare_bits: int = 6, step: int = 12, carry: bool = False) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, shard (its bits as text), depth, shard_bytes, shard_rows.

    ``spare_bits``: how many bits the first directory is deeper than equal buckets would need. ``carry``: all columns of
    ``df`` come along as the struct ``row``.
    """
    size = F.octet_length("text") if size is None else size
    text_key = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    kept = [key, "n_bytes", *(["row"] if carry else [])]
    narrow = df.select(F.col(f"`{key}`").alias(key), F.coalesce(size, F.lit(0)).cast("long").alias("n_bytes"), *whole, _bits60(text_key).alias("_b1"), text_key.alias("_key"), F.monotonically_increasing_id().alias("_row"))
    # Written once: the row numbers that tell equal keys apart must not change between passes.
    rows = materialize(narrow.withColumn("_b2", _bits60(F.concat_ws("/", "_key", F.col("_row")))).drop("_row", "_key"), "shard-keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(BITS, max(1, -(-total // limit)).bit_length() + spare_bits)
    shallow, done = 0, []
    while True:
        placed = rows.withColumn("_cell", _prefix(deep)).join(_leaves(rows, shallow, deep, limit), "_cell", "left")
        out = placed.where(F.col("_leaf").isNotNull()).select(*kept, F.col("_leaf.shard").alias("shard"), F.col("_leaf.depth").alias("depth"), F.col("_leaf.shard_bytes").alias("shard_bytes"), F.col("_leaf.shard_rows").alias("shard_rows"))
        done.append(out)
        rest = placed.where(F.col("_leaf").isNull()).select(*rows.columns)
        if rest.isEmpty():
            break
        if deep >= 2 * BITS:
            raise RuntimeError(f"rows agree in all {2 * BITS} bits of their hashes and do not fit a shard of {limit} bytes")
        rows = materialize(rest, "shard-oversize")
        shallow, deep = deep + 1, min(2 * BITS, deep + step)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def write_shards(df: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> None:
    """Write ``df`` as one folder of Parquet files for each shard; keys may repeat or be null."""
    placed = extendible_shards(df, key, limit=limit, carry=True)
    name = "shard"
    while name in df.columns:
        name = "_" + name
    placed.select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
