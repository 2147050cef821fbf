"""Join, distinct, limit and window forms beyond the plain DataFrame calls."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.plans.materialize import materialize


def null_aware_anti(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left`` rows whose key is NOT IN the right keys, with SQL's three-valued logic.

    An empty right side keeps every row, a NULL among the right keys keeps none, and a NULL left key survives only an
    empty right side. Whether the right side is empty or has a NULL is one aggregate of one row; the rest is an
    ordinary anti join, so nothing of the right side is broadcast but that row.
    """
    keys = right.select(F.col(right_key).alias("_r"))
    facts = keys.agg(F.count("*").alias("_n"), F.coalesce(F.bool_or(F.col("_r").isNull()), F.lit(False)).alias("_null"))
    kept = left.join(keys, F.col(left_key) == F.col("_r"), "left_anti")
    checked = kept.join(F.broadcast(facts))  # one row
    return checked.where((F.col("_n") == 0) | (~F.col("_null") & F.col(left_key).isNotNull())).select(*left.columns)


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mark: str = "mark") -> DataFrame:
    """``left`` with ``mark``: TRUE, FALSE or NULL for left key IN (right keys)."""
    keys = right.select(F.col(right_key).alias("_r"))
    facts = keys.agg(F.count("*").alias("_n"), F.coalesce(F.bool_or(F.col("_r").isNull()), F.lit(False)).alias("_null"))
    found = keys.where(F.col("_r").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    joined = left.join(found, F.col(left_key) == F.col("_r"), "left").join(F.broadcast(facts))  # one row
    value = F.when(F.col("_n") == 0, F.lit(False)).when(F.col("_hit"), F.lit(True)).when(F.col("_null") | F.col(left_key).isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(mark, value).select(*left.columns, mark)


def scalar_subquery(outer: DataFrame, inner: DataFrame, keys: dict[str, str], value: Column, name: str, empty: Column | None = None) -> DataFrame:
    """A correlated scalar aggregate as a LEFT join to a grouped aggregate; ``empty`` replaces a missing group (COUNT: 0)."""
    grouped = inner.groupBy(*[F.col(i).alias(f"_k{n}") for n, i in enumerate(keys.values())]).agg(value.alias(name))
    on = [F.col(o) == F.col(f"_k{n}") for n, o in enumerate(keys)]
    joined = outer.join(grouped, on, "left")
    if empty is not None:
        joined = joined.withColumn(name, F.coalesce(F.col(name), empty))
    return joined.select(*outer.columns, name)


def distinct_on(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each key in the given order; NULL keys form one group.

    Spark plans a group limit below the shuffle for ``row_number() = 1``, so each task sends one row for a key.
    """
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def _sort_key(order: Column) -> tuple[Column, Column]:
    """(sort expression, its key): a plain column sorts ascending with NULLs last."""
    node = order._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return order.asc_nulls_last(), order
    return order, Column(SparkSession.active()._jvm.org.apache.spark.sql.Column(node.child()))


def limit_with_ties(df: DataFrame, n: int, order_by: list[Column]) -> DataFrame:
    """The first ``n`` rows and all that tie with the last, in any order of ``order_by`` (``asc``, ``desc``, NULLs).

    A top-n finds the keys; the rows with one of these keys are the answer, as every tie with an earlier row lies
    within the top n itself.
    """
    orders = [_sort_key(o) for o in order_by]
    keyed = df.withColumns({f"_key{k}": key for k, (_, key) in enumerate(orders)})
    names = [f"_key{k}" for k in range(len(orders))]
    top = keyed.orderBy(*[o for o, _ in orders]).limit(n).select(*[F.col(k).alias(f"_top{k}") for k in names]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_top{k}")) for k in names]
    return keyed.join(top, same, "left_semi").drop(*names)


def table_sample(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """TABLESAMPLE BERNOULLI (percent) [REPEATABLE (seed)]: each row with the same chance, decided in its own task."""
    if not 0 <= percent <= 100:
        raise ValueError("sample percentage must be between 0 and 100")
    return df.where(F.rand(seed) < percent / 100) if percent < 100 else df


def groups_frame(df: DataFrame, partition_by: list[str], order_by: Column, before: int, after: int, aggregates: dict[str, Column]) -> DataFrame:
    """GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a RANGE frame over the dense rank of the peers."""
    ranked = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition_by).orderBy(order_by)))
    frame = Window.partitionBy(*partition_by).orderBy("_peer").rangeBetween(-before, after)
    return ranked.select(*df.columns, *[e.over(frame).alias(n) for n, e in aggregates.items()])


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """``low <= point <= high`` over integral columns as an equi-join on bins of ``width``, checked exactly.

    Right rows are copied to each bin they touch; choose ``width`` near the typical interval length.
    """
    binned_left = left.withColumn("_bin", F.floor(F.col(point) / width))
    binned_right = right.withColumn("_rbin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    on = (F.col("_bin") == F.col("_rbin")) & (F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))
    return binned_left.join(binned_right, on, how).drop("_bin", "_rbin")


#: Rows of a block of a join by blocks, about; pairs that a task of it compares, about.
BLOCK, PAIRS = 2048, 1 << 24


def pairs_within(df: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """All pairs of values ``a < b`` of rows with equal ``keys``, of which none is NULL, as two columns.

    The rows of a group are dealt to blocks by a hash of the value, and each two blocks meet in a unit of their own, so
    a large group is the work of many tasks. Two blocks meet once: which value comes first is decided by the pair.
    """
    known = [f"_k{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, known, strict=True)], F.col(value).alias("_v"))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns))
    sizes = rows.groupBy(*known).agg(F.count("*").alias("_n"))
    work = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    parts = 1 + int(work // PAIRS)
    blocks = sizes.select(*known, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_s"))
    dealt = rows.join(blocks, known).withColumn("_i", F.pmod(F.xxhash64("_v"), F.col("_s")).cast("int")).repartition(parts, *known, "_i")
    unit = [*known, "_lo", "_hi"]
    left = dealt.select(*known, F.col("_v").alias("_a"), F.col("_i").alias("_lo"), F.explode(F.expr("sequence(_i, _s - 1)")).alias("_hi"))
    right = dealt.select(*known, F.col("_v").alias("_b"), F.explode(F.expr("sequence(0, _i)")).alias("_lo"), F.col("_i").alias("_hi"))
    met = left.repartition(parts, *unit).hint("merge").join(right.repartition(parts, *unit), unit).where("_lo < _hi OR _a < _b")
    return met.select(F.least("_a", "_b").alias(names[0]), F.greatest("_a", "_b").alias(names[1]))


def range_of(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by halving."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(value >= F.lit(bounds[middle]), range_of(value, bounds[middle + 1 :], first + middle + 1)).otherwise(range_of(value, bounds[:middle], first))


#: Ranges that quantiles make, at most; what they leave too large is dealt further by a hash.
RANGES = 1024


def _quantiles(df: DataFrame, column: str, block: int | None = None) -> tuple[int, list]:
    """(rows, ascending quantiles of a numeric column, as many as blocks of rows)."""
    n, found = df.agg(F.count("*"), F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)])).first()
    step = -(-RANGES // max(1, min(RANGES, -(-n // (block or BLOCK)))))
    return n, (found or [])[step - 1 :: step]


def less_join(left: DataFrame, right: DataFrame, low: str, high: str) -> DataFrame:
    """The pairs of rows with ``low < high``, of numeric columns of the left and the right side, as an equi-join.

    Quantiles cut both sides to ranges, a large range (equal values) is dealt to blocks by a hash of the row, and a left
    block meets the right blocks of its own range and of those above. So hardly more pairs are compared than come out.
    """
    least, most = left.agg(F.min(low)).first()[0], right.agg(F.max(high)).first()[0]
    sides = [left.where(F.col(low) < F.lit(most)), right.where(F.col(high) > F.lit(least))]
    bounds = sorted({b for side, column in zip(sides, (low, high), strict=True) for b in _quantiles(side, column)[1]})
    placed, rows, starts = [], [], []
    for side, column in zip(sides, (low, high), strict=True):
        ranged = side.withColumn("_range", range_of(F.col(column), bounds))
        counts = dict(map(tuple, ranged.groupBy("_range").count().collect()))
        rows.append([counts.get(k, 0) for k in range(len(bounds) + 1)])
        blocks = [-(-n // BLOCK) for n in rows[-1]]
        starts.append([0, *accumulate(blocks)])
        many, start = (F.get(F.array(*map(F.lit, x)), F.col("_range")) for x in (blocks, starts[-1]))
        placed.append(ranged.withColumn("_own", (start + F.pmod(F.xxhash64(*side.columns), many)).cast("int")))
    work = sum(n * above for n, above in zip(rows[0], reversed(list(accumulate(reversed(rows[1])))), strict=True))
    parts = 1 + work // PAIRS
    from_, below = (F.get(F.array(*map(F.lit, x)), F.col("_range")) for x in (starts[1], starts[0][1:]))
    first, second = (p.repartition(parts, "_own") for p in placed)
    first = first.where(from_ < starts[1][-1]).select(*left.columns, F.col("_own").alias("_p"), F.explode(F.sequence(from_, F.lit(starts[1][-1] - 1))).alias("_q"))
    second = second.where(below > 0).select(*right.columns, F.explode(F.sequence(F.lit(0), below - 1)).alias("_p"), F.col("_own").alias("_q"))
    met = first.repartition(parts, "_p", "_q").hint("merge").join(second.repartition(parts, "_p", "_q"), ["_p", "_q"])
    return met.where(F.col(low) < F.col(high)).drop("_p", "_q")


#: Rows of a range of a ranking, about; counts that are broadcast, at most.
RANGE_ROWS, FEW_COUNTS = 1 << 18, 1 << 17


def rankings(df: DataFrame, group: str, order: str, key: str, tiles: int) -> DataFrame:
    """``df`` with ``rk`` and ``dr`` (rank and dense rank by ``order``), ``rn`` (row number by ``order``, ``key``) and
    ``nt`` (NTILE by ``key``) within ``group``; ``key`` is numeric, NULLs come last.

    A group is no task's work: quantiles cut the keys to ranges, rows are numbered within a range, and what comes before
    it in the group is a sum over the counts of the ranges.
    """
    n, found = _quantiles(df, key, RANGE_ROWS)
    bounds = sorted(set(found))
    ranged = df.withColumn("_range", F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(range_of(F.col(key), bounds)))
    before = Window.unboundedPreceding, -1
    counts = ranged.groupBy(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    whole, by_order = Window.partitionBy("_g"), F.col("_o").asc_nulls_last()
    sums = counts.select(
        "_g", "_o", "_r",
        F.coalesce(F.sum("_n").over(whole.orderBy(by_order, "_r").rowsBetween(*before)), F.lit(0)).alias("_ordered"),
        F.dense_rank().over(whole.orderBy(by_order)).cast("bigint").alias("dr"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_r").rangeBetween(*before)), F.lit(0)).alias("_keyed"),
        F.sum("_n").over(whole).alias("_all"),
    )
    sums = materialize(sums.withColumn("rk", F.min("_ordered").over(Window.partitionBy("_g", "_o")) + 1), "ranks")
    within, by_key = Window.partitionBy(group, "_range"), F.col(key).asc_nulls_last()
    numbered = ranged.repartition(1 + n // RANGE_ROWS, group, "_range").withColumns(
        {"_k": F.row_number().over(within.orderBy(by_key)), "_ok": F.row_number().over(Window.partitionBy(group, "_range", order).orderBy(by_key))}
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o")) & (F.col("_range") == F.col("_r"))
    placed = numbered.join(F.broadcast(sums) if sums.count() <= FEW_COUNTS else sums, same)
    # The first ``_all`` % tiles tiles have a row more than the others.
    large = f"(_all % {tiles}) * (_all div {tiles} + 1)"
    tile = F.expr(f"CASE WHEN _keyed + _k <= {large} THEN (_keyed + _k - 1) div (_all div {tiles} + 1) + 1 ELSE (_keyed + _k - 1 - {large}) div greatest(_all div {tiles}, 1) + _all % {tiles} + 1 END")
    return placed.select(*df.columns, "rk", "dr", (F.col("_ordered") + F.col("_ok")).alias("rn"), tile.alias("nt"))
