"""Exact seeded "take the n smallest keys per stratum" without a global sort.

A global ``row_number()`` (or ``orderBy().limit(n)`` with a large n) funnels
every row through one task. Instead the cut of each stratum is found on slim
(stratum, key, tie) rows:

1. the 60-bit key of each row is split into a 16-bit bucket (top bits);
2. a histogram ``(stratum, bucket) -> count`` is built with map-side partial
   aggregation; its size is bounded by 65,536 rows per stratum, whatever the
   data size;
3. a running sum over the histogram finds, per stratum, the last bucket
   needed and how many of its rows;
4. only that bucket's slim rows are ranked (md5 keys are uniform, so it holds
   about 1/65,536 of the stratum); the last row taken is the stratum's cut.

The cuts (one per stratum: classes and ratios, a handful) come back as a
scalar subquery, and rows pass a map-side filter: they are neither shuffled
nor sorted, and their other columns are read once.

The result equals ``row_number() over (partition by strata order by key,
tiebreak) <= n`` exactly.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keys import hex_to_long

BUCKET_BITS = 16
KEY_BITS = 60
_SHIFT = KEY_BITS - BUCKET_BITS


def _cuts(slim: DataFrame, n: int | Callable[[Column], Column], by: list[str], ties: list[str]) -> Column:
    """The cut of each stratum as a scalar: array of structs (by..., _k, ties...). A row is taken when its
    (_k, ties...) is not beyond its stratum's; a stratum without an entry gives nothing."""
    slim = slim.withColumn("_b", F.shiftright("_k", _SHIFT))
    hist = slim.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("_cum", F.sum("_cnt").over(run))
            .withColumn("_total", F.sum("_cnt").over(Window.partitionBy(*by))))
    n_col = F.lit(n) if isinstance(n, int) else n(F.col("_total"))
    last = (hist.withColumn("_n", n_col.cast("long"))
            .withColumn("_need", F.col("_n") - (F.col("_cum") - F.col("_cnt")))
            .filter(F.col("_need") > 0)
            .groupBy(*by).agg(F.max(F.struct("_b", "_need", "_cnt")).alias("_l")).select(*by, "_l.*"))
    # a bucket that is taken whole needs no ranking: everything below the next bucket passes
    whole = last.filter(F.col("_need") >= F.col("_cnt")).select(
        *by, F.shiftleft(F.col("_b") + 1, _SHIFT).alias("_k"), *[F.lit(None).cast(slim.schema[t].dataType).alias(t) for t in ties])
    rank = Window.partitionBy(*by, "_b").orderBy("_k", *ties)
    ranked = (slim.join(last.filter(F.col("_need") < F.col("_cnt")), on=[*by, "_b"])
              .withColumn("_rn", F.row_number().over(rank))
              .filter(F.col("_rn") == F.col("_need")).select(*by, "_k", *ties))
    return whole.unionByName(ranked).agg(F.collect_list(F.struct(*by, "_k", *ties))).scalar()


def _within(cut: Column, by: list[str], ties: list[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == cut[c])
    return same & (F.struct("_k", *ties) <= F.struct(cut["_k"].alias("_k"), *[cut[t].alias(t) for t in ties]))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over several tasks for each core: work that is heavy for the bytes it reads would
    otherwise run in as few tasks as there are file splits."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def take_smallest(
    df: DataFrame,
    key_hex: Column,
    n: int | Callable[[Column], Column],
    by: list[str] | tuple[str, ...] = (),
    tiebreak: list[str] | tuple[str, ...] = ("id",),
) -> DataFrame:
    """Keep, per stratum ``by``, the n rows with the smallest (key, tiebreak).

    ``n`` is an int or a function of the stratum's row count (a Column), e.g.
    ``lambda total: F.floor(total * 0.3)`` for a stratified fraction.
    """
    by, ties = list(by), list(tiebreak)
    keyed = df.withColumn("_k", hex_to_long(key_hex, 15))
    cuts = _cuts(keyed.select(*by, "_k", *ties), n, by, ties)
    return keyed.withColumn("_cuts", cuts).filter(F.exists("_cuts", lambda c: _within(c, by, ties))).drop("_k", "_cuts")


def take_smallest_each(
    df: DataFrame,
    key_hex: Column,
    name: str,
    values: list[float] | tuple[float, ...],
    n: Callable[[Column], Column],
    by: list[str] | tuple[str, ...] = (),
    tiebreak: list[str] | tuple[str, ...] = ("id",),
) -> DataFrame:
    """take_smallest for each of a few ``values``, which ``n`` may refer to as column ``name``. Only slim
    rows are repeated to find the cuts; a row is copied for the values that take it."""
    by, ties = list(by), list(tiebreak)
    keyed = df.withColumn("_k", hex_to_long(key_hex, 15))
    slim = keyed.select(*by, "_k", *ties).withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    taken = keyed.withColumn("_cuts", _cuts(slim, n, [*by, name], ties))
    taken = taken.withColumn(name, F.explode(F.transform(F.filter("_cuts", lambda c: _within(c, by, ties)), lambda c: c[name])))
    return taken.drop("_k", "_cuts")
