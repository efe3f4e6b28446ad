"""Statistics of profiles, distances and series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions.distances import HAMMING, DistanceFunction
from stemmata.operators.pairs import distance_histogram, numbered
from stemmata.runtime import cut


def distance_stats(profiles: DataFrame, distance: DistanceFunction = HAMMING) -> DataFrame:
    """One row (n, max, min, mean, median, mode) over pairs of earlier and later profiles. Of tied modes the smallest counts.

    Everything follows from the histogram of distances, which has at most one row a distance.
    """
    return histogram_stats(distance_histogram(profiles, distance))


def histogram_stats(histogram: DataFrame) -> DataFrame:
    """The same from rows (w, n)."""
    upto = F.sum("n").over(Window.orderBy("w"))
    total = F.sum("n").over(Window.partitionBy())
    placed = histogram.select("w", "n", upto.alias("upto"), total.alias("total"))
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
    return placed.agg(
        F.sum("n").alias("n"), F.max("w").alias("max"), F.min("w").alias("min"), (F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"),
        ((F.max(F.when(holds(lower), F.col("w"))) + F.max(F.when(holds(upper), F.col("w")))) / 2).alias("median"),
        F.max_by("w", F.struct("n", -F.col("w"))).alias("mode"),
    )


def locus_entropy(profiles: DataFrame) -> DataFrame:
    """(pos, entropy): Shannon entropy in bits of each locus; missing alleles are symbols like others."""
    counts = profiles.select(F.posexplode("alleles").alias("pos", "allele")).groupBy("pos", "allele").agg(F.count("*").alias("n"))
    totals = counts.groupBy("pos").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return totals.select("pos", F.greatest(F.lit(0.0), F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy"))


def missing_by_locus(profiles: DataFrame) -> DataFrame:
    """(pos, n_missing, n)."""
    rows = profiles.select(F.posexplode("alleles").alias("pos", "allele"))
    return rows.groupBy("pos").agg(F.count_if(F.col("allele").isin(-1, 0)).alias("n_missing"), F.count("*").alias("n"))


def sorted_entropy(entropies: DataFrame) -> DataFrame:
    return entropies.orderBy(F.desc("entropy"), "pos")


def top_entropy(entropies: DataFrame, k: int) -> DataFrame:
    return sorted_entropy(entropies).limit(k)


#: Rows of a block that windows over a series work in; longer series go in several blocks.
SERIES_BLOCK = 65_536


def placed(series: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds `__at`, the place of each row among all rows by `by` and `order`, and `__place`, that in its own series, both from 0. Ranges of rows are sorted apart, whatever series they are of,
    so that one long series goes in as many ranges as others; a row a series tells where it begins. Nulls in `by` are a series too.
    """
    by = by or []
    if not by:
        return numbered(series, order, name="__at").withColumn("__place", F.col("__at"))
    rows = cut(numbered(series, [*by, *order], name="__at"))
    first = rows.groupBy(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)]).agg(F.min("__at").alias("__first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(by)])
    return rows.join(first, same).withColumn("__place", F.col("__at") - F.col("__first")).select(*series.columns, "__at", "__place")


def with_halo(rows: DataFrame, at: str, before: int, after: int, block: int) -> DataFrame:
    """Adds `__block`, blocks of so many numbers in column `at`, and `__own`: rows within reach of a neighbouring block are copied to it (own false), so that a window over a block's rows finds all
    that lie up to `before` back and `after` on. Blocks may be no smaller than either.
    """
    if max(before, after) > block:
        raise ValueError("a window may not reach beyond the next block")
    own, offset = F.floor(F.col(at) / block), F.col(at) % block
    copies = F.filter(F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.when(offset >= block - before, F.struct((own + 1).alias("b"), F.lit(False).alias("own"))), F.when(offset < after, F.struct((own - 1).alias("b"), F.lit(False).alias("own")))), lambda x: x.isNotNull())
    return rows.withColumn("__copy", F.explode(copies)).withColumn("__block", F.col("__copy.b")).withColumn("__own", F.col("__copy.own")).drop("__copy")


def moving_average(series: DataFrame, value: str, order: list[str], window: int, by: list[str] | None = None, block: int = SERIES_BLOCK) -> DataFrame:
    """Adds `smoothed`, the mean of up to window // 2 rows before and after and the row itself, cut off at the ends of each series (by). Rows of one place in `order` come in any order.

    Long series are smoothed in blocks of rows that also hold their neighbours' nearest ones.
    """
    half = window // 2
    rows = with_halo(placed(series, order, by), "__at", half, half, max(block, half, 1))
    frame = Window.partitionBy("__block", *(by or [])).orderBy("__at").rowsBetween(-half, half)
    return rows.withColumn("smoothed", F.avg(value).over(frame)).where("__own").select(*series.columns, "smoothed")


def downsample(series: DataFrame, columns: list[str], order: list[str], factor: int, by: list[str] | None = None) -> DataFrame:
    """(by..., point, means of columns) of every `factor` rows in order; the last point may have fewer."""
    rows = placed(series, order, by).withColumn("point", F.floor(F.col("__place") / factor).cast("int"))
    return rows.groupBy(*(by or []), "point").agg(*[F.avg(c).alias(c) for c in columns])


def mebibytes(x: Column) -> Column:
    return x / (1024 * 1024)


def gibibytes(x: Column) -> Column:
    return x / (1024 * 1024 * 1024)


def minutes_of_ms(x: Column) -> Column:
    return x / 60_000


def hours_of_s(x: Column) -> Column:
    return x / 60 / 60


def log2_or_zero(n: Column) -> Column:
    return F.when(n > 0, F.log2(n)).otherwise(0.0)


def complexity(n: Column, solver: str) -> Column:
    """The axis that a solver's run time is drawn over: n log2 n + n squared for pairing heaps, else n cubed."""
    x = n.cast("double")
    return x * log2_or_zero(x) + x * x if solver == "pairingHeap" else x * x * x


def record_kind(json: Column) -> Column:
    """'memory' or 'runtime', by the keys of a JSON object; null if neither fits."""
    keys = F.json_object_keys(json)
    return F.when(F.array_contains(keys, "heap"), "memory").when(F.array_contains(keys, "Inference time"), "runtime")
