"""Scores of runs: totals with the null rule, leaderboards, histograms, usage, errors and cost.

A row's total is the sum of its dimension scores with missing ones as 0; rows without any score count with total 0
unless ``exclude_null``. Each aggregate is one shuffle of partial sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(dimensions: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(d), F.lit(0)) for d in dimensions])


def scored(rows: DataFrame, dimensions: list[str], most: int, exclude_null: bool = False) -> DataFrame:
    out = rows.withColumn("score_total", total(dimensions)).withColumn("score_pct", F.round(F.col("score_total") * 100.0 / most, 1))
    return out.filter(F.coalesce(*dimensions).isNotNull()) if exclude_null else out


def by_domain(scores: DataFrame, domain: str = "domain") -> DataFrame:
    s = F.col("score_total")
    return scores.groupBy(domain).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("lo"), F.max(s).alias("hi"))


def overall(scores: DataFrame) -> DataFrame:
    s = F.col("score_total")
    return scores.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), F.min(s).alias("lo"), F.max(s).alias("hi"))


def by_dimension(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions])).alias("x")).select("x.*")
    return long.groupBy("dimension").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.sum(F.col("value").isNull().cast("int")).alias("missing"))


def matrix(scores: DataFrame, dimensions: list[str], domain: str = "domain") -> DataFrame:
    """Mean of each dimension by domain, one column a dimension; 0 where no row of the domain has it."""
    return scores.groupBy(domain).agg(*[F.coalesce(F.avg(d), F.lit(0.0)).alias(d) for d in dimensions])


def histogram(scores: DataFrame, most: int) -> DataFrame:
    """Rows for each total from 0 to ``most``, also where there are none."""
    bins = scores.sparkSession.range(0, most + 1).select(F.col("id").cast("int").alias("bin"))
    got = scores.groupBy(F.col("score_total").cast("int").alias("of")).agg(F.count(F.lit(1)).alias("k"))
    return bins.join(got, bins["bin"] == got["of"], "left").select("bin", F.coalesce("k", F.lit(0)).alias("n"))


def standard_error(scores: DataFrame, domain: str = "domain") -> DataFrame:
    s = F.col("score_total")
    return scores.groupBy(domain).agg((F.stddev_pop(s) / F.greatest(F.sqrt(F.count(s)), F.lit(1.0))).alias("stderr"), F.count(s).alias("n"))


def usage(rows: DataFrame, tokens: str) -> DataFrame:
    """Tokens of a run; rows without a count, or with 0, are left out of sum, mean and maximum and counted as missing."""
    t = F.nullif(F.col(tokens), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(t).alias("total"), F.avg(t).alias("mean"), F.max(t).alias("most"), F.sum(t.isNull().cast("int")).alias("missing"))


def top_errors(errors: DataFrame, message: str, order: str, k: int, width: int = 80) -> DataFrame:
    """The k most frequent message starts; ties go to the one seen first."""
    head = F.substring(message, 1, width)
    return errors.groupBy(head.alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def cost(rows: DataFrame, tokens_in: Column, tokens_out: Column, prices: DataFrame, key: str, usage: Column | None = None) -> DataFrame:
    """Cost by a table of prices (``key``, ``price_in``, ``price_out`` a million tokens); ``cost_status`` says how it came about.

    ``usage``: what is null where a row has no usage at all (by default: both counts are). The join's strategy is the
    optimizer's, which knows the size of the price table.
    """
    named = prices.select(F.col(key).alias("_of"), "price_in", "price_out")
    joined = rows.withColumns({"tokens_in": tokens_in, "tokens_out": tokens_out, "_used": (F.coalesce(tokens_in, tokens_out) if usage is None else usage).isNotNull()}).join(named, F.col(key) == F.col("_of"), "left")
    status = (
        F.when(F.col("_of").isNull(), "unknown_model")
        .when(~F.col("_used"), "unknown_no_usage")
        .when(F.col("tokens_in").isNull() | F.col("tokens_out").isNull(), "unknown_missing_token_fields")
        .when(F.col("price_in").isNull() | F.col("price_out").isNull(), "estimated_missing_price_table")
        .otherwise("estimated_from_usage")
    )
    value = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return joined.withColumn("cost_status", status).withColumn("estimated_cost", F.when(F.col("cost_status") == "estimated_from_usage", value)).drop("_of", "_used")


def domain_bars(scores: DataFrame, domain: str = "domain") -> DataFrame:
    """What a bar chart of domains shows: mean, standard error, maximum and number, in ascending order of mean (``pos`` from 1)."""
    s = F.col("score_total")
    bars = scores.groupBy(domain).agg(F.avg(s).alias("mean"), (F.stddev_pop(s) / F.greatest(F.sqrt(F.count(s)), F.lit(1.0))).alias("stderr"), F.max(s).alias("most"), F.count(s).alias("n"))
    return bars.withColumn("pos", F.row_number().over(Window.orderBy("mean", domain)))


def dimension_bars(scores: DataFrame, dimensions: list[str], most: int = 2) -> DataFrame:
    """Mean and percentage of each dimension, in ascending order of mean (``pos`` from 1)."""
    bars = by_dimension(scores, dimensions).select("dimension", "mean", (F.col("mean") * 100 / most).alias("pct"))
    return bars.withColumn("pos", F.row_number().over(Window.orderBy("mean", "dimension")))
