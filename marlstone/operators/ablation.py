"""Comparisons over k, backend and model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.metrics import aggregate_report
from marlstone.sources.tables import written


def by_k(ranked: DataFrame, ks: tuple[int, ...] = (3, 5, 7, 10)) -> DataFrame:
    """Hits ranked once at the largest k, repeated for each smaller k that holds them, as column ``k``."""
    return ranked.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("rank") <= k)))


def recall_of(approximate: DataFrame, exact: DataFrame, query_id: str = "query_id", key: str = "id") -> DataFrame:
    """Per query: ``n_exact, n_found, recall`` of the exact hits."""
    found = approximate.select(query_id, key, F.lit(1).alias("_f"))
    both = exact.select(query_id, key).join(found, [query_id, key], "left")
    out = both.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_exact"), F.coalesce(F.sum("_f"), F.lit(0)).alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))


def compare(samples_by_config: dict[str, DataFrame | Callable[[], DataFrame]], column: str = "config") -> tuple[DataFrame | None, dict[str, str]]:
    """Reports of all configurations in one table. Each is run and its report written before the next; one that fails, whether it can't be made,
    planned or run to its end, is left out and its error returned. A configuration is its samples or a function that makes them."""
    out, failed = None, {}
    for name, samples in samples_by_config.items():
        try:
            made = samples() if callable(samples) else samples
            report = written(aggregate_report(made.withColumn(column, F.lit(name)), [column]))
            out = report if out is None else out.unionByName(report, allowMissingColumns=True)
        except Exception as e:  # a run that fails must not stop the others
            failed[name] = str(e)
    return out, failed
