"""Mergeable sketches for reports at scale (A06, A13): stored per batch or bucket, merged into any report.

A sketch row holds, for a group, the number of rows, a distinct-count sketch (HyperLogLog) per counted column and a quantile sketch (KLL) per
measured column.  A new batch is sketched alone; reports merge stored rows and never read the data again.  Distinct counts of merged
parts equal those of the whole exactly, as a merged HyperLogLog sketch is the sketch of the union; quantiles of merged parts keep the error
of the sketch.  With the default sizes a distinct count is off by 1.6 % in the standard deviation, a quantile's rank by 1.33 %.

Defined results: nulls are neither counted nor measured; a group without values has 0 distinct ones and null quantiles; an empty table
gives no groups, and without group columns one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LG_K, KLL_K = 12, 200


def sketch(rows: DataFrame, by: list[str], *, distinct: list[str] = [], measures: list[str] = [], lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """One row per group: ``n``, ``distinct_<column>`` and ``values_<column>`` sketches."""
    hll = [F.hll_sketch_agg(F.col(c), lg_k).alias(f"distinct_{c}") for c in distinct]
    kll = [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"values_{c}") for c in measures]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *hll, *kll)


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored rows of any number of batches or buckets, merged to the groups ``by``."""
    hll = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("distinct_")]
    kll = [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("values_")]
    return sketches.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), *hll, *kll)


def estimates(sketches: DataFrame, quantiles: list[float] = [0.5, 0.9]) -> DataFrame:
    """Distinct counts and quantiles (columns ``<column>_p<percent>``) read from sketch rows."""
    out = sketches
    for c in sketches.columns:
        if c.startswith("distinct_"):
            # a sketch never merged keeps the order of its updates and estimates by it; united with itself it estimates as a merged one
            out = out.withColumn(c, F.coalesce(F.hll_sketch_estimate(F.hll_union(c, c)), F.lit(0).cast("long")))
        elif c.startswith("values_"):
            filled = F.kll_sketch_get_n_double(c) > 0
            for q in quantiles:
                out = out.withColumn(f"{c.removeprefix('values_')}_p{round(100 * q)}", F.when(filled, F.kll_sketch_get_quantile_double(F.col(c), F.lit(q))))
            out = out.drop(c)
    return out


def append(rows: DataFrame, path: str, batch: str, by: list[str], **how) -> None:
    """Sketch one batch into a stored table partitioned by batch; a replayed batch replaces its own rows."""
    sketch(rows, by, **how).write.mode("overwrite").parquet(f"{path}/batch={batch}")
