"""Set operations on keys and bridge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def key_presence(a: DataFrame, b: DataFrame, key: str, left: str = "left_only", right: str = "right_only") -> DataFrame:
    """Both differences and the intersection in one full outer join of distinct keys."""
    x = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    y = b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), left).otherwise(right)
    return x.join(y, key, "full_outer").select(key, where.alias("presence"))


def sync_check(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids without a vector are missing, vectors without a paper are orphaned."""
    return key_presence(papers.select("id"), vectors.select("id"), "id", "missing", "orphaned")


def drop_orphans(vectors: DataFrame, papers: DataFrame) -> DataFrame:
    """X03."""
    return vectors.join(papers.select("id"), "id", "left_semi")


def union_needs(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Union of id lists, sorted, optionally limited."""
    out = lists[0].select("id")
    for t in lists[1:]:
        out = out.union(t.select("id"))
    out = out.distinct().orderBy("id")
    return out if limit is None else out.limit(limit)


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row per key in input order; rows without a key are all kept."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = df.filter(F.col(key).isNotNull()).withColumn("_n", rank).filter("_n = 1").drop("_n")
    return keyed.unionByName(df.filter(F.col(key).isNull()))


def union_results(sources: list[DataFrame], key: str = "doi") -> DataFrame:
    """Results of several sources, one per DOI, earlier sources first."""
    tagged = [s.withColumn("_source_no", F.lit(i)) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_per_key(out, key, ["_source_no", "ordinal"]).drop("_source_no")


def collection_members(closure: DataFrame, paper_collections: DataFrame) -> DataFrame:
    """Papers of a collection and everything below it, each once.

    ``closure`` holds (root_id, id) pairs, see :func:`quire.operators.graph.collection_closure`.
    """
    return closure.join(paper_collections, closure.id == paper_collections.collection_id).select(
        "root_id", "paper_id").distinct()


def edit_set(bridge: DataFrame, add: DataFrame, remove: DataFrame, keys: list[str]) -> DataFrame:
    """Bridge rows after bulk additions and removals (removal wins)."""
    return bridge.select(*keys).union(add.select(*keys)).distinct().join(remove.select(*keys).distinct(), keys, "left_anti")


def edit_report(bridge: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """Requested additions marked added or skipped (already there)."""
    have = bridge.select(*keys).distinct().withColumn("_have", F.lit(True))
    out = change.select(*keys).distinct().join(have, keys, "left")
    return out.withColumn("outcome", F.when(F.col("_have"), "skipped").otherwise("added")).drop("_have")
