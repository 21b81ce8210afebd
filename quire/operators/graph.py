"""Citation graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import doi_key, shorten
from quire.session import SALTS, checkpointed, repeat_per_salt, salt_of, top_k

#: Links of one paper that a task follows; more are dealt over sub-keys.
HOT = 10_000
#: Works of a paper whose pairs are listed.
LISTED = 64


def claims_of(refs: DataFrame) -> DataFrame:
    """One claim per paper whose parallel arrays follow the printed reference order."""
    row = F.struct("reference_order", "reference_id", "matched_paper_id", "match_status")
    rows = F.array_sort(F.collect_list(row))
    pick = lambda f: F.transform("rows", lambda r: r[f])
    return refs.groupBy("paper_id").agg(rows.alias("rows")).select(
        F.col("paper_id").alias("claim_id"), "paper_id", pick("reference_id").alias("reference_ids"),
        pick("matched_paper_id").alias("matched_paper_ids"), pick("match_status").alias("match_statuses"))


def citations(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Papers citing and cited by each of ``ids`` (column ``id``)."""
    citing = edges.join(ids, edges.cited == ids.id).select("id", F.col("citing").alias("other_id"), F.lit("citing").alias("direction"))
    cited = edges.join(ids, edges.citing == ids.id).select("id", F.col("cited").alias("other_id"), F.lit("cited").alias("direction"))
    if direction == "both":
        return citing.unionByName(cited)
    return citing if direction == "citing" else cited


def common_references(refs: DataFrame, min_shared: int = 2, examples: int = 5) -> DataFrame:
    """All pairs of papers sharing at least ``min_shared`` distinct reference DOIs.

    Two papers that share two works share a pair of works, so papers meet at the hashes of
    their pairs of works (of single works if one is enough), of which most occur once and are dropped where they
    are counted: what is shuffled grows with the papers, not with the square of a work's
    citations.  A paper of more than ``LISTED`` works meets all others work by work instead.
    Pairs found so are compared by their whole sets.
    """
    keyed = refs.select("paper_id", doi_key("parsed_doi").alias("doi")).filter("doi IS NOT NULL AND paper_id IS NOT NULL")
    sets = keyed.repartition("paper_id").groupBy("paper_id").agg(F.array_sort(F.collect_set("doi")).alias("dois"))
    later = lambda x, i: F.transform(F.slice("dois", i + 2, F.size("dois")), lambda y: F.xxhash64(x, y))
    keys = F.flatten(F.transform("dois", later)) if min_shared > 1 else F.transform("dois", lambda x: F.xxhash64(x))
    rows = sets.filter(F.size("dois") >= min_shared)
    rows = (rows.filter(F.size("dois") <= LISTED) if min_shared > 1 else rows).select("paper_id", F.explode(keys).alias("key"))
    # for two works no more rows than twice the pairs reported
    met = checkpointed(rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    parts = F.ceil(F.col("n") / 1000).cast("int")
    left = met.select(F.col("paper_id").alias("paper_a"), "key", F.pmod(F.xxhash64("paper_id"), parts).cast("int").alias("salt"))
    right = met.select(F.col("paper_id").alias("paper_b"), "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    pairs = left.join(right, ["key", "salt"]).filter("paper_a < paper_b").select("paper_a", "paper_b")
    if min_shared > 1:
        large = checkpointed(keyed.groupBy("paper_id").agg(F.count("*").alias("n")).filter(F.col("n") > LISTED).select("paper_id"))
        if not large.isEmpty():
            works = keyed.distinct()
            ours = repeat_per_salt(works.join(large, "paper_id", "left_semi").withColumnRenamed("paper_id", "own"))
            both = works.withColumn("salt", salt_of("paper_id")).join(ours, ["doi", "salt"]).filter("paper_id <> own")
            both = both.groupBy("own", "paper_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_shared)
            pairs = pairs.unionByName(both.select(F.least("own", "paper_id").alias("paper_a"), F.greatest("own", "paper_id").alias("paper_b")))
    own = lambda s: sets.select(F.col("paper_id").alias(f"paper_{s}"), F.col("dois").alias(f"dois_{s}"))
    full = pairs.distinct().join(own("a"), "paper_a").join(own("b"), "paper_b").withColumn("both", F.array_intersect("dois_a", "dois_b"))
    full = full.filter(F.size("both") >= min_shared)
    return full.select("paper_a", "paper_b", F.size("both").alias("shared_references"), F.slice(F.array_sort("both"), 1, examples).alias("shared_dois"))


def related_papers(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """G02 per source paper: both directions of each pair, strongest first."""
    way = lambda a, b: F.struct(F.col(f"paper_{a}").alias("paper_id"), F.col(f"paper_{b}").alias("related_id"))
    ways = pairs.select(F.inline(F.array(way("a", "b"), way("b", "a"))), "shared_references", "shared_dois")
    return top_k(ways, ["paper_id"], [F.desc("shared_references"), F.col("related_id")], k, "rank")


def _resolved(links: DataFrame, papers: DataFrame, include_external: bool) -> DataFrame:
    """Links with the node at their far end: a library paper by DOI, else an external work."""
    lib = papers.select(doi_key("doi").alias("_doi"), F.col("id")).filter("_doi IS NOT NULL")
    lib = lib.groupBy("_doi").agg(F.min("id").alias("library_id"))
    out = links.withColumn("_doi", doi_key("doi")).join(lib, "_doi", "left")
    external = F.concat(F.lit("ext_"), F.coalesce(F.col("doi"), F.col("title")))
    out = out.withColumn("node", F.coalesce(F.concat(F.lit("lib_"), F.col("library_id").cast("string")), external))
    return out if include_external else out.filter("library_id IS NOT NULL")


def build_graph(seeds: DataFrame, links: DataFrame, papers: DataFrame, *, include_external: bool = False,
                depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and directed ``cites`` edges around the seed papers.

    ``links`` holds (paper_id, relation, doi, title, year); relation is ``citation`` for
    works citing the paper and ``reference`` for works it cites.  Library papers reached
    at one level are expanded at the next.
    """
    far = _resolved(links, papers, include_external)
    here = F.concat(F.lit("lib_"), F.col("paper_id").cast("string"))
    frontier, levels = seeds.select(F.col("id").alias("paper_id")).distinct(), []
    for _ in range(depth):
        step = far.join(frontier, "paper_id", "left_semi")
        levels.append(step)
        frontier = step.filter("library_id IS NOT NULL").select(F.col("library_id").alias("paper_id")).distinct()
    reached = reduce(DataFrame.unionByName, levels)
    out = F.col("relation") == "reference"
    edges = reached.select(F.when(out, here).otherwise(F.col("node")).alias("source"),
                           F.when(out, F.col("node")).otherwise(here).alias("target"), F.lit("cites").alias("type")).distinct()
    known = seeds.select("id").unionByName(reached.filter("library_id IS NOT NULL").select(F.col("library_id").alias("id"))).distinct()
    nodes = papers.join(known, "id", "left_semi").select(
        F.concat(F.lit("lib_"), F.col("id").cast("string")).alias("node"), F.substring("title", 1, 50).alias("label"),
        F.lit("library").alias("type"))
    if include_external:
        ext = reached.filter("library_id IS NULL").groupBy("node").agg(F.substring(F.min("title"), 1, 50).alias("label"))
        nodes = nodes.unionByName(ext.withColumn("type", F.lit("external")))
    return nodes, edges


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New (citing, cited) pairs that are not there yet, each once."""
    return new.select("citing", "cited").filter("citing <> cited").distinct().join(edges, ["citing", "cited"], "left_anti")


def harvest_plan(source_refs: DataFrame, papers: DataFrame, edges: DataFrame, *, min_year: int | None = None,
                 max_imports: int = 50) -> DataFrame:
    """Per reference of each paper: in library, to import, or over the import quota; and the edges to create."""
    rows = source_refs if min_year is None else source_refs.filter(F.col("year") >= min_year)
    lib = papers.select(doi_key("doi").alias("_doi"), "id").filter("_doi IS NOT NULL").groupBy("_doi").agg(F.min("id").alias("library_id"))
    rows = rows.withColumn("_doi", doi_key("doi")).join(lib, "_doi", "left")
    have = rows.filter("library_id IS NOT NULL").withColumn("action", F.lit("in_library"))
    miss = rows.filter("library_id IS NULL AND _doi IS NOT NULL")
    # the rank ends at the quota, so a task never orders all that a paper misses
    quota = top_k(miss.select("paper_id", "ordinal").distinct(), ["paper_id"], [F.col("ordinal")], max_imports).withColumn("_in", F.lit(True))
    miss = miss.join(quota, ["paper_id", "ordinal"], "left").withColumn("action", F.when(F.col("_in"), "import").otherwise("over_quota")).drop("_in")
    out = have.unionByName(miss).drop("_doi")
    seen = edges.select(F.col("citing").alias("paper_id"), F.col("cited").alias("library_id"), F.lit(True).alias("_seen"))
    out = out.join(seen, ["paper_id", "library_id"], "left")
    return out.withColumn("new_edge", F.col("library_id").isNotNull() & F.col("_seen").isNull()).drop("_seen")


def claims(claim_rows: DataFrame, papers: DataFrame, *, section: str | None = None, claim_type: str | None = None,
           importance: str | None = None) -> DataFrame:
    """Filtered claims with the titles of their matched papers in citation order."""
    out = claim_rows
    for c, v in (("section", section), ("claim_type", claim_type), ("importance", importance)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    pos = out.select("claim_id", F.posexplode("matched_paper_ids").alias("pos", "id")).filter("id IS NOT NULL")
    titled = pos.join(papers.select("id", "title"), "id")
    titled = titled.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title"))).alias("matched_papers"))
    return out.join(titled, "claim_id", "left")


def unmatched_claim_refs(links: DataFrame, refs: DataFrame) -> DataFrame:
    """References no library paper was found for, with the first claim that uses each."""
    todo = links.filter(F.col("match_status").isin("unmatched", "reference_not_found") & F.col("reference_id").isNotNull())
    first = todo.groupBy("reference_id").agg(F.min(F.struct("claim_id", "pos", "paper_id")).alias("f"))
    out = first.select("reference_id", F.col("f.claim_id").alias("claim_id"), F.col("f.paper_id").alias("citing_paper_id"))
    text = refs.groupBy("reference_id").agg(F.min(shorten("raw_text", 200, "")).alias("raw_text"))
    return out.join(text, "reference_id")


def chain(edges: DataFrame, seeds: DataFrame, *, depth: int = 2, direction: str = "forward",
          visited: bool = False) -> DataFrame:
    """Papers reached from each seed, one row per (seed, level, paper).

    ``edges`` are matched claim links (citing, cited).  Each level is deduplicated before
    the next hop, and cut off from its lineage from the third on.  ``visited`` drops papers
    already reached at an earlier level.  Only papers of more than ``HOT`` links are dealt over
    sub-keys, and both sides are shuffled: repeated rows are more than the planner expects.
    """
    src, dst = ("citing", "cited") if direction == "forward" else ("cited", "citing")
    hop = edges.select(F.col(src).alias("from_id"), F.col(dst).alias("to_id")).distinct()
    # at most one row per ``HOT`` links
    hot = F.broadcast(hop.groupBy("from_id").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("from_id", F.lit(True).alias("hot")))
    hop = hop.join(hot, "from_id", "left").withColumn("salt", F.when(F.col("hot"), salt_of("to_id")).otherwise(0)).drop("hot")
    subkeys = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    frontier = seeds.select(F.col("id").alias("seed_id"), F.col("id").alias("paper_id"))
    levels, seen = [], frontier
    for level in range(1, depth + 1):
        start = frontier.select("seed_id", F.col("paper_id").alias("from_id")).join(hot, "from_id", "left")
        start = start.withColumn("salt", subkeys).drop("hot").hint("merge")
        reached = start.join(hop, ["from_id", "salt"]).groupBy("seed_id", F.col("to_id").alias("paper_id")).agg(
            F.min("from_id").alias("from_paper_id"))
        if visited:
            reached = reached.join(seen, ["seed_id", "paper_id"], "left_anti")
            seen = seen.unionByName(reached.select("seed_id", "paper_id"))
        if level >= 3 and level < depth:
            reached = checkpointed(reached)
            if reached.isEmpty():
                break
        levels.append(reached.withColumn("level", F.lit(level)))
        frontier = reached
    return reduce(DataFrame.unionByName, levels)


def link_claims(claim_rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Citation number n -> reference with order n-1 -> library paper, as parallel arrays."""
    lib = refs.groupBy("paper_id", "reference_order").agg(
        F.max(F.struct("reference_id", "matched_paper_id")).alias("r"))
    pos = claim_rows.select("claim_id", "paper_id", F.posexplode("citation_numbers").alias("pos", "number"))
    hit = pos.withColumn("reference_order", F.when(F.col("number") > 0, F.col("number") - 1))
    hit = hit.join(lib, ["paper_id", "reference_order"], "left")
    status = (F.when(F.col("r").isNull(), "reference_not_found")
              .when(F.col("r.matched_paper_id").isNotNull(), "matched").otherwise("unmatched"))
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("r.reference_id").alias("reference_id"),
                                                F.col("r.matched_paper_id").alias("matched_paper_id"), status.alias("status"))))
    pick = lambda f: F.transform("rows", lambda r: r[f])
    return hit.groupBy("claim_id", "paper_id").agg(rows.alias("rows")).select(
        "claim_id", "paper_id", pick("reference_id").alias("reference_ids"),
        pick("matched_paper_id").alias("matched_paper_ids"), pick("status").alias("match_statuses"))


def collection_closure(collections: DataFrame) -> DataFrame:
    """Every collection with itself and all collections below it, at its smallest depth.

    Each round doubles the depth covered: pairs at exactly the reach so far are continued by
    all pairs within it, and pairs known already are dropped.  Rounds grow with the logarithm
    of the depth, no depth or size ends them, and a cycle does.
    """
    own = collections.select(F.col("id").alias("root_id"), "id").distinct().withColumn("depth", F.lit(0))
    step = collections.filter("parent_id IS NOT NULL AND parent_id <> id").select(F.col("parent_id").alias("root_id"), "id").distinct().withColumn("depth", F.lit(1))
    step = step.join(own.select("root_id"), "root_id", "left_semi")
    found, reach = checkpointed(own.unionByName(step)), 1
    while True:
        far = found.filter(F.col("depth") == reach).select("root_id", F.col("id").alias("mid"), F.col("depth").alias("above"))
        if far.isEmpty():
            return found
        near = found.filter("depth > 0").select(F.col("root_id").alias("mid"), "id", F.col("depth").alias("below"))
        new = far.join(near, "mid").groupBy("root_id", "id").agg(F.min(F.col("above") + F.col("below")).cast("int").alias("depth"))
        found = checkpointed(found.unionByName(new.join(found, ["root_id", "id"], "left_anti")))
        reach *= 2


def clusters(pairs: DataFrame, *, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Connected components of duplicate pairs as (id, cluster_id), the smallest id naming each.

    Alternates large-star and small-star steps until no edge changes.  Each step is a
    grouped minimum and a join, rounds grow with the logarithm of the longest chain, and
    lineage is cut through the checkpoint folder after every round.
    """
    # edges run from the larger to the smaller id
    def point_down(df: DataFrame, x: Column, y: Column) -> DataFrame:
        return df.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").distinct()

    def with_min(rows: DataFrame, mins: DataFrame) -> DataFrame:
        """Rows joined with the minimum of their (possibly hot) key ``u``."""
        spread = rows.withColumn("salt", salt_of("v"))
        return spread.join(repeat_per_salt(mins, SALTS), ["u", "salt"]).drop("salt")

    edges = checkpointed(point_down(pairs, F.col(a), F.col(b)))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = point_down(with_min(both.filter("v > u"), low), F.col("v"), F.col("m"))
        # vertices whose neighbours are all smaller keep their own link to the minimum
        large = large.unionByName(point_down(low, F.col("u"), F.col("m"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = point_down(with_min(large, low), F.col("v"), F.col("m"))
        edges = checkpointed(small.unionByName(point_down(low, F.col("u"), F.col("m"))).distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("cluster_id")).unionByName(
        roots.select("id", F.col("id").alias("cluster_id")))
