"""Tiered best match (J13-J15, D6): exact name, shared alias, family; by equi-joins on exploded aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("exact", "normalized_exact", "alias_match", "family_only", "unmatched")


def tiered_match(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per query: id, match_confidence, match_rank, match_key, direct, record (the candidate's row, or null).

    queries: id, name, model_id, family, aliases; candidates: ord (their order), name, family, aliases, sort_score, and
    what else the record shall have. Aliases don't include the family's own name. Tier 0: the candidate's name is the
    query's name or id (any case); tier 1: they share an alias; in both the first candidate by ``ord`` wins. Tier 3: the
    candidate of the family with the highest score, the first among equals; missing scores count as 0. ``ord`` is a number
    or a struct, and tells candidates apart.

    Every key (name, alias, family) is reduced to its first candidate before queries meet it, so work grows with keys
    and aliases, not with queries times candidates; no key brings more than one row to a query.
    """
    low = lambda c: F.lower(F.trim(c))
    first = lambda rows: rows.groupBy("k").agg(F.min("ord").alias("ord"))
    names = queries.select("id", F.explode(F.array_distinct(F.array(low("name"), low("model_id")))).alias("k")).where("k <> ''")
    exact = names.join(first(candidates.select(low("name").alias("k"), "ord")), "k").select("id", F.lit(0).alias("tier"), "ord")
    words = queries.select("id", F.explode("aliases").alias("k"))
    alias = words.join(first(candidates.select(F.explode("aliases").alias("k"), "ord")), "k").select("id", F.lit(1).alias("tier"), "ord")
    score = F.coalesce(F.col("sort_score").cast("double"), F.lit(0.0))
    best = candidates.where("family IS NOT NULL").groupBy("family").agg(F.min(F.struct((-score).alias("s"), "ord"))["ord"].alias("ord"))
    family = queries.select("id", "family").join(best, "family").select("id", F.lit(3).alias("tier"), "ord")
    chosen = exact.unionByName(alias).unionByName(family).groupBy("id").agg(F.min(F.struct("tier", "ord")).alias("m"))
    record = candidates.select("ord", F.struct(*candidates.columns).alias("record"))
    tier = F.coalesce(F.col("m.tier"), F.lit(4))
    shared = F.array_min(F.array_intersect("aliases", "record.aliases"))
    key = F.when(tier == 0, low("record.name")).when(tier == 1, shared).when(tier == 3, F.col("family"))
    found = queries.join(chosen, "id", "left").withColumn("ord", F.col("m.ord")).join(record, "ord", "left")
    return found.select(
        "id",
        F.get(F.array(*(F.lit(t) for t in TIERS)), tier).alias("match_confidence"),
        tier.alias("match_rank"),
        key.alias("match_key"),
        (tier <= 2).alias("direct"),
        "record",
    )
