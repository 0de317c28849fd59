"""Fusion of channels, the explainable rerank, and arbitration between records."""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import anchor_hits, anchors, match_level, strings, tag_token

RRF_K, RRF_WEIGHT = 60.0, 300.0


def fuse(lexical: DataFrame, evidence: DataFrame, cap: int = 50) -> DataFrame:
    """Channels (id, rank) to id, lexical_rank, evidence_rank, fusion, admitted.

    With both channels present half of the places go to the lexical order and the rest to evidence;
    what stays free is filled by fusion score.
    """
    joined = lexical.select("id", F.col("rank").alias("lexical_rank")).join(evidence.select("id", F.col("rank").alias("evidence_rank")), "id", "full")
    score = F.coalesce(1 / (RRF_K + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("evidence_rank")), F.lit(0.0))
    half = math.ceil(cap / 2)
    first = F.when(F.col("lexical_rank") <= half, 0).when(F.col("evidence_rank") <= cap - half, 0).otherwise(1)
    pool = joined.withColumn("fusion", score).withColumn("turn", first)
    admitted = pool.orderBy("turn", F.desc("fusion"), F.coalesce("lexical_rank", F.lit(1_000_000_000)), "id").limit(cap)
    return admitted.select("id", "lexical_rank", "evidence_rank", "fusion")


def surface_level(query: str, surface: Column) -> Column:
    q = anchors(F.lit(query))
    specific, generic = anchor_hits(q, anchors(surface))
    query_specific = anchor_hits(q, q)[0]
    held = F.contains(F.lower(surface), F.lit(query.strip().lower())) & F.lit(bool(query.strip()))
    return F.when(F.coalesce(surface, F.lit("")) == "", "none").when(held, "strong").otherwise(match_level(specific, generic, query_specific))


def tag_level(query: str, tags: Column) -> Column:
    """By the share of query words that are tags; words without ASCII letters may begin or end with a tag."""
    words = F.filter(F.transform(strings(query.split()), tag_token), lambda w: w != "")
    own = F.transform(tags, tag_token)

    def hit(w: Column) -> Column:
        part = F.exists(own, lambda t: (t == w) | ((F.length(t) >= 2) & (F.length(w) >= 2) & (F.startswith(w, t) | F.endswith(w, t))))
        return F.when(w.rlike("[A-Za-z0-9]"), F.array_contains(own, w)).otherwise(part)

    ratio = F.coalesce(F.try_divide(F.size(F.filter(words, hit)), F.size(words)), F.lit(0.0))
    return F.when(F.size(tags) == 0, "none").when(ratio >= 1, "strong").when(ratio >= 0.5, "medium").when(ratio > 0, "weak").otherwise("none")


def points(level: Column) -> Column:
    return F.when(level == "strong", 10.0).when(level == "medium", 6.0).when(level == "weak", 2.0).otherwise(0.0)


def rerank(pool: DataFrame, query: str, as_of: str, workspace: str | None = None) -> DataFrame:
    """pool(memory columns, fusion, evidence_rank) with the parts of the score and the final one."""
    subject, tags = surface_level(query, F.col("subject")), tag_level(query, F.col("tags"))
    q = anchors(F.lit(query))
    specific, generic = anchor_hits(q, anchors("content"))
    whole = F.contains(F.lower("content"), F.lit(query.strip().lower()))
    out = pool.withColumns({"subject_level": subject, "tag_level": tags, "content_score": F.when(whole, 3.0).when(specific + generic >= 2, 1.5).otherwise(0.0)})
    missed = (F.col("subject_level") == "none") & (F.col("tag_level") == "none") & (F.col("content_score") > 0)
    faint = F.col("subject_level").isin("none", "weak") & F.col("tag_level").isin("none", "weak") & (F.length("content") > 2000) & (F.col("content_score") > 0)
    relevance = points(F.col("subject_level")) + points(F.col("tag_level")) + F.col("content_score") - F.when(missed, 2.0).otherwise(0.0) - F.when(faint, 1.5).otherwise(0.0)
    relevance = F.when(F.col("evidence_rank").isNotNull(), F.greatest(relevance, F.lit(2.5))).otherwise(relevance)
    trust = F.when((F.col("source_type") == "user_confirmed") | (F.col("protection_level") == "locked"), 0.5).when(F.col("source_type") == "document_extracted", 0.3).otherwise(0.0)
    age = F.datediff(F.lit(as_of).cast("date"), "ingest_time")
    recency = F.when(age < 0, 0.0).when(age <= 7, 0.30).when(age <= 30, 0.15).when(age <= 90, 0.05).otherwise(0.0)
    nudge = F.lit(0.0) if not workspace else F.when(F.col("ws") == workspace, 0.30).otherwise(-0.15)
    out = out.withColumns({"relevance": relevance, "trust": trust, "recency": F.coalesce(recency, F.lit(0.0)), "ws_adjust": nudge})
    final = F.col("relevance") + RRF_WEIGHT * F.col("fusion") + F.col("trust") + F.col("recency") + F.col("ws_adjust") - F.when(F.col("status") == "superseded", 1000.0).otherwise(0.0)
    return out.withColumn("final_score", final)


def source_rank(source: Column) -> Column:
    return F.when(source == "user_confirmed", 100).when(source == "document_extracted", 70).when(source == "agent_generated", 45).when(source == "pending", 20).when(source == "unknown", 10).otherwise(0)


def protected(prefix: str = "") -> Column:
    return (F.col(f"{prefix}source_type") == "user_confirmed") | F.col(f"{prefix}protection_level").isin("locked", "protected")


def arbitrate_pairs(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Joined pairs of records with the winner (left, right, manual_review, tie) and the deciding reason."""
    names = ("id", "source_type", "protection_level", "event_time", "ingest_time", "confidence")
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in names], *[c for c in left.columns if c not in names])
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in names])
    pairs = a.join(b, on)
    lp, rp = protected("l_"), protected("r_")
    old = F.lit("0001-01-01").cast("date")
    out = F.when(lp & ~rp, F.struct(F.lit("left").alias("winner"), F.lit("protected").alias("reason")))
    out = out.when(rp & ~lp, F.struct(F.lit("right").alias("winner"), F.lit("protected").alias("reason")))
    out = out.when(lp & rp, F.struct(F.lit("manual_review").alias("winner"), F.lit("both_protected").alias("reason")))
    ranked = [
        ("event_time", F.coalesce("l_event_time", old), F.coalesce("r_event_time", old)),
        ("source_type", source_rank(F.col("l_source_type")), source_rank(F.col("r_source_type"))),
        ("confidence", F.coalesce("l_confidence", F.lit(0.0)), F.coalesce("r_confidence", F.lit(0.0))),
        ("ingest_time", F.coalesce("l_ingest_time", old), F.coalesce("r_ingest_time", old)),
    ]
    for reason, x, y in ranked:
        out = out.when(x > y, F.struct(F.lit("left").alias("winner"), F.lit(reason).alias("reason"))).when(x < y, F.struct(F.lit("right").alias("winner"), F.lit(reason).alias("reason")))
    out = out.otherwise(F.struct(F.lit("tie").alias("winner"), F.lit("equivalent").alias("reason")))
    return pairs.withColumn("d", out).select("l_id", "r_id", "d.winner", "d.reason")


def arbitrate_groups(records: DataFrame, by: str) -> DataFrame:
    """The winner of each group: its one protected record, else the best by the fixed order; none with several protected, or on a tie."""
    old = F.lit("0001-01-01").cast("date")
    order = F.coalesce("event_time", old), source_rank(F.col("source_type")), F.coalesce("confidence", F.lit(0.0)), F.coalesce("ingest_time", old)
    guard = protected()
    # the best by the order, with the largest and with the smallest id: two ids are a tie
    g = records.groupBy(by).agg(F.count("*").alias("records"), F.count_if(guard).alias("protected"), F.max(F.when(guard, F.col("id"))).alias("only"), F.max(F.struct(*order, F.col("id").alias("id"))).alias("x"), F.max(F.struct(*order, (-F.col("id")).alias("id"))).alias("y"))
    one = F.when(F.col("protected") == 1, F.col("only")).when((F.col("protected") == 0) & (F.col("x.id") == -F.col("y.id")), F.col("x.id"))
    return g.select(by, "records", "protected", one.alias("winner"))


def pairwise_accuracy(scored: DataFrame) -> DataFrame:
    """scored(query, relevance, score): the share of pairs with unequal relevance in the right order, ties half, by query."""
    # by distinct (relevance, score) with counts, so that a large query is no product of its rows
    cells = scored.groupBy("query", "relevance", "score").agg(F.count("*").alias("n"))
    a = cells.select("query", F.col("relevance").alias("ra"), F.col("score").alias("sa"), F.col("n").alias("na"))
    b = cells.select("query", F.col("relevance").alias("rb"), F.col("score").alias("sb"), F.col("n").alias("nb"))
    pairs = a.join(b, "query").where("ra > rb")
    good = F.when(F.col("sa") > F.col("sb"), 1.0).when(F.col("sa") == F.col("sb"), 0.5).otherwise(0.0)
    return pairs.groupBy("query").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), (F.sum(good * F.col("na") * F.col("nb")) / F.sum(F.col("na") * F.col("nb"))).alias("accuracy"))


def ranking_quality(scored: DataFrame, k: int = 10) -> DataFrame:
    """scored(query, id, relevance, score): nDCG at k, reciprocal rank, recall at 3 and k, by query."""
    by = Window.partitionBy("query")
    ranked = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id"))).withColumn("ideal", F.row_number().over(by.orderBy(F.desc("relevance"), "id")))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("relevance") / F.log2(F.col(r) + 1)).otherwise(0.0))
    first = F.min(F.when(F.col("relevance") > 0, F.col("rank")))
    return ranked.groupBy("query").agg(
        F.coalesce(F.try_divide(gain("rank"), gain("ideal")), F.lit(0.0)).alias("ndcg"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.max(F.when((F.col("rank") <= 3) & (F.col("relevance") > 0), 1).otherwise(0)).alias("recall_3"),
        F.max(F.when((F.col("rank") <= k) & (F.col("relevance") > 0), 1).otherwise(0)).alias("recall_k"))


def golden_outcomes(rankings: DataFrame, golden: DataFrame, modes: Sequence[str], most: int = 10) -> DataFrame:
    """How each mode of ranking answers queries of which the right answers are known, a row for each mode and query.

    rankings(mode, query, id, place from 1, fallback): fallback where a row was found by no match but for being recent; places
    after ``most`` don't count.  golden(query, top1, top3, before of (better, worse)), a query once.  A null top1 is no hit;
    an empty or null top3 is right without being a hit.  A pair is passed if the better one is there and
    the worse one is behind it or not there.  A query without results has hit and passed nothing.
    """
    shown = rankings.where(F.col("place") <= most).groupBy("mode", "query").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("r"), F.max(F.coalesce("fallback", F.lit(False))).alias("fell"))
    none = F.array().cast("array<bigint>")
    asked = golden.select(F.explode(F.array(*map(F.lit, modes))).alias("mode"), "query", "top1", F.coalesce(F.col("top3").cast("array<bigint>"), none).alias("top3"), "before")
    ids = F.coalesce(F.transform("r", lambda x: x["id"].cast("long")), none)
    j = asked.join(shown, ["mode", "query"], "left").withColumn("ids", ids)
    at = lambda x: F.coalesce(F.array_position("ids", x.cast("long")), F.lit(0))
    passed = F.filter("before", lambda p: (at(p["better"]) > 0) & ((at(p["worse"]) == 0) | (at(p["better"]) < at(p["worse"]))))
    hit3 = F.coalesce(F.arrays_overlap(F.slice("ids", 1, 3), "top3"), F.lit(False))
    return j.select(
        "mode", "query", F.coalesce(F.get("ids", F.lit(0)) == F.col("top1"), F.lit(False)).alias("top1_hit"), hit3.alias("top3_hit"), ((F.size("top3") == 0) | hit3).alias("top3_right"),
        F.coalesce(F.size("before"), F.lit(0)).alias("pairs"), F.coalesce(F.size(passed), F.lit(0)).alias("passed"), F.coalesce("fell", F.lit(False)).alias("fallback"))


def golden_rates(outcomes: DataFrame) -> DataFrame:
    """By mode: queries, hits and their shares of all queries, pairs passed and their share of all pairs (0 of none), fallbacks."""
    share = lambda x, of: F.coalesce(F.try_divide(x, of), F.lit(0.0))
    n, pairs, passed = F.count("*"), F.sum("pairs"), F.sum("passed")
    top1, top3, fell = F.count_if("top1_hit"), F.count_if("top3_hit"), F.count_if("fallback")
    return outcomes.groupBy("mode").agg(
        n.alias("queries"), top1.alias("top1_hits"), share(top1, n).alias("top1_rate"), top3.alias("top3_hits"), share(top3, n).alias("top3_rate"),
        pairs.alias("pairs"), passed.alias("passed"), share(passed, pairs).alias("pairwise_rate"), share(fell, n).alias("fallback_rate"))
