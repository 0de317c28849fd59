"""Lexical recall: phrase matches over content, tags and subject, BM25, substring channels, gating."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import CJK, strings

SURFACES = ("content", "tags_text", "subject")


def with_tags_text(memories: DataFrame) -> DataFrame:
    return memories.withColumn("tags_text", F.array_join("tags", " "))


def compile_query(query: str) -> list[list[str]]:
    """Groups of phrases: every group must match, by any of its phrases.

    A word is one phrase; a word with CJK is the alternatives of its trigrams, none if it is shorter.
    """
    out = []
    for word in query.split():
        if re.search(f"[{CJK}]", word):
            clean = "".join(c for c in word if re.match(f"[{CJK}]", c) or c.isalnum())
            out.append([clean[i : i + 3] for i in range(len(clean) - 2)])
        else:
            out.append([word])
    return [g for g in out if g]


def phrase_hit(phrase: str) -> Column:
    """Trigram semantics: a phrase of three or more characters is a substring of any surface, in any case."""
    if len(phrase) < 3:
        return F.lit(False)
    hit = F.lit(False)
    for s in SURFACES:
        hit = hit | F.contains(F.lower(s), F.lit(phrase.lower()))
    return hit


def match_all(groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(bool(groups))
    for g in groups:
        one = F.lit(False)
        for p in g:
            one = one | phrase_hit(p)
        out = out & one
    return out


def match_any(groups: Sequence[Sequence[str]]) -> Column:
    out = F.lit(False)
    for g in groups:
        for p in g:
            out = out | phrase_hit(p)
    return out


def occurrences(lower: Column, phrase: str) -> Column:
    """How often a phrase stands in a lower-case text, overlaps counted."""
    if any(phrase.startswith(phrase[k:]) for k in range(1, len(phrase))):  # it may overlap itself
        return F.regexp_count(lower, F.lit(f"(?={re.escape(phrase)})"))
    return ((F.length(lower) - F.length(F.replace(lower, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def bm25(memories: DataFrame, groups: Sequence[Sequence[str]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Matching rows with their score.  Lengths and document frequencies are over all rows; a phrase's
    frequency counts overlapping occurrences; a length is the number of trigrams of all surfaces."""
    phrases = list(dict.fromkeys(p.lower() for g in groups for p in g if len(p) >= 3))
    if not phrases:
        return memories.where("false").withColumn("bm25", F.lit(0.0))
    length = sum((F.greatest(F.length(s) - 2, F.lit(0)) for s in SURFACES), F.lit(0))
    low = memories.withColumns({f"low_{s}": F.lower(s) for s in SURFACES} | {"length": length})
    rows = low.withColumns({f"tf{i}": sum((F.coalesce(occurrences(F.col(f"low_{s}"), p), F.lit(0)) for s in SURFACES), F.lit(0)) for i, p in enumerate(phrases)})
    stats = rows.agg(F.count("*").alias("rows_"), F.avg("length").alias("mean_"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    score, met = F.lit(0.0), F.lit(True)
    for i in range(len(phrases)):
        n, t = F.col(f"n{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("rows_") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("length") / F.col("mean_")))
    # a row matches if of each group some phrase occurs; shorter ones are no phrases and have no counts
    for g in groups:
        known = [F.col(f"tf{phrases.index(p.lower())}") > 0 for p in g if len(p) >= 3]
        met = met & (reduce(or_, known) if len(known) == len(g) else match_all([g]))
    return rows.where(met).join(F.broadcast(stats)).withColumn("bm25", score).select(*memories.columns, "bm25")


def like_ascii(column: str, pattern: str) -> Column:
    """LIKE with ASCII case folding only; the pattern is taken as it is, with its wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = str.maketrans(upper, lower)
    return F.translate(column, upper, lower).like("%" + pattern.translate(fold).replace("\\", "\\\\") + "%")


def gated(channels: Sequence[DataFrame], cap: int) -> DataFrame:
    """channels(id, pos) in order of precedence: first occurrences, a channel only as far as the pool has room."""
    tagged = None
    for k, c in enumerate(channels):
        c = c.select("id", F.lit(k).alias("channel"), "pos")
        tagged = c if tagged is None else tagged.unionByName(c)
    first = tagged.groupBy("id").agg(F.min(F.struct("channel", "pos")).alias("x")).select("id", "x.*")
    return first.orderBy("channel", "pos", "id").limit(cap)


def overlap_shortlist(memories: DataFrame, tags: Sequence[str], phrases: Sequence[str], recent: int, limit: int) -> DataFrame:
    """Rows like a new one: phrase matches and the newest rows pooled; tags that half of the pool has say nothing."""
    live = with_tags_text(memories.where("status = 'active'"))
    newest = live.orderBy(F.desc("ingest_time"), F.desc("id")).limit(recent)
    pool = live.where(match_any([[p] for p in phrases])).select("id").unionByName(newest.select("id")).distinct()
    rows = live.join(pool, "id")
    size = rows.agg(F.count("*").alias("size"))
    own = rows.select("id", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag")).where(F.col("tag").isin(*[t.lower() for t in tags]))
    telling = own.groupBy("tag").count().join(F.broadcast(size)).where(~((F.col("count") + 1 >= 3) & (F.col("count") * 2 >= F.col("size")))).select("tag")
    by_tag = own.join(telling, "tag").groupBy("id").agg(F.count("*").alias("tag_hits"))
    subject = F.size(F.filter(strings([p.lower() for p in phrases]), lambda p: F.contains(F.lower("subject"), p)))
    scored = rows.join(by_tag, "id", "left").select("id", "ingest_time", F.coalesce("tag_hits", F.lit(0)).alias("tag_hits"), subject.cast("long").alias("subject_hits"))
    both = (F.col("tag_hits") > 0) & (F.col("subject_hits") > 0)
    return scored.where("tag_hits > 0 or subject_hits > 0").orderBy(F.desc(both), F.desc("tag_hits"), F.desc("subject_hits"), F.desc("ingest_time"), F.desc("id")).limit(limit)


def linked_open_items(memories: DataFrame, hits: DataFrame, per_tag: int = 2, limit: int = 5) -> DataFrame:
    """Open todo rows that share a telling tag with the hits(id): at most per_tag a tag, limit in all."""
    live = memories.where("status = 'active'")
    tags = live.select("id", "ws", "ingest_time", F.explode(F.array_distinct("tags")).alias("tag"))
    total = live.agg(F.count("*").alias("total"))
    common = tags.groupBy("tag").count().join(F.broadcast(total)).where((F.col("count") >= 3) & (F.col("count") / F.col("total") >= 0.20)).select("tag")
    telling = tags.where((F.length("tag") > 1) & (F.col("tag") != "todo")).join(common, "tag", "left_anti")
    wanted = telling.join(hits, "id", "left_semi").select("tag").distinct()
    todo = live.where(F.array_contains("tags", "todo")).select("id").join(hits, "id", "left_anti")
    shared = telling.join(wanted, "tag").join(todo, "id")
    first = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("ingest_time"), F.desc("id")))
    best = shared.withColumn("k", first).where(F.col("k") <= per_tag)
    return best.groupBy("id", "ingest_time").agg(F.count("*").alias("shared_tags")).orderBy(F.desc("shared_tags"), F.desc("ingest_time"), F.desc("id")).limit(limit)
