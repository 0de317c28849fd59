"""Workspace names: quality, keys, resolution by alias, spelling and closeness, and the rule on the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.vector import DEFAULT_TERMS, GENERIC_TERMS

KEEP_CUES = ["参考", "借鉴", "模板", "经验", "月报", "指标", "复盘", "通用", "template", "reference", "benchmark"]  # fixed values


def quality(ws: Column) -> Column:
    s = F.trim(F.coalesce(ws, F.lit("")))
    low = F.lower(s)
    return (
        F.when(s == "", "empty").when(low.isin(*DEFAULT_TERMS), "default")
        .when((F.length(s) > 80) | s.rlike(r"[\\/\n\t]|https?://"), "suspicious").when(low.isin(*GENERIC_TERMS), "generic").otherwise("specific")
    )


def alias_key(ws: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(ws, F.lit("")), r"(?U)\s+", " ")))


def mechanical_key(ws: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(ws, F.lit("")), r"(?U)[\s_\-]+", ""))


def resolve(names: DataFrame, canonicals: DataFrame, aliases: DataFrame, near: DataFrame, limit: float = 0.25) -> DataFrame:
    """names(ws) to ws, canonical, matched_by: default, confirmed_alias, exact, mechanical, vector, new.

    canonicals(name), aliases(alias, canonical, status, updated_at), near(ws, name, distance).
    """
    n = names.select("ws").distinct().withColumns({"k": alias_key(F.col("ws")), "mk": mechanical_key(F.col("ws"))})
    said = aliases.where("status = 'confirmed'").select(alias_key(F.col("alias")).alias("k"), "canonical", "updated_at")
    said = said.groupBy("k").agg(F.max_by("canonical", F.struct("updated_at", "canonical")).alias("by_alias"))
    same = canonicals.select(F.col("name").alias("ws"), F.col("name").alias("by_name"))
    spelled = canonicals.groupBy(mechanical_key(F.col("name")).alias("mk")).agg(F.min("name").alias("by_key")).where("mk <> ''")
    no = aliases.where("status = 'rejected'").select(alias_key(F.col("alias")).alias("k"), F.col("canonical").alias("name"))
    close = near.where(F.col("distance") <= limit).withColumn("k", alias_key(F.col("ws"))).join(no, ["k", "name"], "left_anti").groupBy("ws").agg(F.min_by("name", F.struct("distance", "name")).alias("by_vector"))
    out = n.join(F.broadcast(said), "k", "left").join(same, "ws", "left").join(spelled, "mk", "left").join(close, "ws", "left")
    default = quality(F.col("ws")).isin("empty", "default")
    how = (
        F.when(default, "default").when(F.col("by_alias").isNotNull(), "confirmed_alias").when(F.col("by_name").isNotNull(), "exact")
        .when(F.col("by_key").isNotNull(), "mechanical").when(F.col("by_vector").isNotNull(), "vector").otherwise("new")
    )
    return out.select("ws", F.when(default, F.lit("default")).otherwise(F.coalesce("by_alias", "by_name", "by_key", "by_vector", "ws")).alias("canonical"), how.alias("matched_by"))


def rule(resolved: DataFrame, similar: DataFrame) -> DataFrame:
    """resolved(ws, canonical, matched_by, hint), similar(ws, distance, rejected, name) to the decision and its reason."""
    by = Window.partitionBy("ws").orderBy("distance", "name")
    ranked = similar.where("not rejected").withColumn("next", F.lead("distance").over(by)).withColumn("k", F.row_number().over(by))
    first = ranked.where("k = 1").select("ws", F.lit(True).alias("similar"), (F.col("next") - F.col("distance")).alias("gap"))
    turned = similar.where("rejected").select("ws", F.col("name").alias("canonical"), F.lit(True).alias("turned")).distinct()
    j = resolved.join(first, "ws", "left").join(turned, ["ws", "canonical"], "left").withColumn("q", quality(F.col("ws")))
    cue = F.lit(False)
    for c in KEEP_CUES:
        cue = cue | F.contains(F.lower(F.concat_ws(" ", "ws", "hint")), F.lit(c))
    out = lambda d, r: F.struct(F.lit(d).cast("string").alias("decision"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    how, vector_ = F.col("matched_by"), F.col("matched_by") == "vector"
    d = (
        F.when(how.isin("confirmed_alias", "exact"), out("AUTO", how)).when(vector_ & cue, out("KEEP", "reference_material"))
        .when(F.coalesce("turned", F.lit(False)), out("KEEP", "rejected_pair")).when(F.col("q") != "specific", out("ASK", F.concat(F.lit("low_signal_"), "q")))
        .when(vector_ & (F.abs("gap") < 0.05), out("ASK", "candidate_near_tie")).when(vector_, out("AUTO", "vector_strong"))
        .when((how == "new") & F.col("similar"), out(None, "near_miss_candidates")).when(how == "new", out("AUTO", "new_specific_canonical")).otherwise(out(None, "undecided"))
    )
    return j.withColumn("d", d).select("ws", "canonical", "matched_by", "d.decision", "d.reason")
