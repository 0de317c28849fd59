"""Confirmation of pending records: a workspace chosen for each, the redirect that follows, and the record made active."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.ledger import fold_log
from factloom.operators.links import components
from factloom.operators.vector import DEFAULT_TERMS
from factloom.operators.workspace import alias_key, mechanical_key
from factloom.sources.commits import written

_OUTCOME = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("canonical_after", T.StringType()), T.StructField("redirect", T.BooleanType())])


class _Names:
    """What is known of the names of one component, and which records have been confirmed."""

    def __init__(self, known: list[dict]):
        self.keys: dict[str, tuple[str, str]] = {}
        self.registry: set[str] = set()
        self.spelled: dict[str, str] = {}
        self.aliases: dict[str, dict[str, tuple[str, int]]] = defaultdict(dict)
        self.done: set[int] = set()
        for r in known:
            self.keys[r["name"]] = (r["key"], r["plain"])
            if r["alias"] is None:
                self.register(r["name"])
            else:
                self.aliases[r["alias"]][r["name"]] = (r["status"], r["at"])

    def register(self, name: str) -> None:
        self.registry.add(name)
        plain = self.keys[name][1]
        if plain:
            self.spelled[plain] = min(name, self.spelled.get(plain, name))

    def resolve(self, name: str) -> str:
        key, plain = self.keys[name]
        said = [(c, at) for c, (status, at) in self.aliases.get(key, {}).items() if status == "confirmed"]
        if said:
            return min(said, key=lambda x: (-x[1], x[0]))[0]
        return name if name in self.registry else self.spelled.get(plain, name)


def _step(state: dict | None, e: dict) -> tuple[dict | None, tuple]:
    if not isinstance(state, _Names):
        state = _Names((state or {}).get("known") or [])
    refused = lambda why: (state, (why, None, None))
    if e["id"] in state.done:
        return refused("not_pending")
    raw, chosen = e["raw"], e["chosen"]
    state.keys.setdefault(raw, (e["raw_key"], e["raw_plain"]))
    state.keys.setdefault(chosen, (e["chosen_key"], e["chosen_plain"]))
    if e["raw_default"] and not e["chosen_default"]:
        return refused("reserved")
    if e["raw_default"]:
        chosen = "default"
    elif e["raw_plain"] == e["chosen_plain"]:
        chosen = raw
    else:
        chosen = "default" if e["chosen_default"] else state.resolve(chosen)
    if e["scope"] is not None and (e["ws"] != e["scope"] or chosen != e["scope"]):
        return refused("forbidden")
    redirect = False
    if not e["raw_default"]:
        if chosen.lower() in DEFAULT_TERMS:
            return refused("reserved")
        if state.keys[chosen][0] != e["raw_key"]:
            said = state.aliases[e["raw_key"]]
            if said.get(chosen, ("",))[0] == "rejected" and not e["authorized"]:
                return refused("kept_separate")
            state.aliases[e["raw_key"]] = {c: s for c, s in said.items() if s[0] != "confirmed"} | {chosen: ("confirmed", e["seq"])}
            redirect = True
        state.register(chosen)
    state.done.add(e["id"])
    return state, ("confirmed", chosen, redirect)


class Confirmed:
    """What confirmations lead to: outcomes(seq, id, outcome, canonical), and the tables after them."""

    def __init__(self, rows: DataFrame):
        self._rows = rows
        self.outcomes = rows.select("seq", "id", "outcome", F.col("canonical_after").alias("canonical"))
        self._done = rows.where("outcome = 'confirmed'")

    def records(self, records: DataFrame) -> DataFrame:
        """The records: a confirmed one is active, of a new version, with the workspace chosen."""
        now = self._done.select("id", F.col("canonical_after").alias("_now"))
        taken = F.col("_now").isNotNull()
        j = records.join(now, "id", "left").withColumns({"status": F.when(taken, "active").otherwise(F.col("status")), "workspace_canonical": F.coalesce("_now", "workspace_canonical"), "version": (F.col("version") + taken.cast("int")).cast(records.schema["version"].dataType)})
        return j.select(*records.columns)

    def aliases(self, aliases: DataFrame) -> DataFrame:
        """alias (as a key), canonical, status, updated_at: of a key that was redirected the last redirect, and what was rejected and not redirected to."""
        moved = self._done.where("redirect").select(F.col("raw_key").alias("alias"), F.col("canonical_after").alias("canonical"), "seq")
        last = moved.groupBy("alias").agg(F.max_by("canonical", "seq").alias("canonical"), F.lit("confirmed").alias("status"), F.max("seq").alias("updated_at"))
        old = aliases.select(alias_key(F.col("alias")).alias("alias"), "canonical", "status", F.col("updated_at").cast("long").alias("updated_at"))
        kept = old.join(moved.select("alias", "canonical").distinct(), ["alias", "canonical"], "left_anti")
        kept = kept.join(last.select("alias", F.lit(True).alias("over")), "alias", "left").where("over is null or status <> 'confirmed'").drop("over")
        return kept.unionByName(last)

    def registry(self, registry: DataFrame) -> DataFrame:
        """name of all canonicals, with those that confirmations have added."""
        added = self._done.select(F.col("canonical_after").alias("name")).where("name <> 'default'")
        return registry.select("name").unionByName(added).distinct()


def confirm_pending(records: DataFrame, requests: DataFrame, registry: DataFrame, aliases: DataFrame, scope: str | None = None) -> Confirmed:
    """requests(seq, id, canonical, authorized) in the order of seq over pending records(id, workspace, workspace_canonical, status).

    registry(name), aliases(alias, canonical, status, updated_at as a number).  A name of the same spelling (but for case, blanks, hyphens
    and underscores) confirms the record's own; another is resolved by what is known by then: a confirmed
    redirect, a name of the registry, its spelling, or itself.  If it differs from the record's own, a redirect from
    that is kept, as its only one.  Outcomes: ``confirmed``; ``not_found``, ``not_pending`` (also once confirmed),
    ``reserved`` (the common pool is joined by its own records alone), ``kept_separate`` (a pair that was
    rejected, unless authorized), ``forbidden`` (record or name outside scope).  Refused requests change nothing.

    Null or blank names stand for the common pool; a null authorized for no.  What shares a spelling, a request or an alias is
    folded by one task, in one pass, which holds the component's names and the ids that it has confirmed.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    pool = lambda c: F.lower(F.col(c)).isin(*DEFAULT_TERMS)
    node = lambda key, plain: F.when(F.col(plain) != "", F.col(plain)).otherwise(F.col(key))
    r = records.select("id", text("workspace").alias("raw"), F.trim(F.coalesce(F.when(F.trim("workspace_canonical") != "", F.col("workspace_canonical")), "workspace")).alias("ws"), "status")
    asked = requests.select(F.col("seq").cast("long").alias("seq"), "id", text("canonical").alias("chosen"), F.coalesce("authorized", F.lit(False)).alias("authorized"), F.lit(scope).cast("string").alias("scope"))
    log = asked.join(r, "id", "left").withColumns({f"{c}_{k}": f(F.col(c)) for c in ("raw", "chosen") for k, f in (("key", alias_key), ("plain", mechanical_key))})
    log = log.withColumns({"raw_default": pool("raw"), "chosen_default": pool("chosen"), "at": F.when(pool("raw"), F.concat(F.lit("\t"), F.col("id").cast("string"))).otherwise(node("raw_key", "raw_plain"))})
    log = written(log, "confirmations")
    open_ = log.where("status = 'pending'")
    keyed = lambda df, c: df.withColumns({"key": alias_key(F.col(c)), "plain": mechanical_key(F.col(c))})
    names = keyed(registry.select("name").where("name is not null").distinct(), "name").select("name", "key", "plain", F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("at"))
    said = keyed(aliases.where("alias is not null and canonical is not null").select(F.col("canonical").alias("name"), alias_key(F.col("alias")).alias("alias"), mechanical_key(F.col("alias")).alias("from"), "status", F.col("updated_at").cast("long").alias("at")), "name")
    # nodes are spellings; a request or an alias joins two of them
    edges = (
        open_.where("not raw_default").select(F.col("at").alias("a"), node("chosen_key", "chosen_plain").alias("b"))
        .unionByName(open_.where("raw_default").select(F.col("at").alias("a"), F.col("at").alias("b")))
        .unionByName(said.select(node("alias", "from").alias("a"), node("key", "plain").alias("b"))).distinct())
    whole = components(edges)
    known = names.unionByName(said.drop("from")).withColumn("node", node("key", "plain")).join(whole, "node")
    busy = open_.select("at").distinct().join(whole.withColumnRenamed("node", "at"), "at")
    state = known.join(busy.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.collect_list(F.struct("name", "key", "plain", "alias", "status", F.col("at"))).alias("known"))
    told = fold_log(state, open_.join(busy, "at"), "component", _step, _OUTCOME)
    none = F.lit(None)
    rest = log.where("status is null or status <> 'pending'").select("seq", "id", "raw_key", F.when(F.col("raw").isNull(), "not_found").otherwise("not_pending").alias("outcome"), none.cast("string").alias("canonical_after"), none.cast("boolean").alias("redirect"))
    return Confirmed(written(told.select(*rest.columns).unionByName(rest), "confirmed"))
