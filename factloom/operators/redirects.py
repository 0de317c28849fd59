"""Moves of workspaces: folded in their order into redirects, registry and places of records; chains of redirects resolved."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.links import components
from factloom.operators.vector import DEFAULT_TERMS
from factloom.operators.workspace import alias_key, mechanical_key
from factloom.sources.commits import written


def follow(redirects: DataFrame, most_rounds: int = 60) -> DataFrame:
    """redirects(name, target), a name once, to (name, target, hops, cyclic): where each chain ends.

    Pointer jumping: every round doubles how far a name sees, so chains of n take log n joins.  A
    chain into a cycle has no end; it is ``cyclic`` and refused: target is the name itself, hops 0.
    Redirects of a name to itself, or from or to null, are none.
    """
    given = redirects.select("name", "target").where("name is not null and target is not null and name <> target")
    now = written(given.select("name", "target", F.lit(1).cast("long").alias("hops")), "redirects")
    names = now.count()
    for _ in range(most_rounds):
        ahead = now.select(F.col("name").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"))
        now = written(now.join(ahead, "target", "left").select("name", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("open")), "redirects")
        # no chain without a cycle has more hops than there are names
        least = now.where("open").agg(F.min("hops")).first()[0]
        if least is None or least > names:
            break
        now = now.drop("open")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select("name", F.when(F.col("open"), F.col("name")).otherwise(F.col("target")).alias("target"), F.when(F.col("open"), 0).otherwise(F.col("hops")).alias("hops"), F.col("open").alias("cyclic"))


class _Names:
    """The names of one component while its moves are folded."""

    def __init__(self, rows: pd.DataFrame):
        of = lambda kind: rows[rows["kind"] == kind].to_dict("records")
        self.keys = {r["a"]: (r["a_key"], r["a_plain"]) for r in of("name")}
        for r in of("move"):
            self.keys |= {r["a"]: (r["a_key"], r["a_plain"]), r["b"]: (r["b_key"], r["b_plain"])}
        self.registry = {r["a"]: r["a"] for r in of("name") if r["c"] == "registry"}
        self.places = {r["a"]: r["a"] for r in of("name") if r["c"] == "record"}
        self.aliases = {(r["a_key"], r["b"]): (r["c"], int(r["seq"])) for r in of("alias")}
        self.moves = sorted(of("move"), key=lambda r: (r["seq"], r["a"], r["b"]))

    def move(self, seq: int, old: str, new: str) -> str:
        """The outcome; names come trimmed."""
        if not old or not new:
            return "invalid_input"
        if old.lower() in DEFAULT_TERMS or new.lower() in DEFAULT_TERMS:
            return "reserved"
        if old == new:
            return "unchanged"
        key, target = self.keys[old][0], self.keys[new][0]
        if old not in self.registry and old not in self.places.values():
            alike = min((x for x in self.registry if x != old and self.keys[x][1] == self.keys[old][1] != ""), default=None)
            said = sorted(((s != "confirmed", -at, c) for (k, c), (s, at) in self.aliases.items() if k == key))
            known = alike or (said[0][2] if said else None)
            if known is not None:
                return "unchanged" if known == new else "competing_move"
        merged = new in self.registry
        origin = self.registry.pop(old, None)
        if origin is not None and not merged:
            self.registry[new] = origin
        self.places = {k: new if v == old else v for k, v in self.places.items()}
        spared = set() if key == target else {key, target}
        follow_ = [(k, said) for (k, c), said in self.aliases.items() if c == old and k not in spared]
        for k, (status, _) in follow_:
            del self.aliases[k, old]
            self.aliases.setdefault((k, new), (status, seq))  # what was said of the new name stands
        # the new name forwards nowhere, and the old one not to itself
        gone = {(target, old), (target, new)} if key != target else {(target, new)}
        if self.aliases.get((key, old), ("",))[0] == "confirmed":
            gone.add((key, old))
        self.aliases = {pair: said for pair, said in self.aliases.items() if pair not in gone}
        if key != target and key and self.aliases.get((key, new), ("",))[0] != "rejected":
            self.aliases = {(k, c): s for (k, c), s in self.aliases.items() if k != key or c == new or s[0] != "confirmed"}
            self.aliases[key, new] = ("confirmed", seq)
        return "merged" if merged and origin is not None else "renamed" if origin is not None else "redirected"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        n = _Names(rows)
        out = [("outcome", int(r["seq"]), r["a"], r["b"], n.move(int(r["seq"]), r["a"], r["b"])) for r in n.moves]
        out += [("place", None, a, b, None) for a, b in n.places.items()]
        out += [("registry", None, a, b, None) for a, b in n.registry.items()]
        out += [("alias", at, k, c, s) for (k, c), (s, at) in n.aliases.items()]
        yield pd.DataFrame(out, columns=["what", "seq", "a", "b", "c"]).astype({"seq": "Int64"})


class Moved:
    """What moves lead to; each part is a DataFrame."""

    def __init__(self, rows: DataFrame):
        self.outcomes = rows.where("what = 'outcome'").select("seq", F.col("a").alias("old"), F.col("b").alias("new"), F.col("c").alias("outcome"))
        self._places = rows.where("what = 'place' and a <> b").select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        self._registry = rows.where("what = 'registry'").select(F.col("b").alias("name"), F.col("a").alias("_now"))
        self._touched = rows.where("what = 'touched'").select(F.col("a").alias("name"))
        self.aliases = rows.where("what = 'alias'").select(F.col("a").alias("alias"), F.col("b").alias("canonical"), F.col("c").alias("status"), F.col("seq").alias("updated_at"))

    def records(self, rows: DataFrame, columns: tuple[str, ...] = ("ws",)) -> DataFrame:
        """Rows (memories, conflicts) with their workspaces as they are now."""
        for c in columns:
            kept = rows.columns
            rows = rows.join(self._places, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).select(*kept)
        return rows

    def registry(self, registry: DataFrame) -> DataFrame:
        """The registry as it is now: a merged name is gone with its vector; a renamed one keeps its row."""
        rest = registry.join(self._touched, "name", "left_anti")
        stay = registry.join(self._registry, "name").withColumn("name", F.col("_now")).select(*registry.columns)
        return rest.unionByName(stay)


def fold_moves(moves: DataFrame, registry: DataFrame, places: DataFrame, aliases: DataFrame) -> Moved:
    """moves(seq, old, new) in order of seq over registry(name, ...), places(ws) and aliases(alias, canonical, status, updated_at as a number).

    A move takes all records and the registry's row of ``old`` to ``new``, or merges it into a row that
    is there; aliases of old point to new, and old itself is redirected unless that was rejected.  So
    chains stay flat, and a move back makes the first name a canonical again instead of closing a cycle.  Refused: blank names
    (``invalid_input``), the common pool (``reserved``), a name that is gone and was decided otherwise
    (``competing_move``).  Names that share a spelling, a move or an alias are folded in one task; records aren't in it.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    none = F.lit(None).cast("string")
    m = moves.select(F.lit("move").alias("kind"), F.col("seq").cast("long").alias("seq"), text(F.col("old")).alias("a"), text(F.col("new")).alias("b"), none.alias("c"))
    names = registry.select("name", F.lit("registry").alias("c")).unionByName(places.select(F.col("ws").alias("name"), F.lit("record").alias("c"))).where("name is not null").distinct()
    n = names.select(F.lit("name").alias("kind"), F.lit(None).cast("long").alias("seq"), F.col("name").alias("a"), none.alias("b"), "c")
    s = aliases.select(F.lit("alias").alias("kind"), F.col("updated_at").cast("long").alias("seq"), F.col("alias").alias("a"), F.col("canonical").alias("b"), F.col("status").alias("c"))
    every = m.unionByName(n).unionByName(s).withColumns({"a_key": alias_key(F.col("a")), "a_plain": mechanical_key(F.col("a")), "b_key": alias_key(F.col("b")), "b_plain": mechanical_key(F.col("b"))})
    every = written(every, "moves")
    # nodes are spellings; a move or an alias joins two of them
    links = components(every.select(F.col("a_plain").alias("a"), F.when(F.col("kind") == "name", F.col("a_plain")).otherwise(F.col("b_plain")).alias("b")))
    dealt = every.join(links.select(F.col("node").alias("a_plain"), "component"), "a_plain")
    busy = every.where("kind = 'move'").select("a_plain").distinct().join(links.select(F.col("node").alias("a_plain"), "component"), "a_plain").select("component").distinct()
    dealt = written(dealt.join(busy, "component", "left_semi"), "dealt")
    schema = "what string, seq long, a string, b string, c string"
    out = dealt.groupBy("component").applyInPandas(lambda rows: next(_fold(iter([rows]))), schema)
    touched = dealt.where("kind = 'name'").select(F.lit("touched").alias("what"), F.lit(None).cast("long").alias("seq"), "a", none.alias("b"), none.alias("c")).distinct()
    rest = every.where("kind = 'alias'").join(dealt.select("a_plain").distinct(), "a_plain", "left_anti").select(F.lit("alias").alias("what"), "seq", F.col("a_key").alias("a"), "b", "c")
    return Moved(written(out.unionByName(touched).unionByName(rest), "moved"))
