"""Streaming index upkeep and attention volume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from factloom.operators.evidence import pair_gate
from factloom.operators.lifecycle import notice_pairs
from factloom.operators.pairs import features, pair_rule
from factloom.operators.segment import segment
from factloom.operators.vector import batch_knn


def latest_versions(batch: DataFrame) -> DataFrame:
    """The newest snapshot of each memory in a batch; a newer one replaces those that wait."""
    columns = [c for c in batch.columns if c != "id"]
    return batch.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("x")).select("id", "x.*")


def index_stream(snapshots: DataFrame, path: str, checkpoint: str):
    """Segment snapshots(id, version, subject, content) of a stream into a table of units, a folder a batch.

    A batch that is run again overwrites its own folder.
    """

    def publish(batch: DataFrame, number: int) -> None:
        segment(latest_versions(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return snapshots.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_only(snapshots: DataFrame) -> DataFrame:
    """A stream's snapshots(id, version) that are newer than any seen before, with a count of the stale ones."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, stale = state.get if state.exists else (-1, 0)
        for f in frames:
            for v in f["version"]:
                newest, stale = (int(v), stale) if v > newest else (newest, stale + 1)
        state.update((newest, stale))
        yield pd.DataFrame({"id": [key[0]], "version": [newest], "stale": [stale]})

    return snapshots.groupBy("id").applyInPandasWithState(step, "id long, version long, stale long", "newest long, stale long", "update", "NoTimeout")


def attention_volume(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """events(ts, event_type) of a stream counted by windows, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def notices_for(batch: DataFrame, published: DataFrame, *, k: int = 5, most_units: int = 24, most_pairs: int = 2, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What a batch of new units may disagree with: anchor, peer, action, distance, reason and place.

    units(unit_id, memory_id, unit_index, text, embedding); of each memory its first ``most_units`` are
    searched for, of each peer the nearest hit counts, and at most ``most_pairs`` peers are given.
    extract(pairs of quote_a and quote_b) adds what was read out of a pair in either order, ``forward`` and
    ``reverse`` (structs of the four fields, or null); then only pairs that pass the gate of both directions count.
    """
    new = batch.where(F.col("unit_index") < most_units)
    near = batch_knn(published, new, k)
    a = new.select(F.col("unit_id").alias("anchor_id"), F.col("memory_id").alias("anchor"), features(F.col("text")).alias("fa"))
    b = published.select("unit_id", F.col("memory_id").alias("peer"), features(F.col("text")).alias("fb"))
    found = near.join(a, "anchor_id").join(b, "unit_id").withColumn("d", pair_rule(F.col("fa"), F.col("fb"))).where("d.action <> 'ignore'")
    if extract is not None:
        quotes = batch.select(F.col("unit_id").alias("anchor_id"), F.col("text").alias("quote_a"))
        others = published.select("unit_id", F.col("text").alias("quote_b"))
        read = extract(found.drop("fa", "fb").join(quotes, "anchor_id").join(others, "unit_id"))
        gate = pair_gate(F.col("forward"), F.col("reverse"), F.col("quote_a"), F.col("quote_b"))
        found = read.withColumn("gate", gate).where("gate.state = 'notice_ready'").withColumn("d", F.struct(F.lit("notify").alias("action"), F.col("gate.reason").alias("reason")))
    best = notice_pairs(found.select("anchor", "peer", "d.action", "distance"), most_pairs)
    reasons = found.groupBy("anchor", "peer").agg(F.min_by("d.reason", F.struct("distance", "d.action")).alias("reason"))
    return best.join(reasons, ["anchor", "peer"])


def notice_stream(units: DataFrame, published_path: str, path: str, checkpoint: str, **options):
    """For each micro-batch of new units the notices against what is published then, written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        published = batch.sparkSession.read.parquet(published_path)
        notices_for(batch, published, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return units.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
