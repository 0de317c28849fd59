"""Where two tables differ: trees of digests over ranges of ids, compared from the top down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.commits import written

LEAF, FANOUT, LEVELS = 1_000, 100, 3


def leaves(rows: DataFrame, line: Column, leaf: int = LEAF) -> DataFrame:
    """rows with ``id`` to (range, n, d1, d2): how many lines a range of ids has, and two sums of parts of their digests.

    Sums don't depend on the order of rows and are combined before the shuffle; ids are not null.
    """
    of = F.sha2(F.concat_ws("|", F.col("id").cast("string"), line).cast("binary"), 256)
    part = lambda at: F.sum(F.conv(F.substr(of, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return rows.groupBy(F.expr(f"id div {leaf}").alias("range")).agg(F.count("*").alias("n"), part(1).alias("d1"), part(16).alias("d2"))


def above(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level of a tree over this one."""
    total = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    return level.groupBy(F.expr(f"range div {fanout}").alias("range")).agg(F.sum("n").alias("n"), total("d1"), total("d2"))


def grown(bottom: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, keep=written) -> list[DataFrame]:
    """All levels over the leaves, from the bottom up, each written in the order of its ranges."""
    out = [keep(bottom.repartitionByRange("range").sortWithinPartitions("range"), "digests")]
    for _ in range(levels - 1):
        out.append(keep(above(out[-1], fanout).repartitionByRange("range").sortWithinPartitions("range"), "digests"))
    return out


def tree(rows: DataFrame, line: Column, *, leaf: int = LEAF, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    return grown(leaves(rows, line, leaf), fanout, levels)


def hull(wanted: DataFrame, column: Column, times: int = 1, most: int = 64) -> Column:
    """A condition that all rows fulfil whose ``column div times`` is a wanted range, and few others: at most ``most`` intervals.

    Intervals reach the scan, which then leaves out files and row groups; an exact join has to follow.
    """
    first, last = wanted.agg(F.min("range"), F.max("range")).first()
    if first is None:
        return F.lit(False)
    width = (last - first) // most + 1
    found = wanted.groupBy(F.expr(f"(range - {first}L) div {width}L")).agg(F.min("range").alias("a"), F.max("range").alias("b")).collect()
    # a quotient of nought is met from both sides
    low = lambda r: r * times if r > 0 else (r - 1) * times + 1
    high = lambda r: (r + 1) * times - 1 if r >= 0 else r * times
    return reduce(lambda x, y: x | y, [column.between(low(r.a), high(r.b)) for r in found])


def differing(one: list[DataFrame], two: list[DataFrame], fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """The ranges of leaves in which two trees differ, and what was compared on each level, from the top down.

    Below the top only ranges are read whose parent differs.
    """
    wanted, compared = None, []
    for a, b in zip(reversed(one), reversed(two)):
        if wanted is not None:
            near = hull(wanted, F.col("range"), fanout)
            parents = wanted.withColumnRenamed("range", "parent")
            a, b = (x.where(near).join(parents, F.expr(f"range div {fanout}") == F.col("parent"), "left_semi") for x in (a, b))
        facts = F.struct("n", "d1", "d2")
        both = a.select("range", facts.alias("x")).join(b.select("range", facts.alias("y")), "range", "full")
        compared.append(written(both.select("range", F.col("x").eqNullSafe(F.col("y")).alias("same")), "compared"))
        wanted = compared[-1].where("not same").select("range")
    return wanted, compared


def changes(one: DataFrame, two: DataFrame, lines: Column, ranges: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(id, kind) of the rows of differing ranges: changed, missing (in two) or extra (in two); ids are keys."""
    near, known = hull(ranges, F.col("id"), leaf), ranges.withColumnRenamed("range", "part")
    of = lambda df, name: df.where(near).join(known, F.expr(f"id div {leaf}") == F.col("part"), "left_semi").select("id", lines.alias(name), F.lit(True).alias(f"in_{name}"))
    both = of(one, "x").join(of(two, "y"), "id", "full").where("in_x is null or in_y is null or not (x <=> y)")
    return both.select("id", F.when(F.col("in_y").isNull(), "missing").when(F.col("in_x").isNull(), "extra").otherwise("changed").alias("kind"))
