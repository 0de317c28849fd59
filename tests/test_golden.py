"""Golden queries: hits, pairs and rates by mode of ranking."""

from factloom.operators import ranking as R

RANKING = "mode string, query string, id long, place int, fallback boolean"
GOLDEN = "query string, top1 long, top3 array<long>, before array<struct<better:long,worse:long>>, note string"


def listed(mode, query, *ids, fallback=None):
    return [(mode, query, i, k + 1, fallback) for k, i in enumerate(ids)]


def outcomes(spark, rankings, golden, modes=("a", "b")):
    out = R.golden_outcomes(spark.createDataFrame(rankings, RANKING), spark.createDataFrame(golden, GOLDEN), modes)
    return out, {(x.mode, x.query): tuple(x)[2:] for x in out.collect()}


def test_hits_pairs_and_rates(spark):
    rankings = listed("a", "p", 1, 2, 3, 4) + listed("b", "p", 4, 3, 2, 1) + listed("a", "q", *range(10, 22), fallback=True) + listed("b", "r", 7) + listed("c", "p", 1)
    golden = [
        ("p", 1, [1, 9], [(1, 4), (4, 1), (3, 8), (8, 3)], "n"),  # right order, wrong order, worse one not there, better one not there
        ("q", 21, [13], [(10, 20), (20, 10), (20, 21)], "n"),  # the eleventh is not seen
        ("r", None, [], [], "n"), ("s", 5, None, None, "n")]
    out, got = outcomes(spark, rankings, golden)
    assert got == {
        ("a", "p"): (True, True, True, 4, 2, False), ("b", "p"): (False, False, False, 4, 2, False), ("a", "q"): (False, False, False, 3, 1, True), ("b", "q"): (False, False, False, 3, 0, False),
        ("a", "r"): (False, False, True, 0, 0, False), ("b", "r"): (False, False, True, 0, 0, False), ("a", "s"): (False, False, True, 0, 0, False), ("b", "s"): (False, False, True, 0, 0, False)}
    rates = {x.mode: tuple(x)[1:] for x in R.golden_rates(out).collect()}
    assert rates == {"a": (4, 1, 0.25, 1, 0.25, 7, 3, 3 / 7, 0.25), "b": (4, 0, 0.0, 0, 0.0, 7, 2, 2 / 7, 0.0)}


def test_rows_in_any_order_and_empty_tables(spark):
    got = outcomes(spark, listed("a", "p", 5, 6, 7)[::-1], [("p", 5, [7], [(5, 7), (7, 7)], None)], ["a"])[1]
    assert got == {("a", "p"): (True, True, True, 2, 1, False)}
    out, got = outcomes(spark, [], [("p", 1, [1], [(1, 2)], None)], ["a"])
    assert got == {("a", "p"): (False, False, False, 1, 0, False)} and R.golden_rates(out).first()[1:] == (1, 0, 0.0, 0, 0.0, 1, 0, 0.0, 0.0)
    assert outcomes(spark, listed("a", "p", 1), [])[1] == {}
