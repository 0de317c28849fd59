"""Confirmation of pending records, and snapshots of the registry."""

import random

from factloom.operators import confirm as P
from factloom.sources.reviewed import ReviewedRegistry

RECORD = "id long, workspace string, workspace_canonical string, status string, version int, note string"
REQUEST = "seq long, id long, canonical string, authorized boolean"
ALIAS = "alias string, canonical string, status string, updated_at long"


def run(spark, records, requests, registry=(), aliases=(), scope=None):
    r = spark.createDataFrame([(i, w, None, s, 1, "n") for i, w, s in records], RECORD)
    q = spark.createDataFrame([(n, *x) for n, x in enumerate(requests)], REQUEST)
    names, said = spark.createDataFrame([(x,) for x in registry], "name string"), spark.createDataFrame(list(aliases), ALIAS)
    got = P.confirm_pending(r, q, names, said, scope)
    out = [(x.outcome, x.canonical) for x in got.outcomes.orderBy("seq").collect()]
    return out, {x.id: (x.status, x.workspace_canonical, x.version) for x in got.records(r).collect()}, {tuple(x) for x in got.aliases(said).collect()}, {x.name for x in got.registry(names).collect()}


def test_spellings_redirects_and_repeats(spark):
    records = [(1, "my-team", "pending"), (2, "My  Crew", "pending"), (3, "my crew", "pending"), (4, "x", "active"), (5, "x", "pending")]
    requests = [(1, "My Team", False), (1, "other", True), (2, "my team", False), (3, "MY_CREW", False), (4, "x", True), (9, "x", True), (5, "My Crew", False)]
    out, now, aliases, registry = run(spark, records, requests)
    # the second name is redirected to the first, as the registry has it by then; the last request follows that redirect
    assert out == [("confirmed", "my-team"), ("not_pending", None), ("confirmed", "my-team"), ("confirmed", "my crew"), ("not_pending", None), ("not_found", None), ("confirmed", "my-team")]
    assert now == {1: ("active", "my-team", 2), 2: ("active", "my-team", 2), 3: ("active", "my crew", 2), 4: ("active", None, 1), 5: ("active", "my-team", 2)}
    assert aliases == {("my crew", "my-team", "confirmed", 2), ("x", "my-team", "confirmed", 6)}
    assert registry == {"my-team", "my crew"}


def test_kept_separate_until_authorized(spark):
    records = [(i, "a", "pending") for i in range(1, 6)]
    requests = [(1, "b", False), (1, "b", True), (2, "b", False), (3, "c", None), (4, "b", False), (5, "d", False)]
    out, _, aliases, _ = run(spark, records, requests, ["b"], [("A", "b", "rejected", 1), ("a", "d", "rejected", 1), ("q", "b", "confirmed", 1)])
    assert out == [("kept_separate", None), ("confirmed", "b"), ("confirmed", "b"), ("confirmed", "c"), ("confirmed", "b"), ("kept_separate", None)]
    assert aliases == {("a", "b", "confirmed", 4), ("a", "d", "rejected", 1), ("q", "b", "confirmed", 1)}


def test_the_common_pool_and_nulls(spark):
    records = [(1, None, "pending"), (2, " ", "pending"), (3, "Unknown", "pending"), (4, "w", "pending"), (5, "w", "pending"), (6, "--", "pending"), (7, "w", None)]
    requests = [(1, "w", True), (1, None, None), (2, "none", False), (3, "default", False), (4, "", True), (5, "NULL", True), (6, "__", False), (7, "w", True), (None, "w", True)]
    out, now, _, registry = run(spark, records, requests, [None])
    assert out == [("reserved", None), ("confirmed", "default"), ("confirmed", "default"), ("confirmed", "default"), ("reserved", None), ("reserved", None), ("confirmed", "--"), ("not_pending", None), ("not_found", None)]
    assert now[1] == ("active", "default", 2) and now[4] == ("pending", None, 1) and now[7] == (None, None, 1) and registry == {"--", None}


def test_scope(spark):
    records = [(1, "a", "pending"), (2, "b", "pending"), (3, "a", "pending")]
    out, *_ = run(spark, records, [(1, "b", True), (2, "a", True), (3, "A", False)], scope="a")
    assert out == [("forbidden", None), ("forbidden", None), ("confirmed", "a")]


def test_as_one_after_another(spark):
    r = random.Random(4)
    names = ["a", "A", "b-c", "b c", "d", "default", "e", "E "]
    for _ in range(2):
        records = [(i, r.choice(names), r.choice(["pending", "pending", "active"])) for i in range(25)]
        requests = [(r.randrange(27), r.choice(names), r.random() < 0.3) for _ in range(60)]
        registry = r.sample(["b_c", "d"], 1)
        aliases = [("a", "d", "rejected", 0), ("b c", "e", "confirmed", 1), ("e", "d", "rejected", 2)]
        assert run(spark, records, requests, registry, aliases)[0] == expected(records, requests, registry, aliases)


def expected(records, requests, registry, aliases):
    key = lambda x: " ".join(x.split()).lower()
    plain = lambda x: "".join(c for c in x.lower() if c not in " -_")
    status, raw = {i: s for i, _, s in records}, {i: w.strip() for i, w, _ in records}
    pairs, known, out = {(key(a), c): (s, t) for a, c, s, t in aliases}, set(registry), []
    for seq, (i, name, authorized) in enumerate(requests):
        if status.get(i) != "pending":
            out.append(("not_pending" if i in status else "not_found", None))
            continue
        own, name = raw[i], name.strip()
        if own == "default":
            if name != "default":
                out.append(("reserved", None))
                continue
            to = "default"
        elif plain(own) == plain(name):
            to = own
        elif name == "default":
            out.append(("reserved", None))
            continue
        else:
            said = [c for (k, c), (s, _) in pairs.items() if k == key(name) and s == "confirmed"]
            alike = min((x for x in known if plain(x) == plain(name)), default=name)
            to = said[0] if said else name if name in known else alike
        if own != "default" and key(own) != key(to):
            if pairs.get((key(own), to), ("",))[0] == "rejected" and not authorized:
                out.append(("kept_separate", None))
                continue
            pairs = {p: s for p, s in pairs.items() if p[0] != key(own) or s[0] != "confirmed"} | {(key(own), to): ("confirmed", seq)}
        known |= {to} - {"default"}
        status[i] = "active"
        out.append(("confirmed", to))
    return out


def test_empty(spark):
    assert run(spark, [], [])[0] == [] and run(spark, [(1, "a", "pending")], [])[1] == {1: ("pending", None, 1)}


def test_snapshots(spark, tmp_path):
    reviewed = ReviewedRegistry(spark, f"file://{tmp_path}/r")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    registry = names("a", "b ", None, "default", "unknown", "a")
    assert reviewed.finding(registry).first()[1:] == (False, "warning", 0, 2, 2)
    assert reviewed.confirm(registry)["outcome"] == "not_authorized" and reviewed.names().count() == 0
    for wrong in ("abc", ["x"] * 101, ["x" * 2001], [1]):
        assert reviewed.confirm(registry, wrong, authorized=True)["outcome"] == "invalid_input"
    assert reviewed.confirm(registry, reason=" seen ", authorized=True) == {"outcome": "confirmed", "count": 2}
    assert reviewed.finding(registry).first()[1:] == (True, "ok", 2, 2, 0)
    # a name that is gone doesn't matter, a new one does; looking changes nothing
    assert [x.name for x in reviewed.unreviewed(names("b", "c")).collect()] == ["c"] and reviewed.finding(names("b", "c")).first()[1:] == (False, "warning", 2, 2, 1)
    assert reviewed.confirm(registry, ["c", " c", "none"], authorized=True) == {"outcome": "confirmed", "count": 1}
    assert [x.name for x in reviewed.names().collect()] == ["c"]
