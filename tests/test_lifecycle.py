"""Extraction answers, the two-direction gate, evidence of long records: cases by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import evidence as E
from factloom.operators import lifecycle as C

GOOD = '{"attribute_a": "engine", "value_a": "MySQL", "attribute_b": "engine", "value_b": "SQLite"}'


@pytest.mark.parametrize(
    "text, error",
    [
        ("Well: " + GOOD + " and } more", None),
        (None, "missing_json"),
        ("none", "missing_json"),
        ('{"a": {"b": "}"', "missing_json"),
        (f"[{GOOD}]", "array_wrapper"),
        ('{"a": 1,}', "invalid_json"),
        (GOOD[:-1] + ', "value_a": "x"}', "duplicate_field"),
        (GOOD[:-1] + ', "more": "x"}', "invalid_schema"),
        (GOOD.replace('"MySQL"', "5"), "invalid_schema"),
        (GOOD.replace("MySQL", " "), "invalid_value_a"),
        (GOOD.replace("SQLite", "x" * 65), "invalid_value_b"),
        (GOOD.replace("SQLite", "__Unknown__"), "unknown_field"),
    ],
)
def test_answers(text, error):
    assert E.parsed_fields(text).get("error") == error


def test_gate(spark):
    a, b = "数据库引擎采用 MySQL 8", "数据库选型采用 SQLite 3"
    fields = "struct<attribute_a:string,value_a:string,attribute_b:string,value_b:string>"
    there, back = ("数据库引擎", "MySQL", "数据库选型", "SQLite"), ("数据库选型", "SQLite", "数据库引擎", "MySQL")
    rows = [
        (1, there, back, a, b), (2, there, there, a, b), (3, there, None, a, b), (4, None, None, a, b), (5, ("x", "8GB", "x", "8G"), ("x", "8G", "x", "8GB"), a, b),
        (6, there, back, "数据库引擎采用 甲", b), (7, there, back, "测试环境" + a, "生产环境" + b), (8, there, ("y", "1", "x", "2"), a, b)]
    df = spark.createDataFrame(rows, f"k int, f {fields}, r {fields}, a string, b string")
    gate = lambda both: {x.k: x.g.reason for x in df.select("k", E.pair_gate(F.col("f"), F.col("r"), F.col("a"), F.col("b"), both).alias("g")).collect()}
    ready = "same_attribute_different_grounded_value"
    assert gate(True) == {1: ready, 2: "bidirectional_mapping_mismatch", 3: "bidirectional_extraction_required", 4: "unverified", 5: "not_same_attribute_different_value", 6: "unverified", 7: "coexist_environment_mismatch", 8: "direction_invalid"}
    assert gate(False)[3] == "single_direction_only"


def test_evidence_of_a_record(spark):
    text = "# One\nbody a. b! c? d\n\n## Two ##\n tail"
    e = spark.range(1).select(E.short_evidence(F.lit(" "), F.lit(text)).alias("e")).first().e
    assert (e.title, e.headings, e.first_para, e.key_sentences) == ("One", ["One", "Two ##"], "# One\nbody a. b! c? d", ["# One\nbody a.", "b!", "c?"])
    none = spark.range(1).select(E.short_evidence(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("e")).first().e
    assert (none.title, none.headings, none.first_para, none.key_sentences) == ("", [], "", [])


def test_keys_do_not_depend_on_the_order(spark):
    key = lambda *x: spark.range(1).select(E.dedupe_key(*map(F.lit, x), "n")).first()[0]
    assert key(1, 5, 2, 6) == key(2, 6, 1, 5) != key(1, 6, 2, 5)


def test_metadata(spark):
    records = spark.createDataFrame([(1, "active", "normal", "unknown", 1, {"a": "1"}), (2, "active", "locked", "unknown", 4, None)], "id long, status string, protection_level string, source_type string, version int, metadata map<string,string>")
    changes = spark.createDataFrame([(1, {"b": "2"}, ["a"], None), (2, {"b": "2"}, None, None), (3, None, None, True)], "id long, set map<string,string>, clear array<string>, authorized boolean")
    got = {r.id: (r.outcome, r.metadata, r.version) for r in C.update_metadata(records, changes).collect()}
    assert got == {1: ("updated", {"b": "2"}, 2), 2: ("forbidden", None, 4), 3: ("not_found", None, None)}
