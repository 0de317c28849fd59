"""Queries: insertion, field and metadata updates, trust actions, freshness, extraction gate, keys and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import evidence as E
from factloom.operators import filters as L
from factloom.operators import lifecycle as C
from factloom.operators import vector as V
from factloom.plans.registry import query
from factloom.sources.views import CONFLICTS_SQL, MEMORIES_SQL, UNITS_SQL, conflicts, memories, table, units

M = "WITH " + MEMORIES_SQL
_GUARD = "(protection_level = 'locked' OR source_type = 'user_confirmed')"
_BASE = 1_000_000_000


def _new(spark, sf):
    k = F.col("conv_id")
    seq = k * 1000 + F.col("turn")
    return table(spark, sf, "conversations").select(
        seq.alias("seq"), F.when(k % 9 == 0, "  ").otherwise(F.col("text")).alias("content"), F.col("role").alias("subject"),
        F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("conv"), (k % 6).cast("string"))).alias("workspace"), F.array("role", F.lit("talk"), "role").alias("tags"))


_NEW = f"""n AS (SELECT {_BASE} + conv_id * 1000 + turn AS id, text AS content, role AS subject, CASE WHEN conv_id % 4 = 0 THEN 'default' ELSE 'conv' || conv_id % 6 END AS ws, [role, 'talk'] AS tags, 'active' AS status, 1 AS version
 FROM conversations WHERE conv_id % 9 <> 0 AND trim(text) <> '')"""


@query("inserted_records", f"{M}, {_NEW} SELECT id, content, subject, ws, tags, status, version FROM m UNION ALL SELECT * FROM n")
def inserted_records(spark, sf):
    return C.insert_records(memories(spark, sf), _new(spark, sf), _BASE)


@query("registry_missing", f"{M}, {_NEW}, a AS (SELECT ws FROM m UNION ALL SELECT ws FROM n) SELECT DISTINCT ws AS name FROM a WHERE ws NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0)")
def registry_missing(spark, sf):
    """Workspaces, with new records, that no workspace of even documents stands for."""
    registry = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("source").alias("name"), F.lit(True).alias("vector")).distinct()
    return C.unregistered(C.insert_records(memories(spark, sf), _new(spark, sf), _BASE), registry)


@query("field_updates", f"""{M}, g AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'active' END AS s, CASE WHEN id % 4 = 0 THEN 'locked' END AS p, CASE WHEN id % 5 = 0 THEN 0.5::DOUBLE END AS f FROM m)
SELECT id, coalesce(s, status) AS status, coalesce(p, protection_level) AS protection_level, coalesce(f, confidence) AS confidence,
 CAST(version + CASE WHEN coalesce(s <> status, false) OR coalesce(p <> protection_level, false) OR coalesce(f <> confidence, false) THEN 1 ELSE 0 END AS INTEGER) AS version FROM g""")
def field_updates(spark, sf):
    k = F.col("id")
    m = memories(spark, sf)
    changes = m.select("id", F.when(k % 3 == 0, "active").alias("status"), F.when(k % 4 == 0, "locked").alias("protection_level"), F.when(k % 5 == 0, F.lit(0.5)).alias("confidence"))
    return C.update_fields(m, changes).select("id", "status", "protection_level", "confidence", "version")


@query("metadata_updates", f"""{M}, g AS (SELECT *, CASE WHEN status <> 'active' THEN 'not_active' WHEN {_GUARD} AND id % 2 = 0 THEN 'forbidden' WHEN id % 5 = 0 THEN 'no_change' ELSE 'updated' END AS outcome FROM m)
SELECT id, outcome, CASE WHEN outcome = 'updated' THEN CASE WHEN id % 3 = 0 THEN ws || '/new' ELSE ws || '/' || subject END ELSE ws || '/' || subject END AS scope,
 CASE WHEN outcome = 'updated' AND id % 3 <> 0 THEN NULL ELSE subject END AS entity, CAST(version + CASE outcome WHEN 'updated' THEN 1 ELSE 0 END AS INTEGER) AS version FROM g""")
def metadata_updates(spark, sf):
    """Of every third record a field is set, of others one is cleared, of every fifth neither."""
    k, path = F.col("id"), F.concat_ws("/", "ws", "subject")
    m = memories(spark, sf).withColumn("metadata", F.create_map(F.lit("entity"), F.col("subject"), F.lit("scope"), path))
    put = F.when(k % 5 == 0, F.create_map(F.lit("scope"), path)).when(k % 3 == 0, F.create_map(F.lit("scope"), F.concat_ws("/", "ws", F.lit("new"))))
    changes = m.select("id", put.alias("set"), F.when((k % 5 != 0) & (k % 3 != 0), X.strings(["entity", "none"])).alias("clear"), (k % 2 != 0).alias("authorized"))
    out = C.update_metadata(m, changes)
    return out.select("id", "outcome", F.col("metadata")["scope"].alias("scope"), F.try_element_at("metadata", F.lit("entity")).alias("entity"), "version")


@query("trust_actions", f"""{M}, a AS (SELECT id + 5 AS id, (['confirm', 'retire', 'activate', 'retire'])[id % 4 + 1] AS action, id % 7 <> 0 AS authorized, CASE WHEN id % 11 = 0 THEN 1.5 WHEN id % 3 <> 0 THEN 1.0 ELSE 0.5 END AS wanted,
  CASE id % 8 WHEN 1 THEN CASE WHEN id % 5 = 0 THEN id + 5 ELSE id + 9 END WHEN 3 THEN CASE WHEN id % 5 = 0 THEN -id END END AS superseded_by FROM m),
o AS (SELECT a.id, action, wanted, m.status, m.source_type, m.protection_level, m.confidence, m.version, CASE
  WHEN NOT authorized THEN 'forbidden' WHEN action = 'confirm' AND (wanted < 0 OR wanted > 1) THEN 'invalid_confidence' WHEN action = 'retire' AND superseded_by = a.id THEN 'invalid_replacement' WHEN m.id IS NULL THEN 'not_found'
  WHEN action = 'confirm' AND m.status <> 'active' THEN 'not_active' WHEN action = 'activate' AND m.status <> 'pending' THEN 'not_pending' WHEN action = 'retire' AND m.status IN ('superseded', 'deleted') THEN 'already_' || m.status
  WHEN action = 'retire' AND superseded_by IS NOT NULL AND x.id IS NULL THEN 'replacement_not_found' WHEN action = 'retire' AND superseded_by IS NOT NULL AND x.status <> 'active' THEN 'replacement_not_active' ELSE 'done' END AS outcome
  FROM a LEFT JOIN m ON a.id = m.id LEFT JOIN m x ON x.id = a.superseded_by),
n AS (SELECT *, CASE WHEN outcome = 'done' AND action = 'retire' THEN 'superseded' WHEN outcome = 'done' AND action = 'activate' THEN 'active' ELSE status END AS s, CASE WHEN outcome = 'done' AND action = 'confirm' THEN 'user_confirmed' ELSE source_type END AS t,
  CASE WHEN outcome = 'done' AND action = 'confirm' THEN 'locked' WHEN outcome = 'done' AND action = 'retire' THEN 'normal' ELSE protection_level END AS p, CASE WHEN outcome = 'done' AND action = 'confirm' THEN wanted ELSE confidence END AS c FROM o)
SELECT id, action, outcome, s AS status, t AS source_type, p AS protection_level, c AS confidence, CAST(version + CASE WHEN s <> status OR t <> source_type OR p <> protection_level OR c <> confidence THEN 1 ELSE 0 END AS INTEGER) AS version FROM n""")
def trust_actions(spark, sf):
    m = memories(spark, sf)
    k = F.col("id")
    by = F.when(k % 8 == 1, F.when(k % 5 == 0, k + 5).otherwise(k + 9)).when((k % 8 == 3) & (k % 5 == 0), -k)
    wanted = F.when(k % 11 == 0, 1.5).when(k % 3 != 0, 1.0).otherwise(0.5)
    return C.trust_actions(m, m.select((k + 5).alias("id"), F.get(X.strings(["confirm", "retire", "activate", "retire"]), (k % 4).cast("int")).alias("action"), (k % 7 != 0).alias("authorized"), wanted.alias("confidence"), by.alias("superseded_by")))


@query("notice_freshness", f"""WITH {MEMORIES_SQL}, {CONFLICTS_SQL}, e AS (SELECT conflict_id, ws, unnest(members) AS id FROM c), j AS (SELECT e.conflict_id, coalesce(m.status = 'active' AND m.version = CAST((e.id - 1) % 4 + 1 AS INTEGER) AND m.ws = e.ws, false) AS ok FROM e LEFT JOIN m ON m.id = e.id)
SELECT conflict_id AS notice_id, bool_and(ok) AS fresh, count(*) FILTER (NOT ok) AS stale_members FROM j GROUP BY ALL""")
def notice_freshness(spark, sf):
    members = F.transform("members", lambda i: F.struct(i.alias("memory_id"), ((i - 1) % 4 + 1).cast("int").alias("version")))
    return C.freshness(conflicts(spark, sf).select(F.col("conflict_id").alias("notice_id"), "ws", members.alias("members")), memories(spark, sf))


@query("notice_pairs", """WITH f AS (SELECT vec_id // 8 AS anchor, vec_id % 3 + vec_id // 8 + 1 AS peer, CASE WHEN label % 2 = 0 THEN 'notify' ELSE 'check' END AS action, floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS distance FROM embeddings),
b AS (SELECT anchor, peer, arg_min({'a': action, 'd': distance}, (distance, action)) AS b FROM f GROUP BY ALL), r AS (SELECT anchor, peer, b.a AS action, b.d AS distance, row_number() OVER (PARTITION BY anchor ORDER BY b.a <> 'notify', b.d, peer) AS place FROM b)
SELECT anchor, peer, action, distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2""")
def notice_pairs(spark, sf):
    v = F.col("vec_id")
    anchor = F.floor(v / 8)
    found = table(spark, sf, "embeddings").select(anchor.alias("anchor"), (v % 3 + anchor + 1).alias("peer"), F.when(F.col("label") % 2 == 0, "notify").otherwise("check").alias("action"), F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000).cast("double").alias("distance"))
    return C.notice_pairs(found)


@query("dedupe_keys", f"""{M} SELECT id, sha256('semantic:' || least(id, 500 - id) || ':' || CASE WHEN id <= 500 - id THEN version ELSE 7 END || ':' || greatest(id, 500 - id) || ':' || CASE WHEN id <= 500 - id THEN 7 ELSE version END || ':polarity') AS key FROM m""")
def dedupe_keys(spark, sf):
    return memories(spark, sf).select("id", E.dedupe_key(F.col("id"), F.col("version"), 500 - F.col("id"), F.lit(7), "polarity").alias("key"))


@query("padded_spans", rf"""{M}, s AS (SELECT id, content, id % 50 AS a, id % 50 + 40 + id % 9 AS b FROM m), u AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'moved' ELSE trim(regexp_replace(substr(content, a + 1, b - a), '\s+', ' ', 'g')) END AS unit FROM s)
SELECT id, CASE WHEN b <= length(content) AND unit <> '' AND id % 7 <> 0 THEN CAST(greatest(0, a - 128) AS INTEGER) END AS first, CASE WHEN b <= length(content) AND unit <> '' AND id % 7 <> 0 THEN CAST(least(length(content), b + 128) AS INTEGER) END AS last FROM u""")
def padded_spans(spark, sf):
    k = F.col("id")
    a, b = k % 50, k % 50 + 40 + k % 9
    unit = F.when(k % 7 == 0, "moved").otherwise(X.collapse(F.substr("content", (a + 1).cast("int"), (b - a).cast("int"))))
    span = E.padded_span(F.col("content"), unit, a, b)
    return memories(spark, sf).select("id", span.alias("s")).select("id", F.col("s.start").alias("first"), F.col("s.end").alias("last"))


@query("subject_tokens", rf"""{M}, w AS (SELECT id, list_filter(string_split_regex(subject || ' 数据 库选x 型', '\s+'), lambda x: x <> '') AS w FROM m)
SELECT id, flatten(list_transform(w, lambda x: CASE x WHEN '数据' THEN ['数据'] WHEN '库选x' THEN ['库选', '选x'] WHEN '型' THEN []::VARCHAR[] ELSE CASE WHEN length(x) >= 2 THEN [lower(x)] ELSE []::VARCHAR[] END END)) AS tokens FROM w""")
def subject_tokens(spark, sf):
    return memories(spark, sf).select("id", E.subject_tokens(F.concat("subject", F.lit(" 数据 库选x 型"))).alias("tokens"))


@query("tag_coercion", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN list_distinct_order WHEN 1 THEN [lang] ELSE []::VARCHAR[] END AS tags FROM (SELECT doc_id, lang, CASE WHEN lang = source THEN [lang] ELSE [lang, source] END AS list_distinct_order FROM documents)""")
def tag_coercion(spark, sf):
    k = F.col("doc_id") % 5
    raw = (
        F.when(k == 0, F.format_string('["%s", "%s", 3, null, "%s", ["x"]]', "lang", "source", "lang")).when(k == 1, F.format_string('["%s"]', "lang"))
        .when(k == 2, F.format_string('["%s", ', "lang")).when(k == 3, F.format_string('{"a": "%s"}', "lang")))
    return table(spark, sf, "documents").select("doc_id", E.coerce_tags(raw).alias("tags"))


@query("tag_text", f"{M} SELECT id FROM m WHERE contains(CAST(to_json(tags) AS VARCHAR), 'rc1')")
def tag_text(spark, sf):
    return memories(spark, sf).where(L.has_tag_text("rc1")).select("id")


@query("time_bounds", f"{M} SELECT id, event_time >= DATE '2024-03-01' AS a, event_time BETWEEN DATE '2024-03-01' AND DATE '2024-04-01' AS b, true AS c, event_time <= DATE '2024-04-01' AS d FROM m")
def time_bounds(spark, sf):
    one = L.between("event_time", "2024-03-01"), L.between("event_time", "2024-03-01", "2024-04-01"), L.between("event_time", "2024-05-01", "2024-04-01"), L.between("event_time", "soon", "2024-04-01T00:00:00")
    return memories(spark, sf).select("id", *[c.alias(n) for c, n in zip(one, "abcd")])


_WORDS = r"""w AS (SELECT id, lang, subject, split_part(subject, ' ', 2) AS v FROM m JOIN (SELECT doc_id + 1 AS id, lang FROM documents) USING (id) WHERE regexp_matches(subject, '^[A-Za-z]+ [a-z]+ [A-Za-z ]+$')),
p AS (SELECT a.id, a.subject AS qa, b.subject AS qb, a.lang AS la, b.lang AS lb, a.v AS va, b.v AS vb FROM w a JOIN w b ON b.id = a.id + 2)"""


@query("pair_gate", rf"""{M}, {_WORDS} SELECT id, CASE WHEN id % 11 = 0 AND id % 7 = 0 THEN 'unverified' WHEN id % 11 = 0 OR id % 7 = 0 THEN 'bidirectional_extraction_required' WHEN la <> lb OR va = vb THEN 'not_same_attribute_different_value'
 WHEN id % 5 = 0 THEN 'bidirectional_mapping_mismatch' WHEN id % 6 = 0 THEN 'unverified' ELSE 'same_attribute_different_grounded_value' END AS reason FROM p""")
def pair_gate(spark, sf):
    """Neighbours' second words as values of their language; some answers are missing, unswapped, or quoted from elsewhere."""
    d = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("id"), "lang")
    w = memories(spark, sf).where(F.col("subject").rlike("^[A-Za-z]+ [a-z]+ [A-Za-z ]+$")).join(d, "id").select("id", "lang", "subject", F.get(F.split("subject", " "), F.lit(1)).alias("v"))
    p = w.join(w.select((F.col("id") - 2).alias("id"), F.col("lang").alias("lb"), F.col("subject").alias("qb"), F.col("v").alias("vb")), "id")
    answer = lambda *x: F.to_json(F.struct(*[F.col(c).alias(k) for c, k in zip(x, E.FIELDS)]))
    k = F.col("id")
    there, back = answer("lang", "v", "lb", "vb"), answer("lb", "vb", "lang", "v")
    p = p.withColumn("f", F.when(k % 11 == 0, "no answer").otherwise(F.concat(F.lit("So: "), there, F.lit(" }"))))
    p = p.withColumn("r", F.when(k % 7 == 0, F.concat(F.lit("["), back, F.lit("]"))).when(k % 5 == 0, there).otherwise(back))
    p = p.withColumns({"f": E.parse_extraction("f"), "r": E.parse_extraction("r")})
    given = lambda c: F.when(F.col(f"{c}.error").isNull(), F.col(c))
    quote = F.when(k % 6 == 0, "elsewhere").otherwise(F.col("subject"))
    return p.select("id", given("f").alias("f"), given("r").alias("r"), quote.alias("qa"), "qb").select("id", E.pair_gate(F.col("f"), F.col("r"), F.col("qa"), F.col("qb"))["reason"].alias("reason"))


@query("short_evidence", rf"""{M}, x AS (SELECT id, trim(subject) AS title, split_part(regexp_replace(content, '\n\s*\n', chr(1), 'g'), chr(1), 1) AS para FROM m)
SELECT id, title, substr(regexp_replace(para, '^\s+|\s+$', '', 'g'), 1, 400) AS first_para FROM x""")
def short_evidence(spark, sf):
    return memories(spark, sf).select("id", E.short_evidence(F.col("subject"), F.col("content")).alias("e")).select("id", "e.title", "e.first_para")


@query("source_filter", f"{M} SELECT id FROM m WHERE status = 'active' AND source_type = 'user_confirmed' AND ws IN ('src1', 'src2')")
def source_filter(spark, sf):
    return L.filter_recall(memories(spark, sf), source_type="user_confirmed", scope=["src1", " src2 ", "", "src1"]).select("id")


@query("scope_none", f"{M} SELECT count(*) FILTER (false) AS without, count(*) AS whole FROM m")
def scope_none(spark, sf):
    """A notice scope without names holds nothing, another one everything."""
    return memories(spark, sf).agg(F.count_if(L.in_scope([" "], empty_means_none=True)).alias("without"), F.count_if(L.in_scope(None)).alias("whole"))


@query("placement_hints", f"""WITH {UNITS_SQL}, {MEMORIES_SQL}, a AS (SELECT * FROM u WHERE memory_id % 10 = 0),
d AS (SELECT a.unit_id AS anchor_id, u.unit_id, u.memory_id, round(list_distance(a.embedding, u.embedding), 6) AS distance, row_number() OVER (PARTITION BY a.unit_id ORDER BY list_distance(a.embedding, u.embedding), u.unit_id) AS r FROM a JOIN u ON u.memory_id <> a.memory_id)
SELECT anchor_id, arg_min(ws, r) AS ws FROM d JOIN m ON m.id = d.memory_id WHERE r <= 8 AND ws <> 'src0' GROUP BY anchor_id""")
def placement_hints(spark, sf):
    """For units of every tenth memory the workspace, other than the default one, of the first of eight neighbours that has one."""
    u = units(spark, sf)
    near = V.batch_knn(u, u.where("memory_id % 10 = 0"), 8).join(u.select("unit_id", F.col("memory_id").alias("id")), "unit_id")
    named = near.join(memories(spark, sf).select("id", "ws"), "id").where("ws <> 'src0'")
    return named.groupBy("anchor_id").agg(F.min_by("ws", "rank").alias("ws"))
