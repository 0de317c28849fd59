"""Queries: text scalars, segmentation, pair rules, workspace names, governed changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import groups as Q
from factloom.operators import ledger as G
from factloom.operators import pairs as D
from factloom.operators import review as A
from factloom.operators import vector as V
from factloom.operators import workspace as W
from factloom.operators.nearest import nearest_units
from factloom.operators.segment import segment
from factloom.plans.registry import query
from factloom.sources.commits import written
from factloom.sources.views import CONFLICTS_SQL, MEMORIES_SQL, conflicts, memories, table, units

M = "WITH " + MEMORIES_SQL


@query("text_scalars", rf"""{M} SELECT id, sha256(content) AS content_hash, trim(regexp_replace(content, '\s+', ' ', 'g')) AS collapsed,
 trim(lower(trim(regexp_replace(subject, '\s+', ' ', 'g'))), '。，,;；:：.、· ' || chr(9) || '-—') AS canon, regexp_replace(lower(trim(tags[2])), '^v([0-9])', '\1') AS tag FROM m""")
def text_scalars(spark, sf):
    return memories(spark, sf).select("id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), X.collapse("content").alias("collapsed"), X.canon_token("subject").alias("canon"), X.tag_token(F.col("tags")[1]).alias("tag"))


@query("trigram_sets", rf"""{M}, g AS (SELECT id, regexp_replace(lower(subject), '\s+', '', 'g') AS s FROM m), w AS (SELECT DISTINCT id, substr(s, i, 3) AS g FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM g))
SELECT id, count(g) AS trigrams, min(g) AS first_trigram FROM m LEFT JOIN w USING (id) GROUP BY id""")
def trigram_sets(spark, sf):
    return memories(spark, sf).select("id", X.distinct_windows("subject", 3).alias("g")).select("id", F.size("g").cast("long").alias("trigrams"), F.array_min("g").alias("first_trigram"))


@query("anchor_lists", f"{M} SELECT id, list_filter(regexp_extract_all(lower(subject), '[a-z0-9._\\-+/]+'), lambda a: regexp_matches(a, '[a-z0-9]')) AS anchors FROM m")
def anchor_lists(spark, sf):
    return memories(spark, sf).select("id", X.anchors("subject").alias("anchors"))


@query("sentence_slices", rf"""{M}, s AS (SELECT id, unnest(string_split_regex(regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1))) AS s FROM m)
SELECT id, count(*) AS sentences, CAST(sum(length(trim(s))) AS BIGINT) AS characters FROM s WHERE trim(s) <> '' GROUP BY id""")
def sentence_slices(spark, sf):
    s = memories(spark, sf).select("id", F.explode(X.sentences("content")).alias("s"))
    return s.groupBy("id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("characters"))


@query("long_windows", rf"""{M}, c AS (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS t FROM m), p AS (SELECT id, k, trim(substr(t, k * 240 + 1, 300)) AS part FROM (SELECT id, t, unnest(range(0, greatest(1, CAST(ceil((length(t) - 60) / 240.0) AS BIGINT)))) AS k FROM c WHERE length(t) > 400))
SELECT id, count(*) AS parts, CAST(sum(length(part)) AS BIGINT) AS characters FROM p WHERE length(part) >= 8 GROUP BY id""")
def long_windows(spark, sf):
    c = memories(spark, sf).select("id", X.collapse("content").alias("t")).where(F.length("t") > 400)
    p = c.select("id", F.explode(X.long_parts("t")).alias("part"))
    return p.groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.length("part")).alias("characters"))


@query("numeric_values", """SELECT event_id, list_transform(regexp_extract_all(lower(props), '[0-9]+(\\.[0-9]+){0,2}'), lambda v: v) AS v FROM events WHERE regexp_matches(props, '[0-9]')""")
def numeric_values(spark, sf):
    return table(spark, sf, "events").where(F.col("props").rlike("[0-9]")).select("event_id", X.numeric_values("props").alias("v"))


@query("segment_units")
def segment_units(spark, sf):
    return segment(memories(spark, sf).where("status = 'active'"))


@query("unit_offsets")
def unit_offsets(spark, sf):
    """Units of body text whose range of the source doesn't give their text: none."""
    m = memories(spark, sf)
    u = segment(m).where("kind = 'text'").join(m.select(F.col("id").alias("memory_id"), "content"), "memory_id")
    source = X.collapse(F.substring("content", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")))
    return u.agg(F.count("*").alias("units"), F.count_if(source != F.col("text")).alias("wrong"))


@query("pair_decisions")
def pair_decisions(spark, sf):
    """Each memory and the one of the next id, by their subjects."""
    m = memories(spark, sf).select("id", "subject", D.features(F.col("subject")).alias("f"))
    p = m.join(m.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("subject").alias("text"), F.col("f").alias("g")), "id")
    return p.select("id", "other", D.pair_rule(F.col("f"), F.col("g")).alias("d"), D.coexistence_veto(F.col("subject"), F.col("text")).alias("veto")).select("id", "other", "d.*", "veto")


@query("value_grounding", f"{M} SELECT id, split_part(subject, ' ', 2) AS value, contains(lower(subject), lower(split_part(subject, ' ', 2))) AND regexp_replace(lower(split_part(subject, ' ', 2)), '[^\\w\\x80-\\x{{10FFFF}}]+', '', 'g') NOT IN ('') AS grounded FROM m WHERE regexp_matches(subject, '^[A-Za-z]+ [a-z]+ [A-Za-z ]+$')")
def value_grounding(spark, sf):
    value = F.get(F.split("subject", " "), F.lit(1))
    return memories(spark, sf).where(F.col("subject").rlike("^[A-Za-z]+ [a-z]+ [A-Za-z ]+$")).select("id", value.alias("value"), D.grounded(value, F.col("subject")).alias("grounded"))


# Ten neighbours and one more, with the anchor's memory left out; all are judged.
SCAN_NEIGHBOURS = 11


def _scan_units(spark, sf):
    """Live units with their own whole texts; a unit of which the memory has no such text is not indexed."""
    m = memories(spark, sf).where("status = 'active'").join(units(spark, sf).select(F.col("memory_id").alias("id")), "id", "left_semi")
    own = m.select(F.col("id").alias("memory_id"), "version", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    live = units(spark, sf).join(own, "memory_id")
    return live.join(segment(m).select("memory_id", "unit_index", "text", "start_offset", "end_offset"), ["memory_id", "unit_index"])


def recorded_groups(spark, sf):
    """Groups with their members' snapshots; those of every second group are of versions that are no more."""
    e = conflicts(spark, sf).select("conflict_id", "status", F.explode("members").alias("id"))
    now = e.join(memories(spark, sf).select("id", "version"), "id", "left")
    ref = F.concat_ws("@", F.col("id").cast("string"), (F.coalesce("version", F.lit(1)) + F.col("conflict_id") % 2).cast("string"))
    return now.groupBy("conflict_id", "status").agg(F.array_sort(F.collect_list(ref)).alias("refs")).withColumn("candidate", F.lit(None).cast("string"))


@query("scan_candidates")
def scan_candidates(spark, sf):
    """Pairs of memories with near units whose texts may disagree, by a search of the text units among all units."""
    live = written(_scan_units(spark, sf), "live")
    near = nearest_units(live.select("unit_id", "memory_id", "embedding", (F.col("kind") == "text").alias("asked")), SCAN_NEIGHBOURS)
    texts = live.where("kind = 'text'").select("unit_id", "memory_id", "version", "text", "start_offset", "end_offset", "content_hash")
    texts = texts.repartition(max(live.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))  # few rows, much work
    found = D.scan_candidates(written(D.featured(texts), "texts"), near.select("anchor_id", "unit_id", "distance"), recorded_groups(spark, sf), similar_too=True)
    return found.select("x", "y", "state", "reasons", F.round("distance", 6).alias("distance"), "members")


_NAMES = """n AS (SELECT DISTINCT ws FROM (SELECT source AS ws FROM documents UNION ALL SELECT upper(source) FROM documents UNION ALL SELECT replace(source, 'src', 'src-') FROM documents UNION ALL SELECT 'team ' || lang FROM documents
 UNION ALL SELECT unnest(['', 'default', 'notes', 'Plan', 'https://x.y', 'a/b', 'unknown', 'src_1', 'project'])))"""


def _names(spark, sf):
    d = table(spark, sf, "documents")
    odd = ["", "default", "notes", "Plan", "https://x.y", "a/b", "unknown", "src_1", "project"]
    one = F.explode(F.array("source", F.upper("source"), F.replace("source", F.lit("src"), F.lit("src-")), F.concat(F.lit("team "), "lang")))
    return d.select(one.alias("ws")).distinct().unionByName(spark.range(1).select(F.explode(X.strings(odd)).alias("ws"))).distinct()


@query("ws_quality", f"""WITH {_NAMES} SELECT ws, CASE WHEN trim(ws) = '' THEN 'empty' WHEN lower(trim(ws)) IN ('default', 'none', 'null', 'unknown') THEN 'default' WHEN length(trim(ws)) > 80 OR regexp_matches(ws, '[\\\\/]|https?://') THEN 'suspicious'
 WHEN lower(trim(ws)) IN ('notes', 'note', 'plan', 'report', 'draft', 'misc', 'temp', 'tmp', 'project', 'projects') THEN 'generic' ELSE 'specific' END AS quality, regexp_replace(lower(ws), '[\\s_\\-]+', '', 'g') AS key FROM n""")
def ws_quality(spark, sf):
    return _names(spark, sf).select("ws", W.quality(F.col("ws")).alias("quality"), W.mechanical_key(F.col("ws")).alias("key"))


_RESOLVE = f"""{_NAMES}, cn AS (SELECT DISTINCT source AS name FROM documents), al AS (SELECT 'team en' AS k, 'src1' AS canonical),
ne AS (SELECT ws, 'src2' AS name, 0.2 AS distance FROM n WHERE ws IN ('team fr', 'team de') UNION ALL SELECT 'team fr', 'src3', 0.22 UNION ALL SELECT 'team es', 'src4', 0.4 UNION ALL SELECT 'team de', 'src5', 0.1),
cl AS (SELECT ws, arg_min(name, distance) AS by_vector FROM ne WHERE distance <= 0.25 AND NOT (ws = 'team de' AND name = 'src5') GROUP BY ws),
rs AS (SELECT n.ws, CASE WHEN lower(trim(n.ws)) IN ('', 'default', 'unknown') THEN 'default' ELSE coalesce(al.canonical, cn.name, mk.name, by_vector, n.ws) END AS canonical,
 CASE WHEN lower(trim(n.ws)) IN ('', 'default', 'unknown') THEN 'default' WHEN al.canonical IS NOT NULL THEN 'confirmed_alias' WHEN cn.name IS NOT NULL THEN 'exact' WHEN mk.name IS NOT NULL THEN 'mechanical' WHEN by_vector IS NOT NULL THEN 'vector' ELSE 'new' END AS matched_by
 FROM n LEFT JOIN al ON lower(n.ws) = al.k LEFT JOIN cn ON cn.name = n.ws LEFT JOIN cn mk ON regexp_replace(lower(n.ws), '[\\s_\\-]+', '', 'g') = mk.name LEFT JOIN cl ON cl.ws = n.ws)"""


def _resolved(spark, sf):
    canonicals = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    aliases = spark.sql("SELECT * FROM VALUES ('Team  EN', 'src1', 'confirmed', 2), ('team en', 'src9', 'confirmed', 1), ('team de', 'src5', 'rejected', 1) AS t(alias, canonical, status, updated_at)")
    fixed = spark.sql("SELECT * FROM VALUES ('team fr', 'src3', 0.22D), ('team es', 'src4', 0.4D), ('team de', 'src5', 0.1D) AS t(ws, name, distance)")
    names = _names(spark, sf)
    near = names.where("ws in ('team fr', 'team de')").select("ws", F.lit("src2").alias("name"), F.lit(0.2).alias("distance")).unionByName(fixed)
    return W.resolve(names, canonicals, aliases, near), near


@query("ws_resolve", f"WITH {_RESOLVE} SELECT * FROM rs")
def ws_resolve(spark, sf):
    return _resolved(spark, sf)[0]


@query("ws_rule")
def ws_rule(spark, sf):
    resolved, near = _resolved(spark, sf)
    similar = near.withColumn("rejected", (F.col("ws") == "team de") & (F.col("name") == "src5"))
    return W.rule(resolved.withColumn("hint", F.when(F.col("ws") == "team de", "reference notes").otherwise("")), similar)


# Edits from events: half of them pinned to a version, some to the hash of the first content, some partial.
_EDITS = """e AS (SELECT event_id AS seq, user_id AS id, CASE WHEN event_id % 2 = 0 THEN CAST(1 + event_id % 7 AS INTEGER) END AS expect_version,
 CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 31 = 0 THEN ' ' ELSE event_type || ':' || event_id END AS content,
 CASE WHEN event_id % 5 = 0 THEN ':' END AS old_text, CASE WHEN event_id % 5 = 0 THEN '/' || event_id || ':' END AS new_text, event_id % 3 = 0 AS authorized FROM events)"""


def _edits(spark, sf):
    k = F.col("event_id")
    part = k % 5 == 0
    return table(spark, sf, "events").select(
        k.alias("seq"), F.col("user_id").alias("id"), F.when(k % 2 == 0, k % 7 + 1).cast("int").alias("expect_version"),
        F.when(part, None).when(k % 31 == 0, " ").otherwise(F.concat_ws(":", "event_type", k.cast("string"))).alias("content"),
        F.when(part, ":").alias("old_text"), F.when(part, F.concat(F.lit("/"), k.cast("string"), F.lit(":"))).alias("new_text"), (k % 3 == 0).alias("authorized"))


# The rule itself, event after event: what an event finds is what the one before it has left.
_FOLDED = f"""{MEMORIES_SQL}, {_EDITS}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM e),
w AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, version, content, CAST(NULL AS VARCHAR) AS outcome FROM m WHERE id IN (SELECT id FROM e)
 UNION ALL SELECT id, k, seq, CASE outcome WHEN 'applied' THEN version + 1 ELSE version END, CASE outcome WHEN 'applied' THEN after ELSE content END, outcome FROM (
  SELECT w.id, o.k, o.seq, w.version, w.content, CASE WHEN m.status <> 'active' THEN 'not_active' WHEN (protection_level = 'locked' OR source_type = 'user_confirmed') AND NOT o.authorized THEN 'protected'
   WHEN o.expect_version <> w.version THEN 'stale' WHEN trim(o.content) = '' THEN 'invalid' WHEN o.content IS NULL AND NOT contains(w.content, o.old_text) THEN 'stale' ELSE 'applied' END AS outcome,
   coalesce(o.content, substr(w.content, 1, instr(w.content, o.old_text) - 1) || o.new_text || substr(w.content, instr(w.content, o.old_text) + length(o.old_text))) AS after
  FROM w JOIN o ON o.id = w.id AND o.k = w.k + 1 JOIN m ON m.id = w.id))"""


@query("edit_outcomes", f"""WITH RECURSIVE {_FOLDED} SELECT e.seq, e.id, coalesce(w.outcome, 'missing') AS outcome, CASE WHEN w.outcome = 'applied' THEN w.version END AS version_after
 FROM e LEFT JOIN w ON w.seq = e.seq""")
def edit_outcomes(spark, sf):
    return G.apply_edits(memories(spark, sf), _edits(spark, sf)).select("seq", "id", "outcome", "version_after")


@query("ledger_current", f"WITH RECURSIVE {_FOLDED}, l AS (SELECT id, max(version) AS v, arg_max(content, k) AS c FROM w GROUP BY id) SELECT m.id, CAST(coalesce(v, version) AS INTEGER) AS version, coalesce(c, content) AS content FROM m LEFT JOIN l USING (id)")
def ledger_current(spark, sf):
    m = memories(spark, sf)
    return G.current_state(m, G.apply_edits(m, _edits(spark, sf)))


@query("ledger_history", f"""WITH RECURSIVE {_FOLDED} SELECT now.id, before.version, before.content, now.seq FROM w now JOIN w before ON before.id = now.id AND before.k = now.k - 1 WHERE now.outcome = 'applied'""")
def ledger_history(spark, sf):
    return G.history_rows(G.apply_edits(memories(spark, sf), _edits(spark, sf)))


@query("edit_tags", f"{M} SELECT id, CASE WHEN id % 4 = 0 THEN list_sort(list_distinct(list_concat(list_filter(tags, lambda t: t NOT IN ('en', 'todo')), ['kept', 'fr']))) ELSE list_sort(list_distinct(tags)) END AS tags, version FROM m")
def edit_tags(spark, sf):
    m = memories(spark, sf)
    change = m.where("id % 4 = 0").select("id", X.strings(["en", "todo"]).alias("remove"), X.strings(["kept", "fr"]).alias("add"))
    return G.edit_tags(m, change).withColumn("tags", F.array_sort("tags"))


@query("publish_units", f"""{M}, o AS (SELECT id AS memory_id, version AS memory_version, 0 AS unit_index, 'old' AS text FROM m WHERE id % 2 = 0),
n AS (SELECT id AS memory_id, CAST(CASE WHEN id % 7 = 0 THEN version + 1 ELSE version END AS INTEGER) AS memory_version, sha256(CASE WHEN id % 5 = 0 THEN 'moved' ELSE content END) AS content_hash, 0 AS unit_index, 'new' AS text FROM m WHERE id % 3 = 0),
g AS (SELECT n.* FROM n JOIN m ON m.id = n.memory_id AND m.version = n.memory_version AND sha256(m.content) = n.content_hash)
SELECT memory_id, memory_version, unit_index, text FROM g UNION ALL SELECT * FROM o WHERE memory_id NOT IN (SELECT memory_id FROM g)""")
def publish_units(spark, sf):
    m = memories(spark, sf)
    old = m.where("id % 2 = 0").select(F.col("id").alias("memory_id"), F.col("version").alias("memory_version"), F.lit(0).alias("unit_index"), F.lit("old").alias("text"))
    text = F.when(F.col("id") % 5 == 0, "moved").otherwise(F.col("content"))
    new = m.where("id % 3 = 0").select(F.col("id").alias("memory_id"), (F.col("version") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).cast("int").alias("memory_version"), F.sha2(text.cast("binary"), 256).alias("content_hash"), F.lit(0).alias("unit_index"), F.lit("new").alias("text"))
    return G.publish_units(m, old, new)


@query("workspace_rename", f"{M} SELECT CASE WHEN ws = 'src4' THEN 'src3' ELSE ws END AS ws, count(*) AS n FROM m GROUP BY ALL")
def workspace_rename(spark, sf):
    return G.rename_workspace(memories(spark, sf), "src4", "src3").groupBy("ws").agg(F.count("*").alias("n"))


# Requests on conflicts and edits of their first members: a revision that is often right, plans of one or two members, values that stand in what is written or not.
_STEPS = """q AS (SELECT event_id AS seq, user_id * 11 AS conflict_id, CASE WHEN event_id % 48 = 4 THEN 'edit' ELSE (['judge', 'apply', 'apply', 'resolve', 'judge', 'apply', 'replan', 'apply'])[event_id % 8 + 1] END AS action, CAST(event_id % 4 + 1 AS INTEGER) AS revision,
  (['alpha', 'BETA', 'gamma'])[event_id // 8 % 3 + 1] AS chosen, event_id % 3 = 0 AS two, (['update_current_claim', 'preserve_historical_record', 'append_superseded_context', 'needs_authorization'])[event_id // 8 % 4 + 1] AS act,
  CASE WHEN event_id % 48 = 4 THEN user_id * 11 + 1 ELSE user_id * 11 + 1 + event_id // 16 % 2 END AS memory_id, 'now it is ' || (['alpha', 'beta', 'delta'])[event_id % 3 + 1] AS content, event_id % 9 <> 0 AS authorized FROM events),
cc AS (SELECT c.conflict_id, c.ws, c.status, c.revision, list_transform(members, lambda i: CAST(i AS BIGINT)) AS members FROM c),
mm AS (SELECT conflict_id, unnest(members) AS id FROM cc),
st AS (SELECT mm.conflict_id, list({'id': m.id, 'ver': m.version, 'rec': m.version + CASE WHEN mm.conflict_id % 2 = 1 AND m.id % 11 = 2 THEN 1 ELSE 0 END, 'live': m.status = 'active' AND m.ws = cc.ws, 'active': m.status = 'active', 'guarded': m.protection_level = 'locked' OR m.source_type = 'user_confirmed'} ORDER BY m.id) AS recs
  FROM mm JOIN cc USING (conflict_id) JOIN m ON m.id = mm.id GROUP BY mm.conflict_id),
o AS (SELECT *, row_number() OVER (PARTITION BY conflict_id ORDER BY seq) AS k FROM q),
w AS (SELECT conflict_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, status, revision, recs, CAST(NULL AS VARCHAR) AS val, CAST([] AS STRUCT(id BIGINT, act VARCHAR, st VARCHAR, ver INTEGER)[]) AS plan, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS INTEGER) AS ver_after FROM cc JOIN st USING (conflict_id)
 UNION ALL SELECT conflict_id, k, seq, CASE outcome WHEN 'applying' THEN 'applying' WHEN 'resolved' THEN 'resolved' ELSE status END, CASE WHEN outcome IN ('applying', 'replanned', 'completed', 'apply_failed', 'resolved') THEN revision + 1 ELSE revision END,
  CASE WHEN edits THEN list_transform(recs, lambda x: CASE WHEN x.id = memory_id THEN {'id': x.id, 'ver': CAST(x.ver + 1 AS INTEGER), 'rec': x.rec, 'live': x.live, 'active': x.active, 'guarded': x.guarded} ELSE x END) ELSE recs END,
  CASE outcome WHEN 'applying' THEN lower(chosen) ELSE val END,
  CASE WHEN outcome IN ('applying', 'replanned') THEN list_transform(want, lambda x: {'id': x.id, 'act': x.act, 'st': 'pending', 'ver': list_filter(recs, lambda r: r.id = x.id)[1].ver})
   WHEN outcome IN ('completed', 'apply_failed') THEN list_transform(plan, lambda x: CASE WHEN x.id = memory_id THEN {'id': x.id, 'act': x.act, 'st': outcome, 'ver': x.ver} ELSE x END) ELSE plan END,
  outcome, CASE WHEN edits THEN CAST(rec.ver + 1 AS INTEGER) END FROM (
  SELECT *, outcome = 'applied' OR (outcome IN ('completed', 'apply_failed') AND act IN ('update_current_claim', 'append_superseded_context')) AS edits FROM (
  SELECT *, CASE
    WHEN action = 'edit' THEN CASE WHEN rec.id IS NULL THEN 'missing' WHEN NOT rec.active THEN 'not_active' WHEN rec.guarded AND NOT authorized THEN 'protected' ELSE 'applied' END
    WHEN action IN ('apply', 'replan') AND NOT authorized THEN 'unauthorized' WHEN action = 'judge' AND status <> 'open' THEN 'not_open' WHEN action <> 'judge' AND status <> 'applying' THEN 'not_applying' WHEN revision <> asked THEN 'stale_conflict'
    WHEN action = 'judge' THEN CASE WHEN chosen = 'gamma' THEN 'invalid_chosen_value' WHEN len(list_filter(want, lambda x: NOT coalesce(list_filter(recs, lambda r: r.id = x.id)[1].live AND list_filter(recs, lambda r: r.id = x.id)[1].ver = list_filter(recs, lambda r: r.id = x.id)[1].rec, false))) > 0 THEN 'stale_member' ELSE 'applying' END
    WHEN action = 'replan' THEN CASE WHEN len(list_filter(want, lambda x: NOT coalesce(list_filter(recs, lambda r: r.id = x.id)[1].live, false))) > 0 THEN 'invalid_plan' ELSE 'replanned' END
    WHEN action = 'apply' THEN CASE WHEN own.id IS NULL OR own.act <> act OR own.st <> 'pending' THEN 'invalid_action' WHEN rec.ver <> own.ver THEN 'stale_member' WHEN act = 'needs_authorization' THEN 'apply_failed' WHEN act = 'update_current_claim' AND NOT contains(content, val) THEN 'apply_failed' ELSE 'completed' END
    WHEN len(list_filter(plan, lambda x: x.st <> 'completed')) > 0 THEN 'apply_incomplete' ELSE 'resolved' END AS outcome
  FROM (SELECT w.conflict_id, o.k, o.seq, w.status, w.revision, w.recs, w.val, w.plan, o.action, o.revision AS asked, o.chosen, o.act, o.memory_id, o.content, o.authorized,
    CASE WHEN o.two THEN [{'id': w.conflict_id + 1, 'act': o.act}, {'id': w.conflict_id + 2, 'act': 'preserve_historical_record'}] ELSE [{'id': w.conflict_id + 1, 'act': o.act}] END AS want,
    list_filter(w.recs, lambda r: r.id = o.memory_id)[1] AS rec, list_filter(w.plan, lambda x: x.id = o.memory_id)[1] AS own FROM w JOIN o ON o.conflict_id = w.conflict_id AND o.k = w.k + 1))))"""


@query("conflict_steps", f"""WITH RECURSIVE {MEMORIES_SQL}, {CONFLICTS_SQL}, {_STEPS} SELECT q.seq, q.conflict_id, q.action,
 CASE WHEN w.seq IS NOT NULL THEN w.outcome WHEN q.action IN ('apply', 'replan') AND NOT q.authorized THEN 'unauthorized' ELSE 'not_found' END AS outcome,
 CASE WHEN w.outcome IN ('applying', 'replanned', 'completed', 'apply_failed', 'resolved') THEN w.revision END AS revision_after, w.ver_after AS version_after FROM q LEFT JOIN w ON w.seq = q.seq 
WHERE w.seq IS NOT NULL OR q.action <> 'edit'""")
def conflict_steps(spark, sf):
    k = F.col("event_id")
    m = memories(spark, sf)
    c = conflicts(spark, sf)
    member = c.select("conflict_id", F.explode("members").alias("id")).join(m.select("id", "version"), "id")
    moved = F.when((F.col("conflict_id") % 2 == 1) & (F.col("id") % 11 == 2), 1).otherwise(0)
    refs = member.groupBy("conflict_id").agg(F.collect_list(F.struct(F.col("id").alias("memory_id"), (F.col("version") + moved).cast("int").alias("version"))).alias("members"))
    given = c.drop("members").join(refs, "conflict_id").withColumn("values", X.strings(["alpha", "beta"]))
    pick = lambda values, at: F.get(X.strings(values), at.cast("int"))
    lot, owner = F.floor(k / 8), F.col("user_id") * 11
    act = pick([*A.ACTIONS[:1], "preserve_historical_record", "append_superseded_context", "needs_authorization"], lot % 4)
    first = F.struct((owner + 1).alias("memory_id"), act.alias("action"))
    second = F.struct((owner + 2).alias("memory_id"), F.lit("preserve_historical_record").alias("action"))
    action = F.when(k % 48 == 4, "edit").otherwise(pick(["judge", "apply", "apply", "resolve", "judge", "apply", "replan", "apply"], k % 8))
    events = table(spark, sf, "events").select(
        k.alias("seq"), owner.alias("conflict_id"), action.alias("action"), (k % 4 + 1).cast("int").alias("revision"), pick(["alpha", "BETA", "gamma"], lot % 3).alias("chosen_value"), F.when(k % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("plan"),
        F.when(k % 48 == 4, owner + 1).otherwise(owner + 1 + F.floor(k / 16) % 2).alias("memory_id"), act.alias("step"), F.concat(F.lit("now it is "), pick(["alpha", "beta", "delta"], k % 3)).alias("content"), (k % 9 != 0).alias("authorized"))
    events = events.join(given.select("conflict_id", F.lit(True).alias("there")), "conflict_id", "left").where("there or action <> 'edit'").drop("there")
    texts = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("content"))
    return A.conflict_steps(given, m, events, texts).select("seq", "conflict_id", "action", "outcome", "revision_after", "version_after")


# Requests of a few slots of a workspace, some without a slot, of old versions, of other workspaces' memories or of one value, by two detectors.
_RECORDS = """q AS (SELECT event_id AS seq, CASE WHEN event_id % 23 <> 0 THEN 'slot' || event_id % 3 END AS slot, user_id % 30 + 1 AS a, user_id % 30 + 21 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS b, user_id % 30 + 41 AS c, event_id % 4 = 0 AS three,
 CAST((user_id % 30) % 3 + 1 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS va, event_id % 6 < 4 AS is_conflict, CASE WHEN event_id % 5 < 2 THEN CAST(1 + event_id // 5 % 3 AS INTEGER) END AS expect, event_id % 19 = 0 AS alike, 'd' || CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END AS det FROM events),
r AS (SELECT q.*, CASE WHEN is_conflict AND slot IS NULL THEN 'invalid_slot_key' WHEN x.id IS NULL OR y.id IS NULL OR (three AND z.id IS NULL) THEN 'stale_snapshot' WHEN x.ws <> y.ws OR (three AND x.ws <> z.ws) THEN 'workspace_mismatch' END AS problem, x.ws,
 list_sort(CASE WHEN three THEN [a || '@' || va, b || '@' || y.version, c || '@' || z.version] ELSE [a || '@' || va, b || '@' || y.version] END) AS refs FROM q LEFT JOIN m x ON x.id = a AND x.version = va LEFT JOIN m y ON y.id = b LEFT JOIN m z ON z.id = c),
o AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY seq) AS n FROM r WHERE problem IS NULL),
w AS (SELECT DISTINCT ws, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS INTEGER) AS rev,
  CAST([] AS STRUCT(g VARCHAR, slot VARCHAR, active BOOLEAN, rev INTEGER, det VARCHAR, refs VARCHAR[])[]) AS gs FROM o
 UNION ALL SELECT ws, n, seq, outcome,
  CASE WHEN outcome = 'inserted' THEN 'r' || seq WHEN outcome = 'duplicate_event' THEN coalesce(e2.g, e1.g) WHEN outcome = 'deduped' THEN CASE WHEN act.g IS NULL OR expect IS NULL THEN twin.g WHEN list_has_all(act.refs, refs) THEN act.g ELSE other.g END WHEN outcome = 'invalid_input' THEN NULL ELSE act.g END,
  CASE WHEN outcome = 'inserted' THEN 1 WHEN outcome = 'appended' THEN act.rev + 1 WHEN outcome = 'duplicate_event' THEN coalesce(e2.rev, e1.rev) WHEN outcome = 'deduped' THEN CASE WHEN act.g IS NULL OR expect IS NULL THEN twin.rev WHEN list_has_all(act.refs, refs) THEN act.rev ELSE other.rev END WHEN outcome = 'invalid_input' THEN NULL ELSE act.rev END,
  CASE outcome WHEN 'inserted' THEN list_append(gs, {'g': 'r' || seq, 'slot': slot, 'active': is_conflict, 'rev': CAST(1 AS INTEGER), 'det': det, 'refs': refs})
   WHEN 'appended' THEN list_append(list_filter(gs, lambda x: x.g <> act.g), {'g': act.g, 'slot': slot, 'active': true, 'rev': CAST(act.rev + 1 AS INTEGER), 'det': det, 'refs': combined}) ELSE gs END
  FROM (SELECT *, CASE WHEN act.g IS NOT NULL THEN CASE WHEN NOT is_conflict THEN 'open_group_exists' WHEN expect <> act.rev THEN 'stale_conflict' WHEN expect IS NULL THEN CASE WHEN twin.g IS NULL THEN 'stale_conflict' ELSE 'deduped' END
     WHEN list_has_all(act.refs, refs) THEN 'deduped' WHEN other.g <> act.g THEN 'deduped' WHEN e2.g <> act.g THEN 'duplicate_event' ELSE 'appended' END
    WHEN twin.g IS NOT NULL THEN 'deduped' WHEN expect IS NOT NULL THEN 'stale_conflict' WHEN is_conflict AND alike THEN 'invalid_input' WHEN e1.g IS NOT NULL THEN 'duplicate_event' ELSE 'inserted' END AS outcome
   FROM (SELECT *, list_filter(gs, lambda x: x.det = det AND x.refs = combined)[1] AS other, CASE WHEN act.g IS NOT NULL THEN list_filter(gs, lambda x: x.slot = slot AND x.refs = combined)[1] END AS e2
    FROM (SELECT *, list_sort(list_distinct(list_concat(act.refs, refs))) AS combined
     FROM (SELECT o.*, w.gs, list_filter(w.gs, lambda x: x.slot = o.slot AND x.active)[1] AS act, list_filter(w.gs, lambda x: x.det = o.det AND x.refs = o.refs)[1] AS twin, list_filter(w.gs, lambda x: x.slot = o.slot AND x.refs = o.refs)[1] AS e1
      FROM w JOIN o ON o.ws = w.ws AND o.n = w.n + 1)))))"""


@query("conflict_records", f"""WITH RECURSIVE {MEMORIES_SQL}, {_RECORDS} SELECT r.seq, r.slot, coalesce(r.problem, w.outcome) AS outcome, w.grp AS "group", w.rev AS revision_after FROM r LEFT JOIN w ON w.seq = r.seq""")
def conflict_records(spark, sf):
    k, u = F.col("event_id"), F.col("user_id") % 30
    m = memories(spark, sf)
    ids = table(spark, sf, "events").select(
        k.alias("seq"), F.when(k % 23 != 0, F.concat(F.lit("slot"), (k % 3).cast("string"))).alias("slot"), (u + 1).alias("a"), (u + 21 + F.when(k % 17 == 0, 1).otherwise(0)).alias("b"), (u + 41).alias("c"), (k % 4 == 0).alias("three"),
        (u % 3 + 1 + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("va"), (k % 6 < 4).alias("is_conflict"), F.when(k % 5 < 2, F.floor(k / 5) % 3 + 1).cast("int").alias("expect_revision"), (k % 19 == 0).alias("alike"),
        F.concat(F.lit("d"), F.when(k % 7 == 0, "2").otherwise("1")).alias("detector"))
    version = lambda name: m.select(F.col("id").alias(name), F.col("version").alias(f"v{name}"))
    j = ids.join(version("b"), "b", "left").join(version("c"), "c", "left")
    one = lambda i, v, value: F.struct(F.col(i).alias("memory_id"), F.coalesce(v, F.lit(-1)).alias("version"), F.when(F.col("alike"), "x").otherwise(value).alias("value"), F.lit("").alias("evidence"))
    two = F.array(one("a", "va", "x"), one("b", "vb", "y"))
    requests = j.select("seq", "slot", F.when(F.col("three"), F.concat(two, F.array(one("c", "vc", "z")))).otherwise(two).alias("members"), "is_conflict", "expect_revision", "detector")
    return Q.record_conflicts(m, requests).select("seq", "slot", "outcome", "group", "revision_after")


# Notices of a third of all records over four slots of a workspace, each asked for twice; a formal group holds the first slot of each workspace.
_ESCALATE = """k AS (SELECT doc_id AS k, source AS ws, CASE WHEN doc_id % 24 <> 0 THEN 's' || doc_id // 20 % 4 END AS slot, doc_id % 3 = 0 AS there, CASE WHEN doc_id % 2 = 0 THEN [doc_id + 1, doc_id + 21, doc_id + 41] ELSE [doc_id + 1, doc_id + 21] END AS ids, CASE WHEN doc_id % 9 = 3 THEN 1 ELSE 0 END AS off FROM documents),
fr AS (SELECT e.k, bool_and(coalesce(m.status = 'active' AND m.ws = e.ws AND m.version = (e.i - 1) % 3 + 1 + e.off, false)) AS fresh FROM (SELECT k, ws, off, unnest(ids) AS i FROM k WHERE there) e LEFT JOIN m ON m.id = e.i GROUP BY e.k),
r AS (SELECT k.*, k * 2 + t AS seq, CASE WHEN NOT there THEN 'not_found' WHEN slot IS NULL OR k % 15 = 0 THEN 'structured_group_required' WHEN NOT fresh THEN 'stale_snapshot' WHEN k % 10 = 6 THEN 'already_terminal' END AS problem, list_transform(ids, lambda i: i || '@' || ((i - 1) % 3 + 1 + off)) AS refs
  FROM k LEFT JOIN fr USING (k), (VALUES (0), (1)) v(t)),
o AS (SELECT *, row_number() OVER (PARTITION BY ws, slot ORDER BY seq) AS n FROM r WHERE problem IS NULL),
f AS (SELECT source AS ws, min(doc_id) AS f FROM documents GROUP BY source),
w AS (SELECT s.ws, s.slot, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS INTEGER) AS rev,
  CASE WHEN s.slot = 's0' THEN {'g': 'g' || f, 'open': length(s.ws) % 2 = 1, 'rev': CAST(7 AS INTEGER), 'refs': [(f + 1) || '@' || (f % 3 + 1), (f + 21) || '@' || ((f + 20) % 3 + 1), (f + 41) || '@' || ((f + 40) % 3 + 1)]} END AS act, CAST([] AS BIGINT[]) AS done FROM (SELECT DISTINCT ws, slot FROM o) s JOIN f USING (ws)
 UNION ALL SELECT ws, slot, n, seq, outcome, CASE WHEN outcome IN ('already_terminal', 'promoted') THEN 'n' || k ELSE act.g END,
  CASE outcome WHEN 'already_terminal' THEN NULL WHEN 'promoted' THEN 2 WHEN 'appended' THEN act.rev + 1 WHEN 'overflow' THEN act.rev + 1 ELSE act.rev END,
  CASE outcome WHEN 'promoted' THEN {'g': 'n' || k, 'open': true, 'rev': CAST(2 AS INTEGER), 'refs': refs} WHEN 'appended' THEN {'g': act.g, 'open': true, 'rev': CAST(act.rev + 1 AS INTEGER), 'refs': list_distinct(list_concat(act.refs, refs))} WHEN 'overflow' THEN {'g': act.g, 'open': true, 'rev': CAST(act.rev + 1 AS INTEGER), 'refs': act.refs} ELSE act END,
  CASE WHEN outcome IN ('promoted', 'appended', 'linked') THEN list_append(done, k) ELSE done END
 FROM (SELECT o.*, w.act, w.done, CASE WHEN list_contains(w.done, o.k) THEN 'already_terminal' WHEN w.act IS NULL THEN 'promoted' WHEN NOT w.act.open THEN 'applying_group_exists' WHEN list_has_all(w.act.refs, o.refs) THEN 'linked' WHEN len(list_distinct(list_concat(w.act.refs, o.refs))) > 256 THEN 'overflow' ELSE 'appended' END AS outcome
  FROM w JOIN o ON o.ws = w.ws AND o.slot = w.slot AND o.n = w.n + 1))"""


@query("notices_escalated", f"""WITH RECURSIVE {MEMORIES_SQL}, {_ESCALATE} SELECT r.seq, r.k AS notice_id, coalesce(r.problem, w.outcome) AS outcome, CASE WHEN r.problem IS NULL THEN w.grp WHEN r.problem <> 'not_found' THEN 'n' || r.k END AS "group", w.rev AS revision_after FROM r LEFT JOIN w ON w.seq = r.seq""")
def notices_escalated(spark, sf):
    """Outcomes of requests that escalate notices of one slot in turn; the formal groups that are there before are open or being applied."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("ws"))
    pins = lambda ids, off, alike: F.transform(ids, lambda i: F.struct(i.alias("memory_id"), ((i - 1) % 3 + 1 + off).cast("int").alias("version"), F.when(alike, "x").otherwise(F.concat(F.lit("v"), (i % 2).cast("string"), (F.floor(i / 20) % 2).cast("string"))).alias("value"), F.lit("").alias("evidence")))
    slot = F.when(k % 24 != 0, F.concat(F.lit("s"), (F.floor(k / 20) % 4).cast("string")))
    ids = F.when(k % 2 == 0, F.array(k + 1, k + 21, k + 41)).otherwise(F.array(k + 1, k + 21))
    named = lambda x: F.concat(F.lit(x), k.cast("string"))
    notices = d.where(k % 3 == 0).select(named("n").alias("group"), "ws", slot.alias("slot"), F.lit("candidate").alias("status"), F.lit(1).alias("revision"), F.lit("d").alias("detector"), F.lit(True).alias("notice"), pins(ids, F.when(k % 9 == 3, 1).otherwise(0), k % 15 == 0).alias("members"), F.when(k % 10 == 6, "dismissed").otherwise("delivered").alias("delivery"))
    first = d.groupBy("ws").agg(F.min("doc_id").alias("doc_id"))
    formal = first.select(named("g").alias("group"), "ws", F.lit("s0").alias("slot"), F.when(F.length("ws") % 2 == 1, "open").otherwise("applying").alias("status"), F.lit(7).alias("revision"), F.lit("d").alias("detector"), F.lit(False).alias("notice"), pins(F.array(k + 1, k + 21, k + 41), F.lit(0), F.lit(False)).alias("members"), F.lit(None).cast("string").alias("delivery"))
    known = notices.unionByName(formal)
    none = F.lit(None)
    requests = d.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1)))).select((k * 2 + F.col("t")).alias("seq"), none.cast("string").alias("slot"), none.cast(known.schema["members"].dataType).alias("members"), none.cast("boolean").alias("is_conflict"), none.cast("int").alias("expect_revision"), none.cast("string").alias("detector"), named("n").alias("escalate"), k.alias("notice_id"))
    records = memories(spark, sf).select("id", "version", "ws", "status")
    return Q.record_conflicts(records, requests, known).select("seq", "notice_id", "outcome", "group", "revision_after")
