"""Queries: lexical and vector recall, fusion, rerank, arbitration, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import lexical as L
from factloom.operators import ranking as R
from factloom.operators import vector as V
from factloom.operators.postings import PostingsIndex, ranked_by_bm25
from factloom.plans.registry import query
from factloom.sources.commits import shared_folder
from factloom.sources.views import MEMORIES_SQL, UNITS_SQL, memories, table, units

M = "WITH " + MEMORIES_SQL + ", t AS (SELECT *, array_to_string(tags, ' ') AS tags_text FROM m)"
TEXT = "the thn"
GROUPS = L.compile_query(TEXT)


def _hit(p: str) -> str:
    return f"(contains(lower(content), '{p}') OR contains(lower(tags_text), '{p}') OR contains(lower(subject), '{p}'))"


@query("fts_and", f"{M} SELECT id FROM t WHERE status = 'active' AND {_hit('the')} AND {_hit('thn')}")
def fts_and(spark, sf):
    return L.with_tags_text(memories(spark, sf)).where("status = 'active'").where(L.match_all(GROUPS)).select("id")


@query("fts_or", f"{M} SELECT id FROM t WHERE status <> 'deleted' AND ({_hit('ación')} OR {_hit('src11')})")
def fts_or(spark, sf):
    return L.with_tags_text(memories(spark, sf)).where("status <> 'deleted'").where(L.match_any(L.compile_query("ación src11 of"))).select("id")


def _count(p: str) -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace(lower({c}), '{p}', ''))) / {len(p)}" for c in ("content", "tags_text", "subject")) + ")"


_BM25 = f"""{M}, x AS (SELECT id, status, ingest_time, {_count('the')} AS t0, {_count('thn')} AS t1, greatest(length(content) - 2, 0) + greatest(length(tags_text) - 2, 0) + greatest(length(subject) - 2, 0) AS len FROM t),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (t0 > 0) AS n0, count(*) FILTER (t1 > 0) AS n1 FROM x),
bm AS (SELECT x.*, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * len / mean)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * len / mean)) AS bm25 FROM x, s WHERE t0 > 0 AND t1 > 0),
lex AS (SELECT id, row_number() OVER (ORDER BY CASE WHEN status = 'superseded' THEN 1 ELSE 0 END, round(bm25, 6) DESC, id) AS rank, round(bm25, 6) AS bm25 FROM bm WHERE status IN ('active', 'superseded'))"""


def _lexical(spark, sf):
    """Channel of the best 50 rows, the only ones that are ranked."""
    found = L.bm25(L.with_tags_text(memories(spark, sf)), GROUPS).where(F.col("status").isin("active", "superseded")).withColumn("bm25", F.round("bm25", 6))
    order = [F.when(F.col("status") == "superseded", 1).otherwise(0), F.desc("bm25"), F.col("id")]
    top = found.select("id", "status", "bm25").orderBy(*order).limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank"), "bm25")


@query("bm25_rank", f"{_BM25} SELECT id, rank, bm25 FROM lex WHERE rank <= 50")
def bm25_rank(spark, sf):
    return _lexical(spark, sf)


@query("postings_bm25", f"{_BM25} SELECT id, rank, bm25 FROM lex WHERE rank <= 50")
def postings_bm25(spark, sf):
    """The same ranking from an index of trigrams with places that is built here."""
    m = L.with_tags_text(memories(spark, sf))
    index = PostingsIndex(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    index.publish(m.select("id", "content", "tags_text", "subject"))
    live = m.where("status in ('active', 'superseded')").select("id", "status", "content", "tags_text", "subject", "event_time", "ingest_time")
    hits = index.bm25(GROUPS).withColumn("bm25", F.round("bm25", 6))
    return ranked_by_bm25(live, hits, TEXT, limit=50).select("id", F.col("place").alias("rank"), F.col("score").alias("bm25"))


_LIKE = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%{p}%'"


@query("like_surface", f"{M} SELECT id FROM t WHERE status = 'active' AND ({_LIKE.format(c='subject', p='th_re')} OR {_LIKE.format(c='tags_text', p='th_re')}) ORDER BY ingest_time DESC, id DESC LIMIT 30")
def like_surface(spark, sf):
    t = L.with_tags_text(memories(spark, sf)).where("status = 'active'")
    return t.where(L.like_ascii("subject", "Th_re") | L.like_ascii("tags_text", "Th_re")).orderBy(F.desc("ingest_time"), F.desc("id")).limit(30).select("id")


@query("like_content", f"{M} SELECT id FROM t WHERE status = 'active' AND {_LIKE.format(c='content', p='tion%the')} ORDER BY ingest_time DESC, id DESC LIMIT 30")
def like_content(spark, sf):
    return memories(spark, sf).where("status = 'active'").where(L.like_ascii("content", "tion%the")).orderBy(F.desc("ingest_time"), F.desc("id")).limit(30).select("id")


@query("gated_recall", f"""{M}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM t WHERE status = 'active' AND {_hit('thn')}),
b AS (SELECT id, row_number() OVER (ORDER BY ingest_time DESC, id DESC) AS pos FROM t WHERE status = 'active' AND {_LIKE.format(c='subject', p='the')}),
x AS (SELECT id, 0 AS channel, pos FROM a UNION ALL SELECT id, 1, pos FROM b), y AS (SELECT id, min((channel, pos)) AS k FROM x GROUP BY id)
SELECT id, CAST(k[1] AS INTEGER) AS channel, k[2] AS pos FROM y ORDER BY k[1], k[2], id LIMIT 40""")
def gated_recall(spark, sf):
    t = L.with_tags_text(memories(spark, sf)).where("status = 'active'")
    ranked = lambda df, *by: df.orderBy(*by).limit(40).select("id", F.row_number().over(Window.orderBy(*by)).cast("long").alias("pos"))  # noqa: E731  no channel gives more than the pool holds
    first = ranked(t.where(L.match_all([["thn"]])), F.col("id"))
    second = ranked(t.where(L.like_ascii("subject", "the")), F.desc("ingest_time"), F.desc("id"))
    return L.gated([first, second], 40)


@query("overlap_shortlist", f"""{M}, live AS (SELECT * FROM t WHERE status = 'active'),
pool AS (SELECT id FROM live WHERE {_hit('thnd')} OR {_hit('enan')} UNION SELECT id FROM (SELECT id FROM live ORDER BY ingest_time DESC, id DESC LIMIT 40)),
rows AS (SELECT * FROM live WHERE id IN (SELECT id FROM pool)),
own AS (SELECT DISTINCT id, lower(tag) AS tag FROM (SELECT id, unnest(tags) AS tag FROM rows) WHERE lower(tag) IN ('en', 'fr', 'src3', 'src4', 'todo')),
telling AS (SELECT tag FROM own GROUP BY tag HAVING NOT (count(*) + 1 >= 3 AND count(*) * 2 >= (SELECT count(*) FROM rows))),
bt AS (SELECT id, count(*) AS tag_hits FROM own WHERE tag IN (SELECT tag FROM telling) GROUP BY id),
sc AS (SELECT id, ingest_time, coalesce(tag_hits, 0) AS tag_hits, CAST(contains(lower(subject), 'thnd') AS BIGINT) + CAST(contains(lower(subject), 'enan') AS BIGINT) AS subject_hits FROM rows LEFT JOIN bt USING (id))
SELECT * FROM sc WHERE tag_hits > 0 OR subject_hits > 0 ORDER BY tag_hits > 0 AND subject_hits > 0 DESC, tag_hits DESC, subject_hits DESC, ingest_time DESC, id DESC LIMIT 25""")
def overlap_shortlist(spark, sf):
    return L.overlap_shortlist(memories(spark, sf), ["EN", "fr", "src3", "src4", "todo"], ["thnd", "enan"], 40, 25)


@query("metadata_overlap", f"{M} SELECT id, list_has_any(tags, ['todo', 'src9']) AS by_tag FROM m WHERE status = 'active' AND (list_has_any(tags, ['todo', 'src9']) OR contains(lower(subject), 'thand') OR contains(lower(subject), 'ereau'))")
def metadata_overlap(spark, sf):
    tag = F.arrays_overlap("tags", F.array(F.lit("todo"), F.lit("src9")))
    word = F.contains(F.lower("subject"), F.lit("thand")) | F.contains(F.lower("subject"), F.lit("ereau"))
    return memories(spark, sf).where("status = 'active'").where(tag | word).select("id", tag.alias("by_tag"))


def _query_vector(spark, sf):
    return units(spark, sf).where("unit_id = 7").select("embedding").first()[0]


_L2 = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (u.embedding[i] - q.e[i]) * (u.embedding[i] - q.e[i]))))"
_KNN = f"{M}, {UNITS_SQL}, q AS (SELECT embedding AS e FROM u WHERE unit_id = 7), live AS (SELECT u.*, {_L2} AS d FROM u, q WHERE memory_id IN (SELECT id FROM m WHERE status = 'active') AND memory_id <> 2)"


def _live_units(spark, sf):
    live = memories(spark, sf).where("status = 'active'").select(F.col("id").alias("memory_id"))
    return units(spark, sf).where("memory_id <> 2").join(live, "memory_id", "left_semi")


@query("knn_l2", f"{_KNN} SELECT unit_id, memory_id, round(d, 6) AS distance FROM live ORDER BY d, unit_id LIMIT 20")
def knn_l2(spark, sf):
    return V.knn(_live_units(spark, sf), _query_vector(spark, sf), 20).select("unit_id", "memory_id", F.round("distance", 6).alias("distance"))


# Units that stand behind the pool of 50 memories: eight for each, so that memories of many units leave room.
EVIDENCE_POOL = 8 * 50
_EVIDENCE = f"""k AS (SELECT *, 1 - d AS score FROM live ORDER BY d, unit_id LIMIT 400),
rk AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY d, unit_id) AS r FROM k),
mo AS (SELECT *, row_number() OVER (PARTITION BY memory_id, kind ORDER BY r) AS turn FROM rk WHERE r BETWEEN 2 AND 4),
ex AS (SELECT memory_id, sum(greatest(0.0, score - 0.45)) AS extra FROM mo WHERE turn = 1 GROUP BY memory_id),
ev AS (SELECT memory_id AS id, score AS best, score + 0.08 * coalesce(extra, 0) AS total FROM rk LEFT JOIN ex USING (memory_id) WHERE r = 1),
evr AS (SELECT id, row_number() OVER (ORDER BY round(total, 6) DESC, id) AS rank FROM ev)"""


def _evidence(spark, sf):
    hits = V.knn(_live_units(spark, sf), _query_vector(spark, sf), EVIDENCE_POOL)
    return V.memory_scores(hits.select("memory_id", "unit_id", "kind", "distance"))


@query("knn_memory_agg", f"{_KNN}, {_EVIDENCE} SELECT id, round(best, 6) AS best, round(total, 6) AS score FROM ev")
def knn_memory_agg(spark, sf):
    return _evidence(spark, sf).select(F.col("memory_id").alias("id"), F.round("best", 6).alias("best"), F.round("score", 6).alias("score"))


@query("batch_knn", f"""WITH {UNITS_SQL}, a AS (SELECT * FROM u WHERE unit_id % 25 = 0),
p AS (SELECT a.unit_id AS anchor_id, u.unit_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (u.embedding[i] - a.embedding[i]) * (u.embedding[i] - a.embedding[i])))) AS d FROM a JOIN u ON a.memory_id <> u.memory_id),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY d, unit_id) AS rank FROM p)
SELECT anchor_id, unit_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def batch_knn(spark, sf):
    u = units(spark, sf)
    return V.batch_knn(u, u.where("unit_id % 25 = 0"), 5).select("anchor_id", "unit_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("int"))


_CENTRES = f"""ct AS (SELECT label, [{', '.join(f'avg(e[{i}])' for i in range(1, 65))}] AS c FROM (SELECT label, embedding AS e FROM u) GROUP BY label),
cd AS (SELECT b.label, 'topic-' || b.label AS name, 1 - (list_sum(list_transform(range(1, 65), lambda i: a.c[i] * b.c[i])) / (sqrt(list_sum(list_transform(a.c, lambda x: x * x))) * sqrt(list_sum(list_transform(b.c, lambda x: x * x))))) AS d FROM ct a, ct b WHERE a.label = 0 AND b.label <> 0)"""


def _centres(spark, sf):
    """Mean vectors by label: as many rows as there are labels."""
    c = units(spark, sf).groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("c"))
    mine = c.where("label = 0").select(F.col("c").alias("mine"))
    return c.where("label <> 0").join(F.broadcast(mine)).select("label", F.concat(F.lit("topic-"), F.col("label").cast("string")).alias("name"), V.cosine_distance(F.col("mine"), F.col("c")).alias("d"))


@query("cosine_top5", f"WITH {UNITS_SQL}, {_CENTRES}, top AS (SELECT * FROM cd ORDER BY d, name LIMIT 5) SELECT name, round(d, 6) AS distance FROM top WHERE name NOT IN ('topic-3')")
def cosine_top5(spark, sf):
    top = _centres(spark, sf).orderBy("d", "name").limit(5)
    return top.where(F.col("name") != "topic-3").select("name", F.round("d", 6).alias("distance"))


@query("admitted_canonicals", f"WITH {UNITS_SQL}, {_CENTRES} SELECT name, round(d, 6) AS distance FROM cd WHERE d <= 0.9 UNION ALL SELECT 'topic-0', 0.0")
def admitted_canonicals(spark, sf):
    c = _centres(spark, sf)
    d = V.guarded_distance(F.lit("topic-0"), F.col("name"), F.col("d"))
    own = spark.range(1).select(F.lit("topic-0").alias("name"), F.lit(0.0).alias("distance"))
    return c.withColumn("g", d).where("g <= 0.9").select("name", F.round("g", 6).alias("distance")).unionByName(own)


_FUSE = f"""{_BM25.replace(M, _KNN)}, {_EVIDENCE}, lx AS (SELECT id, rank FROM lex WHERE rank <= 50), ex50 AS (SELECT id, rank FROM evr WHERE rank <= 50),
fu AS (SELECT id, lx.rank AS lexical_rank, ex50.rank AS evidence_rank, coalesce(1 / (60.0::DOUBLE + lx.rank), 0) + coalesce(1 / (60.0::DOUBLE + ex50.rank), 0) AS fusion FROM lx FULL JOIN ex50 USING (id)),
ad AS (SELECT * FROM fu ORDER BY CASE WHEN lexical_rank <= 25 OR evidence_rank <= 25 THEN 0 ELSE 1 END, fusion DESC, coalesce(lexical_rank, 1000000000), id LIMIT 50)"""


def _fused(spark, sf):
    evidence = _evidence(spark, sf).select(F.col("memory_id").alias("id"), F.round("score", 6).alias("score"))
    order = [F.desc("score"), F.col("id")]
    top = evidence.orderBy(*order).limit(50)
    return R.fuse(_lexical(spark, sf), top.select("id", F.row_number().over(Window.orderBy(*order)).alias("rank")), 50)


@query("rrf_fusion", f"{_FUSE} SELECT id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(evidence_rank AS INTEGER) AS evidence_rank, round(fusion, 8) AS fusion FROM ad")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("id", "lexical_rank", "evidence_rank", F.round("fusion", 8).alias("fusion"))


def _anchor_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9._\\-+/]+'), lambda a: regexp_matches(a, '[a-z0-9]'))"


def _hits_sql(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(list_contains({_anchor_sql(column)}, '{w}') AS INTEGER)" for w in words) + ")"


def _level_sql(column: str, text: str) -> str:
    words = text.split()
    h = _hits_sql(column, words)
    return f"CASE WHEN {column} = '' THEN 'none' WHEN contains(lower({column}), '{text}') THEN 'strong' WHEN {h} = 0 THEN 'none' WHEN {h} >= 2 OR {h} / {len(words)} >= 0.6 THEN 'medium' ELSE 'weak' END"


def _tag_sql(text: str) -> str:
    words = text.split()
    r = "(" + " + ".join(f"CAST(list_contains(list_transform(tags, lambda t: regexp_replace(lower(trim(t)), '^v([0-9])', '\\1')), '{w}') AS INTEGER)" for w in words) + f") / {len(words)}"
    return f"CASE WHEN {r} >= 1 THEN 'strong' WHEN {r} >= 0.5 THEN 'medium' WHEN {r} > 0 THEN 'weak' ELSE 'none' END"


@query("surface_levels", f"{M} SELECT id, {_level_sql('subject', 'the of en')} AS subject_level, {_tag_sql('the of en')} AS tag_level FROM m")
def surface_levels(spark, sf):
    return memories(spark, sf).select("id", R.surface_level("the of en", F.col("subject")).alias("subject_level"), R.tag_level("the of en", F.col("tags")).alias("tag_level"))


_POINTS = "CASE {x} WHEN 'strong' THEN 10.0 WHEN 'medium' THEN 6.0 WHEN 'weak' THEN 2.0 ELSE 0.0 END"
_HYBRID = f"""{_FUSE}, pl AS (SELECT m.*, fusion, evidence_rank, {_level_sql('subject', TEXT)} AS subject_level, {_tag_sql(TEXT)} AS tag_level,
  CASE WHEN contains(lower(content), '{TEXT}') THEN 3.0 WHEN {_hits_sql('content', TEXT.split())} >= 2 THEN 1.5 ELSE 0.0 END AS content_score FROM m JOIN ad USING (id)),
re AS (SELECT *, {_POINTS.format(x='subject_level')} + {_POINTS.format(x='tag_level')} + content_score
  - CASE WHEN subject_level = 'none' AND tag_level = 'none' AND content_score > 0 THEN 2.0 ELSE 0.0 END
  - CASE WHEN subject_level IN ('none', 'weak') AND tag_level IN ('none', 'weak') AND length(content) > 2000 AND content_score > 0 THEN 1.5 ELSE 0.0 END AS rel FROM pl),
fi AS (SELECT *, CASE WHEN evidence_rank IS NOT NULL THEN greatest(rel, 2.5) ELSE rel END AS relevance, DATE '2024-12-31' - ingest_time AS age FROM re),
sc AS (SELECT id, ingest_time, relevance + 300 * fusion + CASE WHEN source_type = 'user_confirmed' OR protection_level = 'locked' THEN 0.5 WHEN source_type = 'document_extracted' THEN 0.3 ELSE 0.0 END
  + CASE WHEN age < 0 THEN 0.0 WHEN age <= 7 THEN 0.30 WHEN age <= 30 THEN 0.15 WHEN age <= 90 THEN 0.05 ELSE 0.0 END + CASE WHEN ws = 'src8' THEN 0.30 ELSE -0.15 END
  - CASE WHEN status = 'superseded' THEN 1000.0 ELSE 0.0 END AS final_score, relevance FROM fi)
SELECT id, CAST(round(relevance, 4) AS DOUBLE) AS relevance, CAST(round(final_score, 4) AS DOUBLE) AS final_score FROM sc ORDER BY round(final_score, 6) DESC, ingest_time DESC, id LIMIT 20"""


@query("hybrid_find", _HYBRID)
def hybrid_find(spark, sf):
    pool = memories(spark, sf).join(F.broadcast(_fused(spark, sf)), "id")
    ranked = R.rerank(pool, TEXT, "2024-12-31", workspace="src8")
    return ranked.orderBy(F.desc(F.round("final_score", 6)), F.desc("ingest_time"), "id").limit(20).select("id", F.round("relevance", 4).alias("relevance"), F.round("final_score", 4).alias("final_score"))


@query("linked_open_items", f"""{M}, live AS (SELECT * FROM m WHERE status = 'active'), tg AS (SELECT DISTINCT id, ws, ingest_time, unnest(tags) AS tag FROM live),
cm AS (SELECT tag FROM tg GROUP BY tag HAVING count(*) >= 3 AND count(*) / (SELECT count(*) FROM live) >= 0.20),
te AS (SELECT * FROM tg WHERE length(tag) > 1 AND tag <> 'todo' AND tag NOT IN (SELECT tag FROM cm)), h AS (SELECT id FROM live WHERE id % 50 = 7),
sh AS (SELECT te.* FROM te WHERE tag IN (SELECT tag FROM te WHERE id IN (SELECT id FROM h)) AND id IN (SELECT id FROM live WHERE list_contains(tags, 'todo')) AND id NOT IN (SELECT id FROM h)),
k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ingest_time DESC, id DESC) AS r FROM sh)
SELECT id, ingest_time, count(*) AS shared_tags FROM k WHERE r <= 2 GROUP BY ALL ORDER BY shared_tags DESC, ingest_time DESC, id DESC LIMIT 5""")
def linked_open_items(spark, sf):
    m = memories(spark, sf)
    return L.linked_open_items(m, m.where("status = 'active' and id % 50 = 7").select("id"))


_GUARD = "({p}source_type = 'user_confirmed' OR {p}protection_level IN ('locked', 'protected'))"
_RANK = "CASE {p}source_type WHEN 'user_confirmed' THEN 100 WHEN 'document_extracted' THEN 70 WHEN 'agent_generated' THEN 45 WHEN 'pending' THEN 20 WHEN 'unknown' THEN 10 ELSE 0 END"


@query("arbitrate_pairs", f"""{M}, p AS (SELECT a.id AS l_id, b.id AS r_id, {_GUARD.format(p='a.')} AS lp, {_GUARD.format(p='b.')} AS rp, a.event_time AS le, b.event_time AS re, {_RANK.format(p='a.')} AS ls, {_RANK.format(p='b.')} AS rs, a.confidence AS lc, b.confidence AS rc, a.ingest_time AS li, b.ingest_time AS ri FROM m a JOIN m b ON b.id = a.id + 365)
SELECT l_id, r_id, CASE WHEN lp AND NOT rp THEN 'left' WHEN rp AND NOT lp THEN 'right' WHEN lp AND rp THEN 'manual_review' WHEN le <> re THEN CASE WHEN le > re THEN 'left' ELSE 'right' END
  WHEN ls <> rs THEN CASE WHEN ls > rs THEN 'left' ELSE 'right' END WHEN lc <> rc THEN CASE WHEN lc > rc THEN 'left' ELSE 'right' END WHEN li <> ri THEN CASE WHEN li > ri THEN 'left' ELSE 'right' END ELSE 'tie' END AS winner,
 CASE WHEN lp <> rp THEN 'protected' WHEN lp AND rp THEN 'both_protected' WHEN le <> re THEN 'event_time' WHEN ls <> rs THEN 'source_type' WHEN lc <> rc THEN 'confidence' WHEN li <> ri THEN 'ingest_time' ELSE 'equivalent' END AS reason FROM p""")
def arbitrate_pairs(spark, sf):
    m = memories(spark, sf)
    return R.arbitrate_pairs(m, m, F.col("r_id") == F.col("l_id") + 365)


@query("arbitrate_group", f"""{M}, g AS (SELECT *, id % 150 AS slot, {_GUARD.format(p='')} AS guard, rank() OVER (PARTITION BY id % 150 ORDER BY event_time DESC, {_RANK.format(p='')} DESC, confidence DESC, ingest_time DESC) AS r FROM m WHERE status <> 'deleted')
SELECT slot, count(*) AS records, count(*) FILTER (guard) AS protected, CASE WHEN count(*) FILTER (guard) > 1 THEN NULL WHEN count(*) FILTER (guard) = 1 THEN max(id) FILTER (guard) WHEN count(*) FILTER (r = 1) = 1 THEN max(id) FILTER (r = 1) END AS winner FROM g GROUP BY slot""")
def arbitrate_group(spark, sf):
    return R.arbitrate_groups(memories(spark, sf).where("status <> 'deleted'").withColumn("slot", F.col("id") % 150), "slot")


def _judged(spark, sf):
    """A ranking by length of the labelled documents of each source, with graded relevance."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + F.when(F.col("toxic") == 0, F.col("quality")).otherwise(0)).cast("long").alias("relevance"), F.floor(F.col("n_chars") / 100).alias("score"))


_JUDGED = "WITH j AS (SELECT source AS query, d.doc_id AS id, quality + CASE WHEN toxic = 0 THEN quality ELSE 0 END AS relevance, n_chars // 100 AS score FROM documents d JOIN labels USING (doc_id))"


@query("pairwise_accuracy", f"{_JUDGED} SELECT a.query, count(*) AS pairs, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM j a JOIN j b ON a.query = b.query AND a.relevance > b.relevance GROUP BY a.query")
def pairwise_accuracy(spark, sf):
    return R.pairwise_accuracy(_judged(spark, sf)).select("query", "pairs", F.round("accuracy", 6).alias("accuracy"))


@query("ranking_quality", f"""{_JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, id) AS ideal FROM j)
SELECT query, round(coalesce(sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN relevance / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg,
 round(coalesce(1.0::DOUBLE / min(rank) FILTER (relevance > 0), 0), 6) AS mrr, CAST(max(CASE WHEN rank <= 3 AND relevance > 0 THEN 1 ELSE 0 END) AS INTEGER) AS recall_3, CAST(max(CASE WHEN rank <= 10 AND relevance > 0 THEN 1 ELSE 0 END) AS INTEGER) AS recall_k FROM r GROUP BY query""")
def ranking_quality(spark, sf):
    return R.ranking_quality(_judged(spark, sf)).select("query", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "recall_3", "recall_k")


# Two modes of ranking within each source, by length and by number of the trigram "the", against labelled documents: the first good ones, and each before the first bad ones.
_GOLDEN = """WITH l AS (SELECT doc_id AS id, source AS query, quality = 1 AND toxic = 0 AS good, n_chars, CASE WHEN text IS NULL THEN 0 ELSE (length(text) - length(replace(lower(text), 'the', ''))) / 3 END AS hits FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT 'length' AS mode, query, id, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, id) AS place, false AS fallback FROM l UNION ALL SELECT 'matches', query, id, row_number() OVER (PARTITION BY query ORDER BY hits DESC, id), hits = 0 FROM l),
s AS (SELECT mode, query, list(id ORDER BY place) AS ids, bool_or(fallback) AS fell FROM b WHERE place <= 10 GROUP BY ALL),
g AS (SELECT query, (list(id ORDER BY id) FILTER (good))[1:3] AS top3, (list(id ORDER BY id) FILTER (NOT good))[1:3] AS bad FROM l GROUP BY query),
o AS (SELECT mode, query, coalesce(ids[1] = top3[1], false) AS top1_hit, coalesce(list_has_any(ids[1:3], top3), false) AS top3_hit, coalesce(len(top3) * len(bad), 0) AS pairs, fell,
 coalesce(len(list_filter(flatten(list_transform(top3, lambda x: list_transform(bad, lambda y: {'x': x, 'y': y}))), lambda p: list_contains(ids, p.x) AND (NOT list_contains(ids, p.y) OR list_position(ids, p.x) < list_position(ids, p.y)))), 0) AS passed FROM s JOIN g USING (query))
SELECT mode, count(*) AS queries, count(*) FILTER (top1_hit) AS top1_hits, round(avg(CAST(top1_hit AS INTEGER)), 6) AS top1_rate, count(*) FILTER (top3_hit) AS top3_hits, round(avg(CAST(top3_hit AS INTEGER)), 6) AS top3_rate,
 CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(passed) AS BIGINT) AS passed, round(coalesce(sum(passed) / nullif(sum(pairs), 0), 0), 6) AS pairwise_rate, round(avg(CAST(fell AS INTEGER)), 6) AS fallback_rate FROM o GROUP BY mode"""


@query("golden_rates", _GOLDEN)
def golden_rates(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    # texts are counted apart from the labels, so that none takes part in a join
    lower = F.lower("text")
    hits = F.coalesce(((F.length("text") - F.length(F.replace(lower, F.lit("the"), F.lit("")))) / 3).cast("long"), F.lit(0))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("query"), "n_chars", hits.alias("hits")).join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id")
    modes = F.array(F.struct(F.lit("length").alias("mode"), F.col("n_chars").cast("long").alias("score"), F.lit(False).alias("fallback")), F.struct(F.lit("matches").alias("mode"), F.col("hits").alias("score"), (F.col("hits") == 0).alias("fallback")))
    scored = d.select("query", "id", F.explode(modes).alias("m")).select("m.*", "query", "id")
    # Spark limits each group before it shuffles for these windows, so a large source is no large window
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("mode", "query").orderBy(F.desc("score"), "id"))).where("place <= 10")
    few = d.where("good is not null").withColumn("k", F.row_number().over(Window.partitionBy("query", "good").orderBy("id"))).where("k <= 3")
    of = lambda good: F.sort_array(F.collect_list(F.when(F.col("good") == good, F.col("id"))))
    sets = d.select("query").distinct().join(few.groupBy("query").agg(of(True).alias("top3"), of(False).alias("bad")), "query", "left")
    pairs = F.flatten(F.transform("top3", lambda x: F.transform("bad", lambda y: F.struct(x.alias("better"), y.alias("worse")))))
    golden = sets.select("query", F.get("top3", F.lit(0)).alias("top1"), "top3", pairs.alias("before"))
    rates = R.golden_rates(R.golden_outcomes(ranked, golden, ["length", "matches"]))
    return rates.select("mode", "queries", "top1_hits", F.round("top1_rate", 6).alias("top1_rate"), "top3_hits", F.round("top3_rate", 6).alias("top3_rate"), "pairs", "passed", F.round("pairwise_rate", 6).alias("pairwise_rate"), F.round("fallback_rate", 6).alias("fallback_rate"))
