"""Rules on pairs of short texts: decision, coexistence veto, grounding; and the candidate scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import VALUE, distinct_windows, numeric_values, set_cosine, strings

# Fixed values of the rules.
EXPLICIT_SCOPES = [("测试环境", "生产环境"), ("移动端", "管理后台"), ("公开api", "内部api"), ("中国区", "海外区")]
REPLACEMENT_TERMS = ["以后以", "替换", "改为", "不再采用", "之前不对", "旧设计", "新设计", "新口径", "旧口径", "下线", "而不是", "不公开", "公开"]
DONE_TERMS = ["已完成", "已经完成", "已修复", "已经修复", "已发布", "已经发布", "已处理", "完成并"]
NEGATION_TERMS = ["不", "不要", "不能", "不应", "不采用", "不是", "而不是", "移除", "删除", "下线", "不公开", "禁止"]
STOPWORDS = ["用户", "今天", "中午", "想吃", "项目", "系统", "已经", "应该", "可以", "默认", "内容", "记忆", "方案", "设计", "模型", "本地", "腾讯云",
             "一个", "两个", "这个", "那个", "使用", "采用", "固定", "不要", "不能", "不应", "不是", "已经完成"]
VETOES = {
    "coexist_environment_mismatch": [("测试环境", "生产环境"), ("staging", "production"), ("dev", "prod")],
    "coexist_region_mismatch": [("中国区", "海外区"), ("us-east", "eu-west")],
    "coexist_version_mismatch": [("v1", "v2"), ("旧版本", "新版本")],
    "coexist_object_mismatch": [("移动端", "管理后台"), ("客户端", "服务端")],
    "coexist_observation_time_mismatch": [("昨天", "今天"), ("上周", "本周"), ("当时", "目前")],
    "coexist_historical_current": [("历史记录", "当前"), ("曾经", "现在")],
    "coexist_metric_mismatch": [("平均", "峰值"), ("总计", "单项"), ("总数", "其中")],
}
EVOLUTION = ["替换为", "替换成", "升级为", "升级到", "迁移到", "迁移至", "不再采用", "改为", "改成", "切换到", "切换为", "换成", "变为", "变更为", "调整为", "更新为", "更改为"]
TODO_TERMS, HOLDS_TERMS, LACKS_TERMS = ["待办", "todo"], ["包含"], ["不包含", "移除"]
NAMING_TERMS = ["alias", "cli", "命令", "中文名"]
LIKE, LIKE_AT_ALL = 0.45, 0.20
TOKEN = r"[A-Za-z0-9_\-.]+|[一-鿿]{2,}"
NUMBER = r"\d+(?:\.\d+)?\s*(?:mb|gb|kb|%|ms|s|秒|核|g)?"
PIECE = r"[A-Za-z][A-Za-z0-9_.-]*|\d[\d,_.]*\s*(?:ms|s|秒|毫秒|%|mb|gb|kb)?|[一-鿿]{1,24}"
EVIDENCE_ALIASES = [("pgsql", "postgresql"), ("postgres", "postgresql"), ("sqlite_vec", "sqlite-vec")]
TIME_MARKS = ["旧", "新", "此前", "现在", "当前", "之前", "原来", "原先"]


def has(x: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(x, F.lit(t))
    return out


def opposite(a: Column, b: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for x, y in pairs:
        out = out | (has(a, [x]) & has(b, [y])) | (has(a, [y]) & has(b, [x]))
    return out


def normal(x: Column) -> Column:
    """Evidence text without case, separators and aliases."""
    out = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(\d+(?:\.\d+)?)\s*秒", "$1s")
    for alias, name in EVIDENCE_ALIASES:
        out = F.regexp_replace(out, rf"(?U)\b{alias}\b", name)
    return F.regexp_replace(F.regexp_replace(out, r"(?U)[\s_\-]+", ""), r"[^a-z0-9一-鿿.%]+", "")


def tokens(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.btrim(t, F.lit("_.-")))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) & ~F.array_contains(strings(STOPWORDS), t)))


def numbers(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(x), F.lit(NUMBER), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.replace(F.regexp_replace(v, r"(?U)\s+", ""), F.lit("gb"), F.lit("g")))))


def features(x: Column, names: Sequence[tuple[str, str]] = ()) -> Column:
    """struct of all that pair_rule asks of one text; names: two names of one thing each."""
    x = F.coalesce(x, F.lit(""))
    low = F.lower(x)
    bare = F.regexp_replace(low, VALUE, "")
    flags = {"todo": (low, TODO_TERMS), "done": (x, DONE_TERMS), "holds": (x, HOLDS_TERMS), "lacks": (x, LACKS_TERMS), "negative": (x, NEGATION_TERMS), "replaced": (x, REPLACEMENT_TERMS), "naming": (low, NAMING_TERMS)}
    every = lambda found: F.array(*found) if found else F.array().cast("array<boolean>")
    return F.struct(
        normal(x).alias("normal"), numeric_values(x).alias("values"), numbers(x).alias("numbers"),
        tokens(x).alias("tokens"), distinct_windows(x, 3).alias("grams"), tokens(bare).alias("bare_tokens"), distinct_windows(bare, 3).alias("bare_grams"),
        every([has(low, [term]) for pair in EXPLICIT_SCOPES for term in pair]).alias("scopes"),
        every([has(t, [term]) for one, other in names for t, term in ((low, one), (x, other))]).alias("names"),
        *[has(t, terms).alias(k) for k, (t, terms) in flags.items()])


def pair_rule(a: Column, b: Column, n_names: int = 0) -> Column:
    """struct(action, reason) from the features of two texts; the first rule that holds decides."""
    either = lambda k: a[k] | b[k]
    crossed = lambda one, other: (a[one] & b[other]) | (b[one] & a[other])
    other_scope, same_thing = F.lit(False), F.lit(False)
    for i in range(0, 2 * len(EXPLICIT_SCOPES), 2):
        other_scope = other_scope | (a["scopes"][i] & b["scopes"][i + 1]) | (a["scopes"][i + 1] & b["scopes"][i])
    for i in range(0, 2 * n_names, 2):
        same_thing = same_thing | ((a["names"][i] | b["names"][i]) & (a["names"][i + 1] | b["names"][i + 1]) & either("naming"))
    common = F.size(F.array_intersect(a["tokens"], b["tokens"]))
    like = set_cosine(a["grams"], b["grams"])
    alike = (F.size(F.array_intersect(a["bare_tokens"], b["bare_tokens"])) > 0) | (set_cosine(a["bare_grams"], b["bare_grams"]) >= LIKE)
    numeric = (F.size(a["values"]) > 0) & (F.size(b["values"]) > 0) & (a["values"] != b["values"]) & alike
    dropped = crossed("holds", "lacks")
    polar = (a["negative"] != b["negative"]) & (common > 0)
    duplicate = ((F.size(a["numbers"]) > 0) & (a["numbers"] == b["numbers"]) & (like >= LIKE)) | same_thing
    compatible = polar & ~either("replaced") & (common >= 2) & (F.size(F.array_except(b["tokens"], a["tokens"])) > 0) & ~dropped
    out = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    return (
        F.when((a["normal"] != "") & (a["normal"] == b["normal"]), out("ignore", "equivalent_value"))
        .when(other_scope, out("ignore", "explicit_scope_mismatch"))
        .when(numeric, out("check", "numeric_value_candidate"))
        .when((common > 0) & crossed("todo", "done"), out("notify", "todo_resolved"))
        .when(dropped | (polar & (like >= LIKE)), out("notify", "polarity_changed"))
        .when(duplicate, out("ignore", "equivalent_value"))
        .when(compatible, out("ignore", "compatible_evidence"))
        .when((like >= LIKE_AT_ALL) | (common > 0), out("check", "semantic_similarity_only"))
        .otherwise(out("ignore", "insufficient_local_evidence"))
    )


def pair_decision(a: Column, b: Column, names: Sequence[tuple[str, str]] = ()) -> Column:
    """struct(action, reason) for two short texts.

    names: two names of one thing each; statements about such a pair of names say the same.  Over
    many pairs take ``features`` in a projection (or before a join) and ``pair_rule`` of them.
    """
    return pair_rule(features(a, names), features(b, names), len(names))


def coexistence_veto(a: Column, b: Column) -> Column:
    """A code if both statements may hold at once; null if nothing says so."""
    la, lb = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    out = None
    for code, pairs in VETOES.items():
        hit = opposite(la, lb, pairs)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    both = F.concat_ws("\n", la, lb)
    return out.when(has(both, EVOLUTION) & has(both, TIME_MARKS), "coexist_explicit_evolution")


def mechanical(x: Column) -> Column:
    """Lower-case without separators; decimal points between digits stay, unit spellings are one."""
    out = F.trim(F.lower(F.coalesce(x, F.lit(""))))
    out = F.regexp_replace(out, r"(?<=\d)[,_](?=\d)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)(\d+(?:\.\d+)?)\s*秒\b", "$1s"), r"(?U)(\d+(?:\.\d+)?)\s*毫秒\b", "$1ms")
    out = F.regexp_replace(out, r"(?<=\d)\s*(g|k|m|t)b(?![a-z0-9])", "$1")
    out = F.replace(F.regexp_replace(out, r"(?U)[^\w.]+", ""), F.lit("_"), F.lit(""))
    return F.regexp_replace(out, r"(?<!\d)\.|\.(?!\d)", "")


def normal_value(x: Column) -> Column:
    v = mechanical(x)
    return F.when(v.isin("pgsql", "postgres"), "postgresql").otherwise(v)


def grounded(value: Column, quote: Column) -> Column:
    """Whether a short value stands in its quote, as it is or in a normal form of one of its pieces."""
    v = F.trim(value)
    short = (v != "") & (F.length(v) <= 64) & (F.size(F.regexp_extract_all(v, F.lit(r"(?U)\S+"), F.lit(0))) <= 12)
    short = short & (mechanical(v) != "") & (mechanical(v) != mechanical(F.trim(quote))) & ~v.rlike(r"[。！？!?；;](?:[\"'”’）)]*)$")
    pieces = F.regexp_extract_all(quote, F.lit(PIECE), F.lit(0))
    return F.coalesce((quote != "") & short & (F.contains(F.lower(quote), F.lower(value)) | F.exists(pieces, lambda p: normal_value(p) == normal_value(value))), F.lit(False))


def canonical_json(value: Column) -> Column:
    """JSON without blanks, of a struct whose fields are in order of their names."""
    return F.to_json(value)


def candidate_key(detector: Column, evidence: Column) -> Column:
    """Canonical JSON of a candidate's identity; evidence: (memory_id, version, unit, start, end, hash), put in order of id and version."""
    ordered = F.array_sort(evidence)
    ref = lambda e: F.concat_ws("@", e["memory_id"].cast("string"), e["version"].cast("string"))
    shown = lambda e: F.struct(e["hash"].alias("hash"), ref(e).alias("member"), F.array(e["start"], e["end"]).alias("span"), e["unit"].alias("unit"))
    return canonical_json(F.struct(detector.alias("detector_version"), F.transform(ordered, shown).alias("evidence"), F.transform(ordered, ref).alias("members")))


def within_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs(one, other) of refs that both stand in one of groups(refs), by an index of refs to groups."""
    refs = groups.select(F.array_sort(F.array_distinct("refs")).alias("refs")).distinct()
    index = refs.select(F.sha2(F.concat_ws(",", "refs").cast("binary"), 256).alias("group"), F.explode("refs").alias("ref"))
    left = pairs.select("one", "other").distinct().join(index.withColumnRenamed("ref", "one"), "one")
    return left.join(index.withColumnRenamed("ref", "other"), ["group", "other"], "left_semi").select("one", "other").distinct()


def scan_candidates(units: DataFrame, near: DataFrame, recorded: DataFrame, *, detector: str = "rules", similar_too: bool = False) -> DataFrame:
    """Candidate pairs of memories: x, y, state, reasons, distance, members, candidate (its key's sha256).

    units(unit_id, memory_id, version, text, start_offset, end_offset, content_hash) are text units with their features
    taken by ``featured``, near(anchor_id, unit_id, distance) their neighbours.  Every pair of units is judged by itself.  It is left
    out if recorded(status, refs, candidate) holds just this candidate in an open, applying or dismissed (not_a_conflict) group, or if an
    open or applying group holds both snapshots, id@version; so a new version of a memory comes up again.
    A pair of memories comes with all reasons and the least distance; members and candidate are those of the
    first qualifying pair of units.
    """
    side = lambda s: units.select(*[F.col(c).alias(c + s) for c in ("unit_id", "memory_id", "version", "start_offset", "end_offset", "content_hash", "f")])
    pairs = near.select(F.col("anchor_id").alias("unit_id_a"), F.col("unit_id").alias("unit_id_b"), "distance").join(side("_a"), "unit_id_a").join(side("_b"), "unit_id_b").where("memory_id_a <> memory_id_b")
    found = pairs.withColumn("d", pair_rule(F.col("f_a"), F.col("f_b"))).drop("f_a", "f_b").where("d.action <> 'ignore'")
    if not similar_too:
        found = found.where("d.reason <> 'semantic_similarity_only'")
    proof = lambda s: F.struct(*[F.col(c + s).alias(n) for c, n in (("memory_id", "memory_id"), ("version", "version"), ("unit_id", "unit"), ("start_offset", "start"), ("end_offset", "end"), ("content_hash", "hash"))])
    ref = lambda s: F.concat_ws("@", F.col("memory_id" + s).cast("string"), F.col("version" + s).cast("string"))
    first = F.col("memory_id_a") < F.col("memory_id_b")
    found = found.withColumns({
        "x": F.least("memory_id_a", "memory_id_b"), "y": F.greatest("memory_id_a", "memory_id_b"), "one": F.when(first, ref("_a")).otherwise(ref("_b")), "other": F.when(first, ref("_b")).otherwise(ref("_a")),
        "candidate": F.sha2(candidate_key(F.lit(detector), F.array(proof("_a"), proof("_b"))).cast("binary"), 256)})
    known = recorded.where("status in ('open', 'applying', 'not_a_conflict') and candidate is not null").select("candidate").distinct()
    held = within_groups(found, recorded.where("status in ('open', 'applying')"))
    fresh = found.join(known, "candidate", "left_anti").join(held, ["one", "other"], "left_anti")
    return fresh.groupBy("x", "y").agg(
        F.max(F.when(F.col("d.action") == "notify", "notice_ready").otherwise("candidate")).alias("state"),
        F.array_join(F.array_sort(F.collect_set("d.reason")), ",").alias("reasons"), F.min("distance").alias("distance"),
        F.min_by(F.struct(F.concat_ws(",", "one", "other").alias("members"), "candidate"), F.struct("memory_id_a", "unit_id_a", "distance", "unit_id_b")).alias("first")).select("x", "y", "state", "reasons", "distance", "first.*")


def featured(units: DataFrame) -> DataFrame:
    """units with ``f``, all that the pair rule asks of a text, worked out once a unit: write it before it is joined."""
    return units.withColumn("f", features(F.col("text"))).drop("text")
