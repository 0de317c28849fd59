"""Text as column expressions: normal forms, tokens, anchors, n-grams, values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts that count as CJK, and words that are dropped or weak as anchors.
CJK = "㐀-䶿一-鿿豈-﫿぀-ゟ゠-ヿ가-힯"
STOP_ANCHORS = ["的", "了", "和", "与", "及", "或", "在", "对", "把", "被", "为", "是", "有", "无", "中", "上", "下", "内", "外",
                "一个", "一种", "这个", "那个", "进行", "通过", "相关", "以及", "或者", "可以", "需要", "完成", "记录", "总结", "问题", "情况", "内容"]
GENERIC_ANCHORS = ["系统", "平台", "项目", "方案", "流程", "规范", "配置", "工具", "任务", "文档", "业务", "数据", "接口", "功能", "模块",
                   "状态", "规则", "策略", "交付", "处理", "管理"]
STRIPPED = "。，,;；:：.、· \t-—"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def collapse(x: Column | str) -> Column:
    """White space runs as single blanks, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?U)\s+", " "))


def canon_token(x: Column | str) -> Column:
    """Collapsed, lower-case, without punctuation at the ends."""
    return F.btrim(F.lower(collapse(x)), F.lit(STRIPPED))


def tag_token(x: Column | str) -> Column:
    """Lower-case and trimmed; a v in front of a digit is dropped."""
    return F.regexp_replace(F.lower(F.trim(_col(x))), r"^v(?=\d)", "")


def windows(x: Column | str, size: int) -> Column:
    """All substrings of a size, in order; none if the text is shorter."""
    x = _col(x)
    n = F.length(x)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: x.substr(i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def distinct_windows(x: Column | str, size: int) -> Column:
    """Distinct substrings of the text without white space, lower-case."""
    return F.array_distinct(windows(F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), r"(?U)\s+", ""), size))


def anchors(x: Column | str) -> Column:
    """CJK runs as bigrams, other runs whole and lower-case if they have a letter or digit; stop words dropped."""
    runs = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(rf"[{CJK}]+|[A-Za-z0-9._\-+/]+"), F.lit(0))

    def of(run: Column) -> Column:
        bigrams = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        whole = F.when(run.rlike("[A-Za-z0-9]"), F.array(F.lower(run))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), bigrams).otherwise(whole)

    return F.filter(F.flatten(F.transform(runs, of)), lambda a: ~F.array_contains(strings(STOP_ANCHORS), a))


def anchor_hits(query: Column, surface: Column) -> tuple[Column, Column]:
    """How many query anchors, repeats counted, the surface has: specific and generic ones."""
    generic = strings(GENERIC_ANCHORS)
    specific = F.size(F.filter(query, lambda a: F.array_contains(surface, a) & ~F.array_contains(generic, a)))
    weak = F.size(F.filter(query, lambda a: F.array_contains(surface, a) & F.array_contains(generic, a)))
    return specific, weak


def match_level(specific: Column, generic: Column, query_specific: Column) -> Column:
    """none, weak or medium; strong is for a surface that holds the whole query."""
    total = specific + generic
    covered = F.coalesce(F.try_divide(specific, query_specific), F.lit(0.0)) >= 0.6
    return F.when(total == 0, "none").when(((specific >= 1) & (total >= 2)) | covered, "medium").otherwise("weak")


def sentences(x: Column | str) -> Column:
    """Parts after the sentence marks, without empty ones; an ASCII period ends none."""
    return F.filter(F.transform(F.split(collapse(x), r"(?<=[。！？!?；;])\s*"), lambda s: F.trim(s)), lambda s: s != "")


def long_parts(x: Column | str, size: int = 300, overlap: int = 60, least: int = 8) -> Column:
    """Overlapping windows over a long text; trimmed parts below ``least`` are dropped."""
    x, step = _col(x), size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(x) - overlap) / step).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.trim(x.substr(k * step + 1, F.lit(size))))
    return F.filter(parts, lambda p: F.length(p) >= least)


# Fixed value of the rules: a number with its unit.
VALUE = r"(?<![\w.])v?\d+(?:\.\d+){0,2}\s*(?:ms|s|秒|分钟|小时|天|%|mb|gb|kb|条|次|核|g)?"


def numeric_values(x: Column | str) -> Column:
    """Numbers with their units, in order, repeats kept; a v in front is dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit(VALUE), F.lit(0))
    return F.transform(found, lambda v: F.regexp_replace(F.replace(F.regexp_replace(v, r"(?U)\s+", ""), F.lit("秒"), F.lit("s")), r"^v(?=\d)", ""))


def set_cosine(a: Column, b: Column) -> Column:
    """Common elements over the root of the product of the sizes; 0 if either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.sqrt(F.size(a) * F.size(b).cast("double"))), F.lit(0.0))
