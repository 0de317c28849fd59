"""The query op12 over the given tables, and the same from counts of all runs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.collocation import mine_collocations
from factloom.llm.common import table


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"), size=3, least=10, inside=50, most=2_000)


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(m) WHERE len(w) >= m)
  GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
cut AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
         JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ins AS (
  SELECT DISTINCT lang, sub AS phrase
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM c WHERE m = 3) t
  JOIN (SELECT lang AS sl, phrase AS sp, a AS sa FROM c WHERE m = 2) s ON sl = lang AND sp = sub AND 100 * t.a >= 50 * sa)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM low JOIN tot USING (lang) ANTI JOIN ins USING (lang, phrase))
WHERE rank <= 2000
"""
