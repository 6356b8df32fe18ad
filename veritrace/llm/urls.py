"""URL filter by rules and learned path templates, in SQL expressions only.

Rules are host and path prefixes; the longest that fits decides. Other pages are
judged by a template tree per host, grown level by level over counts, never over pages:

1. A path segment is generalised by itself: digits become ``#``.
2. At each level, segments below one parent template that vary too much (more
   distinct values than ``VARIETY`` of the parent's pages) become the wildcard ``*``.
3. Branches of one parent whose share of good labels does not differ from the parent's by more than
   ``Z`` standard errors are statistically similar and merge into ``*``.
4. A template is rejected if its smoothed purity, (good + PRIOR * base) / (labelled +
   PRIOR), is below ``PURITY``; base is the share of good labels overall.

Counting by (host, generalised segments), and by parent template, combines before the shuffle. A host with a
third of all pages may have as many shapes; its shapes meet the counts of their parents, and pages their
template, by key joins whose large keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrace.llm.base import keep, table

#: Levels of the tree; deeper segments are part of the last level.
DEPTH = 4
VARIETY, Z, PRIOR, PURITY = 0.5, 1.96, 10.0, 0.5
#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty for null or without ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _LETTERS, _LETTERS.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, depth: int = DEPTH) -> list[Column]:
    """``depth`` generalised segments; what is deeper belongs to the last; absent ones are empty."""
    parts = F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/", depth + 1)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(1, depth + 1)]


def templates(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds the template ``t`` to rows (host, s1.., n, good, bad) of distinct shapes."""
    tree = counts.withColumn("t", F.lit(""))
    for i in range(1, depth + 1):
        s = f"s{i}"
        branch = tree.groupBy("host", "t", s).agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        # A host may have most shapes, so what its parents sum up to is combined before the shuffle and joined back.
        above = branch.groupBy("host", "t").agg(
            F.count(F.lit(1)).alias("branches"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"),
            F.sum(F.col("good") + F.col("bad")).alias("all_labelled"),
        )
        branch = branch.join(above, ["host", "t"])
        labelled = F.col("good") + F.col("bad")
        mean = (F.col("all_good") + 0.5) / (F.col("all_labelled") + 1)
        share = (F.col("good") + 0.5) / (labelled + 1)
        error = F.sqrt(mean * (1 - mean) / F.greatest(labelled, F.lit(1)))
        varied = F.col("branches") > VARIETY * F.col("all_n")
        apart = (labelled > 0) & (F.abs(share - mean) > Z * error)
        # A segment kept by itself differs from its siblings and is no variable.
        step = branch.select("host", "t", s, F.when(apart & ~varied, F.col(s)).otherwise(F.when(F.col(s) == "", F.lit("")).otherwise(F.lit("*"))).alias("_s"))
        tree = keep(tree.join(step, ["host", "t", s]).withColumn("t", F.concat("t", F.lit("/"), "_s")).drop("_s"), "tree")
    return tree


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    ``labels`` has page_id and quality (1 good, 0 bad); a page with several labels counts each,
    null labels count for nothing. Pages that a rule decides have no template; a null url has empty host and path and is
    judged by the template of that host. Without labels the base share is 1, so everything is allowed.
    Repeated rows are judged alike. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_m", matched(F.col("host"), F.col("path")))
    names = [f"s{i}" for i in range(1, DEPTH + 1)]
    rows = rows.select("page_id", "host", "path", "_m.rule", "_m.verdict", *(c.alias(n) for n, c in zip(names, segments(F.col("path")))))
    open_pages = rows.filter("verdict is null")
    votes = labels.filter("quality is not null").groupBy("page_id").agg(
        F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    shapes = open_pages.join(votes, "page_id", "left").groupBy("host", *names).agg(F.count(F.lit(1)).alias("n"), zero("good"), zero("bad"))
    shapes = keep(shapes, "shapes")
    tree = templates(shapes)
    base = shapes.agg(F.coalesce((F.sum("good") / F.nullif(F.sum(F.col("good") + F.col("bad")), F.lit(0))), F.lit(1.0)).alias("base"))
    share = tree.groupBy("host", "t").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # The base is one row.
    pure = share.join(F.broadcast(base)).withColumn(
        "purity", (F.col("good") + PRIOR * F.col("base")) / (F.col("good") + F.col("bad") + PRIOR)
    ).select("host", "t", "purity")
    known = tree.select("host", *names, "t").join(pure, ["host", "t"])
    judged = open_pages.drop("rule", "verdict").join(known, ["host", *names]).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.when(F.col("purity") < PURITY, "block").otherwise("allow").alias("verdict"), F.col("t").alias("template"), "purity",
    )
    ruled = rows.filter("verdict is not null").select(
        "page_id", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity")
    )
    return ruled.union(judged)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    return judge_urls(table(spark, sf_dir, "pages"), labels).withColumn("purity", F.round("purity", 9))


def _tree_sql() -> str:
    names = ", ".join(f"s{i}" for i in range(1, DEPTH + 1))
    out = [f"t0 AS (SELECT host, {names}, n, good, bad, '' AS t FROM shapes)"]
    for i in range(1, DEPTH + 1):
        s = f"s{i}"
        out.append(f"""b{i} AS (
    SELECT host, t, {s}, sum(n) AS n, sum(good) AS good, sum(bad) AS bad FROM t{i - 1} GROUP BY ALL
), c{i} AS (
    SELECT *, (sum(good) OVER p + 0.5::DOUBLE) / (sum(good + bad) OVER p + 1) AS mean, (good + 0.5::DOUBLE) / (good + bad + 1) AS share,
           count(*) OVER p > {VARIETY}::DOUBLE * sum(n) OVER p AS varied
    FROM b{i} WINDOW p AS (PARTITION BY host, t)
), t{i} AS (
    SELECT a.host, {", ".join("a.s%d" % j for j in range(1, DEPTH + 1))}, a.n, a.good, a.bad, t || '/' || CASE
        WHEN c.good + c.bad > 0 AND NOT varied AND abs(share - mean) > {Z}::DOUBLE * sqrt(mean * (1 - mean) / greatest(c.good + c.bad, 1))
        THEN {s} WHEN {s} = '' THEN '' ELSE '*' END AS t
    FROM t{i - 1} a JOIN c{i} c USING (host, t, {s})
)""")
    return ", ".join(out)


def _sql() -> str:
    names = ", ".join(f"s{i}" for i in range(1, DEPTH + 1))
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    )
    last = f"coalesce(array_to_string(parts[{DEPTH + 1}:], '/'), '')"
    cols = ", ".join([f"coalesce(parts[{i + 1}], '') AS s{i}" for i in range(1, DEPTH)] + [f"{last} AS s{DEPTH}"])
    return rf"""
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_LETTERS}', '{_LETTERS.lower()}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), m AS (
    SELECT *, CASE {fits} END AS hit, string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') AS parts FROM h
), o AS (
    SELECT page_id, host, path, {cols} FROM m WHERE hit IS NULL
), v AS (
    SELECT doc_id AS page_id, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality <> 1) AS bad
    FROM labels WHERE quality IS NOT NULL GROUP BY 1
), shapes AS (
    SELECT host, {names}, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
    FROM o LEFT JOIN v USING (page_id) GROUP BY host, {names}
), {_tree_sql()}, base AS (
    SELECT coalesce(sum(good)::DOUBLE / nullif(sum(good + bad), 0), 1) AS base FROM shapes
), pure AS (
    SELECT host, t, (sum(good) + {PRIOR}::DOUBLE * min(base)) / (sum(good) + sum(bad) + {PRIOR}::DOUBLE) AS purity FROM t{DEPTH}, base GROUP BY host, t
)
SELECT page_id, host, path, split_part(hit, '|', 2) AS rule, split_part(hit, '|', 1) AS verdict, NULL::VARCHAR AS template, NULL::DOUBLE AS purity
FROM m WHERE hit IS NOT NULL
UNION ALL
SELECT page_id, host, path, NULL, CASE WHEN purity < {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END, t, round(purity, 9)
FROM o JOIN (SELECT host, {names}, t FROM t{DEPTH}) USING (host, {names}) JOIN pure USING (host, t)
"""


SQL = _sql()
