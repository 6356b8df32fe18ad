"""Mixing sources to target weights over a domain, language, source tree.

A token budget goes down the tree. Each node shares its budget among its children
by weight, but none gets more than it can hold: the tokens below it times the epochs
allowed. What a child cannot hold goes to its siblings, so a shortage is made
up as near as possible, and reaches an ancestor only when all siblings are full.
Because capacities are known for whole subtrees, one pass from the root does it.

A leaf repeats all its documents for as many whole epochs as its budget has, then
takes documents in the seeded order of the next epoch while the tokens before
them are below what is left. That order is a hash, so the running sum is a sum over
hash buckets plus one within a bucket, however large the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrace.llm.base import id_or_null, identified, keep, table

LEVELS = ("domain", "lang", "source")
SEED, EPOCHS = 7, 4
#: Characters of the hash that name a bucket: 16**3 buckets.
BUCKET_CHARS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weighted(name: str, weights: dict[str, int], other: int = 1) -> Column:
    """Integer weight by the value of a column."""
    out = F.lit(other).cast("long")
    for value, weight in weights.items():
        out = F.when(F.col(name) == value, F.lit(weight).cast("long")).otherwise(out)
    return out


def _product(a: str, b: str) -> str:
    return f"cast({a} as decimal(19,0)) * cast({b} as decimal(19,0))"


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``got`` to children with ``name``, ``w``, ``cap`` and their parent's ``budget``.

    Children come in the order of capacity over weight. One is full if its capacity
    is within its part of what those before it leave; the rest divide what the full
    ones leave by weight, rounded down. Whole numbers only."""
    family = Window.partitionBy(*parent)
    before = family.orderBy(F.expr("cap / cast(w as double)"), "name").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    x = children.filter("w > 0 and cap > 0").withColumns({
        "_b": F.col("budget") - F.coalesce(F.sum("cap").over(before), zero),
        "_w": F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), zero),
    })
    x = x.withColumn("_full", F.expr(f"_b >= 0 and {_product('cap', '_w')} <= {_product('w', '_b')}"))
    x = x.withColumns({
        "_b": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(family), zero),
        "_w": F.sum("w").over(family) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("w"))).over(family), zero),
    })
    part = F.expr(f"case when _full then cap else cast(({_product('w', '_b')}) div _w as long) end")
    return x.withColumn("got", part).drop("_b", "_w", "_full")


def budgets(leaves: DataFrame, weights: dict[str, Column], total: Column, epochs: int) -> DataFrame:
    """Adds ``budget`` to ``leaves``, which have the levels and ``tokens``."""
    # What weighs 0 on any level gets nothing, so it is no capacity of the nodes above.
    counts = F.lit(True)
    for name in LEVELS:
        counts = counts & (weights[name] > 0)
    cap = F.when(counts, F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")).alias("cap")
    caps = leaves.select(*LEVELS, "tokens", cap, F.lit(0).alias("_root"))
    above = caps.groupBy("_root").agg(F.least(total.cast("long"), F.sum("cap")).alias("budget"))
    parent = ["_root"]
    for name in LEVELS:
        here = [*parent, name]
        level = caps.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumns({"name": F.col(name), "w": weights[name]})
        above = share(level.join(above, parent), parent).select(*here, F.col("got").alias("budget"))
        parent = here
    return caps.join(above, parent).select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, Column], total: Column | None = None, epochs: int = EPOCHS, seed: int = SEED
) -> DataFrame:
    """The picks: one row per document and epoch, with doc_id, ``_h``, domain, lang,
    source, n_tokens, epoch (from 0).

    ``docs`` has doc_id, text, lang and source; tokens are words; ``total`` is the
    budget as an expression over the leaves' ``tokens`` (all of them unless given). A null domain,
    lang or source is the value ``none``. A node of weight 0 gets nothing. Documents
    without words ride along in whole epochs, and in a part of one while its budget lasts.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    named = lambda c: F.coalesce(c, F.lit("none"))
    places = [named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source")]
    rows = keep(identified(docs, *places).withColumn("n_tokens", word_count(F.col("text"))).drop("text"), "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    asked = F.sum("tokens") if total is None else total
    planned = budgets(leaves, weights, asked, epochs).filter("tokens > 0").select(
        *LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("part")
    )
    planned = keep(planned, "budgets")
    known = rows.join(planned, list(LEVELS))
    whole = known.filter("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(whole - 1 as int))")))
    key = F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(id_or_null().cast("string"), F.lit("none"))), "UTF-8"))
    some = known.filter("part > 0").withColumn("_key", key).withColumn("_b", F.substring("_key", 1, BUCKET_CHARS))
    order = Window.partitionBy(*LEVELS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.groupBy(*LEVELS, "_b").agg(F.sum("n_tokens").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    inside = Window.partitionBy(*LEVELS, "_b").orderBy("_key", "n_tokens", "_h").rowsBetween(Window.unboundedPreceding, -1)
    started = some.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums.drop("_n"), [*LEVELS, "_b"])
    rest = started.filter("_at + _in < part").withColumn("epoch", F.col("whole").cast("int"))
    columns = ["_id", "_h", *LEVELS, "n_tokens", "epoch"]
    return whole.select(*columns).union(rest.select(*columns)).withColumn("doc_id", id_or_null()).drop("_id")


#: Integer weights of the sample's tree; what is not named weighs 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}


def sample_domain() -> Column:
    """Four domains by the number that ends a source's name."""
    return F.expr("concat('domain', cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as string))")


def sample_weights() -> dict[str, Column]:
    return {name: weighted(name, WEIGHTS[name]) for name in LEVELS}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), sample_domain(), sample_weights()).drop("_h")


def _level_sql(name: str, parent: str, here: str, above: str, weight: str) -> str:
    """SQL of one level; ``parent`` and ``here`` are column lists."""
    return f"""
{name}0 AS (
    SELECT {here}, c.cap, {weight} AS w, a.budget
    FROM (SELECT {here}, sum(cap) AS cap FROM caps GROUP BY {here}) c JOIN {above} a USING ({parent})
), {name}1 AS (
    SELECT *, budget - coalesce(sum(cap) OVER o, 0) AS b, sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER o, 0) AS lw
    FROM {name}0 WHERE w > 0 AND cap > 0
    WINDOW o AS (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name}2 AS (
    SELECT *, b >= 0 AND CAST(cap AS HUGEINT) * lw <= CAST(w AS HUGEINT) * b AS f FROM {name}1
), {name}3 AS (
    SELECT {here}, CASE WHEN f THEN cap ELSE CAST(w AS HUGEINT) * (budget - coalesce(sum(cap) FILTER (WHERE f) OVER p, 0))
               // (sum(w) OVER p - coalesce(sum(w) FILTER (WHERE f) OVER p, 0)) END AS budget
    FROM {name}2 WINDOW p AS (PARTITION BY {parent})
)"""


def _case(name: str) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[name].items())
    return f"(CASE {name} {whens} ELSE 1 END)" if whens else "1"


SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce('domain' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4), 'none') AS domain,
           coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
    FROM documents
), caps AS (
    SELECT 0 AS root, domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL
), root AS (
    SELECT root, least(sum(tokens), sum(cap)) AS budget FROM caps GROUP BY root
), {_level_sql("domain", "root", "root, domain", "root", _case("domain"))},
{_level_sql("lang", "root, domain", "root, domain, lang", "domain3", _case("lang"))},
{_level_sql("source", "root, domain, lang", "root, domain, lang, source", "lang3", _case("source"))},
leaf AS (
    SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS part
    FROM source3 JOIN caps USING (root, domain, lang, source) WHERE tokens > 0
), k AS (
    SELECT d.*, whole, part, sum(n_tokens) OVER (
        PARTITION BY domain, lang, source ORDER BY md5(concat_ws('-', '{SEED}', whole::BIGINT::VARCHAR, doc_id::VARCHAR)), n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
    FROM d JOIN leaf USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INT) AS epoch FROM k, LATERAL (SELECT unnest(range(0, whole::BIGINT)) AS e) x
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole AS INT) FROM k WHERE part > 0 AND coalesce(prior, 0) < part
"""
