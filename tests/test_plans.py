"""Physical plans: top-k operators, limits before shuffles, no nested loops."""

from pyspark.sql import functions as F

from veritrace.operators import ontology, reasoning, retrieval, views
from veritrace.sources.sample import load

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_loops(text):
    return "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_single_question_is_a_top_k(spark):
    text = plan(retrieval.search_chunks(load(spark, SF_DIR, "fx_chunks"), [0.1] * 64))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_listings_are_top_k(spark):
    for df in (views.recent_facts(load(spark, SF_DIR, "fx_facts")), views.recent_relationships(load(spark, SF_DIR, "fx_relationships"))):
        assert "TakeOrderedAndProject" in plan(df)


def test_related_facts_limit_before_the_shuffle(spark):
    text = plan(reasoning.related_facts(load(spark, SF_DIR, "fx_facts")))
    # The sample's own count of vectors is a one-row subquery, not a loop join.
    assert "WindowGroupLimit" in text and no_loops(text)


def test_or_lookups_are_equi_joins(spark):
    facts = load(spark, SF_DIR, "fx_facts").select("fact_id")
    assert no_loops(plan(views.relationships_of(load(spark, SF_DIR, "fx_relationships"), facts)))
    predicates = load(spark, SF_DIR, "fx_predicates").withColumn("aliases", F.array(F.lit("other")))
    rows = load(spark, SF_DIR, "orders").select(F.col("o_orderpriority").alias("predicate"))
    assert no_loops(plan(ontology.lookup_predicates(rows, predicates)))


def test_views_do_not_read_vectors(spark):
    named = views.named_facts(*[load(spark, SF_DIR, n) for n in ("fx_facts", "fx_documents", "fx_entities", "fx_predicates")])
    scans = [line for line in plan(named.select("fact_id", "subject")).splitlines() if "FileScan" in line]
    assert scans and not any("embedding:array" in line for line in scans)


def test_filters_reach_the_scan(spark):
    pending = load(spark, SF_DIR, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan(pending)


def test_both_ends_of_pairs_read_one_table(spark):
    """Quotes, values and periods of the facts are found once, not once for each end."""
    t = lambda n: load(spark, SF_DIR, n)
    pairs = t("fx_relationships").select("fact_a_id", "fact_b_id")
    df = reasoning.reasoning_context(pairs, t("fx_facts"), t("fx_evidence"), t("fx_documents"), t("fx_entities"), t("fx_predicates"))
    assert any("/sides-" in f for f in df.inputFiles()) and not any("lineitem" in f for f in df.inputFiles())
