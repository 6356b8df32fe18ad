"""Registered queries: vectors, retrieval, listings, views, cards, run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import labels, text as tx, values, vectors
from veritrace.operators import retrieval, views
from veritrace.plans.catalog import query


def rounded(name: str):
    """Distances to six places; adding zero turns -0.0 into 0.0."""
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


SQL_DIST = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def sql_dist(a: str, b: str) -> str:
    return SQL_DIST.format(a=a, b=b)


# Each vector against the next one.
@query("cosine_distance", f"""
    SELECT a.vec_id, round({sql_dist('a.embedding', 'b.embedding')}, 6) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_distance(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id", vectors.cosine_distance(F.col("a"), F.col("b")).alias("distance")
    ).select("vec_id", rounded("distance"))


# Default embedding of every text: unit length, or zero for a text without words.
# No SQL, as the hash is Spark's own; tests compare every vector with a rebuilt one.
@query("embed_hash")
def embed_hash(t):
    embedded = t("documents").select("doc_id", vectors.embed_hash(F.col("text"), dim=64).alias("embedding"))
    return embedded.select("doc_id", "embedding", F.round(vectors.norm(F.col("embedding")), 3).alias("length"))


@query("vector_topk", f"""
    SELECT question_id, chunk_id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INT) AS rank FROM (
      SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, {sql_dist('q.embedding', 'c.embedding')} AS distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_dist('q.embedding', 'c.embedding')}, c.vec_id) AS rank
      FROM embeddings q, embeddings c) WHERE rank <= 4""")
def vector_topk(t):
    questions = t("embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    found = retrieval.search_chunks_batch(questions, t("fx_chunks"))
    return found.select("question_id", "chunk_id", rounded("distance"), "rank")


# Facts tie whenever they share a chunk vector, so the answer is decided by id.
FACT_HITS = f"""
    hits AS (
      SELECT question_id, fact_id, distance, CAST(rank AS INT) AS rank FROM (
        SELECT q.vec_id AS question_id, f.fact_id, d.distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY d.distance NULLS LAST, f.fact_id) AS rank
        FROM embeddings q
        CROSS JOIN (SELECT fact_id, chunk_id FROM fx_facts WHERE status = 'active') f
        LEFT JOIN (SELECT q.vec_id AS qid, c.vec_id AS cid, {sql_dist('q.embedding', 'c.embedding')} AS distance
                   FROM embeddings q, embeddings c) d ON d.qid = q.vec_id AND d.cid = f.chunk_id)
      WHERE rank <= 8)"""


@query("vector_topk_active", f"""
    WITH {FACT_HITS} SELECT question_id, fact_id, round(distance, 6) + 0.0 AS distance, rank FROM hits""")
def vector_topk_active(t):
    questions = t("embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    found = retrieval.search_facts_batch(questions, t("fx_facts"))
    return found.select("question_id", "fact_id", rounded("distance"), "rank")


@query("vector_topk_lsh")
def vector_topk_lsh(t):
    from veritrace.operators.nearest import nearest_by_bucket

    rows = t("fx_chunks")
    return nearest_by_bucket(
        rows.select(F.col("chunk_id").alias("anchor_id"), "embedding"),
        rows.select(F.col("chunk_id").alias("candidate_id"), "embedding"), k=4, dim=64,
    ).select("anchor_id", "candidate_id", rounded("distance"), "rank")


# The same through trained cells, with its recall over every chunk as anchor.
@query("vector_topk_cells")
def vector_topk_cells(t):
    from veritrace.operators.cells import nearest_by_cells

    rows = t("fx_chunks")
    return nearest_by_cells(
        rows.select(F.col("chunk_id").alias("anchor_id"), "embedding"), rows.select(F.col("chunk_id").alias("candidate_id"), "embedding"), k=4
    ).select("anchor_id", "candidate_id", rounded("distance"), "rank")


@query("vector_recall", """
    SELECT count(*) AS asked, CAST(sum(least(4, n)) AS BIGINT) AS exact, true AS enough
    FROM embeddings, (SELECT count(*) AS n FROM embeddings)""")
def vector_recall(t):
    rows = t("fx_chunks").select(F.col("chunk_id").alias("question_id"), "embedding")
    exact = retrieval.search_chunks_batch(rows, t("fx_chunks")).select(F.col("question_id").alias("anchor_id"), F.col("chunk_id").alias("candidate_id"))
    close = vector_topk_cells(t).select("anchor_id", "candidate_id", F.lit(1).alias("hit"))
    return exact.join(close, ["anchor_id", "candidate_id"], "left").agg(
        F.countDistinct("anchor_id").alias("asked"), F.count(F.lit(1)).alias("exact"),
        (F.count("hit") >= F.lit(0.9) * F.count(F.lit(1))).alias("enough"),
    )


# The first character starting after byte 500 is cut off, found by summing
# the byte lengths of the characters.
@query("snippet", """
    SELECT document_id, page_number,
           CASE WHEN strlen(text) <= 500 THEN md5(text) ELSE md5((
             SELECT string_agg(ch, '' ORDER BY i) FROM (
               SELECT i, text[i] AS ch, sum(strlen(text[i])) OVER (ORDER BY i) AS bytes
               FROM range(1, least(len(text), 501) + 1) r(i)) WHERE bytes <= 500) || '…') END AS snippet_md5
    FROM fx_pages""")
def snippet(t):
    return t("fx_pages").select("document_id", "page_number", F.md5(tx.snippet(F.col("text"))).alias("snippet_md5"))


VIEW_SQL = """
    quotes AS (
      SELECT fact_id, string_agg(page_number || ':' || quote, ';' ORDER BY page_number, evidence_id) AS evidence,
             CAST(count(*) AS INT) AS n_evidence
      FROM fx_evidence GROUP BY fact_id),
    views AS (
      SELECT f.fact_id, coalesce(d.filename, '') AS document_filename, e.canonical_name AS subject,
             p.canonical_name AS predicate, f.value_raw, f.status, f.created_at, f.time_value, f.scope,
             coalesce(q.evidence, '') AS evidence, coalesce(q.n_evidence, 0) AS n_evidence
      FROM fx_facts f
      LEFT JOIN fx_documents d ON d.document_id = f.document_id
      LEFT JOIN fx_entities e ON e.entity_id = f.subject_entity_id
      LEFT JOIN fx_predicates p ON p.predicate_id = f.predicate_id
      LEFT JOIN quotes q ON q.fact_id = f.fact_id)"""


def _views(t):
    return views.fact_view(t("fx_facts"), t("fx_documents"), t("fx_entities"), t("fx_predicates"), t("fx_evidence"))


def _named(t):
    return views.named_facts(t("fx_facts"), t("fx_documents"), t("fx_entities"), t("fx_predicates"))


@query("evidence_bundle", f"""
    WITH {FACT_HITS}, {VIEW_SQL},
    relation_rows AS (
      SELECT h.question_id, h.fact_id, h.rank, r.relationship_id
      FROM hits h JOIN fx_relationships r ON r.fact_a_id = h.fact_id OR r.fact_b_id = h.fact_id)
    SELECT h.question_id, 'fact' AS kind, h.rank, h.fact_id AS item_id, v.document_filename AS detail
    FROM hits h JOIN views v ON v.fact_id = h.fact_id
    UNION ALL
    SELECT question_id, 'relationship', rank, relationship_id, CAST(fact_id AS STRING) FROM relation_rows
    UNION ALL
    SELECT question_id, 'chunk', CAST(rank AS INT), chunk_id, CAST(label AS STRING) FROM (
      SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, c.label,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_dist('q.embedding', 'c.embedding')}, c.vec_id) AS rank
      FROM embeddings q, embeddings c) WHERE rank <= 4""")
def evidence_bundle(t):
    questions = t("embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    chunks = t("fx_chunks").withColumn("text", F.col("label").cast("string"))
    facts, relations, found = retrieval.evidence_bundle(
        questions, chunks, t("fx_facts"), _named(t), t("fx_relationships")
    )
    cols = ["question_id", "kind", "rank", "item_id", "detail"]
    return (
        facts.select("question_id", F.lit("fact").alias("kind"), "rank", F.col("fact_id").alias("item_id"),
                     F.col("document_filename").alias("detail"))
        .unionByName(relations.select(
            "question_id", F.lit("relationship").alias("kind"), "rank", F.col("relationship_id").alias("item_id"),
            F.col("fact_id").cast("string").alias("detail")))
        .unionByName(found.select(
            "question_id", F.lit("chunk").alias("kind"), "rank", F.col("chunk_id").alias("item_id"),
            F.col("snippet").alias("detail")))
        .select(*cols)
    )


@query("fact_view", f"""
    WITH {VIEW_SQL}
    SELECT v.fact_id, v.document_filename, v.subject, v.predicate, v.value_raw, e.page_number, e.evidence_id, e.quote
    FROM views v LEFT JOIN fx_evidence e ON e.fact_id = v.fact_id""")
def fact_view(t):
    return _views(t).select(
        "fact_id", "document_filename", "subject", "predicate", "value_raw", "page_number", "evidence_id", "quote"
    )


# The newest facts as the listing shows them, evidence nested.
@query("fact_view_recent", f"""
    WITH {VIEW_SQL}
    SELECT fact_id, document_filename, subject, predicate, value_raw, evidence FROM views WHERE status = 'active'
    ORDER BY created_at DESC, fact_id DESC LIMIT 200""")
def fact_view_recent(t):
    recent = views.recent_facts(t("fx_facts"))
    named = views.named_facts(recent, t("fx_documents"), t("fx_entities"), t("fx_predicates"))
    joined = F.array_join(
        F.transform("evidence", lambda e: F.concat(e["page_number"].cast("string"), F.lit(":"), e["quote"])), ";"
    )
    return views.nest_evidence(named, t("fx_evidence")).select(
        "fact_id", "document_filename", "subject", "predicate", "value_raw", joined.alias("evidence")
    )


@query("facts_recent", """
    SELECT fact_id, document_id, value_raw FROM fx_facts WHERE status = 'active'
    ORDER BY created_at DESC, fact_id DESC LIMIT 200""")
def facts_recent(t):
    return views.recent_facts(t("fx_facts")).select("fact_id", "document_id", "value_raw")


@query("facts_by_document", """
    SELECT document_id, fact_id, status FROM fx_facts WHERE document_id IN (SELECT document_id FROM fx_documents)""")
def facts_by_document(t):
    return views.facts_by_document(t("fx_facts"), t("fx_documents").select("document_id")).select(
        "document_id", "fact_id", "status"
    )


@query("document_list", "SELECT document_id, filename, status FROM fx_documents")
def document_list(t):
    return views.document_list(t("fx_documents")).select("document_id", "filename", "status")


@query("page_list", "SELECT document_id, page_number, CAST(len(text) AS INT) AS n_chars FROM fx_pages")
def page_list(t):
    return views.page_list(t("fx_pages")).select("document_id", "page_number", F.length("text").alias("n_chars"))


@query("job_list", "SELECT document_id, seq, stage, status FROM fx_jobs")
def job_list(t):
    return views.job_list(t("fx_jobs")).select("document_id", "seq", "stage", "status")


@query("entity_list", """
    SELECT entity_id, canonical_name, entity_type FROM fx_entities ORDER BY canonical_name, entity_id LIMIT 200""")
def entity_list(t):
    return views.entity_list(t("fx_entities"))


@query("lookup_batch", """
    SELECT k.document_id, d.filename, d.document_id IS NOT NULL AS found
    FROM (SELECT DISTINCT document_id FROM fx_facts) k LEFT JOIN fx_documents d ON d.document_id = k.document_id""")
def lookup_batch(t):
    keys = t("fx_facts").select("document_id").distinct()
    return views.lookup(t("fx_documents"), keys).select("document_id", "filename", "found")


@query("fact_relationships", """
    SELECT f.fact_id, r.relationship_id FROM fx_facts f
    JOIN fx_relationships r ON r.fact_a_id = f.fact_id
    UNION
    SELECT f.fact_id, r.relationship_id FROM fx_facts f
    JOIN fx_relationships r ON r.fact_b_id = f.fact_id""")
def fact_relationships(t):
    return views.relationships_of(t("fx_relationships"), t("fx_facts").select("fact_id")).select(
        "fact_id", "relationship_id"
    )


@query("relationships_recent", """
    SELECT relationship_id, fact_a_id, fact_b_id FROM fx_relationships
    ORDER BY created_at DESC, relationship_id DESC LIMIT 200""")
def relationships_recent(t):
    return views.recent_relationships(t("fx_relationships")).select("relationship_id", "fact_a_id", "fact_b_id")


SEARCH_HIT = """(contains(lower(subject), '{q}') OR contains(lower(predicate), '{q}')
                 OR contains(lower(value_raw), '{q}') OR contains(lower(document_filename), '{q}'))"""


@query("fact_search", f"""
    WITH {VIEW_SQL} SELECT fact_id, subject, predicate, value_raw, document_filename
    FROM views WHERE {SEARCH_HIT.format(q='0.5 b')} OR {SEARCH_HIT.format(q='.25%')} OR {SEARCH_HIT.format(q='urgent m1')}""")
def fact_search(t):
    named = _named(t)
    found = [views.search_facts(named, term) for term in ("0.5 B", ".25%", "urgent m1")]
    # The three searches may share facts; each fact is listed once.
    hits = found[0].unionByName(found[1]).unionByName(found[2])
    return hits.select("fact_id", "subject", "predicate", "value_raw", "document_filename").dropDuplicates(["fact_id"])


@query("fact_search_recent", f"""
    WITH {VIEW_SQL}, recent AS (
      SELECT * FROM views WHERE status = 'active' ORDER BY created_at DESC, fact_id DESC LIMIT 200)
    SELECT fact_id, value_raw FROM recent WHERE {SEARCH_HIT.format(q='crore')}""")
def fact_search_recent(t):
    recent = views.recent_facts(t("fx_facts"))
    named = views.named_facts(recent, t("fx_documents"), t("fx_entities"), t("fx_predicates"))
    return views.search_facts(named, "Crore").select("fact_id", "value_raw")


@query("fact_summary", "SELECT count(*) AS facts, count(DISTINCT document_id) AS documents FROM fx_facts")
def fact_summary(t):
    return views.fact_summary(t("fx_facts"))


DISPLAY_RANK_SQL = """CAST(CASE coalesce(relationship_type, 'UNCERTAIN')
      WHEN 'CONTRADICTS' THEN 1 WHEN 'POTENTIAL_CONTRADICTION' THEN 2 WHEN 'CORROBORATES' THEN 3
      WHEN 'RECONCILES' THEN 4 WHEN 'SCOPE_DIFFERENCE' THEN 5 WHEN 'UNIT_DIFFERENCE' THEN 6
      WHEN 'TEMPORAL_UPDATE' THEN 7 WHEN 'UNCERTAIN' THEN 8 ELSE 9 END AS INT)"""


@query("conflict_groups", f"""
    SELECT coalesce(relationship_type, 'UNCERTAIN') AS relationship_type, count(*) AS n,
           min({DISPLAY_RANK_SQL}) AS display_rank
    FROM fx_relationships GROUP BY coalesce(relationship_type, 'UNCERTAIN')""")
def conflict_groups(t):
    return views.conflict_groups(t("fx_relationships"))


@query("conflict_rows", f"""
    SELECT relationship_id, coalesce(relationship_type, 'UNCERTAIN') AS relationship_type,
           {DISPLAY_RANK_SQL} AS display_rank FROM fx_relationships""")
def conflict_rows(t):
    return views.conflict_rows(t("fx_relationships")).select("relationship_id", "relationship_type", "display_rank")


@query("conflict_detail", f"""
    WITH {VIEW_SQL},
    firsts AS (SELECT fact_id, arg_min(quote, page_number || '/' || evidence_id) AS quote FROM fx_evidence GROUP BY fact_id)
    SELECT r.relationship_id, a.value_raw AS a_value, a.document_filename AS a_filename, qa.quote AS a_quote,
           b.value_raw AS b_value, b.subject AS b_subject, qb.quote AS b_quote
    FROM fx_relationships r
    LEFT JOIN views a ON a.fact_id = r.fact_a_id LEFT JOIN views b ON b.fact_id = r.fact_b_id
    LEFT JOIN firsts qa ON qa.fact_id = r.fact_a_id AND a.fact_id IS NOT NULL
    LEFT JOIN firsts qb ON qb.fact_id = r.fact_b_id AND b.fact_id IS NOT NULL""")
def conflict_detail(t):
    detail = views.conflict_detail(t("fx_relationships"), _named(t), views.first_evidence(t("fx_evidence")))
    return detail.select(
        "relationship_id", F.col("a_value_raw").alias("a_value"), F.col("a_document_filename").alias("a_filename"),
        "a_quote", F.col("b_value_raw").alias("b_value"), "b_subject", "b_quote",
    )


@query("confidence_band", """
    SELECT fact_id, CASE WHEN confidence >= CAST(0.8 AS FLOAT) THEN 'high' WHEN confidence >= CAST(0.6 AS FLOAT) THEN 'medium'
                         ELSE 'low' END AS band,
           CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS INT) AS percent FROM fx_facts""")
def confidence_band(t):
    conf = F.col("confidence")
    return t("fx_facts").select(
        "fact_id", labels.confidence_band(conf).alias("band"), labels.confidence_percent(conf).alias("percent")
    )


@query("evidence_count", """
    SELECT f.fact_id, count(e.evidence_id) AS n_evidence FROM fx_facts f
    LEFT JOIN fx_evidence e ON e.fact_id = f.fact_id GROUP BY f.fact_id""")
def evidence_count(t):
    return views.evidence_count(t("fx_facts"), t("fx_evidence"))


@query("documents_pending", """
    SELECT document_id, CASE status WHEN 'uploaded' THEN 'Queued' WHEN 'processing' THEN 'Processing'
                                    WHEN 'ready' THEN 'Ready' WHEN 'failed' THEN 'Failed' ELSE status END AS status_label
    FROM fx_documents WHERE status NOT IN ('ready', 'failed')""")
def documents_pending(t):
    return views.pending_documents(t("fx_documents")).select("document_id", "status_label")


VALUES_SQL = r"""
    parsed AS (
      SELECT fact_id, TRY_CAST(replace(regexp_extract(value_raw, '(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DECIMAL(20,6)) AS num,
             lower(regexp_extract(value_raw, '-?[0-9][0-9,]*(?:\.[0-9]+)?\s*(%|[a-zA-Z]+)?', 1)) AS word,
             CASE WHEN value_raw LIKE 'Rs%' OR value_raw LIKE 'INR%' OR value_raw LIKE '₹%' THEN 'INR'
                  WHEN value_raw LIKE 'USD%' THEN 'USD' END AS currency
      FROM fx_facts),
    vals AS (
      SELECT fact_id, num * CASE word WHEN 'crore' THEN 10000000 WHEN 'million' THEN 1000000 WHEN 'lakh' THEN 100000
                                      WHEN 'bn' THEN 1000000000 ELSE 1 END AS amount,
             CASE WHEN num IS NULL THEN NULL WHEN word = 'bn' THEN 'billion' ELSE word END AS unit, currency
      FROM parsed)"""

PERIODS_SQL = r"""
    years AS (
      SELECT fact_id, time_value AS tv,
             CAST(regexp_extract(time_value, '^(?:FY|Q[1-4] FY|financial year )([0-9]{2,4})$', 1) AS STRING) AS fy,
             CAST(nullif(regexp_extract(time_value, '^Q([1-4])', 1), '') AS INT) AS q
      FROM fx_facts),
    ends AS (
      SELECT *, CASE WHEN fy = '' THEN NULL WHEN len(fy) = 4 THEN CAST(fy AS INT)
                     WHEN CAST(fy AS INT) < 70 THEN 2000 + CAST(fy AS INT) ELSE 1900 + CAST(fy AS INT) END AS fye
      FROM years),
    periods AS (
      SELECT fact_id,
        CASE WHEN q IS NOT NULL THEN 'quarter' WHEN fye IS NOT NULL THEN 'fiscal_year'
             WHEN tv LIKE '% to %' THEN 'range' WHEN tv LIKE '____-__-__' THEN 'date'
             WHEN tv LIKE '____' THEN 'calendar_year' ELSE 'unspecified' END AS time_type,
        CAST(CASE WHEN q IS NOT NULL THEN make_date(fye - 1, 4, 1) + to_months(3 * (q - 1))
             WHEN fye IS NOT NULL THEN make_date(fye - 1, 4, 1)
             WHEN tv LIKE '% to %' THEN TRY_CAST(tv[1:10] AS DATE)
             WHEN tv LIKE '____-__-__' THEN TRY_CAST(tv AS DATE)
             WHEN tv LIKE '____' THEN make_date(CAST(tv AS INT), 1, 1) END AS DATE) AS period_start,
        CAST(CASE WHEN q IS NOT NULL THEN make_date(fye - 1, 4, 1) + to_months(3 * q) - INTERVAL 1 DAY
             WHEN fye IS NOT NULL THEN make_date(fye, 3, 31)
             WHEN tv LIKE '% to %' THEN TRY_CAST(tv[15:24] AS DATE)
             WHEN tv LIKE '____-__-__' THEN TRY_CAST(tv AS DATE)
             WHEN tv LIKE '____' THEN make_date(CAST(tv AS INT), 12, 31) END AS DATE) AS period_end
      FROM ends)"""


def with_values(facts):
    """Facts with their parsed value and period as flat columns."""
    return facts.withColumn("_v", values.normalize_value(F.col("value_raw"))).withColumn(
        "_p", values.normalize_period(F.col("time_value"))
    ).select(
        *facts.columns, F.col("_v.amount").alias("amount"), F.col("_v.unit").alias("unit"),
        F.col("_v.currency").alias("currency"), F.col("_p.time_type").alias("time_type"),
        F.col("_p.start").alias("period_start"), F.col("_p.end").alias("period_end"),
    )


@query("normalize_value", f"WITH {VALUES_SQL} SELECT fact_id, CAST(amount AS DOUBLE) AS amount, unit, currency FROM vals")
def normalize_value(t):
    return with_values(t("fx_facts")).select("fact_id", F.col("amount").cast("double").alias("amount"), "unit", "currency")


@query("normalize_period", f"WITH {PERIODS_SQL} SELECT * FROM periods")
def normalize_period(t):
    return with_values(t("fx_facts")).select(
        "fact_id", F.coalesce("time_type", F.lit("unspecified")).alias("time_type"), "period_start", "period_end"
    )


@query("timeline", f"""
    WITH {VALUES_SQL}, {PERIODS_SQL},
    events AS (SELECT f.fact_id, f.subject_entity_id, f.predicate_id, p.period_start, CAST(v.amount AS DOUBLE) AS amount
               FROM fx_facts f JOIN vals v ON v.fact_id = f.fact_id JOIN periods p ON p.fact_id = f.fact_id)
    SELECT fact_id, subject_entity_id, predicate_id, period_start,
           row_number() OVER w AS event_no, amount - lag(amount) OVER w AS change
    FROM events
    WINDOW w AS (PARTITION BY subject_entity_id, predicate_id ORDER BY period_start NULLS LAST, fact_id)""")
def timeline(t):
    events = with_values(t("fx_facts")).select(
        "fact_id", "subject_entity_id", "predicate_id", "period_start", F.col("amount").cast("double").alias("amount")
    )
    return views.timeline(events).select(
        "fact_id", "subject_entity_id", "predicate_id", "period_start", F.col("event_no").cast("long").alias("event_no"),
        "change",
    )


@query("comparison_table", """
    SELECT subject_entity_id, predicate_id, document_id, arg_max(value_raw, created_at::STRING || lpad(fact_id::STRING, 12, '0')) AS value,
           arg_max(fact_id, created_at::STRING || lpad(fact_id::STRING, 12, '0')) AS fact_id, count(*) AS n_facts
    FROM fx_facts GROUP BY subject_entity_id, predicate_id, document_id""")
def comparison_table(t):
    return views.comparison_table(t("fx_facts"))


@query("entity_card", """
    SELECT e.entity_id, e.canonical_name AS name, e.entity_type, count(f.fact_id) AS fact_count
    FROM fx_entities e LEFT JOIN fx_facts f ON f.subject_entity_id = e.entity_id
    GROUP BY e.entity_id, e.canonical_name, e.entity_type""")
def entity_card(t):
    return views.entity_cards(t("fx_entities"), t("fx_facts"))


@query("fact_card", f"""
    WITH {VIEW_SQL}, counts AS (
      SELECT subject_entity_id, predicate_id, value_raw, time_value, count(DISTINCT document_id) AS source_count
      FROM fx_facts GROUP BY ALL)
    SELECT f.fact_id, v.subject, v.predicate, f.value_raw, c.source_count
    FROM fx_facts f JOIN views v ON v.fact_id = f.fact_id
    JOIN counts c ON c.subject_entity_id IS NOT DISTINCT FROM f.subject_entity_id
      AND c.predicate_id IS NOT DISTINCT FROM f.predicate_id
      AND c.value_raw = f.value_raw AND c.time_value IS NOT DISTINCT FROM f.time_value""")
def fact_card(t):
    return views.fact_cards(_named(t)).select("fact_id", "subject", "predicate", "value_raw", "source_count")
