"""Registered queries: extraction, grounding, ontology, entities, reasoning."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import text as tx
from veritrace.functions.trigrams import similarity
from veritrace.operators import answers, entities, extraction, ontology, reasoning, retrieval, runlog, views
from veritrace.plans.catalog import query
from veritrace.plans.queries_ingest import SQL_WORD, SQL_WS
from veritrace.plans.queries_read import FACT_HITS, PERIODS_SQL, VALUES_SQL, VIEW_SQL, _named, rounded, sql_dist

# ------------------------------------------------- extraction and grounding


def _sentences(t):
    """Every fact written out as a sentence."""
    f = t("fx_facts")
    return f.select(
        F.col("fact_id").alias("chunk_id"), "document_id",
        F.concat(
            F.lit("Supplier "), F.col("document_id").cast("string"), F.lit(" reported "),
            F.coalesce(F.concat("scope", F.lit(" ")), F.lit("")), F.lit("revenue of "), "value_raw",
            F.coalesce(F.concat(F.lit(" for "), "time_value"), F.lit("")), F.lit(".\nNothing else was said."),
        ).alias("text"),
    )


@query("extract_facts", """
    SELECT fact_id AS chunk_id, 'Supplier ' || document_id AS subject, 'revenue' AS predicate, value_raw, time_value, scope
    FROM fx_facts WHERE value_raw <> 'not disclosed'""")
def extract_facts(t):
    return extraction.extract_by_rule(_sentences(t)).select(
        "chunk_id", "subject", "predicate", "value_raw", "time_value", "scope"
    )


# Whole sample texts, each with a closing statement of its own figures.
STATED = """
    SELECT doc_id, coalesce(text, '') AS body,
           concat('Mill ', CAST(doc_id AS STRING), ' reported ', CASE doc_id % 3 WHEN 0 THEN 'revenue' WHEN 1 THEN 'turnover' ELSE 'ebitda' END,
                  ' of Rs. ', CAST(1 + doc_id % 9973 AS STRING), ' crore for FY', CAST(2000 + doc_id % 25 AS STRING), '.') AS said
    FROM {documents}"""


@query("extract_facts_documents", f"""
    SELECT doc_id, concat('Mill ', CAST(doc_id AS VARCHAR)) AS subject, CASE doc_id % 3 WHEN 2 THEN 'ebitda' ELSE 'revenue' END AS predicate,
           concat('Rs. ', CAST(1 + doc_id % 9973 AS VARCHAR), ' crore') AS value_raw, concat('FY', CAST(2000 + doc_id % 25 AS VARCHAR)) AS time_value,
           'exact' AS grounding, CAST(length(body) + 2 AS INT) AS char_start, CAST(length(body) + 2 + length(said) AS INT) AS char_end
    FROM ({STATED.format(documents='documents').replace('STRING', 'VARCHAR')}) d""")
def extract_facts_documents(t):
    docs = t("documents").sparkSession.sql(STATED, documents=t("documents"))
    texts = docs.select("doc_id", F.concat("body", F.lit(". "), "said").alias("text"))
    return extraction.ground(extraction.extract_by_rule(texts)).select(
        "doc_id", "subject", "predicate", "value_raw", "time_value", "grounding", "char_start", "char_end"
    )


# Responses of every shape, one per order.
RAW_SQL = """
    SELECT o_orderkey AS response_id, o_custkey, o_totalprice,
           CASE o_orderkey % 6
             WHEN 0 THEN body
             WHEN 1 THEN concat('Here you are:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'Done.')
             WHEN 2 THEN concat('The facts are ', body, ' as asked.')
             WHEN 3 THEN 'I cannot help with { that'
             WHEN 4 THEN concat('``` not json ```', '```', body, '```')
             ELSE '{"facts": "none"}' END AS raw_response
    FROM (SELECT o_orderkey, o_custkey, o_totalprice,
                 concat('{"facts": [{"subject": "C', CAST(o_custkey AS STRING), '", "subject_type": "',
                        CASE o_orderkey % 7 WHEN 0 THEN 'planet' ELSE 'org' END,
                        '", "predicate": "revenue", "value_raw": "', CAST(o_custkey AS STRING),
                        '", "confidence": ', CASE o_orderkey % 5 WHEN 0 THEN '"high"' WHEN 1 THEN '"0.25"' ELSE '0.75' END,
                        ', "quote": " revenue was ', CAST(o_custkey AS STRING), ' "}, 17, {"quote": "  "}, {"quote": "q", "scope": 3},',
                        ' {"quote": "only", "subject": null}]}') AS body
          FROM {orders}) b"""


def _responses(t):
    orders = t("orders")
    orders.createOrReplaceTempView("responses_source")
    return orders.sparkSession.sql(RAW_SQL.replace("{orders}", "responses_source"))


@query("parse_responses", """
    SELECT o_orderkey AS response_id, o_orderkey % 6 <> 3 AS parsed,
           CASE WHEN o_orderkey % 6 = 3 THEN 'response holds no JSON' END AS error FROM orders""")
def parse_responses(t):
    parsed = extraction.parse_responses(_responses(t))
    return parsed.select("response_id", F.col("parsed").isNotNull().alias("parsed"), "error")


@query("coerce_facts", """
    WITH good AS (SELECT o_orderkey AS response_id, o_custkey FROM orders WHERE o_orderkey % 6 NOT IN (3, 5))
    SELECT response_id, CAST(0 AS INT) AS item_no, 'C' || o_custkey AS subject, 'revenue' AS predicate,
           'revenue was ' || o_custkey AS quote,
           CAST(CASE WHEN response_id % 5 = 0 THEN NULL WHEN response_id % 5 = 1 THEN 0.25 ELSE 0.75 END AS DOUBLE) AS confidence,
           CASE WHEN response_id % 7 = 0 OR response_id % 5 = 0 THEN 'malformed' END AS drop_reason FROM good
    UNION ALL SELECT response_id, 1, 'Unknown', 'unknown', '', 0.5, 'not_object' FROM good
    UNION ALL SELECT response_id, 2, 'Unknown', 'unknown', '', 0.5, 'blank_quote' FROM good
    UNION ALL SELECT response_id, 3, 'Unknown', 'unknown', 'q', 0.5, 'malformed' FROM good
    UNION ALL SELECT response_id, 4, 'None', 'unknown', 'only', 0.5, NULL FROM good""")
def coerce_facts(t):
    items = extraction.coerce_facts(extraction.parse_responses(_responses(t)).drop("error"))
    return items.select(
        "response_id", "item_no", "subject", "predicate", "quote", F.col("confidence").cast("double").alias("confidence"),
        "drop_reason",
    )


# Words 3 to 10 of each text with single blanks between them as the quote.
QUOTE_SQL = rf"""
    quoted AS (
      SELECT document_id, page_number, text,
             array_to_string(list_slice(regexp_extract_all(text, '{SQL_WORD}'), 3, 10), ' ') AS quote,
             array_to_string(list_transform(list_slice(regexp_extract_all(text, '{SQL_WORD}'), 3, 10), lambda w: regexp_escape(w)),
                             '{SQL_WS}+') AS pattern
      FROM fx_pages)"""


def _quotes(t):
    words = F.regexp_extract_all("text", F.lit(f"{tx.NON_WS}+"), 0)
    return t("fx_pages").withColumn("quote", F.array_join(F.slice(words, 3, 8), " "))


@query("ground_exact", f"""
    WITH {QUOTE_SQL}
    SELECT document_id, page_number, CAST(instr(text, quote) - 1 AS INT) AS char_start,
           CAST(instr(text, quote) - 1 + len(quote) AS INT) AS char_end
    FROM quoted WHERE quote <> '' AND instr(text, quote) > 0""")
def ground_exact(t):
    grounded = extraction.ground(_quotes(t))
    return grounded.filter(F.col("grounding") == "exact").select("document_id", "page_number", "char_start", "char_end")


@query("ground_normalized", f"""
    WITH {QUOTE_SQL}, spans AS (
      SELECT *, CASE WHEN quote <> '' THEN nullif(regexp_extract(text, pattern), '') END AS span FROM quoted)
    SELECT document_id, page_number,
           CASE WHEN quote <> '' AND contains(text, quote) THEN 'exact' WHEN span IS NOT NULL THEN 'normalized' ELSE 'none' END AS grounding,
           CAST(instr(text, span) - 1 AS INT) AS char_start, CAST(instr(text, span) - 1 + len(span) AS INT) AS char_end
    FROM spans""")
def ground_normalized(t):
    return extraction.ground(_quotes(t)).select("document_id", "page_number", "grounding", "char_start", "char_end")


@query("ground_strict", f"""
    WITH {QUOTE_SQL}
    SELECT document_id, page_number, md5(quote) AS quote_md5 FROM quoted WHERE contains(text, quote) AND quote <> ''""")
def ground_strict(t):
    return extraction.keep_grounded(_quotes(t)).select("document_id", "page_number", F.md5("quote").alias("quote_md5"))


# Order lines as extraction attempts of a supplier's document.
ATTEMPTS_SQL = """
    attempts AS (
      SELECT l_suppkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_no, CAST(l_linenumber AS BIGINT) AS n_facts,
             CAST(l_quantity AS BIGINT) % 3 AS n_dropped,
             CASE WHEN l_returnflag = 'R' OR l_suppkey % 10 = 3 THEN 'limit reached at ' || l_partkey END AS error
      FROM lineitem)"""
METRICS_SQL = """
    metrics AS (
      SELECT document_id, CAST(sum(n_facts) AS BIGINT) AS facts, CAST(sum(n_dropped) AS BIGINT) AS dropped_ungrounded,
             count(error) AS chunk_errors, count(*) AS chunks_total,
             (list(error ORDER BY chunk_no, error) FILTER (error IS NOT NULL))[1] AS sample_error
      FROM attempts GROUP BY document_id)"""


def _attempts(t):
    failed = (F.col("l_returnflag") == "R") | (F.col("l_suppkey") % 10 == 3)
    return t("lineitem").select(
        F.col("l_suppkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_no"),
        F.col("l_linenumber").cast("long").alias("n_facts"), (F.col("l_quantity").cast("long") % 3).alias("n_dropped"),
        F.when(failed, F.concat(F.lit("limit reached at "), F.col("l_partkey").cast("string"))).alias("error"),
    )


@query("grounding_metrics", f"WITH {ATTEMPTS_SQL}, {METRICS_SQL} SELECT * FROM metrics")
def grounding_metrics(t):
    return extraction.grounding_metrics(_attempts(t))


@query("extraction_outcome", f"""
    WITH {ATTEMPTS_SQL}, {METRICS_SQL}
    SELECT document_id, CASE WHEN chunk_errors > 0 AND chunk_errors = chunks_total THEN 'failed' ELSE 'done' END AS job_status,
           CASE WHEN chunk_errors > 0 AND chunk_errors = chunks_total THEN sample_error END AS job_error,
           'ready' AS document_status FROM metrics""")
def extraction_outcome(t):
    return extraction.extraction_outcome(extraction.grounding_metrics(_attempts(t))).select(
        "document_id", "job_status", "job_error", "document_status"
    )


SENTENCE_SQL = """
    sentences AS (
      SELECT fact_id AS chunk_id, document_id, value_raw, time_value, scope, embedding,
             'Supplier ' || document_id || ' reported ' || coalesce(scope || ' ', '') || 'revenue of ' || value_raw
             || coalesce(' for ' || time_value, '') || '.' AS quote
      FROM fx_facts WHERE value_raw <> 'not disclosed')"""


def _built(t):
    vectors = t("fx_facts").select(F.col("fact_id").alias("chunk_id"), "embedding")
    chunks = _sentences(t).join(vectors, "chunk_id").withColumn("page_start", (F.col("document_id") % 9 + 1).cast("int"))
    found = extraction.keep_grounded(extraction.ground(extraction.extract_by_rule(chunks)))
    return extraction.build_facts(
        found.withColumn("subject_entity_id", F.lit(None).cast("string")).withColumn("predicate_id", F.lit("revenue"))
    )


@query("facts_build", f"""
    WITH {SENTENCE_SQL}
    SELECT chunk_id, document_id, value_raw, time_value, scope, CAST(0 AS INT) AS char_start,
           CAST(len(quote) AS INT) AS char_end, 'active' AS status, embedding IS NOT NULL AS embedded
    FROM sentences""")
def facts_build(t):
    return _built(t).select(
        "chunk_id", "document_id", "value_raw", "time_value", "scope", "char_start",
        # The quote of the rule extractor ends where its sentence ends.
        "char_end", "status", F.col("embedding").isNotNull().alias("embedded"),
    )


@query("evidence_build", f"""
    WITH {SENTENCE_SQL}
    SELECT chunk_id, document_id, CAST(document_id % 9 + 1 AS INT) AS page_number, quote, CAST(len(quote) AS INT) AS char_end
    FROM sentences""")
def evidence_build(t):
    return extraction.build_evidence(_built(t)).select("chunk_id", "document_id", "page_number", "quote", "char_end")


# ------------------------------------------------------ ontology, entities

PREDICATES_SQL = """
    known AS (
      SELECT n_nationkey AS predicate_id, n_name AS canonical_name, ['metric ' || n_nationkey, r_name] AS aliases
      FROM nation JOIN region ON r_regionkey = n_regionkey),
    names AS (
      SELECT o_orderkey AS row_id, CASE o_orderkey % 4 WHEN 0 THEN 'NATION_' || o_custkey % 40
             WHEN 1 THEN 'metric ' || o_custkey % 40 WHEN 2 THEN r_name ELSE o_orderpriority END AS predicate
      FROM orders JOIN region ON r_regionkey = o_custkey % 5),
    answers AS (
      SELECT name, arg_min(predicate_id, is_alias * 1000 + predicate_id) AS predicate_id FROM (
        SELECT canonical_name AS name, predicate_id, 0 AS is_alias FROM known
        UNION ALL SELECT unnest(aliases), predicate_id, 1 FROM known) GROUP BY name)"""


def _predicates(t):
    return t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").alias("predicate_id"), F.col("n_name").alias("canonical_name"),
        F.array(F.concat(F.lit("metric "), F.col("n_nationkey").cast("string")), "r_name").alias("aliases"),
    )


def _names(t):
    kind, number = F.col("o_orderkey") % 4, (F.col("o_custkey") % 40).cast("string")
    name = (
        F.when(kind == 0, F.concat(F.lit("NATION_"), number)).when(kind == 1, F.concat(F.lit("metric "), number))
        .when(kind == 2, F.col("r_name")).otherwise(F.col("o_orderpriority"))
    )
    rows = t("orders").join(t("region"), F.col("r_regionkey") == F.col("o_custkey") % 5)
    return rows.select(F.col("o_orderkey").alias("row_id"), name.alias("predicate"))


@query("predicate_lookup", f"""
    WITH {PREDICATES_SQL}
    SELECT n.row_id, n.predicate, a.predicate_id FROM names n LEFT JOIN answers a ON a.name = n.predicate""")
def predicate_lookup(t):
    return ontology.lookup_predicates(_names(t), _predicates(t)).select("row_id", "predicate", "predicate_id")


@query("ontology_grow", f"""
    WITH {PREDICATES_SQL}
    SELECT DISTINCT n.predicate AS canonical_name, 'numeric' AS value_type,
           sha256('9:predicate|' || len(n.predicate) || ':' || n.predicate) AS predicate_id
    FROM names n WHERE n.predicate NOT IN (SELECT name FROM answers)""")
def ontology_grow(t):
    return ontology.grow_ontology(_names(t), _predicates(t)).select("canonical_name", "value_type", "predicate_id")


@query("predicate_list", "SELECT predicate_id, canonical_name FROM fx_predicates")
def predicate_list(t):
    return ontology.list_predicates(t("fx_predicates"))


@query("normalized_key", rf"""
    SELECT document_id, page_number,
           md5(lower(regexp_replace(regexp_replace(text, '{SQL_WS}+', ' ', 'g'), '^ | $', '', 'g'))) AS key_md5
    FROM fx_pages""")
def normalized_key(t):
    return t("fx_pages").select("document_id", "page_number", F.md5(tx.normalized_key(F.col("text"))).alias("key_md5"))


# Parts as mentions of product lines, with uneven spelling.
@query("entity_upsert", """
    WITH mentions AS (
      SELECT p_partkey AS seq, CASE p_type WHEN 'SMALL' THEN 'place' ELSE 'org' END AS entity_type,
             CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '  ' || p_brand ELSE ' ' || p_name || ' ' || p_brand END AS name
      FROM part),
    keyed AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS normalized_key FROM mentions)
    SELECT arg_min(name, seq) AS canonical_name, entity_type, normalized_key FROM keyed
    WHERE normalized_key NOT IN (SELECT lower(p_name || ' ' || p_brand) FROM part WHERE p_size > 45)
    GROUP BY entity_type, normalized_key""".replace("\\\\", "\\"))
def entity_upsert(t):
    part = t("part")
    plain = F.concat("p_name", F.lit(" "), "p_brand")
    mentions = part.select(
        F.col("p_partkey").alias("seq"), F.when(F.col("p_type") == "SMALL", "place").otherwise("org").alias("entity_type"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper("p_name"), F.lit("  "), "p_brand"))
        .otherwise(F.concat(F.lit(" "), plain)).alias("name"),
    )
    # Large parts are stored already, under both types.
    stored = part.filter(F.col("p_size") > 45).select(
        F.lower(plain).alias("normalized_key"), F.explode(F.array(F.lit("org"), F.lit("place"))).alias("entity_type")
    )
    return entities.upsert_entities(mentions, stored).select("canonical_name", "entity_type", "normalized_key")


TRIGRAM_MACRO = r"""list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'),
        lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def sql_trigrams(x: str) -> str:
    return TRIGRAM_MACRO.format(x=x)


@query("trigram_similarity", f"""
    WITH pairs AS (
      SELECT c_custkey, {sql_trigrams('c_name')} AS a, {sql_trigrams('s_name')} AS b
      FROM customer JOIN supplier ON s_suppkey = c_custkey % 97)
    SELECT c_custkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS similarity
    FROM pairs""")
def trigram_similarity(t):
    rows = t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey") % 97)
    return rows.select("c_custkey", F.round(similarity(F.col("c_name"), F.col("s_name")), 6).alias("similarity"))


MENTIONS_SQL = f"""
    mentions AS (
      SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 3 = 0 THEN 'place' ELSE 'org' END AS entity_type,
             CASE WHEN c_custkey % 3 = 0 THEN 'NATION ' || c_custkey % 30
                  WHEN c_custkey % 3 = 1 THEN 'Supplier ' || lpad(CAST(c_custkey AS STRING), 9, '0')
                  ELSE 'supplier#' || lpad(CAST(c_custkey % 90 AS STRING), 9, '0') || ' Ltd' END AS name
      FROM customer),
    grams AS (
      SELECT mention_id, entity_id, m.g AS a, e.g AS b, lower(trim(name)) AS mk, lower(canonical_name) AS ek
      FROM (SELECT *, {sql_trigrams('name')} AS g FROM mentions) m
      JOIN (SELECT *, {sql_trigrams('canonical_name')} AS g FROM fx_entities) e ON m.entity_type = e.entity_type),
    scored AS (
      SELECT *, CAST(len(list_intersect(a, b)) AS DOUBLE) AS shared FROM grams),
    ranked AS (
      SELECT mention_id, entity_id, mk, ek, shared / (len(a) + len(b) - shared) AS similarity,
             row_number() OVER (PARTITION BY mention_id ORDER BY shared / (len(a) + len(b) - shared) DESC, entity_id) AS rank
      FROM scored)"""


def _mentions(t):
    key = F.col("c_custkey")
    name = (
        F.when(key % 3 == 0, F.concat(F.lit("NATION "), (key % 30).cast("string")))
        .when(key % 3 == 1, F.concat(F.lit("Supplier "), F.lpad(key.cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("supplier#"), F.lpad((key % 90).cast("string"), 9, "0"), F.lit(" Ltd")))
    )
    return t("customer").select(
        key.alias("mention_id"), F.when(key % 3 == 0, "place").otherwise("org").alias("entity_type"), name.alias("name")
    )


@query("entity_candidates", f"""
    WITH {MENTIONS_SQL}
    SELECT mention_id, entity_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 8""")
def entity_candidates(t):
    found = entities.candidate_entities(_mentions(t), t("fx_entities"))
    return found.select("mention_id", "entity_id", F.round("similarity", 6).alias("similarity"), "rank")


RESOLVE_SQL = f"""{MENTIONS_SQL},
    best AS (
      SELECT mention_id, arg_min(entity_id, rank) AS match, max(CASE WHEN mk = ek THEN 1 ELSE similarity END) AS top
      FROM ranked WHERE rank <= 8 GROUP BY mention_id),
    resolved AS (
      SELECT mention_id, match, CAST(top AS FLOAT) AS confidence,
             CASE WHEN CAST(top AS FLOAT) >= CAST(0.95 AS FLOAT) THEN 'link'
                  WHEN CAST(top AS FLOAT) >= CAST(0.75 AS FLOAT) THEN 'alias' ELSE 'new' END AS decision
      FROM best)"""


def _resolved(t):
    mentions, stored = _mentions(t), t("fx_entities")
    found = entities.candidate_entities(mentions, stored)
    choices = entities.guard_choice(entities.choose_by_similarity(mentions, stored, found), found)
    return entities.resolve(mentions, choices)


@query("entity_resolve", f"""
    WITH {RESOLVE_SQL}
    SELECT mention_id, decision, CASE WHEN decision <> 'new' THEN match END AS entity_id, round(CAST(confidence AS DOUBLE), 5) AS confidence
    FROM resolved""")
def entity_resolve(t):
    return _resolved(t).select(
        "mention_id", "decision", "entity_id", F.round(F.col("confidence").cast("double"), 5).alias("confidence")
    )


@query("entity_aliases", f"""
    WITH {RESOLVE_SQL}
    SELECT r.match AS entity_id, m.name AS alias_text FROM resolved r JOIN mentions m ON m.mention_id = r.mention_id
    WHERE decision = 'alias'""")
def entity_aliases(t):
    return entities.alias_rows(_resolved(t)).select("entity_id", "alias_text")


# Customers' names without a stored counterpart, resolved among themselves.
@query("entity_resolve_batch")
def entity_resolve_batch(t):
    new = t("part").groupBy(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name")).agg(F.min("p_partkey").alias("seq"))
    new = new.select(F.col("seq").alias("mention_id"), "name", F.lit("org").alias("entity_type"), "seq")
    return entities.resolve_batch(new).select(
        "mention_id", "seed_id", F.round("similarity", 6).alias("similarity")
    )


# ----------------------------------------------------------------- reasoning

RELATED_SQL = f"""
    related AS (
      SELECT fact_a_id, fact_b_id, distance, CAST(rank AS INT) AS rank FROM (
        SELECT a.fact_id AS fact_a_id, b.fact_id AS fact_b_id, {sql_dist('a.embedding', 'b.embedding')} AS distance,
               row_number() OVER (PARTITION BY a.fact_id
                 ORDER BY {sql_dist('a.embedding', 'b.embedding')} NULLS LAST, b.fact_id) AS rank
        FROM fx_facts a JOIN fx_facts b ON b.predicate_id = a.predicate_id AND b.document_id <> a.document_id
        WHERE b.status = 'active')
      WHERE rank <= 5)"""


@query("related_facts_topk", f"""
    WITH {RELATED_SQL} SELECT fact_a_id, fact_b_id, round(distance, 6) + 0.0 AS distance, rank FROM related""")
def related_facts_topk(t):
    return reasoning.related_facts(t("fx_facts")).select("fact_a_id", "fact_b_id", rounded("distance"), "rank")


PAIRS_SQL = f"""{RELATED_SQL},
    pairs AS (
      SELECT fact_a_id, fact_b_id FROM (
        SELECT *, row_number() OVER (PARTITION BY least(fact_a_id, fact_b_id), greatest(fact_a_id, fact_b_id)
                                     ORDER BY fact_a_id) AS n FROM related) WHERE n = 1),
    fresh AS (
      SELECT p.* FROM pairs p WHERE NOT EXISTS (
        SELECT 1 FROM fx_relationships r
        WHERE (r.fact_a_id = p.fact_a_id AND r.fact_b_id = p.fact_b_id)
           OR (r.fact_a_id = p.fact_b_id AND r.fact_b_id = p.fact_a_id)))"""


@query("pair_dedupe", f"WITH {PAIRS_SQL} SELECT fact_a_id, fact_b_id FROM pairs")
def pair_dedupe(t):
    return reasoning.dedupe_pairs(reasoning.related_facts(t("fx_facts")))


@query("pair_new", f"WITH {PAIRS_SQL} SELECT fact_a_id, fact_b_id FROM fresh")
def pair_new(t):
    return _fresh(t)


def _fresh(t):
    return reasoning.candidate_pairs(t("fx_facts"), t("fx_relationships"))


@query("first_evidence", """
    SELECT fact_id, quote FROM (
      SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY page_number, evidence_id) AS n FROM fx_evidence)
    WHERE n = 1""")
def first_evidence(t):
    return views.first_evidence(t("fx_evidence")).select("fact_id", "quote")


CONTEXT_SQL = f"""{PAIRS_SQL}, {VIEW_SQL}, {VALUES_SQL}, {PERIODS_SQL},
    firsts AS (SELECT fact_id, arg_min(quote, page_number || '/' || evidence_id) AS quote FROM fx_evidence GROUP BY fact_id),
    sides AS (
      SELECT v.fact_id, v.value_raw, v.time_value, v.scope, v.document_filename AS filename,
             coalesce(v.subject, 'unknown') AS subject, coalesce(v.predicate, 'unknown') AS predicate,
             q.quote, x.amount, x.unit, coalesce(x.currency, CASE WHEN x.unit = '%' THEN '%' ELSE 'count' END) AS kind,
             p.period_start AS ps, p.period_end AS pe
      FROM views v JOIN firsts q ON q.fact_id = v.fact_id
      JOIN vals x ON x.fact_id = v.fact_id JOIN periods p ON p.fact_id = v.fact_id),
    context AS (
      SELECT f.fact_a_id, f.fact_b_id, a.subject AS a_subject, b.subject AS b_subject, a.predicate AS a_predicate,
             b.predicate AS b_predicate, a.filename AS a_filename, b.filename AS b_filename, a.quote AS a_quote, b.quote AS b_quote,
             a.value_raw AS a_value, b.value_raw AS b_value, a.time_value AS a_time, b.time_value AS b_time,
             a.scope AS a_scope, b.scope AS b_scope, a.amount AS aa, b.amount AS ba, a.unit AS au, b.unit AS bu,
             a.kind AS ak, b.kind AS bk, a.ps AS aps, a.pe AS ape, b.ps AS bps, b.pe AS bpe
      FROM fresh f JOIN sides a ON a.fact_id = f.fact_a_id JOIN sides b ON b.fact_id = f.fact_b_id)"""


def _context(t):
    return reasoning.reasoning_context(
        _fresh(t), t("fx_facts"), t("fx_evidence"), t("fx_documents"), t("fx_entities"), t("fx_predicates")
    )


@query("reasoning_context", f"""
    WITH {CONTEXT_SQL}
    SELECT fact_a_id, fact_b_id, a_subject, b_subject, a_predicate, a_filename, b_filename, a_quote, b_quote FROM context""")
def reasoning_context(t):
    return _context(t).select(
        "fact_a_id", "fact_b_id", "a_subject", "b_subject", "a_predicate", "a_filename", "b_filename", "a_quote", "b_quote"
    )


JUDGED_SQL = f"""{CONTEXT_SQL},
    judged AS (
      SELECT *, CASE
        WHEN lower(a_subject) <> lower(b_subject) OR a_predicate <> b_predicate THEN 'UNRELATED'
        WHEN aa IS NULL OR ba IS NULL OR ak <> bk THEN 'UNCERTAIN'
        WHEN aa = ba AND aps IS NOT DISTINCT FROM bps AND ape IS NOT DISTINCT FROM bpe AND au IS DISTINCT FROM bu THEN 'UNIT_DIFFERENCE'
        WHEN aa = ba AND aps IS NOT DISTINCT FROM bps AND ape IS NOT DISTINCT FROM bpe THEN 'CORROBORATES'
        WHEN a_scope <> b_scope THEN 'SCOPE_DIFFERENCE'
        WHEN (aps, ape) <> (bps, bpe) AND ((aps <= bps AND bpe <= ape) OR (bps <= aps AND ape <= bpe)) THEN 'RECONCILES'
        WHEN aps = bps AND ape = bpe THEN 'CONTRADICTS'
        WHEN aps IS NULL OR bps IS NULL THEN 'POTENTIAL_CONTRADICTION'
        ELSE 'RECONCILES' END AS relationship_type,
        a_value || ' (' || coalesce(a_time, 'no period') || ', ' || a_filename || ') against ' ||
        b_value || ' (' || coalesce(b_time, 'no period') || ', ' || b_filename || ')' AS explanation
      FROM context)"""


@query("classify_pairs", f"WITH {JUDGED_SQL} SELECT fact_a_id, fact_b_id, relationship_type, explanation FROM judged")
def classify_pairs(t):
    return reasoning.classify_pairs(_context(t)).select("fact_a_id", "fact_b_id", "relationship_type", "explanation")


@query("label_guard", """
    SELECT relationship_id, CASE WHEN relationship_type IS NULL OR upper(relationship_type) = 'SIMILAR' THEN 'UNCERTAIN'
                                 ELSE upper(relationship_type) END AS relationship_type,
           CASE WHEN confidence = 0 THEN 0.5 ELSE round(CAST(confidence AS DOUBLE), 4) END AS confidence
    FROM fx_relationships WHERE relationship_type IS NULL OR relationship_type <> 'TEMPORAL_UPDATE'""")
def label_guard(t):
    raw = t("fx_relationships").withColumn(
        "relationship_type", F.when(F.col("relationship_type") == "TEMPORAL_UPDATE", "unrelated").otherwise(F.col("relationship_type"))
    ).withColumn("confidence", F.when(F.col("confidence") > 0, F.col("confidence")))
    return reasoning.storable(raw).select(
        "relationship_id", "relationship_type", F.round(F.col("confidence").cast("double"), 4).alias("confidence")
    )


@query("relationships_insert", f"""
    WITH {JUDGED_SQL} SELECT fact_a_id, fact_b_id, relationship_type FROM judged WHERE relationship_type <> 'UNRELATED'""")
def relationships_insert(t):
    judged = reasoning.classify_pairs(_context(t))
    return reasoning.insert_relationships(judged, t("fx_relationships")).select("fact_a_id", "fact_b_id", "relationship_type")


# Anchors are the active facts here, so the pairs of other anchors drop out.
@query("recompute_summary", f"""
    WITH {JUDGED_SQL.replace("WHERE b.status = 'active')", "WHERE b.status = 'active' AND a.status = 'active')")}
    SELECT (SELECT count(*) FROM fx_facts WHERE status = 'active') AS facts_considered,
           count(*) AS relationships_created FROM judged WHERE relationship_type <> 'UNRELATED'""")
def recompute_summary(t):
    from veritrace.plans.flows import recompute

    summary, _ = recompute(
        t("fx_facts"), t("fx_evidence"), t("fx_documents"), t("fx_entities"), t("fx_predicates"), t("fx_relationships")
    )
    return summary


# The facts of even-numbered documents are stored, the others arrive.
@query("incremental_pairs", f"""
    WITH {RELATED_SQL} SELECT fact_a_id, fact_b_id, rank FROM related
    WHERE fact_a_id IN (SELECT fact_id FROM fx_facts WHERE document_id % 2 = 1)""")
def incremental_pairs(t):
    from veritrace.streaming.ingest import pair_arrivals

    facts = t("fx_facts")
    stored, arrived = facts.filter(F.col("document_id") % 2 == 0), facts.filter(F.col("document_id") % 2 == 1)
    return pair_arrivals(stored, arrived).select("fact_a_id", "fact_b_id", "rank")


# ------------------------------------------------------------ answers, log


@query("answer_components", f"""
    WITH {FACT_HITS},
    cards AS (
      SELECT DISTINCT h.question_id, r.relationship_id, r.relationship_type, r.fact_a_id, r.fact_b_id
      FROM hits h JOIN fx_relationships r ON r.fact_a_id = h.fact_id OR r.fact_b_id = h.fact_id)
    SELECT question_id, CASE WHEN relationship_type = 'CORROBORATES' THEN 'CorroborationCard'
             WHEN relationship_type IN ('CONTRADICTS', 'POTENTIAL_CONTRADICTION') THEN 'ConflictCard'
             ELSE 'ReconciliationCard' END AS component_type, fact_a_id, fact_b_id
    FROM cards WHERE relationship_type IN ('CORROBORATES', 'CONTRADICTS', 'POTENTIAL_CONTRADICTION', 'RECONCILES',
                                           'SCOPE_DIFFERENCE', 'UNIT_DIFFERENCE', 'TEMPORAL_UPDATE')
    UNION ALL SELECT question_id, 'FactCard', fact_id, NULL FROM hits
    UNION ALL SELECT vec_id, 'AnswerText', NULL, NULL FROM embeddings
    UNION ALL SELECT -1 - vec_id, 'UncertaintyCard', NULL, NULL FROM embeddings""")
def answer_components(t):
    questions = t("embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    hits = retrieval.search_facts_batch(questions, t("fx_facts"))
    ends = t("fx_relationships").withColumn("fact_id", F.explode(F.array("fact_a_id", "fact_b_id")))
    relations = hits.select("question_id", "fact_id", "rank").join(ends, "fact_id")
    # As many questions again for which nothing was retrieved.
    asked = questions.select(F.explode(F.array(F.col("question_id"), -1 - F.col("question_id"))).alias("question_id"))
    return answers.assemble(asked, hits, relations).select("question_id", "component_type", "fact_a_id", "fact_b_id")


PLAN_EXPR = """
    CASE o_orderkey % 12
      WHEN 0 THEN concat('[{"type": "AnswerText", "text": "See [1]", "citations": [{"marker": "[1]", "page": null}]}]')
      WHEN 1 THEN concat('[{"type": "FactCard", "fact_id": "', id, '", "subject": "s", "predicate": "p", "value_display": "v", "confidence": 0.5}]')
      WHEN 2 THEN concat('[{"type": "FactCard", "fact_id": "', id, '", "subject": "s", "predicate": "p", "value_display": "v", "confidence": 0.5, "scope": null}]')
      WHEN 3 THEN concat('[{"type": "FactCard", "fact_id": "fact one", "subject": "s", "predicate": "p", "value_display": "v", "confidence": "0.5"}]')
      WHEN 4 THEN '[]'
      WHEN 5 THEN '[{"type": "UncertaintyCard", "message": "m", "reason": "r"}, {"type": "Poem", "text": "t"}]'
      WHEN 6 THEN concat('[{"type": "CorroborationCard", "fact_ids": ["', id, '"], "explanation": "e", "confidence": 1}]')
      WHEN 7 THEN concat('[{"type": "ConflictCard", "fact_a_id": "', id, '", "fact_b_id": "', id, '", "relationship_type": "RECONCILES", "explanation": "e", "confidence": 1}]')
      WHEN 8 THEN '[{"type": "ComparisonTable", "rows": [{"label": "l", "value": "v"}]}, {"type": "Timeline", "subject": "s", "events": []}]'
      WHEN 9 THEN concat('[{"type": "EvidenceCard", "document_id": "', id, '", "document_filename": "f", "page": 0, "quote": "q"}]')
      WHEN 10 THEN '{"no": "list"}'
      ELSE '[{"type": "AnswerText", "text": 5}]' END"""


@query("plan_validate", """
    SELECT o_orderkey AS plan_id, o_orderkey % 13 <> 0 AND o_orderkey % 12 IN (0, 1, 2, 3, 6, 8, 9) AS valid_lenient,
           o_orderkey % 13 <> 0 AND o_orderkey % 12 IN (0, 1) AS valid_strict,
           CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 12 IN (0, 1, 4, 10) THEN NULL
                WHEN o_orderkey % 12 IN (5, 8) THEN 1 ELSE 0 END AS bad_component,
           CASE WHEN o_orderkey % 13 = 0 THEN 'not_json' WHEN o_orderkey % 12 IN (0, 1) THEN NULL
                WHEN o_orderkey % 12 = 4 THEN 'empty' WHEN o_orderkey % 12 = 10 THEN 'no_list' ELSE 'bad_component' END AS problem
    FROM orders""")
def plan_validate(t):
    return answers.validate_plans(_plans(t)).select("plan_id", "valid_lenient", "valid_strict", "bad_component", "problem")


def _plans(t):
    uuid = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    return t("orders").select("o_orderkey", uuid.alias("id")).select(
        F.col("o_orderkey").alias("plan_id"),
        F.concat(F.lit('{"components": '), F.expr(PLAN_EXPR), F.when(F.col("o_orderkey") % 13 == 0, "").otherwise("}")).alias("plan"),
    )


# What a reader gets of each plan: the plan, or the one card that stands for a bad one.
@query("plan_accept", f"""
    SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 12 IN (0, 1, 2, 3, 6, 8, 9)
      THEN concat('{{"components": ', {PLAN_EXPR}, '}}')
      ELSE '{{"components": [{{"type": "UncertaintyCard", "message": "No reliable answer could be built.", "reason": "The answer plan was not valid."}}]}}'
      END AS accepted
    FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') || '-0000-4000-8000-000000000000' AS id FROM orders)""")
def plan_accept(t):
    return answers.accepted_plans(_plans(t)).select("plan_id", "accepted")


# Orders cite their lines; a line number that occurs twice takes the last part.
@query("citation_resolve", """
    WITH cited AS (
      SELECT l_orderkey, l_linenumber, arg_max(l_partkey, l_partkey * 1000000 + l_suppkey) AS part,
             arg_max(l_suppkey, l_partkey * 1000000 + l_suppkey) AS supp FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS answer_id, m.marker_no, '[' || m.line || ']' AS marker, c.part IS NOT NULL AS resolved,
           c.part IS NOT NULL AND c.part % 4 <> 0 AND c.supp % 5 <> 0 AS clickable,
           CASE WHEN c.part IS NOT NULL THEN CASE WHEN c.part % 3 = 0 THEN 'Part ' || c.part
             WHEN c.supp % 5 = 0 THEN 'Related' ELSE 'Document · p.' || c.supp % 5 END END AS label
    FROM orders CROSS JOIN (VALUES (0, 2), (1, 5), (2, 2)) m(marker_no, line)
    LEFT JOIN cited c ON c.l_orderkey = o_orderkey AND c.l_linenumber = m.line""")
def citation_resolve(t):
    texts = t("orders").select(F.col("o_orderkey").alias("answer_id"), F.lit("As [2] and [5] say, unlike [x], see [2].").alias("text"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    cited = t("lineitem").select(
        F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("]")).alias("marker"),
        (part * 1000000 + supp).alias("position"), F.when(part % 4 != 0, part).alias("document_id"),
        (supp % 5).alias("page"), F.when(part % 3 == 0, F.concat(F.lit("Part "), part.cast("string"))).otherwise("").alias("label"),
    )
    return answers.resolve_citations(texts, cited)


STATE_SQL = """
    state AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY seq DESC) AS n FROM fx_jobs) WHERE n = 1)"""


@query("job_state", f"WITH {STATE_SQL} SELECT document_id, stage, seq, status, error, metrics FROM state")
def job_state(t):
    return runlog.job_state(t("fx_jobs"))


@query("job_fail_running", f"""
    WITH {STATE_SQL}
    SELECT document_id, stage, CASE WHEN status = 'running' AND c_custkey IS NOT NULL THEN 'failed' ELSE status END AS status,
           CASE WHEN status = 'running' AND c_custkey IS NOT NULL THEN 'gave up on ' || c_name ELSE error END AS error
    FROM state LEFT JOIN customer ON c_custkey = document_id AND c_acctbal < 0""")
def job_fail_running(t):
    failures = t("customer").filter(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").alias("document_id"), F.concat(F.lit("gave up on "), "c_name").alias("failure")
    )
    return runlog.fail_running(runlog.job_state(t("fx_jobs")), failures).select("document_id", "stage", "status", "error")


@query("document_status", """
    WITH changes AS (
      SELECT user_id AS document_id, event_id AS seq, ts, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS pages,
             CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status
      FROM events)
    SELECT document_id, arg_max(status, seq) AS status, arg_max(pages, seq) FILTER (pages IS NOT NULL) AS page_count,
           strftime(arg_max(ts, seq) FILTER (status = 'ready'), '%Y-%m-%d %H:%M:%S') AS processed_at
    FROM changes GROUP BY document_id""")
def document_status(t):
    status = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "failed").otherwise("processing")
    changes = t("events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), status.alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.floor("value")).alias("page_count"), F.col("ts").alias("at"),
    )
    return runlog.document_status(changes).select(
        "document_id", "status", "page_count", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at")
    )
