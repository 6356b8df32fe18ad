"""Registered queries: documents, pages, chunks, graph projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrace.functions import text as tx
from veritrace.operators import chunking, graph, ingest
from veritrace.plans.catalog import query

# The sample texts have line breaks but no blank lines, so units are lines.
LINE_SEP = rf"\n{tx.WS}*"
SQL_WS = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
SQL_WORD = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]+"


def sql_tokens(text: str) -> str:
    return f"greatest(1, CAST(round_even(len(regexp_extract_all({text}, '{SQL_WORD}')) * CAST(1.3 AS DOUBLE), 0) AS INT))"


@query("doc_fingerprint", """
    SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INT) AS n_bytes, 'text/plain' AS mime_type
    FROM documents WHERE strlen(text) > 0""")
def doc_fingerprint(t):
    docs = ingest.fingerprint_documents(t("documents"), "text", mime="text/plain")
    return docs.select("doc_id", "sha256", "n_bytes", "mime_type")


@query("doc_dedupe", """
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS canonical_id,
           doc_id <> first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS deduplicated
    FROM documents""")
def doc_dedupe(t):
    docs = t("documents").select(
        F.col("doc_id").alias("document_id"), ingest.fingerprint(F.col("text")).alias("sha256"),
        F.col("doc_id").alias("arrival"),
    )
    return ingest.dedupe_documents(docs).select(
        F.col("document_id").alias("doc_id"), "canonical_id", "deduplicated"
    )


# Benchmark texts count as stored already; documents and they share one id space.
@query("doc_dedupe_history", """
    WITH stored AS (SELECT text, min(turn * 1000000 + conv_id) AS known FROM conversations GROUP BY text)
    SELECT d.doc_id, coalesce(-1 - s.known, first_value(d.doc_id) OVER (PARTITION BY d.text ORDER BY d.doc_id)) AS canonical_id
    FROM documents d LEFT JOIN stored s ON s.text = d.text""")
def doc_dedupe_history(t):
    sha = ingest.fingerprint(F.col("text")).alias("sha256")
    stored = (
        t("conversations").select(sha, (F.col("turn") * 1000000 + F.col("conv_id")).alias("n"))
        .groupBy("sha256").agg((-1 - F.min("n")).alias("document_id"))
    )
    new = t("documents").select(F.col("doc_id").alias("document_id"), sha, F.col("doc_id").alias("arrival"))
    return ingest.dedupe_documents(new, stored).select(F.col("document_id").alias("doc_id"), "canonical_id")


@query("page_method", rf"""
    WITH native AS (
      SELECT p.page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g') AS body,
             40000.0 * (1 + page_id % 90) AS area, d.text AS ocr_text, page_id % 101 AS c1, (page_id * 7) % 101 AS c2
      FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 5),
    judged AS (
      SELECT *, len(regexp_extract_all(body, '{SQL_WORD}')) / (area / 10000.0) < 0.6 AS scan FROM native)
    SELECT page_id AS document_id, CAST(1 AS INT) AS page_number,
           CASE WHEN scan AND ocr_text IS NOT NULL THEN 'ocr'
                WHEN NOT scan OR regexp_matches(body, '{SQL_WORD}') THEN 'native' ELSE 'failed' END AS extraction_method,
           md5(CASE WHEN scan AND ocr_text IS NOT NULL THEN ocr_text ELSE body END) AS text_md5,
           CASE WHEN scan AND ocr_text IS NOT NULL
                THEN round(CAST((c1 + c2) / 200.0 AS DOUBLE), 4) END AS confidence
    FROM judged""")
def page_method(t):
    ocr = t("documents").select(F.col("doc_id").alias("ocr_id"), F.col("text").alias("ocr_text"))
    pages = t("pages").join(ocr, F.col("ocr_id") == F.col("page_id") * 5, "left").select(
        F.col("page_id").alias("document_id"), F.lit(1).alias("page_number"),
        tx.strip_markup(F.col("html")).alias("native_text"),
        (40000.0 * (1 + F.col("page_id") % 90)).alias("area"),
        "ocr_text",
        F.array(F.col("page_id") % 101, F.lit(-1).cast("long"), (F.col("page_id") * 7) % 101).alias("ocr_words"),
    )
    return ingest.extract_pages(pages).select(
        "document_id", "page_number", "extraction_method", F.md5("text").alias("text_md5"),
        F.round(F.col("confidence").cast("double"), 4).alias("confidence"),
    )


# Damage every text, repair it, and compare with the text it came from.
@query("text_repair", "SELECT doc_id, md5(text) AS repaired_md5 FROM documents")
def text_repair(t):
    damaged = t("documents").select("doc_id", tx.damage_encoding(F.col("text")).alias("text"))
    return damaged.select("doc_id", F.md5(tx.repair_encoding(F.col("text"))).alias("repaired_md5"))


@query("page_key_check", """
    SELECT l_orderkey AS document_id, l_linenumber AS page_number, count(*) AS n_rows
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def page_key_check(t):
    pages = t("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"))
    return ingest.duplicate_pages(pages)


@query("token_estimate", f"SELECT document_id, page_number, {sql_tokens('text')} AS tokens FROM fx_pages")
def token_estimate(t):
    return t("fx_pages").select("document_id", "page_number", tx.token_estimate(F.col("text")).alias("tokens"))


UNITS_SQL = rf"""
    parts AS (
      SELECT document_id, page_number, text AS page_text,
             regexp_split_to_array(text, '\n{SQL_WS}*') AS paras, regexp_extract_all(text, '\n{SQL_WS}*') AS seps
      FROM fx_pages),
    flat AS (
      SELECT document_id, page_number, i, len(page_text) AS page_len, paras[i] AS text,
             coalesce(sum(len(paras[i]) + coalesce(len(seps[i]), 0)) OVER (
               PARTITION BY document_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM parts, unnest(range(1, len(paras) + 1)) u(i)),
    bases AS (
      SELECT document_id, page_number,
             coalesce(sum(len(page_text) + 2) OVER (PARTITION BY document_id ORDER BY page_number
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
      FROM parts),
    units AS (
      SELECT f.document_id, f.page_number, f.text,
             row_number() OVER (PARTITION BY f.document_id ORDER BY f.page_number, f.i) - 1 AS unit_no,
             CAST(base + pos AS BIGINT) AS char_start, CAST(base + pos + len(f.text) AS BIGINT) AS char_end,
             {sql_tokens('f.text')} AS tokens
      FROM flat f JOIN bases b ON b.document_id = f.document_id AND b.page_number = f.page_number
      WHERE regexp_matches(f.text, '{SQL_WORD}'))"""

PACK_SQL = f"""
    WITH RECURSIVE {UNITS_SQL},
    fold(document_id, pos, first_unit, total, done_first, done_last) AS (
      SELECT document_id, unit_no, unit_no, tokens, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
      FROM units WHERE unit_no = 0
      UNION ALL
      SELECT u.document_id, u.unit_no,
             CASE WHEN f.total + u.tokens > 60 THEN f.pos ELSE f.first_unit END,
             CASE WHEN f.total + u.tokens > 60 THEN p.tokens + u.tokens ELSE f.total + u.tokens END,
             CASE WHEN f.total + u.tokens > 60 THEN f.first_unit END,
             CASE WHEN f.total + u.tokens > 60 THEN f.pos END
      FROM fold f
      JOIN units u ON u.document_id = f.document_id AND u.unit_no = f.pos + 1
      JOIN units p ON p.document_id = f.document_id AND p.unit_no = f.pos),
    ranges AS (
      SELECT document_id, done_first AS first_unit, done_last AS last_unit FROM fold WHERE done_first IS NOT NULL
      UNION ALL
      SELECT document_id, first_unit, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos DESC) AS r FROM fold) WHERE r = 1)"""


@query("paragraph_units", f"""
    WITH {UNITS_SQL}
    SELECT document_id, CAST(unit_no AS BIGINT) AS unit_no, page_number, md5(text) AS text_md5, char_start, char_end, tokens
    FROM units""")
def paragraph_units(t):
    units = chunking.paragraph_units(t("fx_pages"), sep=LINE_SEP)
    return units.select(
        "document_id", "unit_no", "page_number", F.md5("text").alias("text_md5"), "char_start", "char_end", "tokens"
    )


# A budget of 60 tokens makes several chunks even of short sample texts.
@query("chunk_pack", f"{PACK_SQL} SELECT document_id, first_unit, last_unit FROM ranges")
def chunk_pack(t):
    units = chunking.paragraph_units(t("fx_pages"), sep=LINE_SEP)
    return chunking.pack_units(units, budget=60)


BUILD_SQL = f"""{PACK_SQL},
    chunks AS (
      SELECT r.document_id, r.first_unit, string_agg(u.text, chr(10) || chr(10) ORDER BY u.unit_no) AS text,
             min(page_number) AS page_start, max(page_number) AS page_end,
             min(char_start) AS char_start, max(char_end) AS char_end
      FROM ranges r JOIN units u
        ON u.document_id = r.document_id AND u.unit_no BETWEEN r.first_unit AND r.last_unit
      GROUP BY r.document_id, r.first_unit, r.last_unit)
    SELECT document_id,
           CAST(row_number() OVER (PARTITION BY document_id ORDER BY first_unit, char_end) - 1 AS INT) AS chunk_no,
           page_start, page_end, md5(text) AS text_md5, char_start, char_end, {sql_tokens('text')} AS token_count
    FROM chunks"""


@query("build_chunks", BUILD_SQL)
def build_chunks(t):
    chunks = chunking.build_chunks(t("fx_pages"), budget=60, sep=LINE_SEP)
    return chunks.select(
        "document_id", "chunk_no", "page_start", "page_end", F.md5("text").alias("text_md5"),
        "char_start", "char_end", "token_count",
    )


# The same chunks by small blocks, so that chunks cross them.
@query("build_chunks_long", BUILD_SQL)
def build_chunks_long(t):
    chunks = chunking.build_chunks(t("fx_pages"), budget=60, sep=LINE_SEP, block=64)
    return chunks.select(
        "document_id", "chunk_no", "page_start", "page_end", F.md5("text").alias("text_md5"),
        "char_start", "char_end", "token_count",
    )


@query("chunk_embedding_join", """
    SELECT vec_id AS chunk_id, e.embedding IS NOT NULL AS embedded, CAST(coalesce(len(e.embedding), 0) AS INT) AS dims
    FROM (SELECT doc_id FROM documents) d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    WHERE vec_id IS NOT NULL
    UNION ALL
    SELECT doc_id, FALSE, 0 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def chunk_embedding_join(t):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"))
    vectors = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunking.attach_embeddings(chunks, vectors).select(
        "chunk_id", F.col("embedding").isNotNull().alias("embedded"),
        F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"),
    )


def _parts(t):
    return t("fx_documents"), t("fx_facts"), t("fx_entities"), t("fx_evidence"), t("fx_relationships")


@query("graph_nodes", """
    SELECT 'Document' AS label, CAST(document_id AS STRING) AS node_id, filename AS name, status AS detail,
           CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS INT) AS page_number FROM fx_documents
    UNION ALL
    SELECT 'Fact', CAST(fact_id AS STRING), value_raw, coalesce(time_value, '') || '|' || coalesce(scope, ''),
           CAST(confidence AS DOUBLE), NULL FROM fx_facts
    UNION ALL
    SELECT DISTINCT 'Entity', CAST(entity_id AS STRING), canonical_name, NULL, NULL, NULL
    FROM fx_entities WHERE entity_id IN (SELECT subject_entity_id FROM fx_facts)
    UNION ALL
    SELECT DISTINCT 'Evidence', evidence_id, quote, NULL, NULL, page_number FROM fx_evidence""")
def graph_nodes(t):
    return graph.nodes(*_parts(t)[:4]).select(
        "label", "node_id",
        F.coalesce("filename", "value_raw", "name", "quote").alias("name"),
        F.when(F.col("label") == "Fact", F.concat_ws("|", "time_value", "scope")).otherwise(F.col("status")).alias("detail"),
        F.col("confidence").cast("double").alias("confidence"), "page_number",
    )


GRAPH_SQL = """
    edges AS (
      SELECT 'FROM_DOCUMENT' AS edge_type, 'Fact:' || fact_id AS src, 'Document:' || document_id AS dst
      FROM fx_facts WHERE document_id IN (SELECT document_id FROM fx_documents)
      UNION
      SELECT 'ABOUT', 'Fact:' || fact_id, 'Entity:' || subject_entity_id
      FROM fx_facts WHERE subject_entity_id IN (SELECT entity_id FROM fx_entities)
      UNION
      SELECT 'SUPPORTED_BY', 'Fact:' || fact_id, 'Evidence:' || evidence_id
      FROM fx_evidence WHERE fact_id IN (SELECT fact_id FROM fx_facts)
      UNION
      SELECT 'FROM', 'Evidence:' || evidence_id, 'Document:' || document_id
      FROM fx_evidence WHERE document_id IN (SELECT document_id FROM fx_documents)
      UNION
      SELECT upper(relationship_type), 'Fact:' || fact_a_id, 'Fact:' || fact_b_id
      FROM fx_relationships
      WHERE upper(relationship_type) IN ('CORROBORATES', 'CONTRADICTS', 'POTENTIAL_CONTRADICTION', 'RECONCILES',
                                         'TEMPORAL_UPDATE', 'UNIT_DIFFERENCE', 'SCOPE_DIFFERENCE', 'UNCERTAIN')
        AND fact_a_id IN (SELECT fact_id FROM fx_facts) AND fact_b_id IN (SELECT fact_id FROM fx_facts))"""


@query("graph_edges", f"WITH {GRAPH_SQL} SELECT edge_type, src, dst FROM edges")
def graph_edges(t):
    return graph.edges(*_parts(t)).select("edge_type", "src", "dst")


@query("provenance_trace", """
    SELECT f.fact_id, f.value_raw, e.evidence_id, e.quote, e.page_number, d.document_id, d.filename
    FROM fx_facts f
    JOIN (SELECT DISTINCT * FROM fx_evidence) e ON e.fact_id = f.fact_id
    JOIN fx_documents d ON d.document_id = e.document_id""")
def provenance_trace(t):
    return graph.provenance_trace(t("fx_facts"), graph.once(t("fx_evidence"), "fact_id"), t("fx_documents"))


# Everything within two steps of one entity, edges taken in both directions.
@query("entity_neighbours", f"""
    WITH {GRAPH_SQL},
    both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    one AS (SELECT DISTINCT dst AS node FROM both_ways WHERE src = 'Entity:7'),
    two AS (SELECT DISTINCT b.dst AS node FROM both_ways b JOIN one ON b.src = one.node)
    SELECT node, CAST(min(hops) AS INT) AS hops FROM (
      SELECT 'Entity:7' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two)
    GROUP BY node""")
def entity_neighbours(t):
    return graph.neighbours(graph.edge_rows(*_parts(t)), "Entity:7", hops=2)
