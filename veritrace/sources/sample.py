"""The sample star-schema tables read as fact tables.

The sample data has no fact tables, so each one is a projection of a sample
table over all its rows. The statements use only syntax that Spark and a plain
SQL engine share, so a check can run the very same projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# {name} stands for the table or projection of that name.
PROJECTIONS = {
    # One document per customer.
    "fx_documents": """
        SELECT c_custkey AS document_id, concat(c_name, '.pdf') AS filename,
               CASE c_custkey % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing'
                    WHEN 2 THEN 'failed' WHEN 3 THEN 'archived' ELSE 'ready' END AS status,
               c_custkey AS uploaded_seq
        FROM {customer}""",
    # Suppliers as organisations, nations and regions as places.
    "fx_entities": """
        SELECT s_suppkey AS entity_id, s_name AS canonical_name, 'org' AS entity_type FROM {supplier}
        UNION ALL
        SELECT 1000000000 + n_nationkey, n_name, 'place' FROM {nation}
        UNION ALL
        SELECT 2000000000 + r_regionkey, r_name, 'place' FROM {region}""",
    # Priority and month of an order as the metric.
    "fx_predicates": """
        SELECT DISTINCT
               CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) * 100 + month(o_orderdate) AS BIGINT) AS predicate_id,
               concat(lower(substring(o_orderpriority, 3)), ' m', CAST(month(o_orderdate) AS STRING)) AS canonical_name
        FROM {orders}""",
    # One chunk per vector; a document owns every chunk with its number.
    "fx_chunks": """
        SELECT vec_id AS chunk_id, label, embedding FROM {embeddings}""",
    # One fact per order. Amounts are coarse so that documents agree at times;
    # some subjects, predicates, documents and vectors are missing on purpose.
    "fx_facts": """
        SELECT o_orderkey AS fact_id, o_custkey + 40 AS document_id,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey % 120 END AS subject_entity_id,
               CASE o_orderkey % 31 WHEN 0 THEN NULL WHEN 1 THEN 999 ELSE
                 CAST(CAST(substring(o_orderpriority, 1, 1) AS INT) * 100 + month(o_orderdate) AS BIGINT)
               END AS predicate_id,
               CASE o_orderkey % 7
                 WHEN 0 THEN concat('Rs. ', n, ' crore')
                 WHEN 1 THEN concat('INR ', n, '0 million')
                 WHEN 2 THEN concat('₹', n, '00 lakh')
                 WHEN 3 THEN concat('USD ', n, '.5 bn')
                 WHEN 4 THEN concat(n, '.25%')
                 WHEN 5 THEN concat(n, ',250 units')
                 ELSE 'not disclosed' END AS value_raw,
               CASE o_custkey % 8
                 WHEN 0 THEN concat('FY', y)
                 WHEN 1 THEN concat('FY', substring(y, 3, 2))
                 WHEN 2 THEN concat('Q', CAST(1 + o_orderkey % 4 AS STRING), ' FY', y)
                 WHEN 3 THEN concat('financial year ', y)
                 WHEN 4 THEN concat(y, '-03-31')
                 WHEN 5 THEN y
                 WHEN 6 THEN concat(y, '-04-01 to ', y, '-09-30')
                 ELSE NULL END AS time_value,
               CASE o_orderkey % 5 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' ELSE NULL END AS scope,
               CAST((o_orderkey % 101) / 100.0 AS FLOAT) AS confidence,
               CASE WHEN o_orderkey % 17 = 0 THEN 'superseded' WHEN o_orderkey % 19 = 0 THEN 'rejected'
                    ELSE 'active' END AS status,
               o_orderdate AS created_at,
               chunk_id, embedding
        FROM (SELECT *, CAST(1 + CAST(floor(o_totalprice / 125000) AS INT) AS STRING) AS n,
                     CAST(year(o_orderdate) AS STRING) AS y,
                     o_orderkey % (SELECT count(*) + 12 FROM {embeddings}) AS vec_no
              FROM {orders}) o
        LEFT JOIN {fx_chunks} c ON c.chunk_id = o.vec_no""",
    # One piece of evidence per order line.
    "fx_evidence": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                         CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS evidence_id,
               l_orderkey AS fact_id, o_custkey + 40 AS document_id, l_linenumber AS page_number,
               concat('part ', CAST(l_partkey AS STRING), ' from ', CAST(l_suppkey AS STRING)) AS quote
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # One relationship per order, to the order a few numbers on.
    "fx_relationships": """
        SELECT o_orderkey AS relationship_id, o_orderkey AS fact_a_id, o_orderkey + 1 + o_orderkey % 5 AS fact_b_id,
               CASE o_orderkey % 11
                 WHEN 0 THEN 'CORROBORATES' WHEN 1 THEN 'CONTRADICTS' WHEN 2 THEN 'POTENTIAL_CONTRADICTION'
                 WHEN 3 THEN 'RECONCILES' WHEN 4 THEN 'TEMPORAL_UPDATE' WHEN 5 THEN 'UNIT_DIFFERENCE'
                 WHEN 6 THEN 'SCOPE_DIFFERENCE' WHEN 7 THEN 'UNCERTAIN' WHEN 8 THEN NULL
                 WHEN 9 THEN 'contradicts' ELSE 'SIMILAR' END AS relationship_type,
               concat('seen on ', CAST(CAST(o_orderdate AS DATE) AS STRING)) AS explanation,
               CAST((o_orderkey % 100) / 100.0 AS FLOAT) AS confidence,
               o_orderdate AS created_at
        FROM {orders}""",
    # Documents have one page, conversations one page per turn.
    "fx_pages": """
        SELECT concat('d', CAST(doc_id AS STRING)) AS document_id, CAST(1 AS INT) AS page_number, text FROM {documents}
        UNION ALL
        SELECT concat('c', CAST(conv_id AS STRING)), CAST(turn + 1 AS INT), text FROM {conversations}""",
    # Events as the run log: one start or finish of a stage per event.
    "fx_jobs": """
        SELECT user_id AS document_id,
               CASE event_id % 5 WHEN 0 THEN 'extract_text' WHEN 1 THEN 'chunk' WHEN 2 THEN 'embed'
                    WHEN 3 THEN 'extract_facts' ELSE 'reason_relationships' END AS stage,
               event_id AS seq,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status,
               CASE WHEN event_type = 'error' THEN props ELSE NULL END AS error, props AS metrics
        FROM {events}""",
}


# Schemas by path; reading them once spares a job per use.
_SCHEMAS: dict[str, StructType] = {}


def _names(sql: str) -> list[str]:
    return [n for n in (*TABLES, *PROJECTIONS) if "{" + n + "}" in sql]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table, or one of the projections."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    sql = PROJECTIONS[name]
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _names(sql)})


def with_projections(sql: str) -> str:
    """``sql`` preceded by the projections it names, as common table
    expressions; the form in which a plain SQL engine runs it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PROJECTIONS:
            if name in text and name not in needed:
                needed.append(name)
                visit(PROJECTIONS[name])

    visit(sql)
    ctes = []
    for name in PROJECTIONS:
        if name in needed:
            body = PROJECTIONS[name]
            for n in _names(body):
                body = body.replace("{" + n + "}", n)
            ctes.append(f"{name} AS ({body})")
    head = sql.lstrip()
    if not ctes:
        return head
    if head.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + head[len("WITH RECURSIVE"):]
    if head.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + ", " + head[len("WITH"):]
    return "WITH " + ", ".join(ctes) + " " + head
