"""Answers as lists of typed components: assembly, validation, citations."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from veritrace.functions.values import let

# ----------------------------------------------------------------- assembly

# Component for each kind of relationship.
CARD_FOR = {
    "CORROBORATES": "CorroborationCard",
    "CONTRADICTS": "ConflictCard", "POTENTIAL_CONTRADICTION": "ConflictCard",
    "RECONCILES": "ReconciliationCard", "SCOPE_DIFFERENCE": "ReconciliationCard",
    "UNIT_DIFFERENCE": "ReconciliationCard", "TEMPORAL_UPDATE": "ReconciliationCard",
}
# Short reason shown on a reconciliation.
REASON_FOR = {
    "RECONCILES": "period", "SCOPE_DIFFERENCE": "scope", "UNIT_DIFFERENCE": "unit", "TEMPORAL_UPDATE": "vintage",
}


def _choice(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def assemble(questions: DataFrame, fact_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """Components per question by rule, as rows in order of (section, rank,
    relationship_id): component_type, fact_a_id, fact_b_id, reason.

    Text comes first, then a card per retrieved fact in order of distance, then
    a card per relationship of those facts; a question with no facts gets a
    single uncertainty card. A fact may have any number of relationships, so
    the list stays rows and is not numbered.
    """
    key = dict(fact_rows.dtypes)["fact_id"]
    found = fact_rows.select("question_id").distinct().withColumn("answered", F.lit(True))
    heads = questions.select("question_id").join(found, "question_id", "left").select(
        "question_id", F.lit(0).alias("section"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("relationship_id"),
        F.when(F.col("answered"), "AnswerText").otherwise("UncertaintyCard").alias("component_type"),
        F.lit(None).cast(key).alias("fact_a_id"), F.lit(None).cast(key).alias("fact_b_id"),
        F.lit(None).cast("string").alias("reason"),
    )
    cards = fact_rows.select(
        "question_id", F.lit(1).alias("section"), "rank", F.lit(None).cast("long").alias("relationship_id"),
        F.lit("FactCard").alias("component_type"), F.col("fact_id").alias("fact_a_id"),
        F.lit(None).cast(key).alias("fact_b_id"), F.lit(None).cast("string").alias("reason"),
    )
    relations = (
        relation_rows.withColumn("component_type", _choice(CARD_FOR, F.col("relationship_type")))
        .filter(F.col("component_type").isNotNull())
        .groupBy("question_id", "relationship_id", "component_type", "relationship_type", "fact_a_id", "fact_b_id")
        .agg(F.min("rank").alias("rank"))
        .select(
            "question_id", F.lit(2).alias("section"), "rank", "relationship_id", "component_type", "fact_a_id", "fact_b_id",
            _choice(REASON_FOR, F.col("relationship_type")).alias("reason"),
        )
    )
    return heads.unionByName(cards).unionByName(relations)


# --------------------------------------------------------------- validation

class Field(NamedTuple):
    """A field of a component. A nullable one may be null even under the strict level."""

    name: str
    kind: str
    optional: bool = False
    nullable: bool = False


# Fields of each component.
FIELDS = {
    "AnswerText": [
        Field("text", "text"),
        Field("citations", "citations", optional=True),
    ],
    "FactCard": [
        Field("fact_id", "id"),
        Field("subject", "text"),
        Field("predicate", "text"),
        Field("value_display", "text"),
        Field("time_value", "text", optional=True),
        Field("scope", "text", optional=True),
        Field("confidence", "share"),
        Field("source_count", "count", optional=True),
    ],
    "EvidenceCard": [
        Field("evidence_id", "id", optional=True),
        Field("document_id", "id"),
        Field("document_filename", "text"),
        Field("page", "page"),
        Field("quote", "text"),
    ],
    "CorroborationCard": [
        Field("fact_ids", "ids"),
        Field("explanation", "text"),
        Field("confidence", "share"),
    ],
    "ConflictCard": [
        Field("fact_a_id", "id"),
        Field("fact_b_id", "id"),
        Field("relationship_type", "conflict"),
        Field("explanation", "text"),
        Field("confidence", "share"),
    ],
    "ReconciliationCard": [
        Field("fact_a_id", "id"),
        Field("fact_b_id", "id"),
        Field("reason", "text"),
        Field("explanation", "text"),
        Field("confidence", "share"),
    ],
    "ComparisonTable": [
        Field("title", "text", optional=True),
        Field("rows", "rows"),
    ],
    "Timeline": [
        Field("subject", "text"),
        Field("events", "events"),
    ],
    "EntityCard": [
        Field("entity_id", "id"),
        Field("name", "text"),
        Field("entity_type", "text"),
        Field("fact_count", "count"),
    ],
    "UncertaintyCard": [
        Field("message", "text"),
        Field("reason", "text"),
    ],
    "RelationshipCard": [
        Field("relationship_id", "id", optional=True),
        Field("fact_a_id", "id"),
        Field("fact_b_id", "id"),
        Field("relationship_type", "text"),
        Field("explanation", "text"),
        Field("confidence", "share"),
    ],
    "SourcePreview": [
        Field("document_id", "id"),
        Field("document_filename", "text"),
        Field("page", "page"),
        Field("quote", "text"),
        Field("fact_id", "id", optional=True),
        Field("evidence_id", "id", optional=True),
    ],
}
# Fields of list items.
ITEM_FIELDS = {
    "citations": [
        Field("marker", "text"),
        Field("fact_id", "id", optional=True),
        Field("evidence_id", "id", optional=True),
        Field("document_id", "id", optional=True, nullable=True),
        Field("page", "page", optional=True, nullable=True),
        Field("label", "text", optional=True, nullable=True),
    ],
    "rows": [
        Field("label", "text"),
        Field("value", "text"),
        Field("fact_id", "id", optional=True),
    ],
    "events": [
        Field("time_value", "text"),
        Field("value_display", "text"),
        Field("fact_id", "id", optional=True),
    ],
}
# Fields that have a default other than null, and so reject null.
DEFAULTED = {"citations", "source_count"}

UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _value_ok(value: Column, kind: str, strict: bool) -> Column:
    """Whether a present, non-null value fits. The lenient level reads numbers
    in strings, as the server's model does; the strict level does not, and also
    checks id forms, ranges and list lengths."""
    type_name = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    is_text = type_name == "STRING"
    is_number = type_name.isin("BIGINT", "DOUBLE", "FLOAT") | type_name.startswith("DECIMAL")
    whole = number == F.floor(number)
    if kind == "text":
        return is_text
    if kind == "id":
        return is_text & text.rlike(UUID) if strict else is_text
    if kind == "conflict":
        return is_text & text.isin("CONTRADICTS", "POTENTIAL_CONTRADICTION")
    if kind == "share":
        if strict:
            return is_number & number.between(0, 1)
        return number.isNotNull() & (is_number | is_text | (type_name == "BOOLEAN"))
    if kind in ("count", "page"):
        if strict:
            return is_number & whole & (number >= (1 if kind == "page" else 0))
        return number.isNotNull() & whole & (is_number | is_text | (type_name == "BOOLEAN"))
    items = F.try_variant_get(value, "$", "array<variant>")
    listed = type_name.startswith("ARRAY")
    if kind == "ids":
        ok = listed & F.forall(items, lambda v: F.coalesce(_value_ok(v, "id", strict), F.lit(False)))
        return ok & (F.size(items) >= 2) if strict else ok
    ok = listed & F.forall(items, lambda v: _object_ok(v, ITEM_FIELDS[kind], strict))
    return ok & (F.size(items) >= 1) if strict and kind in ("rows", "events") else ok


def _object_ok(value: Column, fields: list[Field], strict: bool) -> Column:
    def judge(have: Column) -> Column:
        ok = have.isNotNull()
        for field in fields:
            item = F.try_element_at(have, F.lit(field.name))
            fits = F.coalesce(_value_ok(item, field.kind, strict), F.lit(False))
            if field.optional:
                fits = fits | ~F.map_contains_key(have, field.name)
            if field.nullable or (field.optional and not strict and field.name not in DEFAULTED):
                fits = fits | F.is_variant_null(item)
            ok = ok & F.coalesce(fits, F.lit(False))
        return F.coalesce(ok, F.lit(False))

    # The map is built once, not once per field.
    return let(_fields(value), judge)


def component_ok(component: Column, strict: bool) -> Column:
    kind = F.try_variant_get(component, "$.type", "string")
    ok = F.lit(False)
    for name, fields in FIELDS.items():
        ok = F.when(kind == name, _object_ok(component, fields, strict)).otherwise(ok)
    return F.when(F.schema_of_variant(component).startswith("OBJECT"), ok).otherwise(False)


def validate_plans(plans: DataFrame, raw: str = "plan") -> DataFrame:
    """Adds ``valid_lenient``, ``valid_strict`` (the server's and the browser's
    level), ``bad_component`` (first invalid one under the strict level) and
    ``problem``. One bad component rejects its whole plan. An empty list of
    components is rejected at both levels."""
    parsed = plans.withColumn("_plan", F.try_parse_json(F.col(raw))).withColumn(
        "_parts", F.when(
            F.schema_of_variant(F.try_variant_get("_plan", "$.components", "variant")).startswith("ARRAY"),
            F.try_variant_get("_plan", "$.components", "array<variant>"),
        )
    )
    # One row per component keeps the rules to a single evaluation each.
    judged = parsed.withColumn(
        "_ok", F.transform(
            "_parts", lambda c: F.struct(component_ok(c, False).alias("lenient"), component_ok(c, True).alias("strict"))
        )
    )
    some = F.coalesce(F.size("_parts") > 0, F.lit(False))
    lenient = some & F.coalesce(F.forall("_ok", lambda r: r["lenient"]), F.lit(False))
    strict = some & F.coalesce(F.forall("_ok", lambda r: r["strict"]), F.lit(False))
    first_bad = F.array_position(F.transform("_ok", lambda r: r["strict"]), F.lit(False)) - 1
    return (
        judged.withColumn("valid_lenient", lenient).withColumn("valid_strict", strict)
        .withColumn("bad_component", F.when(first_bad >= 0, first_bad).cast("int"))
        .withColumn(
            "problem",
            F.when(F.col("_plan").isNull(), "not_json").when(F.col("_parts").isNull(), "no_list")
            .when(~some, "empty").when(~strict, "bad_component"),
        )
        .drop("_plan", "_parts", "_ok")
    )


def accepted_plans(plans: DataFrame, raw: str = "plan") -> DataFrame:
    """Adds ``accepted``: the plan itself if it is valid, else a plan of one uncertainty card."""
    message = {"type": "UncertaintyCard", "message": "No reliable answer could be built.", "reason": "The answer plan was not valid."}
    fallback = json.dumps({"components": [message]})
    judged = validate_plans(plans, raw)
    return judged.withColumn("accepted", F.when(F.col("valid_lenient"), F.col(raw)).otherwise(F.lit(fallback)))


# ---------------------------------------------------------------- citations

MARKER = r"\[\d+\]"


def card_details(components: DataFrame, fact_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """Adds explanation and confidence to cards of facts and relationships."""
    facts = fact_rows.select(F.col("fact_id").alias("fact_a_id"), F.col("confidence").alias("f_conf")).dropDuplicates(["fact_a_id"])
    told = relation_rows.select("relationship_id", "explanation", F.col("confidence").alias("r_conf")).dropDuplicates(["relationship_id"])
    return components.join(facts, "fact_a_id", "left").join(told, "relationship_id", "left").withColumn(
        "confidence", F.when(F.col("relationship_id").isNotNull(), F.col("r_conf")).when(F.col("component_type") == "FactCard", F.col("f_conf"))
    ).drop("f_conf", "r_conf")


def source_previews(chunk_rows: DataFrame) -> DataFrame:
    """A preview per retrieved chunk, after all cards."""
    return chunk_rows.select("question_id", F.lit(3).alias("section"), "rank", F.lit("SourcePreview").alias("component_type"), "chunk_id", F.col("snippet").alias("quote"))


def resolve_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Markers such as [2] in (answer_id, text), each with its citation.

    ``citations``: answer_id, marker, position, document_id, page, label. The
    last citation of a marker counts. A marker without one stays text; one with
    a document and a page is clickable.
    """
    markers = answers.select(
        "answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(MARKER), 0)).alias("marker_no", "marker")
    )
    last = citations.groupBy("answer_id", "marker").agg(
        F.max(F.struct("position", "document_id", "page", "label")).alias("c")
    ).select("answer_id", "marker", "c.document_id", "c.page", "c.label", F.lit(True).alias("hit"))
    joined = markers.join(last, ["answer_id", "marker"], "left")
    resolved = F.coalesce("hit", F.lit(False))
    page_label = F.when(
        F.coalesce(F.col("page"), F.lit(0)) != 0, F.concat(F.lit("Document · p."), F.col("page").cast("string"))
    ).otherwise("Related")
    return joined.select(
        "answer_id", "marker_no", "marker", resolved.alias("resolved"),
        (resolved & F.col("document_id").isNotNull() & (F.coalesce(F.col("page"), F.lit(0)) != 0)).alias("clickable"),
        F.when(resolved, F.coalesce(F.nullif("label", F.lit("")), page_label)).alias("label"),
    )
