"""Fact extraction, response parsing, quote grounding, facts and evidence rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from veritrace import schemas
from veritrace.functions import text as tx, values

# ---------------------------------------------------------------- grounding


def quote_pattern(quote: Column) -> Column:
    """A regular expression that matches the words of ``quote`` with any
    whitespace between them. Each word is quoted literally."""
    words = F.regexp_extract_all(quote, F.lit(f"{tx.NON_WS}+"), 0)
    literal = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.array_join(literal, f"{tx.WS}+")


def ground(rows: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Adds grounding ('exact', 'normalized' or 'none'), char_start and
    char_end: the first place of the quote in the text, end exclusive.

    The pattern search runs only for quotes that are not there literally. Its
    match is cut from the text itself, so its first literal place is also the
    first place of the match.
    """
    body, wanted = F.col(text), F.col(quote)
    exact = F.position(wanted, body)
    blank = tx.is_blank(wanted)
    rows = rows.withColumn("_at", F.when(blank, 0).otherwise(exact))
    span = F.when(F.col("_at") > 0, wanted).when(~blank, F.regexp_substr(body, quote_pattern(wanted)))
    rows = rows.withColumn("_span", span)
    start = F.position(F.col("_span"), body) - 1
    return (
        rows.withColumn(
            "grounding",
            F.when(F.col("_at") > 0, "exact").when(F.col("_span").isNotNull(), "normalized").otherwise("none"),
        )
        .withColumn("char_start", F.when(F.col("_span").isNotNull(), start).cast("int"))
        .withColumn("char_end", (F.col("char_start") + F.length("_span")).cast("int"))
        .drop("_at", "_span")
    )


def keep_grounded(rows: DataFrame, mode: str = "strict", text: str = "text", quote: str = "quote") -> DataFrame:
    """Facts that may be stored: 'strict' asks for the literal quote again,
    'normalized' also takes quotes that differ in whitespace only."""
    if mode == "strict":
        return rows.filter(F.contains(F.col(text), F.col(quote)) & ~tx.is_blank(F.col(quote)))
    return rows.filter(F.col("grounding") != "none")


# ---------------------------------------------------------------- responses


def parse_response(raw: Column) -> Column:
    """JSON in a model response, as a variant: the whole text, else the first
    fenced block that parses, else the stretch from the first { to the last }.
    NULL when none of them parses."""
    body = tx.strip_ws(raw)
    fenced = F.transform(
        F.split(body, "```", -1), lambda part: tx.strip_ws(F.regexp_replace(tx.strip_ws(part), "^json", ""))
    )
    blocks = F.filter(
        F.transform(F.filter(fenced, lambda p: p.rlike(r"^[{\[]")), lambda p: F.try_parse_json(p)),
        lambda v: v.isNotNull(),
    )
    braces = F.regexp_substr(body, F.lit(r"(?s)\{.*\}"))
    return F.coalesce(
        F.try_parse_json(body),
        F.when(F.contains(body, F.lit("```")), F.get(blocks, 0)),
        F.try_parse_json(braces),
    )


def parse_responses(rows: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds ``parsed`` and, where nothing could be parsed, ``error``."""
    return rows.withColumn("parsed", parse_response(F.col(raw))).withColumn(
        "error", F.when(F.col("parsed").isNull(), F.lit("response holds no JSON"))
    )


# Kinds of subjects.
SUBJECT_TYPES = ["org", "person", "place", "other"]


def _kind(item: Column, path: str) -> Column:
    """Type name of a field, NULL when the field is absent."""
    return F.schema_of_variant(F.try_variant_get(item, path, "variant"))


def _as_text(item: Column, field: str, default: str) -> Column:
    """A field as text: the default when absent, "None" for a JSON null."""
    path = f"$.{field}"
    kind = _kind(item, path)
    return (
        F.when(kind.isNull(), F.lit(default)).when(kind == "VOID", F.lit("None"))
        .otherwise(F.coalesce(F.try_variant_get(item, path, "string"), F.lit(default)))
    )


def coerce_facts(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """One row per proposed fact in a parsed response.

    Adds the fields of a proposed fact, with defaults where they are absent,
    and ``drop_reason``: not_object, blank_quote, malformed, or NULL.
    """
    items = F.try_variant_get(F.col(parsed), "$.facts", "array<variant>")
    opened = rows.select("*", F.posexplode(items).alias("item_no", "item")).drop(parsed)
    item = F.col("item")

    def optional_text(field: str) -> Column:
        return F.when(_kind(item, f"$.{field}") == "STRING", F.try_variant_get(item, f"$.{field}", "string"))

    def bad_text(field: str) -> Column:
        kind = _kind(item, f"$.{field}")
        return kind.isNotNull() & ~kind.isin("STRING", "VOID")

    conf_kind = _kind(item, "$.confidence")
    confidence = F.when(conf_kind.isNull(), F.lit(0.5)).otherwise(F.try_variant_get(item, "$.confidence", "double"))
    type_kind = _kind(item, "$.subject_type")
    subject_type = F.when(type_kind.isNull(), "other").when(type_kind == "STRING", F.try_variant_get(item, "$.subject_type", "string"))
    new_kind = _kind(item, "$.predicate_is_new")
    is_new = (
        F.when(new_kind.isNull(), F.lit(True)).when(new_kind == "VOID", F.lit(False))
        .when(new_kind == "STRING", F.try_variant_get(item, "$.predicate_is_new", "string") != "")
        .otherwise(F.coalesce(F.try_variant_get(item, "$.predicate_is_new", "boolean"), F.lit(True)))
    )

    def object_json(field: str) -> Column:
        value = F.try_variant_get(item, f"$.{field}", "variant")
        return F.when(_kind(item, f"$.{field}").startswith("OBJECT"), F.to_json(value))

    wide = opened.withColumns({
        "is_object": F.schema_of_variant(item).startswith("OBJECT"),
        "subject": _as_text(item, "subject", "Unknown"),
        "subject_type": subject_type,
        "predicate": _as_text(item, "predicate", "unknown"),
        "predicate_is_new": is_new,
        "value_raw": _as_text(item, "value_raw", ""),
        "value_json": object_json("value_normalized"),
        "qualifiers_json": object_json("qualifiers"),
        "time_type": optional_text("time_type"),
        "time_value": optional_text("time_value"),
        "scope": optional_text("scope"),
        "confidence": confidence.cast("float"),
        "quote": tx.strip_ws(_as_text(item, "quote", "")),
        "bad_text": bad_text("time_type") | bad_text("time_value") | bad_text("scope"),
    })
    malformed = (
        F.col("confidence").isNull() | ~F.coalesce(F.col("subject_type").isin(SUBJECT_TYPES), F.lit(False)) | F.col("bad_text")
    )
    reason = (
        F.when(~F.coalesce(F.col("is_object"), F.lit(False)), "not_object")
        .when(F.col("quote") == "", "blank_quote").when(malformed, "malformed")
    )
    return wide.withColumn("drop_reason", reason).drop("item", "is_object", "bad_text")


# --------------------------------------------------------------- extraction

# Wordings of common metrics and their names.
METRICS = {
    "total income": "total income", "revenue": "revenue", "turnover": "revenue", "net profit": "net profit",
    "net loss": "net loss", "ebitda": "ebitda", "headcount": "employee count", "employees": "employee count",
}
# Nouns that make a plain number a count.
COUNT_NOUNS = "units|employees|people|tonnes|shares|customers"

_SCALE = "|".join(values.SCALE_WORDS.values())
MONEY_TEXT = rf"(?:Rs\.?|₹|INR|USD|EUR|GBP|US\$|\$|€|£)\s*{values.NUMBER}(?:\s*(?:{_SCALE})\b)?"
VALUE_TEXT = rf"(?i)(?:{MONEY_TEXT}|{values.NUMBER}\s*(?:%|per\s?cent\b)|{values.NUMBER}\s+(?:{COUNT_NOUNS})\b)"
# Periods that cannot be meant as any other number, and those with bare years.
MARKED_PERIOD = (
    r"\bQ[1-4]\s+(?:FY\s*'?)?[0-9]{2,4}\b|\b(?:FY|financial year|fiscal year)\s*'?[0-9]{2,4}(?:[-–/][0-9]{2,4})?\b"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:\s*(?:to|–)\s*[0-9]{4}-[0-9]{2}-[0-9]{2})?"
)
PERIOD_TEXT = rf"(?i)(?:{MARKED_PERIOD}|\b(?:19|20)[0-9]{{2}}\b)"
# A sentence ends at . ! or ? before a capital; a clause at a comma or semicolon.
SENTENCE_END = rf"(?<!\bLtd)(?<!\bRs)(?<=[.!?]){tx.WS}+(?=\p{{Lu}})"
CLAUSE_END = rf"[,;]{tx.WS}+"
SUBJECT_TEXT = r"^(\p{Lu}[\p{L}0-9&.#-]*(?:\s+(?:\p{Lu}[\p{L}0-9&.#-]*|[0-9]+))*)\s+(?:today\s+)?(?:reported|announced|recorded|posted)\b"
GROWTH_TEXT = r"(?i)(?:increased|decreased|grew|rose|fell|declined)\s+by\s*$"


def _first(text: Column, pattern: str) -> Column:
    return F.regexp_substr(text, F.lit(pattern))


def _first_period(text: Column, name: Column) -> Column:
    """The first period of a text. Numbers of the name that opens it and of values are none, unless marked as a period."""
    opening = F.regexp_replace(name, rf"(?i)({MARKED_PERIOD})|[0-9]+", "$1 ")
    named = F.when(F.startswith(text, name), F.concat(opening, text.substr(F.length(name) + 1, F.length(text)))).otherwise(text)
    return _first(F.regexp_replace(named, rf"(?i)({MARKED_PERIOD})|{VALUE_TEXT}", "$1 "), PERIOD_TEXT)


def extract_by_rule(chunks: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Default extractor: values of known metrics, found by pattern.

    Adds the fields of a proposed fact and ``fact_no`` to the chunk columns; a
    chunk gives one row per value. Metric, period and scope come from the
    clause of the value, or else from its sentence. The subject is the name
    that opens the sentence, or else ``default_subject`` if there is such a
    column. The quote is the clause.
    """
    metric_text = "(?i)\\b(?:" + "|".join(metrics) + ")\\b"
    names = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    sentences = chunks.select("*", F.posexplode(F.split("text", SENTENCE_END)).alias("sentence_no", "sentence"))
    clauses = (
        sentences.filter(F.col("sentence").rlike(VALUE_TEXT) & F.col("sentence").rlike(metric_text))
        .select("*", F.posexplode(F.split("sentence", CLAUSE_END)).alias("clause_no", "clause"))
    )
    found = clauses.select(
        "*", F.posexplode(F.regexp_extract_all("clause", F.lit(VALUE_TEXT), 0)).alias("value_no", "value_raw")
    )
    clause, sentence = F.col("clause"), F.col("sentence")
    metric = F.coalesce(_first(clause, metric_text), _first(sentence, metric_text))
    before = clause.substr(F.lit(1), F.position(F.col("value_raw"), clause) - 1)
    # A wording that only a pattern of the table matches names itself.
    name = F.coalesce(F.try_element_at(names, F.lower(metric)), F.lower(metric))
    scope = F.lower(F.coalesce(*[_first(c, r"(?i)\b(?:consolidated|standalone)\b") for c in (clause, sentence)]))
    subject = F.nullif(F.regexp_extract(sentence, SUBJECT_TEXT, 1), F.lit(""))
    period = F.coalesce(_first_period(clause, subject), _first_period(sentence, subject))
    if "default_subject" in chunks.columns:
        subject = F.coalesce(subject, F.col("default_subject"))
    out = found.select(
        *chunks.columns,
        F.struct("sentence_no", "clause_no", "value_no").alias("place"),
        F.coalesce(subject, F.lit("Unknown")).alias("subject"),
        F.lit("org").alias("subject_type"),
        F.when(before.rlike(GROWTH_TEXT), F.concat(name, F.lit(" growth"))).otherwise(name).alias("predicate"),
        "value_raw",
        F.when(period.isNotNull(), values.normalize_period(period)["time_type"]).alias("time_type"),
        period.alias("time_value"), scope.alias("scope"), F.lit(0.9).cast("float").alias("confidence"),
        clause.alias("quote"),
    )
    # Places are 32-bit, so ten digits each hold any sentence, clause and value.
    digits = [F.lpad(F.col(f"place.{c}").cast("string"), 10, "0") for c in ("sentence_no", "clause_no", "value_no")]
    return out.withColumn("fact_no", F.concat(*digits)).drop("place")


#: Bytes of predicate names that may go to every task.
KNOWN_BYTES = 1 << 23

# A provider takes chunk texts and returns one raw response per text.
Provider = Callable[[pd.Series], list]


def known_predicates(predicates: DataFrame, most: int = KNOWN_BYTES) -> list[str]:
    """Names of the ontology for an extractor, in order. They go to every task, so their size is checked."""
    size = predicates.agg(F.coalesce(F.sum(F.octet_length("canonical_name")), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"the names of the ontology have {size} bytes, more than the {most} that are sent to each task")
    return sorted(r[0] for r in predicates.select("canonical_name").distinct().collect())


def extract_by_provider(chunks: DataFrame, load_provider: Callable[[list[str]], Provider], known: list[str] = ()) -> DataFrame:
    """Adds ``raw_response`` from a plug-in model, loaded once per task with the
    names of the ``known`` predicates. Where the provider fails on a batch, its two halves are given on their own,
    and so on; the error of a text that fails alone is in ``provider_error`` and its response is NULL."""
    names = chunks.sparkSession.sparkContext.broadcast(list(known))
    schema = T.StructType(
        [*chunks.schema.fields, T.StructField("raw_response", T.StringType()), T.StructField("provider_error", T.StringType())]
    )

    def ask(provider: Provider, texts: pd.Series) -> list[tuple]:
        try:
            return [(r, None) for r in provider(texts)]
        except Exception as exc:  # noqa: BLE001 - any provider failure is data
            if len(texts) == 1:
                return [(None, str(exc))]
        half = len(texts) // 2
        return ask(provider, texts.iloc[:half]) + ask(provider, texts.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = load_provider(names.value)
        for batch in batches:
            said = ask(provider, batch["text"]) if len(batch) else []
            yield batch.assign(raw_response=[r for r, _ in said], provider_error=[e for _, e in said])

    return chunks.mapInPandas(run, schema)


def provider_facts(answered: DataFrame) -> DataFrame:
    """Proposed facts of chunks with ``raw_response``, as ``extract_by_rule`` gives them."""
    items = coerce_facts(parse_responses(answered).drop("raw_response", "provider_error", "error"))
    number = F.lpad(F.col("item_no").cast("string"), 10, "0")
    return items.filter(F.col("drop_reason").isNull()).withColumn("fact_no", number).drop("item_no", "drop_reason", "value_json", "qualifiers_json")


def provider_attempts(answered: DataFrame, proposed: DataFrame) -> DataFrame:
    """(document_id, chunk_no, n_facts, n_dropped, error) per chunk, for ``grounding_metrics``."""
    counts = proposed.groupBy("chunk_id").agg(
        F.count_if(F.col("grounding") != "none").alias("f"), F.count_if(F.col("grounding") == "none").alias("d")
    )
    tried = parse_responses(answered).withColumn("error", F.coalesce("provider_error", "error"))
    zero = F.lit(0)
    return tried.join(counts, "chunk_id", "left").select(
        "document_id", "chunk_no", F.coalesce("f", zero).alias("n_facts"), F.coalesce("d", zero).alias("n_dropped"), "error"
    )


# ------------------------------------------------------------ rows and log


def grounding_metrics(attempts: DataFrame) -> DataFrame:
    """Counts per document over its chunks (chunk_no, n_facts, n_dropped,
    error); the sample error is that of the first failing chunk."""
    failed = F.col("error").isNotNull()
    return attempts.groupBy("document_id").agg(
        F.sum("n_facts").alias("facts"),
        F.sum("n_dropped").alias("dropped_ungrounded"),
        F.count_if(failed).alias("chunk_errors"),
        F.count(F.lit(1)).alias("chunks_total"),
        F.min(F.when(failed, F.struct("chunk_no", "error")))["error"].alias("sample_error"),
    )


def extraction_outcome(metrics: DataFrame) -> DataFrame:
    """The stage fails only if every chunk failed; the document is ready either way."""
    all_failed = (F.col("chunk_errors") > 0) & (F.col("chunk_errors") == F.col("chunks_total"))
    return metrics.withColumn("job_status", F.when(all_failed, "failed").otherwise("done")).withColumn(
        "job_error", F.when(all_failed, F.col("sample_error"))
    ).withColumn("document_status", F.lit("ready"))


def build_facts(grounded: DataFrame) -> DataFrame:
    """Fact rows from grounded, resolved proposals; the vector is the chunk's.

    Needs document_id, chunk_id, embedding, fact_no, subject_entity_id,
    predicate_id, value_raw, time_type, time_value, scope, confidence, quote,
    char_start, char_end.
    """
    return grounded.select(
        schemas.natural_id("chunk_id", "char_start", "char_end", "predicate_id", "value_raw", "fact_no").alias("fact_id"),
        "document_id", "chunk_id", "subject_entity_id", "predicate_id", "value_raw",
        values.normalize_value(F.col("value_raw")).alias("value_normalized"),
        "time_type", "time_value", "scope", F.col("confidence").cast("float").alias("confidence"),
        "char_start", "char_end", "embedding", F.lit("active").alias("status"),
        F.current_timestamp().alias("created_at"), "quote", "page_start", *([F.col("unit_pages")] if "unit_pages" in grounded.columns else []),
    )


def quote_page(unit_pages: Column, char_start: Column) -> Column:
    """The page a quote starts on. ``unit_pages`` has where each unit of its chunk starts, in order, with the
    page of the unit; a chunk has no more units than its token budget, so the array is bounded."""
    return F.element_at(F.filter(unit_pages, lambda u: u["at"] <= char_start), -1)["page_number"]


def build_evidence(facts: DataFrame, page: Column | None = None) -> DataFrame:
    """One evidence row per fact. The page is the first of its chunk, unless
    ``page`` gives the page of the quote itself."""
    return facts.select(
        schemas.natural_id(F.lit("evidence"), "fact_id").alias("evidence_id"), "fact_id", "document_id",
        (F.col("page_start") if page is None else page).cast("int").alias("page_number"),
        "chunk_id", "quote", "char_start", "char_end",
    )
