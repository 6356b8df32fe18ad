"""Read side: listings, lookups, fact views, search, conflict explorer, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrace.functions import labels, text as tx
from veritrace.session import materialize

# Fixed value: rows in a recent listing.
LIST_LIMIT = 200


def fact_view(
    facts: DataFrame, documents: DataFrame, entities: DataFrame, predicates: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Facts with file name ("" if the document is gone), subject, predicate,
    and one row per piece of evidence, or one without any. The order within a
    fact is (page_number, evidence_id). Vectors are not read.

    Kept as rows because a fact may have any amount of evidence; a bounded
    listing may nest them with ``nest_evidence``.
    """
    quotes = evidence.select("fact_id", "page_number", "evidence_id", "quote")
    return named_facts(facts, documents, entities, predicates).join(quotes, "fact_id", "left")


def nest_evidence(listed: DataFrame, evidence: DataFrame) -> DataFrame:
    """The facts of a listing of bounded length with their evidence as an array
    ordered by page. Only evidence of the listed facts is gathered."""
    quotes = evidence.join(listed.select("fact_id"), "fact_id", "left_semi").groupBy("fact_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "evidence_id", "quote"))).alias("evidence")
    )
    empty = F.expr("cast(array() as array<struct<page_number:int,evidence_id:string,quote:string>>)")
    return listed.join(quotes, "fact_id", "left").withColumn("evidence", F.coalesce("evidence", empty))


def named_facts(facts: DataFrame, documents: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """Facts with file name, subject and predicate names; missing names stay NULL."""
    names = entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))
    metrics = predicates.select("predicate_id", F.col("canonical_name").alias("predicate"))
    return (
        facts.drop("embedding")
        .join(documents.select("document_id", F.col("filename").alias("document_filename")), "document_id", "left")
        .join(names, "subject_entity_id", "left")
        .join(metrics, "predicate_id", "left")
        .withColumn("document_filename", F.coalesce("document_filename", F.lit("")))
    )


def newest(rows: DataFrame, key: str, limit: int = LIST_LIMIT, at: str = "created_at") -> DataFrame:
    """Newest rows first; planned as a top-k, not as a sort of the table."""
    return rows.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)


def recent_facts(facts: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return newest(facts.filter(F.col("status") == "active"), "fact_id", limit)


def recent_relationships(relationships: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return newest(relationships, "relationship_id", limit)


def facts_by_document(facts: DataFrame, document_ids: DataFrame) -> DataFrame:
    """Facts of the given documents in order of creation, any status."""
    return facts.join(document_ids, "document_id", "left_semi").repartition("document_id").sortWithinPartitions("document_id", "created_at", "fact_id")


def document_list(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("uploaded_seq").desc())


def page_list(pages: DataFrame) -> DataFrame:
    return pages.repartition("document_id").sortWithinPartitions("document_id", "page_number")


def job_list(jobs: DataFrame) -> DataFrame:
    return jobs.repartition("document_id").sortWithinPartitions("document_id", "seq")


def entity_list(entities: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return entities.orderBy("canonical_name", "entity_id").limit(limit)


def lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Requested keys with their rows; ``found`` is false where there is none."""
    on = keys.columns
    return keys.join(rows.withColumn("_hit", F.lit(True)), on, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def fact_relationships(relationships: DataFrame) -> DataFrame:
    """Relationships keyed by either of their facts. Turning the two ends into
    rows keeps later joins equi-joins, where an OR would compare all pairs."""
    ends = F.array_distinct(F.array("fact_a_id", "fact_b_id"))
    return relationships.withColumn("fact_id", F.explode(ends))


def relationships_of(relationships: DataFrame, fact_ids: DataFrame) -> DataFrame:
    return fact_relationships(relationships).join(fact_ids, "fact_id", "left_semi").repartition("fact_id").sortWithinPartitions(
        "fact_id", F.col("created_at").desc(), F.col("relationship_id").desc()
    )


def search_facts(views: DataFrame, term: str) -> DataFrame:
    """Facts with ``term`` in subject, predicate, value or file name. An empty
    term matches all; apply to ``recent_facts`` for the listing's scope."""
    if not term:
        return views
    hit: Column = F.lit(False)
    for name in ("subject", "predicate", "value_raw", "document_filename"):
        hit = hit | tx.contains_literal(F.col(name), term)
    return views.filter(hit)


def fact_summary(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("document_id").alias("documents"))


def evidence_count(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    counts = evidence.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return facts.select("fact_id").join(counts, "fact_id", "left").fillna(0, ["n_evidence"])


def conflict_groups(relationships: DataFrame) -> DataFrame:
    """Groups of the conflict listing with their counts, in display order.
    Empty groups do not appear. The members are ``conflict_rows``."""
    return (
        relationships.groupBy(F.coalesce("relationship_type", F.lit("UNCERTAIN")).alias("relationship_type"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("display_rank", labels.display_rank(F.col("relationship_type")))
        .orderBy("display_rank", "relationship_type")
    )


def conflict_rows(relationships: DataFrame) -> DataFrame:
    """Relationships in the order in which the grouped listing shows them."""
    shown = relationships.withColumn("relationship_type", F.coalesce("relationship_type", F.lit("UNCERTAIN")))
    return shown.withColumn("display_rank", labels.display_rank(F.col("relationship_type"))).orderBy(
        "display_rank", "relationship_type", F.col("created_at").desc(), "relationship_id"
    )


def first_evidence(evidence: DataFrame) -> DataFrame:
    """The first quote of each fact by page; combines before the shuffle."""
    first = F.min(F.struct("page_number", "evidence_id", "quote"))
    return evidence.groupBy("fact_id").agg(first.alias("e")).select(
        "fact_id", F.col("e.page_number").alias("page_number"), F.col("e.quote").alias("quote")
    )


def conflict_detail(relationships: DataFrame, named: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each relationship with both facts side by side and their first quotes.
    A side that is missing stays NULL."""
    cols = ["subject", "predicate", "value_raw", "time_value", "scope", "document_filename"]
    quoted = named.select("fact_id", *cols).join(quotes.select("fact_id", "quote"), "fact_id", "left")

    def side(letter: str) -> DataFrame:
        return quoted.select(
            F.col("fact_id").alias(f"fact_{letter}_id"), *[F.col(c).alias(f"{letter}_{c}") for c in [*cols, "quote"]]
        )

    return relationships.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")


def pending_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(labels.is_pending(F.col("status"))).withColumn(
        "status_label", labels.status_label(F.col("status"))
    )


def timeline(facts: DataFrame) -> DataFrame:
    """Events of each (subject, predicate) by the start of their period.

    Needs subject_entity_id, predicate_id, fact_id, period_start, amount. Adds
    ``event_no`` and the change of the amount since the event before.

    The events are cut into ranges of (subject, predicate, period, id), so a
    subject with very many events, one without a name or period, and a day
    with very many events are in as many ranges as they need. Each range is
    numbered on its own, and one summary row per subject and range is ordered
    per subject. Repeated rows each count as an event.
    """
    key = ["subject_entity_id", "predicate_id"]
    order = [F.col("period_start").asc_nulls_last(), "fact_id"]
    # Stored before, as the sample for the borders reads the rows once more than the cut
    # does, and after, as the borders must not move between reads.
    cut = materialize(materialize(facts, "events").repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "timeline")
    ranges = cut.groupBy(*key, "_range").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct(F.col("period_start").isNull(), "period_start", "fact_id", "amount"))["amount"].alias("_last"),
    )
    by_range = Window.partitionBy(*key).orderBy("_range")
    before = ranges.select(
        *key, "_range",
        F.coalesce(F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lag("_last").over(by_range).alias("_previous"),
    )
    inside = Window.partitionBy(*key, "_range").orderBy(*order)
    numbered = cut.withColumn("_at", F.row_number().over(inside)).withColumn("_lag", F.lag("amount").over(inside))
    left, right = numbered.alias("l"), before.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, "_range"]]
    previous = F.when(F.col("_at") == 1, F.col("_previous")).otherwise(F.col("_lag"))
    return left.join(right, same).select(
        "l.*", (F.col("_base") + F.col("_at")).alias("event_no"), (F.col("amount") - previous).alias("change")
    ).drop("_range", "_at", "_lag")


def comparison_table(facts: DataFrame) -> DataFrame:
    """One row per (subject, predicate, document): the newest value stated
    there, and how many facts of the document it stands for."""
    return facts.groupBy("subject_entity_id", "predicate_id", "document_id").agg(
        F.max_by("value_raw", F.struct("created_at", "fact_id")).alias("value"),
        F.max(F.struct("created_at", "fact_id"))["fact_id"].alias("fact_id"),
        F.count(F.lit(1)).alias("n_facts"),
    )


def entity_cards(entities: DataFrame, facts: DataFrame) -> DataFrame:
    counts = facts.groupBy(F.col("subject_entity_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("fact_count"))
    return entities.select("entity_id", F.col("canonical_name").alias("name"), "entity_type").join(
        counts, "entity_id", "left"
    ).fillna(0, ["fact_count"])


def fact_cards(named: DataFrame) -> DataFrame:
    """Facts with the number of documents that state the same value for the
    same subject, metric and period. Counted by grouping, then joined back."""
    key = ["subject_entity_id", "predicate_id", "value_raw", "time_value"]
    counts = named.groupBy(*key).agg(F.countDistinct("document_id").alias("source_count"))
    left, right = named.alias("l"), counts.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    return left.join(right, same).select("l.*", "r.source_count")
