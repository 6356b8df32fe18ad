"""Cross-document reasoning: candidate pairs, context, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritrace.functions import labels, values
from veritrace.operators.nearest import nearest_in_groups, nearest_within
from veritrace.operators.views import first_evidence
from veritrace.session import materialize

# Fixed value: related facts per fact.
RELATED = 5
# Amounts within this share of the larger one are equal.
TOLERANCE = 0.000001

REVISION = r"(?i)\b(?:revised|restated|updated|re-estimated)\b"


def related_facts(facts: DataFrame, anchors: DataFrame | None = None, k: int = RELATED) -> DataFrame:
    """For each anchor the ``k`` nearest active facts of the same predicate in
    other documents: (fact_a_id, fact_b_id, distance, rank).

    ``anchors`` defaults to all facts; their own status does not matter. Facts
    without a predicate take no part.
    """
    active, columns = F.col("status") == "active", ["predicate_id", F.col("document_id").alias("owner"), "embedding"]
    facts = facts.filter(F.col("predicate_id").isNotNull())
    if anchors is None:
        # Read once for both sides.
        offers = F.coalesce(active, F.lit(False)).alias("offers")
        return _pairs(nearest_within(facts.select(F.col("fact_id").alias("id"), *columns, F.lit(True).alias("asks"), offers), k, ["predicate_id"]))
    asked = anchors.filter(F.col("predicate_id").isNotNull()).select(F.col("fact_id").alias("anchor_id"), *columns)
    # A few arriving anchors touch only the facts of their predicates.
    pool = facts.filter(active).select(F.col("fact_id").alias("candidate_id"), *columns).join(asked.select("predicate_id").distinct(), "predicate_id", "left_semi")
    return _pairs(nearest_in_groups(asked, pool, k, group=["predicate_id"]))


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("anchor_id").alias("fact_a_id"), F.col("candidate_id").alias("fact_b_id"), "distance", "rank"
    )


def pair_key() -> tuple[Column, Column]:
    return F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once, as its first anchor saw it. Anchors are taken
    in id order, so that is the pair with the smaller id in front if both
    directions are there."""
    return _by_ends(pairs).select("p.fact_a_id", "p.fact_b_id")


def _by_ends(pairs: DataFrame) -> DataFrame:
    low, high = pair_key()
    return pairs.filter(F.col("fact_a_id") != F.col("fact_b_id")).groupBy(low.alias("_low"), high.alias("_high")).agg(
        F.min(F.struct("fact_a_id", "fact_b_id")).alias("p")
    )


def _known(stored: DataFrame) -> DataFrame:
    low, high = pair_key()
    return stored.select(low.alias("_low"), high.alias("_high")).distinct()


def new_pairs(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs without a stored relationship, in either direction. Applied after
    the top ``k``: known pairs have used up their places."""
    low, high = pair_key()
    return pairs.withColumn("_low", low).withColumn("_high", high).join(_known(stored), ["_low", "_high"], "left_anti").drop("_low", "_high")


def reasoning_context(
    pairs: DataFrame, facts: DataFrame, evidence: DataFrame, documents: DataFrame, entities: DataFrame, predicates: DataFrame
) -> DataFrame:
    """Both sides of each pair with names, values, periods and first quotes. A
    pair is skipped when a side has no evidence."""
    names = entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))
    metrics = predicates.select("predicate_id", F.col("canonical_name").alias("predicate"))
    # Only facts of some pair are looked up.
    used = pairs.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id")).distinct()
    side = (
        facts.select("fact_id", "document_id", "subject_entity_id", "predicate_id", "value_raw", "time_value", "scope")
        .join(used, "fact_id", "left_semi")
        .join(first_evidence(evidence.join(used, "fact_id", "left_semi")).select("fact_id", "quote"), "fact_id")
        .join(documents.select("document_id", "filename"), "document_id", "left")
        .join(names, "subject_entity_id", "left")
        .join(metrics, "predicate_id", "left")
        .select(
            "fact_id", "value_raw", "time_value", "scope", "quote",
            F.coalesce("filename", F.lit("")).alias("filename"),
            F.coalesce("subject", F.lit("unknown")).alias("subject"),
            F.coalesce("predicate", F.lit("unknown")).alias("predicate"),
            values.normalize_value(F.col("value_raw")).alias("value"),
            values.normalize_period(F.col("time_value")).alias("period"),
        )
    )
    # Both ends of the pairs read it.
    side = materialize(side, "sides")

    def named(letter: str) -> DataFrame:
        return side.select(
            F.col("fact_id").alias(f"fact_{letter}_id"),
            *[F.col(c).alias(f"{letter}_{c}") for c in side.columns if c != "fact_id"],
        )

    return pairs.join(named("a"), "fact_a_id").join(named("b"), "fact_b_id")


def classify_pairs(context: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Default classifier: the first rule that applies decides.

    1. other subject or metric: UNRELATED
    2. no number on a side, or numbers of different kinds: UNCERTAIN
    3. equal amounts, equal periods: UNIT_DIFFERENCE if written in different
       units, else CORROBORATES
    4. both scopes given and different: SCOPE_DIFFERENCE
    5. one period lies within the other: RECONCILES
    6. equal periods, exactly one quote speaks of a revision: TEMPORAL_UPDATE
    7. equal periods: CONTRADICTS
    8. a period is missing: POTENTIAL_CONTRADICTION
    9. otherwise the periods differ: RECONCILES
    """
    a, b = F.col("a_value.amount"), F.col("b_value.amount")
    kind_a = F.coalesce("a_value.currency", F.when(F.col("a_value.unit") == "%", "%"), F.lit("count"))
    kind_b = F.coalesce("b_value.currency", F.when(F.col("b_value.unit") == "%", "%"), F.lit("count"))
    a_start, a_end, b_start, b_end = (F.col(c) for c in ("a_period.start", "a_period.end", "b_period.start", "b_period.end"))
    close = F.abs(a - b).cast("double") <= F.greatest(F.abs(a), F.abs(b)).cast("double") * tolerance
    dated = a_start.isNotNull() & b_start.isNotNull()
    undated = a_start.isNull() & b_start.isNull()
    same_period = (dated & (a_start == b_start) & (a_end == b_end)) | undated
    within = dated & (((a_start <= b_start) & (b_end <= a_end)) | ((b_start <= a_start) & (a_end <= b_end)))
    revision = F.col("a_quote").rlike(REVISION) != F.col("b_quote").rlike(REVISION)
    label = (
        F.when((F.lower("a_subject") != F.lower("b_subject")) | (F.col("a_predicate") != F.col("b_predicate")), "UNRELATED")
        .when(a.isNull() | b.isNull() | (kind_a != kind_b), "UNCERTAIN")
        .when(close & same_period & ~F.col("a_value.unit").eqNullSafe(F.col("b_value.unit")), "UNIT_DIFFERENCE")
        .when(close & same_period, "CORROBORATES")
        .when(F.col("a_scope") != F.col("b_scope"), "SCOPE_DIFFERENCE")
        .when(within & ~same_period, "RECONCILES")
        .when(dated & same_period & revision, "TEMPORAL_UPDATE")
        .when(dated & same_period, "CONTRADICTS")
        .when(~dated, "POTENTIAL_CONTRADICTION")
        .otherwise("RECONCILES")
    )
    explanation = F.format_string(
        "%s (%s, %s) against %s (%s, %s)",
        "a_value_raw", F.coalesce("a_time_value", F.lit("no period")), "a_filename",
        "b_value_raw", F.coalesce("b_time_value", F.lit("no period")), "b_filename",
    )
    sure = F.when(F.col("relationship_type").isin("UNCERTAIN", "POTENTIAL_CONTRADICTION"), 0.5).otherwise(0.9)
    return context.withColumn("relationship_type", label).withColumn("explanation", explanation).withColumn(
        "confidence", sure.cast("float")
    )


def storable(judged: DataFrame) -> DataFrame:
    """Guards the labels of any classifier and drops unrelated pairs."""
    return judged.withColumn("relationship_type", labels.guard_label(F.col("relationship_type"))).withColumn(
        "confidence", labels.guard_confidence(F.col("confidence"))
    ).filter(F.col("relationship_type") != "UNRELATED")


def insert_relationships(judged: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append: storable pairs that are not stored in either direction,
    each once. Of several judgements of a pair the one with the smaller id in front stays, then the least."""
    low, high = pair_key()
    row = F.struct("fact_a_id", "fact_b_id", "relationship_type", "explanation", "confidence")
    each = new_pairs(storable(judged), stored).groupBy(low.alias("low"), high.alias("high")).agg(F.min(row).alias("r"))
    return each.select("r.*", F.current_timestamp().alias("created_at"))


def candidate_pairs(facts: DataFrame, stored: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Pairs to be judged. They are looked at several times from here on, so
    they are written once rather than searched for each time."""
    # Grouped and compared by the same two ends, so that they are sent once.
    pairs = _by_ends(related_facts(facts, anchors)).join(_known(stored), ["_low", "_high"], "left_anti")
    return materialize(pairs.select("p.fact_a_id", "p.fact_b_id"), "pairs")


def reason(
    facts: DataFrame, evidence: DataFrame, documents: DataFrame, entities: DataFrame, predicates: DataFrame,
    stored: DataFrame, anchors: DataFrame | None = None, classify=classify_pairs,
) -> DataFrame:
    """New relationships of the anchors (default: every active fact)."""
    # Only active facts are found, so without others they are the anchors, too.
    pairs = candidate_pairs(facts.filter(F.col("status") == "active") if anchors is None else facts, stored, anchors)
    return insert_relationships(
        classify(reasoning_context(pairs, facts, evidence, documents, entities, predicates)), stored
    )
