"""The predicate ontology: lookup by name or alias, and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritrace.schemas import natural_id


def predicate_names(predicates: DataFrame) -> DataFrame:
    """Every name a predicate answers to, each name once: (name, predicate_id).

    A canonical name wins over an alias, then the smaller id. Names as rows
    make the lookup an equi-join; an OR over the alias array would not be one.
    """
    rows = predicates.select(
        "predicate_id", F.explode(
            F.concat(
                F.array(F.struct(F.col("canonical_name").alias("name"), F.lit(0).alias("is_alias"))),
                F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(a.alias("name"), F.lit(1).alias("is_alias"))),
            )
        ).alias("n"),
    ).select("predicate_id", "n.*")
    return rows.groupBy("name").agg(F.min_by("predicate_id", F.struct("is_alias", "predicate_id")).alias("predicate_id"))


def lookup_predicates(rows: DataFrame, predicates: DataFrame, name: str = "predicate") -> DataFrame:
    """Adds ``predicate_id``, NULL where no predicate has the name."""
    return rows.join(predicate_names(predicates).withColumnRenamed("name", name), name, "left")


def grow_ontology(rows: DataFrame, predicates: DataFrame, name: str = "predicate") -> DataFrame:
    """Predicates to insert: names that no predicate answers to, once each.
    Running it again after the insert gives no rows."""
    known = predicate_names(predicates).select(F.col("name").alias(name))
    return rows.select(name).distinct().join(known, name, "left_anti").select(
        natural_id(F.lit("predicate"), name).alias("predicate_id"),
        F.col(name).alias("canonical_name"),
        F.expr("cast(array() as array<string>)").alias("aliases"),
        F.lit("numeric").alias("value_type"), F.lit(None).cast("string").alias("unit_class"),
    )


def list_predicates(predicates: DataFrame) -> DataFrame:
    return predicates.orderBy("canonical_name")
