"""Documents and pages: fingerprint, duplicates, page extraction, key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrace.functions import text as tx

# The density unit (square pixels) and the scan threshold.
DENSITY_AREA = 10_000.0
MIN_WORD_DENSITY = 0.6


def fingerprint(content: Column) -> Column:
    """SHA-256 of bytes or text, in hex."""
    return F.sha2(content.cast("binary"), 256)


def fingerprint_documents(df: DataFrame, content: str, mime: str = "application/pdf") -> DataFrame:
    """Adds ``sha256``, ``n_bytes``, ``mime_type``; empty content is rejected."""
    return (
        df.filter(F.octet_length(content) > 0)
        .withColumn("sha256", fingerprint(F.col(content)))
        .withColumn("n_bytes", F.octet_length(content))
        .withColumn("mime_type", F.lit(mime))
    )


def dedupe_documents(new: DataFrame, existing: DataFrame | None = None, arrival: str = "arrival") -> DataFrame:
    """Every arriving document with the id that stands for its content.

    ``new`` has (document_id, sha256, arrival); ``existing`` has (document_id,
    sha256), unique by sha256. A stored document wins over a new one, and among
    new ones the earliest wins. Adds ``canonical_id`` and ``deduplicated``.

    The winner is found by a grouped ``min_by``, which combines before the
    shuffle, so a text that makes up much of the corpus costs one row per map
    task. Only (id, sha) pairs meet again in the join, never the content.
    """
    first = new.groupBy("sha256").agg(
        F.min_by("document_id", F.struct(arrival, "document_id")).alias("first_id")
    )
    if existing is None:
        winners = first.select("sha256", F.col("first_id").alias("canonical_id"))
    else:
        known = existing.select("sha256", F.col("document_id").alias("known_id"))
        winners = first.join(known, "sha256", "left").select(
            "sha256", F.coalesce("known_id", "first_id").alias("canonical_id")
        )
    return new.join(winners, "sha256").withColumn(
        "deduplicated", F.col("document_id") != F.col("canonical_id")
    )


def new_documents(deduped: DataFrame) -> DataFrame:
    """The rows of ``dedupe_documents`` that must be inserted."""
    return deduped.filter(~F.col("deduplicated")).drop("canonical_id", "deduplicated")


def document_rows(df: DataFrame) -> DataFrame:
    """Insert defaults for (document_id, filename, sha256, mime_type)."""
    return df.select(
        "document_id", "filename", "sha256", "mime_type",
        F.lit(None).cast("int").alias("page_count"),
        F.lit("uploaded").alias("status"),
        F.current_timestamp().alias("uploaded_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
    )


def looks_like_scan(native: Column, area: Column) -> Column:
    """Few words for the size of the page."""
    density = tx.word_count(native) / (F.greatest(area.cast("double"), F.lit(1.0)) / DENSITY_AREA)
    return density < MIN_WORD_DENSITY


def ocr_confidence(word_confidences: Column) -> Column:
    """Mean of the non-negative word confidences, scaled to 0..1; NULL if none."""
    valid = F.filter(word_confidences, lambda c: c >= 0)
    total = F.aggregate(valid, F.lit(0.0), lambda acc, c: acc + c.cast("double"))
    return F.when(F.size(valid) > 0, total / F.size(valid) / 100.0)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Chooses the text of each page.

    Input: document_id, page_number, native_text, area, and optionally ocr_text
    and ocr_words (array of word confidences, -1 for non-words). A page that
    looks like a scan takes the OCR text if there is any; otherwise its native
    text; a page with neither is ``failed`` with empty text.
    """
    have_ocr = {"ocr_text", "ocr_words"} <= set(pages.columns)
    ocr = F.col("ocr_text") if have_ocr else F.lit(None).cast("string")
    words = F.col("ocr_words") if have_ocr else F.lit(None).cast("array<double>")
    scan = looks_like_scan(F.col("native_text"), F.col("area"))
    method = (
        F.when(scan & ~tx.is_blank(ocr), "ocr")
        .when(~scan | ~tx.is_blank(F.col("native_text")), "native")
        .otherwise("failed")
    )
    return pages.withColumn("extraction_method", method).select(
        "document_id", "page_number", "extraction_method",
        F.when(F.col("extraction_method") == "ocr", ocr)
        .when(F.col("extraction_method") == "native", F.col("native_text"))
        .otherwise("").alias("text"),
        F.when(F.col("extraction_method") == "ocr", ocr_confidence(words)).cast("float").alias("confidence"),
    )


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Keys that break the (document, page) uniqueness, with their row counts."""
    return (
        pages.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def running_totals(df: DataFrame, key: str, order: str, values: dict[str, Column], span: int = 1024) -> DataFrame:
    """Adds each name in ``values``: the sum of its column over the earlier
    rows of ``key``.

    ``order`` is a dense number, so ``order div span`` cuts a huge key into
    bounded pieces: each piece is summed on its own, then the few piece totals
    are summed per key, and the two parts are added.
    """
    piece = F.floor(F.col(order) / span).alias("_piece")
    earlier = (Window.unboundedPreceding, -1)
    totals = df.select(key, piece, *[v.alias(n) for n, v in values.items()]).groupBy(key, "_piece").agg(
        *[F.sum(n).alias(n) for n in values]
    )
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(*earlier)
    base = totals.select(
        key, "_piece", *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(f"_base_{n}") for n in values]
    )
    inside = Window.partitionBy(key, "_piece").orderBy(order).rowsBetween(*earlier)
    placed = df.withColumn("_piece", piece).withColumns(
        {f"_in_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)).cast("long") for n, v in values.items()}
    )
    return placed.join(base, [key, "_piece"]).withColumns(
        {n: F.col(f"_base_{n}") + F.col(f"_in_{n}") for n in values}
    ).drop("_piece", *[f"_base_{n}" for n in values], *[f"_in_{n}" for n in values])
