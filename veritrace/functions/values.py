"""Normal forms of values and periods found in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Scale words with their factors.
SCALES = {
    "thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000,
    "billion": 1_000_000_000, "trillion": 1_000_000_000_000,
}
# How each scale is written.
SCALE_WORDS = {
    "thousand": "thousand|k", "lakh": "lakhs?|lacs?", "million": "million|mn|m", "crore": "crores?|cr",
    "billion": "billion|bn", "trillion": "trillion|tn",
}
# How each currency is written.
CURRENCIES = {
    "INR": r"₹|\brs\b|\binr\b", "USD": r"\$|\busd\b", "EUR": r"€|\beur\b", "GBP": r"£|\bgbp\b",
}

NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body
    names it. Keeps nested pattern matches out of the generated code, where
    they would be repeated at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def _choose(text: Column, patterns: dict[str, str]) -> Column:
    """Name of the first pattern found in the text."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def normalize_value(raw: Column) -> Column:
    """struct(amount, unit, currency); NULL when the text holds no number.

    The amount is in base units, so "840 crore" and "8.4 billion" are equal.
    ``unit`` is the scale word, "%", or the word after the number.
    """
    factors = F.create_map(*[x for n, f in SCALES.items() for x in (F.lit(n), F.lit(f).cast("decimal(13,0)"))])
    scale_words = {name: f"^({words})$" for name, words in SCALE_WORDS.items()}
    found = let(
        F.lower(raw),
        lambda text: F.struct(
            F.regexp_replace(F.regexp_extract(text, f"({NUMBER})", 1), ",", "").try_cast("decimal(20,6)").alias("number"),
            F.regexp_extract(text, rf"{NUMBER}\s*(%|[a-z]+)?", 1).alias("word"),
            _choose(text, CURRENCIES).alias("currency"),
            text.rlike(r"[0-9]\s*per cent").alias("per_cent"),
        ),
    )
    scaled = let(
        found,
        lambda f: F.struct(
            f["number"].alias("number"), f["word"].alias("word"), f["currency"].alias("currency"),
            _choose(f["word"], scale_words).alias("scale"),
            (f["per_cent"] | f["word"].isin("%", "percent", "pct")).alias("percent"),
        ),
    )
    return let(
        scaled,
        lambda f: F.when(
            f["number"].isNotNull(),
            F.struct(
                (f["number"] * F.coalesce(F.try_element_at(factors, f["scale"]), F.lit(1).cast("decimal(13,0)")))
                .cast("decimal(38,6)").alias("amount"),
                F.when(f["percent"], "%").otherwise(F.coalesce(f["scale"], F.nullif(f["word"], F.lit("")))).alias("unit"),
                f["currency"].alias("currency"),
            ),
        ),
    )


# Patterns for lower-cased text.
FISCAL = r"(?:\bfy|\bfinancial year|\bfiscal year|\bfiscal)\s*'?([0-9]{4}|[0-9]{2})(?:\s*[-–/]\s*([0-9]{4}|[0-9]{2}))?\b"
QUARTER = r"\bq([1-4])\b"
DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
DATE_RANGE = rf"{DATE}\s*(?:to|–|until)\s*{DATE}"
CALENDAR = r"^\s*(?:cy\s*|calendar year\s*)?([0-9]{4})\s*$"
CALENDAR_QUARTER = r"\bq[1-4]\s+([0-9]{4})\b"


def _full_year(digits: Column) -> Column:
    """Two digits below 70 are of this century."""
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 4, n).when(n < 70, n + 2000).otherwise(n + 1900)


def normalize_period(raw: Column, fiscal_start_month: int = 4) -> Column:
    """struct(time_type, start, end), both days inclusive.

    A fiscal year is named after the calendar year it ends in: with an April
    start, FY2025 runs from 2024-04-01 to 2025-03-31.
    """
    m = fiscal_start_month

    # A pattern is tried only where a character it needs is there.
    def part(text: Column, needs: str, pattern: str, group: int = 1) -> Column:
        return F.when(F.contains(text, F.lit(needs)), F.nullif(F.regexp_extract(text, pattern, group), F.lit("")))

    def fiscal(text: Column) -> Column:
        year = F.coalesce(part(text, "f", FISCAL, 2), part(text, "f", FISCAL, 1))
        return let(year, lambda y: F.make_date(_full_year(y) - (1 if m > 1 else 0), F.lit(m), F.lit(1)))

    found = let(
        F.lower(raw),
        lambda text: F.struct(
            fiscal(text).alias("fiscal"), part(text, "q", QUARTER).try_cast("int").alias("quarter"),
            part(text, "q", CALENDAR_QUARTER).try_cast("int").alias("quarter_year"),
            part(text, "-", DATE_RANGE, 1).try_cast("date").alias("d1"),
            part(text, "-", DATE_RANGE, 2).try_cast("date").alias("d2"),
            part(text, "-", DATE).try_cast("date").alias("day"),
            F.regexp_extract(text, CALENDAR, 1).try_cast("int").alias("year"),
        ),
    )
    nothing = F.lit(None).cast("date")

    def span(kind: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("time_type"), start.alias("start"), end.alias("end"))

    def months(kind: str, start: Column, count: int) -> Column:
        return span(kind, start, F.date_sub(F.add_months(start, count), 1))

    return let(
        found,
        lambda f: F.when(
            f["quarter"].isNotNull() & f["fiscal"].isNotNull(),
            months("quarter", F.add_months(f["fiscal"], (f["quarter"] - 1) * 3), 3),
        )
        .when(
            f["quarter_year"].isNotNull(),
            months("quarter", F.make_date(f["quarter_year"], (f["quarter"] - 1) * 3 + 1, F.lit(1)), 3),
        )
        .when(f["fiscal"].isNotNull(), months("fiscal_year", f["fiscal"], 12))
        .when(f["d1"].isNotNull() & f["d2"].isNotNull(), span("range", f["d1"], f["d2"]))
        .when(f["day"].isNotNull(), span("date", f["day"], f["day"]))
        .when(f["year"].isNotNull(), months("calendar_year", F.make_date(f["year"], F.lit(1), F.lit(1)), 12))
        .otherwise(span("unspecified", nothing, nothing)),
    )
