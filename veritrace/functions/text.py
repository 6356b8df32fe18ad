"""Text expressions: whitespace, tokens, snippets, markup, encoding repair."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode whitespace set, as a regex character class body.
WS_CHARS = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"

# Words-to-tokens factor and chunk budget.
TOKENS_PER_WORD = 1.3
MAX_CHUNK_TOKENS = 900

# A blank line (possibly several) between two paragraphs.
PARAGRAPH_SEP = rf"\n{WS}*\n+"

SNIPPET_BYTES = 500
ELLIPSIS = "…"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NON_WS}+"))


def token_estimate(text: Column) -> Column:
    """At least 1; halves round to even."""
    return tokens_of(word_count(F.coalesce(text, F.lit(""))))


def tokens_of(words: Column) -> Column:
    """The estimate for a text of so many words."""
    return F.greatest(F.lit(1), F.bround(words * F.lit(TOKENS_PER_WORD)).cast("int"))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NON_WS)


def collapse_ws(text: Column) -> Column:
    """Trim, and turn every run of whitespace into one space."""
    return strip_ws(F.regexp_replace(text, f"{WS}+", " "))


def normalized_key(name: Column) -> Column:
    return F.lower(collapse_ws(name))


def strip_markup(html: Column) -> Column:
    """Visible text of a web page: scripts, styles and tags become blanks."""
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")


def snippet(text: Column, max_bytes: int = SNIPPET_BYTES) -> Column:
    """The longest prefix of at most ``max_bytes`` UTF-8 bytes that ends on a
    character boundary, followed by an ellipsis when something was cut.

    A UTF-8 continuation byte is 80..BF. If the byte after the cut is one, the
    cut falls inside a character and moves back; a character has at most three
    continuation bytes.
    """
    raw = F.encode(text, "UTF-8")

    def inside(n: int) -> Column:
        return F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")

    cut = (
        F.when(~inside(max_bytes), max_bytes)
        .when(~inside(max_bytes - 1), max_bytes - 1)
        .when(~inside(max_bytes - 2), max_bytes - 2)
        .otherwise(max_bytes - 3)
    )
    shortened = F.decode(raw.substr(F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) > max_bytes, F.concat(shortened, F.lit(ELLIPSIS))).otherwise(text)


# The printable characters that Windows-1252 puts at bytes 80..9F
# (the five unassigned bytes are left out), and those bytes as code points.
CP1252_SPECIALS = (
    "€‚ƒ„…†‡ˆ‰Š‹ŒŽ"
    "‘’“”•–—˜™š›œžŸ"
)
CP1252_BYTES = "".join(
    chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
)


def repair_encoding(text: Column) -> Column:
    """Undo UTF-8 text that was once decoded as Windows-1252.

    The characters are mapped back to the bytes they came from; if those bytes
    form valid UTF-8 the decoded text is the original, otherwise the text was
    not damaged in this way and stays as it is. Plain ASCII is untouched.
    """
    as_bytes = F.encode(F.translate(text, CP1252_SPECIALS, CP1252_BYTES), "ISO-8859-1")
    decodable = ~F.translate(text, CP1252_SPECIALS, CP1252_BYTES).rlike(r"[^\x00-\xff]")
    candidate = F.when(decodable & text.rlike(r"[^\x00-\x7f]"), F.try_validate_utf8(as_bytes.cast("string")))
    return F.coalesce(candidate, text)


def damage_encoding(text: Column) -> Column:
    """The opposite of ``repair_encoding``; used to make test input."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, CP1252_BYTES, CP1252_SPECIALS)


def contains_literal(column: Column, term: str) -> Column:
    """Case-insensitive substring test; NULL is no match and ``%`` is literal."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(term))), F.lit(False))
