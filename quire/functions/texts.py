"""Text columns: word counts, reading time, tag stripping, summaries, tags, slugs, notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS_PER_MINUTE = 230
LONG_READ_WORDS = 1035
SUMMARY_CHARS = 400
MAX_TAGS, MAX_TAG_CHARS = 20, 40

# Named character references that feeds use.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "copy": "©", "amp": "&",
}


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))).cast("long")


def minutes(count: Column) -> Column:
    """Reading time: at least a minute; null when the length is null or 0."""
    return F.when(count > 0, F.greatest(F.lit(1), F.round(count / WORDS_PER_MINUTE))).cast("long")


def is_long(count: Column) -> Column:
    return count >= LONG_READ_WORDS


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_numeric(text: Column) -> Column:
    """Numeric references by their characters; those of no character stay, and an ampersand becomes a named reference."""
    pieces = F.regexp_extract_all(text, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});|[^&]+|&"), F.lit(0))

    def decoded(piece: Column) -> Column:
        digits = F.regexp_replace(piece, "^&#[xX]?|;$", "")
        code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.when(~piece.rlike("^&#.") | ~F.coalesce(real, F.lit(False)), piece).when(code == 38, "&amp;").otherwise(character(code))

    return F.when(F.contains(text, F.lit("&#")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def decode_named(text: Column) -> Column:
    """Numeric and named references by their characters; the ampersand last, so that nothing is decoded twice."""
    decoded = decode_numeric(text)
    for name, char in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Plain text: scripts and styles go, breaks and ends of blocks become spaces, tags go, spaces collapse."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " ")
    text = F.regexp_replace(text, "(?i)<br\\s*/?>|</(?:p|div|li|h[1-6])>", " ")
    return F.trim(F.regexp_replace(decode_named(F.regexp_replace(text, "<[^>]*>", "")), "\\s+", " "))


def strip_tags_sql(html: str) -> str:
    text = html
    for tag in ("script", "style"):
        text = f"regexp_replace({text}, '<{tag}\\b.*?</{tag}>', ' ', 'gis')"
    text = f"regexp_replace({text}, '<br\\s*/?>|</(?:p|div|li|h[1-6])>', ' ', 'gi')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES.items():
        text = f"""replace({text}, '&{name};', '{char.replace("'", "''")}')"""
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def summary(plain: Column) -> Column:
    """At most SUMMARY_CHARS characters, cut after a whole word and marked with an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(plain, 1, SUMMARY_CHARS), "\\s+\\S*$", ""), F.lit("…"))
    return F.when(plain == "", None).when(F.length(plain) > SUMMARY_CHARS, cut).otherwise(plain)


def first_words(text: Column, n: int) -> Column:
    """The first n words with single spaces, marked when there are more."""
    every = F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))
    head = F.array_join(F.slice(every, 1, n), " ")
    return F.when(F.size(every) > n, F.concat(head, F.lit(" …"))).otherwise(head)


def tags(value: Column) -> Column:
    """Tags in free text: split at spaces and commas, lower-cased, cleaned, distinct, the first MAX_TAGS."""
    raw = F.split(F.coalesce(value, F.lit("")), "[\\s,]+")
    clean = F.transform(raw, lambda t: F.substring(F.regexp_replace(F.lower(F.regexp_replace(t, "^#+", "")), "[^\\p{L}\\p{N}_-]+", ""), 1, MAX_TAG_CHARS))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, MAX_TAGS)


def merge_note(old: Column, new: Column) -> Column:
    """Append a note after a blank line, unless the old one already says it (case and spaces aside)."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    old, new = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    merged = F.when(new == "", old).when(old == "", new).when(F.contains(plain(old), plain(new)), old).otherwise(F.concat(old, F.lit("\n\n"), new))
    return F.when(merged != "", merged)


def csv_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where needed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)
