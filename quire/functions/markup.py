"""HTML columns: block-aware text, spoken pieces, places in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.texts import decode_named

MAX_UTTERANCE = 280
STOPS, CLOSERS = ".!?…", "\"'”’)\\]"


def block_text(html: Column) -> Column:
    """Text with lines for blocks, bullets for list items, and at most one blank line."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", "")
    text = F.regexp_replace(text, "(?i)<li\\b[^>]*>", "\n• ")
    text = F.regexp_replace(text, "(?i)<br\\s*/?>", "\n")
    text = F.regexp_replace(text, "(?i)</(?:p|div|h[1-6]|blockquote|pre|ul|ol|table|section|figure)>", "\n\n")
    text = decode_named(F.regexp_replace(text, "<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), " ?\\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\n+|\\n+$", ""))


def spoken(text: Column, most: int = MAX_UTTERANCE) -> Column:
    """Sentences packed into pieces of at most ``most`` characters; a longer sentence is broken between words."""
    clean = F.trim(F.regexp_replace(text, "\\s+", " "))
    # a sentence ends at a blank after a stop, which quotes and brackets may follow
    sentences = F.transform(F.split(clean, f"(?<=[{STOPS}][{CLOSERS}]{{0,3}}) ", -1), lambda s: F.concat(s, F.lit(" ")))
    words = lambda s: F.regexp_extract_all(s, F.lit("\\S+\\s*|\\s+"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def pack(state: Column, unit: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(unit) > most)
        done = F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, unit).otherwise(F.concat(state["now"], unit)).alias("now"))

    def packed(units: Column) -> Column:
        return F.aggregate(units, start, pack, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))

    units = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > most, packed(words(s))).otherwise(F.array(s))))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(packed(units), lambda p: F.trim(p)), lambda p: p != ""))


def locate(text: Column, quote: Column) -> Column:
    """First character (from 0) of a quotation in a text, white space and case aside; null if it is not there.

    Found in the squeezed text, then carried back: the place is that of the non-blank character with the same number.
    """
    squeeze = lambda c: F.lower(F.regexp_replace(c, "\\s+", ""))
    at = F.instr(squeeze(text), squeeze(quote)) - 1
    places = F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("\\S"), i)))
    return F.when((at >= 0) & (squeeze(quote) != ""), F.get(places, at))


def minutes_left(count: Column, progress: Column, per_minute: int = 230) -> Column:
    """Minutes of reading that are left, at least one until the end."""
    return F.when(progress >= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(count * (1 - progress) / per_minute))).cast("long")


def percent(progress: Column) -> Column:
    return F.concat(F.round(progress * 100).cast("int").cast("string"), F.lit("%"))


def token_hash(token: Column) -> Column:
    return F.sha2(token.cast("binary"), 256)
