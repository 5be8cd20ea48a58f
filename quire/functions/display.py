"""Display and identifier columns: titles, tones, relative days, slugs, sortable ids, answers of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.urls import PARTS, canonical

# The digits of sortable ids, and the tones of links without an image.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
TONES = ("#C8D6D3", "#D0DBE2", "#CCDCD4", "#D7D6E3", "#D4DECB", "#DDD6CC")
DROP_CAP_CHARS = 90


def site(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), "^www\\.", "")


def shown_title(title: Column, url: Column) -> Column:
    """The title, else host and path."""
    path = F.regexp_extract(url, PARTS, 4)
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.concat(site(url), F.when(path == "/", F.lit("")).otherwise(path)))


def tone(key: Column) -> Column:
    """One of six tones by a 32-bit hash with multiplier 31 over the key's characters."""
    codes = F.transform(F.split(key, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("long"))
    hashed = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.element_at(F.array(*map(F.lit, TONES)), (hashed % len(TONES) + 1).cast("int"))


def chosen_canonical(url: Column, claimed: Column) -> Column:
    """A page's own canonical URL counts only on the same site, and not "/" for a deeper page."""
    path = lambda c: F.regexp_extract(c, PARTS, 4)
    trusted = (site(claimed) == site(url)) & ~(path(claimed).isin("", "/") & ~path(url).isin("", "/"))
    return canonical(F.when(F.coalesce(trusted, F.lit(False)), claimed).otherwise(url))


def sortable_time(millis: Column) -> Column:
    """The first ten characters of a sortable id: 48 bits of time in base 32, most significant first."""
    digit = lambda k: F.substring(F.lit(DIGITS), (F.shiftright(millis, 45 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(10)])


def time_of(sortable: Column) -> Column:
    """Milliseconds of a sortable id; null where a character is no digit."""
    places = F.transform(F.split(F.upper(F.substring(sortable, 1, 10)), ""), lambda c: F.instr(F.lit(DIGITS), c) - 1)
    real = F.filter(F.zip_with(places, F.split(F.substring(sortable, 1, 10), ""), lambda p, c: F.when(c != "", p)), lambda p: p.isNotNull())
    value = F.aggregate(real, F.lit(0).cast("long"), lambda t, p: t * 32 + p)
    return F.when(F.forall(real, lambda p: p >= 0), value)


def slug(name: Column) -> Column:
    """Lower-case letters, digits and dashes, at most 40; accents of Latin letters are folded."""
    plain = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, 40), "-+$", "")
    return F.when(cut == "", F.lit("category")).otherwise(cut)


def yes_chance(answers: Column, name: str) -> Column:
    """The chance in a model's JSON answer: a bare number or one under a key; outside [0, 1] or unreadable it is null."""
    value = F.coalesce(*[F.get_json_object(answers, f"$.{head}answers.{name}{tail}").try_cast("double") for head in ("result.", "") for tail in ("", ".noul", ".probability")])
    return F.when((value >= 0) & (value <= 1), value)
