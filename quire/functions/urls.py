"""URL columns: parsing, canonical form, host, display title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a click came from (besides those that start with utm_).
TRACKING = "fbclid gclid dclid msclkid mc_cid mc_eid igshid ref ref_src ref_url _hsenc _hsmi mkt_tok yclid si".split()

PARTS = r"^(?i:(https?)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"


def web_url(value: Column) -> Column:
    """The trimmed URL with a scheme, or null unless it is http(s) with a dotted host or localhost."""
    trimmed = F.trim(value)
    schemed = F.when(trimmed.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    host = F.regexp_extract(schemed, PARTS, 2)
    good = schemed.rlike("^(?i)https?://[^\\s]+$") & (F.contains(host, F.lit(".")) | (F.lower(host) == "localhost"))
    return F.when(good, schemed)


def canonical(url: Column) -> Column:
    """https, lower-case host without www., no default port, fragment, credentials or tracking parameters; sorted parameters."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, PARTS, 2)), "^www\\.", "")
    port = F.regexp_extract(url, PARTS, 3)
    shown_port = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(url, PARTS, 4)
    shown_path = F.when(F.length(path) <= 1, F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(F.regexp_extract(url, PARTS, 5), "&"), lambda p: (p != "") & ~_tracks(F.lower(F.substring_index(p, "=", 1))))
    # array_sort of (key, place, pair) is a stable sort by key
    keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(keyed, lambda s: F.when(F.contains(s["p"], F.lit("=")), s["p"]).otherwise(F.concat(s["p"], F.lit("=")))), "&")
    return F.concat(F.lit("https://"), host, shown_port, shown_path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _tracks(key: Column) -> Column:
    return F.startswith(key, F.lit("utm_")) | key.isin(*TRACKING)


def host(canonical_url: Column) -> Column:
    """The host (with any port) of a canonical URL."""
    return F.regexp_extract(canonical_url, "^https://([^/]+)/", 1)


def canonical_sql(url: str) -> str:
    """The same canonical form as DuckDB SQL."""
    part = lambda k: f"regexp_extract({url}, '{PARTS.replace('(?i:(https?)://)', '([hH][tT][tT][pP][sS]?://)')}', {k})"
    names = ", ".join(f"'{t}'" for t in TRACKING)
    pairs = f"list_filter(string_split({part(5)}, '&'), lambda p: p <> '' and not (starts_with(lower(split_part(p, '=', 1)), 'utm_') or lower(split_part(p, '=', 1)) in ({names})))"
    keyed = f"list_sort(list_transform({pairs}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}}))"
    query = f"coalesce(array_to_string(list_transform({keyed}, lambda s: case when contains(s.p, '=') then s.p else s.p || '=' end), '&'), '')"
    path = f"case when length({part(4)}) <= 1 then '/' else regexp_replace({part(4)}, '/+$', '') end"
    port = f"case when {part(3)} in ('', '80', '443') then '' else ':' || {part(3)} end"
    tail = f"case when {query} = '' then '' else '?' || {query} end"
    return f"('https://' || regexp_replace(lower({part(2)}), '^www\\.', '') || {port} || {path} || {tail})"
