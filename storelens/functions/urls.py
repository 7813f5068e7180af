"""URL columns: keys under which events, pages and catalog rows meet."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NULL = lambda t="string": F.lit(None).cast(t)


def _path(x: Column) -> Column:
    """Path of an absolute or relative link, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(x, "[?#].*$", ""), "^(?i)[a-z][a-z0-9+.-]*:", "")
    return F.regexp_replace(bare, "^//[^/]*", "")


def param(x: Column, name: str) -> Column:
    """First value of a query parameter, percent-decoded; null when absent."""
    query = F.regexp_extract(x, "\\?([^#]*)", 1)
    hit = F.regexp_extract(F.concat(F.lit("&"), query), f"&{name}=([^&]*)", 1)
    present = F.concat(F.lit("&"), query).rlike(f"&{name}=")
    return F.when(present, F.coalesce(F.try_url_decode(hit), hit))


def decoded(x: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone; null when malformed."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def url_tail(x: Column) -> Column:
    """FN-04: the ``p`` or ``ItemID`` parameter, else the decoded last path segment, lower-case."""
    p = F.coalesce(param(x, "p"), param(x, "ItemID"))
    last = F.element_at(F.split(F.regexp_replace(_path(x), "/$", ""), "/"), -1)
    return F.coalesce(F.lower(F.when(p != "", p).otherwise(decoded(last))), F.lit(""))


def host(x: Column) -> Column:
    """Lower-case host of an absolute url, without port and user info."""
    h = F.regexp_extract(x, "^(?i)[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(h, "^.*@", ""), ":\\d*$", ""))


def bare_host(x: Column) -> Column:
    """FN-08: lower-case host name without ``www.``."""
    return F.regexp_replace(F.lower(x), "^www\\.", "")


def origin(x: Column) -> Column:
    """Scheme and authority of an absolute url, lower-case; null otherwise."""
    o = F.lower(F.regexp_extract(x, "^((?i)[a-z][a-z0-9+.-]*://[^/?#]+)", 1))
    return F.when(o != "", o)


def product_url_key(x: Column) -> Column:
    """FN-05: host without www plus decoded path without its trailing slash; http(s) only."""
    key = F.concat(bare_host(host(x)), F.regexp_replace(decoded(_path(x)), "/$", ""))
    return F.when(x.rlike("^(?i)https?://[^/?#]+"), key)


def path_key(href: Column, site: str) -> Column:
    """FN-06: a link on ``site`` as its lower-case path from ``/products/`` on; other hosts are null."""
    own = F.regexp_replace(F.lit(site.lower()), "^[a-z]+://(www\\.)?", "")
    there = F.regexp_replace(F.regexp_extract(F.lower(href), "^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1), "^www\\.", "")
    absolute = href.rlike("^(?i)([a-z][a-z0-9+.-]*:)?//")
    path = F.lower(F.regexp_replace(F.coalesce(decoded(_path(href)), _path(href)), "/+$", ""))
    at = F.instr(path, "/products/")
    key = F.nullif(F.when(at > 1, F.substring(path, at, F.length(path))).otherwise(path), F.lit(""))
    web = ~href.rlike("^(?i)(javascript|mailto|tel|data):")
    return F.when(web & (~absolute | (there == own)), key)


def first_capture(x: Column, pattern: str) -> Column:
    """First capture group when the pattern has one and it matched, else the whole match; empty without a match."""
    grouped = "(" in pattern.replace("\\(", "").replace("(?", "")
    whole = F.regexp_extract(x, pattern, 0)
    return F.coalesce(F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")), whole) if grouped else whole


def product_key(url: Column, pattern: str) -> Column:
    """FN-07: product key of a configured rule, tried on path and query first, then on the whole url."""
    p = "(?iu)" + pattern
    local = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^(?i)[a-z][a-z0-9+.-]*://[^/?]*", "")
    return F.coalesce(F.nullif(first_capture(local, p), F.lit("")), F.nullif(first_capture(url, p), F.lit("")))
