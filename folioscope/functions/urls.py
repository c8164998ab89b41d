"""URL functions, all native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import values as V
from folioscope.functions.text import as_column, find_all, let, rstrip, strip

_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(c, group: int) -> Column:
    return F.regexp_extract(as_column(c), _PARTS, group)


def host(c) -> Column:
    """The lower-case host name, without user and port; empty when there is none."""
    name = F.regexp_replace(_part(c, 2), r"^.*@", "")
    return F.lower(F.regexp_replace(name, r":\d*$", ""))


def in_domain(host_name: Column, domain: str) -> Column:
    return (host_name == domain) | host_name.endswith("." + domain)


def is_url(c) -> Column:
    c = as_column(c)
    return c.rlike(r"(?i)^https?://[^/?#]") & ~c.rlike(r"\s")


def post_url(c) -> Column:
    """The one address of a shared social post, from its id; NULL for anything else."""
    path = _part(c, 3)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    shape = r"^/(?:posts/[^/]*-(activity|share)-|feed/update/urn:li:(activity|share):)(\d+)(?:[-/]|$)"
    kind = F.concat(F.regexp_extract(path, shape, 1), F.regexp_extract(path, shape, 2))
    number = F.regexp_extract(path, shape, 3)
    address = F.concat(F.lit("https://www.linkedin.com/feed/update/urn:li:"), kind, F.lit(":"), number)
    return F.when(in_domain(host(c), "linkedin.com") & (number != ""), address)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(c) -> Column:
    """One form per address: no fragment, tracking parameters or trailing slash, sorted query."""
    c = as_column(c)
    pairs = F.transform(
        F.filter(F.split(_part(c, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(
        pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*V.TRACKING_PARAMS))
    )
    query = F.array_join(
        F.transform(F.sort_array(kept), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&"
    )
    path = F.rtrim(F.regexp_replace(_part(c, 3), r";[^/]*$", ""), F.lit("/"))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    web = F.concat(F.lower(_part(c, 1)), F.lit("://"), F.lower(_part(c, 2)), path, tail)
    return F.when(~c.rlike(r"(?i)^https?://"), c).otherwise(F.coalesce(post_url(c), web))


def urls_in(c, max_chars: int | None = None) -> Column:
    """Every http(s) address shown in the text, in order and without repeats; `max_chars` leaves longer ones out."""
    found = F.transform(
        find_all(c, r"https?://[^\s<>\"')\]]+"), lambda u: F.rtrim(u, F.lit(".,;:!?"))
    )
    return F.array_distinct(
        F.filter(found, lambda u: (host(u) != "") if max_chars is None else (F.length(u) <= max_chars) & (host(u) != ""))
    )


def article_links(c) -> Column:
    """`urls_in` minus housekeeping links, pictures and tracking redirects."""

    def wanted(url):
        redirect = (F.size(F.split(host(url), r"\.")) >= 3) & F.regexp_extract(host(url), r"^([^.]*)", 1).isin(
            *V.REDIRECT_HOST_LABELS
        )
        return ~url.rlike(V.NOT_AN_ARTICLE) & ~redirect & ~in_domain(host(url), "list-manage.com")

    return F.filter(urls_in(c), wanted)


def plain_address(c) -> Column:
    """A source address that cannot break out of a link, or NULL."""
    text = strip(c)
    safe = F.replace(F.replace(text, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.when(text.rlike(r'^(?:https?://[^\s<>"]+|mail:[\p{L}\p{N}_.@+=-]+)$'), safe)


def with_scheme(c) -> Column:
    """`site.org/page` pasted from an app, read as https; file names stay as they are."""
    c = as_column(c)
    bare = c.rlike(r"(?i)^[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*\.[a-z]{2,}/")
    first = F.lower(F.regexp_extract(c, "^([^/]*)", 1))
    is_file = F.lit(False)
    for suffix in V.FILE_SUFFIXES:
        is_file = is_file | first.endswith(suffix)
    return F.when(~is_url(c) & bare & ~is_file, F.concat(F.lit("https://"), c)).otherwise(c)


def absolute_url(base, ref) -> Column:
    """`ref` as seen from the page `base` (the forms that occur in page markup)."""
    base, ref = as_column(base), as_column(ref)
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .otherwise(F.concat(folder, F.regexp_replace(ref, r"^(?:\./)+", "")))
    )
    return joined


__all__ = [
    "absolute_url", "article_links", "host", "in_domain", "is_url", "let", "normalize_url",
    "plain_address", "post_url", "rstrip", "urls_in", "with_scheme",
]
