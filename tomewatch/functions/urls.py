"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and the pattern that cuts a URL into its parts.
TRACKING = ("fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga", "yclid", "ref", "ref_src", "ref_url")
PARTS = r"^(?:([^:/?#]+):)?(?:(//)([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
ROUTE = r"(?i)index\.php\?route=product(?:/|%2F)product&product_id=\d+"


def decoded(text: Column) -> Column:
    """Percent-decoded, ``+`` as a space; text with broken escapes stays."""
    return F.coalesce(F.try_url_decode(text), text)


def encoded(text: Column) -> Column:
    """Form encoding with ``~`` kept and ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, single slashes, no trailing slash, fragment or tracking parameters.

    Parameters keep their order and are encoded anew; the path keeps its letters as they are.
    """
    part = lambda k: F.regexp_extract(F.trim(url), PARTS, k)
    scheme, host = F.lower(part(1)), F.lower(part(3))
    path = F.regexp_replace(part(4), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    key = lambda p: decoded(F.substring_index(p, "=", 1))
    value = lambda p: F.when(p.contains("="), decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("")
    kept = F.filter(F.split(part(5), "&"), lambda p: (p != "") & (key(p) != "") & ~F.lower(key(p)).isin(*TRACKING) & ~F.lower(key(p)).startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(key(p)), F.lit("="), encoded(value(p)))), "&")
    front = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""))
    return F.concat(front, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def genuine_alias(canonical: Column, other: Column) -> Column:
    """Whether ``other`` is another address of the same page: not a shop route, and of another last segment."""
    bare = lambda u: F.rtrim(decoded(F.substring_index(u, "?", 1)), F.lit("/"))
    last = lambda u: F.substring_index(bare(u), "/", -1)
    usable = (canonical != "") & (other != "") & ~canonical.rlike(ROUTE) & ~other.rlike(ROUTE)
    return F.coalesce(usable & (bare(canonical) != bare(other)) & (last(canonical) != last(other)), F.lit(False))


def absolute(base: str, href: Column) -> Column:
    """A link against a base address ``scheme://host``."""
    scheme = base.split("//")[0]
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(scheme), href))
        .when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href))
        .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
    )
