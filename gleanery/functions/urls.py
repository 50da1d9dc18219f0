"""Column functions over URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(\?[^#]*)?"


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case without default port, path without one trailing slash, query kept, fragment dropped.
    What is no URL stays as it is."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2))
    port = F.regexp_extract(u, _URL, 3)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    path = F.regexp_replace(F.regexp_extract(u, _URL, 4), r"/$", "")
    return F.when(host == "", url).otherwise(F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(port), path, F.regexp_extract(u, _URL, 5)))


def url_key(url: Column) -> Column:
    """What URLs are compared by."""
    return F.lower(normal_url(url))


def domain_of(url: Column) -> Column:
    """Host in lower case without one leading ``www.``; null for what is no URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _URL, 2)), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def domain_suffixes(domain: Column) -> Column:
    """The domain and its parents of at least two labels."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def slug_of_url(url: Column) -> Column:
    """Last part of the path, decoded, or the host."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_extract(F.trim(url), _URL, 4), r"/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(F.try_url_decode(last), F.lit("")), domain_of(url))
