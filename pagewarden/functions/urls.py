"""URLs: cleaning, parts, and the search addresses of known sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search addresses, aliases and result pages of the supported sites, in order.
ROUTES = [
    ("youtube", "https://www.youtube.com/results?search_query=", ""),
    ("google", "https://www.google.com/search?q=", ""),
    ("github", "https://github.com/search?q=", "&type=repositories"),
    ("wikipedia", "https://en.wikipedia.org/w/index.php?search=", ""),
    ("amazon", "https://www.amazon.in/s?k=", ""),
]
ALIASES = [("youtube music", "youtube"), ("yt", "youtube"), ("wiki", "wikipedia")]

ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"


def sanitize_url(url: Column) -> Column:
    """The URL without user, password, query and fragment; a fixed word for what is no absolute URL."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")
    slashed = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)
    return F.when(url.rlike(ABSOLUTE), slashed).otherwise(F.lit("<URL_REDACTED>"))


def host(url: Column) -> Column:
    """Host with port, as it stands between the scheme and the path, without user and password."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def results_site(url: Column) -> Column:
    """The site on whose search-results page the URL is, else null."""
    h, p = host(url), path(url)
    return (
        F.when(h.contains("youtube.com") & p.startswith("/results"), "youtube")
        .when(h.contains("google.") & p.startswith("/search"), "google")
        .when(h.contains("github.com") & p.startswith("/search"), "github")
        .when(h.contains("wikipedia.org") & p.contains("search"), "wikipedia")
        .when(h.contains("amazon.") & p.startswith("/s"), "amazon")
    )


def injectable(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(https?|file):"), F.lit(False))


def search_url(site: Column, query: Column) -> Column:
    """Search address of a site, the query in form encoding; null for other sites."""
    case = None
    for name, head, tail in ROUTES:
        url = F.concat(F.lit(head), F.url_encode(query), F.lit(tail))
        case = F.when(site == name, url) if case is None else case.when(site == name, url)
    return case


def profile_identity(page_url: Column, link: Column) -> Column:
    """Whether a link names a profile of the page's host: same host, a path of one part."""
    return (host(page_url) == host(link)) & path(link).rlike(r"^/[^/]+/?$")
