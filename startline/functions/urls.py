"""Addresses and link filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from startline.functions.text import strip

# Parts of an address that never lead to an event.
JUNK = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com",
    "mailto:", "tel:", "javascript:",
    "/privacy", "/terms", "/cookie", "/login", "/signin", "/signup", "/account", "/cart", "/checkout", "/basket",
)
JUNK_PATTERN = "(" + "|".join(j.replace(".", r"\.") for j in JUNK) + ")"


def normal_url(c: Column) -> Column:
    """Exactly one slash at the end."""
    return F.concat(F.regexp_replace(strip(c), "/+$", ""), F.lit("/"))


def site_root(c: Column) -> Column:
    """scheme://host, or null."""
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def host(c: Column) -> Column:
    """The lower-case host with port, without one leading `www.`; empty for relative links."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def robots_url(c: Column) -> Column:
    return F.concat(site_root(c), F.lit("/robots.txt"))


def path_and_query(c: Column) -> Column:
    """What robots patterns are held against: path and query, / if there is no path."""
    rest = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def is_junk(c: Column) -> Column:
    return F.lower(c).rlike(JUNK_PATTERN)


def same_site(url: Column, homepage: Column) -> Column:
    """The same host, a subdomain of it, or a host with the same first label."""
    a, b = host(url), host(homepage)
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | (F.split(a, r"\.")[0] == F.split(b, r"\.")[0])


def candidate_links(links: Column, homepage: Column) -> Column:
    """Array of links, stripped, without empties, junk and other sites, each once in order of first sight."""
    kept = F.filter(F.transform(links, strip), lambda u: u.isNotNull() & (u != "") & ~is_junk(u) & same_site(u, homepage))
    return F.array_distinct(kept)


def resolve(base: Column, link: Column) -> Column:
    """The absolute form of a link on a page, dot segments folded."""
    root = site_root(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link == "", base)
        .otherwise(F.concat(folder, link))
    )
    return F.when(joined.rlike(r"/\.\.?(/|$|[?#])") & joined.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), fold_dots(joined)).otherwise(joined)


def fold_dots(url: Column) -> Column:
    """Without . and .. segments in the path."""
    root, tail = site_root(url), F.regexp_extract(url, r"([?#].*)$", 1)
    path = F.regexp_replace(F.replace(url, root, F.lit("")), r"[?#].*$", "")
    every = F.split(path, "/")
    parts = F.slice(every, F.lit(2), F.size(every))
    ends = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")
    step = lambda done, s: (
        F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    )
    folded = F.array_join(F.aggregate(parts, empty, step), "/")
    slash = F.when(ends.isin(".", "..") & (folded != ""), F.lit("/")).otherwise(F.lit(""))
    return F.concat(root, F.lit("/"), folded, slash, tail)
