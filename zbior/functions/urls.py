"""Addresses: extraction from markup, parts, categories and canonical forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from zbior.functions.text import strip

# Known domains and parts of names, by category.
RELIGIOUS_DOMAINS = "catholic.pl radiomaryja.pl niedziela.pl opoka.org.pl vatican.va deon.pl aleteia.org wiara.pl dolinamodlitwy.pl zchrystusem.pl radiokatolik.pl ekai.pl gosc.pl tygodnikpowszechny.pl fronda.pl pch24.pl naszdziennik.pl idziemy.pl misyjne.pl".split()
MEDIA_DOMAINS = "youtube.com youtu.be vimeo.com dailymotion.com tvp.pl polsatnews.pl onet.pl wp.pl interia.pl gazeta.pl rzeczpospolita.pl se.pl fakt.pl super.pl".split()
SOCIAL_DOMAINS = "facebook.com twitter.com x.com instagram.com linkedin.com tiktok.com snapchat.com pinterest.com".split()
EDUCATIONAL_DOMAINS = "wikipedia.org britannica.com edu.pl academia.edu researchgate.net scholar.google.com jstor.org".split()
RELIGIOUS_PARTS = "catholic|christian|church|bible|prayer|gospel"
MEDIA_PARTS = "news|tv|radio|media|press"
EDUCATIONAL_PARTS = r"\.edu$|\.edu\.pl$|university|academia"
TRUST = {"religious": 0.9, "educational": 0.8, "media": 0.7, "social": 0.6, "unknown": 0.5}
VIDEO = r"/watch|/video|\.mp4|\.avi|\.mov"
IMAGE = r"\.jpg|\.jpeg|\.png|\.gif|\.webp"
ARTICLE = "/article|/news|/post|/blog"
HREF = r"(?i)<a[^>]+href=[\"'](.*?)[\"']"
NAKED = r"(?i)(https?://[^\s<>\"\)\]]+|www\.[^\s<>\"\)\]]+)"

#: Most addresses of one post that are analysed.
MAX_URLS = 50


def domain(url: Column) -> Column:
    """Host with port and user, lower-case, without ``www.``; null for none. A missing scheme is https."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def is_religious(d: Column, more: tuple[str, ...] = ()) -> Column:
    return d.isin([*RELIGIOUS_DOMAINS, *more]) | d.rlike(RELIGIOUS_PARTS)


def is_media(d: Column, more: tuple[str, ...] = ()) -> Column:
    return d.isin([*MEDIA_DOMAINS, *more]) | d.rlike(MEDIA_PARTS)


def is_social(d: Column, more: tuple[str, ...] = ()) -> Column:
    return d.isin([*SOCIAL_DOMAINS, *more])


def is_educational(d: Column, more: tuple[str, ...] = ()) -> Column:
    return d.isin([*EDUCATIONAL_DOMAINS, *more]) | d.rlike(EDUCATIONAL_PARTS)


def domain_category(d: Column, more: dict[str, tuple[str, ...]] | None = None) -> Column:
    """religious, educational, media, social or unknown, in this order of precedence; the predicates may overlap."""
    more = more or {}
    return (
        F.when(is_religious(d, more.get("religious", ())), "religious").when(is_educational(d, more.get("educational", ())), "educational")
        .when(is_media(d, more.get("media", ())), "media").when(is_social(d, more.get("social", ())), "social").otherwise("unknown")
    )


def trust_score(category: Column) -> Column:
    out = F.lit(TRUST["unknown"])
    for name, value in TRUST.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def url_type(url: Column, d: Column | None = None) -> Column:
    """video, image, article, social or unknown, in this order of precedence."""
    u = F.lower(url)
    return F.when(u.rlike(VIDEO), "video").when(u.rlike(IMAGE), "image").when(u.rlike(ARTICLE), "article").when(is_social(domain(url) if d is None else d), "social").otherwise("unknown")


def url_stats(urls: Column, more: dict[str, tuple[str, ...]] | None = None, most: int | None = MAX_URLS) -> Column:
    """Counts over at most ``most`` addresses of a post (None: over all): all, distinct domains, and distinct domains by overlapping category."""
    more = more or {}
    capped = F.coalesce(urls, F.array().cast("array<string>"))
    if most is not None:
        capped = F.slice(capped, 1, most)
    domains = F.array_distinct(F.filter(F.transform(F.filter(capped, lambda u: u.isNotNull() & (strip(u) != "")), domain), lambda d: d.isNotNull()))
    n = lambda test: F.size(F.filter(domains, test)).cast("long")
    return F.struct(
        F.size(capped).cast("long").alias("total_urls"),
        F.size(domains).cast("long").alias("unique_domains"),
        n(lambda d: is_religious(d, more.get("religious", ()))).alias("religious_urls"),
        n(lambda d: is_media(d, more.get("media", ()))).alias("media_urls"),
        n(lambda d: is_social(d, more.get("social", ()))).alias("social_urls"),
        n(lambda d: is_educational(d, more.get("educational", ()))).alias("educational_urls"),
        n(lambda d: domain_category(d, more) == "unknown").alias("unknown_urls"),
    )


def light_domain_stats(urls: Column) -> Column:
    """Number of addresses, of distinct domains, and the domains, without a cap."""
    domains = F.array_distinct(F.filter(F.transform(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (strip(u) != "")), domain), lambda d: d.isNotNull()))
    return F.struct(F.coalesce(F.size(F.coalesce(urls, F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("external_links_count"), F.size(domains).cast("long").alias("unique_domains_count"), F.sort_array(domains).alias("domains"))


@F.pandas_udf(StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """``link`` resolved against ``base`` by RFC 3986; null if either is null."""
    from urllib.parse import urljoin

    return pd.Series([None if b is None or u is None else urljoin(b, u) for b, u in zip(base, link, strict=True)], dtype=object)


def resolve_link(base: Column, link: Column) -> Column:
    """The links that posts have (absolute, from the root, dots) resolved natively; dots stay at the root."""
    root = F.regexp_extract(base, r"^([^:]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    parent = F.regexp_replace(folder, r"([^:/])/[^/]+/$", "$1/")
    return F.when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).when(link.startswith("./"), F.concat(folder, F.substr(link, F.lit(3)))).when(link.startswith("../"), F.concat(parent, F.substr(link, F.lit(4)))).otherwise(link)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def extract_urls(html: Column, base: Column) -> Column:
    """Outgoing addresses of a post's markup: targets of links in order, then bare ones that neither extend nor
    shorten one already kept; anchors, mail and links to the page's own host are left out. Null markup has none."""
    html, own = F.coalesce(html, F.lit("")), _host(base)
    keep = lambda u: (u != "") & ((own == "") | own.isNull() | (_host(u) != own))
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda u: F.coalesce(resolve_link(base, strip(u)), strip(u)))
    hrefs = F.array_distinct(F.filter(hrefs, lambda u: keep(u) & ~u.startswith("#") & ~u.startswith("mailto:")))
    naked = F.filter(F.regexp_extract_all(html, F.lit(NAKED), F.lit(1)), keep)
    add = lambda kept, u: F.when(F.exists(kept, lambda k: k.startswith(u) | u.startswith(k)), kept).otherwise(F.concat(kept, F.array(u)))
    return F.aggregate(naked, hrefs, add)


def query_param(url: Column, name: str) -> Column:
    """The first value of a query parameter, null if it is not there."""
    value = F.regexp_extract(F.regexp_replace(url, "&amp;", "&"), rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&;]{name}="), value)


def without_session(url: Column) -> Column:
    """``url`` without its ``sid`` parameter and without a dangling ``?`` or ``&``."""
    out = F.regexp_replace(url, r"([?&])sid=[^&#]*&?", "$1")
    return F.regexp_replace(out, r"[?&]+(#|$)", "$1")
