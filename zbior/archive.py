"""Crawled pages to the relational tables of the archive, and their sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zbior.functions import dates, text, urls
from zbior.operators.resolve import matching, surrogate
from zbior.operators.upsert import replace_by_key
from zbior.sources import pages, versioned
from zbior.sources.tables import latest

# What identifies a row of each table, and when it was written.
KEYS = {
    "forums": (["id"], "updated_at"), "sections": (["id"], "updated_at"), "threads": (["id"], "updated_at"), "users": (["id"], "updated_at"), "posts": (["id"], "updated_at"),
    "weeklies": (["name"], "scraped_at"), "issues": (["weekly_name", "issue_number", "issue_year"], "scraped_at"), "issue_sections": (["weekly_name", "issue_number", "issue_year", "section_name"], "scraped_at"),
    "articles": (["weekly_name", "issue_number", "issue_year", "article_url"], "scraped_at"), "authors": (["name"], "scraped_at"),
}


@dataclass(frozen=True)
class Board:
    """A board's name, title and style of markup (``tables`` or ``lists``)."""

    name: str
    title: str
    style: str


def _dated(shown, at):
    return F.coalesce(dates.board_date(shown, at), dates.stored_date(shown, at), shown)


def posts_of_pages(raw: DataFrame, style: str, fetched: str) -> DataFrame:
    """Posts of thread pages (page_id, url, html, ``fetched``): ids, cleaned text, outgoing addresses, author and date.

    Ids come from natural keys, so that a page fetched again gives the same ids; of posts fetched more than
    once the last stays. Posts without a thread in their page's link or markup are left out.
    """
    return latest(_posts(raw, style, fetched).filter("thread_id is not null"), ["id"], ["updated_at"])


def _posts(raw: DataFrame, style: str, fetched: str) -> DataFrame:
    thread = raw.select("page_id", F.col(fetched).alias("updated_at"), pages.thread_param(F.col("url"), F.col("html")).alias("t"), urls.query_param(F.col("url"), "f").alias("f"), urls.domain(F.col("url")).alias("host"))
    found = pages.extract(raw, "posts", style).join(thread, "page_id")
    clean = text.clean_post(F.col("markup")) if style == "tables" else text.clean_post_keeping_links(F.col("markup"))
    return found.select(
        surrogate("host", "t", "href", "pos").alias("id"), F.when(F.col("t").isNotNull(), surrogate("host", "t")).alias("thread_id"), surrogate("host", "username").alias("user_id"), "username",
        text.post_number(F.col("href")).alias("post_number"), clean.alias("content"), urls.extract_urls(text.strip_quotes(F.col("markup")), F.col("url")).alias("content_urls"),
        F.coalesce(_dated(F.col("post_date"), F.col("updated_at")), dates.author_line_date(F.col("author_line"))).alias("post_date"), pages.profile(F.col("profile")).alias("profile"), "url", "host", "f", "updated_at",
    )


def tables_of_pages(raw: DataFrame, board: Board, fetched: str = "fetched_at") -> dict[str, DataFrame]:
    """``forums``, ``sections``, ``threads``, ``users`` and ``posts`` of a board's pages (page_id, url, html, ``fetched``), and what was ``rejected``.

    Pages are told apart by their script: a thread's posts, a section's threads, else the index. Each row stands
    as last fetched. A thread of which only posts were fetched (one alone, or by the link of a post) gets a row with its
    id and link alone, in the section that its page names, if any. Rejected are posts whose page names no thread, and threads of lists
    whose section is unknown, with the reason. Null and empty pages give nothing; an empty table gives the board alone.
    """
    own = raw.select("page_id", "url", "html", F.col(fetched).alias("updated_at"))
    topics, lists = own.filter(F.contains("url", F.lit("viewtopic.php"))), own.filter(F.contains("url", F.lit("viewforum.php")))
    index = own.filter(~F.contains("url", F.lit("viewtopic.php")))
    at = lambda df: df.select("page_id", "updated_at", urls.domain(F.col("url")).alias("host"), urls.query_param(F.col("url"), "f").alias("page_f"))
    forum = own.agg(F.max("updated_at").alias("updated_at")).select(surrogate(F.lit(board.name)).alias("id"), F.lit(board.name).alias("spider_name"), F.lit(board.title).alias("title"), "updated_at")
    href = urls.without_session(F.col("href"))
    sections = pages.extract(index, "sections", board.style).join(at(index), "page_id").withColumn("href", href).withColumn("f", urls.query_param(F.col("href"), "f")).filter("f is not null")
    sections = latest(sections.select(surrogate("host", "f").alias("id"), surrogate(F.lit(board.name)).alias("forum_id"), "title", F.col("href").alias("url"), "updated_at"), ["id"], ["updated_at"])
    listed = pages.extract(lists, "threads", board.style).join(at(lists), "page_id").withColumn("href", href).withColumn("t", urls.query_param(F.col("href"), "t")).filter("t is not null")
    listed = listed.select(
        surrogate("host", "t").alias("id"), surrogate("host", "page_f").alias("section_id"), "title", F.col("href").alias("url"), "author", text.counter(F.col("replies")).alias("replies"), text.counter(F.col("views")).alias("views"),
        _dated(F.col("last_post_date"), F.col("updated_at")).alias("last_post_date"), "last_post_author", "updated_at",
    )
    listed = latest(listed, ["id"], ["updated_at"])
    kept, lost = matching(listed, sections, "section_id")
    named = sections.select(F.col("id").alias("section_id"), F.col("url").alias("section_url"), F.col("title").alias("section_title"))
    posts = _posts(topics, board.style, "updated_at")
    found = latest(posts.filter("thread_id is not null"), ["id"], ["updated_at"])
    alone = found.groupBy(F.col("thread_id").alias("id")).agg(F.min(F.when(F.col("f").isNotNull(), surrogate("host", "f"))).alias("section_id"), F.min(urls.without_session(F.col("url"))).alias("url"), F.max("updated_at").alias("updated_at"))
    threads = kept.unionByName(alone.join(listed.select("id"), "id", "left_anti"), allowMissingColumns=True).join(named, "section_id", "left")
    users = latest(found.select(F.col("user_id").alias("id"), "username", "profile", "updated_at"), ["id"], ["updated_at"]).select("id", "username", "profile.*", "updated_at")
    reject = lambda df, table, why: df.select(F.lit(table).alias("table"), "id", "url", F.lit(why).alias("reason"))
    rejected = reject(posts.filter("thread_id is null"), "posts", "no thread").unionByName(reject(lost, "threads", "unknown section"))
    return {"forums": forum, "sections": sections, "threads": threads, "users": users, "posts": found.drop("profile", "host", "f"), "rejected": rejected}


def store(folder: str, tables: dict[str, DataFrame]) -> None:
    """Each of ``tables`` (those with a key in ``KEYS``) merged into the versioned table of its name in ``folder``; the row written last wins.

    Lists are encoded as JSON (``content_urls``). A table is replaced whole or not at all; storing the same rows again changes nothing.
    """
    for name, df in tables.items():
        if name in KEYS:
            keys, seq = KEYS[name]
            lists = [c for c, kind in df.dtypes if kind.startswith("array")]
            new = df.withColumns({c: F.to_json(c) for c in lists}) if lists else df
            place = f"{folder}/{name}"
            old = versioned.current(df.sparkSession, place)
            versioned.write(replace_by_key(old if old is not None else new.limit(0), new, keys, seq), place)
