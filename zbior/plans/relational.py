"""Queries of the scalar functions, the upserts and the resolution joins, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zbior.functions import dates as dt
from zbior.functions import text as tx
from zbior.functions import tokens as tk
from zbior.functions import urls as ur
from zbior.operators import resolve, upsert
from zbior.plans import model
from zbior.plans.model import OWN_DOMAINS
from zbior.plans.model_sql import EDUCATIONAL, MEDIA, MODEL, RELIGIOUS, SOCIAL, quoted
from zbior.session import shared_folder
from zbior.sources import pages
from zbior.sources.tables import spread, table
from zbior.streaming.upsert import current, upsert_stream, windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None, prelude: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (MODEL if prelude else "") + sql
        return f

    return register


_words = f"regexp_extract_all(lower(coalesce(text, '')), '{tk.WORD}')"


@query(f"""SELECT doc_id, len(w) AS total_tokens, len(list_distinct(w)) AS unique_tokens, CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w)::DOUBLE ELSE 0.0::DOUBLE END AS avg_token_length FROM (SELECT doc_id, {_words} AS w FROM documents)""")
def token_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Token statistics of every document."""
    own = spread(table(spark, folder, "documents", "doc_id", "text")).withColumn("w", tk.tokens(F.col("text")))
    return own.select("doc_id", tk.token_stats(F.col("w")).alias("s")).select("doc_id", "s.*")


@query(f"""SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS position, unnest(w) AS token FROM (SELECT doc_id, {_words} AS w FROM documents) WHERE len(w) > 0""")
def token_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every document with its place."""
    return spread(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", F.posexplode(tk.tokens(F.col("text"))).alias("position", "token")).withColumn("position", F.col("position").cast("long"))


_hits = ", ".join(f"len(list_filter(w, LAMBDA t: t IN ({quoted(x)}))) AS {k}" for k, x in (("p", tk.POSITIVE), ("m", tk.NEGATIVE), ("r", tk.RELIGIOUS)))


@query(f"""SELECT doc_id, CASE WHEN p + m > 0 THEN (p - m) / (p + m)::DOUBLE ELSE 0.0::DOUBLE END AS polarity, CASE WHEN p + m > 0 THEN least(1.0::DOUBLE, (p + m + 0.5::DOUBLE * r) / n) WHEN r > 0 THEN least(1.0::DOUBLE, r / n::DOUBLE) ELSE 0.0::DOUBLE END AS subjectivity FROM (SELECT doc_id, len(w) AS n, {_hits} FROM (SELECT doc_id, {_words} AS w FROM documents))""")
def lexicon_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment of every document by lexicon."""
    own = spread(table(spark, folder, "documents", "doc_id", "text")).withColumn("w", tk.tokens(F.col("text")))
    return own.select("doc_id", tk.sentiment(F.col("w")).alias("s")).select("doc_id", "s.*")


_raw = "206.835::DOUBLE - 1.015::DOUBLE * (n / s::DOUBLE) - 84.6::DOUBLE * (c / n::DOUBLE)"


@query(f"""SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN round({_raw}, 6) ELSE 0.0::DOUBLE END AS raw, CASE WHEN n > 0 AND s > 0 THEN round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, {_raw})), 6) ELSE 0.0::DOUBLE END AS score
FROM (SELECT doc_id, len({_words}) AS n, length(coalesce(text, '')) AS c, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?…]+'), LAMBDA s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))) AS s FROM documents)""")
def readability(spark: SparkSession, folder: str) -> DataFrame:
    """Readability of every document, clamped and before."""
    text = F.coalesce("text", F.lit(""))
    n, s, c = F.size(tk.tokens(text)).cast("long"), tk.sentence_count(text), F.length(text).cast("long")
    return spread(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", n.alias("n"), s.alias("s"), c.alias("c")).select("doc_id", F.round(tk.raw_readability(F.col("n"), F.col("s"), F.col("c")), 6).alias("raw"), F.round(tk.readability(F.col("n"), F.col("s"), F.col("c")), 6).alias("score"))


#: A post dressed in a board's markup, as a crawl would find it.
_PARTS = ["<div class=\"quotewrapper\"><b>", "coalesce(username, 'x')", "</b> Cytat</div><blockquote class=\"q\">Stare słowa</blockquote><span class=\"postbody\">", "content", "<br /><a href=\"", "url", "\">link</a> ISSN0014 <img src=\"a.png\"/></span><div class=\"notice\">Ostatnio zmieniony</div> www.x.example/y"]
_markup_sql = " || ".join(p if p in ("content", "url") or p.startswith("coalesce") else "'" + p + "'" for p in _PARTS)


def _marked_up(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.expr(p) if p in ("content", "url") or p.startswith("coalesce") else F.lit(p) for p in _PARTS]
    return model.posts(spark, folder, "content", "url", "username").filter("content is not null").select("id", "url", F.concat(*parts).alias("html"))


def _stripped(sql: str) -> str:
    return f"regexp_replace({sql}, '^{dt.SPACE}+|{dt.SPACE}+$', '', 'g')"


@query(f"""SELECT id, {_stripped(tx.rules_sql('html', tx.CLEAN_POST))} AS clean FROM (SELECT id, {_markup_sql} AS html FROM posts WHERE content IS NOT NULL)""", prelude=True)
def clean_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts in a board's markup, cleaned."""
    return _marked_up(spark, folder).select("id", tx.clean_post(F.col("html")).alias("clean"))


@query(f"""SELECT id, {_stripped(tx.rules_sql('html', tx.CLEAN_POST_KEEPING_LINKS))} AS clean FROM (SELECT id, {_markup_sql} AS html FROM posts WHERE content IS NOT NULL)""", prelude=True)
def clean_posts_keeping_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same for boards whose link texts stay."""
    return _marked_up(spark, folder).select("id", tx.clean_post_keeping_links(F.col("html")).alias("clean"))


@query(f"""SELECT id, {tx.rules_sql('html', tx.STRIP_QUOTES)} AS own FROM (SELECT id, {_markup_sql} AS html FROM posts WHERE content IS NOT NULL)""", prelude=True)
def unquoted_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Markup of posts without quoted sections."""
    return _marked_up(spark, folder).select("id", tx.strip_quotes(F.col("html")).alias("own"))


@query(None)
def outgoing_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses in the markup of every post, those that its content names among them."""
    return _marked_up(spark, folder).select("id", ur.extract_urls(F.col("html"), F.lit("https://elsewhere.example/")).alias("urls"))


@query("""SELECT id, regexp_replace(regexp_extract(lower(url), '^[^:]+://([^/?#]*)', 1), '^www\\.', '') AS domain, nullif(regexp_extract(url, '[?&]t=([^&#]*)', 1), '') AS t, nullif(regexp_extract(url, '[?&]f=([^&#]*)', 1), '') AS f,
regexp_replace(regexp_replace(url, '([?&])sid=[^&#]*&?', '\\1', 'g'), '[?&]+(#|$)', '\\1', 'g') AS plain FROM threads""", prelude=True)
def thread_links(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of the links of threads, and the link without its session."""
    u = F.col("url")
    return model.threads(spark, folder, "url").select("id", ur.domain(u).alias("domain"), ur.query_param(u, "t").alias("t"), ur.query_param(u, "f").alias("f"), ur.without_session(u).alias("plain"))


@query("""SELECT id, try_cast(nullif(regexp_extract(url, 'p=([0-9]+)', 1), '') AS BIGINT) AS number FROM posts""", prelude=True)
def post_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of posts from their links."""
    return model.posts(spark, folder, "url").select("id", tx.post_number(F.col("url")).alias("number"))


@query(None)
def displayed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of posts as the two display parsers read them, else as they stand."""
    own = spread(table(spark, folder, "forum_posts", "id", "post_date", "updated_at")).distinct()
    d, at = F.col("post_date"), F.col("updated_at")
    return own.select("id", "updated_at", F.coalesce(dt.board_date(d, at), d).alias("board"), F.coalesce(dt.stored_date(d, at), d).alias("stored"))


@query("""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS n FROM forum_users) WHERE n = 1""")
def users_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Users after INSERT OR REPLACE of every fetch."""
    own = table(spark, folder, "forum_users")
    return upsert.replace_by_key(own.limit(0), own, ["id"], "updated_at")


@query("""SELECT thread_id, post_number, arg_max(id, updated_at) AS id, arg_max(content, updated_at) FILTER (content IS NOT NULL OR true) AS content, min(created_at) AS created_at, max(updated_at) AS updated_at FROM forum_posts GROUP BY thread_id, post_number""")
def posts_updated(spark: SparkSession, folder: str) -> DataFrame:
    """Posts after ON CONFLICT (thread_id, post_number) DO UPDATE of every fetch; the first creation time stays."""
    own = table(spark, folder, "forum_posts", "thread_id", "post_number", "id", "content", "created_at", "updated_at")
    return upsert.update_on_conflict(own.limit(0), own, ["thread_id", "post_number"], "updated_at", ["created_at"])


@query("""SELECT domain, count(*) AS total_references, min(created_at) AS first_seen, max(created_at) AS last_seen FROM links JOIN posts USING (id) WHERE domain IS NOT NULL GROUP BY domain""", prelude=True)
def domain_table(spark: SparkSession, folder: str) -> DataFrame:
    """Domains with counted references and times."""
    return upsert.domain_table(model.post_urls(spark, folder, "created_at"), "created_at").drop("id")


@query("""SELECT p.id, min(t.id) AS resolved_thread FROM (SELECT id, thread_id, regexp_replace(regexp_extract(lower(url), '^[^:]+://([^/?#]*)', 1), '^www\\.', '') AS host, CAST(CAST(replace(thread_id, 't', '') AS BIGINT) AS VARCHAR) AS t FROM posts) p
JOIN (SELECT id, regexp_replace(regexp_extract(lower(url), '^[^:]+://([^/?#]*)', 1), '^www\\.', '') AS host, regexp_extract(url, '[?&]t=([^&#]*)', 1) AS t FROM threads) t ON p.host = t.host AND p.t = t.t GROUP BY p.id""", prelude=True)
def threads_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The thread of each post by the parameter in a thread link on the post's host."""
    link = F.concat(F.regexp_extract("url", r"^([^:]+://[^/?#]*)", 1), F.lit("/viewtopic.php?t="), F.replace("thread_id", F.lit("t"), F.lit("")).cast("long").cast("string"))
    found, _ = resolve.by_thread_param(model.posts(spark, folder, "url", "thread_id").select("id", link.alias("url")), model.threads(spark, folder, "url"))
    return found.select("id", "resolved_thread")


@query("""SELECT t.id, min(s.id) AS resolved_section FROM threads t JOIN forum_sections s ON regexp_extract(lower(t.url), '^[^:]+://([^/?#]*)', 1) = regexp_extract(lower(s.url), '^[^:]+://([^/?#]*)', 1) AND regexp_extract(t.url, '[?&]f=([^&#]*)', 1) = regexp_extract(s.url, '[?&]f=([^&#]*)', 1) GROUP BY t.id""", prelude=True)
def sections_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The section of each thread by its link, else by the parameter on the same host."""
    found, _ = resolve.sections_of_threads(model.threads(spark, folder, "url", "section_url"), table(spark, folder, "forum_sections", "id", "url"))
    return found.select("id", "resolved_section")


@query("""SELECT p.id FROM posts p WHERE p.username IS NULL OR NOT EXISTS (SELECT 1 FROM users u WHERE u.username = p.username)""", prelude=True)
def posts_without_user(spark: SparkSession, folder: str) -> DataFrame:
    """Posts whose name is no user's exactly."""
    return resolve.by_username(model.posts(spark, folder, "username"), model.users(spark, folder, "username"))[1].select("id")


@query("""SELECT s.title AS title, s.url AS href, f.id AS forum_id FROM forum_sections s JOIN forums f ON s.forum_id = f.id WHERE s.title IS NOT NULL""")
def index_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sections read back from index pages that are written from the tables."""
    own = table(spark, folder, "forum_sections", "id", "forum_id", "title", "url")
    link = F.concat(F.lit('<tr><td><a class="forumlink" href="'), F.col("url"), F.lit('">'), F.coalesce("title", F.lit("")), F.lit("</a></td></tr>"))
    html = own.groupBy("forum_id").agg(F.concat(F.lit("<table>"), F.array_join(F.sort_array(F.collect_list(link)), "\n"), F.lit("</table>")).alias("html"))
    index = html.select(F.substring("forum_id", 2, 9).cast("long").alias("page_id"), F.col("forum_id").alias("url"), "html")
    return pages.extract(index, "sections", "tables").select("title", "href", F.col("url").alias("forum_id"))


def _one_space(column: str) -> str:
    return f"trim(regexp_replace({column}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))"


def _shown(c: Column) -> Column:
    """Text as it stands in markup."""
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _page(df: DataFrame, *parts: str) -> DataFrame:
    """Pages (page_id, url, html) of which each is a row's ``id``; parts that name a column stand for its text."""
    html = F.concat(*[_shown(F.col(p[1:])) if p.startswith("$") else F.lit(p) for p in parts])
    return df.select(F.xxhash64("id").alias("page_id"), F.col("id").alias("url"), html.alias("html"))


@query(f"""SELECT * FROM (SELECT id, {_one_space('username')} AS username, {_one_space("coalesce(content, '')")} AS text, nullif({_one_space('post_date')}, '') AS post_date FROM posts) WHERE username <> ''""", prelude=True)
def post_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every post with an author read back from thread pages, of one style and of the other by turns."""
    own = model.posts(spark, folder, "username", "content", "post_date")
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    rows = _page(own.filter(even), '<table><tr class="row1"><td><b class="postauthor">', "$username", '</b></td><td><span class="postdate">', "$post_date", '</span><a href="viewtopic.php?p=1">#</a><div class="postbody">', "$content", "<blockquote>cytat</blockquote></div></td></tr></table>")
    items = _page(own.filter(~even), '<div class="post"><dl class="postprofile"><dt><a class="username">', "$username", '</a></dt></dl><div class="postbody"><span class="postdate">', "$post_date", '</span><a href="viewtopic.php?p=1">#</a><div class="content"><div class="quote"><p>cytat</p></div>', "$content", "</div></div></div>")
    found = pages.extract(rows, "posts", "tables").unionByName(pages.extract(items, "posts", "lists"))
    return found.select(F.col("url").alias("id"), "username", "text", "post_date")


@query(f"""SELECT id, {_one_space('title')} AS title, url AS href, nullif({_one_space('author')}, '') AS author, coalesce(replies, 0) AS replies, views, nullif({_one_space('last_post_date')}, '') AS last_post_date FROM threads WHERE {_one_space('title')} <> ''""", prelude=True)
def thread_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every thread with a title read back from section pages, of one style and of the other by turns."""
    own = model.threads(spark, folder, "title", "url", "author", "replies", "views", "last_post_date").withColumns({"replies": F.coalesce(F.col("replies").cast("string"), F.lit("-")), "views": F.col("views").cast("string")})
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    rows = _page(own.filter(even), '<table><tr><th>Temat</th></tr><tr><td class="row1"><a class="topictitle" href="', "$url", '">', "$title", '</a></td><td><p class="topicauthor">', "$author", '</p></td><td><p class="replies">', "$replies", '</p></td><td><p class="views">', "$views", '</p></td><td class="lastpost"><p class="lastpostdate">', "$last_post_date", "</p></td></tr></table>")
    items = _page(own.filter(~even), '<ul><li class="row sticky"><a class="topictitle" href="x">Regulamin</a></li><li class="row bg1"><a class="topictitle" href="', "$url", '">', "$title", '</a><div class="topic-poster">', "$author", '</div><dd class="posts">Odpowiedzi: ', "$replies", '</dd><dd class="views">', "$views", ' Odsłony</dd><dd class="lastpost"><time>', "$last_post_date", "</time></dd></li></ul>")
    found = pages.extract(rows, "threads", "tables").unionByName(pages.extract(items, "threads", "lists"))
    return found.select(F.col("url").alias("id"), "title", "href", "author", tx.counter(F.col("replies")).alias("replies"), tx.counter(F.col("views")).alias("views"), "last_post_date")


@query(f"""SELECT id, {_one_space('username')} AS username, nullif({_one_space('join_date')}, '') AS join_date, posts_count, CASE WHEN lower({_one_space('gender')}) IN ('m', 'mężczyzna', 'mezczyzna') THEN 'M' WHEN lower({_one_space('gender')}) IN ('k', 'kobieta') THEN 'K' END AS gender,
nullif({_one_space('religion')}, '') AS religion, nullif({_one_space('localization')}, '') AS localization FROM users WHERE {_one_space('username')} <> ''""", prelude=True)
def user_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Every user read back from the profile box beside a post, of one style and of the other by turns."""
    own = model.users(spark, folder, "username", "join_date", "posts_count", "gender", "religion", "localization").withColumn("posts_count", F.col("posts_count").cast("string"))
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    rows = _page(own.filter(even), '<table><tr class="row1"><td><b class="postauthor">', "$username", '</b><span class="postdetails"><b>Dołączył(a):</b> ', "$join_date", "<br /><b>Posty:</b> ", "$posts_count", "<br /><b>Płeć:</b> ", "$gender", "<br /><b>wyznanie:</b> ", "$religion", "<br /><b>Lokalizacja:</b> ", "$localization", '</span></td><td><div class="postbody">x</div></td></tr></table>')
    items = _page(own.filter(~even), '<div class="post"><dl class="postprofile"><dt><a class="username">', "$username", "</a></dt><dd><strong>Rejestracja:</strong> ", "$join_date", "</dd><dd><strong>Posty:</strong> ", "$posts_count", "</dd><dd><strong>Płeć:</strong> ", "$gender", "</dd><dd><strong>Wyznanie:</strong> ", "$religion", "</dd><dd><strong>Lokalizacja:</strong> ", "$localization", '</dd></dl><div class="postbody"><div class="content">x</div></div></div>')
    found = pages.extract(rows, "posts", "tables").unionByName(pages.extract(items, "posts", "lists"))
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(unescape(c), f"{dt.SPACE}+", " ")), F.lit("")).alias(c)
    unescape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return found.select(F.col("url").alias("id"), "username", pages.profile(F.col("profile")).alias("p")).select("id", "username", "p.*").select("id", "username", "posts_count", "gender", *[plain(c) for c in ("join_date", "religion", "localization")])


@query("""SELECT id, [url || '&start=25', url || '&start=50'] AS next FROM forum_sections""")
def page_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each section that its first page links to."""
    own = table(spark, folder, "forum_sections", "id", "url")
    link = lambda n: ['<a href="', "$url", f'&amp;start={n}&amp;sid=abc">{n}</a>']
    page = _page(own, *link(50), *link(25), *link(25), *link(0), '<a href="viewtopic.php?t=5&amp;start=25">x</a>').join(own.withColumnRenamed("url", "own"), F.col("url") == F.col("id"))
    return page.select("id", pages.page_links(F.replace("html", F.lit("&amp;amp;"), F.lit("&amp;")), F.col("own")).alias("next"))


@query("""WITH RECURSIVE links AS (SELECT f.id AS src, s.id AS dst FROM forums f JOIN forum_sections s ON s.forum_id = f.id UNION SELECT section_id, id FROM forum_threads UNION SELECT thread_id, id FROM forum_posts),
reached AS (SELECT id AS url FROM forums WHERE id = (SELECT min(id) FROM forums) UNION SELECT l.dst FROM links l JOIN reached r ON l.src = r.url) SELECT url FROM reached""")
def reachable_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that can be reached from the first forum over its sections, threads and posts."""
    forums = table(spark, folder, "forums", "id")
    edge = lambda df, src: df.select(F.col(src).alias("src"), F.col("id").alias("dst"))
    links = edge(table(spark, folder, "forum_sections", "id", "forum_id"), "forum_id").unionByName(edge(model.threads(spark, folder, "section_id"), "section_id")).unionByName(edge(model.posts(spark, folder, "thread_id"), "thread_id"))
    return pages.discover(links, forums.select(F.min("id").alias("url")))


_count = lambda test, name: f"count(DISTINCT domain) FILTER ({test}) AS {name}"


@query(f"""SELECT p.id, count(u.url) AS total_urls, count(DISTINCT domain) AS unique_domains, {_count(RELIGIOUS, 'religious_urls')}, {_count(MEDIA, 'media_urls')}, {_count(SOCIAL, 'social_urls')}, {_count(EDUCATIONAL, 'educational_urls')}, {_count("category = 'unknown'", 'unknown_urls')} FROM posts p LEFT JOIN urls u ON p.id = u.id GROUP BY p.id""", prelude=True)
def post_url_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of every post, and its distinct domains by category (which may overlap)."""
    found = F.regexp_extract_all(F.replace("content_urls", F.lit("\\/"), F.lit("/")), F.lit(model.ADDRESS), F.lit(0))
    return model.posts(spark, folder, "content_urls").select("id", ur.url_stats(found, OWN_DOMAINS, None).alias("s")).select("id", "s.*")


@query("""SELECT id, count(*) AS total_entities, count(*) FILTER (label = 'PERSON') AS person_entities, count(*) FILTER (label = 'ORG') AS org_entities, count(*) FILTER (label = 'GPE') AS gpe_entities, count(*) FILTER (label NOT IN ('PERSON', 'ORG', 'GPE')) AS other_entities FROM entities GROUP BY id""", prelude=True)
def post_entity_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of each post by kind of their label."""
    kinds = {"person_entities": "person", "org_entities": "org", "gpe_entities": "gpe", "other_entities": "other"}
    own = model.post_entities(spark, folder).withColumn("kind", tx.entity_kind(F.col("label")))
    return own.groupBy("id").agg(F.count("*").alias("total_entities"), *[F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()])


def _streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of its files (a glob, since a stream reads folders)."""
    path = f"{folder}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name}.parque[t]")


@query("""SELECT id, username, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS n FROM forum_users) WHERE n = 1""")
def users_streamed(spark: SparkSession, folder: str) -> DataFrame:
    """Users after a stream of fetches was merged batch by batch."""
    place = f"{shared_folder(spark)}/users-{uuid.uuid4().hex}"
    upsert_stream(_streamed(spark, folder, "forum_users"), f"{place}/table", f"{place}/progress", ["id"], "updated_at").awaitTermination()
    return current(spark, f"{place}/table").select("id", "username", "updated_at")


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each day by type, from a stream; days that the watermark has closed."""
    place = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    counts = windowed_counts(_streamed(spark, folder, "events"), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/table")
