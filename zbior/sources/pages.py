"""Board pages to rows: index, thread list, posts and profiles, links to follow.

Markup is read by a tolerant parser in Arrow batches, one page at a time; what plain patterns can tell
(profile lines, pagination, ids in links) stays in column expressions. ``style`` is ``tables`` for boards
laid out in table rows and ``lists`` for boards laid out in list items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zbior.functions import urls
from zbior.functions.dates import SPACE
from zbior.functions.text import gender, strip

# Elements that have no end tag.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes and children (elements and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        todo = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                yield n
                todo += reversed(n.children)

    def find(self, tag: str | None = None, *names: str, test: Callable[[Node], bool] | None = None) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (not names or n.classes() & set(names)) and (test is None or test(n))]

    def text(self, skip: Callable[[Node], bool] | None = None) -> str:
        out, todo = [], list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif not (skip and skip(n)):
                todo += reversed(n.children)
        return " ".join(" ".join(out).split())

    def markup(self) -> str:
        def show(n: Node | str) -> str:
            if isinstance(n, str):
                return n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            attrs = "".join(f' {k}="{v}"' for k, v in n.attrs.items())
            return f"<{n.tag}{attrs}>" + ("" if n.tag in _VOID else "".join(map(show, n.children)) + f"</{n.tag}>")

        return "".join(map(show, self.children))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(html: str | None) -> Node:
    """The tree of a page; end tags without a start are ignored, elements left open close with their parent."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _quoted(n: Node) -> bool:
    return n.tag == "blockquote" or n.tag == "div" and any("quote" in c for c in n.classes())


def own_text(node: Node) -> str:
    """Text outside quotations."""
    return node.text(_quoted)


def _first(nodes: list[Node]) -> Node | None:
    return nodes[0] if nodes else None


def _say(node: Node | None) -> str | None:
    return (node.text() or None) if node else None


def _sections(page: Node, style: str) -> list[tuple]:
    links = page.find("a", "forumlink") if style == "tables" else page.find("a", "forumtitle", "subforum")
    return [(a.text(), a.attrs.get("href"), "subforum" in a.classes()) for a in links if a.text() and a.attrs.get("href")]


def _threads(page: Node, style: str) -> list[tuple]:
    out = []
    rows = page.find("tr") if style == "tables" else [n for n in page.find("li", "row") if not n.classes() & {"sticky", "announce", "global-announce"}]
    for row in rows:
        link = _first(row.find("a", "topictitle"))
        if not link or not link.text() or not link.attrs.get("href"):
            continue
        last = _first(row.find(None, "lastpost")) or _first(row.find("dd", "lastpost"))
        when = _first(last.find(None, "lastpostdate", "postdate") or last.find("time")) if last else None
        out.append((
            link.text(), link.attrs["href"], _say(_first(row.find(None, "topicauthor", "topic-poster"))), _say(_first(row.find(None, "replies", "posts"))), _say(_first(row.find(None, "views"))),
            _say(when), _say(_first(last.find(None, "lastpostauthor", "username"))) if last else None,
        ))
    return out


def _posts(page: Node, style: str) -> list[tuple]:
    out = []
    for row in page.find("tr", "row1", "row2") if style == "tables" else page.find("div", "post"):
        author, body = _first(row.find(None, "postauthor") if style == "tables" else row.find(None, "author", "postauthor", "username")), _first(row.find(None, "postbody", "content"))
        if not author or not body or not author.text():
            continue
        inner = _first(body.find(None, "content")) or body
        link = _first(row.find("a", test=lambda n: "p=" in n.attrs.get("href", "")))
        profile = _first(row.find(None, "postprofile", "postdetails"))
        out.append((author.text(), own_text(inner), inner.markup(), _say(_first(row.find(None, "postdate") or row.find("time"))), _say(_first(row.find("p", "author"))), link.attrs["href"] if link else None, profile.markup() if profile else None))
    return out


_KINDS = {
    "sections": (_sections, "title string, href string, sub boolean"),
    "threads": (_threads, "title string, href string, author string, replies string, views string, last_post_date string, last_post_author string"),
    "posts": (_posts, "username string, text string, markup string, post_date string, author_line string, href string, profile string"),
}


def extract(pages: DataFrame, what: str, style: str) -> DataFrame:
    """One row per section, thread or post of each page (page_id, url, html), with ``page_id``, ``url`` and ``pos`` (from 0).

    Rows without a title, link, author or body are dropped; null and empty pages give none.
    """
    read, columns = _KINDS[what]
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.bool_() if c.endswith("boolean") else pa.string() for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *values) for i, html in enumerate(batch.column(2).to_pylist()) for n, values in enumerate(read(parse_html(html), style))]
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 2)
            take = pa.array(columns[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(columns[1], pa.int32()), *(pa.array(c, t) for c, t in zip(columns[2:], types, strict=True))], ["page_id", "url", "pos", *names])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id long, url string, pos int, {columns}")


def profile(markup: Column) -> Column:
    """Struct of what a post's profile box says about its author; labels of either style."""
    line = lambda label: F.nullif(strip(F.regexp_extract(markup, rf"(?i)<(?:b|strong)>(?:{label}):?</(?:b|strong)>:?{SPACE}*([^<\n]*)", 1)), F.lit(""))
    icon = F.when(markup.contains("fa-mars"), "M").when(markup.contains("fa-venus"), "K")
    return F.struct(
        line(r"Dołączył\(a\)|Dołączył|Rejestracja").alias("join_date"), F.regexp_extract(line("Posty"), r"(\d+)", 1).try_cast("long").alias("posts_count"),
        F.coalesce(gender(line("Płeć")), icon).alias("gender"), line("wyznanie").alias("religion"), line("Lokalizacja").alias("localization"),
    )


def page_links(html: Column, url: Column, script: str = "viewforum.php") -> Column:
    """Links to other pages of the same list: with ``start=``, of ``script``, not the current start; each once, sorted."""
    hrefs = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(urls.HREF), F.lit(1)), lambda u: urls.without_session(F.regexp_replace(u, "&amp;", "&")))
    start = lambda u: F.coalesce(F.nullif(urls.query_param(u, "start"), F.lit("")), F.lit("0"))
    return F.sort_array(F.array_distinct(F.filter(hrefs, lambda u: u.contains("start=") & u.contains(script) & (start(u) != start(url)))))


def thread_param(url: Column, html: Column) -> Column:
    """The thread id in a page's link, else in the first thread link on the page."""
    return F.coalesce(urls.query_param(url, "t"), F.nullif(F.regexp_extract(html, r"viewtopic\.php\?(?:[^\"'>]*[&;])?t=(\d+)", 1), F.lit("")))


def discover(links: DataFrame, roots: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``url`` of everything reachable from ``roots`` (url) over ``links`` (src, dst), each once.

    Breadth first: each round joins the frontier, keeps what is new by an anti-join and is written to the
    shared folder, so that the plan stays short. Ends when nothing is new; raises if that is not so after ``most_rounds``.
    """
    from zbior.session import cut_lineage

    seen = cut_lineage(roots.select("url").filter("url is not null").distinct())
    frontier, rounds = seen, 0
    while True:
        found = links.join(frontier, links.src == frontier.url, "left_semi").select(F.col("dst").alias("url")).filter("url is not null").distinct()
        frontier = cut_lineage(found.join(seen, "url", "left_anti"))
        if frontier.isEmpty():
            return seen
        if rounds == most_rounds:
            raise RuntimeError(f"more is reachable after {most_rounds} rounds")
        rounds += 1
        seen = cut_lineage(seen.unionByName(frontier))
