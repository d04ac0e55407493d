"""HTML pages to rows: a small lenient element tree, and parsers that return nested structs.

The tree is built with the standard library's event parser, or by one regular expression where a page has plain
tags only; both give the same tree. Lookups go by CSS class or id. Parsers run in pandas UDFs, some pages at a
time; a page that can't be parsed gives a struct with its error and nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLIND = frozenset(("script", "style"))


class Node:
    __slots__ = ("tag", "attrs", "children", "classes")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = frozenset((attrs.get("class") or "").split())

    def walk(self):
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def find(self, cls: str) -> list[Node]:
        return self.found(cls)[cls]

    def found(self, *classes: str) -> dict[str, list[Node]]:
        """The nodes of each of the classes, in the order of the page, from one walk."""
        out, stack = {c: [] for c in classes}, self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is Node:
                for c in node.classes:
                    if c in out:
                        out[c].append(node)
                if node.children:
                    stack += node.children[::-1]
        return out

    def tags(self, tag: str) -> list[Node]:
        out, stack = [], self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is Node:
                if node.tag == tag:
                    out.append(node)
                if node.children:
                    stack += node.children[::-1]
        return out

    def text(self, without: frozenset = frozenset()) -> str:
        if len(self.children) == 1 and self.children[0].__class__ is str:
            return self.children[0]
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    out.append(child)
                elif not child.classes & without:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword: passed over up to its end, as browsers do
            return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


# Plain pages: text, tags with quoted values that need no decoding, and closing tags. Elements whose text isn't markup
# are left to the library.
_PLAIN = re.compile(r"""([^<]*)(?:<(?:([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)( ?/)?|/([a-z][a-z0-9]*))>|\Z)""")
_ATTR = re.compile(r""" ([a-z-]+)="([^"]*)\"""")
_RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp plaintext".split())


@lru_cache(maxsize=4096)
def _attrs(text: str) -> tuple[dict[str, str], frozenset]:
    """Shared by the nodes that have them: not to be changed."""
    attrs = dict(_ATTR.findall(text))
    return attrs, frozenset(attrs.get("class", "").split())


def plain_tree(html: str) -> Node | None:
    """The tree of a page of plain tags; None for any other page."""
    root = Node("", {})
    open_, at, size = [root], 0, len(html)
    match, new, children = _PLAIN.match, Node.__new__, root.children
    while at < size:
        m = match(html, at)
        if m is None:
            return None
        text, tag, attrs, empty, end = m.groups()
        at = m.end()
        if text:
            children.append(unescape(text) if "&" in text else text)
        if tag:
            if tag in _RAW:
                return None
            node = new(Node)
            node.tag, node.children = tag, []
            node.attrs, node.classes = _attrs(attrs)
            children.append(node)
            if not empty and tag not in _VOID:
                open_.append(node)
                children = node.children
        elif end:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == end:
                    del open_[i:]
                    children = open_[-1].children
                    break
    return root


def tree(html: str | None) -> Node:
    plain = plain_tree(html or "")
    if plain is not None:
        return plain
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _joined(nodes: list[Node]) -> str:
    if len(nodes) == 1:
        return nodes[0].text().strip()
    return "".join(n.text() for n in nodes).strip()


# The forms of article and page links.
ARTICLE_LINK = re.compile(r"/bbs/([^/]+)/(M\.(\d+)\.A\.([^.]+))\.html")
PAGE_LINK = re.compile(r"index(\d+)\.html")
_IP = re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")
_AWAY = frozenset(("article-metaline", "article-metaline-right", "push"))


def _whole(text: str) -> int:
    """A whole number as text, else 0."""
    return int(text) if re.fullmatch(r"[+-]?\d{1,18}", text) else 0


def index_page(html: str | None) -> dict:
    root = tree(html)
    newest = 0
    for link in (a for box in root.find("btn-group-paging") for a in box.tags("a")):
        if "上頁" in link.text():
            m = PAGE_LINK.search(link.attrs.get("href", ""))
            newest = int(m[1]) + 1 if m else 0
            break
    entries = []
    for row in root.find("r-ent"):
        own = row.found("title", "author", "date", "nrec", "mark")
        titles = own["title"]
        links = [a for t in titles for a in t.tags("a")]
        m = ARTICLE_LINK.search(links[0].attrs.get("href", "")) if links else None
        entries.append(
            {
                "url_id": m[2] if m else "",
                "title": _joined(links if links else titles),
                "author": _joined(own["author"]),
                "date": _joined(own["date"]),
                "nrec_raw": _joined([s for n in own["nrec"] for s in n.tags("span")]),
                "mark": _joined(own["mark"]),
                "deleted": not links,
            }
        )
    return {"entries": entries, "max_page": newest}


def article_page(html: str | None, url: str | None) -> dict:
    link = ARTICLE_LINK.search(url or "")
    if not link:
        raise ValueError(f"invalid article URL: {url}")
    main = next((n for n in tree(html).walk() if n.attrs.get("id") == "main-content"), None)
    if main is None:
        raise ValueError("#main-content not found")
    meta = {}
    top = main.found("article-metaline", "push")
    for line in top["article-metaline"]:
        own = line.found("article-meta-tag", "article-meta-value")
        meta[_joined(own["article-meta-tag"])] = _joined(own["article-meta-value"])
    pushes = []
    for row in top["push"]:
        own = row.found("push-tag", "push-content", "push-userid", "push-ipdatetime")
        tag = _joined(own["push-tag"])
        if tag:
            said = _joined(own["push-content"]).removeprefix(":").strip()
            pushes.append(
                {"tag": tag, "user_id": _joined(own["push-userid"]), "content": said, "ip_datetime": _joined(own["push-ipdatetime"])}
            )
    ip, kept = "", []
    for line in map(str.strip, main.text(without=_AWAY).split("\n")):
        if line.startswith("※"):
            m = _IP.search(line) if not ip and "發信站" in line else None
            ip = m[0] if m else ip
        elif line and not line.startswith("◆"):
            kept.append(line)
    tags = [p["tag"] for p in pushes]
    return {
        "board": link[1],
        "url_id": link[2],
        "title": meta.get("標題", ""),
        "author": meta.get("作者", "").split(" ")[0],
        "posted_text": meta.get("時間"),
        "content": "\n".join(kept),
        "ip": ip,
        "pushes": pushes,
        "push_count": tags.count("推"),
        "boo_count": tags.count("噓"),
        "neutral_count": tags.count("→"),
    }


def category_page(html: str | None) -> list[dict]:
    out = []
    for row in tree(html).find("b-ent"):
        link = next((a for a in row.tags("a") if "board" in a.classes and a.attrs.get("href")), None)
        if link:
            href = link.attrs["href"]
            out.append(
                {
                    "href": href,
                    "name": _joined(row.find("board-name")),
                    "user_count": _whole(_joined(row.find("board-nuser"))),
                    "class": _joined(row.find("board-class")),
                    "title": _joined(row.find("board-title")),
                    "is_board": "/bbs/" in href,
                }
            )
    return out


def hot_board_page(html: str | None) -> list[dict]:
    out = []
    for row in tree(html).find("b-ent"):
        users = [s for n in row.find("board-nuser") for s in n.tags("span")]
        name = _joined(row.find("board-name"))
        if name:
            out.append(
                {
                    "name": name,
                    "class": _joined(row.find("board-class")),
                    "title": _joined(row.find("board-title")),
                    "n_user": _whole(_joined(users)),
                    "n_user_class": users[0].attrs.get("class", "") if users else "",
                }
            )
    if not out:
        raise ValueError("no board entries found")
    return out


def web_page(html: str | None) -> dict:
    """Any page: title, link targets and visible text."""
    root = tree(html)
    titles = root.tags("title")
    links = [a.attrs["href"] for a in root.tags("a") if a.attrs.get("href")]
    parts, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.tag not in _BLIND and node.tag != "title":
            stack.extend(reversed(node.children))
    return {"title": titles[0].text().strip() if titles else "", "links": links, "text": " ".join("".join(parts).split())}


def _struct(ddl: str) -> T.StructType:
    """A flat list of 'name type' pairs; the types used here only."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


_ENTRY = _struct("url_id string,title string,author string,date string,nrec_raw string,mark string,deleted boolean")
_PUSH = _struct("tag string,user_id string,content string,ip_datetime string")
INDEX = T.StructType([T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("max_page", T.IntegerType())])
ARTICLE = T.StructType(
    [
        *_struct("board string,url_id string,title string,author string,posted_text string,content string,ip string").fields,
        T.StructField("pushes", T.ArrayType(_PUSH)),
        *_struct("push_count int,boo_count int,neutral_count int,error string").fields,
    ]
)
CATEGORY = T.ArrayType(_struct("href string,name string,user_count int,class string,title string,is_board boolean"))
HOT = T.ArrayType(_struct("name string,class string,title string,n_user int,n_user_class string"))
WEB = _struct("title string,links strings,text string")


CHUNK_CHARS, BATCH_BYTES = 1 << 18, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Pages go to Python in batches of at most ``BATCH_BYTES``, however long they are."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def _chunks(batches: Iterator, size: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows of batches of pages (a series, or some of which the first has the pages), about ``size`` characters at a
    time: what is parsed from a page takes many times its room."""
    part, held = [], 0
    for batch in batches:
        for row in zip(*(batch if isinstance(batch, tuple) else (batch,))):
            part.append(row)
            held += len(row[0] or "")
            if held >= size:
                yield part
                part, held = [], 0
        # the rows of a batch are given back before the next one is asked for
        if part:
            yield part
            part, held = [], 0


def _frame(kind: T.StructType, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in kind.names})


def _parsed(kind: T.StructType, parse: Callable[..., dict], batches: Iterator) -> Iterator[pd.DataFrame]:
    for part in _chunks(batches):
        yield _frame(kind, [parse(*row) for row in part])


def _article(html: str | None, url: str | None) -> dict:
    try:
        return article_page(html, url)
    except ValueError as e:
        return {"error": str(e)}


def _hot(html: str | None) -> list[dict] | None:
    try:
        return hot_board_page(html)
    except ValueError:
        return None


@F.pandas_udf(INDEX)
def parse_index(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    yield from _parsed(INDEX, index_page, html)


@F.pandas_udf(ARTICLE)
def parse_article(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(html, url) -> an ARTICLE."""
    for frame in _parsed(ARTICLE, _article, pages):
        yield frame.astype({c: "Int32" for c in ("push_count", "boo_count", "neutral_count")})


# a filter on what was parsed would be pushed below it, and each page parsed twice
parse_article = parse_article.asNondeterministic()


@F.pandas_udf(CATEGORY)
def parse_category(html: pd.Series) -> pd.Series:
    return html.map(category_page)


@F.pandas_udf(HOT)
def parse_hot_boards(html: pd.Series) -> pd.Series:
    """Null for a page without boards; the caller decides whether that's an error."""
    return html.map(_hot)


@F.pandas_udf(WEB)
def parse_web_page(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    yield from _parsed(WEB, web_page, html)
