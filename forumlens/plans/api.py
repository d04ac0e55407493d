"""Routes: which results answer a path, and how long an edge may keep them.

``answer`` gives named DataFrames, or None where the answer is "not found". Rendering is left to the
caller; ``display`` columns come from ``functions.text``.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reads as R
from ..sources.pages import TTLCache

PAGE_SIZE = 30

# Cache policy by path, the first that matches.
CACHE = (
    (r"/healthz$|/deleted", "no-store"),
    (r"/static/", "public, max-age=3600"),
    (r"/$|/bbs/hotboards\.html$", "public, s-maxage=300, stale-while-revalidate=600"),
    (r"/digest$", "public, s-maxage=3600"),
    (r"/trends$", "public, s-maxage=600"),
    (r"/rising$", "public, s-maxage=60"),
    (r"/search|/e/", "public, s-maxage=600"),
    (r"/u/", "public, s-maxage=300"),
    (r"/bbs/[^/]+/index\.html$", "public, s-maxage=60, stale-while-revalidate=120"),
    (r"/bbs/[^/]+/[^/]+\.html$", "public, s-maxage=300, stale-while-revalidate=600"),
)


def cache_policy(path: str) -> str:
    return next((policy for pattern, policy in CACHE if re.match(pattern, path)), "public, max-age=30")


def page_parameter(value: str | None) -> int:
    return max(1, int(value)) if value and re.fullmatch(r"\d{1,9}", value) else 1


def _board(t: R.Tables, name: str, page: int | None = None, slug: str | None = None) -> dict[str, DataFrame] | None:
    board = R.board_by_name(t, name)
    row = board.first()
    if row is None:
        return None
    pages = max(1, -(-row.articles // PAGE_SIZE))
    if slug is not None:
        page = 1 if slug == "index.html" else X.page_number(slug, pages)
    if page is None or not 1 <= page <= pages:
        return None
    return {"board": board, "articles": R.board_page(t, row.board_id, page, PAGE_SIZE)}


def _article(t: R.Tables, ids: DataFrame) -> dict[str, DataFrame] | None:
    row = ids.first()
    return {"article": R.article_detail(t, [row.id])} if row else None


def _live_boards(spark, hot: TTLCache) -> DataFrame:
    """The cached hot list as rows; ``place`` is the list's order."""
    rows = [(place, *(b[c] for c in ("name", "class", "title", "n_user", "n_user_class"))) for place, b in enumerate(hot.get())]
    return spark.createDataFrame(rows, "place int, name string, class string, title string, n_user int, n_user_class string")


def answer(t: R.Tables, url: str, now: int, deleted_token: str | None = None, hot: TTLCache | None = None) -> dict[str, DataFrame] | None:
    """``hot`` is the cached live list of boards (``pages.hot_list_cache``); without it the front page has the stored ones."""
    parts = urlsplit(url)
    path, asked = unquote(parts.path), {k: v[0] for k, v in parse_qs(parts.query).items()}
    if path in ("/", "/bbs/hotboards.html"):
        return {"boards": _live_boards(t["boards"].sparkSession, hot) if hot else R.hot_boards(t)}
    if m := re.fullmatch(r"/bbs/([^/]+)/(index\d*\.html)", path):
        return _board(t, m[1], slug=m[2])
    if m := re.fullmatch(r"/b/([^/]+)", path):
        return _board(t, m[1], page=page_parameter(asked.get("page")))
    if m := re.fullmatch(r"/bbs/([^/]+)/(M\.\d+\.A\.[^.]+)\.html", path):
        return _article(t, R.article_id(t, m[1], m[2]))
    if m := re.fullmatch(r"/a/(\d{1,18})", path):
        return _article(t, R.live(t).where(f"id = {m[1]}").select("id"))
    if path == "/boards":
        return {"boards": R.boards_count(t, 1), "nav": R.boards_count(t, 5)}
    if path == "/search":
        return {"entities": R.search_entities(t, asked.get("q", ""), 30)}
    if m := re.fullmatch(r"/e/(.+)", path):
        parts_ = {"entity": R.search_entities(t, m[1], 1), "timeline": R.entity_timeline(t, m[1], 60), "articles": R.entity_articles(t, m[1], 50)}
        some = reduce(DataFrame.unionByName, (df.limit(1).select(F.lit(1).alias("one")) for df in parts_.values()))
        return parts_ if not some.isEmpty() else None
    if path == "/trends":
        return {"entities": R.trending(t, now, 30)}
    if path == "/rising":
        return {"articles": R.rising_with_probability(t, now), "calibration": R.calibration(t, now)}
    if m := re.fullmatch(r"/u/(.+)", path):
        stats, pushed = R.author_stats(t, m[1]), R.push_stats(t, m[1])
        if not stats.first().total and not pushed.first().total:
            return None
        return {"stats": stats, "pushes_stats": pushed, "articles": R.author_articles(t, m[1], 50), "pushes": R.user_pushes(t, m[1], 50)}
    if path == "/digest":
        return {"boards": R.latest_digests(t)}
    if path == "/deleted":
        allowed = deleted_token is not None and asked.get("token") == deleted_token
        return {"articles": R.deleted_articles(t, 200), "days": R.deleted_by_day(t, 200)} if allowed else None
    if path == "/status":
        return {"status": R.status(t, now)}
    if path == "/healthz":
        return {"health": R.health(t, now)}
    return None
