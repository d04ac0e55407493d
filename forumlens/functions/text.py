"""Scalar functions as Columns; only Unicode normalisation needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UTC8 = 28800
NO_TITLE = "(無標題)"
PINNED = "[公告]"


@F.pandas_udf(T.StringType())
def norm_entity(names: pd.Series) -> pd.Series:
    """NFKC, without white space, in lower case; null stays null."""
    return names.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).split()).lower())


def norm_query(text: str) -> str:
    """The same for a query on the driver."""
    return "".join(unicodedata.normalize("NFKC", text).split()).lower()


def like_literal(text: str) -> str:
    """A query without the signs that a LIKE pattern would read."""
    return norm_query(text).translate({ord(c): None for c in "%_\\"})


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def title_or_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(NO_TITLE))


def excerpt(c: Column, chars: int = 300) -> Column:
    return F.left(trimmed(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(chars))


def local_time(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch + UTC8)


def local_day(epoch: Column) -> Column:
    """The UTC+8 day of an epoch, as YYYY-MM-DD."""
    return F.date_format(local_time(epoch), "yyyy-MM-dd")


def sentiment_sign(c: Column) -> Column:
    return F.when(c == "正面", 1).when(c == "負面", -1).otherwise(0)


def list_date(epoch: Column) -> Column:
    """M/D in UTC+8, months below 10 behind a space; null gives ''."""
    at = local_time(epoch)
    return F.coalesce(F.concat(F.lpad(F.date_format(at, "M"), 2, " "), F.lit("/"), F.date_format(at, "d")), F.lit(""))


def article_time(epoch: Column) -> Column:
    """'Www Mon _D HH:MM:SS YYYY' in UTC+8; null gives ''."""
    at = local_time(epoch)
    weekday = F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek(at))
    text = F.concat_ws(" ", weekday, F.date_format(at, "MMM"), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, "HH:mm:ss yyyy"))
    return F.when(epoch.isNull(), "").otherwise(text)


def relative_time(epoch: Column, now: int) -> Column:
    age = F.lit(now) - epoch
    return (
        F.when(epoch.isNull(), "")
        .when(age < 60, "剛剛")
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit(" 分鐘前")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit(" 小時前")))
        .when(age < 172800, "昨天")
        .when(age < 604800, F.concat(F.floor(age / 86400).cast("string"), F.lit(" 天前")))
        .otherwise(F.date_format(local_time(epoch), "MM/dd"))
    )


def is_peak(epoch: Column) -> Column:
    """Monday to Friday, 14:00 to before 18:00 in UTC+8."""
    at = local_time(epoch)
    return F.dayofweek(at).between(2, 6) & F.hour(at).between(14, 17)


def nrec_class(c: Column) -> Column:
    n = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.try_to_number(F.trim(c), F.lit("S999999999")).cast("long"))
    return (
        F.when(c.isNull() | (c == ""), "")
        .when((c == "爆") | c.startswith("X"), "c-f1")
        .when(n >= 10, "c-f3")
        .when(n >= 1, "c-f2")
        .otherwise("")
    )


def sentiment_class(c: Column) -> Column:
    return F.when(c == "正面", "c-f2").when(c == "負面", "c-f1").otherwise("c-white")


def controversy_class(c: Column) -> Column:
    return F.when(c == "高", "c-f1").when(c == "中", "c-f3").otherwise("c-white")


def user_count_color(c: Column) -> Column:
    return F.when(c.contains("f1"), "c-f1").when(c.contains("f3"), "c-f3").otherwise("c-white")


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def total_pages(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("long")


def board_page_href(board: Column, pages: Column, page: Column) -> Column:
    index = F.when(page <= 1, "index.html").otherwise(F.concat(F.lit("index"), F.greatest(F.lit(1), pages - page + 1).cast("string"), F.lit(".html")))
    return F.concat(F.lit("/bbs/"), board, F.lit("/"), index)


def index_slug_page(slug: str) -> int | None:
    """N of 'indexN.html', from 1; None for anything else."""
    middle = slug.removeprefix("index").removesuffix(".html")
    if slug != f"index{middle}.html" or not middle.isascii() or not middle.isdigit() or int(middle) < 1:
        return None
    return int(middle)


def page_number(slug: str, pages: int) -> int | None:
    """The newest-first page that a slug addresses, None beyond 1..pages."""
    n = index_slug_page(slug)
    return pages - n + 1 if n is not None and n <= pages else None


def next_interval(current: Column, new: Column, low: int = 120, high: int = 604800) -> Column:
    return F.when(new, low).otherwise(F.least(current * 2, F.lit(high)))


def url_id_time(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"M\.(\d+)\.", 1), F.lit("")).try_cast("long")


def article_url_parts(c: Column) -> Column:
    """(board, url_id, url_timestamp) of an article path; null if it isn't one."""
    pattern = r"/bbs/([^/]+)/(M\.(\d+)\.A\.([^.]+))\.html"
    parts = F.struct(
        F.regexp_extract(c, pattern, 1).alias("board"),
        F.regexp_extract(c, pattern, 2).alias("url_id"),
        F.regexp_extract(c, pattern, 3).try_cast("long").alias("url_timestamp"),
    )
    return F.when(c.rlike(pattern), parts)


def posted_at(c: Column) -> Column:
    """Epoch of 'Www Mon D HH:MM:SS YYYY' in UTC+8; null if it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"^\w+ ", "")
    return F.unix_seconds(F.try_to_timestamp(plain, F.lit("MMM d HH:mm:ss yyyy"))) - UTC8


def article_url(board: Column, url_id: Column) -> Column:
    return F.concat(F.lit("/bbs/"), board, F.lit("/"), url_id, F.lit(".html"))


def index_url(board: Column, page: Column) -> Column:
    number = F.when(page > 0, page.cast("string")).otherwise("")
    return F.concat(F.lit("/bbs/"), board, F.lit("/index"), number, F.lit(".html"))


def parse_tags(c: Column) -> Column:
    """The strings of a JSON array; bad JSON, other values and null give an empty array."""
    items = F.from_json(c, "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(strings, lambda v: v.cast("string")), F.array().cast("array<string>"))


def parse_entities(c: Column) -> Column:
    """(name, type) of the objects with a string name in a JSON array."""
    items = F.from_json(c, "array<variant>")
    named = F.filter(items, lambda v: F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING")
    pairs = F.transform(
        named,
        lambda v: F.struct(
            F.try_variant_get(v, "$.name", "string").alias("name"),
            F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("其他")).alias("type"),
        ),
    )
    return F.coalesce(pairs, F.array().cast("array<struct<name:string,type:string>>"))


def parse_stance(c: Column) -> Column:
    """(pro, con, neutral); values that aren't numbers count as 0; bad JSON gives null."""
    v = F.try_parse_json(c)

    def number(field: str) -> Column:
        own = F.try_variant_get(v, f"$.{field}", "variant")
        kind = F.schema_of_variant(own)
        return F.coalesce(F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, f"$.{field}", "double")), F.lit(0.0))

    made = F.struct(number("pro").alias("pro"), number("con").alias("con"), number("neutral").alias("neutral"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), made)


def truncate_error(c: Column, chars: int = 300) -> Column:
    return F.left(c, F.lit(chars))
