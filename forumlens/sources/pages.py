"""Page sources: landed pages as tables, a Python data source, rate limits, a cache and an analyser.

Nothing here needs a network. Pages are read from where a fetcher has landed them; a live fetcher or
model is passed in as a function.
"""

from __future__ import annotations

import datetime
import json
import random
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.html import hot_board_page

#: a page as landed: status 404 is gone, other failures have a status or an error
LANDED = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("fetched_at", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)


def landed_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(LANDED).format(format).load(path)


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    """New files as they land; the trigger's file limit stands for a rate limit."""
    return spark.readStream.schema(LANDED).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


class NotFound(Exception):
    pass


def fetch_with_retries(get: Callable[[str], tuple[int, str]], url: str, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """The body of a page. 5xx and network errors are retried after 1, 2, 4 ... seconds; 404 raises
    NotFound; other failures raise at once."""
    for attempt in range(retries + 1):
        try:
            status, body = get(url)
        except OSError as e:
            failure: Exception = e
        else:
            if status == 404:
                raise NotFound(url)
            if status < 400:
                return body
            failure = OSError(f"status {status}: {url}")
            if status < 500:
                raise failure
        if attempt < retries:
            sleep(2.0**attempt)
    raise failure


AGENT = "forumlens/1.0"
AGE_COOKIE = "over18=1"  # fixed value: what the site asks of readers
PAGE_TIMEOUT, LIST_TIMEOUT, MODEL_TIMEOUT = 30.0, 5.0, 120.0


def get_page(url: str, opener: Callable = urllib.request.urlopen, timeout: float = PAGE_TIMEOUT, headers: dict[str, str] | None = None) -> tuple[int, str]:
    """(status, body) of a page, redirects followed. Failures to connect and timeouts are OSErrors, at once or
    while the body is read."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT, "Cookie": AGE_COOKIE, **(headers or {})})
    try:
        with opener(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        e.close()  # the body isn't read; the connection is free again
        return e.code, ""


def get_hot_list(url: str, opener: Callable = urllib.request.urlopen) -> str:
    """The page of the hot boards; quickly or not at all, as a request waits for it."""
    status, body = get_page(url, opener, LIST_TIMEOUT)
    if status >= 400:
        raise OSError(f"status {status}: {url}")
    return body


def hot_list_cache(url: str, ttl: float = 60.0, get: Callable[[str], str] = get_hot_list, clock: Callable[[], float] = time.monotonic) -> TTLCache:
    """The boards of the hot list, (name, class, title, n_user, n_user_class) in its order. A page without any is no
    hot list: like a failed request it leaves the old boards in place, or raises if there are none."""
    return TTLCache(lambda: hot_board_page(get(url)), ttl, clock)


class PageSource(DataSource):
    """``spark.read.format("forum_pages")``: fetches the URLs of the option ``urls`` (one a line), one task for
    ``urls_per_task``, with ``get_page`` or the function named by ``fetcher`` (module:function). With ``rate`` a task asks
    for so many pages a second at most."""

    @classmethod
    def name(cls) -> str:
        return "forum_pages"

    def schema(self):
        return LANDED

    def reader(self, schema):
        return _PageReader(self.options)


@dataclass
class _Urls(InputPartition):
    urls: list

    def __init__(self, urls):
        self.urls = urls


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.size = int(options.get("urls_per_task", 50))
        self.fetcher = options.get("fetcher", f"{__name__}:get_page")
        self.rate = float(options.get("rate", 0))

    def partitions(self):
        return [_Urls(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Urls([])]

    def read(self, partition):
        import importlib

        module, _, function = self.fetcher.partition(":")
        get = getattr(importlib.import_module(module), function)
        bucket = TokenBucket(self.rate) if self.rate else None
        for url in partition.urls:
            if bucket:
                time.sleep(bucket.delay())
            try:
                yield url, int(time.time()), 200, fetch_with_retries(get, url)
            except NotFound:
                yield url, int(time.time()), 404, None
            except OSError as e:
                yield url, int(time.time()), 0, str(e)


class TokenBucket:
    """Up to ``rate`` tokens a second, as many saved up as a second gives. Threads may share it."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.clock = rate, clock
        self.burst = max(1.0, float(int(rate)))
        self.tokens, self.at = self.burst, clock()
        self.lock = threading.Lock()

    def delay(self) -> float:
        """Takes a token; how long to wait before using it."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            return max(0.0, -self.tokens / self.rate)


class CombinedBucket:
    """Takes a token from every bucket; waits for the slowest."""

    def __init__(self, *buckets: TokenBucket):
        self.buckets = buckets

    def delay(self) -> float:
        return max(b.delay() for b in self.buckets)


BACKFILL_SHARE = 0.6


def shared_bucket(whole: TokenBucket, share: float = BACKFILL_SHARE) -> CombinedBucket:
    """A bucket that has a share of another one's rate at most: what it takes counts there too, and what it leaves
    is the other users'."""
    if not 0 < share <= 1:
        raise ValueError("a share lies above 0 and at most at 1")
    return CombinedBucket(TokenBucket(whole.rate * share, whole.clock), whole)


class TTLCache:
    """A loaded value for ``ttl`` seconds. One caller loads, without holding the others up: they get the old
    value, or wait if there is none. A failed reload serves the old value too, and the next call tries again."""

    def __init__(self, load: Callable, ttl: float, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.lock, self.loading = threading.Lock(), threading.Lock()
        self.value, self.until = None, None

    def _fresh(self) -> tuple[bool, bool]:
        with self.lock:
            return self.until is not None, self.until is not None and self.clock() < self.until

    def get(self):
        had, fresh = self._fresh()
        if fresh or not self.loading.acquire(blocking=not had):
            return self.value
        try:
            had, fresh = self._fresh()
            if not fresh:  # nobody has loaded it in the meantime
                try:
                    value = self.load()
                except Exception:
                    if not had:
                        raise
                else:
                    with self.lock:
                        self.value, self.until = value, self.clock() + self.ttl
            return self.value
        finally:
            self.loading.release()


class ContentFiltered(Exception):
    """The model declined; never retried."""


def completions_url(base: str) -> str:
    """The endpoint of a base URL: as it is, behind a version (v1, v4, v1beta), or behind v1."""
    if base.endswith("/chat/completions"):
        return base
    versioned = re.search(r"/v\d+[a-z]*$", base)
    return f"{base}/chat/completions" if versioned else f"{base}/v1/chat/completions"


# Marks of a content filter in an error's body.
FILTER_MARKS = ('"code":"1301"', '"code": 1301', '"code":1301', "contentFilter")


def model_post(base: str, key: str, model: str, system: str, max_tokens: int, opener: Callable = urllib.request.urlopen, timeout: float = MODEL_TIMEOUT) -> Callable:
    """A ``post`` for ``complete``: asks a chat model and gives (status, body, seconds to wait as the answer asks)."""
    url = completions_url(base.rstrip("/"))
    headers = {"Content-Type": "application/json", "User-Agent": AGENT} | ({"Authorization": f"Bearer {key}"} if key else {})

    def wanted_wait(answer) -> float | None:
        try:
            return max(0.0, float(answer.headers.get("Retry-After")))
        except (TypeError, ValueError):
            return None

    def post(prompt: str) -> tuple[int, str, float | None]:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        body = json.dumps({"model": model, "messages": messages, "temperature": 0.3, "max_tokens": max_tokens}, ensure_ascii=False)
        request = urllib.request.Request(url, body.encode(), headers, method="POST")
        try:
            with opener(request, timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace"), wanted_wait(answer)
        except urllib.error.HTTPError as e:
            with e:
                return e.code, e.read().decode("utf-8", "replace"), wanted_wait(e)

    return post


def complete(
    post: Callable[[str], tuple[int, str, float | None]],
    prompt: str,
    retries: int = 2,
    wait: float = 15.0,
    sleep: Callable[[float], None] = time.sleep,
    jitter: Callable[[], float] = lambda: random.uniform(0.0, 2.0),
) -> tuple[str, int, int]:
    """(content, prompt tokens, completion tokens) of a chat answer.

    ``post`` gives (status, body, retry_after). 429, 5xx and network errors are retried after ``wait``
    seconds, doubled each time and spread by ``jitter`` seconds, or as long as the answer asks if that is
    longer; a content filter raises ContentFiltered.
    """
    for attempt in range(retries + 1):
        after = None
        try:
            status, body, after = post(prompt)
        except OSError as e:
            failure: Exception = e
        else:
            if status < 400:
                found = json.loads(body)
                content = (found.get("choices") or [{}])[0].get("message", {}).get("content") or ""
                if not content.strip():
                    raise ValueError("empty content")
                usage = found.get("usage") or {}
                return content, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)
            if any(m in body for m in FILTER_MARKS):
                raise ContentFiltered(body[:200])
            failure = OSError(f"llm status {status}: {body[:200]}")
            if status != 429 and status < 500:
                raise failure
        if attempt < retries:
            sleep(max(after or 0.0, wait * 2**attempt + jitter()))
    raise failure


def snapshot(tables: dict[str, DataFrame], root: str, stamp: str) -> list[str]:
    """A backup: every table as Parquet under ``root/stamp``."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{stamp}/{name}")
    return sorted(tables)


def prune_snapshots(spark, root: str, before: str) -> list[str]:
    """Deletes the snapshots with stamps below ``before`` (stamps sort by time); returns their names."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(top) if f.isDirectory()] if fs.exists(top) else []
    old = [p for p in found if p.getName() < before]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


KEEP_DAYS = 14


def nightly_backup(spark: SparkSession, tables: dict[str, DataFrame], root: str, now: int, keep_days: int = KEEP_DAYS) -> list[str]:
    """A snapshot named by today's date (UTC), then deletes those older than ``keep_days`` days; returns their names.
    The snapshot of a day that has one already is kept."""
    today = datetime.datetime.fromtimestamp(now, datetime.UTC).date()
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{today}")
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        snapshot(tables, root, str(today))
    return prune_snapshots(spark, root, str(today - datetime.timedelta(days=keep_days)))
