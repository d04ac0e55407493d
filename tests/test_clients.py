import io
import json
import threading
import time
import urllib.error

import pytest
from forumlens.plans import api
from forumlens.sources import adapter
from forumlens.sources import pages as P
from test_html import BOARDS


class Answer(io.BytesIO):
    def __init__(self, status, body, headers=()):
        super().__init__(body.encode())
        self.status, self.headers = status, dict(headers)


def server(*answers):
    """An opener that gives the answers in turn, and what it was asked for."""
    asked, left = [], list(answers)

    def opener(request, timeout):
        asked.append((request, timeout))
        a = left.pop(0)
        if isinstance(a, Exception):
            raise a
        if a[0] >= 400:
            raise urllib.error.HTTPError(request.full_url, a[0], "x", dict(a[2:][0]) if a[2:] else {}, io.BytesIO(a[1].encode()))
        return Answer(*a)

    return opener, asked


def test_pages_are_asked_for_with_agent_cookie_and_timeout():
    opener, asked = server((200, "é"), (404, "gone"), (503, "busy"))
    assert [P.get_page("http://h/a", opener) for _ in range(3)] == [(200, "é"), (404, ""), (503, "")]
    request, timeout = asked[0]
    assert request.get_header("User-agent") == P.AGENT and request.get_header("Cookie") == "over18=1" and timeout == 30


def test_a_page_getter_behind_retries():
    waits = []
    get = lambda *answers: lambda url, o=server(*answers)[0]: P.get_page(url, o)
    assert P.fetch_with_retries(get((500, ""), TimeoutError("30 s"), (200, "ok")), "http://h/", sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(P.NotFound):
        P.fetch_with_retries(get((404, "")), "http://h/")
    with pytest.raises(OSError, match="403"):
        P.fetch_with_retries(get((403, "")), "http://h/", sleep=pytest.fail)
    with pytest.raises(OSError, match="30 s"):
        P.fetch_with_retries(get(*[TimeoutError("30 s")] * 4), "http://h/", sleep=waits.append)

    class Broken(Answer):
        def read(self, *a):
            raise ConnectionResetError("while reading")

    with pytest.raises(OSError, match="while reading"):
        P.get_page("http://h/", lambda r, timeout: Broken(200, ""))


def test_the_hot_list_is_cached_and_an_empty_one_is_none(spark):
    now, pages = [0.0], []

    def get(url):
        body = pages.pop(0)
        if isinstance(body, Exception):
            raise body
        return body

    cache = P.hot_list_cache("http://h/hot", 60, get, lambda: now[0])
    for broken in (OSError("down"), "<p>nothing</p>"):
        pages.append(broken)
        with pytest.raises((OSError, ValueError)):
            cache.get()
    pages.append(BOARDS)
    first = cache.get()
    assert [b["name"] for b in first] == ["Go", "Cat"] and cache.get() is first
    for broken in (OSError("down"), "<p>nothing</p>"):
        now[0] += 100
        pages.append(broken)
        assert cache.get() is first
    pages.append(BOARDS.replace("731", "9"))
    assert cache.get()[0]["n_user"] == 9
    opener, asked = server((500, ""), (200, BOARDS))
    with pytest.raises(OSError):
        P.get_hot_list("http://h/hot", opener)
    assert P.get_hot_list("http://h/hot", opener) == BOARDS and asked[0][1] == 5
    t = adapter.tables(spark, "/root/testdata/sf0.001")
    boards = api.answer(t, "/", adapter.NOW, hot=cache)["boards"]
    assert [(r.place, r.name, r.n_user, r.n_user_class) for r in boards.orderBy("place").collect()] == [(0, "Go", 9, "hl f1"), (1, "Cat", 0, "")]


def test_one_caller_loads_and_the_others_are_not_held_up():
    now, loads, go = [0.0], [], threading.Event()

    def load():
        loads.append(1)
        if len(loads) == 2:
            assert go.wait(10)
        return len(loads)

    cache = P.TTLCache(load, 5, lambda: now[0])
    assert cache.get() == 1
    now[0] = 6
    slow = threading.Thread(target=cache.get)
    slow.start()
    while len(loads) < 2:
        time.sleep(0.01)
    assert cache.get() == 1  # at once, while the other one loads
    go.set()
    slow.join()
    assert cache.get() == 2 and len(loads) == 2
    first = P.TTLCache(lambda: time.sleep(0.05) or loads.append(1) or "v", 5)
    got = []
    threads = [threading.Thread(target=lambda: got.append(first.get())) for _ in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert got == ["v"] * 5 and len(loads) == 3


def test_backfill_never_has_more_than_its_share():
    now, lock = [0.0], threading.Lock()
    whole = P.TokenBucket(10, lambda: now[0])
    backfill = P.shared_bucket(whole)
    taken = {"backfill": [], "other": []}

    def take(name, bucket, until):
        # each thread lives in its own simulated time and asks again once its wait is over
        at = 0.0
        while at < until:
            with lock:
                now[0] = max(now[0], at)
                at = now[0] + bucket.delay()
            taken[name].append(at)
            time.sleep(0)

    threads = [threading.Thread(target=take, args=a) for a in (("backfill", backfill, 60.0), ("other", whole, 60.0))]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    for start in range(0, 50, 5):
        assert sum(start <= x < start + 10 for x in taken["backfill"]) <= 10 * 6 + 6 + 1
        assert sum(start <= x < start + 10 for own in taken.values() for x in own) <= 10 * 10 + 10 + 1
    alone = P.shared_bucket(P.TokenBucket(10, lambda: 0.0))
    assert [round(alone.delay(), 3) for _ in range(8)] == [0] * 6 + [0.167, 0.333]
    with pytest.raises(ValueError):
        P.shared_bucket(whole, 0)


def test_threads_take_each_token_once():
    bucket = P.TokenBucket(1000, clock=lambda: 0.0)
    delays = []
    threads = [threading.Thread(target=lambda: delays.extend(bucket.delay() for _ in range(500))) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(round(d, 3) for d in delays) == [0] * 1000 + [round(i / 1000, 3) for i in range(1, 1001)]


def test_the_model_is_asked_over_http():
    said = json.dumps({"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 4, "completion_tokens": 2}})
    opener, asked = server((429, "slow down", {"Retry-After": "40"}), (200, said), (400, '{"code":"1301"}'), TimeoutError("120 s"))
    post = P.model_post("http://h:1/", "key", "m-1", "be brief", 99, opener)
    waits = []
    assert P.complete(post, "你好", sleep=waits.append, jitter=lambda: 0.0) == ("hi", 4, 2) and waits == [40.0]
    request, timeout = asked[0]
    assert request.full_url == "http://h:1/v1/chat/completions" and request.get_method() == "POST" and timeout == 120
    assert request.get_header("Authorization") == "Bearer key" and request.get_header("Content-type") == "application/json"
    body = json.loads(request.data)
    assert body["messages"] == [{"role": "system", "content": "be brief"}, {"role": "user", "content": "你好"}]
    assert (body["model"], body["max_tokens"], body["temperature"]) == ("m-1", 99, 0.3)
    with pytest.raises(P.ContentFiltered):
        P.complete(post, "p")
    with pytest.raises(OSError, match="120 s"):
        P.complete(post, "p", retries=0)
    quiet, asked = server((200, said))
    assert P.model_post("http://h/v4", "", "m", "", 1, quiet)("p")[0] == 200
    assert asked[0][0].get_header("Authorization") is None and asked[0][0].full_url == "http://h/v4/chat/completions"


def test_the_data_source_asks_for_pages_by_itself(spark, monkeypatch):
    answers = {"http://h/a": (200, "page"), "http://h/gone": (404, "")}
    monkeypatch.setattr(P, "get_page", lambda url: answers[url])
    reader = P.PageSource({"urls": "\n".join(answers), "rate": "100"}).reader(None)
    got = [(r[0], r[2], r[3]) for p in reader.partitions() for r in reader.read(p)]
    assert got == [("http://h/a", 200, "page"), ("http://h/gone", 404, None)]


def test_snapshots_of_fourteen_days_are_kept(spark, tmp_path):
    now, day = 1_000_000_000, 86400  # 2001-09-09
    one = {"backfill_meta": spark.createDataFrame([("k", 1)], "key string, value long")}
    for age in (30, 16, 15, 14, 13, 1):
        P.nightly_backup(spark, one, str(tmp_path), now - age * day, keep_days=99)
    gone = P.nightly_backup(spark, one, str(tmp_path), now)
    assert gone == ["2001-08-10", "2001-08-24", "2001-08-25"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["2001-08-26", "2001-08-27", "2001-09-08", "2001-09-09"]
    assert P.nightly_backup(spark, one, str(tmp_path), now + 60) == []  # one snapshot a day
    assert spark.read.parquet(str(tmp_path / "2001-09-09" / "backfill_meta")).count() == 1
