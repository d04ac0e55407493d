import pytest
from forumlens.plans import api
from forumlens.sources import adapter
from forumlens.sources import pages as P


def page_of(url):
    if url.endswith("gone"):
        return 404, ""
    return (500, "") if url.endswith("down") else (200, f"page {url}")


def test_retries():
    waits, answers = [], iter([(500, ""), OSError("x"), (200, "ok")])

    def get(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert P.fetch_with_retries(get, "u", sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(P.NotFound):
        P.fetch_with_retries(lambda _: (404, ""), "u")
    with pytest.raises(OSError, match="403"):
        P.fetch_with_retries(lambda _: (403, ""), "u", sleep=pytest.fail)


def test_completer_retries():
    waits, answers = [], iter([(429, "", 20.0), (500, "", None), (200, '{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":4,"completion_tokens":2}}', None)])
    assert P.complete(lambda _: next(answers), "p", sleep=waits.append, jitter=lambda: 0.5) == ("hi", 4, 2) and waits == [20.0, 30.5]
    with pytest.raises(P.ContentFiltered):
        P.complete(lambda _: (400, '{"code":"1301"}', None), "p")
    with pytest.raises(ValueError):
        P.complete(lambda _: (200, "{}", None), "p")
    assert [P.completions_url(u) for u in ("http://h:1", "https://h/paas/v4", "https://h/v1/chat/completions")] == [
        "http://h:1/v1/chat/completions", "https://h/paas/v4/chat/completions", "https://h/v1/chat/completions"]


def test_buckets_and_cache():
    now = [0.0]
    bucket = P.TokenBucket(2, clock=lambda: now[0])
    assert [bucket.delay() for _ in range(4)] == [0, 0, 0.5, 1.0]
    now[0] = 10
    assert [bucket.delay() for _ in range(3)] == [0, 0, 0.5]
    both = P.CombinedBucket(P.TokenBucket(10, clock=lambda: now[0]), P.TokenBucket(1, clock=lambda: now[0]))
    assert [both.delay() for _ in range(2)] == [0, 1.0]
    loads = iter([1, OSError(), 3])

    def load():
        v = next(loads)
        if isinstance(v, Exception):
            raise v
        return v

    cache = P.TTLCache(load, 5, clock=lambda: now[0])
    got = [cache.get(), cache.get()]
    now[0] += 6
    got.append(cache.get())
    now[0] += 6
    got.append(cache.get())
    assert got == [1, 1, 1, 3]
    with pytest.raises(OSError):
        P.TTLCache(lambda: (_ for _ in ()).throw(OSError()), 5).get()


def test_page_source(spark):
    spark.dataSource.register(P.PageSource)
    urls = "\n".join(["/a", "/gone", "/down", "/b"])
    import test_sources_api as me

    quick = P.fetch_with_retries.__defaults__
    P.fetch_with_retries.__defaults__ = (0, lambda s: None)
    try:
        reader = P.PageSource({"urls": urls, "fetcher": f"{me.__name__}:page_of", "urls_per_task": "2"}).reader(None)
        got = [r for p in reader.partitions() for r in reader.read(p)]
    finally:
        P.fetch_with_retries.__defaults__ = quick
    assert [(r[0], r[2]) for r in got] == [("/a", 200), ("/gone", 404), ("/down", 0), ("/b", 200)]


def test_routes(spark):
    t = adapter.tables(spark, "/root/testdata/sf0.01")
    now = adapter.NOW
    board = t["boards"].where("id = 7").first().name
    found = api.answer(t, f"/bbs/{board}/index.html", now)
    assert found["articles"].count() == 30 and found["articles"].agg({"place": "max"}).first()[0] == 30
    total = found["board"].first().articles
    pages = -(-total // 30)
    assert api.answer(t, f"/bbs/{board}/index{pages}.html", now)["articles"].collect() == found["articles"].collect()
    assert api.answer(t, f"/bbs/{board}/index1.html", now)["articles"].count() == total - 30 * (pages - 1)
    assert api.answer(t, f"/bbs/{board}/index{pages + 1}.html", now) is None
    assert api.answer(t, "/bbs/none/index.html", now) is None
    one = api.answer(t, "/a/33", now)["article"].first()
    assert api.answer(t, f"/bbs/{one.board}/{one.url_id}.html", now)["article"].first().id == 33
    assert api.answer(t, "/a/99999999", now) is None and api.answer(t, "/u/nobody", now) is None
    assert api.answer(t, "/u/7", now)["stats"].first().total > 0
    assert api.answer(t, "/search?q=BRAND%231", now)["entities"].count() > 0
    assert api.answer(t, "/e/nothing-like-it", now) is None
    assert api.answer(t, "/deleted?token=x", now) is None
    assert api.answer(t, "/deleted?token=x", now, deleted_token="x")["articles"].count() > 0
    for path in ("/", "/boards", "/trends", "/rising", "/digest", "/status", "/healthz", f"/b/{board}?page=2"):
        assert api.answer(t, path, now) is not None
    assert api.answer(t, "/what", now) is None


@pytest.mark.parametrize(
    "path,want",
    [("/healthz", "no-store"), ("/deleted", "no-store"), ("/static/a.css", "public, max-age=3600"), ("/trends", "public, s-maxage=600"),
     ("/rising", "public, s-maxage=60"), ("/e/x", "public, s-maxage=600"), ("/bbs/B/index.html", "public, s-maxage=60, stale-while-revalidate=120"),
     ("/bbs/B/M.1.A.2.html", "public, s-maxage=300, stale-while-revalidate=600"), ("/status", "public, max-age=30")],
)
def test_cache_policy(path, want):
    assert api.cache_policy(path) == want
