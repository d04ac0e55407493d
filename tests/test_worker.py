import json
import threading
import time

import pandas as pd
import pytest
from forumlens.operators import enrich, loops, pool, worker
from forumlens.operators import state as S
from forumlens.streaming import queue as Q
from forumlens.streaming import service
from pyspark.sql import functions as F
from test_state import NOW, listing, rows

EVENTS = "article_id long, at long, weight long"


# pool and loops


def test_never_more_calls_than_the_limit_and_results_in_order():
    lock, running, most = threading.Lock(), [0], [0]

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.002 * (i % 5))
        with lock:
            running[0] -= 1
        if i % 10 == 3:
            raise OSError(f"no {i}")
        return i * i

    for limit in (1, 3, 8):
        most[0] = 0
        got = list(pool.bounded(call, iter(range(60)), limit))
        assert most[0] <= limit and (limit == 1 or most[0] > 1)
        assert [v for v, _ in got] == [None if i % 10 == 3 else i * i for i in range(60)]
        assert [str(e) for _, e in got if e] == [f"no {i}" for i in range(3, 60, 10)]
    assert list(pool.bounded(call, [], 3)) == []


def test_items_are_taken_as_they_are_needed_and_a_stop_begins_no_more():
    taken, stop = [], threading.Event()

    def items():
        for i in range(1000):
            taken.append(i)
            yield i

    found = pool.bounded(lambda i: i, items(), 2, stop)
    assert next(found) == (0, None) and len(taken) <= 4
    stop.set()
    rest = list(found)
    assert len(rest) <= 3 and len(taken) <= 6


def steps(*results):
    left = list(results)

    def step():
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    return step, left


class Clock:
    """Simulated time; stops after ``until``."""

    def __init__(self, now, until):
        self.now, self.until, self.waits = now, until, []

    def __call__(self, seconds):
        if seconds:
            self.waits.append(seconds)
        self.now += seconds
        return self.now < self.until


def test_loops():
    step, left = steps(2, 0, RuntimeError("x"), 1, 0, 0)
    clock = Clock(0, 100)
    loops.continuous(step, clock)
    assert clock.waits == [30, 30, 30, 30] and left == []
    step, left = steps(1, 0, 5)
    clock = Clock(0, 1200)
    loops.scheduled(step, clock, 600)
    assert clock.waits == [600, 600] and left == [5]
    monday = 1_000_080_000 // 86400 * 86400 - 8 * 3600  # 2001-09-10 00:00 in UTC+8
    assert [loops.peak_seconds_left(monday + h * 3600) for h in (13, 14, 17, 18)] == [0, 14400, 3600, 0]
    assert loops.peak_seconds_left(monday - 86400 + 15 * 3600) == loops.peak_seconds_left(monday + 5 * 86400 + 15 * 3600) == 0
    step, left = steps(1, 0, 3)
    clock = Clock(monday + 14 * 3600 - 10, monday + 18 * 3600 + 5)

    def counted():
        clock.now += 5
        return step()

    loops.off_peak(counted, clock, lambda: int(clock.now))
    assert clock.waits == [30, 14370] and left == []
    waiter = loops.Waiter()
    threading.Timer(0.05, waiter.stop).start()
    assert waiter(0) and not waiter(30)


def test_peak_hours_equal_those_of_the_columns(spark):
    from forumlens.functions import text as X

    times = [1_000_000_000 + 1801 * i for i in range(400)]
    df = spark.createDataFrame([(t,) for t in times], "t long")
    assert {r.t: r.p for r in df.select("t", X.is_peak(F.col("t")).alias("p")).collect()} == {t: loops.peak_seconds_left(t) > 0 for t in times}


# worker


def forum(spark, root, n=6):
    store = S.Store(spark, str(root))
    made = [
        {"id": i, "board_id": 1, "url_id": f"u{i}", "title": f"T{i}", "author": "a", "content": "long enough content " * 3, "net_count": 30 + i, "posted_at": NOW - 1000, "last_fetched_at": NOW - 500}
        for i in range(1, n + 1)
    ]
    store.commit(boards=rows(spark, "boards", {"id": 1, "name": "B", "is_hot": True}, {"id": 2, "name": "C", "is_hot": True}), articles=rows(spark, "articles", *made))
    return store


@pytest.fixture
def sent_by_value():
    """Lets executors have the test's own functions."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def counting(folder, bad=("T2",), declined=("T3",)):
    def complete(prompt):
        import os
        import time
        import uuid

        from forumlens.operators import enrich
        from forumlens.sources.pages import ContentFiltered

        mine = os.path.join(folder, uuid.uuid4().hex)
        open(mine, "w").close()
        with open(folder + "-most", "a") as f:
            f.write(f"{len(os.listdir(folder))}\n")
        time.sleep(0.05)
        os.remove(mine)
        if any(t in prompt for t in bad):
            raise RuntimeError("connection reset")
        if any(t in prompt for t in declined):
            raise ContentFiltered("no")
        return enrich.stub_completer(prompt)

    return complete


def test_a_batch_of_analyses(spark, tmp_path, sent_by_value):
    store = forum(spark, tmp_path / "s")
    calls = tmp_path / "calls"
    calls.mkdir()
    complete = counting(str(calls))
    assert worker.analyse_batch(store, complete, "m", NOW, concurrency=3) == 0  # there were failures
    most = [int(x) for x in (tmp_path / "calls-most").read_text().split()]
    assert max(most) <= 3 and len(most) == 6
    found = listing(store.read("article_insights"), "article_id", "tldr", "error")
    assert found[0] == (1, "about T1", None) and [r[2] for r in found] == [None, "connection reset", "content_filter", None, None, None]
    assert listing(store.read("entity_refs"), "name_norm", "article_id") == [(f"t{i}", i) for i in (1, 4, 5, 6)]
    assert worker.analyse_batch(store, complete, "m", NOW + 10) == 0  # nothing is waiting
    assert len((tmp_path / "calls-most").read_text().split()) == 6
    assert worker.analyse_filtered(store, enrich.stub_completer, "other", NOW + 20) == 1
    assert listing(store.read("article_insights").where("article_id = 3"), "tldr", "model", "error") == [("about T3", "other", None)]
    assert worker.analyse_batch(store, enrich.stub_completer, "m", NOW + 7200) == 1  # the failed one, after its hour


def test_digests_are_made_once_a_day(spark, tmp_path, sent_by_value):
    store = forum(spark, tmp_path / "s")
    worker.analyse_batch(store, enrich.stub_completer, "m", NOW - 100)

    def failing(prompt):
        raise OSError("down")

    def blank(prompt):
        return "  ", 1, 1

    def good(prompt):
        return f"digest of {prompt[:5]}", 7, 8

    assert worker.daily_digests(store, failing, "m", NOW) == worker.daily_digests(store, blank, "m", NOW) == 0
    assert store.read("board_digests").count() == 0
    assert worker.daily_digests(store, good, "m", NOW) == 1
    assert worker.daily_digests(store, good, "m", NOW + 60) == 0
    assert listing(store.read("board_digests"), "board_id", "day", "digest", "article_count", "prompt_tokens") == [(1, "2001-09-09", "digest of 看板：B", 6, 7)]
    version = store.version()
    assert worker.daily_digests(store, good, "m", NOW + 90) == 0 and store.version() == version


def test_two_runs_store_one_digest(spark, tmp_path, sent_by_value):
    store = forum(spark, tmp_path / "s")
    worker.analyse_batch(store, enrich.stub_completer, "m", NOW - 100)

    def good(prompt):
        return "d", 1, 1

    stored = []
    threads = [threading.Thread(target=lambda: stored.append(worker.daily_digests(S.Store(spark, store.root), good, "m", NOW))) for _ in range(2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(stored) == [0, 1] and store.read("board_digests").count() == 1


def test_prompts_count_the_pushes_that_they_leave_out(spark):
    from forumlens.operators import reads

    pushes = spark.createDataFrame([(1, i, "推", "u", f"c{i}", "") for i in range(7)], "article_id long, seq long, tag string, user_id string, content string, ipdatetime string")
    queue = spark.createDataFrame([(1, "T", "a", "x")], "id long, title string, author string, content string")
    cut = queue.join(reads.first_pushes(pushes, 3).withColumnRenamed("article_id", "id"), "id")
    text = enrich.with_prompts(cut).first().prompt
    assert "共 7 則" in text and "c2" in text and "c3" not in text


# queue as a stream


def lots():
    first = [(1, 100, 15), (2, 100, 30), (3, 100, 5), (4, 100, None)]
    second = [(1, 110, 10), (2, 120, -20), (3, 90, 5), (5, 50, 20), (2, 130, None), (2, 140, 1)]
    late = [(3, 10, 11), (2, 20, 9), (1, 5, -1), (5, 40, -1), (4, 99, 50), (4, 101, 2)]
    return first, second, late


def run_stream(spark, folder, out):
    stream = spark.readStream.schema(EVENTS).parquet(str(folder))

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/changes/{number}")

    writer = Q.queue_changes(stream, gap=0).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
    with Q.ending_queries(spark):
        assert writer.trigger(availableNow=True).start().awaitTermination(60)


def test_late_comments_count_like_others_across_a_restart(spark, tmp_path):
    seen = []
    for k, lot in enumerate(lots()):
        spark.createDataFrame(lot, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        run_stream(spark, tmp_path / "events", tmp_path)  # a restart each time
        seen += lot
        changes = spark.read.schema(Q.CHANGES).parquet(*(str(p) for p in (tmp_path / "changes").iterdir()))
        status = Q.queue_status(spark.createDataFrame(seen, EVENTS), NOW, gap=0)
        wanted = [r.article_id for r in status.where("wanted").orderBy("article_id").collect()]
        assert [r.article_id for r in Q.wanted_articles(changes).orderBy("article_id").collect()] == wanted
        stale = {r.article_id for r in status.where("stale").collect()}
        assert {r.article_id for r in changes.where("event = 'stale'").collect()} == stale
    assert wanted == [1, 2, 3, 4] and stale == {2, 4}


def test_timers_tell_what_becomes_stale_and_state_is_forgotten(spark, tmp_path):
    """In a running stream: an article becomes stale by a timer, and a total is lost after its time to live."""
    now = int(time.time())
    (tmp_path / "events").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events"))
    got = []
    query = (
        Q.queue_changes(stream, gap=now + 15 - 50, ttl=3600).writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    )

    def add(*events):
        spark.createDataFrame(list(events), EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    def until(done, seconds=40):
        end = time.monotonic() + seconds
        while not done() and time.monotonic() < end:
            time.sleep(0.2)
        assert done()

    try:
        add((7, 50, None), (7, 60, 25))  # analysed at 50, stale at now + 15
        until(lambda: got)
        assert [(g[0], g[2]) for g in got] == [(7, "entered")] or time.time() > now + 15
        until(lambda: len(got) == 2)
        assert got[1][:3] == (7, 25, "stale") and time.time() >= now + 15
    finally:
        query.stop()


def test_an_article_without_news_is_forgotten(spark, tmp_path):
    totals = []
    for weight in (15, 10):
        spark.createDataFrame([(1, 5, weight)], EVENTS).write.mode("append").parquet(str(tmp_path / "events"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events"))
        out = Q.queue_changes(stream, ttl=1).writeStream.foreachBatch(lambda b, n: totals.extend(b.collect())).outputMode("update")
        with Q.ending_queries(spark):
            assert out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        time.sleep(2)
    assert totals == []  # 15 and 10 would have reached 20


# running streams


def test_heartbeats_are_written_at_intervals(spark):
    now, beats = [0.0], []
    heart = service.Heartbeat(lambda: {"articles": 3}, beats.append, 60, lambda: now[0])
    for at, n in ((0, 5), (30, 2), (61, 4), (70, 1), (130, 0)):
        now[0] = at
        heart.saw(n)
    assert [json.loads(b) for b in beats] == [{"at": a, "rows": r, "batches": b, "articles": 3} for a, r, b in ((0, 5, 1), (61, 11, 3), (130, 12, 5))]
    broken = service.Heartbeat(lambda: 1 / 0, beats.append)
    broken.saw(1)
    assert len(beats) == 3 and "division" in broken.failed


def test_a_listener_hears_a_stream(spark, tmp_path):
    beats = []
    heart = service.Heartbeat(lambda: {}, beats.append, 0)
    spark.createDataFrame([(1, 1, 1)] * 4, EVENTS).write.parquet(str(tmp_path / "e"))
    spark.streams.addListener(heart)
    try:
        out = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "e")).writeStream.foreachBatch(lambda b, n: b.count())
        out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        end = time.monotonic() + 20
        while heart.rows < 4 and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heart)
    assert heart.rows == 4 and json.loads(beats[-1])["rows"] == 4


def test_a_stop_ends_the_batch_in_hand_and_frees_claims(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    store.commit(boards=rows(spark, "boards", {"id": 1, "name": "B", "backfill_claimed_at": 5}, {"id": 2, "name": "C"}))
    for i in range(6):
        spark.createDataFrame([(i, i, 1)], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    begun, ended = [], []

    def apply(batch, number):
        ids = [r.article_id for r in batch.collect()]
        begun.extend(ids)
        time.sleep(1.0)
        ended.extend(ids)

    def start(handler, **trigger):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
        return stream.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "cp")).trigger(**trigger).start()

    handler = service.GracefulStop(apply)
    query = start(handler, processingTime="0 seconds")
    end = time.monotonic() + 30
    while not begun and time.monotonic() < end:
        time.sleep(0.05)
    assert handler.stop(query, store, NOW) == 1
    assert begun == ended and 1 <= len(ended) < 6 and not query.isActive
    assert store.read("boards").where("backfill_claimed_at is not null").isEmpty()
    assert service.release_orphans(store, NOW) == 0
    start(service.GracefulStop(apply), availableNow=True).awaitTermination(60)
    assert sorted(set(ended)) == list(range(6)) and len(ended) <= 7  # the last batch of the stop may be run again


def test_a_bucket_of_articles_is_read_and_written_once():
    """All articles of a bucket are worked on together: one update of state, whatever their number."""
    frame = pd.DataFrame({"article_id": [1, 2, 3, 1], "at": [5, 5, 5, 6], "weight": [25, 3, None, -10]})
    kept, clock = [], type("T", (), {"getCurrentProcessingTimeInMs": lambda self: 10_000})()
    state = type("S", (), {"exists": lambda self: bool(kept), "get": lambda self: kept[-1], "update": lambda self, v: kept.append(v)})()
    p = Q.QueueState(20, 3600, 100)
    p.handle, p.state = None, state
    assert [len(f) for f in p.handleInputRows((0,), iter([frame]), clock)] == [0]
    more = pd.DataFrame({"article_id": [1, 2], "at": [7, 7], "weight": [5, 17]})
    out = pd.concat(list(p.handleInputRows((0,), iter([more]), clock)))
    assert len(kept) == 2 and out[["article_id", "net", "event", "number"]].values.tolist() == [[1, 20, "entered", 3], [2, 20, "entered", 2]]
