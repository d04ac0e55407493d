import os
import re

import duckdb
import pytest
from forumlens.plans import registry
from forumlens import schemas
from forumlens.operators import enrich, ingest
from forumlens.operators import state as S
from forumlens.streaming import ingest as SI
from pyspark.sql import functions as F
from test_html import ARTICLE, INDEX

NOW = 1_000_000_000


def rows(spark, name, *dicts):
    table = schemas.TABLES[name]
    fields = table.schema.names
    return spark.createDataFrame([tuple(d.get(f) for f in fields) for d in dicts], table.schema)


def listing(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_boards_round_trip(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    found = spark.createDataFrame([("Go", "A > Go", "t", 7), ("Ba", None, None, None)], "name string, category_path string, title string, user_count long")
    store.commit(boards=S.upsert_boards(store.read("boards"), found, NOW))
    once = listing(store.read("boards"), "name", "title", "user_count", "next_check_at", "id")
    assert [r[:4] for r in once] == [("Ba", None, None, NOW), ("Go", "t", 7, NOW)] and {r[4] for r in once} == {1, 2}
    go = once[1][4]
    store.commit(boards=S.upsert_boards(store.read("boards"), found, NOW))
    assert listing(store.read("boards"), "name", "title", "user_count", "next_check_at", "id") == once
    # a second sighting without a path writes null over it; the crawl state stays
    seen = spark.createDataFrame([("Go", 9)], "name string, user_count long")
    boards = S.mark_hot(S.upsert_boards(store.read("boards"), seen, NOW + 5), ["Go"], NOW + 5)
    assert listing(boards.where("name = 'Go'"), "category_path", "user_count", "is_hot", "next_check_at", "updated_at") == [(None, 9, True, NOW, NOW + 5)]
    boards, got = S.claim_due_board(boards, NOW + 10)
    assert got["name"] == "Go" and got["next_check_at"] == NOW + 610
    assert S.claim_due_board(boards, NOW + 10)[1] is None
    boards, got = S.claim_backfill_board(boards, 0, NOW)
    assert got["name"] == "Go" and S.claim_backfill_board(boards, 0, NOW)[1] is None
    assert S.claim_backfill_board(boards, 0, NOW + 21601)[1]["name"] == "Go"
    free, n = S.release_claims(boards, NOW)
    assert n.first().released == 1 and free.where("backfill_claimed_at is not null").isEmpty()
    done = S.complete_backfill(free, [go], NOW)
    assert listing(done.where(F.col("id") == go), "backfill_complete", "window_floor") == [(True, 0)]


def test_window_moves_only_when_all_have_reached_it(spark):
    meta = spark.createDataFrame([("window_bottom", 1000)], "key string, value long")
    for floors, want in (([900, 800], 900), ([900, 1100], 1000), ([900, None], 1000), ([], 1000)):
        boards = rows(spark, "boards", *({"id": i, "name": str(i), "is_hot": True, "backfill_complete": False, "window_floor": f} for i, f in enumerate(floors)))
        assert S.advance_window(boards, meta, 100).first().value == want


def test_article_upsert(spark):
    old = rows(spark, "articles", {"id": 1, "board_id": 1, "url_id": "a", "title": "old", "mark": "M", "posted_at": 5, "first_seen_at": 6, "deleted_at": 7, "ip": "1"})
    new = spark.createDataFrame([(1, "a", "new", None, 9, "X"), (1, "b", "b", None, 3, None)], "board_id long, url_id string, title string, ip string, posted_at long, mark string")
    out = S.upsert_articles(old, new, NOW)
    want = [(1, "a", "new", None, 5, "M", 6, None), (2, "b", "b", None, 3, None, NOW, None)]
    columns = ("id", "url_id", "title", "ip", "posted_at", "mark", "first_seen_at", "deleted_at")
    assert listing(out, *columns) == want
    assert listing(S.upsert_articles(out, new, NOW), *columns) == want
    assert schemas.duplicate_keys("articles", out).isEmpty()
    index = spark.createDataFrame([(1, "a", "9", None), (1, "zz", "1", "M")], "board_id long, url_id string, nrec_raw string, mark string")
    assert listing(S.update_from_index(out, index), "url_id", "nrec_raw", "mark") == [("a", "9", None), ("b", None, None)]
    gone = S.mark_deleted(out, index.select("board_id", "url_id"), NOW)
    assert listing(gone, "url_id", "deleted_at") == [("a", NOW), ("b", None)]
    assert listing(S.mark_deleted(gone, index, NOW + 1), "url_id", "deleted_at") == [("a", NOW), ("b", None)]
    assert listing(S.resurrect(gone, index), "url_id", "deleted_at") == [("a", None), ("b", None)]


def test_orphans(spark):
    t = {"boards": rows(spark, "boards", {"id": 1, "name": "x"}), "articles": rows(spark, "articles", {"board_id": 1}, {"board_id": 2})}
    assert listing(schemas.orphans("articles", t), "column", "value") == [("board_id", "2")]


def test_insights_and_entities(spark):
    insights = rows(spark, "article_insights", {"article_id": 1, "tldr": "old", "key_points": "k", "schema_ver": 1, "generated_at": 1})
    errors = spark.createDataFrame([(1, "x" * 400), (2, "boom")], "article_id long, error string")
    out = S.mark_insight_errors(insights, errors, NOW)
    assert listing(out, "article_id", "tldr", "schema_ver", "generated_at") == [(1, "old", 1, NOW), (2, "(分析失敗)", 1, NOW)]
    assert out.where("length(error) = 300").count() == 1
    named = '[{"name":"ＦＧＯ","type":""},{"name":"fgo","type":"遊戲"},{"name":" "},null,{"name":7}]'
    results = spark.createDataFrame([(1, "new", named)], "article_id long, tldr string, entities string")
    out = S.store_insights(out, results, NOW)
    assert listing(out.where("article_id = 1"), "tldr", "key_points", "schema_ver", "error") == [("new", "k", 2, None)]
    refs = S.sync_entity_refs(rows(spark, "entity_refs", {"name_norm": "old", "article_id": 1}, {"name_norm": "z", "article_id": 9}), out.where("article_id = 1"))
    assert listing(refs, "name_norm", "name", "kind", "article_id")[0] == ("fgo", "ＦＧＯ", "其他", 1)
    assert refs.count() == 2


def test_runs_digests_audits(spark):
    runs = S.start_run(rows(spark, "crawl_runs"), 1, 2, "backfill", NOW)
    runs = S.finish_run(runs, 1, "completed", NOW + 3, articles_new=4)
    assert listing(runs, "status", "articles_new", "finished_at") == [("completed", 4, NOW + 3)]
    d = rows(spark, "board_digests", {"board_id": 1, "day": "d", "digest": "a"})
    assert listing(S.store_digests(d, rows(spark, "board_digests", {"board_id": 1, "day": "d", "digest": "b"})), "digest") == [("b",)]
    a = rows(spark, "deletion_audits", {"board_id": 1, "url_id": "u", "result": "gone"})
    assert listing(S.record_audits(a, rows(spark, "deletion_audits", {"board_id": 1, "url_id": "u", "result": "alive"})), "result") == [("alive",)]


ENTRY = "board_id long, page int, url_id string, url_timestamp long, deleted boolean, mark string, nrec_raw string"


def entries(spark, page, *times, pinned=()):
    every = [(1, page, f"M.{t}.A.X", t, False, "!" if t in pinned else "", "") for t in times]
    return spark.createDataFrame(every or [(1, page, "", None, True, "", "")], ENTRY)


def stored(spark, *times):
    return rows(spark, "articles", *({"id": t, "board_id": 1, "url_id": f"M.{t}.A.X", "url_timestamp": t} for t in times))


def test_vanish_guards(spark):
    none = spark.createDataFrame([], "board_id long, url_id string, status int")
    dead = spark.createDataFrame([(1, f"M.{t}.A.X", 404) for t in range(1, 400)], none.schema)
    run = lambda first, again, prev, status=dead, times=(10, 20, 30, 40): [
        r.url_id for r in ingest.vanished(stored(spark, *times), first, again, prev, status).collect()
    ]
    page, before = entries(spark, 2, 20, 40), entries(spark, 1, 5, 10)
    assert run(page, page, before) == ["M.30.A.X"]
    assert run(page, page, before, none) == []  # not known to be gone
    assert run(page, entries(spark, 2, 20, 30, 40), before) == []  # back on the second look
    assert run(entries(spark, 2, 20, 30, 40), page, before) == []  # nothing was missing at first
    assert run(entries(spark, 2, 20), entries(spark, 2, 20), before) == []  # newer than the page: the page is stale
    assert run(page, page, entries(spark, 1, 5, 30)) == []  # merely scrolled to the page before
    assert run(page, page, entries(spark, 1, 5, 35)) == []  # older than what the newest page must show
    assert run(page, page, entries(spark, 1)) == []  # the page before judges nothing
    assert run(page, page, entries(spark, 1).limit(0)) == []  # nor does one that wasn't fetched
    assert run(page, page, entries(spark, 0)) == ["M.30.A.X"]  # the board has one page
    assert run(entries(spark, 2), entries(spark, 2), before) == []  # an empty page
    pinned = entries(spark, 2, 1, 300, pinned=(1,))
    assert run(pinned, pinned, entries(spark, 1, 60, 70), times=range(2, 60)) == []  # an old pinned entry doesn't reach further
    many = entries(spark, 2, 100, 399)
    assert run(many, many, before, times=range(100, 400)) == []  # too many at once
    assert len(run(many, many, before, times=range(300, 400))) == 99


def test_actions_and_intervals(spark):
    known = rows(spark, "articles", {"id": 1, "board_id": 1, "url_id": "M.10.A.X", "nrec_raw": None, "deleted_at": 3}, {"id": 2, "board_id": 1, "url_id": "M.20.A.X", "nrec_raw": "5", "mark": "M"})
    actions = ingest.entry_actions(entries(spark, 1, 10, 20, 30), known)
    assert listing(actions, "url_id", "insert", "resurrect", "refetch", "update_meta") == [
        ("M.10.A.X", False, True, False, False), ("M.20.A.X", False, False, True, True), ("M.30.A.X", True, False, False, False)]
    boards = rows(spark, "boards", {"id": 1, "name": "a", "check_interval_secs": 600}, {"id": 2, "name": "b", "check_interval_secs": 600})
    assert listing(ingest.next_intervals(boards, actions, NOW), "board_id", "check_interval_secs") == [(1, 120)]
    assert listing(ingest.next_intervals(boards, actions.where("not insert"), NOW), "board_id", "check_interval_secs") == [(1, 1200)]


def test_audit_and_backfill(spark):
    due = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "board_id long, url_id string")
    status = spark.createDataFrame([(1, "a", 200), (1, "b", 404), (1, "c", 503)], "board_id long, url_id string, status int")
    assert listing(ingest.audit_results(due, status, NOW), "url_id", "result") == [("a", "alive"), ("b", "gone")]
    assert [ingest.backfill_pages(1, 9, 3), ingest.backfill_pages(5, 9, 0), ingest.backfill_pages(3, 9, 5), ingest.backfill_pages(30, 9, 2)] == [(9, 7), (4, 1), (2, 1), (9, 8)]
    pages = entries(spark, 3, 300, 310).unionByName(entries(spark, 2, 200, 5, pinned=(5,))).unionByName(entries(spark, 1, 100))
    columns = ("last_backfill_page", "window_floor", "complete", "at_boundary")
    assert listing(ingest.backfill_step(pages, 250, 3, 1), *columns) == [(2, 200, False, True)]
    assert listing(ingest.backfill_step(pages, 0, 3, 1), *columns) == [(1, 0, True, False)]
    assert listing(ingest.backfill_step(pages.where("page > 1"), 0, 3, 2), *columns) == [(2, 200, False, False)]


def test_discovery(spark):
    link = '<div class="b-ent"><a class="board" href="{}"><div class="board-name">{}</div><div class="board-nuser">{}</div></a></div>'
    site = {
        "/cls/1": link.format("/cls/2", "A", 0) + link.format("/bbs/X/index.html", "X", 3),
        "/cls/2": link.format("/cls/1", "back", 0) + link.format("/bbs/Y/index.html", "Y", 0) + link.format("/cls/9", "lost", 0),
    }
    pages = lambda urls: spark.createDataFrame([(u, site[u]) for u in urls if u in site], "url string, body string")
    assert listing(ingest.discover(pages), "name", "user_count", "category_path") == [("X", 3, "X"), ("Y", None, "A > Y")]


def test_discovery_goes_on_and_is_stored_with_hot_flags(spark, tmp_path):
    from test_html import BOARDS

    link = '<div class="b-ent"><a class="board" href="{}"><div class="board-name">{}</div><div class="board-nuser">{}</div></a></div>'
    site = {
        "/cls/1": link.format("/cls/2", "A", 0) + link.format("/cls/3", "B", 0),
        "/cls/2": link.format("/bbs/X/index.html", "X", 3) + link.format("/cls/4", "deep", 0) + link.format("/bbs/Go/index.html", "Go", 1),
        "/cls/3": link.format("/bbs/X/index.html", "X", 4) + link.format("/cls/4", "deep", 0),
        "/cls/4": link.format("/bbs/Z/index.html", "Z", 9),
    }
    asked = []

    def pages(urls, lost=()):
        asked.extend(urls)
        if set(urls) & set(lost):
            raise OSError("the driver is lost")
        return spark.createDataFrame([(u, site[u]) for u in urls if u in site], "url string, body string")

    hot = spark.createDataFrame([(BOARDS,)], "body string")
    folder = str(tmp_path / "walk")
    with pytest.raises(OSError):
        ingest.discover(lambda urls: pages(urls, ["/cls/4"]), folder=folder)
    asked.clear()
    found = ingest.discover(pages, folder=folder, hot=hot)
    assert asked == ["/cls/4"]  # the levels that were complete are read
    want = [("Cat", None, None, True), ("Go", 731, "A > Go", True), ("X", 3, "A > X", False), ("Z", 9, "A > deep > Z", False)]
    assert listing(found, "name", "user_count", "category_path", "is_hot") == want
    store = S.Store(spark, str(tmp_path / "store"))
    assert ingest.discover_into(store, pages, hot, NOW) == ingest.discover_into(store, pages, hot, NOW + 1) == 4
    assert listing(store.read("boards"), "name", "user_count", "category_path", "is_hot") == want
    assert len({r.id for r in store.read("boards").collect()}) == 4
    with pytest.raises(Exception, match="no boards"):
        ingest.hot_listed(spark.createDataFrame([("<p>",)], "body string")).collect()


def test_pages_are_ingested_by_a_stream(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "store"))
    store.commit(boards=S.upsert_boards(store.read("boards"), spark.createDataFrame([("B",)], "name string"), NOW))
    landed = [("/bbs/B/M.1402207451.A.1F2.html", 1, 200, ARTICLE), ("/bbs/B/index.html", 1, 200, INDEX), ("/bbs/B/M.2.A.0.html", 1, 404, None), ("/bbs/Z/M.3.A.0.html", 1, 200, ARTICLE)]
    from forumlens.sources import pages as P

    spark.createDataFrame(landed, P.LANDED).write.parquet(str(tmp_path / "pages"))
    for _ in range(2):
        SI.ingest_pages(P.landed_stream(spark, str(tmp_path / "pages")), store, str(tmp_path / "cp"), lambda: NOW).awaitTermination()
    SI.apply_article_pages(store, P.landed_pages(spark, str(tmp_path / "pages")), NOW)
    assert listing(store.read("articles"), "id", "title", "author", "posted_at", "net_count", "ip") == [(1, "Hello", "someone", 1402207451, 0, "192.0.2.7")]
    assert listing(store.read("pushes"), "article_id", "seq", "tag") == [(1, 0, "推"), (1, 1, "噓"), (1, 2, "→")]
    assert schemas.orphans("pushes", store.tables()).isEmpty()


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.unionByName(events.limit(50)).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    def drained(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counted = drained(SI.daily_counts(stream), "complete", "counted")
    assert listing(counted, "day", "event_type", "n") == listing(SI.daily_counts(spark.read.parquet(str(tmp_path / "e"))), "day", "event_type", "n")
    assert drained(SI.without_repeats(stream), "append", "once").count() == events.count()


def test_enrichment(spark, tmp_path):
    queue = spark.createDataFrame([(1, "T", "a", "text", []), (2, "bad", None, None, []), (3, "no", None, None, [])],
                                  "id long, title string, author string, content string, pushes array<struct<seq:long,tag:string,user_id:string,content:string>>")

    def completer(prompt):
        from forumlens.sources.pages import ContentFiltered

        if "標題：bad" in prompt:
            return "not json", 1, 1
        if "標題：no" in prompt:
            raise ContentFiltered("x")
        return enrich.stub_completer(prompt)

    enrich.analyze(enrich.with_prompts(queue), completer).write.parquet(str(tmp_path / "a"))
    good, bad = enrich.answers_and_errors(spark.read.parquet(str(tmp_path / "a")))
    assert listing(good, "article_id", "tldr", "sentiment") == [(1, "about T", "正面")]
    errors = dict(listing(bad, "article_id", "error"))
    assert errors[3] == "content_filter" and errors[2].startswith("parse llm output")
    out = S.store_insights(rows(spark, "article_insights"), good, NOW)
    assert listing(S.entity_refs_of(out), "name_norm", "article_id") == [("t", 1)]
    prompts = spark.createDataFrame([(1, 3, "p"), (2, 4, "")], "board_id long, article_count long, prompt string")
    made = enrich.digests(prompts, "2001-01-01", NOW, lambda p: (p, 1, 1))
    assert listing(made, "board_id", "digest") == [(1, "p")]


def test_missing_tables_are_made_once(spark, tmp_path):
    assert len(schemas.create_missing(spark, str(tmp_path))) == len(schemas.TABLES)
    assert schemas.create_missing(spark, str(tmp_path)) == []


def test_a_commit_shows_all_or_nothing(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "s"))
    meta = lambda v: spark.createDataFrame([("k", v)], "key string, value long")
    assert store.versions() == {} and store.read("backfill_meta").count() == 0
    assert store.commit(backfill_meta=meta(1)) == 1
    base = store.version()
    # a driver that is lost after writing tables or a draft leaves the version before in place
    meta(9).write.parquet(str(tmp_path / "s" / "backfill_meta" / "v2-lost"))
    (tmp_path / "s" / "_draft-lost").write_text("{")
    assert listing(store.read("backfill_meta"), "value") == [(1,)]
    assert store.commit(base, backfill_meta=meta(2)) == 2
    with pytest.raises(S.Conflict):
        store.commit(base, backfill_meta=meta(3))
    assert listing(store.read("backfill_meta"), "value") == [(2,)]
    store.commit(entity_aliases=spark.createDataFrame([("a", "b")], "alias string, canonical string"))
    store.commit(backfill_meta=meta(5))
    assert listing(store.read("backfill_meta"), "value") == [(5,)] and store.read("entity_aliases").count() == 1
    assert len(store._pointers()) == S.Store.KEEP


def test_hot_list(spark):
    from test_html import BOARDS

    boards = S.upsert_boards(rows(spark, "boards"), spark.createDataFrame([("Cat", "A > Cat", "x", 5)], "name string, category_path string, title string, user_count long"), 1)
    out = ingest.apply_hot_list(boards, spark.createDataFrame([(BOARDS,)], "body string"), NOW)
    assert listing(out, "name", "is_hot", "user_count", "category_path") == [("Cat", True, 0, "A > Cat"), ("Go", True, 731, None)]


def test_all_deletions_are_audited_without_a_sort(spark):
    """The query asks for every due deletion: nothing is ordered or gathered in one task for that."""
    plan = registry.QUERIES["audit_results"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort [deleted_at" not in plan


def test_entity_rows_are_made_in_partitions_of_bounded_input(spark, monkeypatch):
    """The number of partitions follows the size of the pushes' file, not the cores; the rows stay those of the view."""
    from forumlens.sources import adapter

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapter, "PART_BYTES", 1 << 14)
    refs = adapter.tables(spark, sf)["entity_refs"]
    n = int(re.search(r"RepartitionByExpression \[article_id[^]]*\], (\d+)", refs._jdf.queryExecution().optimizedPlan().toString())[1])
    assert n == -(-os.path.getsize(f"{sf}/lineitem.parquet") // (1 << 14)) > 1
    con = duckdb.connect()
    for name in ("nation", "orders", "lineitem", "customer", "part"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(adapter.oracle("select name_norm, name, kind, article_id from entity_refs")).fetchall()
    assert sorted(map(tuple, refs.select("name_norm", "name", "kind", "article_id").collect())) == sorted(want)
