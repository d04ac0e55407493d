import json
import os
import threading
import time

import pytest
from forumlens import schemas
from forumlens.operators import migrations, reads
from forumlens.operators import state as S
from forumlens.sources import adapter
from forumlens.streaming import ingest as SI
from pyspark.sql import functions as F
from test_html import ARTICLE
from test_state import NOW, listing, rows

SF = "/root/testdata/sf0.01"


def meta(spark, value, key="k"):
    return spark.createDataFrame([(key, value)], "key string, value long")


def stored(t, name):
    """The adapter's rows with every column of the stored table."""
    df = t[name]
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name].schema))


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    t = adapter.tables(spark, SF)
    store = S.Store(spark, str(tmp_path_factory.mktemp("full")))
    store.commit(**{name: stored(t, name) for name in ("boards", "articles", "pushes")})
    return store, t


def test_ten_keys_rewrite_ten_buckets(spark, full):
    store, t = full
    before = store.parts("articles")
    pushes = store.parts("pushes")
    assert len(before) == 64
    ten = spark.createDataFrame([(r.board_id, r.url_id, "edited") for r in t["articles"].orderBy("id").limit(9).collect()] + [(3, "M.1.A.NEW", "new")], "board_id long, url_id string, title string")
    want = S.upsert_articles(stored(t, "articles"), ten, NOW)
    written = store.retry(lambda c: c.update("articles", ten, lambda old: S.upsert_articles(old, ten, NOW, c.top("articles"))).count())
    after = store.parts("articles")
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 10 and store.parts("pushes") == pushes
    folder = os.path.join(store.root, "articles", after[changed[0]].split("/")[0])
    assert sum(n.startswith("_bucket=") for n in os.listdir(folder)) == len(changed)
    files = [f for b in changed for f in os.listdir(os.path.join(store.root, "articles", after[b])) if f.endswith(".parquet")]
    assert len(files) == len(changed)
    assert written < 0.3 * want.count()
    columns = ("id", "board_id", "url_id", "title", "net_count", "deleted_at", "last_fetched_at")
    assert listing(store.read("articles"), *columns) == listing(want, *columns)
    some = ten.select("board_id", "url_id")
    own = store.read_keys("articles", some)
    assert own.join(some, ["board_id", "url_id"]).count() == 10 and len(own.inputFiles()) == len(changed)


def test_replaced_pushes_rewrite_their_buckets(spark, full):
    store, t = full
    touched = spark.createDataFrame([(r.id,) for r in t["articles"].orderBy("id").limit(5).collect()], "article_id long")
    fresh = touched.select("article_id", F.lit(0).cast("long").alias("seq"), F.lit("推").alias("tag"), F.lit("me").alias("user_id"), F.lit("x").alias("content"), F.lit("").alias("ipdatetime"))
    before = store.parts("pushes")
    want = S.replace_pushes(store.read("pushes"), fresh, touched)
    expected = listing(want, "article_id", "seq", "user_id")
    store.retry(lambda c: c.update("pushes", touched, lambda old: S.replace_pushes(old, fresh, touched)))
    after = store.parts("pushes")
    assert listing(store.read("pushes"), "article_id", "seq", "user_id") == expected
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 5


def rows_read(df):
    """Rows of the row groups that a filtered scan reads."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_user_is_looked_up_in_few_row_groups(spark, full, tmp_path):
    t = full[1]
    store = S.Store(spark, str(tmp_path), {"articles": 4, "pushes": 4}, {"parquet.block.size": "16384"})
    store.commit(**{name: stored(t, name) for name in ("boards", "articles", "pushes")})
    pushes, articles = store.read("pushes"), store.read("articles")
    user, total = "7", pushes.count()
    assert rows_read(pushes.where(F.col("user_id") == user)) < 0.25 * total
    assert rows_read(pushes.where(F.col("user_id") == "nobody here")) == 0  # the Bloom filters
    assert rows_read(articles.where(F.col("author") == "7x")) == 0
    own = {name: store.read(name) for name in ("boards", "articles", "pushes")}
    plain = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in own.items()}
    assert reads.user_pushes(own, user).collect() == reads.user_pushes(plain, user).collect()


def test_rows_outside_the_named_keys_are_refused(spark, tmp_path):
    store = S.Store(spark, str(tmp_path), buckets={"backfill_meta": 16})
    store.commit(backfill_meta=meta(spark, 1))
    with pytest.raises(ValueError):
        store.retry(lambda c: c.update("backfill_meta", meta(spark, 1), lambda old: old.unionByName(meta(spark, 2, "other"))))
    assert listing(store.read("backfill_meta"), "key") == [("k",)]
    store.retry(lambda c: c.update("backfill_meta", meta(spark, 1), lambda old: old.where("false")))
    assert store.read("backfill_meta").count() == 0 and store.parts("backfill_meta") == {}


def test_ids_go_on_over_batches(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    for k in range(3):
        found = spark.createDataFrame([(1, f"u{i}") for i in range(5 * k, 5 * k + 8)], "board_id long, url_id string")
        store.retry(lambda c: c.update("articles", found, lambda old: S.upsert_articles(old, found, NOW, c.top("articles"))))
    ids = [r.id for r in store.read("articles").collect()]
    assert len(ids) == 18 and sorted(ids) == list(range(1, 19))


def test_concurrent_changes_lose_nothing(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.commit(backfill_meta=meta(spark, 0))
    errors = []

    def add():
        def one(c):
            c.update("backfill_meta", meta(spark, 0), lambda old: old.withColumn("value", F.col("value") + 1))

        try:
            S.Store(spark, store.root).retry(one, attempts=20)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert errors == [] and listing(store.read("backfill_meta"), "value") == [(4,)]


def test_a_pointer_that_was_left_half_written(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.commit(backfill_meta=meta(spark, 1))
    left = tmp_path / "_current-2"
    left.write_text('{"tables"')
    assert store.version() == 1 and listing(store.read("backfill_meta"), "value") == [(1,)]
    with pytest.raises(S.Conflict):  # it may still be completed
        store.commit(backfill_meta=meta(spark, 2))
    long_ago = time.time() - 1000
    os.utime(left, (long_ago, long_ago))
    assert store.commit(backfill_meta=meta(spark, 2)) == 3
    assert listing(store.read("backfill_meta"), "value") == [(2,)]


def test_what_lost_drivers_left_is_deleted(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    store.commit(backfill_meta=meta(spark, 1))
    meta(spark, 9).write.parquet(str(tmp_path / "backfill_meta" / "v2-lost"))
    assert store.vacuum() == []
    assert store.vacuum(0) == ["backfill_meta/v2-lost"]
    assert listing(store.read("backfill_meta"), "value") == [(1,)]


def test_another_number_of_buckets(spark, tmp_path):
    store = S.Store(spark, str(tmp_path), buckets={"articles": 2})
    found = spark.createDataFrame([(1, f"u{i}") for i in range(40)], "board_id long, url_id string")
    store.retry(lambda c: c.update("articles", found, lambda old: S.upsert_articles(old, found, NOW, 0)))
    once = listing(store.read("articles"), "id", "url_id")
    store.rebucket("articles", 8)
    assert len(store.parts("articles")) == 8 and listing(store.read("articles"), "id", "url_id") == once
    again = S.Store(spark, store.root)  # the store knows its own buckets
    again.retry(lambda c: c.update("articles", found.limit(1), lambda old: S.upsert_articles(old, found.limit(1), NOW + 1, c.top("articles"))))
    assert listing(store.read("articles"), "id", "url_id") == once


def old_store(spark, root, steps):
    """A store as it was after its first steps."""
    store = S.Store(spark, root)
    migrations.migrate(store, NOW, migrations.STEPS[:steps])
    if steps >= 2:
        named = json.dumps([{"name": "Go", "type": "x"}])
        insights = rows(spark, "article_insights", {"article_id": 1, "tldr": "a", "entities": named}, {"article_id": 2, "tldr": "b"})
        store.retry(lambda c: c.update("article_insights", insights, lambda old: old.unionByName(insights)))
    return store


@pytest.mark.parametrize("steps", [0, 1, 2, 4, 8])
def test_upgrade_from_any_version(spark, tmp_path, steps):
    store = old_store(spark, str(tmp_path), steps)
    assert migrations.schema_version(store) == steps
    assert migrations.migrate(store, NOW + 5) == [n for n, _ in migrations.STEPS[steps:]]
    assert migrations.migrate(store, NOW + 9) == [] and migrations.schema_version(store) == len(migrations.STEPS) == schemas.SCHEMA_VERSION
    assert listing(store.read("backfill_meta"), "value") == [(NOW + 5 * (steps == 0) - 90 * 86400,)]
    if 2 <= steps < 4:
        assert listing(store.read("article_insights"), "article_id", "schema_ver") == [(1, 1), (2, 1)]
    if 2 <= steps < 5:
        assert listing(store.read("entity_refs"), "name_norm", "article_id") == [("go", 1)]


def test_two_drivers_apply_each_step_once(spark, tmp_path):
    applied = []
    threads = [threading.Thread(target=lambda: applied.append(migrations.migrate(S.Store(spark, str(tmp_path)), NOW))) for _ in range(2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(applied[0] + applied[1]) == [n for n, _ in migrations.STEPS]
    assert S.Store(spark, str(tmp_path)).read("backfill_meta").count() == 1


def test_newer_stores_are_refused(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    migrations.migrate(store, NOW, (*migrations.STEPS, ("9 more", lambda c, now: None)))
    with pytest.raises(migrations.NewerStore):
        migrations.migrate(store, NOW)


def test_a_batch_of_pages_touches_its_buckets(spark, tmp_path):
    from forumlens.sources import pages as P

    store = S.Store(spark, str(tmp_path))
    store.commit(boards=S.upsert_boards(store.read("boards"), spark.createDataFrame([("B",)], "name string"), NOW))
    landed = spark.createDataFrame([(f"/bbs/B/M.{1700000000 + i}.A.1F2.html", 1, 200, ARTICLE) for i in range(3)], P.LANDED)
    SI.apply_article_pages(store, landed, NOW)
    once = listing(store.read("articles"), "id", "url_id")
    assert len(once) == 3 and store.read("pushes").count() == 9
    SI.apply_article_pages(store, landed.limit(1), NOW + 1)
    assert listing(store.read("articles"), "id", "url_id") == once and store.read("pushes").count() == 9
    assert not os.listdir(tmp_path / "_scratch")
