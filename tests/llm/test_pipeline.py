"""The pipeline against a brute-force version of its stages, and stages on odd tables."""

import random

import corpus_pipeline as cp
import pytest
from forumlens.llm import decontamination, line_dedup, quality_classifier
from forumlens.llm.queries import QUALITY_THRESHOLD, crc_mod
from pyspark.sql import functions as F
from test_decontamination import greedy
from test_line_dedup import distance
from test_near_dedup import brute as near_brute
from test_near_dedup import roots

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    root = str(tmp_path_factory.mktemp("sf"))
    words = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    shared, item = [line(14) for _ in range(4)], line(25)
    rows = []
    for i in range(60):
        body = [line(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            body.insert(0, rng.choice(shared) + ("!" if i % 2 else ""))
        if i % 10 == 4:
            body.append(line(5) + " " + item + " " + line(5))
        rows.append((i, "\n".join(body)))
        if i % 7 == 0:
            rows.append((200 + i, "\n".join(body) if i % 2 else " ".join(body)))
        if i % 4 == 0:
            rows.append((300 + i, " ".join(w.upper() + "!!" for w in body[0].split())))
    rows += [(None, None), (400, ""), (401, rows[0][1]), (401, rows[0][1])]
    labels = [(i, 0 if i is not None and 300 <= i < 400 else 1, 0) for i, _ in rows if i is not None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).coalesce(2).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def without_repeats(rows):
    """Lines after the first of their class go, but for lines that first stand in a near copy."""
    k, least = line_dedup.THRESHOLD, line_dedup.MIN_CHARS
    lines = sorted({s for _, t in rows for _, s in line_dedup.document_lines(t, 1)})
    root, near = {s: s for s in lines}, dict(zip(((d, t) for d, t in rows), roots(rows)))
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= k and root[a] != root[b] and distance(a, b) <= k:
                old, new = root[a], root[b]
                root = {s: new if r == old else r for s, r in root.items()}
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for _, s in line_dedup.document_lines(t, 1):
            first.setdefault(root[s], near[d, t])
    out = []
    for d, t in rows:
        gone, own = set(), set()
        for i, s in line_dedup.document_lines(t, 1):
            if root[s] in own or first[root[s]] != near[d, t]:
                gone.add(i)
            own.add(root[s])
        if gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            if not t.strip():
                continue
        out.append((d, t))
    return out


def contaminated(text, items):
    bare = lambda t: [b for b in map(decontamination.bare, decontamination.words(t)) if b]
    return any(greedy(bare(i), bare(text), decontamination.MIN_MATCH) >= decontamination.COVERAGE * len(bare(i)) for i in items)


def test_pipeline_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), crc_mod(F.col("id"), 5) != 0)
    rows = [r for r, s in zip(rows, quality_classifier.score_texts([t for _, t in rows], weights)) if s >= QUALITY_THRESHOLD]
    assert not any(d is not None and 300 <= d < 400 for d, _ in rows) and len(rows) > 60
    assert not any(t in (None, "") for _, t in rows)
    rows = without_repeats(rows)
    stays, kept = near_brute(rows), []
    for r in rows:
        if r[0] in stays:
            stays.remove(r[0])
            kept.append(r)
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    kept = [r for r in kept if not contaminated(r[1], items)]
    got = cp.run(spark, tables).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, _ in kept), key=str)
    assert all(r.round_trip for r in got)
    from forumlens.llm import sentencepiece_codec as sp

    texts = {r.doc_id: sp.codec().decode(r.ids) for r in got}
    assert texts == dict(kept)


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("line", F.lit(1)).withColumn("content", F.lit("x"))
    for name in ("_row", "_score", "_found", "_drops", "found", "score", "doc", "near"):
        docs = docs.withColumn(name, F.lit(name))
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        assert out.where("_row = '_row' and _score = '_score' and _drops = '_drops' and found = 'found' and doc = 'doc'").count() > 50
        assert stage(spark, docs.limit(0), tables).count() == 0
    changed = cp.remove_repeated_lines(spark, docs, tables)
    assert changed.where("n_chars <> length(text)").count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0
