import re
import time

import numpy as np
from forumlens.llm import language_id, license_scan, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, l) for p, l in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    pos = [i for i, _ in at]
    return len(w), len(at), min(pos, default=None), max(pos, default=None), ",".join(sorted({l for _, l in at}))


EDGES = [None, "", "!!", "CC-BY-NC cc by nc", "under the MIT license.", "Apache License, Version 2.0; under The MIT\nLicense",
         "cc byé nc", "cc by nc by nc", "Licensed under CC BY-NC 4.0.", "x " * 30000 + "cc by nc"]


def test_licence_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(EDGES)], "doc_id long, text string, labels string")
    got = sorted(license_scan.license_scan(df).collect())
    assert [tuple(r)[1:6] for r in got] == [brute(t) for t in EDGES]
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_licence_templates():
    index = license_scan.build_index(1000, {b"the": 900, b"of": 800, b"to": 700, b"software": 5})
    for label, text, _ in license_scan.TEMPLATES:
        prose = "some words here. " * 40 + text.upper() + ", and more. " * 20
        assert label in license_scan.scan_text(prose, index)[5].split(","), text
    edited = license_scan.TEMPLATES[0][1].replace("any person", "any natural person")
    assert "mit" in license_scan.scan_text(edited, index)[5]
    shuffled = " ".join(sorted(license_scan.TEMPLATES[0][1].split()))
    assert license_scan.scan_text(shuffled, index)[5:] == ("", 0.0)


def test_licence_long_texts_are_linear():
    index = license_scan.build_index(1000, {b"the": 900, b"license": 5})
    start = time.monotonic()
    row = license_scan.scan_text("under the MIT license the " * 100_000 + license_scan.TEMPLATES[3][1], index)
    assert row[:4] == (500_000 + len(license_scan.license_words(license_scan.TEMPLATES[3][1])), 100_000, 0, 499_995)
    assert row[5] == "bsd,mit" and time.monotonic() - start < 30


def test_licence_rare_words_are_the_files_own():
    index = license_scan.build_index(1000, {b"the": 900, b"of": 800, b"to": 700})
    for t, (label, text, phrases) in enumerate(license_scan.TEMPLATES):
        kept = " ".join(phrases).split()
        gone = next((w for w, _ in index.ranked[t] if w.decode() not in kept), None)
        if gone and index.size[t] > 12:  # one of the template's rarest words is not in the file
            edited = " ".join("altered" if w == gone.decode() else w for w in text.split())
            assert label in license_scan.scan_text(edited, index)[5].split(","), text


def test_licence_statistics_cover_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, df = license_scan.document_frequencies(docs)
    texts = [r.text for r in docs.select("text").collect()]
    assert rows == len(texts)
    for w in (b"license", b"gnu", b"the"):
        assert df.get(w, 0) == sum(w in license_scan.license_words(t) for t in texts)


def test_fold():
    points, row = language_id.fold(["Ab, 1c", "", "𝔘É!", None])
    assert ["".join(map(chr, points[row == i])) for i in range(4)] == ["ab c ", " ", "𝔘é ", " "]
    for i, t in enumerate(["ab", "cd"]):
        for (h, at), (alone, _) in zip(language_id.grams(["ab", "cd"]), language_id.grams([t])):
            assert h[at == i].tolist() == alone.tolist()


def test_filters_against_exact_sets(spark):
    rows = [(i, "der die das und ist " * 3, "de") for i in range(40)] + [(100 + i, "the and of is that " * 3, "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs, F.lit(True))
    hits, total = filters.counts(["der und", "the that"])
    exact = {lang: {int(x) for h, _ in language_id.grams([t for _, t, l in rows if l == lang]) for x in h} for lang in ("de", "en")}
    for i, t in enumerate(["der und", "the that"]):
        own = [int(x) for h, _ in language_id.grams([t]) for x in h]
        assert total[i] == len(own)
        for j, lang in enumerate(filters.languages):
            assert hits[i, j] >= sum(x in exact[lang] for x in own)  # no false negatives
    edge = [None, "", "12 34!", "der und", "the that", "中文"]
    assert [p for p, _ in filters.predict(edge)] == ["und", "und", "und", "de", "en", "de"]
    none = language_id.fit(docs.limit(0), F.lit(True))
    assert none.predict(["x"]) == [("und", 0.0)]


def test_language_held_out(spark):
    got = queries.QUERIES["op9_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.97


def test_an_id_of_many_rows_is_learned_from_once(spark):
    rows = [(i, f"some words of the text number {i} stand here", "en") for i in range(40)] + [(100 + i, f"quelques mots du texte numéro {i} ici", "fr") for i in range(40)]
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, kind)
    again = docs.union(spark.range(10_000).select(F.lit(7).cast("long"), F.lit(rows[7][1]), F.lit("en")))
    once, many = (language_id.fit(d, F.lit(True), sample_per_language=30) for d in (docs, again))
    assert once.languages == many.languages == ["en", "fr"]
    assert all((a == b).all() for a, b in zip(once.tables, many.tables))


def test_decisions_match_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = language_id.fit(docs, F.lit(True), sample_per_language=60)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["x", "no 1 2", "ça là", None]
    n = len(filters.languages)
    held = [{s for s, mask in enumerate(filters.tables[i // language_id.GROUP].tolist()) if mask >> (i % language_id.GROUP) & 1} for i in range(n)]
    rate = [(len(own) / (1 << language_id.SLOT_BITS)) ** language_id.HASHES for own in held]
    for text, (lang, score) in zip(texts, filters.predict(texts)):
        if text is None:
            assert (lang, score) == ("und", 0.0)
            continue
        hits, total = [0] * n, 0
        for h, _ in language_id.grams([text]):
            total += len(h)
            for places in zip(*(s.tolist() for s in language_id.slots(h))):
                for i in range(n):
                    hits[i] += all(p in held[i] for p in places)
        fixed = [max(0.0, (x - total * p) / (1 - p)) for x, p in zip(hits, rate)]
        best = fixed.index(max(fixed))
        assert lang == filters.languages[best] and abs(score - (fixed[best] / sum(fixed) if sum(fixed) else 0.0)) < 1e-9
