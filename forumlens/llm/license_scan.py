"""License scans with a positional index of rare words.

The corpus tells how rare each licence word is (its inverse document frequency over all documents).
The index keeps the postings (template, position) of all licence words. Of a file's licence words the
``rare`` highest-IDF ones that a template has are looked up; each hit votes for the place where the
template would start, and hits that agree within ``slack`` positions are added up by IDF. Where enough
weight (a share of that of the template's own ``rare`` rarest words) lies in order, the template's
mandatory key phrases are looked for in the region; a template with all of them is found there.
Phrases of ``STATEMENTS`` are looked up by their one rarest word, without slack: each hit gives the
place where the phrase would start, and the whole phrase is verified there.

The time is linear in the length of a text: its words are walked once, and regions are as long as templates.

Edge cases: a null text counts as empty; texts without licence words have no label and score 0;
repeated ids give a row each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 8
SLACK = 4
MIN_WEIGHT = 0.6

# Phrases that state a licence, with their labels.
STATEMENTS = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, template words, mandatory key phrases.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    ("mit", "released under the terms of the mit license", ("mit license",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license version 2",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by"
        " the free software foundation",
        ("gnu affero general public license",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    (
        "cc0",
        "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal",
        ("public domain", "cc0 1 0"),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ("creative commons attribution noncommercial",),
    ),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
    ),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0 international",),
    ),
)

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def license_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def vocabulary(templates=TEMPLATES) -> set[bytes]:
    return {w for t in (*(t for _, t, _ in templates), *STATEMENTS) for w in license_words(t)}


def document_frequencies(docs: DataFrame, text_col: str = "text", words: set[bytes] | None = None) -> tuple[int, dict[bytes, int]]:
    """Rows of the table, and in how many of them each licence word stands; over all rows.

    The result has an entry for each licence word at most, so it is bounded by the templates.
    """
    wanted = frozenset(words if words is not None else vocabulary())

    def run(batches):
        n, found = 0, defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in wanted.intersection(license_words(text)):
                    found[w] += 1
        names = ["", *(w.decode() for w in found)]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n, *found.values()], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    by_word = {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = by_word.pop("", 0)
    return rows, {w.encode(): n for w, n in by_word.items()}


@dataclass
class Index:
    """Postings of licence words, and what is needed to verify a template or statement.

    ``ranked`` has each template's words with their postings, rarest first; ``statements`` by their rarest
    word the place of that word, the phrase and its label.
    """

    templates: tuple
    rare: int
    slack: int
    min_weight: float
    weight: dict = field(default_factory=dict)
    ranked: list = field(default_factory=list)
    statements: dict = field(default_factory=dict)
    total: list = field(default_factory=list)
    phrases: list = field(default_factory=list)
    size: list = field(default_factory=list)


def build_index(
    rows: int, frequency: dict[bytes, int], templates=TEMPLATES, rare: int = RARE, slack: int = SLACK, min_weight: float = MIN_WEIGHT
) -> Index:
    index = Index(templates, rare, slack, min_weight)
    idf = {w: float(np.log((rows + 1) / (frequency.get(w, 0) + 1)) + 1e-9) for w in vocabulary(templates)}
    for _, text, phrases in templates:
        own = license_words(text)
        ranked = sorted(set(own), key=lambda w: (-idf[w], w))
        index.ranked.append([(w, [p for p, x in enumerate(own) if x == w]) for w in ranked])
        index.total.append(sum(idf[w] * len(places) for w, places in index.ranked[-1][:rare]))
        index.phrases.append([b" " + b" ".join(license_words(p)) + b" " for p in phrases])
        index.size.append(len(own))
    for phrase, label in STATEMENTS.items():
        own = license_words(phrase)
        rarest = min(own, key=lambda w: (-idf[w], w))
        index.statements.setdefault(rarest, []).append((own.index(rarest), own, label))
    index.weight = idf
    return index


def statements(own: list[bytes], index: Index) -> tuple[list[int], set[str]]:
    """Word positions where a statement starts, and the labels of those found."""
    starts, labels = [], set()
    if index.statements.keys() & set(own):
        for q, w in enumerate(own):
            for p, phrase, label in index.statements.get(w, ()):
                if q >= p and own[q - p : q - p + len(phrase)] == phrase:
                    starts.append(q - p)
                    labels.add(label)
    return starts, labels


def aligned_templates(own: list[bytes], index: Index) -> dict[str, float]:
    """Label -> the best share of rare weight in order, of the templates verified in the text."""
    present = index.weight.keys() & set(own)
    postings = defaultdict(list)
    for t, ranked in enumerate(index.ranked):
        best = [(w, places) for w, places in ranked if w in present][: index.rare]
        if sum(index.weight[w] * len(places) for w, places in best) >= index.min_weight * index.total[t]:
            for w, places in best:
                postings[w] += [(t, p) for p in places]
    votes = defaultdict(list)
    for q, w in enumerate(own) if postings else ():
        for t, p in postings.get(w, ()):
            votes[t].append((q - p, p, index.weight[w]))
    found: dict[str, float] = {}
    for t, hits in votes.items():
        hits.sort()
        low, inside, weight = 0, defaultdict(int), 0.0
        for high, (offset, p, v) in enumerate(hits):
            weight += 0.0 if inside[p] else v
            inside[p] += 1
            while hits[low][0] < offset - index.slack:
                _, gone, lost = hits[low]
                inside[gone] -= 1
                weight -= 0.0 if inside[gone] else lost
                low += 1
            share = min(1.0, weight / index.total[t])
            label = index.templates[t][0]
            if share >= index.min_weight and share > found.get(label, 0.0):
                start = max(0, hits[low][0] - index.slack)
                region = b" " + b" ".join(own[start : offset + index.size[t] + index.slack]) + b" "
                if all(phrase in region for phrase in index.phrases[t]):
                    found[label] = share
    return found


def scan_text(text: str | None, index: Index) -> tuple:
    """A row of SCHEMA."""
    own = license_words(text)
    starts, base = statements(own, index)
    found = aligned_templates(own, index)
    score = 1.0 if base else max(found.values(), default=0.0)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return (len(own), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | set(found))), score)


def scan(spark, text: Column, index: Index) -> Column:
    """A struct of SCHEMA for each whole text."""
    shared = spark.sparkContext.broadcast(index)
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan_text(t, shared.value) for t in texts], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return run(text.cast("string"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, SCHEMA) for every row."""
    index = build_index(*document_frequencies(docs, text_col))
    return docs.select(F.col(id_col).alias("id"), scan(docs.sparkSession, F.col(text_col), index).alias("m")).select("id", "m.*")
