"""Substring dedup: word windows that an earlier document has, found in a compacted De Bruijn graph.

A window of ``size`` words is an edge of the graph from its first ``size - 1`` words to its last ones. Only
edges of several documents matter, and their paths are long: so edges are kept packed from the start.

* A window's *anchor* is the smallest hash among its runs of ``anchor`` words. Equal windows have equal
  anchors, and consecutive windows mostly share one, so a document becomes a row for each run of windows
  with one anchor (about every fifth window), with a short hash of each window.
* Rows meet by anchor. There an edge is an anchor and a window hash, 96 bits; its source is the smallest
  document that has it. Edges of one row that another document has before, and whose sources follow each
  other, are one piece of a path: a path ends where it branches off from its source.
* Pieces are joined to their document by the id, checked against its own windows at their coordinates,
  and pieces that continue each other in the document and in the source become one span.

Anchors of very many rows are split by document (``HOT_ROWS``). There a window is settled among the rows of
its part; those not seen before in a part are settled in a second round by the window's own hash, with a row
for each part at most. Which anchors are split is found by counting in one of 16 rows; the result
doesn't depend on it.

Edge cases: null and short texts have no windows, though their words count; a document without an id
removes nothing and loses nothing; rows of one id do not remove words of each other, nor does a text
its own repeats; rows repeated as a whole have equal results. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CHUNK_BYTES, CodeCache, word_codes, words
from .workspace import Workspace

SIZE, ANCHOR = 13, 4
HOT_ROWS = 4096
MAX_WORDS = 100_000
#: anchors are counted by their last bits, 2 ** 20 counts in all
COUNT_BITS = 20
COUNTED_OF = 16

RECORDS = "key long, doc long, at long, anchor long, hashes binary"
FOUND = "doc long, at long, n int, source long, source_at long, check int, anchor long, hash int, kind int"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` codes."""
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        h = h * _MUL + codes[j : len(codes) - size + 1 + j]
    return _mix(h)


def _smallest(values: np.ndarray, wide: int) -> np.ndarray:
    """The smallest of every ``wide`` consecutive values."""
    have = 1
    while have < wide:
        step = min(have, wide - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_hashes(codes: np.ndarray, at: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the windows that lie in one text, their anchors, their short hashes) of texts in a row."""
    if len(codes) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    place = np.flatnonzero(at[size - 1 :] == at[: len(at) - size + 1])
    anchors = _smallest(_rolled(codes, anchor), size - anchor + 1)
    return place, anchors[place], (_rolled(codes, size)[place] >> np.uint64(32)).astype(np.uint32)


class _Codes(CodeCache):
    """Word hashes; forgets them sooner than the other operators, which hold less beside them."""

    def __missing__(self, word):
        if len(self) >= MAX_WORDS:
            self.clear()
        return super().__missing__(word)


def _cache() -> CodeCache:
    return _Codes(xxhash.xxh64_intdigest)


def _slices(batches, column: int, size: int = CHUNK_BYTES):
    """The batches in pieces of about ``size`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()) // size
        starts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:]))


def _grouped(batches, size: int, anchor: int):
    """For texts (id, row hash, text): for each chunk its ids, row hashes, and a row for each anchor run."""
    cache = _cache()
    for batch in _slices(batches, 2):
        ids, rows, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        codes, at = word_codes(texts, cache)
        place, anchors, hashes = window_hashes(codes, at, size, anchor)
        if not len(place):
            continue
        begins = np.searchsorted(at, np.arange(len(texts)))
        text = at[place]
        new = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])])
        yield ids[text[new]], rows[text[new]], (place[new] - begins[text[new]]), anchors[new], np.r_[new, len(place)], hashes


class Split:
    """Into how many parts the anchors are split: by the last bits of an anchor, 1 where nothing is named."""

    def __init__(self, parts: dict[int, int]):
        self.buckets = np.array(sorted(parts), np.uint64)
        self.parts = np.array([parts[int(b)] for b in self.buckets], np.int64)

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.ones(len(anchors), np.int64)
        bucket = anchors & np.uint64((1 << COUNT_BITS) - 1)
        i = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        return np.where(self.buckets[i] == bucket, self.parts[i], 1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text).alias("row"), text.alias("text")).where("doc is not null and text is not null")


def hot_anchors(texts: DataFrame, size: int, anchor: int, hot_rows: int, counted_of: int) -> Split:
    """The anchors to be split, 2 ** 18 of them at most, from a count in one of ``counted_of`` rows."""

    def count(batches):
        for *_, anchors, _, _ in _grouped(batches, size, anchor):
            bucket, n = np.unique(anchors & np.uint64((1 << COUNT_BITS) - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n, pa.int64())], ["bucket", "n"])

    counted = texts.where(F.rand(3) * counted_of < 1) if counted_of > 1 else texts  # by row, as one id may have many
    counts = counted.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg((F.sum("n") * counted_of).alias("n"))
    work = Workspace(texts.sparkSession)
    try:
        counts = work.table(counts, "counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        limit = max(hot_rows, total >> 18)
        return Split({r.bucket: -(-r.n // limit) + 1 for r in counts.where(F.col("n") > limit).collect()})
    finally:
        work.drop()


def records(texts: DataFrame, split: Split, size: int, anchor: int) -> DataFrame:
    """A row for each run of windows with one anchor; ``at`` packs the text's hash and the run's first word."""

    def run(batches):
        number = 0
        for ids, rows, start, anchors, ends, hashes in _grouped(batches, size, anchor):
            parts = split(anchors)
            number += len(ids)
            # by document, and by row for an id of many rows
            own = _mix(ids.astype(np.uint64) * _MUL + np.uint64(number)) % parts.astype(np.uint64)
            hot = parts > 1
            key = np.where(hot, _mix(anchors + (own + np.uint64(1)) * _MUL) | np.uint64(1), anchors & ~np.uint64(1)).view(np.int64)
            at = (rows.astype(np.int64) << 32) | start
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(hashes)])
            whole = pa.array(anchors.view(np.int64), pa.int64(), mask=~hot)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids, pa.int64()), pa.array(at), whole, packed], ["key", "doc", "at", "anchor", "hashes"])

    return texts.mapInArrow(run, RECORDS)


def _settled(table: pa.Table) -> pa.RecordBatch:
    """Whole groups sorted by (key, doc, at) -> pieces (kind 0), and windows of split groups that are the
    first of their part (kind 1)."""
    key, doc, at = (table.column(c).to_numpy() for c in ("key", "doc", "at"))
    same = np.r_[False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])]
    if same.any():  # rows repeated as a whole
        table = table.filter(pa.array(~same))
        key, doc, at = key[~same], doc[~same], at[~same]
    packed = table.column("hashes").combine_chunks()
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    hashes = np.frombuffer(packed.buffers()[2] or b"", np.uint32)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    rec = np.repeat(np.arange(len(key)), sizes)
    step = np.arange(len(hashes)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    place = at[rec] + step  # the low half counts words
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    edge = (group[rec].astype(np.uint64) << np.uint64(32)) | hashes
    order = np.argsort(edge, kind="stable")
    head = np.r_[True, edge[order][1:] != edge[order][:-1]]
    head_of = np.empty(len(order), np.int64)
    head_of[order] = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    source, source_at = doc[rec][head_of], place[head_of]
    found = source < doc[rec]
    go_on = np.r_[False, found[1:] & found[:-1] & (rec[1:] == rec[:-1]) & (source[1:] == source[:-1]) & (source_at[1:] == source_at[:-1] + 1)]
    first, breaks = np.flatnonzero(found & ~go_on), np.r_[np.flatnonzero(~go_on), len(found)]
    length = breaks[np.searchsorted(breaks, first, "right")] - first
    n = len(first)
    open_ = np.flatnonzero(((key & 1) == 1)[rec] & ~found)
    m = len(open_)
    anchor = table.column("anchor").combine_chunks().take(pa.array(rec[open_]))
    columns = [
        pa.array(np.r_[doc[rec][first], doc[rec][open_]], pa.int64()), pa.array(np.r_[place[first], place[open_]], pa.int64()),
        pa.array(np.r_[length, np.ones(m)].astype(np.int32)), pa.array(np.r_[source[first], np.zeros(m, np.int64)], pa.int64()),
        pa.array(np.r_[source_at[first], np.zeros(m, np.int64)], pa.int64()), pa.array(np.r_[hashes[first], np.zeros(m, np.uint32)].astype(np.uint32).view(np.int32)),
        pa.concat_arrays([pa.nulls(n, pa.int64()), anchor]), pa.array(np.r_[np.zeros(n, np.uint32), hashes[open_]].astype(np.uint32).view(np.int32)),
        pa.array(np.r_[np.zeros(n), np.ones(m)].astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc", "at", "n", "source", "source_at", "check", "anchor", "hash", "kind"])


def _settle(batches):
    """Takes rows sorted by (key, doc, at), a number of whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column(0)[-1].as_py() != key[0].item()):
            yield _settled(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield _settled(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield _settled(pa.Table.from_batches(held))


def _meet(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_settle, FOUND)


def path_pieces(
    docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR,
    hot_rows: int = HOT_ROWS, counted_of: int = COUNTED_OF,
) -> DataFrame:
    """(doc, row, start, n, source, source_start, check): runs of windows that a smaller document has in step.

    ``row`` is the hash of the text that the piece stands in, ``check`` that of its first window."""
    texts = _texts(docs, id_col, text_col)
    split = hot_anchors(texts, size, anchor, hot_rows, counted_of)
    path = f"{work.root}/pieces"
    _meet(records(texts, split, size, anchor)).write.mode("overwrite").partitionBy("kind").parquet(path)
    spark = docs.sparkSession
    found = spark.read.schema(FOUND).parquet(path)
    pieces = found.where("kind = 0")
    if len(split.buckets):
        key = F.shiftleft(F.xxhash64("anchor", "hash"), 1)
        again = found.where("kind = 1").select(key.alias("key"), "doc", "at", F.lit(None).cast("long").alias("anchor"), _bytes(F.col("hash")).alias("hashes"))
        pieces = pieces.unionByName(_meet(again).where("kind = 0"))
    low = F.lit(0xFFFFFFFF)
    return pieces.select(
        "doc", F.shiftright("at", 32).cast("int").alias("row"), F.col("at").bitwiseAND(low).cast("int").alias("start"), "n", "source",
        F.col("source_at").bitwiseAND(low).cast("int").alias("source_start"), "check",
    )


def _bytes(value):
    """The four bytes of an int, lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(4))))


def spans_of(text: str, pieces: list[dict], size: int, anchor: int, cache: CodeCache) -> list[tuple[int, int, int, int]]:
    """(start, end, source, source_start) in words, by start: the pieces that the text really has, those that
    continue each other in one. Spans may overlap where their sources differ."""
    codes, at = word_codes([text], cache)
    place, _, hashes = window_hashes(codes, at, size, anchor)
    out: list[list[int]] = []
    last: dict[tuple[int, int], int] = {}  # span by the diagonal that it goes on
    for p in sorted(pieces, key=lambda p: (p["start"], p["source"], p["source_start"])):
        start, n = p["start"], p["n"]
        if start + n > len(place) or int(hashes[start : start + 1].view(np.int32)[0]) != p["check"]:
            continue  # a piece of another row with this id
        way = (p["source"], p["source_start"] - start)
        i = last.get(way)
        if i is not None and start <= out[i][1] - size + 1:
            out[i][1] = max(out[i][1], start + n - 1 + size)
        else:
            last[way] = len(out)
            out.append([start, start + n - 1 + size, p["source"], p["source_start"]])
    return [tuple(s) for s in out]


def _with_pieces(docs: DataFrame, work: Workspace, id_col: str, text_col: str, size: int, anchor: int, settings: dict) -> DataFrame:
    if not 1 <= anchor <= size:
        raise ValueError("1 <= anchor <= size is needed")
    pieces = path_pieces(docs, work, id_col, text_col, size, anchor, **settings)
    own = pieces.groupBy(F.col("doc").alias("id"), "row").agg(F.collect_set(F.struct("start", "n", "source", "source_start", "check")).alias("pieces"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("row"), text.alias("text"))
    return rows.join(own, ["id", "row"], "left").select("id", "text", "pieces")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR, **settings) -> DataFrame:
    """(id, start, end, source, source_start), in words: the passages of ``size`` words or more that a document
    with a smaller id has too, each as long as it keeps in step with that document."""
    rows = _with_pieces(docs, Workspace(docs.sparkSession), id_col, text_col, size, anchor, settings)

    def run(batches):
        cache = _cache()
        for batch in _slices(batches, 1):
            found = [(i, *s) for i, t, p in zip(*(c.to_pylist() for c in batch.columns)) for s in spans_of(t, p, size, anchor, cache)]
            names = ["id", "start", "end", "source", "source_start"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*found)) or [()] * 5)], names)

    return rows.where("pieces is not null").mapInArrow(run, "id long, start long, end long, source long, source_start long")


def kept_words(texts: list[str | None], pieces: pa.ListArray, size: int, anchor: int, cache: CodeCache) -> list[tuple[int, bytes]]:
    """(number of words, the words outside the pieces) of each text, many texts at a time."""
    each = [words(t) for t in texts]
    every = [w for own in each for w in own]
    ends = np.cumsum([len(own) for own in each])
    change = np.zeros(len(every) + 1, np.int64)
    sizes = np.diff(pieces.offsets.to_numpy())
    if sizes.any():
        codes = np.fromiter(map(cache.__getitem__, every), np.uint64, len(every))
        doc = np.repeat(np.arange(len(texts)), sizes)
        start, n, check = (pieces.flatten().field(k).to_numpy() for k in ("start", "n", "check"))
        first = start + ends[doc] - np.fromiter(map(len, each), np.int64, len(each))[doc]
        last = first + n - 1 + size
        fits = last <= ends[doc]  # else it is a piece of another row with this id
        if fits.any():
            first, last, check = first[fits], last[fits], check[fits]
            own = (_rolled(codes, size)[first] >> np.uint64(32)).astype(np.uint32).view(np.int32) == check
            np.add.at(change, first[own], 1)
            np.add.at(change, last[own], -1)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    for own, end in zip(each, ends):
        lost = gone[end - len(own) : end]
        out.append((len(own), b" ".join([w for w, x in zip(own, lost.tolist()) if not x] if lost.any() else own)))
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, anchor: int = ANCHOR, **settings) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): each row without the words of its spans; kept words are
    joined by single spaces."""
    rows = _with_pieces(docs, Workspace(docs.sparkSession), id_col, text_col, size, anchor, settings)

    def run(batches):
        cache = _cache()
        for batch in _slices(batches, 1):
            found = kept_words(batch.column(1).to_pylist(), batch.column(2), size, anchor, cache)
            columns = [
                batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n - (k.count(b" ") + 1 if k else 0) for n, k in found], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for _, k in found], pa.string()), pa.array([k.decode() for _, k in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string, kept string")
