"""Line dedup by a segment-partition edit join.

Lines (stripped, at least ``min_chars`` long) are linked if their edit distance is at most
``threshold``. A line is cut into threshold + 1 segments of even length; a line within the threshold
must contain one of them unchanged, at a place that the lengths and the edits before and after it
narrow down. So each line gives index keys (its length, segment number, segment) and probe keys
(substrings at the places where segments of equal or shorter lines may stand). Lines that share a
key, one of them by an index key, are candidates; they are narrowed by a sketch of their character
counts and verified with a banded bit-parallel edit distance. A class is a connected component of
linked lines, so equal lines are of one class, too. With ``short_lines`` shorter lines take part as
well, each in the class of the lines that equal it.

Only hashes are shuffled in the candidate search, packed by ranges of keys; the text of a candidate
line is fetched once, from the document where it first stands. Lines of keys with more than
``shard_rows`` of them get finer keys: the characters are dealt to 2 * threshold + 1 classes, of which
an edit touches two at most, so lines within the threshold agree on all characters of some class. A
finer key that still has more lines is split into pairs of bounded shards. A pair that shares several
keys is counted under the smallest one, so links are exact; only the edges of a spanning forest leave
a task.

With ``near_copies`` a document keeps the lines that first stand in a near copy of it, so that near-dedup
after this finds near copies whole instead of fragments. A document is compared with the documents in
which its lines first stand, each once, by 256-bit SimHash fingerprints of five-word shingles: near are
those within ``NEAR_BITS`` (of texts under 24 shingles ``SMALL_NEAR_BITS``), 4 standard deviations above
what is expected of a similarity of 0.8.

Lines are known by 64-bit hashes of their text; a row by the 128 bits of its id and text's MD5.

Edge cases: null texts have no lines; blank lines are never linked or removed, nor short ones without
``short_lines``; rows with the same id and text count as one document and get the same answers; null ids come last in the order
that decides which line is the first of its class; an empty table gives an empty result; other
columns are passed on by ``remove_repeated_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .near_dedup import SHINGLE, SMALL_SET, WORDS, wide_fingerprint
from .shards import shard_groups, spread_join
from .simhash import shingle_hashes
from .workspace import Workspace, row_key, small_batches

THRESHOLD = 3
MIN_CHARS = 16
SHARD_ROWS = 512
NEAR_BITS = 64
SMALL_NEAR_BITS = 76
CLASSES = 8  # of characters, in the sketch that goes with a key
BUCKET_KEYS = 500_000
SEEN_LINES = 200_000
TEXT_LEFT = r"(?U)[^\s\x1c-\x1f]"  # what str.strip leaves
PACKED = np.dtype([("low", "<u4"), ("mark", "<u4"), ("line", "<i8")])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse


def _hash(text: str, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return value - (1 << 64) if value >> 63 else value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for at, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            factors = np.full(max(n, 1 << 16), base, np.uint64)
            factors[0] = 1
            _POWERS[at] = np.multiply.accumulate(factors)
    return _POWERS[0][:n], _POWERS[1][:n]


def segments(length, threshold: int, i: int):
    """(start, length) of the i-th of the threshold + 1 even segments of lines of this length."""
    parts = threshold + 1
    short, longer = length // parts, length % parts
    return i * short + np.maximum(0, i - (parts - longer)), short + (i >= parts - longer)


def slices(threshold: int) -> list[tuple[int, int, int]]:
    """(how much shorter the other line is, segment number, shift): where a line may contain a segment
    of a line of its own length or shorter, unchanged. With s edits before the segment and at most
    threshold in all, the shift is at most s, and the rest must make up for the lengths. Those without
    a shift in lines of equal length, the line's own segments, come first."""
    out = []
    for delta in range(threshold + 1):
        for i in range(threshold + 1):
            out += [(delta, i, p) for p in range(max(-i, delta - threshold + i), min(i, delta + threshold - i) + 1)]
    return sorted(out, key=lambda s: (s[0] != 0 or s[2] != 0, s))


def keys(lines: list[str], threshold: int) -> np.ndarray:
    """A row of hashes for each line: of its threshold + 1 segments (index keys), then of the other
    places where a segment may stand (probe keys). A segment's length, number and line length count.

    Lines have more than 2 * threshold characters. Substrings are hashed from sums over prefixes.
    """
    points, length = _points(lines)
    up, down = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    first = np.cumsum(length) - length
    out = np.empty((len(lines), len(slices(threshold))), np.uint64)
    for k, (delta, i, shift) in enumerate(slices(threshold)):
        other = length - delta
        start, size = segments(other, threshold, i)
        at = first + start + shift
        own = (total[at + size] - total[at]) * down[at]
        out[:, k] = _mix(own ^ _mix((other * 64 + i).astype(np.uint64)))
    return out


def group_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes as (bucket, 32 bits of which the lowest is 0)."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFE))


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, lines), np.int64, len(lines))


def class_keys(line: str, threshold: int) -> list[int]:
    """Hashes of the characters of each of 2 * threshold + 1 classes, in code point order.

    An edit touches two classes at most, so lines within the threshold agree on a class at least.
    """
    points = np.sort(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32))
    own = (_mix(points.astype(np.uint64)) % np.uint64(2 * threshold + 1)).astype(np.int64)
    return [xxhash.xxh64_intdigest(points[own == g].tobytes(), g) >> 1 for g in range(2 * threshold + 1)]


def sketches(lines: list[str], classes: int = 16) -> np.ndarray:
    """A packed count (modulo 16) for each class of characters; an edit changes two by one."""
    if not lines:
        return np.empty(0, np.uint64)
    points, length = _points(lines)
    row = np.repeat(np.arange(len(lines)) * classes, length)
    counts = np.bincount(row + ((points ^ (points >> np.uint32(4))) & np.uint32(classes - 1)), minlength=classes * len(lines))
    counts = counts.reshape(-1, classes).astype(np.uint64) & np.uint64(15)
    return (counts << (np.arange(classes, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def sketch_distance(a: np.ndarray, b: np.ndarray, classes: int = 16) -> np.ndarray:
    """A lower bound, within modulo 16, of how much the counts differ."""
    total = np.zeros(np.broadcast(a, b).shape, np.uint8)
    for k in range(classes):
        shift = a.dtype.type(4 * k)
        d = (((a >> shift) - (b >> shift)) & a.dtype.type(15)).astype(np.uint8)
        total += np.minimum(d, np.uint8(16) - d)
    return total


def within_edits(a: str, b: str, threshold: int) -> bool:
    """Whether the edit distance is at most the threshold: bit-parallel over a band of diagonals.

    The vertical differences of a column are kept for the 2 * threshold + 1 rows around the
    diagonal; the window moves down a row with each column. The distance is followed along the lower
    edge of the band to the last row, and then along that row.
    """
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > threshold:
        return False
    start = 0
    while start < len(a) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, k = len(a), threshold
    if not m:
        return len(b) <= k
    full = (1 << (2 * k + 1)) - 1
    occurs: dict[str, int] = {}
    for i, c in enumerate(a):
        occurs[c] = occurs.get(c, 0) | 1 << i
    up, down, distance = full ^ ((1 << k) - 1), 0, min(k, m)
    for j, c in enumerate(b, 1):
        at = occurs.get(c, 0)
        shift = j - k - 1
        equal = (at >> shift if shift >= 0 else at << -shift) & full
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right = down | (full & ~(diagonal | up))
        left = diagonal & up
        if j <= m - k:
            distance += not diagonal >> (2 * k) & 1
        else:
            bit = m - j + k
            distance += (right >> bit & 1) - (left >> bit & 1)
        up = left | (full & ~((diagonal >> 1) | right))
        down = (diagonal >> 1) & right
    return distance <= k


def document_lines(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """(place, stripped line) of the lines that take part."""
    stripped = [line.strip() for line in (text or "").split("\n")]
    return [(i, s) for i, s in enumerate(stripped) if len(s) >= min_chars]


def _near_print(text: str | None) -> list[int]:
    """The words of a text's wide fingerprint and the bits within which others are near."""
    distinct = np.unique(shingle_hashes(text, SHINGLE))
    return [*wide_fingerprint(distinct).view(np.int64).tolist(), NEAR_BITS if len(distinct) >= SMALL_SET else SMALL_NEAR_BITS]


def _scan(rows: DataFrame, least: int, near_copies: bool) -> DataFrame:
    """One row for each document: places and hashes of its lines of at least ``least`` characters, whether
    the line stands further up in the document, too, and with ``near_copies`` its wide fingerprint."""

    def run(batches):
        for batch in batches:
            pos, line, again, fp = [], [], [], []
            for text in batch.column(2).to_pylist():
                own, seen = document_lines(text, least), set()
                pos.append([i for i, _ in own])
                again.append([s in seen or seen.add(s) is not None for _, s in own])
                line.append([_hash(s) for _, s in own])
                fp.append(_near_print(text) if near_copies else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pos, pa.list_(pa.int32())), pa.array(line, pa.list_(pa.int64())),
                 pa.array(again, pa.list_(pa.bool_())), pa.array(fp, pa.list_(pa.int64()))],
                ["id", "_row", "pos", "line", "again", "fp"],
            )

    return rows.mapInArrow(run, "id long, _row binary, pos array<int>, line array<long>, again array<boolean>, fp array<long>")


def _signatures(rows: DataFrame, threshold: int, min_chars: int, buckets: int) -> DataFrame:
    """(bucket, packed): the keys, sketches and hashes of lines not seen shortly before in the same task, many
    to a row: a row for each key would cost the shuffle many times the lines."""
    own = threshold + 1

    def run(batches):
        held, many, seen = [], 0, set()

        def packed():
            every = np.concatenate([h[1] for h in held])
            bucket = np.concatenate([h[0] for h in held])
            order = np.argsort(bucket, kind="stable")
            every, bucket = every[order], bucket[order]
            start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(start[1:], len(bucket))
            # a few rows a batch, so that no batch is large
            for part in range(0, len(start), 64):
                at = slice(part, part + 64)
                blobs = [every[a:b].tobytes() for a, b in zip(start[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[start[at]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                fresh = {}
                if len(seen) > SEEN_LINES:
                    seen.clear()
                for text in batch.column(0).slice(start, 200).to_pylist():
                    for _, s in document_lines(text, min_chars):
                        h = _hash(s)
                        if h not in seen:
                            seen.add(h)
                            fresh[h] = s
                if not fresh:
                    continue
                lines = list(fresh.values())
                found = group_keys(keys(lines, threshold), buckets)
                entry = np.empty(found.shape, PACKED)
                entry["low"] = (found & np.uint64(0xFFFFFFFF)) | (np.arange(found.shape[1]) < own).astype(np.uint64)
                entry["mark"] = sketches(lines, CLASSES)[:, None]
                entry["line"] = np.fromiter(fresh, np.int64, len(lines))[:, None]
                held.append(((found >> np.uint64(32)).astype(np.int64).ravel(), entry.ravel()))
                many += found.size
                if many >= 2 * BUCKET_KEYS:
                    yield from packed()
                    held, many = [], 0
        if held:
            yield from packed()

    return rows.select("text").mapInArrow(run, "bucket long, packed binary")


def distinct_entries(entries: np.ndarray, hot: set[int]) -> np.ndarray:
    """Entries of hot keys and of keys of two or more lines, by key and line; a line once under a key, as
    index if it is that, too."""
    key = entries["low"] >> np.uint32(1)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    entries = entries[order[np.append(same, False) | np.append(False, same) | np.isin(key, list(hot))]]
    entries = entries[np.lexsort((~entries["low"], entries["line"], entries["low"] >> np.uint32(1)))]
    key = entries["low"] >> np.uint32(1)
    if len(entries):
        entries = entries[np.append(True, (key[1:] != key[:-1]) | (entries["line"][1:] != entries["line"][:-1]))]
    return entries


def partners(entries: np.ndarray, threshold: int, shard_rows: int, hot: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the entries (by key) that have a candidate under their key, and of those of hot keys."""
    key, mark, flag = entries["low"] >> np.uint32(1), entries["mark"], (entries["low"] & np.uint32(1)).astype(bool)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(entries)]
    size = np.diff(np.append(first, len(entries)))
    large = np.repeat((size > shard_rows) | np.isin(key[first], list(hot)), size)
    keep, at = large.copy(), np.flatnonzero(~large)
    for step in range(1, shard_rows):
        at = at[at + step < len(entries)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = at[flag[at] | flag[at + step]]
        near = near[sketch_distance(mark[near], mark[near + step], CLASSES) <= 2 * threshold]
        keep[near] = keep[near + step] = True
    return keep, large


def _narrow(signatures: DataFrame, threshold: int, shard_rows: int) -> DataFrame:
    """(key, line, is_index, hot) of the lines that have a candidate partner under a key.

    Rows arrive sorted by bucket, and a bucket is held as a whole, without the repeated lines of a key.
    Lines of keys beyond ``shard_rows``, the hot ones, are all passed on: where a bucket grows beyond
    ``4 * BUCKET_KEYS`` they go at once, so that not more than that is held.
    """

    def rows(bucket, entries, hot):
        key = np.int64(bucket) << np.int64(32) | (entries["low"] & np.uint32(0xFFFFFFFE)).astype(np.int64)
        flag = (entries["low"] & np.uint32(1)).astype(bool)
        line = np.ascontiguousarray(entries["line"])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(flag), pa.array(hot)], ["key", "line", "is_index", "hot"])

    def run(batches):
        bucket, held, many, limit, hot = None, [], 0, 0, set()

        def finish():
            entries = distinct_entries(np.concatenate(held), hot)
            keep, large = partners(entries, threshold, shard_rows, hot)
            return rows(bucket, entries[keep], large[keep])

        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != bucket:
                    if held:
                        yield finish()
                    bucket, held, many, limit, hot = number, [], 0, 4 * BUCKET_KEYS, set()
                held.append(np.frombuffer(packed.as_buffer(), PACKED))
                many += len(held[-1])
                if many > limit:
                    every = np.concatenate(held)
                    every = distinct_entries(every, set((every["low"] >> np.uint32(1)).tolist()))
                    _, large = partners(every, threshold, shard_rows, hot)
                    hot |= set((every["low"][large] >> np.uint32(1)).tolist())
                    yield rows(bucket, every[large], large[large])
                    held, many = [every[~large]], int((~large).sum())
                    limit = max(limit, 2 * many)
        if held:
            yield finish()

    ordered = signatures.repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "key long, line long, is_index boolean, hot boolean")


def close_pairs(texts: list[str], index: list[bool], shard: list[int], threshold: int, across: bool) -> list[tuple[int, int]]:
    """Pairs within the threshold, one of them by an index key; with ``across`` of different shards only."""
    if len(texts) == 2:
        ok = (index[0] or index[1]) and not (across and shard[0] == shard[1])
        return [(0, 1)] if ok and within_edits(*texts, threshold) else []
    marks, index, shard, out = sketches(texts), np.array(index, bool), np.array(shard, np.int64), []
    for i in range(len(texts) - 1):
        near = sketch_distance(marks[i], marks[i + 1 :]) <= 2 * threshold
        near &= index[i] | index[i + 1 :]
        if across:
            near &= shard[i + 1 :] != shard[i]
        out += [(i, j) for j in (np.flatnonzero(near) + i + 1).tolist() if within_edits(texts[i], texts[j], threshold)]
    return out


def linked_pairs(groups: list[tuple[int, int, bool, list[dict]]], threshold: int, buckets: int) -> list[list[tuple[int, int]]]:
    """Verified pairs of each group (key, class of characters or -1, across, rows) that belong to it: a
    pair that shares several keys belongs to the smallest one, and there to the first class it shares.

    Rows have line, is_index, own (shard) and text.
    """
    found, text = [], {}
    for _, _, across, rows in groups:
        lines: dict[int, dict] = {}
        for r in rows:
            if r["line"] in lines:
                lines[r["line"]]["is_index"] |= r["is_index"]
            else:
                lines[r["line"]] = dict(r)
        own = list(lines.values())
        texts = [r["text"] for r in own]
        pairs = close_pairs(texts, [r["is_index"] for r in own], [r["own"] for r in own], threshold, across)
        text |= {own[i]["line"]: texts[i] for p in pairs for i in p}
        found.append([(own[i]["line"], own[j]["line"]) for i, j in pairs])
    if not text:
        return found
    every = group_keys(keys(list(text.values()), threshold), buckets).tolist()
    key_sets = {line: (set(k[: threshold + 1]), set(k[threshold + 1 :])) for line, k in zip(text, every)}
    out = []
    for (key, group, _, _), pairs in zip(groups, found):
        kept = []
        for a, b in pairs:
            (ai, ap), (bi, bp) = key_sets[a], key_sets[b]
            if min((ai & (bi | bp)) | (bi & ap)) == key:
                both = zip(class_keys(text[a], threshold), class_keys(text[b], threshold)) if group >= 0 else ()
                if group < 0 or group == next(g for g, (x, y) in enumerate(both) if x == y):
                    kept.append((a, b))
        out.append(kept)
    return out


def _verify(groups: DataFrame, threshold: int, buckets: int) -> DataFrame:
    """(a, b, links): edges of a spanning forest of each group (links null), and links of lines (b null)."""

    def run(batches):
        for batch in batches:
            a, b, links = [], [], []
            groups = [(key, g, i != j, rows) for key, g, i, j, rows in zip(*(batch.column(c).to_pylist() for c in range(5)))]
            for pairs in linked_pairs(groups, threshold, buckets):
                root, count = {}, {}

                def top(x):
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for x, y in pairs:
                    count[x], count[y] = count.get(x, 0) + 1, count.get(y, 0) + 1
                    if top(x) != top(y):
                        root[top(x)] = top(y)
                        a.append(x)
                        b.append(y)
                        links.append(None)
                for x, n in count.items():
                    a.append(x)
                    b.append(None)
                    links.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])

    return groups.mapInArrow(run, "a long, b long, links long")


def _texts(texts: DataFrame, scanned: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, text) of lines (line, first_doc, first_pos), from the documents where they first stand."""
    wanted = lines.groupBy(F.col("first_doc").alias("doc")).agg(F.collect_list(F.struct(F.col("first_pos").alias("pos"), "line")).alias("wanted"))
    wanted = wanted.join(scanned.select("doc", "_row"), "doc").select("_row", "wanted")

    def fetch(batches):
        for batch in batches:
            line, text = [], []
            for whole, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = whole.split("\n")
                line += [w["line"] for w in want]
                text += [parts[w["pos"]].strip() for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(text, pa.string())], ["line", "text"])

    found = texts.join(wanted, "_row").select("text", "wanted").mapInArrow(fetch, "line long, text string")
    return found.dropDuplicates(["line"])  # rows with equal ids and texts


def _by_class(hot: DataFrame, threshold: int) -> DataFrame:
    """(key, line, is_index, text) -> a row for each class of characters, with its finer key."""

    def run(batches):
        for batch in batches:
            n = 2 * threshold + 1
            finer = [class_keys(t, threshold) for t in batch.column(3).to_pylist()]
            repeated = pa.array(np.repeat(np.arange(batch.num_rows), n))
            own = [batch.column(c).take(repeated) for c in range(3)]
            group = pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows))
            flat = pa.array([x for f in finer for x in f], pa.int64())
            yield pa.RecordBatch.from_arrays([*own, group, flat], ["key", "line", "is_index", "group", "finer"])

    return hot.select("key", "line", "is_index", "text").mapInArrow(
        run, "key long, line long, is_index boolean, group int, finer long"
    )


class LineClasses:
    """The classes of a table's lines.

    ``lines``: (line, n, class_id, links, first_doc, first_pos) of each different line; ``n`` is how often
    it stands, ``first_doc`` and ``first_pos`` where a line of its class first stands. ``scanned``: (doc,
    id, _row, copies, pos, line, again, fp) of every different row; ``doc`` numbers rise with the ids.
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD, min_chars=MIN_CHARS, shard_rows=SHARD_ROWS, short_lines=False, near_copies=False):
        if threshold < 0 or min_chars <= 2 * threshold:
            raise ValueError("0 <= threshold and 2 * threshold < min_chars are needed")
        work = self.work = Workspace(docs.sparkSession)
        small_batches(docs.sparkSession)
        self.near_copies = near_copies
        id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
        texts = docs.select(id_.alias("id"), row_key(id_, text).alias("_row"), text.alias("text"))
        raw = work.table(_scan(texts, 1 if short_lines else min_chars, near_copies), "raw")
        ordered = raw.orderBy(F.col("id").asc_nulls_last(), "_row").withColumn("doc", F.monotonically_increasing_id())
        ordered = work.table(ordered, "ordered")
        repeated = ordered.groupBy("_row").agg(F.count("*").alias("copies"), F.min("doc").alias("low")).where("copies > 1")
        repeated = work.table(repeated, "repeated")
        scanned = ordered.join(repeated, "_row", "left").where("low is null or low = doc").drop("low")
        self.scanned = work.table(scanned.withColumn("copies", F.coalesce("copies", F.lit(1))), "scan")
        self.total = self.scanned.agg(F.coalesce(F.sum(F.size("line")), F.lit(0))).first()[0]
        order = F.when(~F.col("again"), F.col("doc"))
        firsts = self.places().groupBy("line").agg(
            F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.min_by("pos", order).alias("first_pos")
        )
        firsts = work.table(firsts, "firsts")
        buckets = max(1, -(-self.total * len(slices(threshold)) // BUCKET_KEYS))
        members = work.table(_narrow(_signatures(texts, threshold, min_chars, buckets), threshold, shard_rows), "members")
        wanted = firsts.join(members.select("line").distinct(), "line", "left_semi")
        fetched = work.table(_texts(texts, self.scanned, wanted), "texts")
        hot = members.where("hot")
        finer = members.where("not hot").select("key", "line", "is_index", F.lit(-1).alias("group"), F.lit(0).cast("long").alias("finer"))
        if hot.take(1):
            finer = work.table(finer.unionByName(_by_class(hot.join(fetched, "line"), threshold)), "finer")
        groups = (
            shard_groups(finer, ["key", "group", "finer"], F.col("line"), shard_rows, work, "members")
            .join(fetched, "line")
            .groupBy("key", "group", "finer", "_i", "_j")
            .agg(F.collect_list(F.struct("line", "is_index", F.col("_own").alias("own"), "text")).alias("rows"))
            .where(F.size("rows") > 1)
            .select("key", "group", "_i", "_j", "rows")
        )
        found = work.table(_verify(groups, threshold, buckets), "found")
        nodes = connected_components(found.where("b is not null").select("a", "b"), work)
        links = found.where("links is not null").groupBy(F.col("a").alias("line")).agg(F.sum("links").alias("links"))
        linked = nodes.select(F.col("node").alias("line"), F.col("root").alias("class_id")).join(links, "line")
        linked = work.table(linked.join(firsts.drop("n"), "line"), "linked")
        lows = linked.groupBy("class_id").agg(F.count("*").alias("size"), F.min(F.struct("first_doc", "first_pos")).alias("low"))
        linked = spread_join(linked.select("line", "class_id", "links"), lows, "class_id", "size", linked.count())
        every = firsts.join(linked, "line", "left")
        self.lines = work.table(
            every.select(
                "line", "n", F.coalesce("class_id", "line").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("low.first_doc", "first_doc").alias("first_doc"), F.coalesce("low.first_pos", "first_pos").alias("first_pos"),
            ),
            "lines",
        )
        work.drop("raw", "ordered", "repeated", "firsts", "members", "members-sizes", "finer", "texts", "found", "linked")

    def places(self) -> DataFrame:
        """(doc, pos, line, again) of every line of the different rows."""
        each = F.explode(F.arrays_zip("pos", "line", "again")).alias("p")
        return self.scanned.select("doc", each).select("doc", "p.pos", "p.line", "p.again")

    def occurrences(self) -> DataFrame:
        """(doc, pos, class_id, links, repeated): repeated unless it's the first of its class."""
        joined = spread_join(self.places().drop("again"), self.lines, "line", "n", self.total)
        is_first = (F.col("first_doc") == F.col("doc")) & (F.col("first_pos") == F.col("pos"))
        return joined.select("doc", "pos", "class_id", "links", (~is_first).alias("repeated"))

    def repeated(self) -> DataFrame:
        """(doc, pos) of the lines to remove: those that repeat an earlier line's class.

        With ``near_copies`` a line that first stands in a near copy of its document is no repeat, unless
        it repeats a line of its own document.
        """
        lines = self.lines.where("n > 1 or links > 0")
        joined = spread_join(self.places().drop("again"), lines, "line", "n", self.total)
        if not self.near_copies:
            return joined.where("first_doc <> doc or first_pos <> pos").select("doc", "pos")
        turn = F.row_number().over(Window.partitionBy("doc", "class_id").orderBy("pos"))
        joined = joined.repartition("doc").withColumn("again", turn > 1).where("again or first_doc <> doc")
        joined = self.work.table(joined.select("doc", "pos", "first_doc", "again"), "repeats")
        near = self._near_pairs(joined.where("not again").select("doc", "first_doc").distinct())
        joined = joined.join(near.withColumn("near", F.lit(True)), ["doc", "first_doc"], "left")
        return joined.where("again or near is null").select("doc", "pos")

    def _near_pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (doc, first_doc) whose fingerprints are near."""
        fps = self.scanned.select("doc", "fp")
        pairs = self.work.table(pairs.join(fps, "doc"), "pairs")
        firsts = pairs.groupBy("first_doc").agg(F.count("*").alias("n"))
        firsts = self.work.table(firsts.join(fps.toDF("first_doc", "first_fp"), "first_doc"), "pair-firsts")
        met = spread_join(pairs, firsts, "first_doc", "n", pairs.count())
        word = lambda k: F.bit_count(F.col("fp")[k].bitwiseXOR(F.col("first_fp")[k]))
        apart = sum((word(k) for k in range(1, WORDS)), word(0))
        return met.where(apart <= F.greatest(F.col("fp")[WORDS], F.col("first_fp")[WORDS])).select("doc", "first_doc")

    def by_document(self) -> DataFrame:
        """(id, n_lines, n_repeated, n_linked, classes, links), arrays in the order of the text."""
        own = self.occurrences().groupBy("doc").agg(
            F.array_sort(F.collect_list(F.struct("pos", "class_id", "links", "repeated"))).alias("o")
        )
        rows = self.scanned.select("id", "doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        out = rows.join(own, "doc", "left").withColumn("o", F.coalesce("o", F.expr("slice(array(named_struct('pos', 0, 'class_id', 0L, 'links', 0L, 'repeated', false)), 1, 0)")))
        return out.select(
            "id",
            F.size("o").cast("long").alias("n_lines"),
            F.size(F.filter("o", lambda x: x["repeated"])).cast("long").alias("n_repeated"),
            F.size(F.filter("o", lambda x: x["links"] > 0)).cast("long").alias("n_linked"),
            F.col("o.class_id").alias("classes"),
            F.col("o.links").alias("links"),
        )


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without the lines that repeat an earlier line's class.

    Documents without such lines stay as they are; documents of which only blank lines would be left go.
    With ``near_copies`` near copies keep what they have in common (see LineClasses.repeated).
    """
    classes = LineClasses(docs, id_col, text_col, **settings)
    drops = classes.repeated().groupBy("doc").agg(F.collect_set("pos").alias("_drops"))
    drops = drops.join(classes.scanned.select("doc", "_row"), "doc").select("_row", "_drops")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no name clashes
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(whole, row_key(id_, text).alias("_row"), text.alias("text")).join(drops, "_row", "left")
    kept = F.expr("array_join(filter(split(text, '\n', -1), (l, i) -> not array_contains(_drops, i)), '\n')")
    rows = rows.withColumn("text", F.when(F.col("_drops").isNull(), F.col("text")).otherwise(kept))
    out = rows.where(F.col("_drops").isNull() | F.col("text").rlike(TEXT_LEFT))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns))
