"""Vector code compression: product-quantised codes by Yinyang Lloyd rounds in whole numbers.

A vector's components become integers floor(scale * x) and are cut into equal parts, each with a codebook
of its own. A round assigns every part to its nearest entry and moves the entries to the mean of their parts.

Yinyang: the entries of a codebook are clustered into a few groups. A part keeps an upper bound of the
distance to its entry and a lower bound for each group; when entries move, the bounds drift by as much.
A group is scanned only if its lower bound no longer exceeds the upper one, and a part none of whose groups
fails isn't looked at. Bounds are floats rounded to the safe side; what is scanned is compared in integers,
and ties go to the lower index. So the result is that of plain Lloyd rounds.

A round reads the vectors with their bounds once, and writes them beside one row of sums for each task,
part and entry; only the sums of all tasks, a row for each entry, and the codebooks reach the driver.

Edge cases: vectors that are null or hold nulls, NaN or infinities are dropped. Shorter vectors are padded
with zeros to the longest one's length, rounded up to a multiple of ``parts``. Codebooks start from the
smallest ids, null ids last, rows of one id in the order of their vectors; with fewer rows than entries
the codebooks are smaller. Components beyond 10 ** 18 count as that, and errors beyond a long as the
largest one. Other columns are ignored. No kept vector gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import spread_join
from .workspace import Workspace

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 8, 16, 6, 4, 4096
LARGEST = 10**18
#: integers up to here have squared distances that fit an int64; larger ones are Python integers
PLAIN = 1 << 28
LONG = (1 << 63) - 1
_SAFE = 1e-12

ROWS = "id long, label string, vector array<double>, code binary, bounds binary, part int, entry int, n long, total array<string>, kind int"


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the vectors that have finite components only."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("vector").isNotNull() & finite)


def integers(vectors: pa.Array, length: int, scale: int, plain: bool) -> np.ndarray:
    """floor(scale * x) of the vectors, padded with zeros; int64, or Python integers if not ``plain``."""
    offsets = vectors.offsets.to_numpy()
    sizes, values = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    out = np.zeros((len(sizes), length))
    out[np.arange(length) < sizes[:, None]] = values
    if plain:
        return np.floor(out * scale).astype(np.int64)
    return np.frompyfunc(lambda x: math.floor(max(-LARGEST, min(LARGEST, int(x))) * scale if abs(x) > 2**52 else x * scale), 1, 1)(out)


def grouped(book: list[list[int]], groups: int) -> np.ndarray:
    """A group number for each entry: a few k-means rounds from entries far apart."""
    points = np.array(book, dtype=float)
    seeds = [0]
    while len(seeds) < min(groups, len(points)):
        far = np.min([((points - points[s]) ** 2).sum(1) for s in seeds], axis=0)
        if not far.max():
            break
        seeds.append(int(far.argmax()))
    centres = points[seeds]
    for _ in range(5):
        own = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([points[own == g].mean(0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(own, return_inverse=True)[1]


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return ((x - entry) ** 2).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


class Codebook:
    """The entries of one part, their groups, and how far each has moved since the bounds were made."""

    def __init__(self, book: list[list[int]], groups: np.ndarray, before: list[list[int]] | None, dtype):
        self.entries = np.array(book, dtype=dtype)
        self.groups = groups
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        moved = np.array([math.sqrt(sum((a - b) ** 2 for a, b in zip(e, f))) for e, f in zip(book, before)]) if before else np.zeros(len(book))
        self.drift = moved * (1 + _SAFE)
        self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, squared distances, bounds) by a full scan; bounds hold the upper one and one for each group."""
        d = np.stack([squared(x, e) for e in self.entries], axis=1)
        code = d.argmin(axis=1)
        best = d[np.arange(len(x)), code]
        bounds = np.empty((len(x), 1 + len(self.members)))
        bounds[:, 0] = _root(best) * (1 + _SAFE)
        for g, own in enumerate(self.members):
            other = np.where(own == code[:, None], np.inf, _root(d[:, own]))
            bounds[:, 1 + g] = other.min(axis=1) * (1 - _SAFE)
        return code, best, bounds

    def assign(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, bounds) against the moved entries; scans the groups whose bound fails."""
        code, upper, lower = code.copy(), bounds[:, 0].copy(), bounds[:, 1:].copy()
        upper += self.drift[code] + _SAFE * upper
        lower -= self.group_drift + _SAFE * (np.abs(np.where(np.isinf(lower), 0, lower)) + self.group_drift)
        todo = np.flatnonzero(lower.min(axis=1) <= upper)
        own = squared(x[todo], self.entries[code[todo]])
        upper[todo] = _root(own) * (1 + _SAFE)
        still = lower[todo].min(axis=1) <= upper[todo]
        todo, own = todo[still], own[still]
        before, best, best_d = code[todo], code[todo].copy(), own.copy()
        scanned = []
        for g, members in enumerate(self.members):
            at = np.flatnonzero(lower[todo, g] <= _root(best_d) * (1 + _SAFE))
            if not len(at):
                continue
            d = np.stack([squared(x[todo[at]], self.entries[e]) for e in members], axis=1)
            first = d.argmin(axis=1)
            found, entry = d[np.arange(len(at)), first], members[first]
            better = (found < best_d[at]) | ((found == best_d[at]) & (entry < best[at]))
            best[at[better]], best_d[at[better]] = entry[better], found[better]
            scanned.append((g, at, d))
        left = np.flatnonzero(best != before)  # the entry that was left bounds its group from now on
        g = self.groups[before[left]]
        lower[todo[left], g] = np.minimum(lower[todo[left], g], _root(own[left]) * (1 - _SAFE))
        for g, at, d in scanned:
            other = np.where(self.members[g] == best[at][:, None], np.inf, _root(d))
            lower[todo[at], g] = other.min(axis=1) * (1 - _SAFE)
        code[todo], upper[todo] = best, _root(best_d) * (1 + _SAFE)
        return code, np.concatenate([upper[:, None], lower], axis=1)


class _Round:
    """What a task does to its vectors: new codes and bounds, and at the end a row of sums for each entry."""

    def __init__(self, books, groups, before, length: int, scale: int, plain: bool):
        self.books, self.groups, self.before = books, groups, before
        self.length, self.scale, self.plain = length, scale, plain

    def parts(self, vectors: pa.Array) -> np.ndarray:
        x = integers(vectors, self.length, self.scale, self.plain)
        return x.reshape(len(x), len(self.books), -1)

    def run(self, batches):
        dtype = np.int64 if self.plain else object
        parts = len(self.books)
        books = [Codebook(b, g, self.before and self.before[p], dtype) for p, (b, g) in enumerate(zip(self.books, self.groups))]
        sums = [np.zeros(b.entries.shape, dtype=object) for b in books]
        counts = np.zeros((parts, max(len(b.entries) for b in books)), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = self.parts(batch.column(2))
            codes, bounds = np.empty((n, parts), np.uint8), []
            if self.before:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts)
                held = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(n, -1)
            at = 0
            for p, book in enumerate(books):
                if self.before:
                    wide = 1 + len(book.members)
                    codes[:, p], part = book.assign(x[:, p], old[:, p].astype(np.int64), held[:, at : at + wide])
                    at += wide
                else:
                    codes[:, p], _, part = book.start(x[:, p])
                bounds.append(part)
                for e in np.unique(codes[:, p]):
                    own = x[codes[:, p] == e, p]
                    sums[p][e] += own.sum(axis=0).astype(object)
                    counts[p, e] += len(own)
            packed = np.ascontiguousarray(np.concatenate(bounds, axis=1))
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([b.tobytes() for b in packed], pa.binary()), *none, pa.array(np.zeros(n), pa.int32())],
                _names(),
            )
        used = [(p, e) for p in range(parts) for e in range(len(sums[p])) if counts[p, e]]
        m = len(used)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.binary(), pa.binary())]
        p, e = [u[0] for u in used], [u[1] for u in used]
        total = [[str(v) for v in sums[a][b]] for a, b in used]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array([int(counts[u]) for u in used], pa.int64()), pa.array(total, pa.list_(pa.string())), pa.array([1] * m, pa.int32())],
            _names(),
        )

    def finish(self, batches):
        dtype = np.int64 if self.plain else object
        for batch in batches:
            n = batch.num_rows
            x = self.parts(batch.column(2)) if n else np.zeros((0, len(self.books), 1), np.int64)
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, len(self.books))
            held = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float64).reshape(n, -1)
            error, codes, at = [0] * n, np.empty((n, len(self.books)), np.uint8), 0
            for p in range(len(self.books) if n else 0):
                book = Codebook(self.books[p], self.groups[p], self.before[p], dtype)
                wide = 1 + len(book.members)
                codes[:, p], _ = book.assign(x[:, p], old[:, p].astype(np.int64), held[:, at : at + wide])
                at += wide
                error = [a + int(d) for a, d in zip(error, squared(x[:, p], book.entries[codes[:, p]]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(v, LONG) for v in error], pa.int64())],
                ["id", "label", "code", "error"],
            )


def _names() -> list[str]:
    return [f.strip().split(" ")[0] for f in ROWS.split(", ")]


def _moved(book: list[list[int]], sums: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    return [[t // sums[e][0] for t in sums[e][1]] if e in sums else entry for e, entry in enumerate(book)]


def trained_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS, scale: int = SCALE, work: Workspace | None = None,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows (id, label, code, error), the final codebooks by part): code has two hex digits for each part."""
    spark: SparkSession = vectors.sparkSession
    work = work or Workspace(spark)
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    largest = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    longest, most = kept.agg(F.max(F.size("vector")), F.max(largest)).first()
    if longest is None:
        return spark.createDataFrame([], "id long, label string, code string, error long"), []
    length = max(1, -(-longest // parts)) * parts
    plain = most * scale < PLAIN
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector", "label").limit(entries).select("vector").toArrow()
    start = integers(first.column(0).combine_chunks(), length, scale, plain).reshape(first.num_rows, parts, -1)
    books = [[[int(v) for v in row] for row in start[:, p]] for p in range(parts)]
    own = [grouped(b, groups) for b in books]
    rows, before = kept.select("id", "label", "vector"), None
    for k in range(rounds):
        path = f"{work.root}/round-{k}"
        step = _Round(books, own, before, length, scale, plain)
        rows.mapInArrow(step.run, ROWS).write.mode("overwrite").partitionBy("kind").parquet(path)
        place = F.posexplode("total").alias("at", "v")
        sums = spark.read.schema("part int, entry int, n long, total array<string>").parquet(f"{path}/kind=1")
        per_place = sums.select("part", "entry", "n", place).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        found: list[dict] = [{} for _ in range(parts)]
        for r in per_place.orderBy("part", "entry", "at").collect():  # parts * entries * the length of a part
            found[r.part].setdefault(r.entry, (r.n, []))[1].append(int(r.v))
        before, books = books, [_moved(b, f) for b, f in zip(books, found)]
        rows = spark.read.schema("id long, label string, vector array<double>, code binary, bounds binary").parquet(f"{path}/kind=0")
        if k:
            work.drop(f"round-{k - 1}")
    final = _Round(books, own, before, length, scale, plain)
    return rows.mapInArrow(final.finish, "id long, label string, code string, error long"), books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): each kept vector's code, its error, the error summed
    over the rows of its label (nulls together), and a digest of all entries."""
    work = Workspace(vectors.sparkSession)
    rows, books = trained_codes(vectors, id_col, vector_col, label_col, work=work, **settings)
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    key = F.coalesce(F.concat(F.lit("="), "label"), F.lit("-"))
    rows = work.only(rows.withColumn("label", key), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = work.table(rows.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "labels")
    out = spread_join(rows, labels, "label", "n", rows.count())
    return out.select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
