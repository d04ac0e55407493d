"""Quality rules from tokeniser fertility.

Two public vocabularies split every word of the whole text, one with byte fallback and a byte-level
one for many languages; from the pieces of each come three measures: characters per token, the share
of tokens that are no whole characters, and the entropy of the token distribution in bits. Each has a
band, and a text outside a band is rejected. ``fit_measured`` takes the bands from the measures of all
good texts, by language (by script for languages with few of them). Entropy grows with the number of
tokens, so its band lies around a curve over their logarithm. Without labels the wide ``BANDS`` of
scripts hold. Texts too short to judge pass the bands and are left to the base rules.

Words are tokenised one by one, with the marker that stands for the space before them, so a word's
pieces are looked up once per worker and not once per occurrence.

Base rules (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) follow the
counts of a common web filter.

Edge cases: a null text counts as empty; an empty text has zero counts, fails the base rules and has
null measures; repeated ids give a row each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import CHUNK_BYTES, chunks, words
from .workspace import Workspace

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MIN_TOKENS = 64
MAX_WORDS_CACHED = 150_000
MIN_GROUP = 100  # good texts that a language or script needs for bands of its own
TAIL = 0.001  # share of the good texts beyond either end of a band, before it is widened
WIDEN = 0.05  # by this share of its width

#: (lowest, highest) by script; "other" holds for scripts without bands of their own.
BANDS = {
    "latin": {"chars_per_token": (1.35, 8.0), "byte_share": (0.0, 0.2), "entropy": (2.5, 16.0)},
    "cyrillic": {"chars_per_token": (1.2, 8.0), "byte_share": (0.0, 0.2), "entropy": (2.5, 16.0)},
    "other": {"chars_per_token": (0.3, 8.0), "byte_share": (0.0, 0.75), "entropy": (2.5, 16.0)},
}

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string,"
    " n_tokens long, chars_per_token double, byte_share double, entropy double,"
    " n_tokens_2 long, chars_per_token_2 double, byte_share_2 double, entropy_2 double"
)
MEASURES = ("chars_per_token", "byte_share", "entropy", "chars_per_token_2", "byte_share_2", "entropy_2")

_LATIN = re.compile(r"[A-Za-zª-ɏḀ-ỿ]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_state: dict = {}


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


class Pieces:
    """What the vocabularies make of words: flat arrays, and each word's place in them."""

    def __init__(self, model_file: str, ranks_file: str = RANKS):
        import sentencepiece
        import tiktoken

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_level = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        part = np.zeros(max(ranks.values()) + 1, bool)
        part[[i for piece, i in ranks.items() if not _whole(piece)]] = True
        self.encoders = (
            lambda texts: model.encode(texts, num_threads=1),
            lambda texts: [byte_level.encode_ordinary(" " + t) for t in texts],
        )
        self.is_byte = (np.array([model.is_byte(i) for i in range(model.get_piece_size())]), part)
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start = [np.zeros(1, np.int64) for _ in self.encoders]
        self.chars = np.empty(0, np.int64)
        self.script = np.empty(0, np.int8)
        self.flat = [np.empty(0, np.int32) for _ in self.encoders]

    def lookup(self, every: list[bytes]) -> np.ndarray:
        """The place of each word; new words are tokenised together."""
        if len(self.place) > MAX_WORDS_CACHED:
            self.clear()
        fresh = [w for w in dict.fromkeys(every) if w not in self.place]
        if fresh:
            texts = [w.decode("utf-8", "replace") for w in fresh]
            first = len(self.place)
            self.place.update(zip(fresh, range(first, first + len(fresh))))
            for v, encode in enumerate(self.encoders):
                ids = encode(texts)
                ends = np.cumsum([len(x) for x in ids]) + len(self.flat[v])
                self.start[v] = np.concatenate([self.start[v], ends])
                self.flat[v] = np.concatenate([self.flat[v], np.fromiter((i for x in ids for i in x), np.int32)])
            self.chars = np.concatenate([self.chars, [len(t) for t in texts]])
            self.script = np.concatenate([self.script, np.array([_script(t) for t in texts], np.int8)])
        return np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))


def _script(word: str) -> int:
    """0 latin, 1 cyrillic, 2 another script, 3 no letter: by the first letter of a word."""
    for c in word:
        if c.isalpha():
            return 0 if _LATIN.match(c) else 1 if _CYRILLIC.match(c) else 2
    return 3


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    _, local = np.unique(ids, return_inverse=True)
    n = int(local.max()) + 1
    local = local.astype(np.int64)
    if n < 1 << 21:
        windows = (local[:-2] * n + local[1:-1]) * n + local[2:]
    else:
        _, two = np.unique(local[:-1] * n + local[1:], return_inverse=True)
        windows = two[:-1].astype(np.int64) * n + local[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    found = np.zeros(len(ordered), bool)
    found[1:] |= same
    found[:-1] |= same
    start = order[found]
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[start + k] = True
    return int(marked.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(" \t\n\x0b\x0c\r"))
        seen.add(line)
    return n


def measure(texts: list, model_file: str = MODEL) -> list[tuple]:
    """A row of SCHEMA for each text."""
    pieces = _state.get(model_file)
    if pieces is None:
        pieces = _state[model_file] = Pieces(model_file)
    out = []
    for part in chunks(texts, CHUNK_BYTES):
        split = [words(t) for t in part]
        ids = pieces.lookup([w for s in split for w in s])
        at = 0
        for t, s in zip(part, split):
            own = ids[at : at + len(s)]
            at += len(s)
            out.append(_row(t or "", own, pieces))
    return out


def _row(text: str, own: np.ndarray, pieces: Pieces) -> tuple:
    symbols = sum(text.count(chr(c)) for c in SYMBOLS)
    chars = int(pieces.chars[own].sum())
    base = (len(own), chars, symbols, dup_lines(text), repeat_words(own))
    script = ("latin", "cyrillic", "other")[int(np.argmax(np.bincount(pieces.script[own], minlength=4)[:3]))]
    measures = [m for v in range(len(pieces.encoders)) for m in _measures(own, chars, pieces, v)]
    return (*base, script, *measures)


def _measures(own: np.ndarray, chars: int, pieces: Pieces, v: int) -> tuple:
    # pieces of all words, one after another
    start, size = pieces.start[v][own], pieces.start[v][own + 1] - pieces.start[v][own]
    total = int(size.sum())
    if not total:
        return 0, None, None, None
    offset = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    tokens = pieces.flat[v][np.repeat(start, size) + offset]
    ordered = np.sort(tokens)
    share = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))) / total
    entropy = float(-(share * np.log2(share)).sum())
    return total, chars / total, float(pieces.is_byte[v][tokens].mean()), entropy


def fertility(text: Column, model_file: str = MODEL) -> Column:
    """A struct of SCHEMA: base counts and fertility measures of each whole text."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        return pd.DataFrame(measure(texts, model_file), columns=names).astype(dict.fromkeys(MEASURES, float))

    return run(text.cast("string"))


@dataclass(frozen=True)
class Band:
    """Bounds of a measure, less ``curve`` (a, b, c: a x^2 + b x + c at x = log2 of the tokens within ``span``)."""

    low: float
    high: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    span: tuple[float, float] = (0.0, 64.0)

    def holds(self, name: str) -> Column:
        a, b, c = map(F.lit, self.curve)
        n = F.col("n_tokens_2" if name.endswith("_2") else "n_tokens")
        x = F.greatest(F.least(F.log2(n), F.lit(self.span[1])), F.lit(self.span[0]))
        return (F.col(name) - ((a * x + b) * x + c)).between(self.low, self.high)


BIN = 1024  # bins of residuals for each unit of a measure, to find the ranks of a quantile
CENTRE = 10.0  # log2 of tokens from which curves are fitted
_KEY = ("by", "name")


def _log_tokens(name: str) -> Column:
    return F.log2(F.col("n_tokens_2" if name.endswith("_2") else "n_tokens"))


def _curve(row, name: str) -> tuple[float, float, float]:
    """Least squares of a measure over log2 of the tokens, from a group's sums."""
    powers = [row[f"{name}_x{k}"] for k in range(5)]
    normal = np.array([[powers[i + j] for j in range(3)] for i in range(3)]) / row["n"]
    if np.linalg.cond(normal) > 1e12:  # fewer than three lengths
        return 0.0, 0.0, 0.0
    c, b, a = np.linalg.solve(normal, np.array([row[f"{name}_y{k}"] for k in range(3)]) / row["n"])
    # rounded, as sums of doubles depend on their order
    return round(float(a), 9), round(float(b - 2 * a * CENTRE), 9), round(float(c - b * CENTRE + a * CENTRE * CENTRE), 9)


def _ranked(values: DataFrame, n: Column) -> DataFrame:
    """(by, name, measure, r, start, end) of the residuals r at the ranks of both ends of a band, in values (.., r)."""
    key, at = [*_KEY, "measure"], lambda q: F.lit(q) * (n - 1)
    ranks = F.array(*(f(at(q)).cast("long") for q in (TAIL, 1 - TAIL) for f in (F.floor, F.ceil)))
    values = values.withColumns({"bin": F.floor(F.col("r") * BIN), "ranks": ranks})

    def hit(counted: DataFrame, within: list[str], order: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = counted.withColumn("end", F.col("base") + F.sum("c").over(before)).withColumn("start", F.col("end") - F.col("c"))
        return out.where(F.exists("ranks", lambda k: (k >= F.col("start")) & (k < F.col("end"))))

    bins = values.groupBy(*key, "bin").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks")).withColumn("base", F.lit(0))
    found = hit(bins, key, "bin").select(*key, "bin", F.col("start").alias("base"))
    # four bins of each measure and group at most
    own = values.join(F.broadcast(found), [*key, "bin"]).groupBy(*key, "bin", "base", "r").agg(F.count("*").alias("c"), F.first("ranks").alias("ranks"))
    return hit(own, [*key, "bin"], "r").select(*key, "r", "start", "end")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_file: str = MODEL) -> DataFrame:
    """(id, _lang, SCHEMA) for every row."""
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).alias("id"), lang.cast("string").alias("_lang"), fertility(F.col(text_col), model_file).alias("m")).select("id", "_lang", "m.*")


def good_ids(labels: DataFrame, eligible: Column, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """``eligible`` is a condition on the id, named ``id``; of several labels of an id the smallest counts."""
    good = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null").where(eligible)
    return good.groupBy("id").agg(F.min("label").alias("label")).where("label = 1").select("id")


def fit_measured(measured: DataFrame, good: DataFrame) -> dict:
    """Bands by ("lang" or "script", name) from the stored ``measures`` of all texts with an id of ``good``; of several rows
    of an id the smallest is taken. The driver gets sums and ends of bands, of groups of MIN_GROUP texts or more."""
    columns = ("_lang", "script", "n_words", "n_repeat_words", "n_tokens", "n_tokens_2", *MEASURES)
    own = measured.withColumn("id", F.col("id").cast("long")).join(good, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*columns)).alias("m")).select("m.*")
    own = own.where((F.col("n_tokens") >= MIN_TOKENS) & ~_base_failed())
    group = F.explode(F.array(*(F.struct(F.lit(by).alias("by"), F.col(c).alias("name")) for by, c in (("script", "script"), ("lang", "_lang"))))).alias("g")
    rows = own.select(group, "n_tokens", "n_tokens_2", *MEASURES).select("g.*", "n_tokens", "n_tokens_2", *MEASURES).where("name is not null")
    sums = [F.count("*").alias("n")]
    for m in MEASURES:
        x, y = _log_tokens(m), F.col(m)
        sums += [F.min(x).alias(f"{m}_low"), F.max(x).alias(f"{m}_high")]
        if m.startswith("entropy"):
            sums += [F.sum(F.pow(x - CENTRE, F.lit(k))).alias(f"{m}_x{k}") for k in range(5)]
            sums += [F.sum(y * F.pow(x - CENTRE, F.lit(k))).alias(f"{m}_y{k}") for k in range(3)]
    groups = {(r["by"], r["name"]): r for r in rows.groupBy(*_KEY).agg(*sums).where(F.col("n") >= MIN_GROUP).collect()}
    if not groups:
        return {}
    curves = {(*k, m): _curve(r, m) if m.startswith("entropy") else (0.0, 0.0, 0.0) for k, r in groups.items() for m in MEASURES}
    fitted = measured.sparkSession.createDataFrame([(*k, *c, groups[k[:2]]["n"]) for k, c in curves.items()], "by string, name string, measure string, a double, b double, c double, n long")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("y"), _log_tokens(m).alias("x")) for m in MEASURES))).alias("e")
    values = rows.select(*_KEY, each).select(*_KEY, "e.*").join(F.broadcast(fitted), [*_KEY, "measure"])
    values = values.select(*_KEY, "measure", "n", (F.col("y") - ((F.col("a") * F.col("x") + F.col("b")) * F.col("x") + F.col("c"))).alias("r"))
    ends: dict = {}
    for r in _ranked(values, F.col("n")).collect():
        ends.setdefault((r["by"], r["name"], r["measure"]), []).append((r["start"], r["end"], r["r"]))
    out: dict = {}
    for (by, name, m), found in ends.items():
        low, high = (_quantile(found, q * (groups[by, name]["n"] - 1)) for q in (TAIL, 1 - TAIL))
        room, r = WIDEN * (high - low) + 1e-6, groups[by, name]
        out.setdefault((by, name), {})[m] = Band(low - room, high + room, curves[by, name, m], (r[f"{m}_low"], r[f"{m}_high"]))
    return out


def _quantile(found: list[tuple], at: float) -> float:
    """The value at a rank, between those of the whole ranks beside it."""
    below, above = (next(v for start, end, v in found if start <= k < end) for k in (math.floor(at), math.ceil(at)))
    return below + (above - below) * (at - math.floor(at))


def fit_bands(
    docs: DataFrame, labels: DataFrame, eligible: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", model_file: str = MODEL,
) -> dict:
    """Bands by ("lang" or "script", name), from all labelled good texts; they are measured once."""
    work = Workspace(docs.sparkSession)
    good = good_ids(labels, eligible, label, id_col)
    texts = docs.join(good.select(F.col("id").alias("_good")), F.col(id_col).cast("long") == F.col("_good"), "left_semi").distinct()
    try:
        return fit_measured(work.table(measures(texts, id_col, text_col, lang_col, model_file), "measures"), good)
    finally:
        work.drop()


def within_bands(bands: dict = BANDS, lang: Column | None = None) -> Column:
    """True where the measures lie in the bands of the language or else the script, or can't be judged.

    ``bands`` are those of ``fit_bands``, or (lowest, highest) by script, which also hold for scripts
    that the former leave out.
    """
    fitted = {k: v for k, v in bands.items() if isinstance(k, tuple)}
    ok = F.lit(True)
    by_script = {s: {m: Band(*b) for m, b in own.items()} for s, own in (BANDS if fitted or not bands else bands).items()}
    choices = [(F.col("script") == s, own) for s, own in by_script.items()]
    choices += [(F.col("script") == s, own) for (by, s), own in fitted.items() if by == "script"]
    if lang is not None:
        choices += [(lang == s, own) for (by, s), own in fitted.items() if by == "lang"]
    for chosen, own in choices:
        inside = F.lit(True)
        for name, band in own.items():
            inside = inside & band.holds(name)
        ok = F.when(chosen, inside).otherwise(ok)
    return F.coalesce(F.when(F.col("n_tokens") < MIN_TOKENS, F.lit(True)).otherwise(ok), F.lit(True))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, bands: dict = BANDS, lang_col: str = "lang"
) -> DataFrame:
    """(id, counts, measures, base_failed, kept) for every row."""
    return judged(measures(docs, id_col, text_col, lang_col, model_file), bands)


def judged(measured: DataFrame, bands: dict = BANDS) -> DataFrame:
    rows = measured.withColumn("base_failed", _base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & within_bands(bands, F.col("_lang"))).drop("_lang")
