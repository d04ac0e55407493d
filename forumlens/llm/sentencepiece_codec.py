"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and scores come from a public model file. A unigram model's scores are log probabilities
and are used as they are; a merge-ranked (BPE) model has ranks instead, which become log scores by
Zipf's law, -log(rank + 1). A text is marked (a space becomes the marker, with one before the
text) and cut before every marker that follows another sign, as no piece has a marker after another
sign; runs of markers are thus cut from words by the pieces themselves. Each segment is then encoded
by the path of highest total score, all segments of a batch at once: a double-array trie finds the
pieces at all places together, and the best scores are filled in place by place. Characters without
a piece become byte-fallback pieces, as does a marker sign that stands in the text itself, so
decoding gives back every text exactly.

Edge cases: a null text gives null ids and decodes to null; an empty text gives no ids; repeated ids
give a row each; other columns pass unused; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import CHUNK_BYTES, chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
MAX_CACHED = 300_000
#: segments of more characters are encoded one by one
LONG = 200
#: below any sum of piece scores, for each byte of a character that has no piece
BYTE_PENALTY = 30.0

_SEGMENT = re.compile(f"{MARKER}*[^{MARKER}]*")
_state: dict = {}


class DoubleArray:
    """A trie over bytes: from state s by byte c to base[s] + c, if check of that place is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys.items():
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    value.append(-1)
                at = nxt
            value[at] = number
        size = max(1024, 2 * len(children) + 512)
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        values = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        # the search for room starts behind places that have turned out to be crowded
        place, queue, crowded = {0: 0}, [0], 1
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            at, tries = used.find(0, max(1 + kids[0], crowded)), 0
            while True:
                if at < 0 or at + 256 >= len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    base = np.concatenate([base, np.zeros(more, np.int32)])
                    check = np.concatenate([check, np.full(more, -1, np.int32)])
                    values = np.concatenate([values, np.full(more, -1, np.int32)])
                    at = used.find(0, max(1 + kids[0], crowded)) if at < 0 else at
                b = at - kids[0]
                if not any(used[b + c] for c in kids):
                    break
                at, tries = used.find(0, at + 1), tries + 1
            if tries > 40:
                crowded = at
            base[place[node]] = b
            for c in kids:
                kid = children[node][c]
                used[b + c] = 1
                check[b + c] = place[node]
                values[b + c] = value[kid]
                place[kid] = b + c
                queue.append(kid)
        end = max(place.values()) + 257
        pad = max(0, end - len(base))
        self.base = np.concatenate([base, np.zeros(pad, np.int32)])[:end]
        self.check = np.concatenate([check, np.full(pad, -1, np.int32)])[:end]
        self.value = np.concatenate([values, np.full(pad, -1, np.int32)])[:end]
        self.longest = max(map(len, keys), default=0)

    def find(self, key: bytes) -> int:
        at = 0
        for c in key:
            nxt = int(self.base[at]) + c
            if self.check[nxt] != at:
                return -1
            at = nxt
        return int(self.value[at])


def _marked(key: str) -> str:
    return key[1:] if key[:1] == MARKER else MARKER + key


@dataclass
class Vocabulary:
    """Normal pieces with scores, the ids of the 256 byte pieces, and the text of every id."""

    pieces: dict[str, int]
    scores: np.ndarray
    byte_ids: list[int]
    texts: list[bytes]

    @staticmethod
    def load(model_file: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        raw = np.array([model.get_score(i) for i in range(size)])
        pieces, byte_ids, texts = {}, [-1] * 256, [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                texts[i] = piece.replace(MARKER, " ").encode()
        if min(byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        own = raw[list(pieces.values())]
        ranked = len(own) > 1 and bool(np.all(own == np.round(own))) and float(own.min()) < -100
        # pieces of the lowest score can't be merged in a ranked model; they rank last here
        scores = np.where(raw < -1e8, -np.log(size + 1.0), -np.log1p(np.abs(raw))) if ranked else raw
        return Vocabulary(pieces, scores, byte_ids, texts)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = DoubleArray({p.encode(): i for p, i in vocabulary.pieces.items()})
        self.scores = vocabulary.scores
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        if self.trie.longest > 63:
            raise ValueError("pieces of up to 63 bytes are supported")
        self.longest_gap = float(np.abs(self.scores).max()) + BYTE_PENALTY
        self._forget()

    def _segments(self, text: str) -> list[str]:
        """Keys of the segments: a word stands for itself with one marker in front; any other segment
        is written out behind a marker sign, and the marker sign alone is a literal one."""
        if "  " not in text and text[0] != " " and MARKER not in text:
            return text.split(" ")
        out: list[str] = []
        for i, part in enumerate(text.split(MARKER)):
            if i:
                out.append(MARKER)
            marked = part.replace(" ", MARKER)
            out += [MARKER + s for s in _SEGMENT.findall(marked if i else MARKER + marked) if s]
        return out

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where the ids of each segment are; segments that aren't known yet are encoded together."""
        if len(self.place) > MAX_CACHED:
            self._forget()
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [keys[i] for i in missing.tolist()]
            self._fill(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.place.__getitem__, unknown), np.int64, len(unknown))
        return at

    def _fill(self, fresh: list[str]) -> None:
        long = [k for k in fresh if len(k) > LONG]
        short = [k for k in fresh if len(k) <= LONG]
        ids, sizes = self._viterbi([_marked(k) for k in short])
        rest = [self._viterbi_long(_marked(k)) for k in long]
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        self.place.update(zip(short + long, range(len(self.place), len(self.place) + len(fresh))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids, *rest])

    def _forget(self) -> None:
        literal = self.byte_ids[list(MARKER.encode())]
        self.place = {MARKER: 0}
        self.start = np.array([0, len(literal)], np.int64)
        self.flat = literal.astype(np.int32)

    def _viterbi_long(self, segment: str) -> np.ndarray:
        """The best path of one segment of any length, place by place."""
        raw = segment.encode("utf-8", "surrogatepass")
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n = len(raw)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            if raw[i] & 0xC0 == 0x80:
                continue
            width = 1 if raw[i] < 0xC0 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
            at, whole = 0, False
            for j in range(i, n):
                nxt = int(base[at]) + raw[j]
                if check[nxt] != at or nxt == 0:
                    break
                at = nxt
                number = int(value[at])
                if number >= 0:
                    whole |= j + 1 - i == width
                    score = best[i] + float(self.scores[number])
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (i, number)
            if not whole and best[i] - self.longest_gap * width > best[i + width]:
                best[i + width], back[i + width] = best[i] - self.longest_gap * width, (i, -1)
        out, at = [], n
        while at > 0:
            i, number = back[at]
            out += [number] if number >= 0 else [int(self.byte_ids[c]) for c in reversed(raw[i:at])]
            at = i
        return np.array(out[::-1], np.int32)

    def _viterbi(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of non-empty segments, all at once: the ids one after another, and their counts."""
        if not segments:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw) + bytes(self.trie.longest + 1), np.uint8).astype(np.int32)
        total = int(size.sum())
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(total)  # bytes left in the segment
        lead = (data[:total] & 0xC0) != 0x80
        # all matches: (from, length, id), by walking the trie from every character at once
        at, state, found = np.flatnonzero(lead), np.zeros(int(lead.sum()), np.int32), []
        has_one = np.zeros(total, bool)
        width = np.ones(total, np.int32)
        byte = data[:total]
        width[byte >= 0xC0], width[byte >= 0xE0], width[byte >= 0xF0] = 2, 3, 4
        for depth in range(self.trie.longest):
            alive = room[at] > depth
            at, state = at[alive], state[alive]
            if not len(at):
                break
            nxt = self.trie.base[state] + data[at + depth]
            alive = (self.trie.check[nxt] == state) & (nxt > 0)
            at, state = at[alive], nxt[alive]
            number = self.trie.value[state]
            hit = number >= 0
            if hit.any():
                found.append((at[hit], np.full(int(hit.sum()), depth + 1, np.int32), number[hit]))
                has_one[at[hit][width[at[hit]] == depth + 1]] = True
        # characters that are no piece: an edge over the whole character
        gaps = np.flatnonzero(lead & ~has_one)
        gap_width = np.minimum(width[gaps], room[gaps])
        found.append((gaps, gap_width, np.full(len(gaps), -1, np.int32)))
        frm = np.concatenate([f for f, _, _ in found])
        length = np.concatenate([n for _, n, _ in found])
        number = np.concatenate([i for _, _, i in found])
        score = np.where(number >= 0, self.scores[number], -self.longest_gap * length)
        # fill in by place within the segment, then by length: the targets of a group differ, and
        # among equal scores the longest piece comes first and stays
        inside = frm - np.repeat(start, size)[frm]
        group = (inside * 64 + length).astype(np.uint16)  # LONG bounds the place, the model the length
        order = np.argsort(group, kind="stable")
        group = group[order]
        node = np.arange(total) + np.repeat(np.arange(len(raw)), size)  # one place more for each segment
        source, length, number, score = node[frm[order]], length[order], number[order], score[order]
        target = source + length
        best = np.full(total + len(raw), -np.inf)
        back_len, back_id = np.zeros(total + len(raw), np.int32), np.full(total + len(raw), -1, np.int32)
        best[start + np.arange(len(raw))] = 0.0
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            to, value = target[lo:hi], best[source[lo:hi]] + score[lo:hi]
            better = value > best[to]
            to = to[better]
            best[to] = value[better]
            back_len[to] = length[lo:hi][better]
            back_id[to] = number[lo:hi][better]
        # walk back from all ends together
        ends = start + size + np.arange(len(raw))
        low = start + np.arange(len(raw))
        which = np.arange(len(raw))
        steps = []
        while len(ends):
            live = ends > low
            ends, low, which = ends[live], low[live], which[live]
            if not len(ends):
                break
            n, i = back_len[ends], back_id[ends]
            steps.append((which, ends - n - which, n, i))
            ends = ends - n
        which, pos, n, i = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((pos, which))
        which, pos, n, i = which[order], pos[order], n[order], i[order]
        many = np.where(i >= 0, 1, n)
        flat = np.repeat(i, many)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
        fallback = flat < 0
        flat[fallback] = self.byte_ids[data[(np.repeat(pos, many) + offset)[fallback]]]
        per = np.bincount(which, many, len(raw)).astype(np.int64)
        return flat.astype(np.int32), per

    def encode_part(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and where each text's ids end."""
        split = [self._segments(t) if t else [] for t in texts]
        every = [k for own in split for k in own]
        at = self._places(every)
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        total = int(size.sum())
        ids = self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(own) for own in split])]

    def encode(self, texts: list) -> list[np.ndarray | None]:
        out = []
        for part in chunks(texts, CHUNK_BYTES):
            ids, ends = self.encode_part(part)
            out += [None if t is None else x for t, x in zip(part, np.split(ids, ends[:-1]))]
        return out

    def decode(self, ids) -> str | None:
        """The text of a sequence of ids: pieces and bytes joined, without the marker in front."""
        if ids is None:
            return None
        raw = b"".join(map(self.vocabulary.texts.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def codec(model_file: str = MODEL) -> Codec:
    if model_file not in _state:
        _state[model_file] = Codec(Vocabulary.load(model_file))
    return _state[model_file]


def encoded(
    docs: DataFrame, text_col: str = "text", ids_col: str = "ids", check_col: str = "round_trip", model_file: str = MODEL
) -> DataFrame:
    """The rows with the ids of each whole text, and whether decoding them gives the text back.

    Columns of the two names are replaced. Rows leave in batches of about CHUNK_BYTES of text.
    """
    rows = docs.drop(ids_col, check_col)
    place = rows.columns.index(text_col)
    names = [*rows.columns, ids_col, check_col]

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            at = 0
            for part in chunks(batch.column(place).to_pylist(), CHUNK_BYTES):
                ids, ends = own.encode_part(part)
                starts = np.concatenate([[0], ends[:-1]])
                same = [t is None or own.decode(ids[a:b].tolist()) == t for t, a, b in zip(part, starts.tolist(), ends.tolist())]
                offsets = pa.array(np.concatenate([starts, ends[-1:]]), pa.int32(), mask=np.array([*(t is None for t in part), False]))
                coded = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                cut = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*cut.columns, coded, pa.array(same, pa.bool_())], names)

    schema = T.StructType([*rows.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(check_col, T.BooleanType())])
    return rows.mapInArrow(run, schema)


def decode(ids: Column, model_file: str = MODEL) -> Column:
    """The text of each sequence of ids."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([codec(model_file).decode(r) for r in rows])

    return run(ids)
