"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has its character boundaries as nodes and vocabulary pieces
as edges.  The search keeps one surviving backpointer for each boundary and only a
window of boundaries: no later edge starts more than the longest piece behind the
newest boundary, so as soon as the backpointer paths of all boundaries in that
reach run through one common boundary, the ids up to it are committed and
forgotten.  Memory follows the longest piece and how late paths meet, not the text.

The scores are the model's own.  ``unigram`` models sum piece scores.  ``bpe``
models (the public one here) order merges; there a path is admissible if every two
neighbouring pieces would stay apart when merged by rank, which leaves exactly one
admissible path for each prefix, the model's own segmentation.  So the search is
the same with a path score of 0 or minus infinity.

Pieces hold no space mark behind another character (a model in which one does is refused), so all paths meet in front
of a run of spaces, and the ids up to there are committed; what is searched and
committed between two such boundaries is remembered, in a bounded cache.  Inside a
long stretch without spaces the search looks for a common boundary itself.

Plan: narrow Arrow batches next to the scan, no shuffle.  The driver reads the
model file (path given) and broadcasts its tables, a few MB that don't depend on
the data.

The model's type, pieces and normaliser are read from its file; a model with user-defined
symbols, or that normalises text in any other way than by one space in front, is refused.

Defined cases: null text encodes to null and null ids decode to null; empty text
has no ids; a character outside the vocabulary becomes its UTF-8 byte pieces (the
unknown id where the model has none); U+2581 itself encodes as a space and so
decodes as one; ids outside the vocabulary decode to nothing; incoming columns
named like the results are replaced.
"""

from __future__ import annotations

import array
import hashlib
import math
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import row_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct stretches that a worker remembers, and the longest that it does.
REMEMBER, STRETCH = 120_000, 64
#: Boundaries searched between two looks for a common one.
LOOK = 256


def merge_by_rank(parts: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge neighbours, lowest rank first, leftmost first; the result and the last merge made."""
    parts, last = list(parts), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _parts(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message in order: numbers, or the bytes of parts."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            at += n
            yield key >> 3, raw[at - n : at]


def _fields(raw: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a message."""
    return dict(_parts(raw))


def model_kind(proto: bytes) -> str:
    """``unigram`` or ``bpe``; a model that this codec would encode otherwise than the library is refused."""
    # Field numbers and defaults of the public model format.
    model = _fields(proto)
    trainer, normalizer = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
    if kind is None:
        raise ValueError(f"model type {trainer.get(3)} is neither unigram nor bpe")
    if trainer.get(24, 0):
        raise ValueError("white space as a suffix isn't supported")
    pieces = [_fields(raw) for field, raw in _parts(proto) if field == 1]
    if any(p.get(3, 1) == 4 for p in pieces):
        raise ValueError("models with user-defined symbols, which are cut out before the search, aren't supported")
    if any(MARK in p[1].decode().lstrip(MARK) for p in pieces if p.get(3, 1) == 1):
        raise ValueError("models with a space mark inside a piece aren't supported: texts are cut at spaces first")
    if normalizer.get(2, b""):
        raise ValueError("models that rewrite characters before they encode aren't supported")
    if not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that put a space in front, keep all spaces and mark them are supported")
    return kind


class Vocabulary:
    """The tables of a model that encoding and decoding need."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, special: set[int], byte_ids: dict[int, int], unk: int):
        self.kind, self.unk, self.byte_ids, self.scores = kind, unk, byte_ids, scores
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.split: dict[int, tuple[int, int]] = {}
        if kind == "bpe":
            order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-scores[self.ids[p]], self.ids[p]))
            rank = {p: r for r, p in enumerate(order)}
            self.rank = {self.ids[p]: r for p, r in rank.items()}
            for p in order:
                whole, last = merge_by_rank(list(p), rank)
                if len(whole) == 1 and all(x in self.ids for x in last):
                    self.split[self.ids[p]] = (self.ids[last[0]], self.ids[last[1]])
                else:  # merging never arrives at this piece
                    del self.ids[p]
        self.longest = max(map(len, self.ids), default=1)
        alone = {c for p in self.ids if len(p) > 1 for c in p}
        self.newline_alone = "\n" not in alone
        self.text = [b""] * len(pieces)
        for p, i in self.ids.items():
            self.text[i] = p.replace(MARK, " ").encode()
        for i in range(len(pieces)):
            if i not in special and not self.text[i]:
                self.text[i] = pieces[i].replace(MARK, " ").encode()
        for byte, i in byte_ids.items():
            self.text[i] = bytes([byte])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file; the library serves as its parser only."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
        special = {i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)} | set(bytes_.values())
        kind = model_kind(sp.serialized_model_proto())
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], kind, special, bytes_, sp.unk_id())


class Encoder:
    """Streaming search over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: Finds all pieces that end at each character, longest first, as (length, id).
        self.pieces = ahocorasick.Automaton()
        for p, i in vocabulary.ids.items():
            self.pieces.add_word(p, (len(p), i))
        self.pieces.make_automaton()
        self.single = {p for p in vocabulary.ids if len(p) == 1}
        by_text = vocabulary.ids
        #: What two pieces make if they are joined, and its rank.
        self.joined = {}
        for p, z in by_text.items() if vocabulary.kind == "bpe" else ():
            for k in range(1, len(p)):
                if p[:k] in by_text and p[k:] in by_text:
                    self.joined[by_text[p[:k]], by_text[p[k:]]] = vocabulary.rank[z]
        self.apart: dict[int, bool] = {}
        self.lowest = min(vocabulary.scores, default=0.0) - 10.0  # for a character outside the vocabulary
        self.size = len(vocabulary.text)
        #: Stretches seen lately, and the generation before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ends = "\n" if vocabulary.newline_alone else ""
        self.stretches = re.compile(f"{MARK}+[^{MARK}{ends}]*|[^{MARK}{ends}]+" + ("|\n" if ends else ""))

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether rank merging keeps pieces ``a`` and ``b``, side by side, as they are.

        Undoes merges on both sides of their boundary, latest first; the pieces that
        then touch were neighbours once, until the earlier of the two undone merges.
        """
        key = a * self.size + b
        if key in self.apart:
            return self.apart[key]
        rank, split, joined = self.v.rank, self.v.split, self.joined
        until_left = until_right = len(rank)
        x, y, result = a, b, True
        while True:
            z = joined.get((x, y))
            # Of two merges of one rank the left one goes first.
            if z is not None and z < until_left and z <= until_right:
                result = False
                break
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until_left, x = rx, split[x][1]
            else:
                until_right, y = ry, split[y][0]
        if len(self.apart) >= 200_000:
            self.apart.clear()
        self.apart[key] = result
        return result

    def _outside(self, c: str) -> list[int]:
        """The ids of a character that no piece holds."""
        return [self.v.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unk]

    def search(self, text: str, window: list | None = None) -> array.array:
        """Ids of ``text``, searched as one lattice.  ``window`` collects the widths kept, for tests.

        ``last``, ``back`` and ``value`` hold, for the boundaries from ``base`` on, the piece
        that the surviving path ends with (-1 for a character outside the vocabulary), where
        that piece starts, and for sums of scores the path's.  What is before ``base`` is committed.
        """
        scores, size, single = self.v.scores, self.size, self.single
        bpe, apart, stay_apart = self.v.kind == "bpe", self.apart, self.stay_apart
        out, base, newest = array.array("i"), 0, 0
        last, back, value = [-1], [0], [0.0]
        for end, (width, i) in self.pieces.iter(text):
            end += 1
            if newest < end - 1:
                newest = self._pass_over(newest, end - 1, last, back, value)
            start = end - width
            if bpe:
                if newest < end:  # else the path to here is known, and there is only one
                    before = last[start - base]
                    fits = before < 0 or apart.get(before * size + i)
                    if fits or (fits is None and stay_apart(before, i)):
                        last.append(i)
                        back.append(start)
                        newest = end
                else:
                    continue
            else:
                score = value[start - base] + scores[i]
                if newest < end:
                    newest = self._pass_over(newest, end, last, back, value)
                    if text[end - 1] in single:
                        value[-1] = -math.inf
                if score > value[-1]:
                    last[-1], back[-1], value[-1] = i, start, score
            if newest - base >= LOOK and (newest - base) % (LOOK // 4) == 0:
                meet = self._meeting(newest, base, back)
                if meet > base:
                    self._commit(text, base, meet, last, back, out)
                    del last[: meet - base], back[: meet - base], value[: meet - base]
                    base = meet
                if window is not None:
                    window.append(len(last))
        self._pass_over(newest, len(text), last, back, value)
        self._commit(text, base, len(text), last, back, out)
        return out

    def _pass_over(self, newest: int, end: int, last: list, back: list, value: list) -> int:
        """Boundaries up to ``end`` that only characters outside the vocabulary lead to."""
        while newest < end:
            last.append(-1)
            back.append(newest)
            if self.v.kind != "bpe":
                value.append(value[-1] + self.lowest)
            newest += 1
        return newest

    def _meeting(self, newest: int, base: int, back: list) -> int:
        """Where the paths to all boundaries meet that a later piece can start at: the ids up to there are settled."""
        paths = set(range(max(base, newest - self.v.longest), newest + 1))
        while len(paths) > 1:
            q = max(paths)
            paths.remove(q)
            paths.add(back[q - base])
        return paths.pop()

    def _commit(self, text, base, end, last, back, out) -> None:
        ids = []
        while end > base:
            i, start = last[end - base], back[end - base]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(reversed(self._outside(text[start:end])))
            end = start
        ids.reverse()
        out.extend(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        known, out = self.known, []
        for s in self.stretches.findall(MARK + text.replace(" ", MARK)):
            ids = known.get(s)
            if ids is None:
                ids = self.older.get(s)
                if ids is None:
                    ids = self.search(s).tobytes()
                if len(s) <= STRETCH:
                    if len(known) >= REMEMBER:
                        self.older, self.known = known, {}
                        known = self.known
                    known[s] = ids
            out.append(ids)
        return b"".join(out)


def decode_ids(text: list[bytes], ids: np.ndarray) -> str:
    """The text of some ids: pieces joined, one space in front dropped."""
    if len(ids) and not (0 <= ids.min() and ids.max() < len(text)):
        ids = ids[(ids >= 0) & (ids < len(text))]
    raw = b"".join([text[i] for i in ids.tolist()])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(tables) -> Encoder:
    """The worker's encoder for these tables; its cache of stretches outlives a task."""
    name, blob = tables.value
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(pickle.loads(blob))
    return _encoders[name]


_texts: dict[str, list[bytes]] = {}


def _piece_texts(tables) -> list[bytes]:
    """The worker's texts of the pieces."""
    name, blob = tables.value
    if name not in _texts:
        _texts.clear()
        _texts[name] = pickle.loads(blob).text
    return _texts[name]


def load_tables(df: DataFrame, path: str = MODEL):
    """The model's tables as a broadcast variable."""
    blob = pickle.dumps(Vocabulary.load(path))
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(blob).hexdigest(), blob))


def _slice(b: pa.RecordBatch, i: int, j: int, drop: str) -> dict:
    return {c: b.column(c).slice(i, j - i) for c in b.schema.names if c != drop}


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", out: str = "ids", decoded: str | None = None, tables=None) -> DataFrame:
    """``docs`` with ``out``: the model's ids of each whole text.

    With ``decoded``, that column gets the text of the ids, decoded in the same pass.
    """
    tables = tables or load_tables(docs, path)
    docs = docs.drop(out, decoded or out)
    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches):
        e = _encoder(tables)
        for b in batches:
            for i, j in row_slices(b.column(text)):
                ids = [None if t is None else e.encode(t) for t in b.column(text).slice(i, j - i).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x or b"") // 4 for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets),
                    pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), "<i4")),
                    mask=pa.array([x is None for x in ids]),
                )
                new = {out: lists}
                if decoded:
                    new[decoded] = pa.array(
                        [None if x is None else decode_ids(e.v.text, np.frombuffer(x, "<i4")) for x in ids],
                        pa.string(),
                    )
                yield pa.RecordBatch.from_pydict(_slice(b, i, j, out) | new)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, path: str = MODEL, ids: str = "ids", out: str = "decoded", tables=None) -> DataFrame:
    """``rows`` with ``out``: the text of each list of ids."""
    tables = tables or load_tables(rows, path)
    rows = rows.drop(out)

    def run(batches):
        text = _piece_texts(tables)
        for b in batches:
            lists = b.column(ids)
            for i in range(0, len(lists), 256):
                j = min(len(lists), i + 256)
                texts = [decode_ids(text, x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists.slice(i, j - i)]
                yield pa.RecordBatch.from_pydict(_slice(b, i, j, out) | {out: pa.array(texts, pa.string())})

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
