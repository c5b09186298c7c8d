"""Best-fit packing of tokenised documents into sequences, by linear grouping.

A document is its tokens and one end token; only one that is longer than a sequence is
cut, into pieces of a whole sequence and a rest.  Pieces over a share of a sequence are
large.  Sorted by length they fall into groups of equal number, each rounded up to its
longest; a sequence holds three of them at most, so all configurations of the few rounded
sizes are listed and a linear program (revised simplex) chooses how often each is used.
Whole uses are kept; actual pieces, by rank, take the places of their rounded size, but for
each configuration's smallest place, which goes to what fits best there.  What is left,
large and then small pieces, longest first, goes where it fits best by actual lengths.  The
share that makes a piece large (``SHARES``) and the number of groups (``GROUPS``) are tried
in turn, and the packing of the fewest sequences counts: rounding costs more than the
program gains where short pieces abound, and the other way round.

Plan.  All that the packing needs to know is how many pieces have each length, which is at
most ``room`` numbers whatever the size of the corpus.  Pieces get global numbers in the
order of length: ids, lengths and checksums, not texts, are range-partitioned, sorted and
checkpointed, and the driver sees one count for each partition and length bin.  The packing
is made of runs: pieces numbered [a, b) go to sequences from s on, q a sequence, at offsets
from o on in steps.  The runs (a few thousand, their number doesn't follow the rows) reach
the tasks with the function that applies them; sequence and offset of a piece are then
arithmetic, without another shuffle.  Equal lengths are ordered by a hash, so that any
number of them spreads over partitions.

Defined cases: null text is empty and has the end token alone; repeated rows are packed
each; an empty table gives an empty result; columns other than the id and the text are not
looked at; strings of special tokens in a text are what the tokenizer makes of them.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
ROOM, END = 2048, 0
#: Large pieces are longer than 1/4, 1/3 or 1/2 of a sequence (at most three go into one); their groups.
SHARES, GROUPS = (4, 3, 2), (64, 128)
#: Words that a worker remembers; characters of a text that are split at once.
REMEMBER, SLICE = 500_000, 1 << 20


class Words(dict):
    """Ids of the words of a text, as little-endian unsigned 32-bit numbers, remembered by word (and the generation before).

    Words are what spaces separate.  For a tokenizer that drops white space and whose
    patterns don't look over it (``apart``), a text's ids are those of its words.
    """

    # What the public word-level tokenizer does before it merges.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_str(config)
        said = json.loads(config)
        steps = (said.get("normalizer") or {}).get("normalizers") or []
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.apart = (
            [s["type"] for s in steps] == self.NORMALIZERS
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and cuts[0].get("pattern") == {"Regex": self.PATTERN}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and not any(c["lstrip"] or c["rstrip"] or " " in c["content"] for c in said.get("added_tokens", []))
        )
        #: Begins a special token, so that a word without it holds none.
        marks = {c["content"][0] for c in said.get("added_tokens", [])}
        self.mark = marks.pop() if len(marks) == 1 else ""
        self.pattern = regex.compile(self.PATTERN)
        self.older: dict[str, bytes] = {}
        self.apart = self.apart and self._rank(said["model"])

    def _rank(self, model: dict) -> bool:
        """Merges by rank over bytes, where the byte 0xFF stands for the end of a word; whether the model allows for it."""
        import tiktoken

        solid = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        byte = {(b if b in set(solid) else next(rest)): b for b in range(256)}
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]

        def raw(token: str) -> bytes:
            bare = token.removesuffix(suffix) if suffix and token != suffix else token
            return bytes(byte[ord(c)] for c in bare) + (b"\xff" if bare != token else b"")

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        try:
            order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(256)] + [raw(a + b) for a, b in merges]
            ids = {raw(t): i for t, i in vocab.items() if t not in {c.content for c in self.whole.get_added_tokens_decoder().values()}}
        except KeyError:  # tokens that aren't bytes
            return False
        if not suffix or len(set(order)) != len(order) or any(t not in ids for t in order):
            return False
        self.one = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})._encode_single_piece
        self.raw = [ids[t].to_bytes(4, "little") for t in order]
        return True

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.raw.__getitem__, self.one(piece.encode() + b"\xff")))

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            # Latin letters in composed form are lowered and cut here; the library sees the rest as it is.
            latin = word.isascii() or (max(word) < "ɐ" and unicodedata.is_normalized("NFC", word))
            if word and latin and word.isprintable() and self.mark not in word:
                low = word.lower()
                if low.isalpha():
                    found = self._piece(low)
                elif low[:-1].isalpha() and not low[-1].isalnum():
                    found = self._piece(low[:-1]) + self._piece(low[-1])
                else:
                    found = b"".join(map(self._piece, self.pattern.findall(low)))
            else:
                found = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str):
        """Ids of a text, those of a bounded part at a time."""
        if not self.apart:
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return
        at = 0
        while at < len(text):
            end = at + SLICE
            end = len(text) if end >= len(text) else text.find(" ", end) % (len(text) + 1)
            yield b"".join(map(self.__getitem__, text[at:end].split(" ")))
            at = end + 1


_words: dict[int, Words] = {}


def _pieces(config, room: int, end: int, with_ids: bool):
    """Tokenises texts and cuts them: id, hash, piece, start, length, checksum and, if asked for, the ids."""

    def run(batches):
        key = zlib.crc32(config.value.encode())
        words = _words.get(key) or _words.setdefault(key, Words(config.value))
        last, size = np.uint32(end).tobytes(), 4 * room
        for batch in batches:
            rows, crc, ids = [], [], []

            def out(i, n, part):
                rows.append((i, n, len(part) // 4))
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int64))

            for i, text in enumerate(batch.column(2).to_pylist()):
                n, held = 0, b""
                for more in words.ids(text or ""):
                    held += more
                    whole = max(0, (len(held) - 1) // size) * size  # the last piece waits for the end token
                    for at in range(0, whole, size):
                        out(i, n, held[at : at + size])
                        n += 1
                    held = held[whole:]
                held += last
                for at in range(0, len(held), size):
                    out(i, n, held[at : at + size])
                    n += 1
            at, n, length = np.array(rows, np.int64).reshape(-1, 3).T
            found = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(n.astype(np.int32)), pa.array(n * room), pa.array(length), pa.array(crc, pa.int64())]
            names = ["id", "h", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(found + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), names + ["ids"] * with_ids)

    return run


def configurations(sizes: np.ndarray, room: int) -> np.ndarray:
    """All multisets of one to three sizes that fit, as rows of indices, -1 for none."""
    none = len(sizes)
    size = np.append(sizes, 0)
    a, b, c = (x.ravel() for x in np.meshgrid(*[np.arange(none + 1)] * 3, indexing="ij"))
    fits = (a <= b) & (b <= c) & (a < none) & (size[a] + size[b] + size[c] <= room)
    return np.stack([a, b, c], 1)[fits] % (none + 1)


def optimise(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[tuple[int, ...], float]]:
    """How often each configuration is used for the least number of sequences; parts of a use are allowed."""
    k = len(sizes)
    all_ = configurations(sizes, room)
    columns = np.array([[i, k, k] for i in range(k)])
    inverse, x = np.eye(k), demand.astype(float)
    for _ in range(200 * k):
        price = np.append(inverse.sum(0), 0.0)
        gain = price[all_].sum(1) - 1
        best = int(gain.argmax())
        if gain[best] < 1e-9:
            break
        enter = inverse @ np.bincount(all_[best], minlength=k + 1)[:k]
        limit = np.where(enter > 1e-9, x / np.where(enter > 1e-9, enter, 1), np.inf)
        leave = int(limit.argmin())
        step = limit[leave]
        x = np.maximum(x - step * enter, 0)
        x[leave] = step
        inverse[leave] /= enter[leave]
        others = np.arange(k) != leave
        inverse[others] -= np.outer(enter[others], inverse[leave])
        columns[leave] = all_[best]
    return [(tuple(i for i in c.tolist() if i < k), float(n)) for c, n in zip(columns, x) if n > 0]


class Packing:
    """Runs of numbered pieces, made from the number of pieces of each length (index 0 to room)."""

    def __init__(self, histogram: np.ndarray, room: int, groups: int, share: int):
        self.room, self.count = room, histogram.astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))  # number of the first piece of each length
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # first, end, sequence, pieces a sequence, offset, step
        self.space: dict[int, list[tuple[int, int]]] = defaultdict(list)  # sequences [s, e) by the room left
        self.sequences = 0
        self.placed: list[tuple[int, int]] = []
        self._whole()
        self._large(groups, share)
        self._rest()
        self.table = np.array(sorted(self.runs), np.int64).reshape(-1, 6)

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _whole(self) -> None:
        n = int(self.count[self.room])
        if n:
            a = int(self.first[self.room])
            self.runs.append((a, a + n, self._open(n), 1, 0, 0))

    def _lengths(self, a: int, b: int) -> list[tuple[int, int]]:
        """Stretches of one length in the numbers [a, b): (first number, length)."""
        lo, hi = int(np.searchsorted(self.first, a, "right")) - 1, int(np.searchsorted(self.first, b - 1, "right")) - 1
        return [(max(a, int(self.first[x])), x) for x in range(lo, hi + 1) if self.count[x]]

    def _large(self, groups: int, share: int) -> None:
        """Groups of equal number from the longest down; whole uses of the configurations, less their smallest place."""
        low, high = int(self.first[self.room // share + 1]), int(self.first[self.room])
        n = high - low
        if not n:
            return
        bounds = np.unique(np.linspace(0, n, min(groups, n) + 1).astype(np.int64))
        tops = high - bounds  # group g holds the numbers [tops[g + 1], tops[g])
        sizes = np.searchsorted(self.first, tops[:-1] - 1, "right") - 1
        used = [0] * len(sizes)
        for slots, x in optimise(sizes, np.diff(bounds), self.room):
            times = int(x + 1e-6)
            for g in set(slots):
                times = min(times, int(tops[g] - tops[g + 1] - used[g]) // slots.count(g))
            if times <= 0:
                continue
            taken = []
            for g in slots[:-1] or slots:
                used[g] += times
                taken.append(int(tops[g]) - used[g])  # numbers [taken, taken + times), one a sequence
            self._fill(self._open(times), times, taken)
        self.placed = [(int(tops[g] - used[g]), int(tops[g])) for g in range(len(sizes))]

    def _fill(self, sequence: int, times: int, taken: list[int]) -> None:
        parts = [self._lengths(a, a + times) for a in taken]
        edges = sorted({at - a for a, own in zip(taken, parts) for at, _ in own})
        for t, until in zip(edges, [*edges[1:], times]):
            offset = 0
            for a in taken:
                self.runs.append((a + t, a + until, sequence + t, 1, offset, 0))
                offset += int(np.searchsorted(self.first, a + t, "right")) - 1
            self.space[self.room - offset].append((sequence + t, sequence + until))

    def _left(self) -> list[tuple[int, int, int]]:
        """Pieces without a place, longest first: (first number, end, length)."""
        out, high = [], int(self.first[self.room])
        for a, b in [*sorted(self.placed, reverse=True), (0, 0)]:
            if b < high:
                ends = self._lengths(b, high)
                out += [(at, end, x) for (at, x), end in zip(ends, [*(s for s, _ in ends[1:]), high])][::-1]
            high = a
        return out

    def _rest(self) -> None:
        """Best fit, longest first: the least room that is enough, filled before the next sequence is looked at."""
        rooms = np.zeros(self.room + 1, bool)
        rooms[[r for r in self.space]] = True
        for a, b, length in self._left():
            while a < b:
                fit = np.flatnonzero(rooms[length:])
                r = int(fit[0]) + length if len(fit) else self.room
                each = r // length
                if not len(fit):
                    n = -(-(b - a) // each)
                    s = self._open(n)
                    self.space[r].append((s, s + n))
                s, e = self.space[r].pop()
                full = min(e - s, (b - a) // each)
                if full:
                    self.runs.append((a, a + full * each, s, each, self.room - r, length))
                    self._give(rooms, r - each * length, s, s + full)
                    a, s = a + full * each, s + full
                elif a < b:
                    self.runs.append((a, b, s, b - a, self.room - r, length))
                    self._give(rooms, r - (b - a) * length, s, s + 1)
                    a, s = b, s + 1
                if s < e:
                    self.space[r].append((s, e))
                rooms[r] = bool(self.space[r])

    def _give(self, rooms: np.ndarray, room: int, s: int, e: int) -> None:
        if room:
            self.space[room].append((s, e))
            rooms[room] = True

    def place(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of numbered pieces."""
        t = self.table
        if not len(number):
            return number, number
        first, _, sequence, each, offset, step = t[np.searchsorted(t[:, 0], number, "right") - 1].T
        at = number - first
        return sequence + at // each, offset + at % each * step


def best_packing(histogram: np.ndarray, room: int, groups: tuple[int, ...] = GROUPS) -> Packing:
    """The packing of the fewest sequences over all shares and numbers of groups."""
    return min((Packing(histogram, room, g, share) for share in SHARES for g in groups), key=lambda p: p.sequences)


def pack(docs: DataFrame, room: int = ROOM, end: int = END, tokenizer: str = TOKENIZER, id_col: str = "doc_id", ids: bool = False, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Id, piece, start, length, ids_crc32, sequence_id and offset of every piece; with ``ids`` also its ids."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), "text").alias("h"), F.col("text").cast("string").alias("text"))
    fields = [("id", kind), ("h", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in fields + [("ids", T.ArrayType(T.LongType()))] * ids])
    made = slim.mapInArrow(_pieces(config, room, end, ids), schema)
    made = cut(made)  # ranges are found by a sample, which would tokenise all texts once more
    made = made.withColumns({"h": F.xxhash64("h", "piece"), "read": F.monotonically_increasing_id()})
    order = ["length", "h", "read"]
    ranked = cut(made.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "read"))
    ranked = ranked.withColumn("at", F.monotonically_increasing_id())
    counts = dict(ranked.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    offset = np.zeros(max(counts, default=0) + 1, np.int64)
    for p in sorted(counts)[:-1]:
        offset[p + 1 :] += counts[p]
    histogram = np.zeros(room + 1, np.int64)
    for length, n in ranked.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[length] = n
    packing = best_packing(histogram, room, groups)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(at: pd.Series) -> pd.DataFrame:
        at = at.to_numpy()
        sequence, offset_ = packing.place(offset[at >> 33] + (at & ((1 << 33) - 1)))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset_})

    out = ranked.withColumn("to", placed("at"))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "to.sequence_id", "to.offset", *["ids"] * ids)
