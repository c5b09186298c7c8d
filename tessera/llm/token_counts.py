"""Token counts that follow edits: pre-token segment trees, re-encoded only around an edit.

A text is cut into pre-tokens by the tokenizer's pattern; byte-pair merges never
cross them, so a document's count is the sum over its pre-tokens.  A document keeps
a segment tree over leaves of LEAF pre-tokens each: token counts, characters and a
hash at the leaves, sums above.  An edit replaces characters [start, end) by a
text.  Cutting starts again at a leaf boundary before the edit, far enough back that
the pattern can't see past it, and goes on until a new cut falls, after the edit, on
an old leaf boundary, from where old leaves stay; only the leaves between are
encoded and the sums above them updated.

The whole tree is kept, inner sums and all, as a column next to the text; an edit
changes leaves and the paths above them.

Plan: index and edits are joined on the document.  Edits of one document are grouped,
all of them in one row, since each works on what the one before left; documents are
not.  Edits whose counted bytes stay under the session's own bound for broadcasts
(spark.sql.autoBroadcastJoinThreshold) are broadcast: then no row of the index is
shuffled, and rows without an edit go on as Arrow columns, unread.  More edits than
that are joined by a shuffle of the index.

Defined cases: null text is empty and counts 0; a null start is 0, a null end is the
start (an insertion), a null ``seq`` comes first; edits are applied in order of
``seq``, each to the text that those before it left; ties go by start, end and
text; out-of-range positions are clipped; an edit with a null replacement deletes;
a row of the index without a tree gets one when it is edited;
edits of unknown documents are ignored; repeated rows of a document are each
edited; incoming columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_bytes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
#: Pre-token counts that a worker remembers.
REMEMBER = 60_000
OUT = ("n_tokens", "tree")


class Counter:
    """Token counts of pre-tokens, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def one(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.coder.encode_ordinary(piece))
            if len(piece) <= 64:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[piece] = n
        return n

    def cut(self, text: str, start: int = 0):
        """Pre-tokens from ``start`` on, as (end, tokens)."""
        for m in self.pattern.finditer(text, start):
            yield m.end(), self.one(m.group())

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """(characters, tokens) of every LEAF pre-tokens."""
        ends = [m.end() for m in self.pattern.finditer(text)]
        counts, known = [], self.known
        for a, b in zip([0, *ends], ends):
            n = known.get(text[a:b])
            counts.append(self.one(text[a:b]) if n is None else n)
        bounds = [0, *ends[LEAF - 1 :: LEAF]]
        if ends and bounds[-1] != ends[-1]:
            bounds.append(ends[-1])
        return [(b - a, sum(counts[i * LEAF : (i + 1) * LEAF])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


class Tree:
    """A segment tree of characters and tokens over a document's leaves, as one array of rows.

    Row i is the sum of rows 2i and 2i + 1; leaves start at row ``size``, a power of
    two.  A leaf may be empty or hold more than LEAF pre-tokens, so that new cuts go
    into the slots of the old ones and only the paths above them are updated.  Where
    they need more slots than twofold leaves give, later leaves move up and the sums
    are made anew; that takes LEAF new pre-tokens at least, and no text is read for it.
    """

    def __init__(self, leaves=(), rows: np.ndarray | None = None):
        if rows is None:
            self._build(np.array(leaves, np.int64).reshape(-1, 2))
        else:
            self.rows, self.size, self.used = rows, len(rows) // 2, int(rows[0, 0])

    def _build(self, leaves: np.ndarray) -> None:
        self.used = len(leaves)
        self.size = 1 << max(self.used - 1, 0).bit_length()
        self.rows = np.zeros((2 * self.size, 2), np.int64)
        self.rows[self.size : self.size + self.used] = leaves
        half = self.size
        while half > 1:
            self.rows[half // 2 : half] = self.rows[half : 2 * half : 2] + self.rows[half + 1 : 2 * half : 2]
            half //= 2
        self.rows[0, 0] = self.used

    @property
    def leaves(self) -> list[tuple[int, int]]:
        return [tuple(x) for x in self.rows[self.size : self.size + self.used].tolist()]

    @property
    def total(self) -> int:
        return int(self.rows[1, 1])

    def chars(self, leaf: int) -> int:
        return int(self.rows[self.size + leaf, 0])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one beyond the end), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            left = int(self.rows[2 * i, 0])
            if at < start + left or not self.rows[2 * i + 1, 0]:
                i = 2 * i
            else:
                i, start = 2 * i + 1, start + left
        return min(i - self.size, max(self.used - 1, 0)), start

    def splice(self, a: int, b: int, new: list[tuple[int, int]]) -> None:
        """Leaves [a, b) become ``new``."""
        slots = b - a
        if slots and len(new) <= 2 * slots:
            twofold = max(0, len(new) - slots)
            pairs = [(w + y, x + z) for (w, x), (y, z) in zip(new[: 2 * twofold : 2], new[1 : 2 * twofold : 2])]
            new = [*pairs, *new[2 * twofold :]]
            new += [(0, 0)] * (slots - len(new))
            self.rows[self.size + a : self.size + b] = new
            low, high = self.size + a, self.size + b - 1
            while low > 1:
                low, high = low // 2, high // 2
                self.rows[low : high + 1] = self.rows[2 * low : 2 * high + 2 : 2] + self.rows[2 * low + 1 : 2 * high + 2 : 2]
            return
        old = self.rows[self.size : self.size + self.used]
        self._build(np.concatenate((old[:a], np.array(new, np.int64).reshape(-1, 2), old[b:])))


def apply_edit(counter: Counter, text: str, tree: Tree, start: int, end: int, new: str) -> tuple[str, int]:
    """The text after one edit; the tree follows.  Also how many pre-tokens were cut again."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    edited = text[:start] + new + text[end:]
    if not text:
        tree.splice(0, tree.used, counter.leaves(edited))
        return edited, tree.used * LEAF
    # A match looks one character past its end at most, or through a run of blanks.
    back = max(start - 1, 0)
    while back and text[back - 1].isspace():
        back -= 1
    first, begin = tree.find(max(back - 1, 0))
    keep = start + len(new)  # old text goes on from here, shifted
    shift = len(edited) - len(text)
    last, edge = first, begin
    while last < tree.used and edge + shift < keep:
        edge += tree.chars(last)
        last += 1
    out, size, tokens, n, at, work = [], 0, 0, 0, begin, 0
    for stop, count in counter.cut(edited, begin):
        size, tokens, n, at, work = size + stop - at, tokens + count, n + 1, stop, work + 1
        while last < tree.used and edge + shift < at:
            edge += tree.chars(last)
            last += 1
        if at == edge + shift and at > keep and not edited[at - 1].isspace():
            break
        if n == LEAF:
            out.append((size, tokens))
            size = tokens = n = 0
    if at == len(edited):
        last = tree.used
    if n:
        out.append((size, tokens))
    tree.splice(first, last, out)
    return edited, work


_counters: dict[str, Counter] = {}


def load_ranks(df: DataFrame, path: str = RANKS):
    """The vocabulary file (its path is a parameter) as a broadcast variable."""
    with open(path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), raw))


def _counter(ranks) -> Counter:
    name, raw = ranks.value
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})
    return _counters[name]


_KEY, _EDITS = "_tessera_edited", "_tessera_edits"
_TREE = T.ArrayType(T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
#: What an edit takes in memory besides its replacement, about.
EDIT_BYTES = 40


def _trees(rows: list[np.ndarray]) -> pa.Array:
    """Trees as a list column."""
    flat = np.concatenate([np.zeros((0, 2), np.int32), *rows]).astype(np.int32)
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["chars", "tokens"])
    return pa.ListArray.from_arrays(pa.array(ends), both)


def count_tokens(docs: DataFrame, path: str = RANKS, ranks=None) -> DataFrame:
    """``docs`` with n_tokens and tree, each document's segment tree (its row 0 holds the number of leaves)."""
    ranks = ranks or load_ranks(docs, path)
    docs = docs.drop(*OUT)

    def run(batches):
        c = _counter(ranks)
        for b in batches:
            for low in range(0, len(b), 128):
                part = b.slice(low, 128)
                trees = [Tree(c.leaves(t or "")) for t in part.column("text").to_pylist()]
                new = [pa.array([t.total for t in trees], pa.int64()), _trees([t.rows for t in trees])]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *OUT])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("tree", _TREE)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def leaves(tree: Column) -> Column:
    """The leaves of a tree column, as (chars, tokens)."""
    return F.slice(tree, (F.size(tree) / 2 + 1).cast("int"), tree[0]["chars"])


def edit_counts(index: DataFrame, edits: DataFrame, path: str = RANKS, ranks=None) -> DataFrame:
    """The index (doc_id, text, n_tokens, tree, ...) after edits (doc_id, seq, start, end, replacement), with ``recut``.

    recut is the number of pre-tokens that were cut and looked up again; 0 where a
    document had no edit.
    """
    ranks = ranks or load_ranks(index, path)
    index = index.drop("recut", _KEY, _EDITS)
    start = F.coalesce(F.col("start"), F.lit(0))
    one = F.struct(
        "seq",
        start.alias("start"),
        F.coalesce(F.col("end"), start).alias("end"),
        F.coalesce("replacement", F.lit("")).alias("replacement"),
    )
    known = edits.where("doc_id is not null")
    grouped = known.groupBy(F.col("doc_id").alias(_KEY)).agg(F.array_sort(F.collect_list(one)).alias(_EDITS))
    size = known.agg(F.sum(F.coalesce(F.octet_length("replacement"), F.lit(0)) + EDIT_BYTES).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes(index.sparkSession):
        grouped = F.broadcast(grouped)

    def edited(c: Counter, b: pa.RecordBatch) -> pa.RecordBatch:
        todo, texts, counts = (b.column(x).to_pylist() for x in (_EDITS, "text", "n_tokens"))
        old = b.column("tree")
        ends, flat = old.offsets.to_numpy() - old.offsets[0].as_py(), old.flatten()
        flat = np.column_stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)])
        rows, work = [flat[a:z] for a, z in zip(ends, ends[1:])], [0] * len(b)
        for i, steps in enumerate(todo):
            if not steps:
                continue
            text = texts[i] or ""
            tree = Tree(rows=rows[i].astype(np.int64)) if len(rows[i]) else Tree(c.leaves(text))
            for e in steps:
                text, n = apply_edit(c, text, tree, e["start"], e["end"], e["replacement"])
                work[i] += n
            texts[i], counts[i], rows[i] = text, tree.total, tree.rows
        new = {
            "text": pa.array(texts, b.schema.field("text").type),
            "n_tokens": pa.array(counts, pa.int64()),
            "tree": _trees(rows),
            "recut": pa.array(work, pa.int64()),
        }
        return pa.RecordBatch.from_pydict({n: new[n] if n in new else b.column(n) for n in (*names, "recut")})

    names = index.columns

    def run(batches):
        c = _counter(ranks)
        for b in batches:
            for low in range(0, len(b), 64):
                part = b.slice(low, 64)
                if part.column(_EDITS).null_count == len(part):  # nothing to do: columns go on as they are
                    columns = {n: part.column(n) for n in names}
                    yield pa.RecordBatch.from_pydict(columns | {"recut": pa.array([0] * len(part), pa.int64())})
                else:
                    yield edited(c, part)

    joined = index.join(grouped, F.col("doc_id") == F.col(_KEY), "left")
    return joined.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("recut", T.LongType())]))
