"""LM scoring by prediction by partial matching over a byte-context trie.

A text is lower-cased (A-Z) and read as words, each closed by a space, and one end
mark.  Every byte is predicted from the ORDER bytes before it, whatever they are:
contexts run across spaces (six NUL bytes stand in front of a text).  A byte that
the longest context was never followed by in training escapes to the next shorter
one.  Escapes are estimated by absolute discounting (ESCAPE of a count from each
distinct successor), with symbol exclusion: what a longer context offered is taken
out of the shorter ones.  The trie is pretrained on the training documents and
keeps every node; a document's score is the sum of log10 probabilities.

The trie is never in one place.  A node is a context, newest byte first, and its
successor; nodes are dealt to buckets by the newest SPLIT bytes of their context, so
that a context and all its longer ones share a bucket.  Contexts below SPLIT bytes
are counted in a pass of their own and broadcast: 256 ** SPLIT nodes at most (2**24),
however large the corpus.

Plan: (1) next to the scan, training rows count their short nodes; (2) rows are
dealt into blocks of text; a block sends the distinct longest nodes and words it
holds, with training counts, to their buckets, delta-coded; (3) a bucket sums them,
derives the shorter nodes down to SPLIT, and answers each block with the log10
probability of its nodes and the training count of its words; (4) the block adds
them up for each document.  A frequent context costs one entry a block, so hot
sources, copies and lines don't make a bucket hot.  All three steps work through
texts in pieces of bounded size, however long one text is.

Words are told apart by 64-bit hashes: of v words, v² / 2**65 pairs are expected to
be taken for one (0.03 at 10**9 words), which touches n_known and base_score alone;
trie nodes are their bytes.

Defined cases: null text counts as empty, whose only token is the end; null ids are
never held out; repeated rows count each time; without training documents bytes are
uniform; incoming columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, crc_mod, cut, mix, row_slices, text_bytes, word_bounds, word_hashes

ORDER = 6
#: Newest context bytes that name a node's bucket; shorter contexts are broadcast.
SPLIT = 3
#: What each distinct successor of a context gives up to the escape.
ESCAPE = 0.3
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES, BUCKET_BYTES = 1 << 24, 1 << 24
#: Positions, and documents, that are coded at once.
PIECE, PIECE_ROWS = 1 << 20, 256
OUT = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
_BLOCK, _BUCKET, _TRAIN = "_tessera_block", "_tessera_bucket", "_tessera_train"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_U = np.uint64
_END = 10


# ── from texts to nodes ──────────────────────────────────────────────────────


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts as they are coded, each behind ORDER NULs; where coding starts and ends in each."""
    raw = column.cast(pa.large_binary()).fill_null(b"")
    front, back = pa.scalar(bytes(ORDER), pa.large_binary()), pa.scalar(b" \n", pa.large_binary())
    joined = pc.binary_join_element_wise(front, raw, back, pa.scalar(b"", pa.large_binary()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    n = len(joined)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    data = _LOWER[np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    pads = (offsets[:-1, None] + np.arange(ORDER)).ravel()
    space[pads] = True
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of blanks the first stays, and none in front of a text
    keep[pads] = True
    keep[offsets[1:] - 1] = True
    data[space] = 32
    data[pads] = 0
    data[offsets[1:] - 1] = _END
    place = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], place[offsets[:-1]] + ORDER, place[offsets[1:]]


def keys_at(data: np.ndarray, low: int, high: int, order: int) -> np.ndarray:
    """The node of each position in [low, high): ``order`` context bytes, newest first, then the byte itself."""
    key = np.zeros(high - low, _U)
    for k in range(1, order + 1):
        key <<= _U(8)
        key |= data[low - k : high - k]
    key <<= _U(8)
    key |= data[low:high]
    return key


def pieces(start: np.ndarray, end: np.ndarray):
    """Cuts of texts into work of bounded size: lists of (row, low, high), PIECE positions and PIECE_ROWS rows at most."""
    out, size = [], 0
    for row, (a, z) in enumerate(zip(start.tolist(), end.tolist())):
        while a < z:
            b = min(z, a + PIECE - size)
            out.append((row, a, b))
            size += b - a
            a = b
            if size >= PIECE or len(out) >= PIECE_ROWS:
                yield out
                out, size = [], 0
    if out:
        yield out


def reduced(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and what their counts (one each if none are given) add up to."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


class Tally:
    """Distinct keys with counts, gathered piece by piece; held as few sorted runs."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((keys, counts))
        while len(self.runs) > 1 and len(self.runs[-1][0]) * 2 > len(self.runs[-2][0]):
            (a, m), (b, n) = self.runs.pop(), self.runs.pop()
            self.runs.append(reduced(np.concatenate((a, b)), np.concatenate((m, n))))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return reduced(*(np.concatenate(x) for x in zip(*self.runs)))


def block_nodes(t: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some texts with their training counts (0 for those of held-out texts alone)."""
    train = t.column(_TRAIN).to_numpy(zero_copy_only=False).astype(bool)
    tally = Tally()
    for i, j in row_slices(t.column("text")):
        data, start, end = coded(t.column("text").slice(i, j - i))
        for piece in pieces(start, end):
            parts = [(keys_at(data, a, z, order) << _U(1)) | _U(train[i + r]) for r, a, z in piece]
            keys, n = reduced(np.concatenate(parts))
            n *= (keys & _U(1)).astype(np.int64)
            keys >>= _U(1)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            tally.add(keys[first], np.add.reduceat(n, first))
    return tally.total()


def block_words(t: pa.Table):
    """Distinct word hashes of some texts, their training counts, and (row, word number) of every word."""
    train = t.column(_TRAIN).to_numpy(zero_copy_only=False).astype(bool)
    found, rows = [], []
    for i, j in row_slices(t.column("text")):
        data, offsets = text_bytes(t.column("text").slice(i, j - i))
        data = _LOWER[data]
        start, end, first = word_bounds(data, offsets)
        found.append(word_hashes(data, start, end))
        rows.append(i + np.repeat(np.arange(j - i), np.diff(first)))
    rows.append(np.arange(len(t)))  # the end of each text is a token
    found.append(np.full(len(t), mix(np.full(1, _END, _U))[0]))
    row, (words, turn) = np.concatenate(rows), np.unique(np.concatenate(found), return_inverse=True)
    return words, np.bincount(turn, train[row], minlength=len(words)).astype(np.int64), row, turn


# ── packing ──────────────────────────────────────────────────────────────────


def pack(keys: np.ndarray) -> bytes:
    """Rising integers as compressed planes of the bytes of their differences."""
    gaps = np.diff(keys.astype(_U), prepend=_U(0))
    return pa.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


def pack_counts(n: np.ndarray) -> bytes:
    return pa.compress(n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts buckets one after another and keeps what is inside; where each starts."""
    small = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _node_bucket(nodes: np.ndarray, buckets: int, order: int) -> np.ndarray:
    return (mix(nodes >> _U(8 * (order + 1 - SPLIT))) % _U(buckets)).astype(np.int64)


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> _U(32)) % _U(buckets)).astype(np.int64)


_ENTRIES = f"{_BUCKET} int, {_BLOCK} long, n_nodes int, nodes binary, node_counts binary, n_words int, words binary, word_counts binary"


def _send(buckets: int, order: int):
    """A block's entry for every bucket (an empty one too: the answer brings the bucket's share of the totals)."""

    def send(key, t):
        nodes, counts = block_nodes(t, order)
        words, word_counts, _, _ = block_words(t)
        by_node, node_cut = _by_bucket(_node_bucket(nodes, buckets, order), buckets)
        by_word, word_cut = _by_bucket(_word_bucket(words, buckets), buckets)
        out = {k: [] for k in ("nodes", "node_counts", "words", "word_counts")}
        for b in range(buckets):
            own = by_node[node_cut[b] : node_cut[b + 1]]
            out["nodes"].append(pack(nodes[own]))
            out["node_counts"].append(pack_counts(counts[own]))
            own = by_word[word_cut[b] : word_cut[b + 1]]
            out["words"].append(pack(words[own]))
            out["word_counts"].append(pack_counts(word_counts[own]))
        lengths = {"n_nodes": np.diff(node_cut).astype(np.int32), "n_words": np.diff(word_cut).astype(np.int32)}
        heads = {_BUCKET: np.arange(buckets, dtype=np.int32), _BLOCK: np.full(buckets, key[0].as_py())}
        columns = heads | lengths | {k: pa.array(v, pa.binary()) for k, v in out.items()}
        return pa.table(
            {n: columns[n] for n in ("_tessera_bucket", "_tessera_block", "n_nodes", "nodes", "node_counts", "n_words", "words", "word_counts")}
        )

    return send


def _short_nodes(batches):
    """Counts of the nodes whose contexts are one byte shorter than SPLIT, a row each."""
    tally = Tally()
    for b in batches:
        for i, j in row_slices(b.column("text")):
            data, start, end = coded(b.column("text").slice(i, j - i))
            for piece in pieces(start, end):
                tally.add(*reduced(np.concatenate([keys_at(data, a, z, SPLIT - 1) for _, a, z in piece])))
    nodes, n = tally.total()
    for low in range(0, len(nodes), 1 << 16):
        part = slice(low, low + (1 << 16))
        yield pa.RecordBatch.from_pydict({"node": nodes[part].astype(np.int64), "n": n[part].astype(np.int64)})


# ── the model ────────────────────────────────────────────────────────────────


def log_probabilities(nodes: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each node's byte in its context.

    ``nodes`` are distinct and rising, ``n`` their training counts; 0 marks a node that
    is only asked for.  They hold every trained node of their own newest SPLIT context
    bytes; ``short`` has every trained node of a context one byte shorter than SPLIT.
    """
    levels = [(nodes, n.astype(np.float64), None)]
    for k in range(order - 1, -1, -1):
        above, counts, _ = levels[-1]
        below, parent = np.unique(((above >> _U(16)) << _U(8)) | (above & _U(255)), return_inverse=True)
        if k == SPLIT - 1:  # from here on counts are those of the whole corpus
            own, below = below, np.union1d(below, short)
            parent = np.searchsorted(below, own)[parent]
            total = np.zeros(len(below))
            total[np.searchsorted(below, short)] = short_n
        else:
            total = np.bincount(parent, counts, minlength=len(below))
        levels[-1] = (above, counts, parent)
        levels.append((below, total, None))
    before = None
    for k, (keys, count, parent) in enumerate(reversed(levels)):
        head = keys >> _U(8)
        context = np.cumsum(np.concatenate(([0], head[1:] != head[:-1]))) if len(keys) else np.zeros(0, np.int64)
        size = int(context[-1]) + 1 if len(keys) else 0
        met = np.bincount(context, count, minlength=size)
        kinds = np.bincount(context, count > 0, minlength=size)
        if k == 0:
            # Bytes never met share what all the met ones leave.
            lower = np.full(len(keys), -np.log10(max(256 - (kinds[0] if size else 0), 1)))
        else:
            p_count, p_context, p_met, p_kinds, p_lower = before
            up = p_context[parent]
            hidden = np.bincount(context, np.where(count > 0, p_count[parent], 0), minlength=size)
            left, new = p_met[up] - hidden[context], p_kinds[up] - kinds[context]
            found = p_count[parent]
            with np.errstate(divide="ignore", invalid="ignore"):
                escaped = np.where(left > 0, np.log10(new * ESCAPE / left), 0.0) + p_lower[parent]
                lower = np.where(found > 0, np.log10((found - ESCAPE) / left), escaped)
            # (nodes that the context itself has are never asked for below it)
            lower = np.where(count > 0, 0.0, lower)
        before = (count, context, met, kinds, lower)
    count, context, met, kinds, lower = before
    with np.errstate(divide="ignore", invalid="ignore"):
        escaped = np.where(met[context] > 0, np.log10(kinds[context] * ESCAPE / met[context]), 0.0) + lower
        return np.where(count > 0, np.log10((count - ESCAPE) / met[context]), escaped)


_ANSWERS = f"{_BLOCK} long, {_BUCKET} int, n_nodes int, scores binary, n_words int, counts binary, tokens long, words long"


def _answer(shared, order: int):
    def answer(key, t):
        short, short_n = shared.value
        n_nodes, n_words = t.column("n_nodes").to_pylist(), t.column("n_words").to_pylist()

        def gathered(name: str, sizes: list[int]):
            keys = [unpack(x, n) for x, n in zip(t.column(name + "s").to_pylist(), sizes)]
            counts = [unpack_counts(x, n) for x, n in zip(t.column(name + "_counts").to_pylist(), sizes)]
            distinct, turn = np.unique(np.concatenate(keys), return_inverse=True)
            return distinct, np.bincount(turn, np.concatenate(counts), minlength=len(distinct)), turn

        nodes, n, turn = gathered("node", n_nodes)
        scores = log_probabilities(nodes, n, short, short_n, order).astype("<f4")[turn]
        words, n, turn = gathered("word", n_words)
        counts = n.astype(np.int64)[turn]
        cuts, word_cuts = np.cumsum(n_nodes)[:-1], np.cumsum(n_words)[:-1]
        rows = len(t)
        return pa.table({
            _BLOCK: t.column(_BLOCK),
            _BUCKET: pa.array([key[0].as_py()] * rows, pa.int32()),
            "n_nodes": t.column("n_nodes"),
            "scores": pa.array([x.tobytes() for x in np.split(scores, cuts)], pa.binary()),
            "n_words": t.column("n_words"),
            "counts": pa.array([pack_counts(x) for x in np.split(counts, word_cuts)], pa.binary()),
            "tokens": np.full(rows, int(n.sum())),
            "words": np.full(rows, int((n > 0).sum())),
        })

    return answer


def _sums(t: pa.Table, nodes: np.ndarray, scores: np.ndarray, order: int) -> np.ndarray:
    """The sum of each text's log10 probabilities."""
    out = np.zeros(len(t))
    for i, j in row_slices(t.column("text")):
        data, start, end = coded(t.column("text").slice(i, j - i))
        for piece in pieces(start, end):
            base = piece[0][0]
            # Sorted together with the row, equal nodes are looked up once.
            keys = np.concatenate([(keys_at(data, a, z, order) << _U(8)) | _U(r - base) for r, a, z in piece])
            keys, n = reduced(keys)
            at = np.searchsorted(nodes, keys >> _U(8))
            sums = np.bincount((keys & _U(255)).astype(np.int64), n * scores[at])
            out[i + base : i + base + len(sums)] += sums
    return out


def _apply(buckets: int, names: list[str], order: int):
    def apply(key, docs, answers):
        nodes, _ = block_nodes(docs, order)
        words, _, row, turn = block_words(docs)
        by_node, node_cut = _by_bucket(_node_bucket(nodes, buckets, order), buckets)
        by_word, word_cut = _by_bucket(_word_bucket(words, buckets), buckets)
        scores, counts = np.zeros(len(nodes), np.float64), np.zeros(len(words), np.int64)
        for b, s, n, c in zip(*(answers.column(x).to_pylist() for x in (_BUCKET, "scores", "n_words", "counts"))):
            if len(s) != 4 * (node_cut[b + 1] - node_cut[b]) or n != word_cut[b + 1] - word_cut[b]:
                raise RuntimeError("a block's rows changed between its two readings")
            scores[by_node[node_cut[b] : node_cut[b + 1]]] = np.frombuffer(s, "<f4")
            counts[by_word[word_cut[b] : word_cut[b + 1]]] = unpack_counts(c, n)
        tokens = int(np.sum(answers.column("tokens").to_numpy()))
        kinds = int(np.sum(answers.column("words").to_numpy()))
        base = np.log10(counts + 1.0) - np.log10(tokens + kinds + 1.0)
        sums = lambda x: np.bincount(row, x[turn], minlength=len(docs))
        out = {c: docs.column(c) for c in names} | {
            "n_tokens": np.bincount(row, minlength=len(docs)).astype(np.int64),
            "n_known": sums((counts > 0).astype(float)).astype(np.int64),
            "train_tokens": np.full(len(docs), tokens, np.int64),
            "base_score": sums(base),
            "score": _sums(docs, nodes, scores, order),
        }
        return pa.table(out)

    return apply


def score_texts(
    docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the trie's).

    ``order`` lies between SPLIT and ORDER.  Blocks and buckets set the grain of the
    work, never the result; an input of many TB takes larger ones (each block sends
    each bucket one entry).
    """
    if not SPLIT <= order <= ORDER:
        raise ValueError(f"order must lie between {SPLIT} and {ORDER}")
    docs = docs.drop(*OUT, _BLOCK, _BUCKET, _TRAIN)
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks, buckets = max(1, whole // block_bytes), max(1, whole // bucket_bytes)
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)))
    names = docs.columns
    training = docs.where("not held_out").select("text").mapInArrow(_short_nodes, "node long, n long")
    # At most 256 ** SPLIT rows.
    short = training.groupBy("node").agg(F.sum("n").alias("n")).toArrow().sort_by("node")
    shared = docs.sparkSession.sparkContext.broadcast(
        (short.column("node").to_numpy().astype(_U), short.column("n").to_numpy().astype(np.float64))
    )
    # Equal rows of different partitions part, too: a block is dealt by text and partition.
    place = F.xxhash64(F.col("doc_id").cast("string"), text, F.spark_partition_id())
    dealt = docs.withColumns({_TRAIN: ~F.col("held_out"), _BLOCK: F.pmod(place, F.lit(blocks))})
    sent = dealt.groupBy(_BLOCK).applyInArrow(_send(buckets, order), _ENTRIES)
    answers = sent.groupBy(_BUCKET).applyInArrow(_answer(shared, order), _ANSWERS)
    new = [(n, T.LongType()) for n in OUT[1:4]] + [(n, T.DoubleType()) for n in OUT[4:]]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in new)])
    return dealt.groupBy(_BLOCK).cogroup(answers.groupBy(_BLOCK)).applyInArrow(_apply(buckets, names, order), schema)
