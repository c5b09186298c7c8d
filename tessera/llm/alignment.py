"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes.

A text, with a space in front, is encoded by a byte-level BPE vocabulary (A) and by a
SentencePiece model (B).  Byte offsets where tokens of both end cut the two sequences into
groups; each A and B token of a group are linked.

The sweep.  The ends of all tokens are events (document, offset, side, id).  A task that
tokenises writes those of a stretch of text as one row: the byte where the stretch's first
token starts, and the ids, from whose lengths every end follows.  The events of both sides
are repartitioned by document and sorted within partitions by document, offset and side,
and stream through a machine that keeps what has ended on one side only since the last
common end, and the running sums of the document it is in: a group is complete when both
sides end at one offset.  The machine takes some ten thousand events at a time as arrays.

Counts of id pairs over the corpus.  Documents are dealt into blocks.  A first sweep gives
each block's pairs with the number of its documents that hold them; they go, packed, to
buckets by A id, which sum them (a bucket holds distinct pairs only, a bounded number since
both vocabularies are), mark the pairs with an A id's highest count, and answer each block
for the pairs that it sent.  A second sweep, over the same exchange of events, adds the
answers up.  No table of pairs is collected or broadcast.

Defined cases: null and empty texts have no tokens, nor has a text whose joined tokens
differ from its bytes (U+2581 in a text becomes a space in B); they give zeros and empty
groups.  Strings of special tokens are plain text.  Repeated rows are aligned each and
counted each; null ids stay null; an empty table gives an empty result; columns other than
the id and the text are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: The byte-level pattern, a fixed value of the public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
#: Bytes of text of a block; tokens of a stretch, and events that the machine takes at once; entries of a bucket's slice.
BLOCK_BYTES, STRETCH, STEP, SLICE = 4 << 20, 1 << 15, 1 << 16, 1 << 23
BUCKETS = 256
#: Words that a worker remembers.
REMEMBER = 400_000
#: Links of one group that are listed; a larger group's are counted by distinct ids.
LISTED = 1 << 14


class Tokenizers:
    """Both encodings of a text, remembered by word, and the bytes of every token."""

    def __init__(self, config: str, model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(config)
        self.whole.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        said = json.loads(config)
        solid = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        byte = {(b if b in set(solid) else next(rest)): b for b in range(256)}
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        own = said["model"]["vocab"]
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[ord(c)] for c in token) if token in own and all(ord(c) in byte for c in token) else token.encode()
        pieces = range(self.model.get_piece_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i in pieces for p in [self.model.id_to_piece(i)]]
        # Merges in the order of ids make a rank encoder of the same vocabulary, which is faster.
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        made = [own[a + b] for a, b in merges]
        before = said.get("pre_tokenizer") or {}
        cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.fast = None
        if cuts and made == sorted(made) and len(set(made)) == len(made):
            added = {t["content"] for t in said.get("added_tokens", [])}
            ranks = {self.bytes_a[i]: i for t, i in own.items() if t not in added}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # Spaces between solid characters cut a text into words that are encoded alike alone, if no piece looks over one.
        keeps = not any(MARK in p.lstrip(MARK) for i in pieces if not (self.model.is_control(i) or self.model.is_unknown(i)) for p in [self.model.id_to_piece(i)])
        from .sentencepiece_codec import model_kind

        model_kind(model)
        self.apart = bool(self.fast and keeps)
        self.kinds = ["<u2" if len(b) <= 1 << 16 else "<u4" for b in (self.bytes_a, self.bytes_b)]
        self.lengths = [np.array([len(x) for x in b], np.int64) for b in (self.bytes_a, self.bytes_b)]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def _word(self, word: str) -> tuple[bytes, bytes, bool]:
        a = self.fast(" " + word) if self.fast else self.whole.encode(" " + word, add_special_tokens=False).ids
        b = self.model.encode(word)
        want = b" " + word.encode()
        fits = b"".join([self.bytes_a[i] for i in a]) == want and b"".join([self.bytes_b[i] for i in b]) == want
        found = np.array(a, self.kinds[0]).tobytes(), np.array(b, self.kinds[1]).tobytes(), fits
        if len(word) <= 64:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[word] = found
        return found

    _gap = re.compile(r"(?<=\S) (?=\S)")
    _odd = re.compile(r"\s\s|^\s|\s$")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the text, a space in front, in both vocabularies; none if either's bytes differ from the text's."""
        if not text:
            words = []
        elif not self.apart:
            words = [text]
        else:
            words = self._gap.split(text) if self._odd.search(text) else text.split(" ")
        known = self.known
        found = [known.get(w) or self._word(w) for w in words]
        if not all(f[2] for f in found):
            a, b, _ = zip(*found)
            want = b" " + text.encode()
            for ids, kind, table in zip((a, b), self.kinds, (self.bytes_a, self.bytes_b)):
                if b"".join([table[i] for i in np.frombuffer(b"".join(ids), kind).tolist()]) != want:
                    found = []
                    break
        return tuple(np.frombuffer(b"".join([f[side] for f in found]), kind) for side, kind in enumerate(self.kinds))


_loaded: dict[int, Tokenizers] = {}


def _tokenizers(shared) -> Tokenizers:
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Tokenizers(*shared.value)
    return _loaded[shared.id]


class _Shared:
    """The tokenizers' files as a broadcast."""

    def __init__(self, spark, a: str, b: str):
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            self._files = spark.sparkContext.broadcast((f.read(), g.read()))
        self.id = a, b

    @property
    def value(self):
        return self._files.value


def _events(shared, blocks: int, id_field: pa.Field):
    """Events of both sides: block, key and n (tell rows apart), offset, side, ids, n_bytes, id."""

    def run(batches):
        tok = _tokenizers(shared)
        seen: dict[int, int] = {}
        names = ["block", "key", "nth", "offset", "side", "ids", "id"]
        for batch in batches:
            rows, at = [], []
            for i, (key, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                nth = seen[key] = seen.get(key, -1) + 1
                for side, ids in enumerate(tok.encode(text or "")):
                    ends = np.cumsum(tok.lengths[side][ids])
                    for j in range(0, max(1, len(ids)), STRETCH):
                        rows.append((key % blocks, key, nth, int(ends[j - 1]) if j else 0, side, ids[j : j + STRETCH].tobytes()))
                        at.append(i)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(at)).cast(id_field.type)], names)

    return run


class _Document:
    """Running sums of the document that the machine is in."""

    def __init__(self, row_id):
        self.id, self.n, self.groups = row_id, np.zeros(4, np.int64), []


class Sweep:
    """Groups and links from sorted events, some at a time.

    ``step`` yields, for documents that are complete, their sums, and hands the links of
    each part to ``links(documents' numbers, pair codes, times)``.
    """

    def __init__(self, tok: Tokenizers, texts: bool):
        self.tok, self.texts = tok, texts
        self.width = len(tok.bytes_b)
        self.tables = [self._shown(len(b)) for b in (tok.bytes_a, tok.bytes_b)] if texts else None
        self.done: list[_Document] = []
        self.base, self.open = 0, None
        self.held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        self.size = 0
        self.number = -1
        self.bounds: list[tuple[int, _Document]] = []  # ends of documents that are complete, as positions in the stream
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _shown(n: int) -> np.ndarray:
        """Decimal ids behind nothing, ';', ',' or '|'."""
        return np.array([f"{mark}{i}" for i in range(n) for mark in ("", ";", ",", "|")], "S")

    def document(self, row_id) -> None:
        """A new document begins."""
        self._close()
        self.open = _Document(row_id)
        self.number += 1
        self.last = self.base

    def add(self, side: int, offset: int, ids: np.ndarray) -> None:
        if not len(ids):
            return
        ends = self.base + offset + np.cumsum(self.tok.lengths[side][ids])
        self.last = max(self.last, int(ends[-1]))
        self.held[side].append((ids.astype(np.int64), ends))
        self.size += len(ids)

    def _close(self) -> None:
        if self.open is not None:
            self.bounds.append((self.last, self.open))
            self.base = self.last
            self.open = None

    def flush(self, all_: bool = False) -> None:
        """Groups that are complete; the events behind the last common end wait."""
        if all_:
            self._close()
        a, a_end, b, b_end = (np.concatenate([x[k] for x in self.held[side]]) if self.held[side] else np.zeros(0, np.int64) for side in (0, 1) for k in (0, 1))
        common = np.intersect1d(a_end, b_end, assume_unique=True) if self._strict(a_end) and self._strict(b_end) else np.intersect1d(a_end, b_end)
        stop = common[-1] if len(common) else self.base - 1
        ka, kb = np.searchsorted(a_end, stop, "right"), np.searchsorted(b_end, stop, "right")
        self.held = [[(a[ka:], a_end[ka:])] if ka < len(a) else [], [(b[kb:], b_end[kb:])] if kb < len(b) else []]
        self.size = len(a) - ka + len(b) - kb
        documents = [d for _, d in self.bounds] + ([self.open] if self.open is not None else [])
        ends = np.array([e for e, _ in self.bounds], np.int64)
        first = self.number + 1 - len(documents)
        if len(common):
            self._groups(a[:ka], a_end[:ka], b[:kb], b_end[:kb], common, documents, ends, first)
        self.done += [d for _, d in self.bounds]
        self.bounds = []

    @staticmethod
    def _strict(x: np.ndarray) -> bool:
        return bool((np.diff(x) > 0).all())

    def _groups(self, a, a_end, b, b_end, common, documents, ends, first) -> None:
        ga, gb = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        n = len(common)
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
        at = np.searchsorted(ends, common)  # the document of each group
        k = len(documents)
        sums = [np.zeros(k, np.int64) for _ in range(4)]
        for total, value in zip(sums, (na, nb, np.ones(n, np.int64), na * nb)):
            np.add.at(total, at, value)
        fresh = np.array([d.n[2] == 0 for d in documents])
        if self.texts:
            self._texts(a, b, ga, gb, na, sa, sb, at, fresh, documents)
        for d, *values in zip(documents, *sums):
            d.n += values
        links = na * nb
        big = np.flatnonzero(links > LISTED)
        few = links.copy()
        few[big] = 0
        g = np.repeat(np.arange(n), few)
        turn = np.arange(len(g)) - np.repeat(np.cumsum(few) - few, few)
        codes = a[sa[g] + turn // nb[g]] * self.width + b[sb[g] + turn % nb[g]]
        self.links.append((first + at[g], codes, None))
        for i in big.tolist():
            x, xn = np.unique(a[sa[i] : sa[i] + na[i]], return_counts=True)
            y, yn = np.unique(b[sb[i] : sb[i] + nb[i]], return_counts=True)
            codes = (x[:, None] * self.width + y).ravel()
            self.links.append((np.full(len(codes), first + at[i]), codes, (xn[:, None] * yn).ravel()))

    def _texts(self, a, b, ga, gb, na, sa, sb, at, fresh, documents) -> None:
        """The groups in digits, by document."""
        shown_a, shown_b = self.tables
        width = max(shown_a.itemsize, shown_b.itemsize)
        lead = np.ones(len(na), np.int64)  # ';' before a group, nothing before a document's first
        opens = np.flatnonzero(np.diff(at, prepend=-1))
        lead[opens[fresh[at[opens]]]] = 0
        mark_a, mark_b = np.full(len(a), 2), np.full(len(b), 2)
        mark_a[sa] = lead
        mark_b[sb] = 3
        out = np.zeros(len(a) + len(b), f"S{width}")
        out[np.arange(len(a)) + sb[ga]] = shown_a[a * 4 + mark_a]
        out[np.arange(len(b)) + (sa + na)[gb]] = shown_b[b * 4 + mark_b]
        until = np.append(sa, len(a)) + np.append(sb, len(b))
        raw = out.view(np.uint8).reshape(-1, width)
        edges = np.append(opens, len(na))
        for i, j in zip(edges, edges[1:]):
            part = raw[until[i] : until[j]].ravel()
            documents[at[i]].groups.append(part[part != 0].tobytes())


def _sweep(tok: Tokenizers, batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[Sweep]:
    """The machine over a block's sorted events, yielded each time some groups are complete."""
    machine, now = Sweep(tok, texts), None
    for batch in batches:
        named = {n: batch.column(n) for n in ("key", "nth", "offset", "side", "ids")}
        places = batch.column("id")
        for i, (key, nth, offset, side, ids) in enumerate(zip(*(c.to_pylist() for c in named.values()))):
            if (key, nth) != now:
                now = key, nth
                machine.document(places[i])
            machine.add(side, offset, np.frombuffer(ids, tok.kinds[side]).astype(np.int64))
            if machine.size >= STEP:
                machine.flush()
                yield machine
    machine.flush(all_=True)
    yield machine


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, turn = np.unique(codes, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, turn, counts)
    return found, total


def _code_kind(tok: Tokenizers) -> str:
    return "<u4" if len(tok.bytes_a) * len(tok.bytes_b) <= 1 << 32 else "<u8"


def _by_bucket(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket of sorted pair codes, and where each bucket begins in it."""
    bucket = codes // width % BUCKETS
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def _send(shared, slices: int):
    """A block's pairs and the number of its documents that hold each, by bucket."""

    def send(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(shared)
        block = key[0].as_py()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size, span = 0, len(tok.bytes_a) * len(tok.bytes_b)
        tail = np.zeros(0, np.int64)  # document and pair of the last document of what was swept, which may go on
        for machine in _sweep(tok, batches, False):
            parts = [d * span + c for d, c, _ in machine.links]
            machine.links.clear()
            machine.done.clear()
            own = np.unique(np.concatenate([tail, *parts]))
            open_ = np.searchsorted(own, machine.number * span)
            tail = own[open_:]
            waiting.append(own[:open_] % span)
            size += open_
            if size > SLICE:
                codes, counts = _merge(np.concatenate([codes, *waiting]), np.concatenate([counts, np.ones(size, np.int64)]))
                waiting, size = [], 0
        waiting.append(tail % span)
        size += len(tail)
        codes, counts = _merge(np.concatenate([codes, *waiting]), np.concatenate([counts, np.ones(size, np.int64)]))
        order, cuts = _by_bucket(codes, machine.width)
        full = np.flatnonzero(np.diff(cuts))
        kind = _code_kind(tok)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(full.astype(np.int32)),
            "slice": pa.array(np.full(len(full), block % slices, np.int32)),
            "block": pa.array(np.full(len(full), block, np.int64)),
            "codes": pa.array([codes[order[cuts[b] : cuts[b + 1]]].astype(kind).tobytes() for b in full], pa.binary()),
            "counts": pa.array([_thin(counts[order[cuts[b] : cuts[b + 1]]]) for b in full], pa.binary()),
        })

    return send


def _thin(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k or k == 8)
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def _thick(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _sum(kind: str, width: int, last: bool):
    """A bucket's pairs and their counts summed; at ``last`` doubled, and 1 more where the count is the highest of its A id."""

    def sum_(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for c, n in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist()):
                waiting.append((np.frombuffer(c, kind).astype(np.int64), _thick(n)))
                size += len(waiting[-1][0])
                if size > max(SLICE, len(codes)):
                    codes, counts = _merge(*(np.concatenate([a, *(w[i] for w in waiting)]) for i, a in enumerate((codes, counts))))
                    waiting, size = [], 0
        codes, counts = _merge(*(np.concatenate([a, *(w[i] for w in waiting)]) for i, a in enumerate((codes, counts))))
        if last and len(codes):
            a = codes // width
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            best = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(a))))
            counts = counts * 2 + (counts == best)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([key[0].as_py()], pa.int32()),
            "codes": pa.array([codes.astype(kind).tobytes()], pa.binary()),
            "counts": pa.array([_thin(counts)], pa.binary()),
        })

    return sum_


def _answer(kind: str):
    """For the blocks of a slice, the totals of the pairs that they sent to a bucket."""

    def answer(key: tuple[pa.Scalar, ...], sent: pa.Table, totals: pa.Table) -> pa.Table:
        codes = np.frombuffer(totals.column("codes")[0].as_py(), kind) if len(totals) else np.zeros(0, kind)
        values = _thick(totals.column("totals")[0].as_py()) if len(totals) else np.zeros(0, np.int64)
        return pa.table({
            "block": sent.column("block"),
            "bucket": sent.column("bucket"),
            "totals": pa.array([_thin(values[np.searchsorted(codes, np.frombuffer(c, kind))]) for c in sent.column("codes").to_pylist()], pa.binary()),
        })

    return answer


def _apply(shared, id_type: pa.DataType):
    """A block's documents with the sums of the answers over their links."""

    def apply(key: tuple[pa.Scalar, ...], events: pa.Table, answers: pa.Table) -> pa.Table:
        tok = _tokenizers(shared)
        done: list[_Document] = []
        links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for machine in _sweep(tok, iter(events.to_batches()), True):
            done += machine.done
            links += [(d.astype(np.int32), c.astype(_code_kind(tok)), n) for d, c, n in machine.links]
            machine.done.clear()
            machine.links.clear()
        codes = np.unique(np.concatenate([c for _, c, _ in links])) if links else np.zeros(0, np.int64)
        order, cuts = _by_bucket(codes.astype(np.int64), machine.width)
        value = np.zeros(len(codes), np.int64)
        found = 0
        for b, packed in zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()):
            own = order[cuts[b] : cuts[b + 1]]
            told = _thick(packed)
            if len(told) != len(own):
                raise RuntimeError("a block's documents changed between its two sweeps")
            value[own] = told
            found += len(own)
        if found != len(codes):
            raise RuntimeError("a block's documents changed between its two sweeps")
        best, total = np.zeros(len(done), np.int64), np.zeros(len(done), np.int64)
        for d, c, n in links:
            v = value[np.searchsorted(codes, c)]
            times = 1 if n is None else n
            cuts_ = np.flatnonzero(np.diff(d, prepend=-1))  # a part's links are in the order of documents
            if len(cuts_):
                best[d[cuts_]] += np.add.reduceat((v & 1) * times, cuts_)
                total[d[cuts_]] += np.add.reduceat((v >> 1) * times, cuts_)
        n = np.array([d.n for d in done], np.int64).reshape(-1, 4)
        return pa.table({
            "id": pa.array([d.id.as_py() for d in done], id_type),
            **{c: pa.array(n[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "n_best": pa.array(best),
            "count_sum": pa.array(total),
            "groups": pa.array([b"".join(d.groups).decode() for d in done], pa.string()),
        })

    return apply


def _swept(docs: DataFrame, a: str, b: str, id_col: str, block_bytes: int):
    """The sorted events, what tasks need to read them, and the numbers of blocks and slices."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, total // block_bytes)
    shared = _Shared(spark, a, b)
    kind = docs.schema[id_col].dataType
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text, F.spark_partition_id()).alias("key"), text.alias("text"))
    names = [("block", "long"), ("key", "long"), ("nth", "int"), ("offset", "long"), ("side", "byte"), ("ids", "binary")]
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in names] + [T.StructField("id", kind)])
    events = slim.mapInArrow(_events(shared, blocks, pa.field("id", to_arrow_type(kind))), schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = events.repartition(parts, "block").sortWithinPartitions("block", "key", "nth", "offset", "side")
    # a slice's share of a bucket stays bounded: pairs of a block are at most half of its bytes
    return swept, shared, to_arrow_type(kind), max(1, total // 2 // BUCKETS // SLICE)


_SENT = "bucket int, slice int, block long, codes binary, counts binary"


def _totals(sent: DataFrame, shared) -> DataFrame:
    tok = _tokenizers(shared)
    sums, schema = (lambda last: _sum(_code_kind(tok), len(tok.bytes_b), last)), "bucket int, codes binary, counts binary"
    return sent.groupBy("bucket", "slice").applyInArrow(sums(False), schema).groupBy("bucket").applyInArrow(sums(True), schema).withColumnRenamed("counts", "totals")


def align(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups ('a1,a2|b1;a3|b2,b3') for every row of ``docs``.

    n_best are links whose pair has the highest count of its A id, count_sum is the sum of
    the counts of the pairs of all links.
    """
    swept, shared, kind, slices = _swept(docs, a, b, id_col, block_bytes)
    sent = swept.groupBy("block").applyInArrow(_send(shared, slices), _SENT)
    totals = _totals(sent, shared).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    answers = sent.groupBy("bucket", "slice").cogroup(totals.groupBy("bucket", "slice")).applyInArrow(_answer(_code_kind(_tokenizers(shared))), "block long, bucket int, totals binary")
    fields = [T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    out = swept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_apply(shared, kind), T.StructType([*fields, T.StructField("groups", T.StringType())]))
    return out.withColumnRenamed("id", id_col)


def pair_counts(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, documents and best: how many documents hold each pair of ids linked, and whether no pair of its A id has more."""
    swept, shared, _, _ = _swept(docs, a, b, id_col, block_bytes)
    totals = _totals(swept.groupBy("block").applyInArrow(_send(shared, 1), _SENT), shared)
    tok = _tokenizers(shared)
    kind, width = _code_kind(tok), len(tok.bytes_b)

    def listed(batches):
        for batch in batches:
            for codes, packed in zip(batch.column("codes").to_pylist(), batch.column("totals").to_pylist()):
                codes, value = np.frombuffer(codes, kind).astype(np.int64), _thick(packed)
                yield pa.RecordBatch.from_pydict({"a": codes // width, "b": codes % width, "documents": value >> 1, "best": (value & 1).astype(bool)})

    return totals.mapInArrow(listed, "a long, b long, documents long, best boolean")
