"""A persisted inverted index of trigrams for keyword search (RK2).

Layout, below one folder that driver and executors share::

    postings/segment=N/bucket=B   gram, row_id, place, length, positions; sorted by gram
    rows/segment=N                row_id, length
    gone/segment=N                row_id: rows deleted as of this segment
    manifest/version=V            one row a live segment: kind, rows, length

A row's posting of a trigram has its positions in one text column (``place``) and the length
of the row, in trigrams over all columns.  Postings are dealt into buckets by the trigram's
checksum, so a query reads only the buckets of its own trigrams, and of these the row groups
that hold them; the texts are never read.  A phrase's occurrences are the starts at which
every trigram of it stands at its offset: overlapping ones count, as in a scan.

Appends write a segment; deletes write tombstones that hide rows of earlier segments; an
upsert is both in one version.  ``merge`` writes what is live as one segment.  A version of the
manifest is written last and whole, so readers see a change completely or not at all, and
of two writers of one version the second fails.  Count and summed length of the live rows are
in the manifest, so BM25 needs no pass over the table.  Hot trigrams: a bucket is written by
as many tasks as its bytes need (``SPREAD``), since rows spread over them too.

Defined cases: null texts are empty; rows under three characters count as rows and have no
postings; a row id that is appended twice is two rows of one id, upsert replaces; phrases under
three characters have no trigram and are refused.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .search import B, K1, LEAST_IDF

BUCKETS = 64
#: Bytes of text whose postings of a bucket one task writes.
SPREAD = 1 << 30
_MANIFEST = "version long, segment long, kind string, rows long, length long, buckets int, columns array<string>"


def _postings(batches):
    """Trigrams of each text with their positions: row, place, length, gram, positions."""
    for batch in batches:
        rows, places, lengths = (batch.column(i) for i in range(3))
        at, grams, found, sizes = [], [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            if len(text) < 3:
                continue
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            code = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=np.uint64(1 << 63)) != 0)
            at += [i] * len(starts)
            grams += [text[k : k + 3] for k in order[starts].tolist()]
            sizes.append(np.diff(np.append(starts, len(order))))
            found.append(order.astype(np.int32))
        if at:
            take = pa.array(at)
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            columns = [rows.take(take), places.take(take), lengths.take(take), pa.array(grams, pa.string()), positions]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "place", "length", "gram", "positions"])


class TextIndex:
    """The index at ``path``; ``create`` starts one, the constructor opens what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        live = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        last = live.agg(F.max("version")).first()[0]
        self.version: int = last
        self.live = [r.asDict() for r in live.where(F.col("version") == last).collect()]
        self.buckets, self.columns = self.live[0]["buckets"], self.live[0]["columns"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: list[str], buckets: int = BUCKETS) -> TextIndex:
        """An empty index of some text columns."""
        path = path.rstrip("/")
        cls._note(spark, path, 0, [{"segment": 0, "kind": "empty", "rows": 0, "length": 0}], buckets, columns)
        return cls(spark, path)

    @staticmethod
    def _note(spark, path: str, version: int, segments: list[dict], buckets: int, columns: list[str]) -> None:
        rows = [(s["segment"], s["kind"], s["rows"], s["length"], buckets, columns) for s in segments]
        schema = T.StructType([f for f in T._parse_datatype_string(_MANIFEST).fields if f.name != "version"])
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/manifest/version={version}")

    def _next(self, segments: list[dict]) -> TextIndex:
        self._note(self.spark, self.path, self.version + 1, segments, self.buckets, self.columns)
        return TextIndex(self.spark, self.path)

    def _of(self, *kinds: str) -> list[int]:
        return [s["segment"] for s in self.live if s["kind"] in kinds]

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(segments))

    def _living(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row_id, segment, more) that no later tombstone hides."""
        gone = self._of("gone", "both")
        if not gone:
            return rows
        last = self._read("gone", gone).groupBy("row_id").agg(F.max("segment").alias("until"))
        return rows.join(last, "row_id", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def _write(self, rows: DataFrame, id_col: str, segment: int) -> tuple[int, int]:
        texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in self.columns]
        length = sum((F.greatest(F.lit(0), F.length(t) - 2) for t in texts[1:]), F.greatest(F.lit(0), F.length(texts[0]) - 2)).cast("long")
        slim = rows.select(F.col(id_col).alias("row_id"), length.alias("length"), F.array(*texts).alias("texts"))
        size = F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
        stat = slim.agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
        one = slim.select("row_id", "length", F.posexplode("texts").alias("place", "text")).select("row_id", F.col("place").cast("byte").alias("place"), "length", "text")
        kind = rows.schema[id_col].dataType.simpleString()
        made = one.mapInArrow(_postings, f"row_id {kind}, place byte, length long, gram string, positions array<int>")
        made = made.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % self.buckets).cast("int"))
        self._deal(made, stat["bytes"]).write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        slim.select("row_id", "length").write.parquet(f"{self.path}/rows/segment={segment}")
        return stat["rows"], stat["length"]

    def _deal(self, postings: DataFrame, size: int) -> DataFrame:
        spread = F.pmod(F.xxhash64("row_id"), F.lit(max(1, size // SPREAD // self.buckets)))
        return postings.repartition("bucket", spread).sortWithinPartitions("bucket", "gram")

    def append(self, rows: DataFrame, id_col: str = "id") -> TextIndex:
        """The index with more rows."""
        segment = self.version + 1
        n, length = self._write(rows, id_col, segment)
        return self._next([*self.live, {"segment": segment, "kind": "rows", "rows": n, "length": length}])

    def _bury(self, ids: DataFrame, id_col: str, segment: int) -> tuple[int, int]:
        wanted = ids.select(F.col(id_col).alias("row_id")).distinct()
        held = self._of("rows", "both")
        gone = self._living(self._read("rows", held)).join(wanted, "row_id", "left_semi") if held else None
        stat = gone.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first() if held else (0, 0)
        wanted.write.parquet(f"{self.path}/gone/segment={segment}")
        return -stat[0], -stat[1]

    def delete(self, ids: DataFrame, id_col: str = "id") -> TextIndex:
        """The index without the rows of these ids."""
        segment = self.version + 1
        n, length = self._bury(ids, id_col, segment)
        return self._next([*self.live, {"segment": segment, "kind": "gone", "rows": n, "length": length}])

    def upsert(self, rows: DataFrame, id_col: str = "id") -> TextIndex:
        """The index with ``rows`` in place of earlier rows of their ids."""
        segment = self.version + 1
        gone_n, gone_length = self._bury(rows, id_col, segment)
        n, length = self._write(rows, id_col, segment)
        return self._next([*self.live, {"segment": segment, "kind": "both", "rows": n + gone_n, "length": length + gone_length}])

    def merge(self) -> TextIndex:
        """The index with all that is live in one segment; earlier files stay for readers of earlier versions."""
        held, segment = self._of("rows", "both"), self.version + 1
        if not held:
            return self
        size = 4 * sum(s["length"] for s in self.live)
        self._deal(self._living(self._read("postings", held)).drop("segment"), size).write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        self._living(self._read("rows", held)).drop("segment").write.parquet(f"{self.path}/rows/segment={segment}")
        total = {k: sum(s[k] for s in self.live) for k in ("rows", "length")}
        return self._next([{"segment": segment, "kind": "rows", **total}])

    def vacuum(self) -> None:
        """Deletes the files of segments and versions that this version doesn't name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        live = {"postings": self._of("rows", "both"), "rows": self._of("rows", "both"), "gone": self._of("gone", "both"), "manifest": [self.version]}
        for name, keep in live.items():
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            for entry in fs.listStatus(folder) if fs.exists(folder) else []:
                key = entry.getPath().getName().rpartition("=")[2]
                if key.isdigit() and int(key) not in keep:
                    fs.delete(entry.getPath(), True)

    def search(self, phrase: str) -> DataFrame:
        """(row_id, frequency, length) of rows that hold the phrase, ignoring case; overlapping occurrences count."""
        low = phrase.lower()
        if len(low) < 3:
            raise ValueError("a phrase has three characters at least")
        held = self._of("rows", "both")
        if not held:
            return self.spark.createDataFrame([], "row_id long, frequency long, length long")
        offsets = defaultdict(list)
        for i in range(len(low) - 2):
            offsets[low[i : i + 3]].append(i)
        buckets = sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % self.buckets for g in offsets})
        own = self._read("postings", held).where(F.col("bucket").isin(buckets) & F.col("gram").isin(list(offsets)))
        own = self._living(own.select("row_id", "segment", "place", "length", "gram", "positions"))
        steps = F.lit(None).cast("array<int>")
        for gram, own_steps in offsets.items():
            steps = F.when(F.col("gram") == gram, F.array(*map(F.lit, own_steps))).otherwise(steps)
        each = own.select("row_id", "segment", "place", "length", "positions", F.explode(steps).alias("step"))
        starts = each.select("row_id", "segment", "place", "length", "step", F.explode("positions").alias("p")).withColumn("start", F.col("p") - F.col("step"))
        whole = starts.groupBy("row_id", "segment", "place", "length", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(low) - 2)
        return whole.groupBy("row_id", "segment").agg(F.count("*").alias("frequency"), F.min("length").alias("length")).select("row_id", "frequency", "length")

    def bm25(self, phrase: str) -> DataFrame:
        """(row_id, score) of rows that hold the phrase, lower is better: as ``search.bm25`` of the table."""
        n, length = (sum(s[k] for s in self.live) for k in ("rows", "length"))
        found = self.search(phrase)
        matched = found.agg(F.count("*").alias("_m"))
        idf = F.greatest(F.log((n - F.col("_m") + 0.5) / (F.col("_m") + 0.5)), F.lit(LEAST_IDF))
        f, share = F.col("frequency"), F.col("length") / F.lit(length / n if n else 1.0)
        score = -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * share))
        return found.crossJoin(F.broadcast(matched)).select("row_id", score.alias("score"))
