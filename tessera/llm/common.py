"""Shared helpers: checkpoints, table access, Arrow text batches and rolling hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

__all__ = ["cut"]

#: Bytes that separate words: space and \x09-\x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text bytes that one pass of the byte hash covers; bounds its scratch memory.
SEGMENT = 1 << 19

# Freed Arrow memory goes back to the system, so that idle Python workers stay small.
pa.set_memory_pool(pa.system_memory_pool())

_NONSPACE = np.ones(256, dtype=bool)
_NONSPACE[list(SPACES)] = False
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's bound for broadcast sides, spark.sql.autoBroadcastJoinThreshold, in bytes; below 0 for none."""
    number, unit = (
        re.fullmatch(
            r"(-?\d+)\s*([kmgt]?)b?",
            spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").lower().strip(),
        )
        .groups()
    )
    return int(number) << 10 * " kmgt".index(unit or " ")


def crc_mod(col: str, n: int):
    """crc32 of the column's text form, modulo ``n`` (a null column gives null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; ``base`` is odd."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, dtype=_U), np.full(n, inverse, dtype=_U)
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_tables: dict[str, tuple] = {}


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "bytes" not in _tables:
        letters = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
        _tables["bytes"] = (letters, *_powers(_BYTE_BASE, SEGMENT + 1))
    return _tables["bytes"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n + 1 long)."""
    n = len(data)
    solid = _NONSPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial over the bytes, then mixed.

    Worked through in segments of at most SEGMENT bytes, so that scratch memory
    doesn't follow the length of a text; a longer word is hashed in one piece.
    """
    letters, up, down = _byte_tables()
    out = np.empty(len(start), dtype=_U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        low, high = int(start[i]), int(end[j - 1])
        if high - low > SEGMENT:
            u, d = _powers(_BYTE_BASE, high - low + 1)
        else:
            u, d = up, down
        sums = np.zeros(high - low + 1, dtype=_U)
        np.cumsum(letters[data[low:high]] * u[: high - low], out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * d[s] + (e - s).astype(_U) * _U(0x2545F4914F6CDD1D)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` words: the run's polynomial over the word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    key = f"words{1 << (len(words)).bit_length()}"
    if key not in _tables:
        for old in [k for k in _tables if k.startswith("words")]:
            del _tables[old]
        _tables[key] = _powers(_WORD_BASE, 1 << (len(words)).bit_length())
    up, down = _tables[key]
    sums = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def row_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most`` bytes of text each; a longer row comes alone."""
    _, offsets = text_bytes(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
