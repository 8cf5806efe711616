"""Shared pieces of the text operators: word spans, rolling hashes, checkpoints, output schemas."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as the contracts define it, and its complement.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: The six separators of words.
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

_IS_GAP = np.zeros(256, bool)
_IS_GAP[list(SEPARATORS)] = True

#: Odd multipliers of the rolling hashes.
_BYTE_STEP = 0x9E3779B97F4A7C15 | 1
_WORD_STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take the shared folder from spark.checkpoint.dir. Where that is unset, a local run (as in tests) makes one of its
    own; a cluster must set it, since a machine's own folder goes with the machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """df's schema with fields added; a field of the same name (in any case) is replaced."""
    names = {n.lower() for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """Names for helper columns that df doesn't have (in any case): those given, with underscores as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


def with_results(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns added at its end; columns of df named like them (in any case) go."""
    names = {n.lower() for n in columns}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in names), *(v.alias(n) for n, v in columns.items()))


def kept(name: str, make):
    """make() once for each worker process: functions come anew with every task, the process stays. One thing at a
    time is kept."""
    home = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    if getattr(home, "name", None) != name:
        home.value = None
        home.value, home.name = make(), name
    return home.value


def forget() -> None:
    """Frees what another operator's tasks have kept in this worker process."""
    sys.modules.pop("_kept_by_worker", None)


def n_words(text):
    """Words of a text column (0 for null or none), by JVM code."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column as one array, and the n + 1 offsets into it. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    _, where, data = a.buffers()
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Runs of rows (first, beyond) of at most so many bytes together, or of one longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        beyond = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(beyond, n)
        first = beyond


def pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, text of each): the texts that offsets cut data into, those of more than `most` bytes cut further. A piece
    ends after the last separator that leaves it short enough, or, without one, after its last whole character. Where a
    text is cut depends on that text alone."""
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    more, of = [], []
    for i in long.tolist():
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > most:
            gaps = np.flatnonzero(_IS_GAP[data[at : at + most]])
            step = int(gaps[-1]) + 1 if len(gaps) else most
            while not len(gaps) and step > most - 4 and (data[at + step] & 0xC0) == 0x80:
                step -= 1
            at += step
            more.append(at)
            of.append(i)
    cuts = np.sort(np.concatenate([offsets, np.array(more, offsets.dtype)]), kind="stable")
    return cuts, np.repeat(np.arange(len(offsets) - 1), 1 + np.bincount(np.array(of), minlength=len(offsets) - 1))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the texts that offsets cut data into; words of each text before it (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1), modulo 2 ** 64; kept from call to call."""
    have = _powers.get(step)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, step, np.uint64)
        have[0] = 1
        _powers[step] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_sums(values: np.ndarray, step: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, the same wherever the span stands."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(step, len(values)), dtype=np.uint64, out=total[1:])
    back = powers(pow(step, -1, 1 << 64), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its length and its 8-byte lanes are mixed in one after the other, each by a
    bijection that isn't linear, so that no two words collide but by chance. Words over 64 bytes are hashed by XXH3.
    Another seed gives another, independent hash. Works in blocks of so many words, to need little memory at once."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    for i in range(0, len(starts), block):
        at, left = starts[i : i + block], (ends - starts)[i : i + block]
        h = mix((left.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(_BYTE_STEP))
        where = np.flatnonzero(left <= 64)
        at, left = at[where], left[where]
        while len(where):
            n = np.minimum(left, 8).astype(np.uint64)
            own = lanes[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * n))
            h[where] = mix((h[where] ^ own) + np.uint64(_BYTE_STEP))
            more = left > 8
            where, at, left = where[more], at[more] + 8, left[more] - 8
        out[i : i + block] = h
    for i in np.flatnonzero(ends - starts > 64).tolist():
        from xxhash import xxh3_64_intdigest

        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]], seed)
    return out


def window_hashes(words: np.ndarray, step: int, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the window of size word hashes that starts at each of at."""
    return mix(span_sums(words, step, at, at + size))
