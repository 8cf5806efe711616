"""Fill-in-the-middle: a text is cut at two unit boundaries, and its three parts change places behind sentinels.

Texts are decomposed into chunks that overlap by one byte, which is all that a predicate on adjacent characters needs to
tell where units begin. Boundaries are counted chunk by chunk, prefix sums of the counts give the number of units and
route both cut ranks to the chunks that own them, and only those are scanned again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _IS_GAP, forget, slices, utf8, with_fields

#: Bytes of a chunk, of the chunks whose predicates are held at once, and of the texts that leave a task together.
CHUNK, BLOCK, SLICE = 1 << 14, 1 << 22, 1 << 22

#: The marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

#: Whether a unit begins at a byte, by it and the byte before it (the first byte of a text always begins one). A word goes
#: with the separators behind it.
BEGINS = {
    "line": lambda before, own: before == 10,
    "word": lambda before, own: _IS_GAP[before] & ~_IS_GAP[own],
    "char": lambda before, own: (own & 0xC0) != 0x80,
}


class Chunks:
    """Boundaries of the texts that offsets cut data into, counted by chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK, block: int = BLOCK):
        self.data, self.offsets, self.begins = data, offsets, BEGINS[unit]
        sizes = np.diff(offsets)
        per_text = -(-sizes // chunk)
        #: The first chunk of each text, and one beyond the last text's.
        self.first = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int64)
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.heads = np.append(np.repeat(offsets[:-1], per_text) + within * chunk, offsets[-1])
        self.opens = within == 0
        n = len(within)
        units, chars = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        step = max(1, block // chunk)
        for a in range(0, n, step):
            b = min(a + step, n)
            at = self.heads[a:b] - self.heads[a]
            starts, own = self._scan(a, b)
            units[a + 1 : b + 1] = np.add.reduceat(starts, at, dtype=np.int64)
            chars[a + 1 : b + 1] = np.add.reduceat((own & 0xC0) != 0x80, at, dtype=np.int64)
        #: Units and characters that begin before each chunk, over all texts.
        self.units, self.chars = np.cumsum(units), np.cumsum(chars)

    def _scan(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where units begin in the chunks a to b, and their bytes. Reads one byte more, before the first."""
        low, high = self.heads[a], self.heads[b]
        own = self.data[low:high]
        before = np.empty(len(own), np.uint8)
        before[1:] = own[:-1]
        before[0] = self.data[low - 1] if low else 0
        starts = self.begins(before, own)
        starts[self.heads[a:b][self.opens[a:b]] - low] = True
        return starts, own

    def n_units(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """(byte, characters before it) in a text where its unit of a rank (from 0) begins; the text's end for the rank beyond."""
        first, beyond = self.first[text], self.first[text + 1]
        wanted = self.units[first] + rank
        if wanted >= self.units[beyond]:
            return int(self.offsets[text + 1] - self.offsets[text]), int(self.chars[beyond] - self.chars[first])
        # the owner is the last chunk before which no more units begin
        owner = int(np.searchsorted(self.units[first : beyond + 1], wanted, "right")) - 1 + int(first)
        starts, own = self._scan(owner, owner + 1)
        at = int(np.flatnonzero(starts)[wanted - self.units[owner]])
        chars = int(np.count_nonzero((own[:at] & 0xC0) != 0x80))
        return int(self.heads[owner] - self.offsets[text]) + at, int(self.chars[owner] - self.chars[first]) + chars


def _draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must be told apart wherever they stand: none may be empty, hold another, or begin as one ends."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: int = 7,
    sentinels: tuple[str, str, str] = SENTINELS, keep_text: bool = True,
) -> DataFrame:
    """docs with n (units of the text), form, prefix_chars, middle_chars and output.

    unit is "line" (each with its \\n), "word" (with what separates it from the next) or "char". Of the texts, rate in 100 are
    cut, spm_rate in 100 of these in the form spm (suffix, prefix, middle), the rest in psm (prefix, suffix, middle); each part
    stands behind its sentinel. All draws come from a hash of seed and id, so reruns agree; rows that share an id draw the
    same numbers, each over its own text, and a null id draws as an empty one. Texts that hold a sentinel, empty and null
    ones stay as they are (form plain, lengths null; a null text counts as empty). Prefix, middle or suffix may be empty.

    An empty table gives an empty table. Columns of the new names, in any case, are replaced; without keep_text the text itself
    doesn't come back. restored() undoes it. Texts stay in their tasks: nothing is shuffled.
    """
    check_sentinels(sentinels)
    fields = ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())
    schema = with_fields(docs, *fields)
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])
    names, kinds = schema.names, {n for n, _ in fields}
    marks = [s.encode() for s in sentinels]

    def part(ids: list, data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        chunks = Chunks(data, offsets, unit)
        counts = chunks.n_units().tolist()
        forms, prefixes, middles, sizes, out = [], [], [], [], []
        for i, n in enumerate(counts):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            h1, h2, h3, h4 = _draws(seed, ids[i])
            if not text or h3 % 100 >= rate or any(m in text for m in marks):
                row, pieces = ("plain", None, None), [text]
            else:
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (a, before), (b, upto) = chunks.place(i, low), chunks.place(i, high)
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                spm = h4 % 100 < spm_rate
                pieces = [marks[1], suffix, marks[0], prefix, marks[2], middle] if spm else [marks[0], prefix, marks[1], suffix, marks[2], middle]
                row = ("spm" if spm else "psm", before, upto - before)
            for held, value in zip((forms, prefixes, middles), row):
                held.append(value)
            sizes.append(sum(map(len, pieces)))
            out += pieces
        where = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        output = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(where), pa.py_buffer(b"".join(out))]).cast(pa.string())
        return {"n": pa.array(counts, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(prefixes, pa.int64()),
                "middle_chars": pa.array(middles, pa.int64()), "output": output}

    def run(batches):
        forget()
        for batch in batches:
            where = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            ids = batch.column(where[id_col]).to_pylist()
            data, offsets = utf8(batch.column(where[text_col]))
            for first, beyond in slices(offsets, SLICE):
                new = part(ids[first:beyond], data[offsets[first] : offsets[beyond]], offsets[first : beyond + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays([new[n] if n in kinds else batch.column(where[n]).slice(first, beyond - first) for n in names], names)

    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text before fill_in_middle(), from its output and form alone."""
    check_sentinels(sentinels)
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    joined = F.transform(F.array(parts), lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    return F.when(form == "plain", output).otherwise(joined[0])
