"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of labelled texts. The ordinary one is trained by zstandard itself on
windows of ordinary texts. The toxic one has the same content, so that ordinary passages compress alike with both, and
after it passages of toxic texts: runs of short substrings, as a dictionary trainer would choose them for being in many
windows, but only those that are several times as frequent in toxic windows as in ordinary ones. Every window of a
document is compressed with both dictionaries; the bytes that the toxic one saves, against the windows the document has,
are calibrated to a score on rows that the dictionaries have not seen, part by part of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, with_results
from .sampling import held_out, labelled_sample

#: Words in a window; bytes of a match at least; zstandard's level.
WINDOW = 8
LEAST_MATCH = 5
LEVEL = 3
#: Bytes of ordinary content, of toxic passages at most, of one passage at most, and of a weighed substring.
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 8_192
PASSAGE = 32
SUBSTRING = 5
#: A substring is weighed if it is in so many times as many toxic windows as ordinary ones would make expect, and in so
#: many standard deviations more.
LEAST_RATIO = 3.0
DEVIATIONS = 6.0
#: A passage is taken if at least one in so many of its substrings is in no passage taken before.
FRESH = 2
#: Rows of each label in the training sample at most, and windows of each that dictionaries are trained on at most. Longer
#: windows are no training samples (they are scored like any other).
SAMPLE = {0: 2500, 1: 1200}
MOST_WINDOWS = 30_000
MOST_WINDOW_BYTES = 512
#: Parts of the sample: each is calibrated by dictionaries trained on the others.
FOLDS = 3
#: A score from which a document is predicted to be toxic.
THRESHOLD = 0.5
#: Characters of a text that are cut to windows at once.
PIECE = 1 << 18

_SPACE = re.compile(r"[ \t-\r]")


def windows(text: str) -> Iterator[bytes]:
    """Runs of WINDOW words of a whole text in lower case, a blank before, between and after them."""
    rest: list[bytes] = []
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        words = rest + text[at:end].lower().encode().split()
        at = end
        whole = len(words) if at >= len(text) else len(words) // WINDOW * WINDOW
        for i in range(0, whole, WINDOW):
            yield b" %b " % b" ".join(words[i : i + WINDOW])
        rest = words[whole:]


def _substrings(parts: list[bytes]):
    """Each substring of SUBSTRING bytes as a number, its window, and whether it lies in one window; and all bytes."""
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    n = max(0, len(data) - SUBSTRING + 1)
    code, inside, gap = np.zeros(n, np.uint64), np.ones(n, bool), data == 10
    for i in range(SUBSTRING):
        code = (code << np.uint64(8)) | data[i : n + i]
        inside &= ~gap[i : n + i]
    return code, np.cumsum(gap)[:n], inside, data


def _frequencies(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct substrings of windows, and in how many windows each is."""
    code, of, inside, _ = _substrings(parts)
    code, of = code[inside], of[inside]
    order = np.lexsort((of, code))
    code, of = code[order], of[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    return np.unique(code[new], return_counts=True)


def toxic_passages(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Passages of toxic windows, the commonest last, where a dictionary's matches are cheapest; and the ordinary windows
    without any of the substrings they are made of."""
    if not toxic or not ordinary:
        return b"", ordinary
    own, n = _frequencies(toxic)
    other, m = _frequencies(ordinary)
    at = np.minimum(np.searchsorted(other, own), max(0, len(other) - 1))
    expected = (np.where(other[at] == own, m[at], 0) + 1) * len(toxic) / len(ordinary) if len(other) else np.ones(len(own))
    weighed = own[(n >= LEAST_RATIO * expected) & (n >= expected + DEVIATIONS * np.sqrt(expected) + 4)]
    # passages are the longest runs of such substrings; the commonest comes first, then what covers others
    code, _, inside, data = _substrings(toxic)
    edge = np.diff(np.concatenate([[False], inside & np.isin(code, weighed), [False]]).astype(np.int8))
    raw = data.tobytes()
    seen = Counter(raw[a : min(b + SUBSTRING - 1, a + PASSAGE)] for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
    out, covered, size = [], set(), 0
    for passage, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        own_parts = {passage[i : i + SUBSTRING] for i in range(len(passage) - SUBSTRING + 1)}
        if FRESH * len(own_parts - covered) >= len(own_parts) and size < TOXIC_BYTES:
            covered |= own_parts
            out.append(passage)
            size += len(passage) + 1
    code, of, inside, _ = _substrings(ordinary)
    with_some = set(of[inside & np.isin(code, weighed)].tolist())
    return b"".join(b"\n" + passage for passage in reversed(out)), [w for i, w in enumerate(ordinary) if i not in with_some]


def train_dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, trained on windows."""
    import zstandard as zstd

    passages, plain = toxic_passages(ordinary, toxic)
    try:
        base = zstd.train_dictionary(ORDINARY_BYTES, plain, k=32, d=6).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few windows to train on: the windows themselves
        base = b"".join(plain)[-ORDINARY_BYTES:].rjust(8)
    return base, base + passages


def compressors(dictionaries: tuple[bytes, bytes]):
    """Functions that compress a window with the ordinary and with the toxic dictionary."""
    import zstandard as zstd

    p = zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    out = []
    for content in dictionaries:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstd.ZstdCompressor(dict_data=d, compression_params=p).compress)
    return out


def saved_bytes(text: str | None, ordinary, toxic) -> tuple[int, int]:
    """Bytes that the toxic dictionary saves over the windows of a text, and how many windows there are."""
    saved = n = 0
    for window in windows(text or ""):
        gain = len(ordinary(window)) - len(toxic(window))
        if gain > 0:
            saved += gain
        n += 1
    return saved, n


def _evidence(saved, n):
    return np.log((np.asarray(saved, float) + 0.5) / (np.asarray(n, float) + 3))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a small ridge, by Newton's method. With one class only, those by
    which no text that saves nothing is toxic."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    a = np.stack([x - x.mean(), np.ones(len(x))], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (p - y) / len(y) + 1e-3 * beta
        curve = (a * (p * (1 - p))[:, None]).T @ a / len(y) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(beta[1] - beta[0] * x.mean())


def _training_windows(batches):
    forget()
    for batch in batches:
        for fold, label, text in zip(*(batch.column(n).to_pylist() for n in ("fold", "label", "text"))):
            some = list(dict.fromkeys(w for w in windows(text) if len(w) <= MOST_WINDOW_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(some), pa.int32()), pa.array([label] * len(some), pa.int32()), pa.array(some, pa.binary())], ["fold", "label", "window"])


def _training_evidence(shared):
    def run(batches):
        by_fold = [compressors(d) for d in shared.value]
        for batch in batches:
            found = [saved_bytes(t, *by_fold[f]) for f, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist())]
            found = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(found[:, 0]), pa.array(found[:, 1])], ["place", "label", "saved", "n"])

    return run


def trained(sample: DataFrame) -> tuple[tuple[bytes, bytes], float, float]:
    """The two dictionaries, and the slope and intercept of the score, from labelled_sample()'s rows. At most MOST_WINDOWS
    windows of each label, each with its part of the sample, come to the driver, and two numbers for each row."""
    rows = sample.select("place", F.pmod("place", F.lit(FOLDS)).cast("int").alias("fold"), "label", "text")
    found = rows.select("fold", "label", "text").mapInArrow(_training_windows, "fold int, label int, window binary")
    found = cut(found.groupBy("label", "window").agg(F.collect_set("fold").alias("folds")))
    parts = [[(bytes(r["window"]), r["folds"]) for r in found.where(F.col("label") == label).orderBy(F.xxhash64("window"), "window").limit(MOST_WINDOWS).collect()] for label in (0, 1)]
    # without a part: without all windows that it has
    without = [train_dictionaries(*([w for w, folds in part if fold not in folds] for part in parts)) for fold in range(FOLDS)]
    shared = sample.sparkSession.sparkContext.broadcast(without)
    seen = rows.mapInArrow(_training_evidence(shared), "place long, label int, saved long, n long").collect()
    seen.sort(key=lambda r: tuple(r))
    slope, intercept = calibrate(_evidence([r["saved"] for r in seen], [r["n"] for r in seen]), np.array([r["label"] for r in seen], float))
    return train_dictionaries(*([w for w, _ in part] for part in parts)), slope, intercept


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5) and saved_bytes.

    Trained on at most `sample` rows of each label of the training fold; every window of every text is scored, of any
    length. Null and empty texts have no windows and the score of a text without evidence. Equal texts score alike,
    repeated rows stay. A row with a null id is scored and not held out. Columns named like a result are replaced;
    others stay as they are. Without toxic labels no text saves anything and none is predicted. An empty table gives an
    empty table.
    """
    dictionaries, slope, intercept = trained(labelled_sample(docs, labels, label_col, sample or SAMPLE, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf("struct<score:double,saved:long>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        both = compressors(shared.value)
        for batch in texts:
            found = np.array([saved_bytes(t.as_py(), *both) for t in batch], np.int64).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(slope * _evidence(found[:, 0], found[:, 1]) + intercept, -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(found[:, 0])], names=["score", "saved"])

    out = with_results(docs, score=judged(F.col(text_col)), held_out=held_out(id_col))
    return with_results(out, score=F.col("score.score"), held_out=F.col("held_out"), predicted=(F.col("score.score") >= THRESHOLD).cast("int"), saved_bytes=F.col("score.saved"))
