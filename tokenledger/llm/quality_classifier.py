"""Quality classifier with supervised subword embeddings.

A text is a bag of hashed features: its words, pairs of neighbouring words, whether a word repeats the one before, and
the n-grams of its characters. Each bucket has a learned vector; a document is the mean of its features' vectors; a
softmax over two classes follows. Vectors and output weights are learned by stochastic gradient descent in numpy from a
sample of a bounded number of documents, each taken whole. Only texts go to Python, and only scores come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mix, pieces, slices, unused, utf8, with_results, word_hashes, word_spans
from .sampling import held_out, labelled_sample

#: Hash buckets (a power of 2), the vectors' length, and the n-grams' lengths in characters.
BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4)
#: Rows of each label in the training sample at most.
SAMPLE = {0: 1500, 1: 2500}
EPOCHS, BATCH, RATE = 6, 32, 4.0
#: A score from which a document is predicted to be good.
THRESHOLD = 0.3
#: Bytes that are turned into features at once. A longer text is the bag of its pieces' features.
PIECE = 1 << 17

_REPEAT = 12_345


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts): the features of the texts that offsets cut data into, one kind after the other."""
    n = len(offsets) - 1
    starts, ends, before = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(before))
    yield (words >> np.uint64(48)).astype(np.int64) % BUCKETS, owner
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        pair = mix(words[:-1] * np.uint64(3) + words[1:])
        yield (pair >> np.uint64(48)).astype(np.int64)[same] % BUCKETS, owner[1:][same]
        again = same & (words[1:] == words[:-1])
        yield np.full(int(again.sum()), _REPEAT), owner[1:][again]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(data) else offsets
    owner = np.repeat(np.arange(n), np.diff(before))
    for g in GRAMS:
        if len(points) < g:
            continue
        x = np.zeros(len(points) - g + 1, np.uint32)
        for i in range(g):
            x = (x ^ points[i : len(points) - g + 1 + i]) * np.uint32(2_654_435_769)
            x ^= x >> np.uint32(15)
        whole = owner[: len(x)] == owner[g - 1 :]
        yield (x >> np.uint32(16)).astype(np.int64)[whole] % BUCKETS, owner[: len(x)][whole]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text, and the share of its features that each has."""
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.zeros(BUCKETS, np.int64)
    offsets, _ = pieces(data, np.array([0, len(data)]), PIECE)
    for a, b in zip(offsets[:-1], offsets[1:]):
        for buckets, _ in features(data[a:b], np.array([0, b - a])):
            count += np.bincount(buckets, minlength=BUCKETS)
    ids = np.flatnonzero(count)
    return ids.astype(np.uint16), (count[ids] / max(1, count.sum())).astype(np.float32)


class SubwordClassifier:
    """Vectors of the buckets and weights of the two classes."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
        self.output = np.zeros((WIDTH, 2))
        self.bias = np.zeros(2)

    def probabilities(self, bags) -> np.ndarray:
        """Softmax over the classes, a row for each bag: the mean of its vectors times the output weights."""
        mean = np.array([share @ self.vectors[ids] if len(ids) else np.zeros(WIDTH) for ids, share in bags]).reshape(-1, WIDTH)
        z = mean @ self.output + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def step(self, bags, y: np.ndarray, rate: float) -> None:
        """One step down the gradient of the mean log loss of a batch."""
        ids = np.concatenate([b[0] for b in bags]).astype(np.int64)
        share = np.concatenate([b[1] for b in bags])
        of = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        own = self.vectors[ids] * share[:, None]
        mean = np.stack([np.bincount(of, own[:, k], len(bags)) for k in range(WIDTH)], 1)
        z = mean @ self.output + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(bags)), y] -= 1
        back = p @ self.output.T
        self.output -= rate * mean.T @ p / len(bags)
        self.bias -= rate * p.mean(0)
        # shares are small, so vectors take longer steps
        for k in range(WIDTH):
            self.vectors[:, k] -= 50 * rate * np.bincount(ids, share * back[of, k], BUCKETS) / len(bags)

    def fit(self, bags, labels) -> SubwordClassifier:
        """Steps over batches in a seeded order, with a falling rate. No text, or one label only: the classifier answers
        with the labels' frequency."""
        y = np.array(labels, np.int64)
        if not len(y):
            return self
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias[:] = np.log([1 - share, share])
        if len(set(y.tolist())) < 2:
            return self
        self.output = self.rng.normal(0, 0.5, (WIDTH, 2))
        steps, done = EPOCHS * -(-len(y) // BATCH), 0
        for _ in range(EPOCHS):
            order = self.rng.permutation(len(y))
            for a in range(0, len(order), BATCH):
                rows = order[a : a + BATCH]
                self.step([bags[i] for i in rows], y[rows], RATE * (1 - done / steps))
                done += 1
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the score's log odds, and the odds of an empty text: the mean of the vectors times
        the output weights is the mean of these."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Softmax probability of label 1 for each text; needs memory for PIECE bytes at a time, however long a text."""
    total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    cuts, owner = pieces(data, offsets, PIECE)
    for first, beyond in slices(cuts, PIECE):
        of = owner[first:beyond]
        for buckets, piece in features(data[cuts[first] : cuts[beyond]], cuts[first : beyond + 1] - cuts[first]):
            np.add.at(total, of, np.bincount(piece, weights[buckets], len(of)))
            np.add.at(count, of, np.bincount(piece, minlength=len(of)))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))


def _bags(batches):
    forget()
    for batch in batches:
        ids, share = zip(*map(bag, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
        columns = [batch.column("place"), batch.column("id"), batch.column("label"), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (ids, share))]
        yield pa.RecordBatch.from_arrays(columns, ["place", "id", "label", "ids", "share"])


def _fit(batches):
    forget()
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
    rows.sort(key=lambda r: r[:2])
    bags = [(np.frombuffer(ids, np.uint16), np.frombuffer(share, np.float32)) for _, _, _, ids, share in rows]
    weights, bias = SubwordClassifier().fit(bags, [r[2] for r in rows]).weights()
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([bias])})


def trained(sample: DataFrame) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds, and those of an empty text, by a classifier fitted to labelled_sample()'s
    rows. Bags are made where the texts are; one task fits them, of BUCKETS entries of 6 bytes a row at most, for as many
    rows as the sample has. Only the weights come to the driver."""
    kind = sample.schema["id"].dataType.simpleString()
    bags = sample.select("place", "id", "label", "text").mapInArrow(_bags, f"place long, id {kind}, label int, ids binary, share binary")
    found = bags.repartition(1).mapInArrow(_fit, "weights binary, bias double").first()
    if found is None:
        weights, bias = SubwordClassifier().weights()
        return weights.astype(np.float32), bias
    return np.frombuffer(bytes(found["weights"]), "<f4"), found["bias"]


def quality_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: dict[int, int] | None = None) -> Column:
    """The score of a text column of docs, by a classifier trained on its labelled rows."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(labelled_sample(docs, labels, label_col, sample or SAMPLE, id_col, text_col)))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for batch in texts:
            yield pa.array(scores(*utf8(batch), *shared.value), pa.float64())

    return score(F.col(text_col))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: dict[int, int] | None = None) -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.3).

    Trained on at most `sample` rows of each label of the training fold; every whole text is scored, of any length.
    Null and empty texts get the score of no features at all. Equal texts score alike, repeated rows stay. A row with
    a null id is scored and not held out. Columns named like a result are replaced; others stay as they are. Without
    labels, scores are 0.5. An empty table gives an empty table.
    """
    score = quality_score(docs, labels, id_col, text_col, label_col, sample)
    out = with_results(docs, score=score, held_out=held_out(id_col))
    return with_results(out, predicted=(F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that score_quality() predicts to be good, with the columns of docs."""
    score = unused(docs, "score")
    return docs.withColumn(score, quality_score(docs, labels, **options)).where(F.col(score) >= THRESHOLD).drop(score)
