"""Classifiers by held-out accuracy, quality rules against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from tokenledger.llm import quality_classifier, toxicity
from tokenledger.llm.common import mix, word_hashes
from tokenledger.llm.quality_classifier import SubwordClassifier, bag, drop_low_quality, score_quality, scores
from tokenledger.llm.quality_rules import js_distance, judge
from tokenledger.llm.toxicity import LEVEL, WINDOW, compressors, saved_bytes, score_toxicity, train_dictionaries, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "the of and river stone paper house walks sings green small tall under over light water north window".split()
BAD = ["###", "$$$", "%%%", "|||"]
RUDE = ["grumblefoot", "snotwit", "mudbrain"]


def corpus(seed, n=900):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(GOOD) + r.choice(["", "ly", "er", "ing"]) for _ in range(r.randint(30, 90))]
        bad, rude = r.random() < 0.25, r.random() < 0.25
        if bad:
            w = [x + r.choice(BAD) for x in w]
        if rude:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(RUDE))
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(rude)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(7)
    extra = [(5001, None), (5002, ""), (None, "the river of paper"), (5003, "w " * 40_000), (3, docs[3][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("en"))
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, threshold", [(score_quality, "quality", 0.3), (score_toxicity, "toxic", 0.5)])
def test_held_out_accuracy(spark, tables, score, label, threshold):
    docs, labels = tables
    got = score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns[:3] == ["doc_id", "text", "lang"]
    want = {r["doc_id"]: r[label] for r in labels.collect()}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 100 and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.97
    again = {(r["doc_id"], r["text"]): r["score"] for r in score(docs, labels).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["score"] for r in rows)


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_without_labels(spark, tables, score):
    docs, labels = tables
    assert score(docs, labels.limit(0)).count() == docs.count()
    assert score(docs.limit(0), labels).count() == 0


def test_rejected_documents_go(tables):
    docs, labels = tables
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_windows_are_compressed_with_both_dictionaries():
    """Saved bytes against compressors made here, of plain zstandard parameters, window by window."""
    docs, labels = corpus(8)
    parts = [list(dict.fromkeys(w for (_, t), (_, _, y) in zip(docs, labels) if y == label for w in windows(t))) for label in (0, 1)]
    dictionaries = train_dictionaries(*parts)
    assert len(dictionaries[0]) > 1000 and dictionaries[1].startswith(dictionaries[0])
    both = compressors(dictionaries)
    plain = [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_dict_id=False, write_checksum=False) for d in dictionaries]
    same = 0
    for _, text in docs[:60] + [(0, ""), (0, "The RIVER walks " * 20 + "you snotwit"), (0, "x" * 5000), (0, " \n")]:
        words = text.lower().split()
        cuts = [" " + " ".join(words[i : i + WINDOW]) + " " for i in range(0, len(words), WINDOW)]
        assert [w.encode() for w in cuts] == list(windows(text))
        gains = [len(both[0](w)) - len(both[1](w)) for w in windows(text)]
        assert saved_bytes(text, *both) == (sum(g for g in gains if g > 0), len(cuts))
        # other match lengths allowed, plain compressors rank windows alike
        same += sum((len(plain[0].compress(w.encode())) > len(plain[1].compress(w.encode()))) == (g > 0) for w, g in zip(cuts, gains)) / max(1, len(cuts))
    assert same > 50
    assert saved_bytes("the river walks " * 20 + " you snotwit ", *both)[0] > 0
    assert saved_bytes("the river walks " * 20, *both)[0] == 0
    assert saved_bytes(None, *both) == (0, 0)
    # without the passages of toxic texts there is no distance
    assert saved_bytes("you snotwit " * 9, *compressors((dictionaries[0], dictionaries[0])))[0] == 0


def test_windows_of_very_long_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 5000 + " end"
    whole = list(windows(text))
    for piece in (1, 7, 100, 4096):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert list(windows(text)) == whole


def brute_bag(text):
    """Features of a text by plain loops."""
    words, out = WORD.findall(text), Counter()

    def number(word):
        raw = word.encode()
        return int(word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])

    hashes = [number(w) for w in words]
    out.update(h >> 48 for h in hashes)
    for a, b in zip(hashes, hashes[1:]):
        out[int(mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) >> 48] += 1
        out[12_345] += a == b
    for g in (3, 4):
        for i in range(len(text) - g + 1):
            x = 0
            for c in text[i : i + g]:
                x = (x ^ ord(c)) * 2_654_435_769 % 2**32
                x ^= x >> 15
            out[x >> 16] += 1
    return +out


def test_quality_features_and_scores_by_brute_force():
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "é漢字", "river", "x" * 70, "Ω"]) for _ in range(r.randint(0, 30))) for _ in range(20)] + ["", "a", "ab", " \n "]
    model = SubwordClassifier(3)
    model.output = np.random.default_rng(1).normal(0, 1, (8, 2))
    model.bias = np.array([0.3, -0.2])
    data = [t.encode() for t in texts]
    got = scores(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]), *model.weights())
    for text, score in zip(texts, got):
        want = brute_bag(text)
        ids, share = bag(text)
        assert dict(zip(ids.tolist(), share.tolist())) == pytest.approx({k: v / sum(want.values()) for k, v in want.items()}, rel=1e-5)
        mean = sum((n * model.vectors[k] for k, n in want.items()), np.zeros(8)) / max(1, sum(want.values()))
        z = np.exp(mean @ model.output + model.bias)
        assert score == pytest.approx(z[1] / z.sum(), abs=1e-6)
        assert model.probabilities([(ids, share)])[0][1] == pytest.approx(score, abs=1e-6)


def test_gradient_step_against_differences():
    """One step changes each weight by its rate times the numerical derivative of the log loss."""
    model = SubwordClassifier(2)
    model.output = np.random.default_rng(4).normal(0, 1, (8, 2))
    bags, y = [bag("the river walks"), bag("stone paper stone"), bag("é漢 house")], np.array([1, 0, 1])
    loss = lambda: -np.mean(np.log(model.probabilities(bags)[np.arange(3), y]))

    def slope(array, at):
        kept, found = array[at], []
        for d in (1e-5, -1e-5):
            array[at] = kept + d
            found.append(loss())
        array[at] = kept
        return (found[0] - found[1]) / 2e-5

    places = [(int(bags[0][0][3]), 2), (int(bags[1][0][0]), 5), (int(bags[2][0][1]), 0)]
    want = [slope(model.vectors, p) for p in places], [slope(model.output, (k, 1)) for k in range(8)], [slope(model.bias, k) for k in (0, 1)]
    before = model.vectors.copy(), model.output.copy(), model.bias.copy()
    model.step(bags, y, 0.01)
    assert [before[0][p] - model.vectors[p] for p in places] == pytest.approx([50 * 0.01 * g for g in want[0]], rel=1e-3, abs=1e-9)
    assert (before[1] - model.output)[:, 1].tolist() == pytest.approx([0.01 * g for g in want[1]], rel=1e-3, abs=1e-9)
    assert (before[2] - model.bias).tolist() == pytest.approx([0.01 * g for g in want[2]], rel=1e-3, abs=1e-9)


def test_long_texts_are_scored_and_learnt_whole(monkeypatch):
    long = " ".join(f"{GOOD[i % len(GOOD)]}{i % 7}" for i in range(60_000))
    data = np.frombuffer(long.encode(), np.uint8)
    weights = np.random.default_rng(2).normal(0, 1, 1 << 16)
    whole = scores(data, np.array([0, len(data)]), weights, 0.1)[0]
    monkeypatch.setattr(quality_classifier, "PIECE", 1 << 24)
    assert scores(data, np.array([0, len(data)]), weights, 0.1)[0] == pytest.approx(whole, abs=1e-3)
    assert scores(np.frombuffer(b"y" * 3_000_000, np.uint8), np.array([0, 3_000_000]), weights, 0.1)[0] > 0


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered), failed


def test_quality_rules(spark):
    r = random.Random(3)
    plain = [" ".join((r.choice(["the", "of", "and", "to", "in"]) if r.random() < 0.5 else r.choice(GOOD) + r.choice(["", "s", "ed", "x" * r.randint(1, 9)])) for _ in range(120)) for _ in range(80)]
    odd = [" ".join("Q%#7" + str(r.randint(0, 10**6)) for _ in range(120)) for _ in range(4)]
    texts = plain + odd + [None, "", " \n\t", "a b c d e a b c d e f", "x\nx\n \nx y\nx y", "é漢 # * $ % & | < >", "one two three four five " * 2000, plain[0]]
    df = spark.createDataFrame([(i, t, None if i % 11 == 0 and i < 80 else "en") for i, t in enumerate(texts)] + [(None, "a", "xx")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in judge(df.withColumn("kept", F.lit("clash"))).collect()}
    assert len(rows) == df.count()
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute_counts(t), t
        assert not (x["base_failed"] and x["kept"])
    assert not any(rows[i]["kept"] for i in range(80, 84))
    assert sum(rows[i]["kept"] for i in range(80)) >= 78
    assert judge(df.limit(0)).count() == 0


def test_distance_of_histograms(spark):
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 9, 5).astype(float).tolist(), rng.integers(0, 9, 5).astype(float).tolist()) for _ in range(20)] + [([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p array<double>, q array<double>").orderBy("i").select(js_distance(F.col("p"), F.col("q"))).collect()]

    def plain(p, q):
        p, q = np.array(p), np.array(q)
        if not p.sum() or not q.sum():
            return None
        p, q = p / p.sum(), q / q.sum()
        part = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return np.sqrt((part(p, q) + part(q, p)) / 2)

    for g, (p, q) in zip(got, pairs):
        w = plain(p, q)
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-9)
