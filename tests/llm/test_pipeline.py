"""The pipeline, stage by stage, against plain loops."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tokenledger.llm import mixing
from tokenledger.llm.byte_bpe import read_ranks
from tokenledger.llm.quality_classifier import SAMPLE, THRESHOLD, bag, trained
from tokenledger.llm.sampling import labelled_sample

from .test_blocks import filled, spark_hash, swapped
from .test_dedup import WORD, brute_windows

GOOD = "the of and river stone paper house walks sings green small tall under over light water north window".split()


def corpus(n=150):
    r = random.Random(11)
    words = lambda k: " ".join(r.choice(GOOD) + str(r.randint(0, 99)) for _ in range(k))
    passages, rows, labels = [words(20) for _ in range(3)], [], []
    for i in range(n):
        text = words(r.randint(20, 80))
        if r.random() < 0.3:
            text += "\n" + r.choice(passages)
        bad = r.random() < 0.25
        if bad:
            text = " ".join(w + r.choice(["###", "%%%", "|||"]) for w in text.split())
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["web", "web", "web", "book", "news"])))
        labels.append((i, int(not bad)))
    for i in range(30):  # exact and near copies
        _, text, lang, source = rows[r.randrange(n)]
        w = text.split(" ")
        if i % 2:
            w[r.randrange(len(w))] = "changed"
        rows.append((n + i, " ".join(w), lang, source))
    rows += [(900, None, "en", "web"), (901, "", None, "web"), (902, "  \n", "en", None), (903, "ÀB c", "fr", None), (904, words(3000), "en", "book"), (None, words(30), "en", "web"), (905, words(30), None, None)]
    return rows, labels


def brute_quality(rows, weights, bias):
    def score(text):
        ids, share = bag(text or "")
        return 1 / (1 + np.exp(-(float(share.astype(float) @ weights[ids].astype(float)) + bias)))

    return [r for r in rows if score(r[1]) >= THRESHOLD]


def brute_near(rows):
    def shingles(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, label = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(row[0], least.get(root(i), row[0]))
    return [row for i, row in enumerate(rows) if (least[root(i)] == row[0] if root(i) in least else True)]


def brute_substrings(rows):
    found = {(d, text): None for d, text, *_ in rows}
    for d, n, gone, text in brute_windows([(d, t) for d, t, *_ in rows], 13):
        found[d] = (n, gone, text)
    out = []
    for d, text, lang, source in rows:
        n, gone, kept = found[d]
        if not gone:
            out.append((d, text, lang, source))
        elif gone < n:
            out.append((d, kept, lang, source))
    return out


def brute_mixed(rows, seed=0):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(WORD.findall(t or ""))
    target, out = filled(size), []
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    for no, source in enumerate(names):
        key = lambda r: hashlib.md5("~".join([*([str(r[0])] if r[0] is not None else []), str(spark_hash(r[1]))]).encode()).hexdigest()
        own = sorted((r for r in rows if r[3] == source), key=key)
        stream = [(k, i) for k, r in enumerate(own) for i in range(len(WORD.findall(r[1] or "")))]
        if not stream:
            continue
        cut = [stream[a : a + mixing.BLOCK_WORDS] for a in range(0, len(stream), mixing.BLOCK_WORDS)]
        whole = len(stream) // mixing.BLOCK_WORDS
        passes, left = divmod(min(int(target[source] + 0.5), 3 * len(stream)), len(stream))
        some, i = defaultdict(set), 0
        while left:
            block = cut[swapped(i, whole, np.int32(seed), no, passes) if i < whole else i][:left]
            for k, place in block:
                some[k].add(place)
            left -= len(block)
            i += 1
        for k, (d, text, lang, _) in enumerate(own):
            words = WORD.findall(text or "")
            out += [(d, text, lang, source)] * passes if words else []
            if some[k]:
                out.append((d, text if len(some[k]) == len(words) else " ".join(words[p] for p in sorted(some[k])), lang, source))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage_by_brute_force(spark, folder):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights, bias = trained(labelled_sample(docs, spark.read.parquet(f"{folder}/labels.parquet"), "quality", SAMPLE))
    brutes = [lambda r: brute_quality(r, weights, bias), brute_near, brute_substrings, brute_mixed]
    schema, sizes = docs.schema, [len(rows)]
    for (_, stage), brute in zip(corpus_pipeline.STAGES, brutes):
        got = stage(spark, docs, folder)
        assert got.columns == schema.names
        found = [tuple(r) for r in got.collect()]
        rows = brute(rows)
        assert Counter(r[:4] for r in found) == Counter(rows)
        assert all(r[4] == len(r[1]) for r in found if r[1] is not None)
        docs = spark.createDataFrame(found, schema)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 50
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def last(d, text, lang, source):
        ids = encoding.encode_ordinary(text or "")
        return d, lang, source, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    want = Counter(last(*r) for r in rows)
    names = ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).select(names).collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).select(names).collect()) == want


def test_stages_of_nothing(spark, folder):
    """An empty table stays empty; one of nulls loses nothing to a crash."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for table in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None)], docs.schema)):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, folder)
            assert rows.count() <= 3


def test_mixing_leaves_a_short_plan(spark, folder):
    """What it plans of texts, places and spans is cut: one plan of all takes the driver's memory."""
    plan = corpus_pipeline.mixing(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8 and plan.count("Window") <= 4
