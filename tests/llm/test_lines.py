"""Line dedup, fill-in-the-middle and the divergence audit against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import divergence
from tokenledger.llm.divergence import audit_sources, shares
from tokenledger.llm.fill_middle import Chunks, check_sentinels, fill_in_middle, restored
from tokenledger.llm.line_dedup import drop_frequent_lines

GAPS = " \t\n\x0b\x0c\r"


def lower(x):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), x)


# line dedup


def brute_lines(docs, least_docs, least_chars):
    keys = [[lower(x.strip(GAPS)) for x in (t or "").split("\n")] for _, t in docs]
    count = Counter(k for ks in keys for k in set(ks))
    gone = {k for k, n in count.items() if n >= least_docs and len(k) >= least_chars}
    out = []
    for (d, t), ks in zip(docs, keys):
        kept = [x for x, k in zip((t or "").split("\n"), ks) if k not in gone]
        out.append((d, len(ks), len(ks) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(seed, n=80):
    r = random.Random(seed)
    common = ["Terms", " TERMS\t", "terms", "Ünder", "ünder", "ÜNDER", "", "  ", "x", "\x0bX\r", "rights \x85", "rights \x85 ", "İ", "a  b", "a b"]
    docs = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randint(0, 60)}" for _ in range(r.randint(0, 12)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n"), (n + 3, "\n\n"), (None, "Terms\nown"), (None, None), (3, docs[3][1]), (3, docs[3][1]), (3, "other"), (n + 4, "terms\n" * 20_000 + "end"), (n + 5, "y " * 100_000)]


@pytest.mark.parametrize("least_docs,least_chars,broadcast_keys", [(10, 1, 1 << 18), (10, 1, 3), (10, 1, 0), (3, 0, 1), (2, 3, 1 << 18), (1, 0, 2)])
def test_lines(spark, least_docs, least_chars, broadcast_keys):
    docs = lined(least_docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").select(F.lit(1).alias("k1"), "*", F.lit("x").alias("N_Lines"), F.lit("y").alias("gone"), F.lit(2).alias("key"), F.lit(3).alias("h1")).repartition(5)
    got = drop_frequent_lines(df, least_docs=least_docs, least_chars=least_chars, broadcast_keys=broadcast_keys)
    assert got.columns == ["k1", "doc_id", "text", "gone", "key", "h1", "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr) == brute_lines(docs, least_docs, least_chars)
    assert got.where("k1 = 1 and gone = 'y' and key = 2 and h1 = 3").count() == len(docs)


def test_lines_of_nothing(spark):
    assert drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = drop_frequent_lines(spark.createDataFrame([("a", None)], "doc_id string, text string")).collect()
    assert [tuple(r)[2:] for r in one] == [(1, 0, "")]


# fill in the middle

UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)", "word": r"\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|\A[\x20\x09-\x0D]+\Z|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}


def units_of(text, unit):
    if unit == "word" and re.match(r"[\x20\x09-\x0D]", text):  # what stands before the first word is a unit of its own
        gap = re.match(r"[\x20\x09-\x0D]+", text)[0]
        return [gap, *re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text[len(gap) :])]
    return re.findall(UNITS[unit], text)


def brute_middle(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    units = units_of(text, unit)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = sentinels
    spm = h4 % 100 < spm_rate
    return doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle


def texts(seed, n=120):
    r = random.Random(seed)
    docs = [(i, "".join(r.choice(["\n", "word ", "é", "𝄞", "\r\n", " ", "<", "P>", "S>", "\x85", " "]) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (None, "a\nb\nc"), (None, None), (2, docs[2][1]), (2, "other\ntext\n"), (n + 2, "has <M> in it\nand more"), (n + 3, "\n"), (n + 4, "no end"), (n + 5, "ü\n" * 50_000 + "x" * 100_000)]


@pytest.mark.parametrize("options", [{}, {"unit": "word", "rate": 60, "seed": 3}, {"unit": "char", "spm_rate": 0}, {"spm_rate": 100, "sentinels": ("[pre]", "(suf)", "{mid}$")}])
def test_middle(spark, options):
    docs = texts(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Form", F.lit(1)).withColumn("extra", F.lit("e"))
    got = fill_in_middle(df, **options)
    assert got.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, got.drop("text", "extra").collect()), key=repr) == sorted((brute_middle(*d, **options) for d in docs), key=repr)
    back = got.select(F.coalesce("text", F.lit("")).alias("was"), restored(F.col("output"), F.col("form"), options.get("sentinels", ("<P>", "<S>", "<M>"))).alias("now"))
    assert back.where("not (was <=> now)").count() == 0 and back.count() == len(docs)
    assert fill_in_middle(df, keep_text=False, **options).columns == ["doc_id", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_middle_of_nothing(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("unit", ["line", "word", "char"])
@pytest.mark.parametrize("chunk,block", [(1, 1), (3, 7), (16, 64), (1 << 14, 1 << 22)])
def test_chunks_find_every_rank(unit, chunk, block):
    held = [(t or "") for _, t in texts(9, 25)[:-1]]
    encoded = [t.encode() for t in held]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    chunks = Chunks(np.frombuffer(b"".join(encoded), np.uint8), offsets, unit, chunk, block)
    for i, t in enumerate(held):
        units = units_of(t, unit)
        assert chunks.n_units()[i] == len(units)
        for rank in range(len(units) + 1):
            before = "".join(units[:rank])
            assert chunks.place(i, rank) == (len(before.encode()), len(before))


def test_sentinels_that_run_together():
    for bad in [("<P>", "<S>", ""), ("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("<<", "<P>", "<S>"), ("ab", "bc", "d")]:
        with pytest.raises(ValueError):
            check_sentinels(bad)
    check_sentinels(("<P>", "<S>", "<M>"))


# the divergence audit


def brute_audit(docs, least_docs, most):
    df, count, lang_count, groups = defaultdict(lambda: defaultdict(int)), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in set(terms):
            df[lang][t] += 1
        count[lang, source].update(terms)
        lang_count[lang].update(terms)
    kept = {lang: sorted(t for t, n in df[lang].items() if n >= least_docs) for lang, _ in groups}
    rows = []
    for lang, source in groups:
        ts = kept[lang]

        def share(c):
            total = sum(c[t] for t in ts)
            return [1 + 10**9 * (c[t] + 1) // (total + len(ts)) for t in ts]

        p, q = share(count[lang, source]), share(lang_count[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                pairs.append((-sum((a - b) ** 2 // b for a, b in zip(p, share(count[lang, other]))), other.encode(), other))
        terms = [(-((a - b) ** 2 // b), t.encode(), t) for a, b, t in zip(p, q, ts) if count[lang, source][t] > 0 and a > b]
        for part, found, upto in (("pair", pairs, None), ("term", terms, most)):
            rows += [(lang, source, part, item, -minus, rank) for rank, (minus, _, item) in enumerate(sorted(found)[:upto], 1)]
    return sorted(rows)


def sourced(seed, sources=11):
    r = random.Random(seed)
    words = ["The", "the", "straße", "ÉTÉ", "été", "x", "don't", "a1b", "日本", "zz_top", "𝄞", "w"] + [f"t{chr(97 + i)}" for i in range(20)]
    docs = [(r.choice(["en", "de", None]), r.choice([None, *(f"s{i}" for i in range(sources))]), " ".join(r.choices(words, k=r.randint(0, 25)))) for _ in range(150)]
    docs += [("en", "empty", ""), ("en", "none", None), ("xx", "a", "1 2 3"), ("xx", "b", None), ("xx", "c", ""), ("lone", "only", "w w w")] + [("en", "s0", "the the hot")] * 60
    return docs + [("en", "long", "the " * 3000 + "日本" * 3000 + " tail" * 3000), ("yy", "p", "w v"), ("yy", "q", "w v"), ("yy", "r", "w v")]


@pytest.mark.parametrize("options", [{}, {"slots": 3, "cell": 5, "most_terms": 4}, {"slots": 1, "cell": 20, "least_docs": 1}, {"slots": 100, "cell": 40, "most_terms": 2}, {"slots": 2}])
def test_audit(spark, options):
    docs = sourced(len(options))
    df = spark.createDataFrame(docs, "lang string, source string, text string").select(F.lit(1).alias("term"), "*", F.lit("x").alias("g"), F.lit(2).alias("rank")).repartition(4)
    got = audit_sources(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, options.get("least_docs", 3), options.get("most_terms", 200))


def test_audit_of_nothing(spark):
    assert audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    assert audit_sources(spark.createDataFrame([(None, None, None)], "lang string, source string, text string")).count() == 0


def test_texts_cut_to_pieces_count_alike(spark, monkeypatch):
    docs = sourced(5)
    monkeypatch.setattr(divergence, "SLICE", 50)
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    assert sorted(map(tuple, audit_sources(df).collect())) == brute_audit(docs, 3, 200)


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(300):
        counts = [r.randint(0, 10 ** r.randint(1, 15)) for _ in range(5)]
        total, v = sum(counts), r.randint(5, 10**9)
        assert shares(np.array(counts), total, v).tolist() == [1 + 10**9 * (n + 1) // (total + v) for n in counts]
