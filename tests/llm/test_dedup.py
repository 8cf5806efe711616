"""Substring dedup and SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenledger.llm import components, simhash
from tokenledger.llm.simhash import drop_near_duplicates, near_duplicate_components, star_links
from tokenledger.llm.substring_dedup import _packed, _unpacked, remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_windows(docs, size):
    first, words = {}, [WORD.findall(t or "") for _, t in docs]
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - size + 1):
            if d is not None:
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def documents(seed, n=60):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 30))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(f"w{r.randint(0, 50)}é" for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 4))]
        docs.append((i, r.choice([" ", "\n", "\t \x0b"]).join(parts)))
    docs += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, passages[0]), (3, passages[1]), (5, docs[5][1]), (5, docs[5][1]), (n + 3, "x " * 5000)]
    docs += [(n + 10 + i, passages[2]) for i in range(20)]
    return docs


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 300}, {"width": 4, "depth": 2}])
def test_windows(spark, options):
    docs = documents(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("extra", F.lit(1))
    got = remove_repeated_windows(df, size=13, **options)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "n_removed", "kept_text"]
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr) == brute_windows(docs, 13)


def test_windows_of_nothing(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = remove_repeated_windows(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in one] == [(0, 0, "")]


def test_words_that_only_a_weak_hash_confuses(spark):
    """The Thue-Morse word of 1,024 letters and its complement have one polynomial hash modulo 2 ** 64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = "".join("ba"[bin(i).count("1") % 2] for i in range(1024))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = remove_repeated_windows(spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}")], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in rows] == [0, 0]


def test_helper_names_and_long_texts(spark):
    """Columns named like helpers stay; a text of a million words is one document like any other."""
    passage = " ".join(f"p{i}" for i in range(20))
    long = " ".join(f"v{i}" for i in range(300_000)) + " " + passage
    docs = spark.createDataFrame([(1, passage, 7, 8, 9), (2, long, 10, 11, 12), (None, " a  b\n", 13, 14, 15)], "doc_id long, text string, chunk int, block int, _chunk int")
    got = {r["doc_id"]: r for r in remove_repeated_windows(docs, chunk_bytes=1 << 16).collect()}
    assert [(got[k]["n_removed"], got[k]["chunk"], got[k]["block"], got[k]["_chunk"]) for k in (1, 2)] == [(0, 7, 8, 9), (20, 10, 11, 12)]
    assert got[2]["n_words"] == 300_020 and (got[None]["kept_text"], got[None]["n_words"]) == ("a b", 2)


def test_counters_are_packed_whole():
    for places in ([], [0], [5, 6, 70_000], [0, 65_535, 131_070], [65_536], list(range(0, 10**7, 99_991))):
        a = np.array(places, np.int64)
        assert _unpacked(_packed(a), len(a)).tolist() == places


def brute_print(text, shingle=4):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed):
    r = random.Random(seed)
    base = [" ".join(f"Wörd{r.randint(0, 900)}" for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(120):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        rows.append((1000 - i, " ".join(w)))
    return rows + [(1, None), (2, ""), (3, "A b"), (4, "a\nB"), (None, base[0]), (None, "lone text of no id at all"), (5, "A b"), (5, "A b"), (6, "z" * 100_000)]


def test_components(spark):
    rows = near_copies(2)
    got = near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got.collect()), key=repr) == brute_components(rows)


def test_one_of_each_component_stays(spark):
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("simhash", "print", "keep", "rank", "_rank", "_keep", "component_id", "id")})
    kept = drop_near_duplicates(df)
    assert all(set(r[2:]) == {"clash"} for r in kept.collect())
    assert near_duplicate_components(df.limit(0)).count() == 0
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(map(str, (r[0] for r in kept.collect()))) == sorted(map(str, want))
    assert drop_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("direct", [8, 4096])
def test_links_in_a_large_bucket(monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]
    f = {b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) % 2**64 for b in base for _ in range(60)}
    f = np.array(sorted(f), np.uint64)
    parent = star_links(f, 4)

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    group = {x: i for i, x in enumerate(f.tolist())}
    changed = True
    while changed:
        changed = False
        for x in group:
            for y in group:
                if bin(x ^ y).count("1") <= 4 and group[y] < group[x]:
                    group[x], changed = group[y], True
    assert len({root(x) for x in group}) == len(set(group.values()))


def test_more_blocks_link_the_same(spark, monkeypatch):
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for blocks in (6, 7):
        monkeypatch.setattr(simhash, "_blocks_for", lambda n, bits: blocks)
        got = near_duplicate_components(df)
        assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_of_any_graph(spark, monkeypatch, most):
    """One task and rounds over all of them find the same components: chains, stars, repeats, loops, null labels."""
    monkeypatch.setattr(components, "LOCAL_EDGES", most)
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)] + [(300, 300), (301, 302), (302, 301), (301, 302)]
    edges += [(r.randint(400, 500), r.randint(400, 500)) for _ in range(60)]
    names = sorted({x for e in edges for x in e})
    label = {x: None if x in (302, 130) else 10_000 - x for x in names}
    group = {x: x for x in names}
    for _ in names:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    want = {}
    for x in names:
        if any(x in e and e[0] != e[1] for e in edges):
            want[x] = min((label[y] for y in names if group[y] == group[x] and label[y] is not None), default=None)
    got = components.smallest_reachable(spark.createDataFrame(list(label.items()), "node long, label long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["label"] for x in got.collect()} == want
    assert components.smallest_reachable(spark.createDataFrame([], "node long, label long"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chunk_takes_little_memory():
    """Arrays at their peak while a chunk's texts lose their windows, by bytes of text."""
    import tracemalloc

    import pyarrow as pa

    from tokenledger.llm import substring_dedup

    r = random.Random(3)
    texts = [" ".join(f"{r.randint(0, 99_999)}" for _ in range(500)) for _ in range(700)]
    docs = pa.table({"doc_id": pa.array(range(700), pa.int64()), "text": texts})
    none = pa.table({"chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    sketch = substring_dedup._Sketch(13, 4, 1 << 20, 2)
    parts = substring_dedup._sketches("doc_id", "text", sketch)((pa.scalar(0),), docs)
    bits = pa.array([bytes(-(-sum(n) // 8)) for n in parts["n"].to_pylist()], pa.binary())
    replies = pa.concat_tables([none, pa.table({"chunk": parts["chunk"], "kind": pa.array([0] * len(bits), pa.int32()), "block": parts["block"], "bits": bits})])
    tracemalloc.start()
    substring_dedup._remove("doc_id", "text", sketch, ["doc_id", "n_removed", "kept_text"])((pa.scalar(0),), docs, replies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * sum(map(len, texts))
