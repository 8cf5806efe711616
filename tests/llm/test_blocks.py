"""HTML extraction, top-k and mixing against brute force; the pipeline."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenledger.llm import common, html_extract, line_dedup, mixing, quality_rules, topk
from tokenledger.llm.html_extract import OPEN, blocks, extract_main_text, main_text, repeated_in, suffix_order
from tokenledger.llm.mixing import mix_plan, mixed_documents
from tokenledger.llm.topk import exact_top_k

FOLDER = "/root/testdata/sf0.001"


def text_of(page):
    return main_text(blocks(page), np.zeros(0, np.int64))


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="ad">Buy</div><div class='cookie-notice'>Cookies</div><aside>Side</aside><form><p>Your name</p></form><article><header><h1>A &amp; B</h1></header><p>one
    <b>two</b><br>three<p>four &#233;&nbsp;x < y<!-- no --><img src="a>b">.<section id="comments"><p>Troll</p></section><article class="comment"><p>Reader</p></article><div role="alert">Notice</div><div class="adapter">kept</div></article><footer>&copy;</footer>"""
    assert text_of(page) == "A & B\none two\nthree\nfour é x < y.\nkept"
    assert blocks("") == blocks(None) == [] and blocks("<p>open <b>never closed") == [("open never closed", OPEN)]
    assert blocks("<nav>a</nav>b</p></div>c") == [("b", OPEN), ("c", OPEN)]


def test_text_that_markup_does_not_hide():
    assert text_of("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><select><option>one</option></select><svg><text>drawn</text></svg></article>") == "so x=2 holds\none\ndrawn"
    assert text_of('<article><p class="share-price">Shares rose.</p><div class="notice-period">One month.</div><div class="article-header">Title</div></article>') == "Shares rose.\nOne month.\nTitle"
    assert text_of('<article><div class="ad-unit-3">Buy</div><ul class="nav_primary_items"><li>Home</ul><div class="userComments comment-body">Troll</div><p>x</article>') == "x"
    assert text_of('<article><p class="share">Tell all</p><div class="related-posts">More</div><div id="ad_1">Buy</div><p>Text.</article>') == "Text."
    # a quote that is never closed is none; a tag that the end cuts off is no text
    assert text_of('<article><p class="x>Hello world</p><p>more</article>') == "Hello world\nmore"
    assert text_of("<article><p>a</p><p clas") == "a"
    assert text_of('<article><p title="a > b">c</article>') == "c"


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<b>" * 150_000 + "</i>" * 150_000, "<" * 1_000_000, '<p a="x>' * 125_001, "<!--" * 250_000, "<script>" * 125_000, '<a "><b" ' * 111_111, "<p>" * 333_333, "&amp" * 250_000, "</p" * 333_333, "<div><p>x" * 111_111])
def test_hostile_pages_take_one_pass(page):
    import time

    began = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - began < 2.5


def test_repeats_by_brute_force():
    r = random.Random(1)
    for _ in range(40):
        pages = [np.array([r.randint(0, 2) for _ in range(r.randint(0, 12))], np.uint64) for _ in range(r.randint(0, 6))]
        size = r.randint(2, 5)
        seen, least = defaultdict(set), {}
        for p, w in enumerate(pages):
            own = [tuple(w[i : i + size].tolist()) for i in range(len(w) - size + 1)]
            for run in own:
                seen[run].add(p)
            least[p] = html_extract._content(w)
        runs, low, high = repeated_in(pages, size)
        want = {int(html_extract._runs(np.array(run, np.uint64), size)[0]): (min(least[p] for p in ps), max(least[p] for p in ps)) for run, ps in seen.items()}
        assert dict(zip(runs.tolist(), zip(low.tolist(), high.tolist()))) == want
        words = np.concatenate([*pages, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(pages)), [len(w) for w in pages])
        order, bounds = suffix_order(words, owner, size)
        sorted_runs = [tuple(words[i : i + size].tolist()) for i in order]
        assert sorted_runs == sorted(sorted_runs) and len(bounds) - 1 == len(set(sorted_runs))


@pytest.mark.parametrize("chars", [1 << 22, 1])
def test_boilerplate_without_an_article(spark, monkeypatch, chars):
    """Texts do not depend on how pages are dealt to suffix arrays; labels in doubt are decided by repetition."""
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30))
    own = [text() for _ in range(12)]
    page = "<div>Home News Sport Weather Travel Shop Contact About</div><div>{}</div><div>All rights reserved by the owner of this very site</div>"
    rows = [(i, f"http://h{i % 2}.org/{i}", page.format(t)) for i, t in enumerate(own)] + [(50, None, None), (51, "no host", ""), (52, "http://h0.org/0", page.format(own[0])), (52, "http://h0.org/0", page.format(own[0])), (None, "x", "<p>y</p>")]
    strip = '<div class="share-strip">Tell all of your friends about this right now</div><p class="share-price">Shares of firm {} rose by five per cent today</p>'
    rows += [(60 + i, f"http://h3.org/{i}", f"<article><p>{text()}</p>{strip.format(i)}</article>") for i in range(6)]
    names = ("text", "key", "runs", "host", "_html", "_groups", "_host", "_group", "_blocks", "html_")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in names}).repartition(3)
    monkeypatch.setattr(html_extract, "STREAM_CHARS", chars)
    found = extract_main_text(df).collect()
    assert len(found) == len(rows) and all(r[c] == "clash" for r in found for c in names[1:])
    got = {r["page_id"]: r for r in found}
    assert [got[i]["text"] for i in (*range(12), 52)] == [*own, own[0]]
    assert got[50]["text"] == got[51]["text"] == "" and got[None]["text"] == "y"
    for i in range(6):
        assert got[60 + i]["text"].split("\n")[1:] == [f"Shares of firm {i} rose by five per cent today"]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("pages,shared,own", [(2, 300, 60), (2, 300, 30), (3, 40, 200), (5, 300, 60), (20, 300, 30), (20, 12, 8)])
def test_boilerplate_of_any_length_goes(pages, shared, own):
    """On hosts of a few pages, in any order and dealt to any tasks."""
    for seed in range(100):
        r = random.Random(seed)
        words = lambda n: " ".join(f"w{r.randint(0, 10**7)}" for _ in range(n))
        menu, texts = words(shared), [words(own) for _ in range(pages)]
        parsed = [blocks(f"<div>{menu}</div><div>{t}</div>") for t in texts]
        streams = [html_extract._stream(p) for p in parsed]
        r.shuffle(streams)
        near = r.randint(1, pages - 1)
        parts = [repeated_in(streams[:near], 6), repeated_in(streams[near:], 6)]  # two tasks, merged as by host and run
        merged = defaultdict(list)
        for runs, low, high in parts:
            for run, a, b in zip(runs.tolist(), low.tolist(), high.tolist()):
                merged[run] += [a, b]
        repeated = np.array([run for run, seen in merged.items() if min(seen) < max(seen)], np.int64)
        assert [main_text(p, repeated) for p in parsed] == texts


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>T</title><meta x><div>Body text</div><p>More", "Body text\nMore"),
    ("<head><link rel=x><body><article><p>One", "One"),
    ('<article><p class="advert">Buy<h2>Title here</h2><p>Text</article>', "Title here\nText"),
    ('<article><p>One <b>bold<div>Two</div><ul><li><i>a<li>b</ul>', "One bold\nTwo\na\nb"),
    ('<article><p class="ad-hoc">Plans</p><p class="comment-free">Zone</p><p class="promo-code-history">Codes</p></article>', "Plans\nZone\nCodes"),
    ('<article><p data-x="display: none">a</p><p title="is hidden here">b</p><p hidden>c</p><p style="color:red; display:none">d</p><p aria-hidden="true">e</p></article>', "a\nb"),
    ('<main><article class="post menu"><p>Soup of the day</p></article></main>', "Soup of the day"),
    ('<main><article><p>Text</p><article class="comment"><p>First!</p></article></article></main>', "Text"),
    ('<article><p>Text</p><div class="ad-slot-top">Buy</div><div id="cookie-banner">Accept</div><section class="comments-list"><p>Hi</p></section></article>', "Text"),
])
def test_markup_in_short(page, text):
    assert text_of(page) == text


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_articles_of_the_test_pages(spark):
    """Texts against the articles cut out by hand; and again from pages whose articles are plain divisions, where all that
    isn't declared boilerplate is undecided and the suffix array decides."""
    import html

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|h2|br|div|ul|li)\b[^>]*>", inside))
        want[r["page_id"]] = "\n".join(p for p in parts if p)
    assert {r["page_id"]: r["text"] for r in extract_main_text(pages).collect()} == want
    plain = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(plain).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.9 * len(want)


def brute_top(rows, k=5):
    good = {}
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, w in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)[:k]
            good[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return good


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
        monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(301)]
    rows += [(400 + i, rows[7][1]) for i in range(20)]
    rows += [(500, None), (550, [1.0, None]), (600, [float("nan")]), (650, [float("inf")]), (None, [1.0]), (700, []), (750, [0.0] * 8), (800, [2.0] * 3), (901, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in exact_top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert dict(got) == brute_top(rows)


def test_scores_beyond_64_bits_are_held(spark):
    df = spark.createDataFrame([(50, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [-1e17, 0.0]), (3, [1e-2, 1.0]), (4, [1e300, 0.0])], "vec_id long, embedding array<double>")
    most = 2**63 - 1
    assert [(r["vec_id"], r["score"]) for r in exact_top_k(df, F.col("vec_id") == 50).collect()] == [(1, most), (3, most), (4, most), (2, -most)]


def test_top_k_of_little(spark):
    df = spark.createDataFrame([(50, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 256 * 128)]
    assert exact_top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert exact_top_k(df.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        left = [s for s in names if s not in held]
        rest = total - sum(held.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]]
        if not over:
            return held | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        held |= {s: 3.0 * sizes[s] for s in over}


def mixed_rows(seed):
    r = random.Random(seed)
    big = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice("aaaab")) for i in range(200)]
    small = [(300 + i, " ".join(f"v{k}" for k in range(r.randint(1, 40))), s) for i, s in enumerate(["c", "ä", None, "Z", "dd"] * 3)]
    return big + small + [(400, None, "c"), (401, "", "empty"), (402, None, None), (None, "x y z", "c"), (None, "x y z", "c"), (5, big[5][1], big[5][2]), (403, "q " * 9000, "c")]


@pytest.mark.parametrize("bucket", [2048, 8])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "RUN_SLOTS", 7)
    rows = mixed_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    plan, slots = mix_plan(df)
    got = plan.collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = filled(size)
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in size)
    assert sum(r["words"] for r in slots.collect()) == sum(taken.values())
    assert sorted(map(repr, mix_plan(df.repartition(3))[0].collect())) == sorted(map(repr, got))
    texts = mixed_documents(spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("passes", "size", "id")}))
    assert texts.columns == ["doc_id", "text", "source", "n_chars", "passes", "size", "id"]
    words, want = Counter(), Counter()
    for r in texts.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"], r["source"]] += len(r["text"].split())
    for r in got:
        want[r["id"], r["source"]] += r["taken"]
    assert words == +want


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(df)[0].count() == 0 and mixed_documents(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix_plan(blank)[0].collect()] == [(0.0, 0)]


def spark_hash(*values):
    """xxhash64 of Spark: each value's bytes, seeded by the hash of those before."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else np.int32(v).tobytes() if isinstance(v, np.int32) else np.int64(v).tobytes()
            h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


def swapped(i, n, *key):
    """The swap-or-not shuffle in whole numbers."""
    for r in range(1, mixing.ROUNDS + 1):
        partner = (spark_hash(*key, np.int32(r)) - i) % n
        if spark_hash(*key, np.int32(r), max(i, partner)) % 2:
            i = partner
    return i


def brute_mix(rows, seed):
    """(id, source, words taken) of each row, by lists of single words."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target, out = filled(size), []
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    for no, source in enumerate(names):
        own = [(hashlib.md5("~".join([*([str(i)] if i is not None else []), str(spark_hash(t))]).encode()).hexdigest(), i is not None, i or 0, len((t or "").split())) for i, t, s in rows if s == source]
        own.sort()
        stream = [k for k, (_, _, _, n) in enumerate(own) for _ in range(n)]
        blocks = [stream[a : a + mixing.BLOCK_WORDS] for a in range(0, len(stream), mixing.BLOCK_WORDS)]
        whole = len(stream) // mixing.BLOCK_WORDS
        left, taken = min(int(target[source] + 0.5), 3 * len(stream)), Counter()
        slot = 0
        while left:
            turn, i = divmod(slot, len(blocks))
            words = blocks[swapped(i, whole, np.int32(seed), no, turn) if i < whole else i][:left]
            taken.update(words)
            left -= len(words)
            slot += 1
        out += [(i if known else None, source, taken[k]) for k, (_, known, i, _) in enumerate(own)]
    return sorted(out, key=repr)


def test_mix_by_brute_force(spark):
    rows = mixed_rows(6)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {seed: sorted(((r["id"], r["source"], r["taken"]) for r in mix_plan(df, seed=seed)[0].collect()), key=repr) for seed in (0, 99)}
    assert found[0] == brute_mix(rows, 0) and found[99] == brute_mix(rows, 99) and found[0] != found[99]


def test_shards_draw_their_sources(spark, monkeypatch):
    """Counts of sources by shard are as drawn: each slot's shard by its hash, totals held, near what chance gives."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5000)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    monkeypatch.setattr(mixing, "RUN_SLOTS", 7)
    df = spark.createDataFrame(mixed_rows(7), "doc_id long, text string, source string")
    plan, slots = mix_plan(df, seed=5)
    slots = slots.collect()
    shards = -(-sum(r["size"] for r in plan.collect()) // 5000)
    total = Counter(r["source_no"] for r in slots)
    want = Counter((no, spark_hash(np.int32(5), "shard", no, slot) % shards) for no, n in total.items() for slot in range(n))
    assert Counter((r["source_no"], r["shard"]) for r in slots) == want and len({s for _, s in want}) == shards
    for no, n in total.items():
        own = sorted((r for r in slots if r["source_no"] == no), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(n))
        assert [r["shard"] for r in own] == sorted(r["shard"] for r in own)
        assert all(abs(want[no, s] - n / shards) <= 6 * (n / shards) ** 0.5 + 1 for s in range(shards))
        by_pass = defaultdict(list)
        for r in own:
            by_pass[r["pass"]].append(r["block"])
        assert all(len(set(b)) == len(b) for b in by_pass.values())


def test_helper_columns_of_the_mix_stay(spark):
    names = ("key", "source_of", "copy", "passes", "spans", "some", "cut", "own_key", "own_copy", "_words", "_turn_of", "_cut", "words", "bucket", "place")
    df = spark.createDataFrame([(i, "a b c", "x") for i in range(9)] + [(1, "a b c", "x")], "doc_id long, text string, source string").withColumns({c: F.lit(-7) for c in names})
    got = mixed_documents(df).collect()
    assert len(got) == 10 and all(r[c] == -7 for r in got for c in names)


def test_permutation_is_one(spark):
    for n in (1, 2, 63, 1000, 99_999_989):
        seen = set()
        for source in (0, 4, 7):
            few = min(n, 1000)
            got = [r[0] for r in spark.range(few).orderBy("id").select(mixing.permutation(F.col("id"), F.lit(n).cast("long"), F.lit(source).cast("long"))).collect()]
            assert len(set(got)) == few and min(got) >= 0 and max(got) < n
            assert got[:20] == [swapped(i, n, source) for i in range(min(few, 20))]
            seen.add(tuple(got))
        assert len(seen) == 3 or n < 3


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = [n]
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns
        assert docs.where("n_chars <> char_length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes[1] < n and sizes[2] < sizes[1] and sizes[3] <= sizes[2]
    last = p.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == sizes[-1] and last.where("decoded_sha256 is null").count() == 0
    assert p.run(spark, FOLDER).count() == sizes[-1]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op5_quality_rules", "op8_exact_top_k", "op11_fill_in_middle", "op12_line_dedup", "op13_source_divergence"])
def test_queries_against_sql(spark, name):
    import duckdb

    from tokenledger.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    flat = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(flat, df.select(*columns).collect())) == sorted(map(flat, c.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_native_operators_have_no_python(spark, monkeypatch):
    from tokenledger.llm import queries

    cut, seen = common.cut, []

    def looked_at(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for module in (line_dedup, mixing, quality_rules):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", looked_at)
    for name in ("op5_quality_rules", "op10_mixing", "op12_line_dedup"):
        seen.append(queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString())
    assert len(seen) > 4 and not any("Python" in plan or "Arrow" in plan for plan in seen)
