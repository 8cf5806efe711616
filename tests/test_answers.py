"""Golden cases of extraction, normalization and equivalence."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenledger.functions import answers as A
from tokenledger.functions import text as X
from tokenledger.functions.symbolic import symbolic_equal, symbolically_equal


def over(spark, make, *rows):
    """make(columns) over rows of texts."""
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(make(*(F.col(f"c{k}") for k in range(n)))).collect()]


EXTRACTION = [
    (r"\boxed{5}", "5", "5", "5"),
    (r"\boxed{1} then \boxed{2}", "1", "2", "2"),
    (r"\boxed{\frac{1}{2}}", r"\frac{1", r"\frac{1}{2}", r"\frac{1}{2}"),
    (r"\boxed{\text{Evelyn}}", r"\text{Evelyn", "Evelyn", "Evelyn"),
    (r"\boxed{3} and \boxed{\frac{1}{2", "3", "3", "3"),
    (r"\boxed{\frac{1}{2", r"\frac{1", r"\frac{1", r"\frac{1"),
    (r"\boxed{12", None, r"\boxed{12", r"\boxed{12"),
    ("a\n#### 72", None, "a\n#### 72", "72"),
    ("a\n #### 72", None, "72", "72"),
    ("so $x+1$ and $7$", None, "7", "7"),
    ("a\n42", None, "a\n42", "42"),
    ("a\n 42 ", None, "42", "42"),
    ("", None, None, None),
    (None, None, None, None),
]


def test_extraction(spark):
    texts = [(t[0],) for t in EXTRACTION]
    assert over(spark, X.boxed_first, *texts) == [t[1] for t in EXTRACTION]
    for native in (False, True):
        assert over(spark, lambda s: X.extract_answer(s, "pipeline", native), *texts) == [t[2] for t in EXTRACTION]
        assert over(spark, lambda s: X.extract_answer(s, "analysis", native), *texts) == [t[3] for t in EXTRACTION]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\boxed{", "\\\\boxed{", "{", "}", "}", "$", "####", "# ", " ", "\n", "\n", "\t", "7", "-2.5", "x", "é", "\r", "\\text{", "٣"]), max_size=25).map("".join), min_size=1, max_size=80))
def test_one_scan_and_built_in_functions_agree(spark, texts):
    for profile in X.PROFILES:
        want = over(spark, lambda s: X.extract_answer(s, profile, True), *((t,) for t in texts))  # noqa: B023
        assert [X.scan_answer(t, profile) for t in texts] == want
    assert over(spark, X.extract_answer, *((t,) for t in texts)) == want


def brute_box(text):
    """The last box whose braces balance, found character by character from each box on."""
    for m in reversed(list(re.finditer(r"\\{1,2}boxed\{", text or ""))):
        depth = 1
        for i in range(m.end(), len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                inner = text[m.end() : i].strip()
                wrapped = re.match(r"\\text(?:bf|it|rm|sf)?\{(.+)\}$", inner)
                return wrapped[1].strip() if wrapped else inner
    return None


def brute_fraction(line):
    """A line's first \\frac written out, argument by argument."""
    before, found, rest = line.partition("\\frac")
    args, i = [], 0
    for _ in range(2):
        i += len(rest[i:]) - len(rest[i:].lstrip(" "))
        if i < len(rest) and rest[i] == "{":
            j, depth = i, 0
            while j < len(rest):
                depth += {"{": 1, "}": -1}.get(rest[j], 0)
                j += 1
                if not depth:
                    break
            args.append(rest[i:j])
            i = j
        elif i < len(rest):
            args.append("{" + rest[i] + "}")
            i += 1
    return before + found + "".join(args) if found and len(args) == 2 else line


LONG = [
    "\\boxed{" + "x" * 200_000 + "}",
    "\\boxed{" + "x" * 200_000,
    "\\boxed{" * 4000 + "1",
    "\\boxed{" * 4000 + "1}",
    "\\boxed{" + "{" * 50 + "x" + "}" * 50 + "}",
    "\\boxed{" + "{" * 3000 + "x" + "}" * 3000 + "} tail",
    "\\boxed{" + "{a}" * 30_000 + "}",
    "\\boxed{1}" * 3000 + "\\boxed{2",
    "}" * 50_000 + "\\boxed{7}",
    r"\boxed{\boxed{3}} \\boxed{4",
    r"\\\boxed{5} boxed{6}",
    "\\boxed{{{{{{{x}}}}}}}",
    "",
    None,
]


def test_boxes_of_any_length_and_depth(spark):
    want = [brute_box(t) if len(t or "") < 50_000 or "x" * 9 in t or "a" in t else X.balanced_box(t) for t in LONG]
    assert [X.balanced_box(t) for t in LONG] == want
    for native in (X.boxed_balanced, X.boxed_balanced_native):
        assert over(spark, native, *((t,) for t in LONG)) == want


def test_many_unclosed_boxes_take_one_pass():
    began = time.perf_counter()
    assert X.balanced_box("\\boxed{" * 100_000) is None
    assert time.perf_counter() - began < 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="\\{}ab \n", max_size=16), st.lists(st.sampled_from(["\\boxed{", "\\\\boxed{", "{", "}", "}", "a", "\\text{", " ", "\n", "é"]), max_size=24).map("".join)), min_size=1, max_size=60))
def test_both_forms_of_the_box_agree(spark, texts):
    want = [brute_box(t) for t in texts]
    assert [X.balanced_box(t) for t in texts] == want
    assert over(spark, X.boxed_balanced_native, *((t,) for t in texts)) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\frac", "{", "}", "{", "}", "1", "x", " ", "\n", "é"]), max_size=20).map("".join), min_size=1, max_size=60))
def test_fractions_by_brute_force(spark, texts):
    want = ["\n".join(map(brute_fraction, t.split("\n"))) for t in texts]
    assert over(spark, lambda s: A._full_forms(s, False), *((t,) for t in texts)) == want


def test_fractions_of_any_length_and_depth(spark):
    deep = "{" * 50 + "x" + "}" * 50
    long = "y" * 200_000
    texts = [f"\\frac{{{long}}}{{2}}", f"\\frac{deep}{deep}", f"\\frac{deep}3 tail", f"\\frac{{{long}", f"\\frac1{{{long}", "\\frac{" * 3000 + "1", "9" * 20_000]
    assert over(spark, lambda s: A._full_forms(s, False), *((t,) for t in texts)) == [brute_fraction(t) for t in texts]
    strict = over(spark, lambda s: A._full_forms(s, True), (f"\\frac{deep}3 tail",), ("\\frac12 tail",))
    assert strict == [f"\\frac{deep}{{3}} tail", "\\frac{1}{2} tail"]
    rows = [("\\boxed{\\frac{" + "z" * 4000 + "}{2}}", "\\boxed{\\frac{" + "z" * 4000 + "}{2}}"), ("\\boxed{" + "9" * 20_000 + "}", "\\boxed{1}")]
    for native in (False, True):
        assert [r["is_correct"] for r in over(spark, lambda a, b: A.evaluate(a, b, native=native), *rows)] == [True, False]


SYMBOLIC = [
    (r"\frac{11+9a}{20}", r"\frac{9a+11}{20}", True), ("(x+1)^2", "x^2+2x+1", True), (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt{2}}{2}", True),
    (r"\frac{x^2-1}{x-1}", "x+1", True), (r"3\pi", r"\pi\cdot 3", True), ("2^{-1}", r"\frac12", True), ("x", "y", False), ("1/0", "2", False), (r"\sin x", "x", False), ("((((", ")", False), ("", "", False), ("x^{100}", "x", False),
]


#: What takes more than multiplying out: powers and lengths without a bound, functions, roots of any order.
IDENTITIES = [
    ("(x+1)^40", "(1+x)^40", True), ("(x+1)^{10000}", "(1+x)^{9999}(x+1)", True), ("(x+1)^{40}", "x^{40}+1", False), (r"\sin(x)", r"\sin x", True), (r"\sin^2 x", r"(\sin x)^2", True),
    (r"\sin 2x", r"2\sin x", False), (r"\sin x\cos x", r"\cos x\sin x", True), (r"\log_2 8", r"\log_{2}(8)", True), (r"\log_2 8", r"\log 8", False), (r"\sqrt2\sqrt3", r"\sqrt6", True),
    (r"\sqrt{x}^2", "x", True), (r"\sqrt{x^2}", "x", False), (r"\sqrt{4x}", r"2\sqrt{x}", True), (r"\sqrt[3]{8}", "2", True), ("x^{1/2}", r"\sqrt{x}", True), (r"\sqrt{\frac12}", r"\frac1{\sqrt2}", True),
    (r"\sqrt{12}+\sqrt{3}", r"3\sqrt{3}", True), ("a_1+b", "b+a_{1}", True), ("a_1", "a_2", False), (r"\frac{1}{x-x}", "1", False), ("2^x", "x^2", False), (r"e^{x}\pi", r"\pi e^x", True),
    ("9^{9^{9^9}}", "9^{9^{9^9}}", True), ("x-y", "-(y-x)", True), (r"\sqrt{x+1}\sqrt{x+1}", "x+1", True), (r"\frac{x+1}{x+1}", "1", True), ("2+3i", "3i+2", True), (r"x\text{ cm}", "x", False),
    ("+".join(f"x^{{{i}}}" for i in range(500)), "+".join(f"x^{{{i}}}" for i in reversed(range(500))), True), ("+".join("xy" for _ in range(3000)), "3000xy", True), ("+".join("xy" for _ in range(3000)), "3001xy", False),
    (r"\sqrt{11}+\sqrt{13}+\sqrt{17}+\sqrt{19}", r"\sqrt{19}+\sqrt{17}+\sqrt{13}+\sqrt{11}", True), ("(" * 3000, ")", False), ("--x", "x", True), ("x+", "x", False),
]


def test_symbolic_identities():
    assert [(a[:40], b[:40], symbolically_equal(a, b)) for a, b, _ in IDENTITIES] == [(a[:40], b[:40], w) for a, b, w in IDENTITIES]
    assert all(symbolically_equal(b, a) == w for a, b, w in IDENTITIES)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=5), st.lists(st.integers(-9, 9), min_size=1, max_size=5))
def test_products_of_polynomials(p, q):
    """A product written out against its factors, and against a neighbour of itself."""
    written = lambda c: "+".join(f"({x})x^{{{i}}}" for i, x in enumerate(c))
    product = [sum(p[i] * q[k - i] for i in range(len(p)) if 0 <= k - i < len(q)) for k in range(len(p) + len(q) - 1)]
    assert symbolically_equal(f"({written(p)})({written(q)})", written(product))
    assert not symbolically_equal(f"({written(p)})({written(q)})", written([product[0] + 1, *product[1:]]))


def test_symbolic_equality(spark):
    assert [symbolically_equal(a, b) for a, b, _ in SYMBOLIC] == [w for _, _, w in SYMBOLIC]
    got = over(spark, lambda a, b: A.equivalent(a, b, symbolic=symbolic_equal), (r"\frac{11+9a}{20}", r"\frac{9a+11}{20}"), ("a+b", "b-a"), (None, "x"))
    assert got == [True, False, False]


NORMAL = [
    (r"\left(2,3\right)", "(2,3)"),
    (r"864 \mbox{ inches}^2", "864"),
    (r"\$5", "5"),
    (r"x \in [-2,7]", "[-2,7]"),
    (r"90^\circ", "90"),
    ("2516_8", "2516"),
    ("4210_{5}", "4210"),
    ("x=5", "5"),
    ("(C)", "C"),
    (r"\dfrac{1}{2}", r"\frac{1}{2}"),
    (r"\sqrt2", r"\sqrt{2}"),
    (r"\frac43", r"\frac{4}{3}"),
    (r"\frac 59", r"\frac{5}{9}"),
    (r"\frac9{19}", r"\frac{9}{19}"),
    (r"\frac{1}{2}x", r"\frac{1}{2}"),
    ("58,500", "58500"),
    ("(2,12)", "(2,12)"),
    ("-2,1", "-2,1"),
    (r"\text{A}", ""),
    (r"\\\\frac12", r"\frac{1}{2}"),
    ("nan", "nan"),
    ("a \n b", "a b"),
    (None, None),
]


@pytest.mark.parametrize("profile", ["pipeline", "analysis"])
def test_normalization(spark, profile):
    assert over(spark, lambda s: A.normalize_answer(s, profile), *((t[0],) for t in NORMAL)) == [t[1] for t in NORMAL]


def test_strict_normalization_keeps_tails_and_units(spark):
    assert over(spark, lambda s: A.normalize_answer(s, strict=True), (r"\frac{1}{2}x",), (r"\text{A}",)) == [r"\frac{1}{2}x", r"\text{A}"]


PAIRS = [
    ("1,-2", "-2, 1", True, False),
    ("(1,2)", "[2,1]", True, False),
    (r"\frac{9}{100}", "0.09", True, False),
    ("3", "3.0", True, False),
    ("1/2", "0.5", False, True),
    (r"\frac{11+9a}{20}", r"\frac{9a+11}{20}", False, False),
    (r"10\%", "10", False, True),
    (r"5\text{ cm}", "5", True, True),
    ("k=4", "4", True, True),
    (r"a\text{ b}\text{ c}", r"a\text{ b}\text{ c}", True, True),
    (r"\frac12", r"\frac{1}{2}", True, True),
    (r"\sqrt", r"\sqrt", True, True),
    (r"x\frac", r"x \frac", True, False),
    (".5", "0.5", True, True),
    ("03/4", "3/4", False, False),
    ("1_000", "1000", False, False),
    (r"\frac{1}{0}", "7", False, False),
]


def test_equivalence(spark):
    both = [p[:2] for p in PAIRS]
    assert over(spark, A.equivalent, *both) == [p[2] for p in PAIRS]
    assert over(spark, lambda a, b: A.equivalent(b, a), *both) == [p[2] for p in PAIRS]
    assert over(spark, A.legacy_equivalent, *both) == [p[3] for p in PAIRS]


def test_missing_answers(spark):
    rows = [(None, None), ("1", None), (None, "1"), (r"\boxed{1}", r"\boxed{1}")]
    assert over(spark, A.legacy_equivalent, *rows) == [True, False, False, True]
    assert [r["is_correct"] for r in over(spark, A.evaluate, *rows)] == [False, False, False, True]
    assert over(spark, A.legacy_correct, ("4", r"\boxed{4}"), (r"\boxed{4}", "4"), (" 4 ", r"\boxed{k=4}")) == [True, False, True]


def test_a_symbolic_check_may_decide_the_rest(spark):
    @F.pandas_udf("boolean")
    def symbolic(a, b):
        return a.map(len) == b.map(len)

    assert over(spark, lambda a, b: A.equivalent(a, b, symbolic=symbolic), ("a+b", "b+a"), ("a", "bc")) == [True, False]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.text(alphabet=r"\{}boxedfrac12$# ,()=" + "\n", max_size=24)] * 2), min_size=1, max_size=40))
def test_equivalence_is_reflexive_and_symmetric(spark, rows):
    assert all(over(spark, lambda a, b: A.equivalent(a, a), *rows))
    assert over(spark, A.equivalent, *rows) == over(spark, lambda a, b: A.equivalent(b, a), *rows)


def test_texts(spark):
    assert over(spark, X.stated_budget, ("Budget: [[12]]",), ("[[ 12 ]]",), ("[[12]] [[30]]",), (None,)) == [12, 100, 12, 100]
    assert over(spark, X.level_text, ("Level 5",), ("Level ?",), ("3",), ("3.0",), (None,)) == ["5", "?", "3", "3", None]
    assert over(spark, lambda s: X.level_number(X.remap(s, {"aimee": "6"})), ("aimee",), ("Level 2",), ("?",)) == [6, 2, None]
    assert over(spark, X.parse_flag, ("True",), (" false ",), ("yes",), (None,)) == [True, False, None, None]
    assert over(spark, X.has_second_thought, ("know",), ("Wait",), ("cat",)) == [True, True, False]
    assert over(spark, X.think_text, ("a<think> b\nc </think>",), ("a",), ("</think><think>x</think>",)) == ["b\nc", "", "x"]
    assert over(spark, X.think_span, ("a<think> b</think>",), ("</think><think>x</think>",)) == [" b", ""]
    assert over(spark, X.strip, ("  a\x1c　",), ("",)) == ["a", ""]
    assert over(spark, lambda p: X.run_name(p, F.lit("nowait")), ("a/b/model.v1.gguf",), ("model/",)) == ["model.v1_nowait", "model_nowait"]
    assert over(spark, X.id_part, ("12-aime",), ("12",)) == ["aime", None]
    assert over(spark, lambda p: X.budget_prompt(p, F.lit(100), "sentence"), ("P",)) == ["P Use less than 1 sentences."]
    assert over(spark, lambda p: X.problem_prompt(p, F.lit("aime-250")), ("P",)) == ["P"]
    assert over(spark, X.estimate_prompt, ("Why?",))[0].startswith("Q: Why?Task: ")


def test_balanced_box_in_sql(spark):
    from tokenledger.functions.sql import register

    register(spark)
    assert spark.sql(r"select balanced_box(r'\boxed{a{b}{{c}}} \boxed{d')").first()[0] == "a{b}{{c}}"


def test_written_rules_in_sql(spark):
    from tokenledger.functions.sql import register

    register(spark)
    rows = [(r"\boxed{\dfrac{1}{2}}", r"so \boxed{0.5}"), (r"\boxed{3}", "#### 4"), (None, "x"), ("", ""), ("it's (1, 2)", "$(2,1)$"), (r"\boxed{1,234}", "1234")]
    spark.createDataFrame(rows, "a string, b string").createOrReplaceTempView("pairs_of_answers")
    both = lambda make, n=2: over(spark, make, *(rows if n == 2 else [r[:1] for r in rows]))
    in_sql = lambda text: [r[0] for r in spark.sql(f"select {text} from pairs_of_answers").collect()]
    assert in_sql("evaluate(a, b)") == both(lambda a, b: A.evaluate(a, b, native=True)) == both(A.evaluate)
    assert in_sql("equivalent(a, b)") == both(A.equivalent)
    assert in_sql("legacy_correct(a, b)") == both(A.legacy_correct)
    for name, make in (("normalize_answer", A.normalize_answer), ("legacy_form", A.legacy_form), ("answer_set", A.answer_set), ("number_value", A.number_value), ("scan_answer", X.extract_answer)):
        assert in_sql(f"{name}(a)") == both(make, 1)
    assert spark.sql("select count(*) from pairs_of_answers group by evaluate(a, b).is_correct").count() == 2


def test_roots_of_large_numbers_are_quick():
    """A square's primes come out at once; others are looked for among primes alone."""
    import time

    began = time.process_time()
    for p in range(99_000, 100_000):
        assert symbolically_equal(f"\\sqrt{{{12 * p * p}}}", f"{2 * p}\\sqrt{{3}}")
    assert time.process_time() - began < 4


def test_pairs_are_dealt_to_tasks(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["q_symbolic_equiv"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
