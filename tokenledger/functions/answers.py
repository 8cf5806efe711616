"""Normalization and equivalence of answers in LaTeX, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import written as W
from .symbolic import symbolic_equal, symbolic_or
from .text import LEVELS, SPACE, boxed_first, extract_answer, nested, strip
from .written import Written, let, written

#: The two arguments of a \frac, each in braces or one character, where braces balance within LEVELS.
_ARGUMENT = rf"(?:\{{({nested(LEVELS)})\}}|([^{{ ]))"
_ARGUMENTS = rf"(?s)\A *+{_ARGUMENT} *+{_ARGUMENT}"
#: Texts that are their own normal form, once stripped.
_PLAIN = r"\A[0-9A-Za-z.+/-]*+\z"
_UNIT = r"\\(?:text|mbox|textbf|mathrm)\{"


def _drop(s: Written, *texts: str) -> Written:
    for t in texts:
        s = W.replace(s, W.lit(t), W.lit(""))
    return s


def _cut(s: Written, pattern: str, by: str = "") -> Written:
    return strip(W.regexp_replace(s, pattern, by))


@written(1)
def normalize_answer(s: Column, profile: str = "analysis", strict: bool = False) -> Column:
    """An answer in a form that can be compared. Null, empty and "nan" stay as they are.

    Double backslashes become single ones; \\left and \\right, units, \\$, \\! and \\, a leading "x \\in" or "x=", a
    trailing degree sign or base, and brackets around one letter go; \\dfrac, \\sqrt2 and \\frac43 get their full
    form; commas between thousands go where there are no brackets; white space becomes one blank. After the second
    argument of a line's first \\frac the rest of the line is lost, and so are units, unless strict.
    """
    # most answers are plain, and stay as they are
    x = let(strip(s), lambda v: W.when(v.rlike(_PLAIN), v).otherwise(_normalized(v, profile, strict)))
    return W.when(s.isNull() | (s == "") | (s == "nan"), s).otherwise(x)


def _normalized(x: Written, profile: str, strict: bool) -> Written:
    x = W.when(x.contains("\\"), _latex(x, profile, strict)).otherwise(x)
    x = let(x, lambda v: W.when(v.contains("_"), _cut(v, rf"(?d)_\{{?\p{{Nd}}+\}}?{SPACE}*$")).otherwise(v))
    x = let(x, lambda v: W.when(v.contains("="), _cut(v, rf"^[a-zA-Z]{SPACE}*={SPACE}*")).otherwise(v))
    x = let(x, lambda v: W.when(v.startswith("("), W.regexp_replace(v, r"(?d)\A\(([A-Za-z])\)$", "$1")).otherwise(v))
    x = let(x, lambda v: W.when(v.contains("\\"), _full_forms(v, strict)).otherwise(v))
    commas = lambda v: W.regexp_replace(v, r"(?d)(?<=\p{Nd}),(?=\p{Nd}{3}(?:\P{Nd}|$))", "")
    x = let(x, lambda v: W.when(v.contains(",") & ~v.rlike(r"[()\[\]\\]"), commas(v)).otherwise(v))
    return strip(W.regexp_replace(x, rf"{SPACE}+", " "))


def _latex(x: Written, profile: str, strict: bool) -> Written:
    """The rules up to the degree sign, for a text with a backslash."""
    x = let(x, lambda v: W.when(v.contains("\\\\"), W.regexp_replace(v, r"\\{2,}", r"\\")).otherwise(v))
    for side in ("left", "right"):
        x = W.replace(x, W.lit(f"\\{side}"), W.lit(""))
    if not strict:

        def without_units(v: Written) -> Written:
            if profile == "pipeline":
                v = _cut(v, rf"(?d){SPACE}*{_UNIT}[^}}]\}}(?:\^\p{{Nd}}+)?{SPACE}$")
            return _cut(v, rf"{SPACE}*{_UNIT}[^}}]*\}}(?:\^\p{{Nd}}+)?")

        x = let(x, lambda v: W.when(v.rlike(_UNIT), without_units(v)).otherwise(strip(v)))
    x = strip(_drop(x, "\\$", "\\!", "\\,"))
    x = let(x, lambda v: W.when(v.contains("\\in"), _cut(v, rf"^[a-zA-Z]{SPACE}*\\in{SPACE}*")).otherwise(v))
    return let(x, lambda v: W.when(v.contains("\\circ"), _cut(v, rf"(?d)\^\\circ{SPACE}*$")).otherwise(v))


@written(1)
def _full_forms(x: Column, strict: bool) -> Column:
    x = W.replace(x, W.lit("\\dfrac"), W.lit("\\frac"))
    root = lambda v: W.regexp_replace(v, r"\\sqrt([^{\s\x1c-\x1f\x85\p{Z}\\])", r"\\sqrt{$1}")
    x = let(x, lambda v: W.when(v.contains("\\sqrt"), root(v)).otherwise(v))
    lines = lambda v: W.array_join(W.transform(W.split(v, "\n"), lambda line: _fraction(line, strict)), "\n")
    return let(x, lambda v: W.when(~v.contains("\\frac"), v).when(v.contains("\n"), lines(v)).otherwise(_fraction(v, strict)))


def _fraction(line: Written, strict: bool) -> Written:
    """A line whose first \\frac has both arguments in braces; what follows them is dropped unless strict. A line where
    it lacks an argument stays."""

    def expanded(rest: Written) -> Written:
        short = W.regexp_replace(rest, _ARGUMENTS + ("" if strict else ".*"), r"\\frac{$1$2}{$3$4}")
        return W.when(rest.rlike(_ARGUMENTS), short).otherwise(_counted_fraction(rest, strict))

    before = W.substring_index(line, "\\frac", 1)
    return W.when(line.contains("\\frac"), W.concat(before, let(W.substr(line, W.char_length(before) + 6), expanded))).otherwise(line)


def _counted_fraction(rest: Written, strict: bool) -> Written:
    """What a \\frac and the rest of its line become, braces of any depth counted. A last argument whose brace stays
    open reaches to the end."""
    zero = W.struct(*(W.lit(0).alias(n) for n in ("seen", "done", "depth", "from1", "to1", "from2", "to2")))

    def step(a: Written, c: Written) -> Written:
        seen, idle = a["seen"] + 1, (a["done"] == 2) | ((a["depth"] == 0) & (c == " "))
        depth = W.when(idle, a["depth"]).when(c == "{", a["depth"] + 1).when((c == "}") & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        ends = ~idle & (depth == 0)
        begins = ~idle & (a["depth"] == 0)
        place = lambda n, k, now: W.when(now & (a["done"] == k), seen).otherwise(a[n]).alias(n)
        return W.struct(seen.alias("seen"), (a["done"] + ends.cast("int")).alias("done"), depth.alias("depth"), place("from1", 0, begins), place("to1", 0, ends), place("from2", 1, begins), place("to2", 1, ends))

    # inner functions use nothing from around them: a Python function's argument may not
    def written(z: Written) -> Written:
        rest, a = z["rest"], z["at"]
        argument = lambda x, y: let(W.substr(rest, x, y - x + 1), lambda t: W.when(t.startswith("{"), t).otherwise(W.concat(W.lit("{"), t, W.lit("}"))))
        to2 = W.when(a["done"] == 2, a["to2"]).otherwise(a["seen"])
        tail = W.substr(rest, to2 + 1) if strict else W.lit("")
        both = (a["done"] == 2) | ((a["done"] == 1) & (a["depth"] > 0))
        return W.when(both, W.concat(W.lit("\\frac"), argument(a["from1"], a["to1"]), argument(a["from2"], to2), tail)).otherwise(W.concat(W.lit("\\frac"), rest))

    at = W.aggregate(W.regexp_extract_all(rest, W.lit("(?s)."), W.lit(0)), zero, step)
    return let(W.struct(rest.alias("rest"), at.alias("at")), written)


@written(1)
def answer_set(s: Column) -> Column:
    """A list at commas, without brackets around it, sorted; null for fewer than two parts, or a part whose braces
    don't balance."""
    inner = W.regexp_replace(W.regexp_replace(strip(s), r"\A[(\[]", ""), r"[)\]]\z", "")
    count = lambda p, b: W.char_length(p) - W.char_length(W.replace(p, W.lit(b), W.lit("")))
    whole = lambda parts: W.forall(parts, lambda p: count(p, "{") == count(p, "}"))
    return let(W.transform(W.split(inner, ","), strip), lambda parts: W.when((W.size(parts) > 1) & whole(parts), W.array_join(W.array_sort(parts), ",")))


@written(1)
def plain_number(s: Column) -> Column:
    """A number as Python's float() reads it: underscores between digits, inf and nan included; else null."""
    return let(strip(s), _float)


def _float(bare: Written) -> Written:
    digits = r"\d(?:_?\d)*+"
    number = bare.rlike(rf"\A[+-]?(?:{digits}\.?(?:{digits})?|\.{digits})(?:[eE][+-]?{digits})?\z")
    endless = W.when(bare.startswith("-"), W.lit(float("-inf"))).otherwise(W.lit(float("inf")))
    word = W.when(W.lower(bare).endswith("nan"), W.lit(float("nan"))).otherwise(endless)
    return W.when(number, W.replace(bare, W.lit("_"), W.lit("")).try_cast("double")).when(bare.rlike(r"(?i)\A[+-]?(?:inf|infinity|nan)\z"), word)


@written(1)
def number_value(s: Column) -> Column:
    """The value of a number or of \\frac{a}{b}; null where there is none or b is 0."""
    pattern = r"(?d)\A\\frac\{([^}]+)\}\{([^}]+)\}$"
    ratio = W.try_divide(plain_number(W.regexp_extract(s, pattern, 1)), plain_number(W.regexp_extract(s, pattern, 2)))
    return W.when(s.startswith("\\"), W.when(s.startswith("\\frac{"), ratio)).otherwise(plain_number(s))


@written(2)
def same_value(a: Column, b: Column) -> Column:
    """Whether two normalized answers have values less than 1e-9 apart."""
    near = let(number_value(a) - number_value(b), lambda d: ~W.isnan(d) & (W.abs(d) < 1e-9))
    return W.coalesce(near, False)


def _text(x: Written) -> Written:
    return W.coalesce(x.cast("string"), "None")


def _same(a: Written, b: Written) -> Written:
    """Whether two normal forms are the same as texts, without blanks, as sets or as values."""
    bare = lambda x: W.replace(x, " ", "")
    sets = W.when(a.contains(",") & b.contains(","), W.coalesce(answer_set(a) == answer_set(b), False)).otherwise(False)
    return (bare(a) == bare(b)) | sets | same_value(a, b)


def _forms(t: Written, profile: str, strict: bool) -> Written:
    """The normal forms of t's a and b, by one rule."""
    return W.transform(W.array(t["a"], t["b"]), lambda x: normalize_answer(x, profile, strict))


@written(2)
def _equivalent(expected: Written, generated: Written, profile: str, strict: bool) -> Written:
    def plain_value(t: Written) -> Written:
        digits = r"\A[0-9]{1,15}\z"
        return W.when(t["a"].rlike(digits) & t["b"].rlike(digits), t["a"].cast("long") == t["b"].cast("long")).otherwise(same_value(t["a"], t["b"]))

    def decided(t: Written) -> Written:
        full = let(_forms(t, profile, strict), lambda f: _same(f[0], f[1]))
        return W.when(t["a"] == t["b"], True).when(t["a"].rlike(_PLAIN) & t["b"].rlike(_PLAIN), plain_value(t)).otherwise(full)

    return let(W.struct(("a", _text(expected)), ("b", _text(generated))), decided)


@written(2)
def _left_open(expected: Written, generated: Written, profile: str, strict: bool) -> Written:
    """STRUCT<a, b, same>: normal forms, and whether they are the same; equal texts are as they stand."""
    found = lambda t: let(_forms(t, profile, strict), lambda f: W.struct(("a", f[0]), ("b", f[1]), ("same", _same(f[0], f[1]))))
    equal = lambda t: W.struct(("a", t["a"]), ("b", t["b"]), ("same", W.lit(True)))
    return let(W.struct(("a", _text(expected)), ("b", _text(generated))), lambda t: W.when(t["a"] == t["b"], equal(t)).otherwise(found(t)))


def equivalent(expected: Column, generated: Column, profile: str = "analysis", strict: bool = False, symbolic=None) -> Column:
    """Whether two answers are the same once normalized: as texts, without blanks, as sets or as values.

    A null is the text "None". Equal texts are the same at once; two plain ones can only be the same value. symbolic: a function of
    two columns that decides the rest, from normal forms (null where it is decided already); by default nothing does.
    """
    if symbolic is None:
        return _equivalent(expected, generated, profile, strict)
    found = _left_open(expected, generated, profile, strict)
    if symbolic is symbolic_equal:
        return symbolic_or(found)
    # Python's functions can't stand in a let
    return found["same"] | F.coalesce(symbolic(F.when(~found["same"], found["a"]), F.when(~found["same"], found["b"])), F.lit(False))


@written(2)
def _verdict(a: Written, b: Written, profile: str) -> Written:
    ok = W.when(a.isNull() | b.isNull(), False).otherwise(_equivalent(a, b, profile, False))
    return W.struct(("is_correct", ok), ("expected_value", a), ("generated_value", b))


def evaluate(expected: Column, generated: Column, profile: str = "analysis", native: bool = False) -> Column:
    """STRUCT<is_correct, expected_value, generated_value>; without an answer on either side it is not correct."""
    return _verdict(extract_answer(expected, profile, native), extract_answer(generated, profile, native), profile)


# The older algorithm. A text on which it fails is null, which makes the comparison one of the raw texts.

@written(1)
def legacy_form(s: Column) -> Column:
    """The older algorithm's form of an answer; null where it fails: with "\\text{ " twice or more, or with nothing
    after a \\sqrt or a \\frac."""
    x = _drop(s, "\n", "\\!")
    x = W.replace(x, W.lit("\\\\"), W.lit("\\"))
    x = W.replace(W.replace(x, W.lit("tfrac"), W.lit("frac")), W.lit("dfrac"), W.lit("frac"))
    x = _drop(x, "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")
    x = let(x, lambda v: W.when(W.size(W.split(v, r"\\text\{ ")) <= 2, W.substring_index(v, "\\text{ ", 1)))
    x = _drop(x, "\\%")
    x = W.replace(W.replace(x, W.lit(" ."), W.lit(" 0.")), W.lit("{."), W.lit("{0."))
    x = W.regexp_replace(x, r"\A\.", "0.")
    x = let(W.split(x, "="), lambda p: W.when((W.size(p) == 2) & (W.char_length(p[0]) <= 2), W.get(p, W.lit(1))).otherwise(W.array_join(p, "=")))
    x = let(x, lambda v: W.when(~v.rlike(r"\\sqrt(?:\z|(?=\\sqrt))"), W.regexp_replace(v, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")))
    x = let(W.replace(x, W.lit(" "), W.lit("")), _legacy_fractions)
    ratio = r"\A(0|-?[1-9]\d*)/(0|-?[1-9]\d*)\z"
    return W.regexp_replace(W.regexp_replace(x, r"\A0\.5\z", r"\\frac{1}{2}"), ratio, r"\\frac{$1}{$2}")


def _legacy_fractions(x: Written) -> Written:
    """Every \\frac with its arguments in braces; null with nothing after one; as it is if one has a single character."""
    failed = x.rlike(r"\\frac(?:\z|(?=\\frac))")
    short = x.rlike(r"(?s)\\frac[^{](?:\z|(?=\\frac))")
    full = W.regexp_replace(W.regexp_replace(x, r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"(?s)\\frac([^{])\{", r"\\frac{$1}{")
    return W.when(~failed, W.when(short, x).otherwise(full))


@written(2)
def legacy_equivalent(a: Column, b: Column) -> Column:
    """The older comparison: two nulls are equal, one is not; if either text fails, the raw texts are compared."""
    forms = W.struct(legacy_form(a).alias("x"), legacy_form(b).alias("y"))
    same = let(forms, lambda f: W.coalesce(f["x"] == f["y"], a == b))
    return W.when(a.isNull() & b.isNull(), W.lit(True)).when(a.isNull() | b.isNull(), W.lit(False)).otherwise(same)


@written(2)
def legacy_correct(expected: Column, generated: Column, raw_expected: bool = False) -> Column:
    """The older verdict on two texts with boxes: an expected text without one stands for itself, a generated one
    without one is wrong. raw_expected: the expected text is an answer already."""
    want = expected if raw_expected else W.coalesce(boxed_first(expected), strip(expected))
    got = boxed_first(generated)
    return W.when(got.isNull(), W.lit(False)).otherwise(legacy_equivalent(want, got))
