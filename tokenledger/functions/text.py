"""Text columns: stripping, answer extraction, budgets, levels, prompts. All but one are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import written as W
from .written import Written, let, of, written

#: White space as Python's str.strip() and \s have it (a Java character class).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


#: The same characters, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return of(s).btrim(s, of(s).lit(SPACES))


def _match(s: Column, pattern: str, place: int) -> Column:
    """Group 1 of the match at a place (1: first, -1: last), stripped; null if there is none."""
    f = of(s)
    return strip(f.try_element_at(f.regexp_extract_all(s, f.lit(pattern), f.lit(1)), f.lit(place)))


def boxed_first(s: Column) -> Column:
    """The first \\boxed{...} up to the next closing brace; null if there is none. Null and empty texts give null."""
    return _match(s, r"\\boxed\{([^}]*)\}", 1)


_BRACE = re.compile(r"\\{1,2}boxed\{|[{}]")
_WRAPPED = re.compile(r"\\text(?:bf|it|rm|sf)?\{(.+)\}$")


def balanced_box(text: str | None) -> str | None:
    """The content of the last \\boxed{...} whose braces balance, a \\text{...} around all of it taken off. One pass."""
    if not text or "boxed{" not in text:
        return None
    open_at, best, end = [], -1, -1
    for brace in _BRACE.finditer(text):
        if brace[0] != "}":
            open_at.append(brace.end() if len(brace[0]) > 1 else -1)
        elif open_at and (start := open_at.pop()) > best:
            best, end = start, brace.start()
    if best < 0:
        return None
    return _unwrapped(text[best:end].strip())


def _unwrapped(inner: str) -> str:
    """Without a \\text{...} around all of it."""
    wrapped = _WRAPPED.match(inner)
    return wrapped[1].strip() if wrapped else inner


def _by_value(values: pa.Array, use) -> pa.Array:
    """use() of each text, called once for equal ones."""
    coded = values.dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array([use(x) for x in coded.dictionary.to_pylist()], pa.string())).cast(pa.string())


@F.arrow_udf(T.StringType())
def _balanced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for s in batches:
        yield _by_value(s, balanced_box)


def boxed_balanced(s: Column) -> Column:
    """balanced_box() as a column; texts without a box skip Python's part of the work."""
    return _balanced(F.when(s.contains("boxed{"), s))


def nested(levels: int, plain: str = "[^{}]") -> str:
    """A pattern of a text whose braces balance within some levels. All repeats are possessive, which Java's engine
    follows by loops and not by calls, so that no length of text exhausts the stack."""
    inner = f"{plain}*+"
    for _ in range(levels):
        inner = rf"{plain}*+(?:\{{{inner}\}}{plain}*+)*+"
    return inner


#: Levels of braces that one regular expression follows. Deeper ones are counted token by token.
LEVELS = 4


@written(1)
def boxed_balanced_native(s: Column) -> Column:
    """As boxed_balanced(), by built-in functions: what follows the last box is matched at once if its braces balance
    within LEVELS; else all braces of the text are counted, of whatever depth."""
    wrapped = r"(?d)\A\\text(?:bf|it|rm|sf)?\{(.+)\}\z"
    closed = rf"\A({nested(LEVELS)})\}}"
    last = W.substring_index(s, "\\boxed{", -1)
    box = W.when(last.rlike(closed), W.regexp_extract(last, closed, 1)).otherwise(_counted_box(s))
    content = let(W.when(s.contains("\\boxed{"), box), strip)
    return let(content, lambda c: W.when(c.rlike(wrapped), strip(W.regexp_extract(c, wrapped, 1))).otherwise(c))


def _counted_box(s: Written) -> Written:
    """The content of the last box whose braces balance: from the right, an opening brace is closed if a closing one to
    its right is still free; from the left, the box ends where its depth is 0 again. Both are one pass."""

    def backward(a: Written, t: Written) -> Written:
        free = W.when(t == "}", a["free"] + 1).when(t.endswith("{") & (a["free"] > 0), a["free"] - 1).otherwise(a["free"])
        at = W.when((a["at"] == 0) & (a["free"] > 0) & t.endswith("boxed{"), a["seen"] + 1).otherwise(a["at"])
        return W.struct(free.alias("free"), (a["seen"] + 1).alias("seen"), at.alias("at"))

    def forward(a: Written, t: Written) -> Written:
        depth = W.when(t == "}", a["depth"] - 1).when(t.endswith("{"), a["depth"] + 1).otherwise(a["depth"])
        end = W.when((a["end"] == 0) & (t == "}") & (a["depth"] == 1), a["seen"] + 1).otherwise(a["end"])
        return W.struct(depth.alias("depth"), (a["seen"] + 1).alias("seen"), end.alias("end"))

    def after(tokens: Written) -> Written:
        zero = W.struct(W.lit(0).alias("free"), W.lit(0).alias("seen"), W.lit(0).alias("at"))
        at = W.aggregate(W.reverse(tokens), zero, backward, lambda a: a["at"])
        both = W.struct(tokens.alias("t"), at.alias("n"))
        return let(both, lambda z: W.when(z["n"] > 0, W.slice(z["t"], W.size(z["t"]) - z["n"] + 2, z["n"] - 1)))

    def inner(tokens: Written) -> Written:
        zero = W.struct(W.lit(1).alias("depth"), W.lit(0).alias("seen"), W.lit(0).alias("end"))
        end = W.aggregate(tokens, zero, forward, lambda a: a["end"])
        return W.array_join(W.slice(tokens, W.lit(1), end - 1), "")

    tokens = W.regexp_extract_all(s, W.lit(r"\\{1,2}boxed\{|[{}]|[^{}\\]++|\\"), W.lit(0))
    return let(let(tokens, after), lambda t: W.when(t.isNotNull(), inner(t)))


#: What the two profiles allow before and after a marked answer or a lone number: in run-time scoring exactly one blank.
PROFILES = {"pipeline": ("[ \\t]", "[ \\t]"), "analysis": ("[ \\t]*", "[ \\t]*")}


def marked_answer(s: Column, profile: str = "analysis") -> Column:
    """The last line that is "#### answer"."""
    before, after = PROFILES[profile]
    return _match(s, rf"(?dm)^{before}####{after}([^\n\r#]+?)[ \t]*$", -1)


def last_dollars(s: Column) -> Column:
    """What stands between the last pair of dollar signs."""
    return _match(s, r"\$([^$]*)\$", -1)


def lone_number(s: Column, profile: str = "analysis") -> Column:
    """The last line that is a number."""
    before, after = PROFILES[profile]
    return _match(s, rf"(?dm)^{before}([+-]?\p{{Nd}}+(?:\.\p{{Nd}}+)?){after}$", -1)


#: Lines of a marked answer and of a number, by profile.
_MARKED = {k: re.compile(rf"^{before}####{after}([^\n\r#]+?)[ \t]*$", re.M) for k, (before, after) in PROFILES.items()}
_NUMBER = {k: re.compile(rf"^{before}([+-]?\d+(?:\.\d+)?){after}$", re.M) for k, (before, after) in PROFILES.items()}


def _boxes(text: str) -> str | None:
    """What the boxes of a text say, in one pass over its braces: the last box that balances, else the last one up to a brace."""
    open_at, best, end, loose, said = [], -1, -1, -1, None
    for brace in _BRACE.finditer(text):
        at = brace.start()
        if brace[0] != "}":
            box = brace.end() if brace.end() - at > 1 else -1
            open_at.append(box)
            if loose < 0:
                loose = box
            continue
        if loose >= 0:
            said, loose = (loose, at), -1
        if open_at and (start := open_at.pop()) > best:
            best, end = start, at
    if best < 0:
        return None if said is None else text[said[0] : said[1]].strip()
    return _unwrapped(text[best:end].strip())


def scan_answer(text: str | None, profile: str = "analysis") -> str | None:
    """As extract_answer(), in Python: each kind of answer is looked for in one pass, and only where its mark occurs."""
    if not text:
        return None
    if "boxed{" in text and (found := _boxes(text)) is not None:
        return found
    if "####" in text and (lines := _MARKED[profile].findall(text)):
        return lines[-1].strip()
    if (n := text.count("$")) > 1:  # dollar signs pair up from the left
        end = text.rfind("$")
        if n % 2:
            end = text.rfind("$", 0, end)
        return text[text.rfind("$", 0, end) + 1 : end].strip()
    if lines := _NUMBER[profile].findall(text):
        return lines[-1].strip()
    return text


def _scanner(profile: str):
    @F.arrow_udf(T.StringType())
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            yield _by_value(s, lambda text: scan_answer(text, profile))

    return scan


_SCANNERS = {profile: _scanner(profile) for profile in PROFILES}


def extract_answer(s: Column, profile: str = "analysis", native: bool = False) -> Column:
    """The answer of a text: its last balanced box; else its last box up to a brace; else a marked line; else what
    is between dollar signs; else a lone number; else the whole text. Null for null and empty texts. native: by built-in
    functions; else by one scan in Python, in Arrow batches."""
    return _native_answer(s, profile) if native else _SCANNERS[profile](s)


@written(1)
def _native_answer(s: Written, profile: str) -> Written:
    boxes = W.coalesce(boxed_balanced_native(s), _match(s, r"\\{1,2}boxed\{([^}]*)\}", -1))
    kinds = ("boxed{", boxes), ("####", marked_answer(s, profile)), ("$", last_dollars(s))
    return W.coalesce(*(W.when(s.contains(mark), answer) for mark, answer in kinds), lone_number(s, profile), W.nullif(s, ""))


def think_text(s: Column) -> Column:
    """The first <think>...</think>, stripped, else an empty text."""
    return strip(F.regexp_extract(s, r"(?s)<think>(.*?)</think>", 1))


def think_span(s: Column) -> Column:
    """What is between the first <think> and the first </think> of the text; empty unless both are there in order."""
    a, b = F.locate("<think>", s), F.locate("</think>", s)
    return F.when((a > 0) & (b >= a + 7), F.substring(s, a + 7, b - a - 7)).otherwise(F.lit(""))


def stated_budget(s: Column, default: int = 100) -> Column:
    """The first [[number]], else the default (also for null)."""
    return F.coalesce(F.nullif(F.regexp_extract(s, r"\[\[(\p{Nd}+)\]\]", 1), F.lit("")).try_cast("bigint"), F.lit(default).cast("bigint"))


def prompt_budget(s: Column) -> Column:
    """The number of tokens that a prompt asks for; null if it asks for none."""
    return F.nullif(F.regexp_extract(s, r"(?:Think for|Use less than) (\d+) tokens\.", 1), F.lit("")).try_cast("bigint")


def id_part(s: Column, place: int = 1) -> Column:
    """The part of an id at a place (from 0), cut at hyphens; null if there is none."""
    return F.get(F.split(s, "-"), F.lit(place))


def level_number(s: Column, strict: bool = False) -> Column:
    """A level without the word "Level", as a number. What is none is null, or an error if strict."""
    bare = strip(F.replace(s, F.lit("Level"), F.lit("")))
    return bare.cast("int") if strict else bare.try_cast("int")


def remap(s: Column, words: dict[str, str]) -> Column:
    """A text with some words replaced by others, e.g. a level that is named by a number."""
    for old, new in words.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def level_text(s: Column) -> Column:
    """A level as text: "Level 3", 3 and 3.0 are all "3"; null stays null."""
    bare = strip(F.regexp_replace(s, "^Level", ""))
    return F.regexp_replace(bare, r"^(-?\d+)\.0+$", "$1")


def solution_text(s: Column, kind: str) -> Column:
    """A solution as text: lists are joined by line ends, null stays null. kind: the column's type, as dtypes has it."""
    return F.when(s.isNotNull(), F.array_join(s, "\n")) if kind.startswith("array") else s.cast("string")


def parse_flag(s: Column) -> Column:
    """"true" or "false", in any case and with white space around, as a boolean; all else is null."""
    bare = F.lower(strip(s.cast("string")))
    return F.when(bare == "true", True).when(bare == "false", False)


def pair_key(a: Column, b: Column) -> Column:
    """a-b."""
    return F.concat_ws("-", a.cast("string"), b.cast("string"))


def run_name(path: Column, mode: Column) -> Column:
    """<last part of a model's path, without its extension>_<mode>."""
    return F.concat(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?/*$", 1), F.lit("_"), mode)


# Instructions of prompts; the first two differ in the apostrophe and in wording.
INSTRUCTION_CURLY = "\nLet\u2019s think step by step and output the final answer within boxed{}."
INSTRUCTION_PLAIN = "\nLet's think step by step and output the final answer within boxed{}."
INSTRUCTION_INSIDE = " Let\u2019s think step by step inside and output the final answer within boxed{}."
ESTIMATE_TASK = (
    "Task: Analyze the given question and estimate the minimum number of tokens required to generate a complete and accurate response. "
    "Please Give the response by strictly following this format: [[budget]]. for example, Budget: [[12]].\n\n"
)
#: The data set whose problems carry their own instruction; tokens to a sentence when data is
#: generated and when it is evaluated.
SELF_INSTRUCTED = "aime-250"
SENTENCE_GENERATION, SENTENCE_EVALUATION = 80, 60
#: Words of second thoughts.
SECOND_THOUGHTS = ("wait", "alternatively", "hmm", "but", "however", "alternative", "another", "check", "double-check", "oh", "maybe", "verify", "other", "again", "now", "ah", "any")


def problem_prompt(problem: Column, dataset: Column, instruction: str = INSTRUCTION_PLAIN) -> Column:
    """A problem with the instruction, but for those that carry their own."""
    return F.when(dataset == SELF_INSTRUCTED, problem).otherwise(F.concat(problem, F.lit(instruction)))


def budget_prompt(content: Column, budget: Column, mode: str, sentence: int = SENTENCE_EVALUATION) -> Column:
    """content with a budget. mode: "token" (or "regressor"), "less" (or "tale"), "sentence", or another for none."""
    if mode in ("token", "regressor"):
        return F.concat(content, F.lit(" Think for "), budget.cast("string"), F.lit(" tokens."))
    if mode in ("less", "tale"):
        return F.concat(content, F.lit(" Use less than "), budget.cast("string"), F.lit(" tokens."))
    if mode == "sentence":
        return F.concat(content, F.lit(" Use less than "), F.floor(budget / sentence).cast("string"), F.lit(" sentences."))
    return content


def estimate_prompt(question: Column, remove: str = "") -> Column:
    """Asks for a budget; a text may be removed from the question first."""
    return F.concat(F.lit("Q: "), F.replace(question, F.lit(remove), F.lit("")) if remove else question, F.lit(ESTIMATE_TASK))


def chat_prompt(content: Column, template: str = "{}") -> Column:
    """content in a chat template, given as a text with {} where it goes."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), content, F.lit(after))


def has_second_thought(token: Column, words=SECOND_THOUGHTS) -> Column:
    """Whether a token, stripped and in lower case, contains one of the words ("know" contains "now")."""
    bare = F.lower(strip(token))
    hit = F.lit(False)
    for w in words:
        hit = hit | bare.contains(w)
    return F.coalesce(hit, F.lit(False))


def long_answer(value: Column, most: int = 50) -> Column:
    """Whether an answer is longer than an answer can be; null counts as no."""
    return F.coalesce(F.char_length(value) > most, F.lit(False))
