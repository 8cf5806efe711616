"""Quality rules: base counts, and divergence from language references, by DataFrame operations only.

A document's histograms over character classes and over its language's common words are held against those of
all documents of that language by Jensen-Shannon distance; short documents, whose histograms say little, pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, cut

#: Common words of each language.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour"),
}

#: Character classes counted one by one; all other characters are the last class.
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]", r"[\x20\x09-\x0D]")
SYMBOLS = CLASSES[3]

#: Words a document must have for its histograms to count; the two distances that, both exceeded, reject it.
LEAST_WORDS = 60
MOST_CLASS_DISTANCE = 0.15
MOST_WORD_DISTANCE = 0.2


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words in windows of `size` that occur twice or more among the words, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        # (hash, place) in order: a window is repeated if a neighbour has its hash
        def places(ordered: Column) -> Column:
            twice = F.filter(ordered, lambda e, i: F.get(ordered, i - 1)["h"].eqNullSafe(e["h"]) | F.get(ordered, i + 1)["h"].eqNullSafe(e["h"]))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size)))), F.lit(0), lambda a, x: a + x)

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, lambda o: _let(places(o), total)))

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + d) for d in range(1, size))))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), covered)).cast("long")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms, arrays of counts of one length; null if one is empty."""

    def share(x: Column) -> Column:
        return _let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), lambda n: F.transform(x, lambda v: v / n))

    def gain(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    both = F.aggregate(F.zip_with(share(p), share(q), lambda a, b: gain(a, b) + gain(b, a)), F.lit(0.0), lambda s, v: s + v)
    some = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) > 0
    return F.when(some(p) & some(q), F.sqrt(F.greatest(both / 2, F.lit(0.0))))


def document_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common), one row a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"), words_of(F.col(text_col)).alias("words"), F.char_length(text).alias("chars"), *(F.regexp_count(text, F.lit(c)).alias(f"c{i}") for i, c in enumerate(CLASSES)))
    lists = F.create_map(*(x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(lists, F.col("lang")), F.array().cast("array<string>"))
    hits = lambda c: _let(F.filter("words", lambda w: F.array_contains(c, w)), lambda f: F.transform(c, lambda k: F.size(F.filter(f, lambda w: w == k)).cast("double")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    rest = F.col("chars") - sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0))
    common = _let(own, hits)
    return base.select(
        "id", "lang", n.cast("long").alias("n_words"), (F.col("chars") - F.col("c4")).cast("long").alias("word_chars"), F.col("c3").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*(F.col(f"c{i}").cast("double") for i in range(len(CLASSES))), rest.cast("double")).alias("classes"),
        _let(common, lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0.0), lambda a, v: a + v)))).alias("common"),
    )


def _references(counts: DataFrame) -> DataFrame:
    """Summed histograms, one row a language."""
    longest = max(map(len, COMMON_WORDS.values())) + 1
    return counts.groupBy(F.col("lang").alias("_lang")).agg(
        F.array(*(F.sum(F.get("classes", F.lit(i))) for i in range(len(CLASSES) + 1))).alias("all_classes"),
        F.array(*(F.coalesce(F.sum(F.get("common", F.lit(i))), F.lit(0.0)) for i in range(longest))).alias("all_common"),
    )


def _distances(counts: DataFrame, references: DataFrame) -> DataFrame:
    both = counts.join(references, counts["lang"].eqNullSafe(references["_lang"]), "left")
    # without a list of common words there is one bin, which says nothing
    words = F.when(F.size("common") > 1, js_distance(F.col("common"), F.slice("all_common", 1, F.size("common"))))
    return both.select(*counts.columns, js_distance(F.col("classes"), F.col("all_classes")).alias("class_distance"), words.alias("word_distance"))


def _nearer_half(near: DataFrame) -> DataFrame:
    """The rows up to each language's median class distance, by counts in bins of a thousandth."""
    place = F.floor(F.col("class_distance") * 1000)
    counts = near.groupBy(F.col("lang").alias("_lang"), place.alias("_bin")).count()
    mine = Window.partitionBy("_lang")
    upto = F.sum("count").over(mine.orderBy("_bin"))
    halves = counts.withColumn("_in", upto * 2 >= F.sum("count").over(mine)).where("_in").groupBy("_lang").agg(F.min("_bin").alias("_half"))
    return near.join(halves, near["lang"].eqNullSafe(halves["_lang"])).where(place <= F.col("_half")).select(near.columns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
    kept), one row a row of docs, without its other columns.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. Otherwise a document is kept
    unless it has words enough and both histograms lie too far from its language's. References are sums over all
    documents of a language (null is one too) that did not fail, taken again of the half nearer to the first; a
    language without any rejects none; for one without a list of common words (its word distance is null) the classes
    alone decide. Null and empty texts have no words. Texts may be of any length. Repeated rows are judged alike; an
    empty table gives an empty table.
    """
    counts = cut(document_counts(docs, id_col, text_col, lang_col))
    wide = len(CLASSES) + 1
    longest = max(map(len, COMMON_WORDS.values())) + 1
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = _distances(counts, _references(counts.where(~failed)))
    # once more, of the half of each language's documents that lies nearer to the first reference
    far = _distances(counts, _references(_nearer_half(near.where(~failed & F.col("class_distance").isNotNull()))))
    odd = (F.col("n_words") >= LEAST_WORDS) & (F.col("class_distance") > MOST_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(1.0)) > MOST_WORD_DISTANCE)
    return far.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"))
