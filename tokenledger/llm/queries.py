"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_texts
from .divergence import audit_sources
from .fill_middle import fill_in_middle, restored
from .html_extract import extract_main_text
from .line_dedup import drop_frequent_lines
from .mixing import mix_plan
from .quality_classifier import score_quality
from .quality_rules import CLASSES, COMMON_WORDS, LEAST_WORDS, MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE, judge
from .simhash import near_duplicate_components
from .substring_dedup import remove_repeated_windows
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .topk import exact_top_k


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def vocabulary(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; it stays where it is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_table(spark, folder, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(_table(spark, folder, "documents", "doc_id", "text"), vocabulary("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_quality(_table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "labels", "doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(_table(spark, folder, "documents", "doc_id", "text", "lang")).drop("class_distance", "word_distance")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = remove_repeated_windows(_table(spark, folder, "documents", "doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE d < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LISTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_quoted, v))}]" for k, v in COMMON_WORDS.items()) + " ELSE [] END"


def _distances(name: str, references: str) -> str:
    """CTEs: the references of a set of documents, and the distances of all documents from them, kind by kind."""
    return f"""
{name}_all AS (SELECT lang, kind, bin, sum(v) AS v FROM hist WHERE doc_id IN ({references}) GROUP BY ALL),
{name}_ref AS (SELECT lang, kind, bin, v / sum(v) OVER (PARTITION BY lang, kind) AS q FROM {name}_all),
{name} AS (SELECT h.doc_id, h.lang, h.kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM shares h JOIN {name}_ref r ON h.lang IS NOT DISTINCT FROM r.lang AND h.kind = r.kind AND h.bin = r.bin GROUP BY ALL)"""


_OP5 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM d, unnest(range(1, len(ws) - 3)) AS t(i) WHERE len(ws) >= 5),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, length(t) AS chars, {", ".join(f"len(regexp_extract_all(t, {_quoted(c)})) AS c{i}" for i, c in enumerate(CLASSES))},
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, {_LISTS} AS own FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
counted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed, list_transform(own, lambda x: len(list_filter(ws, lambda y: y = x))) AS f FROM base),
hist AS (
  SELECT doc_id, lang, 'class' AS kind, unnest(range({len(CLASSES) + 1})) AS bin, CAST(unnest([c0, c1, c2, c3, c4, chars - c0 - c1 - c2 - c3 - c4]) AS DOUBLE) AS v FROM counted
  UNION ALL SELECT doc_id, lang, 'word', unnest(range(len(f) + 1)), CAST(unnest(list_append(f, n_words - coalesce(list_sum(f), 0))) AS DOUBLE) FROM counted),
shares AS (SELECT * FROM (SELECT doc_id, lang, kind, bin, v / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0) AS p FROM hist) WHERE p IS NOT NULL),
{_distances("near", "SELECT doc_id FROM counted WHERE NOT failed").strip()},
binned AS (SELECT doc_id, near.lang, floor(d * 1000) AS b FROM near JOIN counted USING (doc_id) WHERE kind = 'class' AND NOT failed),
ranked AS (SELECT lang, b, sum(count(*)) OVER (PARTITION BY lang ORDER BY b) * 2 >= sum(count(*)) OVER (PARTITION BY lang) AS up FROM binned GROUP BY lang, b),
half AS (SELECT lang, min(b) AS b FROM ranked WHERE up GROUP BY lang),
{_distances("far", "SELECT doc_id FROM binned JOIN half ON binned.lang IS NOT DISTINCT FROM half.lang WHERE binned.b <= half.b").strip()},
apart AS (SELECT doc_id, max(d) FILTER (kind = 'class') AS c, max(d) FILTER (kind = 'word') AS w FROM far GROUP BY doc_id)
SELECT doc_id, n_words, CAST(chars - c4 AS BIGINT) AS word_chars, CAST(c3 AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND NOT coalesce(n_words >= {LEAST_WORDS} AND c > {MOST_CLASS_DISTANCE} AND coalesce(CASE WHEN len(own) > 0 THEN w END, 1) > {MOST_WORD_DISTANCE}, false) AS kept FROM counted LEFT JOIN apart USING (doc_id)
"""


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    rows = encode_texts(_table(spark, folder, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, keep_text=False)
    return rows.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(_table(spark, folder, "documents", "doc_id", "text"), _table(spark, folder, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted", "saved_bytes")


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(_table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan, _ = mix_plan(_table(spark, folder, "documents", "doc_id", "text", "source"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicate_components(_table(spark, folder, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(_table(spark, folder, "documents", "doc_id", "text"), keep_text=False)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def _number(i: int) -> str:
    """The i-th 8-digit group of the hex digest h, as a whole number."""
    return " + ".join(f"(instr('123456789abcdef', h[{8 * i + k + 1}]) * {16 ** (7 - k)}::BIGINT)" for k in range(8))


_OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
draws AS (SELECT *, CAST(len(units) AS BIGINT) AS n, {_number(0)} AS h1, {_number(1)} AS h2, {_number(2)} AS h3, {_number(3)} AS h4 FROM d),
formed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM formed),
cut AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = drop_frequent_lines(_table(spark, folder, "documents", "doc_id", "text"), least_docs=10, least_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP12 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (often.key IS NOT NULL) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY doc_id
"""


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(_table(spark, folder, "documents", "text", "lang", "source"), least_docs=3, most_terms=200)


_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 1)::HUGEINT) // (g.total + v) AS p, 1 + (1000000000 * (k.n + 1)::HUGEINT) // (vocabulary.total + v) AS q
  FROM g JOIN kept k USING (lang) JOIN vocabulary USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pair UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM term),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES = {
    "op1_substring_dedup": _OP1,
    "op5_quality_rules": _OP5,
    "op8_exact_top_k": _OP8,
    "op11_fill_in_middle": _OP11,
    "op12_line_dedup": _OP12,
    "op13_source_divergence": _OP13,
}
