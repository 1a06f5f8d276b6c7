"""Quality rules (2): a threshold table compiled into one projection.

Measures are counts and ratios over the words and lines of the whole text;
the table names a measure, the side on which it fails and the bound.  All is
built-in functions: no user functions, no shuffle.

Defined results: null and empty texts have 0 for every measure and fail the
base rule; repeated rows are measured each; an empty table gives no rows;
other columns are passed on by ``quality_rules`` and ignored by the query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import WS, documents, free_name, let, strip_ws, whole_text, words

#: Frequent words of the languages read, in lower case.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne se pas il ce avec sont".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más pero sus le".split(),
}
#: Marks that may follow a word directly.
CLOSING_MARKS = ".,;:!?"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    measure: str
    fails: str  # "below" or "above"
    bound: float


#: The threshold table of the method's verdict.
RULES = [
    Rule("mean_word_length_low", "mean_word_chars", "below", 2.0),
    Rule("mean_word_length_high", "mean_word_chars", "above", 20.0),
    Rule("too_many_symbols", "symbol_ratio", "above", 0.1),
    Rule("too_few_stop_words", "stop_ratio", "below", 0.02),
    Rule("repeated_lines", "dup_line_ratio", "above", 0.3),
]
#: A text with fewer words fails the base rule.
MIN_WORDS = 10
#: Percent of the words in repeated 5-word windows above which a text fails the base rule.
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def repeat_words(found: Column, n: int = WINDOW) -> Column:
    """Words in windows of n words that the text has twice or more."""
    hashes = F.when(F.size(found) >= n, F.transform(F.sequence(F.lit(0), F.size(found) - n),
                                                    lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(n)])))

    def starts(p: Column) -> Column:
        twice = F.filter(p, lambda x, j: F.get(p, j - 1)["h"].eqNullSafe(x["h"]) | F.get(p, j + 1)["h"].eqNullSafe(x["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(n), F.get(p, j + 1) - x), F.lit(n)).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(ordered, starts), covered))

    return F.coalesce(let(hashes, count), F.lit(0).cast("long"))


def measures(text: Column, found: Column, lines: Column) -> dict[str, Column]:
    """The measures; ``found`` are the text's words, ``lines`` its lines with a word."""

    def without(chars: str) -> Column:
        return F.char_length(F.translate(text, chars, "")).cast("long")

    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return {
        "n_words": F.size(found).cast("long"),
        "word_chars": without(WS),
        "n_symbols": F.char_length(text).cast("long") - without(SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeat_words(found),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(found, lambda w: F.rtrim(w, F.lit(CLOSING_MARKS)).isin(stop))).cast("long"),
    }


def compiled(m: dict[str, Column], rules: list[Rule]) -> Column:
    """The threshold table as one expression: the names of the failed rules."""
    n_words, n_lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    ratios = m | {
        "mean_word_chars": m["word_chars"] / n_words,
        "symbol_ratio": m["n_symbols"] / n_words,
        "stop_ratio": m["n_stop_words"] / n_words,
        "dup_line_ratio": m["n_dup_lines"] / n_lines,
    }
    fails = {"below": lambda x, bound: x < bound, "above": lambda x, bound: x > bound}
    return F.array_compact(F.array(*[F.when(fails[r.fails](ratios[r.measure], r.bound), F.lit(r.name)) for r in rules]))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The input's columns and a struct ``quality`` (``quality_`` if the input has one): measures, base_failed, failed_rules, kept."""
    text, name = whole_text(), free_name(docs.columns, "quality")
    cut = docs.withColumns({"_op_words": words(text),
                            "_op_lines": F.filter(F.split(text, "\n"), lambda x: strip_ws(x) != "")})
    by = measures(text, F.col("_op_words"), F.col("_op_lines"))
    counted = cut.withColumns({f"_op_{k}": c for k, c in by.items()})
    m = {k: F.col(f"_op_{k}") for k in by}
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
    failed = compiled(m, RULES if rules is None else rules)
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(
        *[c.alias(k) for k, c in m.items()], base.alias("base_failed"), failed.alias("failed_rules"),
        (~base & (F.size(failed) == 0)).alias("kept")).alias(name))


def oracle() -> str:
    """DuckDB SQL of the query."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    sides = {"below": "<", "above": ">"}
    ratio = {"mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)",
             "stop_ratio": "n_stop_words / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    failed = ", ".join(f"CASE WHEN {ratio.get(r.measure, r.measure)} {sides[r.fails]} {r.bound} THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
grams AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
                 || ' ' || lead(word, 4) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(list_filter(w, lambda x: rtrim(x, '{CLOSING_MARKS}') IN ({stop}))) AS BIGINT) AS n_stop_words
      FROM d LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM j"""


@register("op2_quality_rules", oracle())
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{x}" for x in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")],
        F.array_join("quality.failed_rules", ",").alias("failed_rules"))
