"""Filter interaction audit (12): Hart-Mas-Colell potentials over the 32 coalitions of five filters.

Each document becomes one pattern, the set of filters that it fails; counts by
part and pattern are all that the rest needs (at most 32 rows a part).  The
removal game of a part is v(S), the documents that fail some filter of the
coalition S.  Its potential is P({}) = 0 and P(S) = (v(S) + sum of P(S without i)
over i in S) / |S|; the Shapley value of i is P(all) - P(all without i).  Here
Q(S) = |S|! P(S) is kept, which is whole: Q(S) = (|S| - 1)! v(S) + sum of
Q(S without i), so that n! times a Shapley value is Q(all) - n Q(all without i),
the filter's removals summed over all n! orders.  A step of an order is a
difference of two coalitions.

Defined results: a null text counts as empty, a null lang as the empty part;
every row of the table is a document, also where doc_ids repeat; filter E
compares with the smallest non-null doc_id of the same text, so rows of that id
and rows without an id do not fail it; several labels of one doc_id count as
good or toxic if one of them is; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm.catalog import register
from jobsift.llm.common import documents, let, whole_text, words

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (few words), B (few distinct words), C (many capitals), D (a symbol)."""
    few = let(words(text), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(
        100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text) * F.lit(MAX_UPPER_PERCENT).cast("long")
    return few + F.when(capitals, 4).otherwise(0) + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def marked_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Thin rows with a count: id, part, digest of the text, own failures, good, toxic, n.

    Rows that agree in all of it are counted together before they meet the labels.
    """
    text = whole_text()
    thin = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    rows = thin.groupBy("id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                                             F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) == 1 for c in ("good", "toxic")})


def patterns(marked: DataFrame) -> DataFrame:
    """Counts ``n`` by part, pattern (bits of the filters failed, A lowest), good and toxic.

    Filter E needs the least id of each text.  The rows of one text are first
    counted by part, own failures and label, with the least id of each such
    group and its rows, so that however many copies a text has, only these few
    groups of it meet.
    """
    key = ["digest", "part", "own", "good", "toxic"]
    by_id = marked.groupBy(*key, "id").agg(F.sum("n").alias("n"))
    with_id = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = by_id.groupBy(*key).agg(F.sum("n").alias("n"), F.min(with_id).alias("least"),
                                     F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    spared = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    halves = F.array(F.struct(F.col("own").alias("pattern"), F.col("spared").alias("n")),
                     F.struct((F.col("own") + 16).alias("pattern"), (F.col("n") - F.col("spared")).alias("n")))
    return (groups.withColumn("spared", spared).select("part", "good", "toxic", F.explode(halves).alias("half"))
            .groupBy("part", "good", "toxic", F.col("half.pattern").alias("pattern")).agg(F.sum("half.n").alias("n")).where("n > 0"))


def games(counts: DataFrame, filters: int = 5) -> DataFrame:
    """A row per part: total, and the games v, v_good, v_toxic as arrays indexed by the coalition's bits."""
    everyone = (1 << filters) - 1
    hit = F.expr(f"filter(sequence(0, {everyone}), s -> s = 0 OR (s & pattern) <> 0)")
    # coalition 0 removes nothing; its row carries the part's total
    removed = counts.select("part", "n", "good", "toxic", F.explode(hit).alias("s")).groupBy("part", "s").agg(
        F.sum("n").alias("v"), *[F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(f"v_{m}") for m in ("good", "toxic")])
    by_s = removed.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("v", "v_good", "v_toxic")))).alias("m"))

    def game(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(everyone)), lambda s: F.when(s == 0, F.lit(0)).otherwise(
            F.coalesce(F.try_element_at(F.col("m"), s)[name], F.lit(0))).cast("long"))

    return by_s.select("part", F.try_element_at(F.col("m"), F.lit(0))["v"].alias("total"),
                       *[game(c).alias(c) for c in ("v", "v_good", "v_toxic")])


def potentials(v: Column, filters: int = 5) -> Column:
    """Q(S) = |S|! P(S) for each coalition, from the game ``v``; a smaller coalition has a smaller number, so one pass fills them."""
    fact = F.array(*[F.lit(factorial(max(0, k - 1))).cast("long") for k in range(filters + 1)])

    def following(acc: Column, s: Column) -> Column:
        members = F.filter(F.sequence(F.lit(0), F.lit(filters - 1)), lambda i: F.getbit(s, i) == 1)
        below = F.aggregate(members, F.lit(0).cast("long"), lambda total, i: total + F.get(acc, s - F.get(F.array(
            *[F.lit(1 << b) for b in range(filters)]), i)))
        return F.array_append(acc, F.get(fact, F.bit_count(s)) * F.get(v, s) + below)

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), following)


def orders(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """Every order and step: (order, step, coalition before it, the step's filter as a bit)."""
    return [("".join(o), k + 1, sum(1 << letters.index(x) for x in o[:k]), 1 << letters.index(o[k]))
            for o in permutations(letters) for k in range(len(letters))]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From pattern counts, a row per part, order of the filters and step, zeros included."""
    n = len(letters)
    everyone = (1 << n) - 1
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(s).alias("s"), F.lit(b).alias("bit"))
                      for o, k, s, b in orders(letters)])
    with_q = games(counts, n).withColumn("q", potentials(F.col("v"), n))
    rows = with_q.select("*", F.explode(steps).alias("at")).select("*", "at.*")
    s, bit = F.col("s"), F.col("bit")

    def step(game: str) -> Column:
        return F.get(game, s + bit) - F.get(game, s)

    def of_all(name: str) -> Column:
        return F.get(name, F.lit(everyone))

    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("v", s + bit)).alias("kept"), step("v").alias("removed"),
        (F.get("v", bit) - step("v")).alias("redundant"), (of_all("v") - F.get("v", F.lit(everyone) - bit)).alias("unique_fails"),
        step("v_good").alias("good_lost"), step("v_toxic").alias("toxic_lost"),
        (of_all("q") - n * F.get("q", F.lit(everyone) - bit)).alias("shapley"))


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CAST(len(words) < 200 AS INT) AS A, CAST(100 * list_unique(words) < 50 * len(words) AS INT) AS B,
             CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) AS C,
             CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS D, CAST(w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS INT) AS E
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, A || '' || B || C || D || E AS bits, A + B + C + D + E AS fails, count(*) AS n FROM f GROUP BY ALL),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS letter FROM o, range(1, 6) r(k)),
hit AS (SELECT c.*, s.*, substr(bits, ascii(letter) - 64, 1) = '1' AS fail,
               list_sum([CAST(substr(bits, ascii(substr(filter_order, j, 1)) - 64, 1) AS INT) FOR j IN range(1, step)]) AS before
        FROM c, s),
m AS (SELECT part, filter_order, step, letter, sum(n) AS total,
             sum(n) FILTER (WHERE coalesce(before, 0) = 0 AND NOT fail) AS kept, sum(n) FILTER (WHERE coalesce(before, 0) = 0 AND fail) AS removed,
             sum(n) FILTER (WHERE before > 0 AND fail) AS redundant, sum(n) FILTER (WHERE fails = 1 AND fail) AS unique_fails,
             sum(n) FILTER (WHERE coalesce(before, 0) = 0 AND fail AND good = 1) AS good_lost,
             sum(n) FILTER (WHERE coalesce(before, 0) = 0 AND fail AND toxic = 1) AS toxic_lost
      FROM hit GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM m"""


@register("op12_filter_audit", ORACLE)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(patterns(marked_rows(documents(spark, sf_dir), labels)))
