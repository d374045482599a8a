"""Quality rules whose cutoffs are chosen under risk control (native).

A rule rejects a document when a ratio exceeds a cutoff. The cutoffs come from labelled documents: for each stratum and
rule the strictest cutoff of a grid is taken whose false rejection rate (the share of good documents that it rejects) is
shown to be at most ``alpha`` by an exact binomial test, with the error probability ``risk`` divided over all strata and
rules (Bonferroni). Along a grid the tests go from the loosest cutoff to the strictest and stop at the first that fails,
so no further correction is needed within it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, durable, set_aside, small, table

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 0.5
GRID = 20
#: Ratio and the loosest cutoff of its grid.
RULES = {"symbols": ("n_symbols", "word_chars", 0.5), "dup_lines": ("n_dup_lines", "n_lines", 1.0), "repeats": ("n_repeat_words", "n_words", 0.5)}
#: Bound of the false rejection rate of all rules together in a stratum, and of the probability that any bound fails.
ALPHA, RISK = 0.05, 0.1
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with MEASURES and ``base_failed`` of each whole text; null counts as a text without words.

    n_repeat_words is the number of words that lie in a window of three words which occurs at least twice in the text:
    windows are hashed, and only texts with an equal pair are sorted.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE_CHARS))
    df = df.withColumns(
        {
            "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+")),
            "_lines": F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
            "_marks": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        }
    )
    n = F.size("_words")
    df = df.withColumns(
        {
            "_windows": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>")),
            "_n_lines": F.size("_lines"),
            "_dup": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "_n_words": n,
            "_chars": F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)),
        }
    )
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ranked", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked))
    again = F.filter("_ranked", lambda x, i: F.coalesce(x["h"] == F.get("_ranked", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_ranked", i + 1)["h"], F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    measured = {"n_words": F.col("_n_words"), "word_chars": F.col("_chars"), "n_symbols": F.col("_marks"), "n_dup_lines": F.col("_dup"), "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.col("_n_lines")}
    # one struct, exploded: a filter on a measure is not carried down through it, which would repeat all that stands above
    df = df.withColumn("_measured", F.explode(F.array(F.struct(*[c.cast("long").alias(name) for name, c in measured.items()]))))
    df = df.drop("_words", "_lines", "_marks", "_windows", "_n_lines", "_dup", "_n_words", "_chars", "_ranked", "_places", *MEASURES)
    df = df.select(*[c for c in df.columns if c != "_measured"], "_measured.*")
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def ratio(rule: str) -> Column:
    part, whole, _ = RULES[rule]
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def cutoffs(rule: str, grid: int = GRID) -> list[float]:
    """From the loosest to the strictest."""
    return [RULES[rule][2] * (grid - j) / grid for j in range(grid)]


def cutoffs_below(rule: str, grid: int) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cutoffs(rule, grid))), lambda c: ratio(rule) > c))


def stratum_key(column: Column) -> Column:
    return F.concat(F.when(column.isNull(), "1").otherwise("0"), F.coalesce(column.cast("string"), F.lit("")))


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1 by Stirling's series at x + 10."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = F.log(x)
    for k in range(1, 10):
        shift = shift + F.log(x + k)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of the binomial distribution (n, p), 1 where k >= n * p (its value there plays no part in a test).

    Below the mean the terms fall from k downwards; the sum stops after as many terms as can count in double precision,
    so its cost grows with the root of n at most.
    """
    first = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        i = k - j + 1
        term = acc["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(first) * F.aggregate(steps, start, step, lambda a: a["sum"]))


def calibrate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, risk: float = RISK, grid: int = GRID) -> DataFrame:
    """(_stratum, rule, cutoff) from all documents that are labelled good (quality 1 in every label row of theirs).

    Documents that fail the base rules are rejected anyway and do not count. A stratum and rule for which no cutoff can
    be shown to be safe has none, and never rejects. Null strata form one of their own. Labels of null keys and label rows
    with a null quality do not count; repeated rows of a document count each.
    """
    good = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("quality")).filter("quality = 1").select(key)
    good = durable(good)
    near = small(good)
    held = docs.select(key, F.col(text).alias("_text"), stratum_key(F.col(stratum)).alias("_stratum"))
    # labels that are too many to be sent to every task meet the measures of all documents, so that texts never move
    held = with_measures(held.join(near, key, "left_semi"), "_text") if near is not good else with_measures(held, "_text").drop("_text").join(good, key, "left_semi")
    held = held.filter(~F.col("base_failed"))
    level = [F.struct(F.lit(r).alias("rule"), cutoffs_below(r, grid).alias("above")) for r in RULES]
    counts = durable(held.select("_stratum", F.explode(F.array(*level)).alias("x")).groupBy("_stratum", "x.rule", "x.above").agg(F.count(F.lit(1)).alias("n")))
    tests = counts.select("_stratum").distinct().count() * len(RULES)
    steps = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).groupBy("_stratum", "rule", "j")
    steps = steps.agg(F.sum("n").cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("above") >= grid - F.col("j"), F.col("n"))), F.lit(0)).cast("double").alias("k"))
    safe = steps.filter(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= risk / max(1, tests))
    lists = F.create_map(*[x for r in RULES for x in (F.lit(r), F.array(*map(F.lit, cutoffs(r, grid))))])
    return safe.groupBy("_stratum", "rule").agg(F.max("j").alias("j")).select("_stratum", "rule", F.get(lists[F.col("rule")], F.col("j")).alias("cutoff"))


def judge(docs: DataFrame, chosen: DataFrame, text: str = "text", stratum: str = "lang") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``, which replace columns of these names; all others stay as they came.

    Null and empty texts have no words and fail the base rules; texts of any length are measured whole; rows alike are judged alike.
    """
    wide = durable(chosen.groupBy("_stratum").pivot("rule", list(RULES)).agg(F.max("cutoff")).withColumnsRenamed({r: f"_cut_{r}" for r in RULES}))
    docs, names, back = set_aside(docs)
    text, stratum = names.get(text, text), names.get(stratum, stratum)
    rows = with_measures(docs, text).withColumn("_stratum", stratum_key(F.col(stratum))).join(small(wide), "_stratum", "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(ratio(r) > F.col(f"_cut_{r}"), F.lit(False))
    return back(rows.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"_cut_{r}" for r in RULES]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they came (whatever their names)."""
    chosen = calibrate(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    return judge(rows, chosen, "_text", "_lang").filter("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document. Null and empty texts have no words and fail the base rule."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "text", "lang")
    return judge(rows, calibrate(rows, labels)).select("doc_id", *MEASURES[:5], "base_failed", "kept")


def _sql() -> str:
    grids = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest(range({GRID}))::DOUBLE AS j, unnest({cutoffs(r)}::DOUBLE[]) AS cut" for r in RULES)
    ratios = " UNION ALL ".join(f"SELECT r, stratum, base_failed, doc_id, '{k}' AS rule, coalesce({a}::DOUBLE / nullif({b}, 0), 0) AS ratio FROM m" for k, (a, b, _) in RULES.items())
    p = ALPHA / len(RULES)
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IS NULL THEN '1' ELSE '0' END || coalesce(lang, '') AS stratum,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
    SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
           len(w) < {LEAST_WORDS} OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
    FROM d LEFT JOIN line_counts USING (r) LEFT JOIN covered USING (r)
), ratios AS ({ratios}), grid AS ({grids}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (
    SELECT stratum, rule, j, any_value(cut) AS cut, count(*)::DOUBLE AS n, sum(CASE WHEN ratio > cut THEN 1 ELSE 0 END)::DOUBLE AS k
    FROM ratios JOIN good USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY stratum, rule, j
), tails AS (
    SELECT *, CASE WHEN k >= n * {p} THEN 1 ELSE list_sum(list_transform(range(k::BIGINT + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::DOUBLE) + (n - i) * ln(1 - {p}::DOUBLE)))) END AS tail
    FROM counts
), chosen AS (
    SELECT stratum, rule, arg_max(cut, j) AS cut FROM tails
    WHERE tail <= {RISK} / ({len(RULES)} * (SELECT count(DISTINCT stratum) FROM counts)) GROUP BY stratum, rule
), bad AS (SELECT DISTINCT r FROM ratios JOIN chosen USING (stratum, rule) WHERE ratio > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM m LEFT JOIN bad USING (r)
"""


OP8_SQL = _sql()
