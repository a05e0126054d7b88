"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule rejects a document whose ratio is above a cutoff.  For a stratum and a rule the
cutoffs of a fixed grid are tested from the most lenient on: the hypothesis "more than
``risk / rules`` of the good documents are rejected" is refuted at level
``level / (strata * rules)`` by the exact binomial tail of the rejections among the good
labelled documents.  The tests of a rule stop at the first cutoff that is not refuted (a
fixed sequence needs no further correction), and Bonferroni covers strata and rules.  With
probability ``1 - level`` no stratum loses more than ``risk`` of its good documents to
all rules together.  All certified cutoffs hold at once, so any of them may be taken: the
one that rejects most bad labelled documents beyond the good ones, the most lenient of
equal ones.  A rule without a certified cutoff that does so rejects nothing in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import SPACE, quoted
from glossa.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STRATA = ("de", "en", "es", "fr")
OTHER = "other"
RISK = 0.08
LEVEL = 0.1
#: Rule: (numerator, denominator, cutoffs per thousand from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "word_chars", (400, 300, 250, 200, 150, 120, 100, 80, 70, 60, 50, 40, 30, 20)),
    "lines": ("n_dup_lines", "n_words", (200, 150, 100, 80, 60, 50, 40, 30, 25, 20, 15, 10, 8, 5)),
    "repeats": ("n_repeat_words", "n_words", (180, 160, 140, 120, 100, 90, 80, 70, 60, 50, 40, 30, 20, 10)),
    "capitals": ("n_capitals", "word_chars", (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60)),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, "")).cast("long")


#: Words of 5-word windows that occur twice or more: windows are compared by a 64-bit hash
#: within one text; equal neighbours in hash order are repeated, and their word ranges are
#: merged in order of position.
REPEATED = """
CASE WHEN size(hashes) > size(array_distinct(hashes)) THEN
  aggregate(
    array_sort(transform(
      transform(
        array(array_sort(transform(hashes, (x, i) -> struct(x AS h, i AS i)))),
        s -> filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) OR coalesce(x.h = get(s, i + 1).h, false))
      )[0],
      x -> x.i)),
    struct(0L AS upto, 0L AS total),
    (a, p) -> struct(p + 5L AS upto, a.total + p + 5L - greatest(a.upto, CAST(p AS BIGINT)) AS total),
    a -> a.total)
ELSE 0L END
"""


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, base_failed."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    stratum = quoted(stratum_col)
    worded = docs.select(
        quoted(id_col).alias("doc_id"),
        F.when(stratum.isin(*STRATA), stratum).otherwise(OTHER).alias("stratum"),
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("lines"),
    ).withColumn(
        "hashes",
        F.when(
            F.size("words") >= 5,
            F.expr("transform(sequence(1, size(words) - 4), i -> xxhash64(slice(words, i, 5)))"),
        ).otherwise(F.expr("CAST(array() AS array<bigint>)")),
    )
    counted = worded.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        _without(F.col("text"), SPACES).alias("word_chars"),
        (F.length("text").cast("long") - _without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
        (F.length("text").cast("long") - _without(F.col("text"), CAPITALS)).alias("n_capitals"),
    )
    return counted.withColumn(
        "base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly: the terms are summed in logarithms."""
    step = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + step
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda state: state["total"])


def certified_cutoffs(held: DataFrame, risk: float = RISK, level: float = LEVEL, rules: dict = RULES) -> DataFrame:
    """(stratum, rule, cutoff) from the features of labelled documents (``good`` or not); only certified rules have a row.

    ``held`` is aggregated to one row per stratum (at most five), the rest works on those.
    """
    above = lambda num, den, cut, good: F.count_if((F.col(num) * 1000 > F.col(den) * cut) & (F.col("good") == good))
    tests = [(rule, step, cut, num, den) for rule, (num, den, cuts) in rules.items() for step, cut in enumerate(cuts)]
    counts = held.groupBy("stratum").agg(
        F.count_if("good").alias("n"),
        *[above(num, den, cut, True).alias(f"{rule}_{step}") for rule, step, cut, num, den in tests],
        *[above(num, den, cut, False).alias(f"bad_{rule}_{step}") for rule, step, cut, num, den in tests],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(step).alias("step"),
                F.lit(cut).alias("cutoff"),
                F.col(f"{rule}_{step}").alias("k"),
                (F.col(f"bad_{rule}_{step}") - F.col(f"{rule}_{step}")).alias("gain"),
            )
            for rule, step, cut, _, _ in tests
        ]
    )
    share = risk / len(rules)
    # k at or above its expectation cannot refute anything, so the long sum is left out.
    p_value = F.when(F.col("k") < F.col("n") * share, binomial_tail(F.col("k"), F.col("n"), share)).otherwise(1.0)
    tested = (
        counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
        .withColumn("tests", rows)
        .select("stratum", "n", "strata", F.explode("tests").alias("t"))
        .select("stratum", "n", "strata", "t.*")
        .withColumn("passed", p_value * F.col("strata") * len(rules) <= level)
    )
    order = Window.partitionBy("stratum", "rule").orderBy("step")
    return (
        tested.withColumn("all_passed", F.min("passed").over(order))
        .filter("all_passed and gain > 0")
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = RISK,
    level: float = LEVEL,
    rules: dict = RULES,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rejected_by (rules that rejected, sorted, comma-joined).

    ``labels`` has doc_id and quality (1: good, 0: bad).  Labelled documents that pass the base
    rule are the holdout; ids with contradicting labels and null labels are ignored.
    Languages that are null or not in ``STRATA`` share one stratum.  Null texts have no
    words and fail the base rule.  Repeated rows each count.  Other columns are ignored; without
    labels nothing is certified and the base rule alone decides.
    """
    rows = cut_lineage(features(docs, id_col, text_col, stratum_col))
    known = (
        labels.filter("quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
        .filter("least = most")
        .select("doc_id", (F.col("least") == 1).alias("good"))
    )
    cutoffs = certified_cutoffs(rows.filter("not base_failed").join(known, "doc_id"), risk, level, rules)
    by_stratum = cutoffs.groupBy("stratum").pivot("rule", list(rules)).agg(F.min("cutoff"))
    # At most len(STRATA) + 1 rows.
    judged = rows.join(F.broadcast(by_stratum), "stratum", "left")
    hit = lambda rule, num, den: F.coalesce(F.col(num) * 1000 > F.col(den) * F.col(rule), F.lit(False))
    hits = F.array_compact(
        F.array(*[F.when(hit(rule, num, den), F.lit(rule)) for rule, (num, den, _) in sorted(rules.items())])
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(hits) == 0)).alias("kept"),
        F.array_join(hits, ",").alias("rejected_by"),
    )
