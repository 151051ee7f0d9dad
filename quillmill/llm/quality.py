"""Quality rules with risk-controlled thresholds (operator 9); DataFrame functions only.

Cutoffs are certified jointly, by a fixed sequence of cutoff vectors per stratum: the rules are
tightened by one cutoff at a time, in turn, from the laxest on. A vector is certified if the
share of good documents that any of its rules rejects is shown to be under ``ALPHA``: the exact
binomial probability of seeing so few false rejections among the labelled good documents, were
the share at the limit, must not exceed ``DELTA`` divided by the strata (Bonferroni). The
sequence stops at the first failure, which needs no further correction. The last certified
vector holds; a rule that it has not reached rejects nothing in that stratum. With probability
1 - ``DELTA``, all rules together falsely reject at most ``ALPHA`` in every stratum.

A stratum needs ln(``DELTA`` / strata) / ln(1 - ``ALPHA``) good documents for any cutoff: 436 of four strata.

The grids are fixed in advance, so that all labelled rows serve as holdout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm.common import ASCII_SPACE, materialize

ALPHA, DELTA = 0.01, 0.05
SYMBOLS = "#*$%&|<>"
#: Rule -> (value, cutoffs from lax to strict); a document over the cutoff is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    "repeats": ("n_repeat_words / n_words", (0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines / n_words", (0.2, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "long_words": ("word_chars / n_words", (16, 14, 12, 10, 9, 8.5, 8)),
    "short_words": ("-word_chars / n_words", (-1.5, -2, -2.5, -3, -3.5, -4)),
}


def with_measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text counts as empty.

    Repeated windows are found within a document by sorting 64-bit hashes of its 3-word
    windows, so no row leaves its task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    space = F.lit(ASCII_SPACE)
    nothing = F.array().cast("array<string>")
    trimmed = F.trim(text, space)
    words = F.when(trimmed == "", nothing).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, space) != "")
    measured = df.select(
        "*",
        F.translate(text, ASCII_SPACE, "").alias("_solid"),
        words.alias("_words"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    word = F.col("_words")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2])))
    measured = measured.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_solid") - F.length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    ).drop("_solid", "_words", "_lines")
    some_again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    measured = measured.withColumn("_placed", F.when(some_again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    placed = F.col("_placed")

    def beside(x: Column, k: Column) -> Column:
        """The hash before or after it is the same."""
        return F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False))

    measured = measured.withColumn("_starts", F.sort_array(F.transform(F.filter(placed, beside), lambda x: x["i"]))).drop("_placed")
    return measured.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_starts")), F.lit(0)).cast("long")).drop("_starts")


def _covered(starts: Column) -> Column:
    """Words in windows of three words that begin at these places, in order; null for none."""
    first = F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last"))
    return F.aggregate(starts, first, lambda acc, i: F.struct((acc["words"] + F.least(i - acc["last"], F.lit(3))).alias("words"), i.alias("last")), lambda acc: acc["words"])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), summed term by term in logarithms; 1 where k is over the mean."""
    log = F.ln
    odds = log(F.lit(p)) - log(F.lit(1 - p))
    start = n * log(F.lit(1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc.term + log((n - i + 1) / i) + odds
        high, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(start.alias("term"), start.alias("total")), step, lambda acc: F.exp(acc.total))
    return F.when(k > n * p, 1.0).otherwise(total)


#: The sequence: (rule, cutoff) that each vector tightens over the one before.
SEQUENCE: list[tuple[str, float]] = [(rule, float(cutoffs[step])) for step in range(max(len(c) for _, c in RULES.values())) for rule, (_, cutoffs) in RULES.items() if step < len(cutoffs)]


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoffs, from measures of labelled good documents.

    ``labelled`` has stratum and the measures, a row per good document that the base rules keep.
    """
    never = len(SEQUENCE)
    first = F.least(*[F.when(F.expr(RULES[rule][0]) > F.lit(cutoff), step).otherwise(never) for step, (rule, cutoff) in enumerate(SEQUENCE)])  # the first vector that rejects it
    stops = labelled.select("stratum", first.alias("stop")).groupBy("stratum", "stop").agg(F.count("*").alias("m"))
    steps = F.struct(*[F.sum(F.when(F.col("stop") <= step, F.col("m")).otherwise(0)).alias(f"k{step}") for step in range(never)])
    counts = stops.groupBy("stratum").agg(F.sum("m").alias("n"), steps.alias("k"))
    strata = F.count("*").over(Window.partitionBy(F.lit(0)))  # over the few counts
    vectors = [F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"k.k{step}").alias("k")) for step, (rule, cutoff) in enumerate(SEQUENCE)]
    tested = counts.withColumn("limit", F.lit(delta) / strata).select("stratum", "n", "limit", F.inline(F.array(*vectors))).withColumn("p", binomial_cdf(F.col("k"), F.col("n"), alpha))
    order = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("passed", F.min((F.col("p") <= F.col("limit")).cast("int")).over(order)).filter("passed = 1")
    return passed.groupBy("stratum", "rule").agg(F.min_by("cutoff", -F.col("step")).alias("cutoff"))


def active_cutoffs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n_good, n_active) of each stratum of ``docs``: good labels that count, and rules with a certified cutoff."""
    measures = _measured(docs, id_col, text_col, stratum_col)
    good = _good(measures, labels, id_col)
    active = certified_cutoffs(good, alpha, delta).groupBy("stratum").agg(F.count("*").alias("n_active"))
    counted = measures.select("stratum").distinct().join(good.groupBy("stratum").agg(F.count("*").alias("n_good")), "stratum", "left").join(active, "stratum", "left")
    stratum = F.when(F.col("stratum") != "", F.substring(F.col("stratum"), F.lit(2), F.length("stratum"))).alias("stratum")
    return counted.select(stratum, F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_active", F.lit(0)).alias("n_active"))


def _measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """Strata are named by ``=`` and what they are, so that the null one is apart from the empty one."""
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col)), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return materialize(with_measures(narrow).drop("text").withColumn("base_failed", base_failed()), "quality")


def _good(measures: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    good = labels.filter("quality = 1").select(F.col(id_col).alias("id")).distinct()
    return measures.filter(~F.col("base_failed")).join(good, "id")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(id, measures, base_failed, kept) of each row of ``docs``; ``labels`` has the id and quality 0 or 1.

    An id labelled twice counts as good if any label says so; null labels are none. Rows that
    repeat an id are judged each. A null stratum is one of its own. Without labels the base
    rules alone decide.
    """
    measures = _measured(docs, id_col, text_col, stratum_col)
    cutoffs = certified_cutoffs(_good(measures, labels, id_col), alpha, delta)
    by_stratum = materialize(cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")), "quality-cutoffs")
    joined = measures.join(by_stratum, "stratum", "left")
    over = F.lit(False)
    for rule, (value, _) in RULES.items():
        over = over | F.coalesce(F.expr(value) > F.col(rule), F.lit(False))
    kept = F.when(F.col("base_failed"), False).otherwise(~over)
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
