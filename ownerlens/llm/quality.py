"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured once. Failures of the base rules are counted per host, the
hosts' rates are shrunk towards a beta prior that is fitted to the hosts
themselves, and the verdict of a host is joined back to its documents.

Defined cases: a null text counts as the empty text (no words, base rules failed);
a document without a source belongs to no host and is judged by the base rules
alone; repeated rows are judged each; extra columns are ignored; an empty table
gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ownerlens.session import materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is refused when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Strength of the prior where the hosts differ by no more than chance.
POOLED = 1e6


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the sorted ``starts``, each word once."""
    n = F.size(starts)
    steps = F.zip_with(F.slice(starts, 1, n - 1), F.slice(starts, 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(WINDOW)).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """``keep`` columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts in
    which some hash repeats have their windows sorted.
    """
    t = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = t.select(*keep, "_t", F.array_remove(F.split("_t", SPACE, -1), "").alias("_w"), F.split("_t", "\n", -1).alias("_l"))
    t = t.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter("_l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))
    t = t.select(
        *keep, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_x"),
    )
    repeats = F.size(F.array_distinct("_x")) < F.size("_x")
    t = t.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(repeats, F.array_sort(F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"),
    )
    n = F.size("_s")
    twin = F.filter(
        F.col("_s"),
        lambda s, k: ((k > 0) & (F.get("_s", k - 1)["x"] == s["x"])) | ((k < n - 1) & (F.get("_s", k + 1)["x"] == s["x"])),
    )
    t = t.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_s").isNotNull(), F.array_sort(F.transform(twin, lambda s: s["i"]))).alias("_p"),
    )
    t = t.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_p").isNull(), F.lit(0)).otherwise(_covered(F.col("_p"))).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return t.withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """Per source: documents, failures and the failure rate shrunk by an empirical beta prior.

    The prior has the hosts' mean rate; its strength follows from the variance of
    the rates beyond what their sizes explain (method of moments).
    """
    hosts = measured.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv"))
    beyond = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv")
    strength = F.when(beyond > 0, F.greatest(F.lit(1.0), F.least(F.lit(POOLED), F.col("m") * (1 - F.col("m")) / beyond - 1))).otherwise(F.lit(POOLED))
    one = prior.select("m", strength.alias("k")).first()
    mean, k = (one["m"] or 0.0), (one["k"] or POOLED)
    shrunk = (F.col("host_failed") + F.lit(mean * k)) / (F.col("host_docs") + F.lit(k))
    return hosts.withColumn("host_rate", F.round(shrunk, 6))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, the base verdict and ``kept``.

    The measures are written once, so the texts are read once for both the host
    counts and the verdicts. The host side of the join holds one row per host.
    """
    measured = materialise(measure(docs), "quality-measures")
    hosts = host_rates(measured).select("source", "host_rate")
    out = measured.join(hosts, "source", "left")
    kept = ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= MAX_HOST_RATE)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "source", "host_rate")
