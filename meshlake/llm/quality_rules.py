"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each metric is a count in so many words or lines. Its rate is summed up per language and source in a quantile
sketch: a count per bucket, where buckets are exact below 64 and then 64 to each power of two, so a quantile is off by
at most 1/32 of itself. Sketches merge by adding counts, from language and source to language to all.

Thresholds. Of each sketch the median and tail quantiles are taken. Those of a source are drawn towards those of
its language, and these towards those of all documents, as if ``PRIOR`` documents more had the parent's, so small groups
lean on their parents and large ones on themselves. A fence lies ``REACH`` times the way from the median to the tail
quantile; no fixed cutoff is added. A document fails where its count is beyond what the rate at the fence explains by more
than ``NOISE`` standard deviations of a count, so short texts aren't judged by a single word. Fences are joined back
to the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_BREAKS, Scratch, text_of

#: Documents that the parent's quantiles count for; how far beyond the median a fence lies; deviations allowed.
PRIOR, REACH, NOISE = 20, 3, 3
#: (metric, what is counted, in what, scale of the rate, percent of documents below the tail quantile, whether there is a lower fence too)
METRICS = (
    ("symbol_rate", "n_symbols", "n_words", 1000, 90, False),
    ("dup_line_rate", "n_dup_lines", "n_lines", 1000, 95, False),
    ("word_length", "word_chars", "n_words", 100, 90, True),
)


def text_metrics(docs: DataFrame) -> DataFrame:
    """The row's ``doc_id, lang, source`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words``.

    Null and empty texts have zeros. ``n_repeat_words`` hashes each window of five words; only where
    hashes repeat are windows themselves sorted, with their places, so that equal ones are neighbours."""
    d = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", WORD_BREAKS), "").alias("w"),
        (F.size(F.split("text", r"[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.size("w")
    w = F.col("w")
    d = d.select(
        "doc_id", "lang", "source", "w", "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 6, F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).alias("g"),
    )
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    # texts without a repeated hash go no further
    window = F.when(repeats, F.transform("g", lambda g, i: F.struct(g.alias("h"), F.array_join(F.slice("w", i + 1, F.lit(5)), " ").alias("t"), i.cast("long").alias("i"))))
    d = d.select(*keep, F.sort_array(window).alias("s"))
    s = F.col("s")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["t"] == y["t"]), F.lit(False))

    d = d.select(*keep, F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    starts = F.sort_array("hit")
    covered = F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end")))
    return d.select(*keep, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def with_rates(metrics: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rates = [F.expr(f"case when {base} > 0 then ({scale} * {count}) div {base} else 0 end").cast("long").alias(m) for m, count, base, scale, _, _ in METRICS]
    return metrics.select("*", failed.alias("base_failed"), *rates)


def bucket_floor(v: str) -> Column:
    """The least value of the sketch bucket that holds v."""
    return F.expr(f"case when {v} < 64 then {v} else shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) end")


def sketch(rated: DataFrame) -> DataFrame:
    """``lang, source, metric, bucket, n`` over documents that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket_floor(m).alias("bucket")) for m, *_ in METRICS])).alias("x")
    return rated.where(~F.col("base_failed")).select("lang", "source", pairs).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, docs, mid, low, high`` of the sketches merged by keys."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "metric")  # at most a few thousand buckets
    c = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("docs"))
    tail = F.lit(None).cast("int")
    for m, _, _, _, percent, _ in METRICS:
        tail = F.when(F.col("metric") == m, percent).otherwise(tail)

    def at(percent: Column) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("docs"), F.col("bucket")))

    return c.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(F.lit(50)).alias("mid"), at(100 - tail).alias("low"), at(tail).alias("high"))


def _drawn(own: DataFrame, parent: DataFrame) -> DataFrame:
    """``own`` with its quantiles drawn towards those of ``parent``, joined as ``p_mid`` and so on."""
    cols = [F.expr(f"(docs * {q} + {PRIOR} * p_{q}) div (docs + {PRIOR})").alias(q) for q in ("mid", "low", "high")]
    keys = [c for c in parent.columns if c not in ("mid", "low", "high")]
    return own.join(parent.withColumnsRenamed({q: f"p_{q}" for q in ("mid", "low", "high")}), keys).select(*[c for c in own.columns if c not in ("mid", "low", "high")], *cols)


def thresholds(sketches: DataFrame) -> DataFrame:
    """``lang, source`` with a low and a high fence for each metric. Null languages and sources are groups."""
    # a null-safe key: equality joins of arrays match nulls within
    s = sketches.withColumn("lang_key", F.array("lang"))
    every = quantiles(s, []).drop("docs")
    lang = _drawn(quantiles(s, ["lang_key"]), every.select("metric", "mid", "low", "high"))
    own = _drawn(quantiles(s, ["lang_key", "lang", "source"]), lang.select("metric", "lang_key", "mid", "low", "high"))
    fences = []
    for m, *_ in METRICS:
        mine = F.col("metric") == m
        fences += [F.max(F.when(mine, F.col("mid") - REACH * (F.col("mid") - F.col("low")))).alias(f"{m}_lo"), F.max(F.when(mine, F.col("mid") + REACH * (F.col("high") - F.col("mid")))).alias(f"{m}_hi")]
    return own.groupBy("lang", "source").agg(*fences)


def within(count: str, base: str, scale: int, fence: str, low: bool = False) -> Column:
    """Whether a count is explained by the rate at the fence; true without a fence."""
    mean = F.greatest(F.col(fence), F.lit(0)) * F.col(base) / F.lit(float(scale))
    off = mean - F.col(count) if low else F.col(count) - mean
    return F.coalesce((off <= 0) | (off * off <= NOISE * NOISE * (mean + 1)), F.lit(True))


def apply_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: base metrics, ``base_failed`` and ``kept``.

    Null texts count as empty and fail the base rules; null languages and sources are groups of their
    own; repeated rows are judged each. Texts are read once: metrics go to the shared folder. The
    thresholds have a row per language and source; as a written table their size is known, so the
    session's broadcast limit decides how they are joined."""
    scratch = Scratch(spark, "rules")
    rated = scratch.write(with_rates(text_metrics(docs)), "metrics")
    limits = scratch.write(thresholds(sketch(rated)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "thresholds")
    ok = ~F.col("base_failed")
    for m, count, base, scale, _, low in METRICS:
        ok = ok & within(count, base, scale, f"{m}_hi")
        if low:
            ok = ok & within(count, base, scale, f"{m}_lo", True)
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept"))
