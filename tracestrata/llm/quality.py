"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Method. Each document gets metrics: mean word length and the shares (in
thousandths) of symbols, duplicate lines and repeated words. A sketch counts
documents per (lang, source, metric, bin); bins are exact below 64 and then 32
per doubling, so a quantile is off by 3 % at most. Sketches merge by adding
counts: the sources' give each language's, those give the overall one. A group
with at least `support` documents uses its own quartiles, others their
language's, else all. A document is dropped if a metric lies beyond
`width` interquartile ranges (and a least step) outside its group's quartiles. The thresholds
are joined to the documents' metrics; texts are read once and not shuffled.

Native: built-in expressions only. Defined results. Null or empty text: no
words, so base_failed. A null lang or source is a group of its own. Repeated
rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracestrata import materialize
from tracestrata.llm.text import let, words

SUPPORT = 200
WIDTH = 3
# Least step beyond the quartiles, for groups whose documents hardly differ.
LEAST = {"word_length": 2000, "symbols": 100, "dup_lines": 200, "repeats": 200}
FEWEST_WORDS = 50
EXACT = 64
SUB_BITS = 5


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Sorted by hash and place, equal windows stand side by side; each of their
    places covers three words, less what the next one covers as well.
    """
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            )
            return let(
                F.sort_array(F.transform(again, lambda x: x["i"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                    F.lit(0), lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, twice))

    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, repeated))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts that the rules are made of."""
    text = F.coalesce("text", F.lit(""))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(
        lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    )
    return docs.select(
        "doc_id", "lang", "source",
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(words(F.col("text")), counted).alias("w"), line_counts.alias("l"),
    ).select(
        "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols",
        F.col("l.dup").cast("long").alias("n_dup_lines"), "w.n_repeat_words",
        F.col("l.n_lines").cast("long").alias("n_lines"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(F.lit(0)).cast("long")


def metrics(counts: DataFrame) -> DataFrame:
    c = F.col
    return counts.withColumns(
        {
            "word_length": _share(c("word_chars"), c("n_words")),
            "symbols": _share(c("n_symbols"), c("word_chars")),
            "dup_lines": _share(c("n_dup_lines"), c("n_lines")),
            "repeats": _share(c("n_repeat_words"), c("n_words")),
        }
    )


def bin_of(value: Column) -> Column:
    """Lower edge of the value's bin."""
    shift = F.length(F.bin(value)) - 1 - SUB_BITS
    # Column shifts need SQL: the functions take numbers only.
    edge = (value / F.pow(F.lit(2), shift)).cast("long") * F.pow(F.lit(2), shift).cast("long")
    return F.when(value < EXACT, value).otherwise(edge)


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: one mergeable sketch per group and metric."""
    values = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in LEAST])
    )
    return (
        measured.where("n_words > 0").select("lang", "source", values.alias("v"))
        .groupBy("lang", "source", F.col("v.metric").alias("metric"), F.col("v.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, support: int = SUPPORT, width: float = WIDTH) -> DataFrame:
    """lang, source, metric, low, high for every group of the sketches."""
    sketch = materialize(sketch)

    def quartiles(keys: list[str], prefix: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")  # at most one row per bin
        run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = merged.select(
            *keys, "metric", "bin", F.sum("n").over(run).alias("seen"), F.sum("n").over(group).alias("all")
        )
        at = lambda q: F.min(F.when(F.col("seen") >= q * F.col("all"), F.col("bin")))
        return ranked.groupBy(*keys, "metric").agg(
            F.struct(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("n")).alias(prefix)
        )

    own, by_lang, over_all = (
        quartiles(["lang", "source"], "own"), quartiles(["lang"], "by_lang"), quartiles([], "over_all")
    )
    both = own.alias("o").join(
        by_lang.alias("l"), F.expr("o.lang <=> l.lang and o.metric = l.metric")
    ).join(F.broadcast(over_all.alias("a")), F.expr("o.metric = a.metric"))  # one row per metric
    chosen = F.when(F.col("own.n") >= support, F.col("own")).when(
        F.col("by_lang.n") >= support, F.col("by_lang")
    ).otherwise(F.col("over_all"))
    least = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    rows = both.select(F.col("o.lang"), F.col("o.source"), F.col("o.metric"), chosen.alias("q"))
    step = width * (F.col("q.q3") - F.col("q.q1")) + least[F.col("metric")]
    return rows.select(
        "lang", "source", "metric", (F.col("q.q1") - step).alias("low"), (F.col("q.q3") + step).alias("high")
    )


def quality(docs: DataFrame, support: int = SUPPORT, width: float = WIDTH) -> DataFrame:
    """doc_id, counts, base_failed, kept and the metrics of every row of `docs` (doc_id, text, lang, source)."""
    measured = materialize(metrics(base_metrics(docs)))
    limits = (
        thresholds(sketches(measured), support, width).groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("metric") == m, F.struct("low", "high"))).alias(f"_{m}") for m in LEAST])
    ).toDF("_lang", "_source", *[f"_{m}" for m in LEAST])
    joined = measured.join(limits, F.expr("lang <=> _lang and source <=> _source"), "left")
    inside = F.lit(True)
    for m in LEAST:
        inside &= F.coalesce(F.col(m).between(F.col(f"_{m}")["low"], F.col(f"_{m}")["high"]), F.lit(True))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
    )
