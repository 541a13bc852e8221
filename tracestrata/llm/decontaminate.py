"""Benchmark decontamination with a distributed positional inverted index.

Method. The index holds a posting (term, doc_id, pos) for every occurrence of a
term of the tests in the training documents, and one end posting per document
at its number of words. Tests are cut into windows. For each window the lists of its
two rarest terms are taken, moved back by the terms' offsets and intersected;
what is left is intersected with the lists of the other terms. A window that
all its terms agree on is an exact phrase; `proximity` takes terms that are within
a distance instead.

The index is written once, in columns, and then read for term counts, lists and
checks. Only lists of rare terms are shuffled; the vocabulary of the tests is
broadcast if it is counted to be small.

Native: built-in expressions only. Defined results. Null or empty text has no
words. A null doc_id is counted but has no hits, since an index cannot refer to
it. A null item_id or an item without words has no windows. Repeated rows of a
document give the same hits. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracestrata import materialize, scratch_dir
from tracestrata.llm.joins import sized
from tracestrata.llm.text import lower_ascii, words

# Fixed value: everything in ASCII but letters and digits separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 2
# A word put in shifts the words behind it by one; two swapped neighbours are two places apart.
SLACK = 2
END = ""  # the term of the end posting


def test_windows(tests: DataFrame, length: int = WINDOW) -> DataFrame:
    """window (hash of its terms), items (that have it), terms (hashes in order); stored."""
    items = tests.select("item_id", words(lower_ascii(F.col("text")), SEPARATORS).alias("w")).where(
        "item_id is not null and size(w) > 0"
    )
    n = F.size("w")
    start = F.explode(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1)))).alias("start")
    spread = items.select("item_id", "w", start)
    terms = F.transform(F.slice("w", F.col("start"), F.lit(length)), lambda w: F.xxhash64(w))
    cut = spread.select("item_id", terms.alias("terms"))
    return materialize(
        cut.groupBy(F.xxhash64("terms").alias("window")).agg(
            F.first("terms").alias("terms"), F.collect_set("item_id").alias("items")
        )
    )


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings (doc_id, pos, term) as a stored table; of the terms of `vocabulary` if given."""
    listed = F.concat(words(lower_ascii(F.col("text")), SEPARATORS), F.array(F.lit(END)))
    rows = docs.select("doc_id", F.posexplode(listed).alias("pos", "word")).select(
        "doc_id", "pos", F.xxhash64("word").alias("term")
    )
    if vocabulary is not None:
        ends = vocabulary.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"))
        wanted = materialize(vocabulary.select("term").union(ends).distinct())
        rows = rows.join(sized(wanted), "term").select("doc_id", "pos", "term")
    where = scratch_dir(docs.sparkSession, "postings")
    rows.write.parquet(where)
    return docs.sparkSession.read.schema("doc_id long, pos int, term long").parquet(where)


def ranked_terms(index: DataFrame, windows: DataFrame) -> DataFrame:
    """window, place, term, rank (1: rarest in the index), n; windows with an absent term are left out."""
    counts = index.groupBy("term").agg(F.count("*").alias("uses"))
    places = windows.select("window", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "term"))
    joined = places.join(counts, "term", "left")
    one = Window.partitionBy("window")  # at most a window's terms
    return materialize(
        joined.withColumn("absent", F.max(F.col("uses").isNull()).over(one)).where("not absent")
        .withColumn("rank", F.row_number().over(one.orderBy("uses", "place")))
        .select("window", "place", "term", "rank", "n")
    )


def phrase_matches(
    index: DataFrame, windows: DataFrame, rarest: int = RAREST, ranked: DataFrame | None = None
) -> DataFrame:
    """doc_id, start, n, window of every exact occurrence; stored."""
    ranked = ranked_terms(index, windows) if ranked is None else ranked
    known = index.where("doc_id is not null")
    # Lists of the rarest terms, moved back by their offsets: equal starts intersect.
    probes = ranked.where(F.col("rank") <= rarest)
    starts = known.join(sized(probes), "term").select(
        "doc_id", "window", "n", (F.col("pos") - F.col("place")).alias("start"), "rank"
    ).where("start >= 0")
    found = materialize(
        starts.groupBy("doc_id", "window", "start").agg(
            F.max("n").alias("n"), F.count_distinct("rank").alias("k")
        ).where(F.col("k") == F.least("n", F.lit(rarest))).drop("k")
    )
    checks = found.join(sized(ranked.where(F.col("rank") > rarest).drop("n")), "window").select(
        "doc_id", "window", "start", (F.col("start") + F.col("place")).alias("pos"), "term", "rank"
    )
    # Postings of the few documents that are left.
    near = known.join(sized(materialize(found.select("doc_id").distinct())), "doc_id", "left_semi")
    agreed = checks.join(near, ["doc_id", "pos", "term"]).groupBy("doc_id", "window", "start").agg(
        F.count_distinct("rank").alias("k")
    )
    return materialize(
        found.join(agreed, ["doc_id", "window", "start"], "left")
        .where(F.coalesce("k", F.lit(0)) == F.greatest(F.col("n") - rarest, F.lit(0)))
        .select("doc_id", "start", "n", "window")
    )


def proximity_matches(index: DataFrame, windows: DataFrame, slack: int, ranked: DataFrame | None = None) -> DataFrame:
    """doc_id, start, window where every term is within `slack` words of its place.

    The start is where the window's rarest term puts it. The lists of the two
    rarest terms are cut into stretches as long as the slack allows, so each place is
    compared with its own and the neighbouring stretches only; the other terms are
    looked up in the documents that are left.
    """
    ranked = ranked_terms(index, windows) if ranked is None else ranked
    known = index.where("doc_id is not null")
    moved = known.join(sized(ranked.where("rank <= 2")), "term").select(
        "doc_id", "window", "n", "rank", (F.col("pos") - F.col("place")).alias("start")
    )
    width = slack + 1
    anchors = moved.where("rank = 1").select(
        "doc_id", "window", "n", F.col("start").alias("anchor"),
        F.explode(F.sequence(F.floor((F.col("start") - slack) / width), F.floor((F.col("start") + slack) / width)))
        .alias("stretch"),
    )
    second = moved.where("rank = 2").select(
        "doc_id", "window", "start", F.floor(F.col("start") / width).alias("stretch")
    ).distinct()
    found = materialize(
        anchors.join(second, ["doc_id", "window", "stretch"], "left")
        .where((F.col("n") == 1) | (F.abs(F.col("start") - F.col("anchor")) <= slack))
        .select("doc_id", "window", "n", "anchor").distinct()
    )
    place = F.col("anchor") + F.col("place")
    checks = found.join(sized(ranked.where("rank > 2").drop("n")), "window").select(
        "doc_id", "window", "anchor", "rank", "term", F.explode(F.sequence(place - slack, place + slack)).alias("pos")
    )
    near = known.join(sized(materialize(found.select("doc_id").distinct())), "doc_id", "left_semi")
    agreed = checks.join(near, ["doc_id", "pos", "term"]).groupBy("doc_id", "window", "anchor").agg(
        F.count_distinct("rank").alias("k")
    )
    return materialize(
        found.join(agreed, ["doc_id", "window", "anchor"], "left")
        .where(F.coalesce("k", F.lit(0)) == F.greatest(F.col("n") - 2, F.lit(0)))
        .select("doc_id", F.col("anchor").alias("start"), "window")
    )


def _items(matches: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    return (
        matches.select("doc_id", "window").distinct()
        .join(windows.select("window", F.explode("items").alias("item_id")), "window")
        .groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(name))
    )


def decontaminate(docs: DataFrame, tests: DataFrame, length: int = WINDOW, slack: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated of every row of `docs` (doc_id, text).

    With `slack` also n_near, the number of occurrences of windows whose terms are all
    within so many words of their places (exact ones included), and near_items.
    """
    windows = test_windows(tests, length)
    vocabulary = windows.select(F.explode("terms").alias("term"))
    index = build_index(docs.select("doc_id", "text"), vocabulary)
    ranked = ranked_terms(index, windows)
    matches = phrase_matches(index, windows, ranked=ranked)
    hit = (
        matches.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
        .distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    )
    # As many rows as documents with a hit.
    result = sized(materialize(hit.join(_items(matches, windows, "items"), "doc_id")))
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", F.col("pos").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    further = []
    if slack is not None:
        close = proximity_matches(index, windows, slack, ranked)
        counts = close.groupBy("doc_id").agg(F.count("*").alias("n_near"))
        ends = ends.join(sized(materialize(counts.join(_items(close, windows, "near_items"), "doc_id"))), "doc_id", "left")
        further = [
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"),
        ]
    return ends.join(result, "doc_id", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
        *further,
    )
