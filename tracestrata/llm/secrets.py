"""Secrets: fixed patterns, and a battery of randomness tests with false-discovery control.

Method. Long runs of identifier characters are candidates, and so are their long
parts between '/', '-', '_' and '+'; '=' ends a run unless it is closing padding.
The encoding is inferred as the smallest alphabet that holds all characters. The battery asks
whether a candidate is random: chi-squared uniformity over the alphabet, runs above
and below the alphabet's middle, and serial correlation of neighbours; its p-value is
the smallest of the three, times three. The Benjamini-Hochberg procedure, separately for
each encoding and length class, turns the battery's p-values into the candidates that
are not random, of which at most the share `alpha` are random after all. The same
procedure tells from the other side: under ordinary text the kind of character
(letter, digit, new capital) rarely changes and letters collide often; the smaller of
those p-values, doubled, gives the candidates that are no text, at rate `rate`. A secret
is no text and has not been found to be not random. So short candidates, on which all
these tests say little, pay for their number among themselves. p-values are counted in
bins of a bounded number and rounded up, so the procedures need no global sort.

Native: built-in expressions only. Texts are read once and not shuffled; later
steps carry lengths and candidates. Defined results. Null text is empty. Every
row gets its own result, repeated rows the same. Spans count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracestrata import materialize
from tracestrata.llm.text import let

# Patterns as the contract states them, and the length a match needs.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
_PADDING = r"(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+" + _PADDING


def _part(letters: str, cuts: str) -> str:
    """Stretches of `letters` with one of `cuts` before or behind them."""
    run = f"[{letters}]{{20,}}+"
    return rf"(?<![{letters}])(?:(?<=[{cuts}]){run}{_PADDING}|{run}(?=[{cuts}]))"


# Parts of a candidate: of a path, of a compound name, and between all of these signs.
PARTS = (
    _part(r"A-Za-z0-9+_-", "/"), _part("A-Za-z0-9+/", "_-"), _part("A-Za-z0-9+", "/_-"), _part("A-Za-z0-9", "+/_-"),
)
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

ALPHA = 0.001
RATE = 0.01
# Ordinary text: how often the kind of character changes, and letters collide.
CHANGE, COLLIDE = 0.05, 0.066
# p-values are binned by a tenth of their natural logarithm, down to e^-60.
BINS_PER_UNIT, LOWEST = 10, 60
LENGTH_EDGES = (24, 32, 48, 64, 128)

# name, pattern, alphabet; the first that fits is the encoding.
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("letters", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _occurrences(text: Column, pattern: str, kind: str, keep) -> Column:
    """(kind, i, gap, size, value, keep) of every match, in order; none if there is none.

    Splitting and extracting walk through the same matches, so piece i stands
    right before match i.
    """
    empty = F.array().cast(
        "array<struct<kind:string,i:int,gap:int,size:int,value:string,keep:boolean>>"
    )
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m, i: F.struct(m.alias("m"), i.alias("i")),
    )

    def rows(gaps: Column) -> Column:
        return F.transform(
            found,
            lambda x: F.struct(
                F.lit(kind).alias("kind"), x["i"].cast("int").alias("i"),
                F.length(F.get(gaps, x["i"])).alias("gap"), F.length(x["m"]).alias("size"),
                F.when(F.lit(kind.startswith("random")), x["m"]).alias("value"), keep(x["m"]).alias("keep"),
            ),
        )

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), rows)).otherwise(empty)


def occurrences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """row, `key`, found (all matches of all patterns) of every document; stored."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_ASSIGN
    always = lambda m: F.lit(True)
    found = F.concat(
        _occurrences(text, ASSIGN, "assign", value),
        _occurrences(text, ACCESS, "access", lambda m: F.length(m) >= LEAST_ACCESS),
        _occurrences(text, HEX, "hex", always),
        _occurrences(text, CANDIDATE, "random", always),
        *[_occurrences(text, p, f"random{i}", always) for i, p in enumerate(PARTS)],
    )
    # Stored at once, so the row numbers stay what they are.
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), key, found.alias("found")))


def located(found: DataFrame) -> DataFrame:
    """row, kind, start, stop, value of the matches that are kept."""
    rows = found.where(F.size("found") > 0).select("row", F.inline("found"))
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(order)
    kind = F.regexp_replace("kind", "[0-9]+$", "").alias("kind")
    return rows.select("row", kind, "size", "value", "keep", stop.alias("stop")).where("keep").select(
        "row", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "value"
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by a rational approximation (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(candidates: DataFrame) -> DataFrame:
    """Adds encoding, length class, p_uniform, p_runs, p_serial, p_text to distinct `value`s."""
    text = F.rtrim("value", F.lit("="))
    encoding = F
    for name, pattern, _ in ENCODINGS[:-1]:
        encoding = encoding.when(F.col("v").rlike(pattern), F.lit(name))
    alphabet = F
    for name, _, letters in ENCODINGS:
        alphabet = alphabet.when(F.col("encoding") == name, F.lit(letters))
    x = (
        candidates.select("value", F.translate(text, "-_", "+/").alias("v"))
        .where("length(v) >= 16")
        .withColumn("encoding", encoding.otherwise(F.lit("base64")))
        .withColumn("alphabet", alphabet)
        .withColumn("n", F.length("v").cast("double"))
        .withColumn("k", F.length("alphabet").cast("double"))
    )
    letters = F.filter(F.split("alphabet", ""), lambda c: c != "")
    squares = F.aggregate(
        F.transform(letters, lambda c: (F.length("v") - F.length(F.replace(F.col("v"), c, F.lit("")))).cast("double")),
        F.lit(0.0), lambda total, c: total + c * c,
    )
    values = F.transform(
        F.filter(F.split("v", ""), lambda c: c != ""), lambda c: F.expr("0").cast("int") + F.instr(F.col("alphabet"), c)
    )
    x = x.withColumns({"squares": squares.cast("double"), "places": values})
    n, k, s = F.col("n"), F.col("k"), F.col("squares")
    chi, df = k / n * s - n, k - 1
    # Wilson-Hilferty: the cube root of a chi-squared variable over its mean is nearly normal.
    p_uniform = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    high = F.filter("places", lambda p: p > F.col("k") / 2)
    changes = F.size(
        F.filter(F.sequence(F.lit(1), F.size("places") - 1), lambda i: (
            (F.get(F.col("places"), i) > F.col("k") / 2) != (F.get(F.col("places"), i - 1) > F.col("k") / 2)
        ))
    )
    above = F.size(high).cast("double")
    below = n - above
    mean = 2 * above * below / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(
        (above > 0) & (below > 0) & (spread > 0),
        2 * _upper_tail(F.abs(changes + 1 - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))),
    ).otherwise(0.0)
    middle = (k + 1) / 2
    products = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.size("places") - 1),
            lambda i: (F.get(F.col("places"), i) - (F.col("k") + 1) / 2)
            * (F.get(F.col("places"), i - 1) - (F.col("k") + 1) / 2),
        ),
        F.lit(0.0), lambda total, p: total + p,
    )
    variance = (k * k - 1) / 12
    p_serial = 2 * _upper_tail(F.abs(products) / (variance * F.sqrt(n - 1)))
    # Ordinary text. Letter to digit and back, and lower case to capital, are changes.
    plain = F.regexp_replace("v", "[+/]+", "")
    kind_changes = F.size(F.regexp_extract_all(plain, F.lit(r"([a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z]))")))
    m = F.greatest(F.length(plain).cast("double") - 1, F.lit(1.0))
    a = F.least(kind_changes / m, F.lit(1 - 1e-9))
    entropy = a * F.log(F.greatest(a, F.lit(1e-9)) / CHANGE) + (1 - a) * F.log((1 - a) / (1 - CHANGE))
    p_change = F.when(a > CHANGE, F.exp(-m * entropy)).otherwise(1.0)  # a bound on the binomial tail
    pairs = n * (n - 1) / 2
    collisions = (s - n) / 2
    deviation = F.sqrt(pairs * COLLIDE * (1 - COLLIDE) + n * n * n * 0.0006)
    p_collide = 1 - _upper_tail((collisions - pairs * COLLIDE) / deviation)
    edges = F.lit(0)
    for edge in LENGTH_EDGES:
        edges = edges + (F.col("n") >= edge).cast("int")
    return x.select(
        "value", "encoding", edges.alias("length_class"), p_uniform.alias("p_uniform"), p_runs.alias("p_runs"),
        p_serial.alias("p_serial"), F.least(F.lit(1.0), 2 * F.least(p_change, p_collide)).alias("p_text"),
        middle.alias("middle"),
    ).drop("middle")


def rejected(tested: DataFrame, p: str, rate: float) -> DataFrame:
    """`tested` with a flag `rejected`: the Benjamini-Hochberg procedure on the p-values `p` at `rate`.

    One procedure for each encoding and length class.
    """
    log_p = F.greatest(F.log(F.greatest(p, F.lit(1e-300))), F.lit(float(-LOWEST)))
    binned = tested.withColumn("bin", F.ceil(log_p * BINS_PER_UNIT).cast("int"))
    group = ["encoding", "length_class"]
    # At most 601 bins for each of some sixty groups, whatever the number of values.
    counts = binned.groupBy(*group, "bin").agg(F.count("*").alias("c"))
    run = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns(
        {"seen": F.sum("c").over(run), "all": F.sum("c").over(Window.partitionBy(*group))}
    )
    cut = ranked.where(
        F.exp(F.col("bin") / BINS_PER_UNIT) <= rate * F.col("seen") / F.col("all")
    ).groupBy(*group).agg(F.max("bin").alias("cut"))
    flag = F.coalesce(F.col("bin") <= F.col("cut"), F.lit(False))
    return binned.join(F.broadcast(cut), group, "left").withColumn("rejected", flag).drop("bin", "cut")


def discovered(tested: DataFrame, alpha: float = ALPHA, rate: float = RATE) -> DataFrame:
    """The values that are no text and have not been found to be not random."""
    p_random = F.least(F.lit(1.0), 3 * F.least("p_uniform", "p_runs", "p_serial"))
    judged = rejected(tested.withColumn("p_random", p_random), "p_random", alpha)
    judged = rejected(judged.withColumnRenamed("rejected", "not_random"), "p_text", rate)
    return judged.where("rejected and not not_random").select("value")


def _apart(spans: DataFrame) -> DataFrame:
    """Random spans (row, start, stop) that no fixed span touches, and the longest of those that hold each other.

    Two sweeps over the spans of a row in order, so a row of many spans takes no longer
    than sorting them.
    """
    fixed = F.col("kind") != "random"
    order = Window.partitionBy("row").orderBy("start", (~fixed).cast("int"))
    reached = F.max(F.when(fixed, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    next_ = F.first(F.when(fixed, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (
        spans.select("row", "kind", "start", "stop", reached.alias("reached"), next_.alias("next"))
        .where("kind = 'random'")
        .where((F.coalesce("reached", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("stop")) >= F.col("stop")))
        .select("row", "kind", "start", "stop").distinct()
    )
    longest = Window.partitionBy("row").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    held = F.max("stop").over(longest)
    return free.withColumn("held", held).where(F.coalesce("held", F.lit(-1)) < F.col("stop")).drop("held")


def find_secrets(docs: DataFrame, alpha: float = ALPHA, rate: float = RATE, key: str = "doc_id") -> DataFrame:
    """`key`, spans (array of kind, start, stop by start and kind) of every row of `docs` (`key`, text)."""
    found = occurrences(docs.select(key, "text"), key)
    spans = materialize(located(found))
    tested = materialize(battery(spans.where("kind = 'random'").select("value").distinct()))
    random = materialize(discovered(tested, alpha, rate))
    drawn = spans.where("kind = 'random'").join(random, "value", "left_semi").select("row", "kind", "start", "stop")
    base = spans.where("kind <> 'random'").select("row", "kind", "start", "stop")
    # A random span is new only where no pattern has found anything.
    rows = drawn.select("row").distinct()
    kept = base.union(_apart(drawn.union(base.join(rows, "row", "left_semi"))))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    listed = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "stop", "kind"))).alias("spans")
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")
    shaped = F.transform(
        "spans",
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop")),
    )
    return found.select("row", key).join(listed, "row", "left").select(
        key, F.coalesce(shaped, none).alias("spans")
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (in order), overlapping ones together, replaced by a mark."""
    # Each span with where the ones before it have reached: of three numbers a span, nothing of the text.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at: bigint, start: bigint>>").alias("cuts"))

    def step(done: Column, s: Column) -> Column:
        cut = F.array(F.struct(done["at"].alias("at"), s["start"].alias("start")))
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["cuts"], cut)).otherwise(done["cuts"]).alias("cuts"),
        )

    def finish(done: Column) -> Column:
        pieces = F.transform(
            done["cuts"], lambda c: F.substr(text, (c["at"] + 1).cast("int"), (c["start"] - c["at"]).cast("int"))
        )
        return F.concat(F.array_join(pieces, mark), F.lit(mark), F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(
        F.aggregate(spans, start, step, finish)
    )
