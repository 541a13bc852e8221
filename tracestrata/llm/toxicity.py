"""Toxicity: a weighted finite-state pattern grammar over clauses.

Method. A lexicon turns words into the symbols insult, threat, target, negation,
reported speech and other. Transducers rewrite the symbol string of a clause:
negation turns an insult or threat in its scope into a negated one, reported
speech turns one into a reported one, target marks those of a clause that names
somebody. They are composed once into a single transducer, and its output
weights add up per clause. A document's features are what its clauses give; a
logistic model on them gives the score.

Only clauses around insult or threat words are read by the grammar. Those
words are listed in the lexicon or learnt: word stems that toxic training
documents use far more often than the others. Stems and weights are fitted on a
bounded sample of labelled rows (`sample` of each label, those with the
smallest hash), never on labels, lang, source or doc_id as inputs.

Defined results. Null or empty text has no clause and gets the score of a
document without matches. Rows repeated in `labels` count once. Null labels are
not used; without labels of both kinds the lexicon's own weights are used.
Repeated rows get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.text import slices

# Plain lists of words, as stems, in four languages.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "clown", "scum", "trash", "pathetic", "worthless",
    "disgusting", "imbecile", "bastard", "dumb", "filthy", "coward", "fool",
    "dummkopf", "trottel", "abschaum", "arschloch", "widerlich", "wertlos",
    "crétin", "connard", "imbécile", "salaud", "minable",
    "estúpido", "imbécil", "basura", "asqueroso", "patético", "inútil",
)
THREATS = (
    "kill", "murder", "hurt", "destroy", "beat", "burn", "shoot", "stab",
    "töten", "umbringen", "verprügel", "tuer", "frapper", "matar", "golpear",
)
TARGETS = (
    "you", "your", "yours", "you're", "u", "he", "him", "she", "her", "they", "them",
    "du", "dich", "dir", "dein", "ihr", "euch", "sie", "tu", "toi", "vous", "votre",
    "tú", "ti", "usted", "ustedes", "ellos", "ellas",
)
NEGATIONS = (
    "not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nobody",
    "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás", "sin",
)
REPORTS = (
    "said", "says", "say", "called", "claims", "claimed", "wrote", "quoted", "reported", "according",
    "sagte", "schrieb", "nannte", "dit", "déclaré", "écrit", "dijo", "escribió", "llamó",
)

SAMPLE = 4_000
# A stem is learnt if so many toxic training documents have it, at such odds.
SUPPORT = 12
ODDS = 30.0
STEMS = 2_000
STEM_SIZES = (5, 7)
SCOPE = 3
FEATURES = ("plain", "targeted", "negated", "reported")

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_ENDS = frozenset(b".!?;:\n")


class Transducer:
    """arcs[state][symbol] = [(output, next state)]; `ends` maps final states to an output."""

    def __init__(self, arcs: dict, start, ends: dict):
        self.arcs, self.start, self.ends = arcs, start, ends

    def compose(self, after: Transducer) -> Transducer:
        """What `after` makes of the output of this one; only reachable states are kept."""
        start = (self.start, after.start)
        arcs, ends, waiting = {}, {}, [start]
        while waiting:
            state = waiting.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol, ways in self.arcs[state[0]].items():
                for middle, left in ways:
                    for output, right in after.arcs[state[1]].get(middle, ()):
                        arcs[state].setdefault(symbol, []).append((output, (left, right)))
                        waiting.append((left, right))
            if state[0] in self.ends and state[1] in after.ends:
                ends[state] = after.ends[state[1]]
        return Transducer(arcs, start, ends)

    def best(self, symbols: list[str], value) -> list:
        """Output of the heaviest path through the symbols; `value` weighs one output symbol."""
        paths = {self.start: (0.0, ())}
        for place, symbol in enumerate(symbols):
            following: dict = {}
            for state, (weight, output) in paths.items():
                for out, target in self.arcs[state].get(symbol, ()):
                    new = (weight + value(out), (*output, (out, place)) if out in FEATURES else output)
                    if target not in following or new[0] > following[target][0]:
                        following[target] = new
            paths = following
        final = [path for state, path in paths.items() if state in self.ends]
        return list(max(final, key=lambda path: path[0])[1]) if final else []


def grammar(scope: int = SCOPE) -> Transducer:
    """negation, then reported speech, then target, composed."""
    plain = {"other": "other", "target": "target", "report": "report"}
    negation: dict = {}
    for left in range(scope + 1):
        after = max(0, left - 1)
        arcs = {s: [(o, after)] for s, o in plain.items()}
        arcs["negation"] = [("other", scope)]
        for hit in ("insult", "threat"):
            arcs[hit] = [("negated" if left else hit, after)]
        negation[left] = arcs
    reported: dict = {}
    for inside in (0, 1):
        arcs = {s: [(s, inside)] for s in ("other", "target", "negated")}
        arcs["report"] = [("other", 1)]
        for hit in ("insult", "threat"):
            arcs[hit] = [("reported" if inside else hit, inside)]
        reported[inside] = arcs
    # 0: not decided, "none": the clause names nobody, "wait": somebody must follow, "seen": has come.
    target: dict = {}
    for state in ("none", "wait", "seen"):
        arcs = {s: [(s, state)] for s in ("other", "negated", "reported")}
        hit = "plain" if state == "none" else "targeted"
        arcs["insult"] = arcs["threat"] = [(hit, state)]
        if state != "none":
            arcs["target"] = [("other", "seen")]
        target[state] = arcs
    target["begin"] = {
        s: [w for state in ("none", "wait") for w in target[state].get(s, ())] for s in
        ("other", "negated", "reported", "insult", "threat", "target")
    }
    return (
        Transducer(negation, 0, {s: None for s in negation})
        .compose(Transducer(reported, 0, {s: None for s in reported}))
        .compose(Transducer(target, "begin", {"begin": None, "none": None, "seen": None}))
    )


# How much each output counts before anything is learnt; a named target makes it worse.
_DEFAULT = {"plain": 1.0, "targeted": 1.5, "negated": 0.2, "reported": 0.3}


class Matcher:
    """Clause features of a text: one array per text, sums by output and the heaviest clause."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float]):
        self.hits = {**{s: ("threat", w) for s, w in threats.items()}, **{s: ("insult", w) for s, w in insults.items()}}
        self.sizes = sorted({len(s) for s in self.hits}, reverse=True)
        self.symbol = {w: s for s, words in
                       (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}
        self.grammar = grammar()
        # First four bytes of every stem: a quick look whether a word can be one.
        heads = {(s.encode() + b"\0\0\0\0")[:4] for s in self.hits}
        self.heads = np.unique(np.frombuffer(b"".join(sorted(heads)), "<u4"))

    def lookup(self, word: str) -> tuple[str, float] | None:
        for size in self.sizes:
            if size <= len(word) and (found := self.hits.get(word[:size])):
                return found
        return None

    def clauses(self, data: bytes) -> list[str]:
        """The clauses of a lower-case text in which a word may begin like a stem."""
        low = np.frombuffer(data, np.uint8)
        if len(low) < 4:
            return []
        ascii_letter = (low >= 97) & (low <= 122)
        # Behind a letter or sign beyond ASCII a word may begin; the grammar tells.
        begin = (ascii_letter | (low >= 192))[:-3]
        begin[1:] &= ~ascii_letter[:-4]
        at = np.flatnonzero(begin)
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, 4)[at]).view("<u4").ravel()
        place = np.searchsorted(self.heads, heads)
        place[place == len(self.heads)] = 0
        hits = at[self.heads[place] == heads] if len(self.heads) else at[:0]
        out, last = [], -1
        if not len(hits):
            return out
        ends = np.flatnonzero(np.isin(low, list(_CLAUSE_ENDS)))
        for hit in hits.tolist():
            if hit < last:
                continue
            i = int(np.searchsorted(ends, hit))
            first = int(ends[i - 1]) + 1 if i else 0
            last = int(ends[i]) if i < len(ends) else len(data)
            out.append(data[first:last].decode("utf-8", "replace"))
        return out

    def features(self, text: str) -> np.ndarray:
        """[sum of each output, clauses with a hit, heaviest clause]."""
        sums, matched, most = dict.fromkeys(FEATURES, 0.0), 0, 0.0
        for clause in self.clauses(text.lower().encode()):
            words = _WORD.findall(clause)
            found = [self.lookup(w) for w in words]
            if not any(found):
                continue
            symbols = [f[0] if f else self.symbol.get(w, "other") for w, f in zip(words, found)]
            total = 0.0
            for out, place in self.grammar.best(symbols, lambda o: _DEFAULT.get(o, 0.0)):
                weight = found[place][1]
                sums[out] += weight
                total += weight * _DEFAULT[out]
            matched += 1
            most = max(most, total)
        return np.array([*sums.values(), float(matched), most])


def shaped(features: np.ndarray) -> np.ndarray:
    """Bounded inputs of the logistic model: presence and logarithms."""
    return np.hstack([features > 0, np.log1p(features), np.ones((len(features), 1))]).astype(float)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `sample` labelled rows of each label that are not held out."""
    usable = usable_labels(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(sample).unionAll(
        usable.where("toxic = 0").orderBy(*order).limit(sample)
    )
    # At most twice `sample` pairs of numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "toxic"
    ).dropDuplicates(["doc_id"])


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from."""
    return (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )


def _stems(training: DataFrame) -> dict[str, float]:
    """Stems (and whole words, marked by a length of their own) that toxic documents use, with log-odds."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}{4,})")))
    # Texts with the same words count as one document: copies must not lend a word support. Made
    # below the explode, which would otherwise repeat it for every word of the text.
    kind = F.xxhash64(F.sort_array("words")).alias("kind")
    rows = training.select("toxic", found.alias("words")).select("toxic", "words", kind)
    words = rows.select("toxic", "kind", F.explode("words").alias("word"))
    forms = F.array(*[F.substring("word", 1, n) for n in STEM_SIZES])
    stems = (
        words.select("kind", "toxic", F.explode(F.array_distinct(forms)).alias("stem"))
        .where(F.length("stem") >= min(STEM_SIZES)).distinct()
    )
    kinds = rows.select("toxic", "kind").distinct().groupBy("toxic").agg(F.count("*").alias("n"))
    sizes = {r["toxic"]: r["n"] for r in kinds.collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        return {}
    odds = ((F.col("k") + 0.5) / (ones + 1)) / ((F.col("n") - F.col("k") + 0.5) / (zeros + 1))
    best = (
        stems.groupBy("stem").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
        .where(F.col("k") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= ODDS)
        .orderBy(F.desc("odds"), "stem").limit(STEMS)
    )
    return {r["stem"]: float(np.log(r["odds"])) for r in best.collect()}  # at most STEMS rows


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method on the penalised log-likelihood."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measure(docs: DataFrame, matcher: Matcher, keep: list[str], weights: np.ndarray | None) -> DataFrame:
    """The `keep` columns with the features, or with the score if there are weights."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [matcher.features(t or "") for t in part.column("text").to_pylist()]
                made = np.array(rows).reshape(len(rows), -1)
                columns = [part.column(c) for c in keep]
                if weights is None:
                    columns.append(pa.array(list(made), pa.list_(pa.float64())))
                else:
                    z = np.clip(shaped(made) @ weights, -30, 30)
                    columns += [pa.array(1 / (1 + np.exp(-z))), pa.array(made[:, 4].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made_names])

    made_names = ["features"] if weights is None else ["score", "n_clauses"]
    kinds = dict(docs.dtypes)
    made = "features array<double>" if weights is None else "score double, n_clauses long"
    return docs.select(*keep, "text").mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " + made)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Matcher, np.ndarray]:
    """Lexicon with weights, and the logistic model, from a bounded sample of labelled rows."""
    training = materialize(training_rows(docs, labels, sample))
    learnt = _stems(training)
    known = float(np.median(list(learnt.values()))) if learnt else 4.0
    insults = {**dict.fromkeys(INSULTS, known), **learnt}
    matcher = Matcher(insults, dict.fromkeys(THREATS, known / 4))
    rows = _measure(training, matcher, ["toxic"], None).collect()  # at most twice `sample` short rows
    if len({r["toxic"] for r in rows}) < 2:
        w = np.zeros(13)
        w[[0, 1]], w[-1] = 4.0, -3.0
        return matcher, w
    x = shaped(np.array([r["features"] for r in rows]))
    y = np.array([r["toxic"] for r in rows], float)
    w = _logistic(x, y)
    # The sample may hold one label more often than the labels do.
    counts = {r["toxic"]: r["n"] for r in usable_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    w[-1] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (1 - y).sum())
    return matcher, w


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every row of `docs` (doc_id, text)."""
    matcher, weights = fit(docs, labels, sample)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = _measure(rows, matcher, ["doc_id", "held_out"], weights)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below one half; nothing is shuffled.

    Only the text goes to Python and only the verdict comes back.
    """
    matcher, weights = fit(docs, labels, sample)

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text"):
            made = np.array([matcher.features(t or "") for t in part.column("text").to_pylist()])
            out.append(pa.array(shaped(made) @ weights < 0))
        return pa.concat_arrays(out) if out else pa.array([], pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))
