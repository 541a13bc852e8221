"""Repeated passages: prefix-partitioned suffix trees over the words of all documents.

Method. A repeat of `length` words holds the same minimiser: of the k-word grams
that begin inside it, the one with the smallest hash. Suffixes begin at minimisers
(about two in nine words), each with the few words that lead to it, and a suffix belongs
to the group of its prefix, the k words of the minimiser. A prefix of a single document
is a leaf and is dropped before any suffix is sent. Prefixes are of variable length: a
group of more than `hot` documents is split by longer ones, step by step (`LENGTHS`), by
the words behind the minimiser and, where the passage ends before, by those that lead
to it, until each group fits into memory.

A group's subtree is built from its sorted suffixes and the lengths that neighbours have
in common, and the words that lead to them are sorted likewise. An internal node `length`
words deep holds the suffixes that agree in so many words, `d` of them before the
minimiser; a node of several documents is a repeat, which the smallest of them keeps.
Runs of such nodes along a document are its maximal repeats. At the greatest prefix
length a group is one node; its smallest document is a pre-aggregated minimum, joined
back, so no task gets an unbounded group.

Within a slice of a document every passage is sent once, however often it repeats there.
Texts are shuffled once, by document; the marks are joined to that shuffle.

Defined results. Windows are judged on the input. Null text: no words. A null
doc_id is never compared: the document keeps all its words. Rows with the same
doc_id are one document and each is cut the same way. Documents shorter than
the window keep everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.text import Words, mix, seeds, slices

LENGTH = 13
# Words of a prefix: of the minimiser, and of the longer prefixes of groups that are too large.
LENGTHS = (6, 8, 10, 13)
# Documents of one prefix that a task sorts at most, at about 150 bytes each.
HOT = 100_000
# Suffixes that are sorted at a time, unless one group has more.
SORT_ROWS = 20_000


class Windows:
    """Every window of a slice: row, place in its row, fingerprint, and its prefixes by length.

    `lead` is how many of its words come before the minimiser.
    """

    def __init__(self, column: pa.Array, length: int, lengths: tuple[int, ...]):
        self.words = words = Words(column)
        first = lengths[0]
        self.grams = grams = words.grams(first)
        n = max(0, len(words.hash) - length + 1)
        valid = np.flatnonzero(words.whole(length))
        if n:
            view = np.lib.stride_tricks.sliding_window_view(grams, length - first + 1)[:n]
            self.lead = view.argmin(axis=1)[valid]
        else:
            self.lead = np.zeros(0, np.int64)
        self.at = valid
        self.doc = words.doc[valid]
        self.begin = valid - words.first[self.doc]
        self.label = words.grams(length)[valid].astype(np.int64)
        self.prefix = np.stack([self._prefix(k, length) for k in lengths])

    def _prefix(self, size: int, length: int) -> np.ndarray:
        """The `size` words from the minimiser on, or, if the window ends before, that end with it."""
        moved = np.maximum(0, size - (length - self.lead))
        grams = self.words.grams(size)
        place = self.at + self.lead - moved
        # 48 bits are enough to tell prefixes apart and are less to send.
        key = mix(grams[place] ^ seeds(length + 1, stream=size)[moved]) if len(grams) else np.zeros(0, np.uint64)
        return (key >> np.uint64(16)).astype(np.int64)

    def named(self, prefixes: np.ndarray, lists: pa.Array) -> np.ndarray:
        """For each window, whether its row's list holds its prefix."""
        lists = lists.fill_null([]) if lists.null_count else lists
        size = np.asarray(pc.list_value_length(lists), np.int64)
        listed = np.asarray(lists.flatten(), np.int64)
        owner = mix(np.repeat(np.arange(len(lists)), size).astype(np.uint64)) ^ listed.astype(np.uint64)
        return np.isin(mix(self.doc.astype(np.uint64)) ^ prefixes.astype(np.uint64), owner)

    def level(self, hot: pa.Array) -> np.ndarray:
        """For each window, which of its prefixes is the shortest that is not too common."""
        out = np.zeros(len(self.doc), np.int64)
        for k in range(len(self.prefix) - 1):
            longer = (out == k) & self.named(self.prefix[k], hot)
            out[longer] = k + 1
        return out


def _prefixes(docs: DataFrame, length: int, lengths: tuple[int, ...], level: int) -> DataFrame:
    """(prefix, doc_id), once for each document and prefix of a level; above the first, where shorter ones are hot."""

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = Windows(part.column("text"), length, lengths)
                doc, key = found.doc, found.prefix[level]
                if level:
                    here = found.level(part.column("hot")) == level
                    doc, key = doc[here], key[here]
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new]), pa.array(ids[doc[new]])], names=["prefix", "doc_id"]
                )

    return docs.mapInArrow(task, "prefix long, doc_id long")


_SUFFIX = "prefix long, doc_id long, begin int, lead short, windows short, words binary, node boolean"


def _suffixes(docs: DataFrame, length: int, lengths: tuple[int, ...]) -> DataFrame:
    """Suffixes of shared prefixes with the words that lead to them; one window a row where the prefix is a node.

    The words of a minimiser are sent as one, its hash: they are the same throughout a group.
    """
    spared = lengths[0] - 1

    def task(batches):
        for batch in batches:
            for part in slices(batch.filter(batch.column("shared").is_valid()), "text"):
                found = Windows(part.column("text"), length, lengths)
                level = found.level(part.column("hot"))
                prefix = found.prefix[level, np.arange(len(level))]
                at = np.flatnonzero(found.named(found.prefix[0], part.column("shared")))
                order = at[np.lexsort((found.begin[at], found.label[at], found.doc[at]))]
                first = np.ones(len(order), bool)
                first[1:] = (found.doc[order][1:] != found.doc[order][:-1]) | (
                    found.label[order][1:] != found.label[order][:-1]
                )
                at = np.sort(order[first])
                node = level[at] == len(lengths) - 1
                head = np.ones(len(at), bool)
                minimiser = found.begin[at] + found.lead[at]
                head[1:] = (
                    (at[1:] != at[:-1] + 1) | (found.doc[at][1:] != found.doc[at][:-1])
                    | (prefix[at][1:] != prefix[at][:-1]) | (minimiser[1:] != minimiser[:-1]) | node[1:]
                )
                run = np.flatnonzero(head)
                count = np.diff(np.append(run, len(at)))
                # The words of a run: those of its windows together, those of the minimiser as one.
                size = np.where(node[run], 1, count + length - 1 - spared)
                starts = np.cumsum(size) - size
                source = np.where(node[run], 0, found.at[at][run])
                lead = np.where(node[run], 0, found.lead[at][run])
                step = np.arange(size.sum()) - np.repeat(starts, size)
                behind = step > np.repeat(lead, size)
                place = np.repeat(source, size) + step + spared * behind
                content = found.words.hash[place] if len(place) else np.zeros(0, np.uint64)
                label = found.label[at][run].astype(np.uint64)
                content[starts + lead] = np.where(node[run], label, found.grams[source + lead])
                ends = (np.append(starts, size.sum()) * 8).astype(np.int32)
                words = pa.BinaryArray.from_buffers(
                    pa.binary(), len(run), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(content.astype("<u8").tobytes())]
                )
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[at][run]), pa.array(ids[found.doc[at][run]]),
                     pa.array(found.begin[at][run].astype(np.int32)), pa.array(found.lead[at][run].astype(np.int16)),
                     pa.array(count.astype(np.int16)), words, pa.array(node[run])],
                    names=["prefix", "doc_id", "begin", "lead", "windows", "words", "node"],
                )

    return docs.mapInArrow(task, _SUFFIX)


def _in_order(prefix: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words within their prefixes, and how many words each shares with the one before it.

    A new prefix shares -1.
    """
    order = np.lexsort((*rows.T[::-1], prefix))
    common = np.full(len(order), -1, np.int64)
    differ = rows[order][1:] != rows[order][:-1]
    same = prefix[order][1:] == prefix[order][:-1]
    common[1:] = np.where(same, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]), -1)
    return order, common


def deep_nodes(
    prefix: np.ndarray, doc: np.ndarray, lead: np.ndarray, windows: np.ndarray, words: list[np.ndarray], length: int
) -> np.ndarray:
    """For each suffix and each number of words before it, whether a smaller document shares that node.

    The node of `d` words before the minimiser is `length` deep: `d` words back, the rest on.
    """
    size = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return _deep_nodes(prefix, doc, lead, windows, flat, size, length)


def _unfolded(stored: np.ndarray, size: np.ndarray, lead: np.ndarray, spared: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and their numbers with each minimiser at its full length: its hash, then `spared` times nothing."""
    step = np.arange(len(stored)) - np.repeat(np.cumsum(size) - size, size)
    whole = size + spared
    place = np.repeat(np.cumsum(whole) - whole, size) + step + spared * (step > np.repeat(lead, size))
    flat = np.zeros(whole.sum(), np.uint64)
    flat[place] = stored
    return flat, whole


def _deep_nodes(
    prefix: np.ndarray, doc: np.ndarray, lead: np.ndarray, windows: np.ndarray, flat: np.ndarray, size: np.ndarray, length: int
) -> np.ndarray:
    """`deep_nodes` of words that lie one after the other, `size` of each suffix."""
    n, most = len(prefix), length - LENGTHS[0]
    start = np.cumsum(size) - size + lead
    # The words from the minimiser on, and those before it, the nearest first.
    ahead = np.zeros((n, length), np.uint64)
    back = np.zeros((n, most), np.uint64)
    step = np.arange(length)
    there = step < (size - lead)[:, None]
    ahead[there] = flat[(start[:, None] + step)[there]]
    step = np.arange(most)
    there = step < lead[:, None]
    back[there] = flat[(start[:, None] - 1 - step)[there]]
    tree, tree_common = _in_order(prefix, ahead)
    leads, lead_common = _in_order(prefix, back)
    out = np.zeros((n, most + 1), bool)
    below, above = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(most + 1):
        rows = np.flatnonzero((lead >= d) & (lead - windows < d))
        if len(rows) < 2:
            continue
        below[tree] = np.cumsum(tree_common < length - d)
        above[leads] = np.cumsum(lead_common < d)
        node = below[rows] * (n + 1) + above[rows]
        order = np.lexsort((doc[rows], node))
        first = np.ones(len(rows), bool)
        first[1:] = node[order][1:] != node[order][:-1]
        least = doc[rows][order][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        out[rows[order[doc[rows][order] > least]], d] = True
    return out


def _repeats(suffixes: DataFrame, length: int, lengths: tuple[int, ...]) -> DataFrame:
    """(doc_id, first window, end of windows) whose passages a smaller document has as well.

    A task takes its groups in order and builds the subtrees of all that are
    complete at once; only the last group waits for the next batch.
    """

    def subtrees(rows: pa.RecordBatch):
        words = rows.column("words")
        size = np.asarray(pc.binary_length(words), np.int64) // 8
        stored = np.frombuffer(b"".join(words.to_pylist()), "<u8")
        prefix, doc, begin, lead, windows = (
            rows.column(c).to_numpy().astype(np.int64) for c in ("prefix", "doc_id", "begin", "lead", "windows")
        )
        found = _deep_nodes(prefix, doc, lead, windows, *_unfolded(stored, size, lead, lengths[0] - 1), length)
        edge = np.zeros((len(doc), found.shape[1] + 2), np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        owner, near = np.nonzero(step == 1)  # the last window of a run, by its distance to the minimiser
        far = np.nonzero(step == -1)[1] - 1
        base = begin[owner] + lead[owner]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[owner]), pa.array((base - far).astype(np.int32)), pa.array((base - near + 1).astype(np.int32))],
            names=["doc_id", "begin", "end"],
        )

    def task(batches):
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("prefix").to_numpy()
            waiting.append(batch)
            held += batch.num_rows
            cut = int(np.searchsorted(keys, keys[-1]))  # sorted: where the last group begins
            if held >= SORT_ROWS and cut:
                waiting[-1] = batch.slice(0, cut)
                for part in pa.Table.from_batches(waiting).combine_chunks().to_batches():
                    yield subtrees(part)
                waiting, held = [batch.slice(cut)], batch.num_rows - cut
        if waiting:
            for part in pa.Table.from_batches(waiting).combine_chunks().to_batches():
                yield subtrees(part)

    grouped = suffixes.repartition("prefix").sortWithinPartitions("prefix")
    return grouped.select("prefix", "doc_id", "begin", "lead", "windows", "words").mapInArrow(
        task, "doc_id long, begin int, end int"
    )


def _covered(text: pa.Array, spans: pa.Array, length: int) -> tuple[list[int], np.ndarray]:
    """Words of each text, and which of all words lie in a passage like one of the marked windows."""
    words = Words(text)
    label = words.grams(length)
    size = np.asarray(pc.list_value_length(spans), np.int64)
    fields = spans.flatten()
    begin, end = (np.asarray(fields.field(k), np.int64) for k in (0, 1))
    doc = np.repeat(np.arange(len(size)), size)
    inside = end <= words.count[doc] - length + 1  # else of another row with this doc_id
    begin, end, doc = begin[inside], end[inside], doc[inside]
    width = end - begin
    marked = np.repeat(words.first[doc] + begin - (np.cumsum(width) - width), width) + np.arange(width.sum())
    owner = mix(words.doc.astype(np.uint64))
    valid = np.flatnonzero(words.whole(length))
    hit = valid[np.isin(label[valid] ^ owner[valid], label[marked] ^ owner[marked])]
    edges = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + length, -1)
    return words.count.tolist(), np.cumsum(edges[:-1]) > 0


def _shared(found: DataFrame, hot: int) -> DataFrame:
    """(prefix, hot) of the prefixes of several documents; of more than `hot`, the prefix once more."""
    return (
        found.groupBy("prefix")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("prefix", F.when(F.col("n") > hot, F.col("prefix")).alias("hot"))
    )


def _marks(docs: DataFrame, length: int, lengths: tuple[int, ...], hot: int) -> DataFrame:
    """(doc_id, shared, hot) of the documents with shared prefixes; stored.

    Hot ones are those of any length that have too many documents; each round counts
    the next length, only where the one before was too common.
    """
    # One shuffle of the prefixes serves the aggregate and the join: both read
    # the same columns and drop the same nulls, so Spark makes it once.
    found = _prefixes(docs, length, lengths, 0).where("prefix is not null and doc_id is not null").repartition("prefix")
    marks = materialize(
        found.join(_shared(found, hot), "prefix").groupBy("doc_id")
        .agg(F.collect_set("prefix").alias("shared"), F.collect_set("hot").alias("hot"))
    )
    common = marks.where("size(hot) > 0")
    for level in range(1, len(lengths) - 1):
        if common.isEmpty():
            break
        texts = docs.join(common.select("doc_id", "hot"), "doc_id")
        found = materialize(_prefixes(texts, length, lengths, level))
        larger = found.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("prefix")
        more = found.join(larger, "prefix").groupBy("doc_id").agg(F.collect_set("prefix").alias("more"))
        marks = materialize(
            marks.join(more, "doc_id", "left")
            .select("doc_id", "shared", F.concat("hot", F.coalesce("more", F.array().cast("array<bigint>"))).alias("hot"), "more")
        )
        common = marks.where("more is not null").drop("more")
        marks = marks.drop("more")
    return marks


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, lengths: tuple[int, ...] = LENGTHS, hot: int = HOT
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), kept_sha256 of every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id is not null")
    marks = _marks(named, length, lengths, hot)
    # The texts are shuffled once, and cut into suffixes and later into what stays.
    texts = named.repartition("doc_id")
    suffixes = _suffixes(texts.join(marks, "doc_id", "left"), length, lengths)
    spans = _repeats(suffixes.where("not node"), length, lengths)
    if not marks.where("size(hot) > 0").isEmpty():
        single = suffixes.where("node").select("prefix", "words", "doc_id", "begin")
        owner = single.groupBy("prefix", "words").agg(F.min("doc_id").alias("owner"))
        spans = spans.union(
            single.join(owner, ["prefix", "words"]).where("doc_id > owner")
            .select("doc_id", "begin", (F.col("begin") + 1).alias("end"))
        )
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                total, removed, kept, digest = [], [], [], []
                cut = part.filter(part.column("spans").is_valid())
                sizes, gone = _covered(cut.column("text"), cut.column("spans"), length)
                at = 0
                marked = iter(sizes)
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").is_valid().to_pylist()):
                    words = (text or "").encode().split()
                    total.append(len(words))
                    if spans:
                        n = next(marked)
                        hit = gone[at : at + n].tolist()
                        at += n
                        words = [w for w, removed_ in zip(words, hit) if not removed_]
                    rest = b" ".join(words)
                    removed.append(total[-1] - len(words))
                    kept.append(rest)
                    digest.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest)],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    # Rows without an id are not compared, and stay where they are.
    unnamed = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").union(unnamed).mapInArrow(
        task, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    )
