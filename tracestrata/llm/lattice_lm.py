"""Subword lattice language model: a text's probability over all its segmentations.

Method. The pieces and first scores come from an existing vocabulary; a word is
the word mark and its characters, and every way to cut it into pieces counts.
Piece probabilities are re-estimated from the training words by expectation
maximisation: the forward and backward sums over each word's lattice give the
expected number of times each piece is used. The marginal log-probability of a
word is the forward sum over its lattice, in log space; a document's is the sum
over its words and the end. Characters that are no piece are spelt in bytes.
A training word is also one edge across its own lattice, with its discounted
relative frequency; what the discount saves is the weight of the pieces.

Each distinct word is scored once, not each occurrence. Documents travel as
blocks: one row per block and word with the places where it occurs; the row
meets the word's value in one join and goes back to its block.

What is learnt (word counts, piece counts) comes from all training rows. Only
the piece counts, as many as the vocabulary has pieces, reach the driver.

Defined results. Null text is empty: the end token alone. Repeated rows count
as often as they occur. A null doc_id is scored, and belongs to the training
rows. Without training rows the vocabulary's own scores are used. `docs` must
be a scan of stored data, so that a repeated task sees the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.text import Words, seeds, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
END = "\n"  # no word holds it
ROUNDS = 1
# Weight of the vocabulary's own scores beside the counts, in pieces.
PRIOR = 1000.0
# Taken from the count of every training word, for the pieces.
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20
# Words longer than this are scored one at a time.
LONG = 200
LOG10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Lattice:
    """Pieces with log-probabilities; scores words in arrays of equal length."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.asarray(logp, float)
        self.longest = max(map(len, pieces))
        self.power = seeds(1, stream=23)[0]
        self.byte = float(self.logp[[i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")]].mean())
        spelt = [(p, i) for i, p in enumerate(pieces) if not p.startswith("<0x") and p]
        self.index = dict(spelt)
        size = 1 << 18
        self.shift = np.uint64(64 - 18)
        self.keys, self.ids = np.zeros(size + 64, np.uint64), np.zeros(size + 64, np.int32)
        for piece, i in spelt:
            key = self._key(piece)
            at = int((np.array([key]) * self.power)[0] >> self.shift)
            while self.keys[at]:
                at += 1
            self.keys[at], self.ids[at] = key, i

    def _key(self, piece: str) -> np.uint64:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for c in piece:
                h = h * self.power + np.uint64(ord(c) + 1)
            return h

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that are pieces, their numbers)."""
        at = ((key * self.power) >> self.shift).astype(np.int64)
        rows = np.arange(len(key))
        hit_rows, hit_ids = [], []
        while len(rows):
            slot = self.keys[at]
            hit = slot == key[rows]
            hit_rows.append(rows[hit])
            hit_ids.append(self.ids[at[hit]])
            on = (slot != 0) & ~hit
            rows, at = rows[on], at[on] + 1
        return np.concatenate(hit_rows or [rows]), np.concatenate(hit_ids or [np.zeros(0, np.int32)])

    def forward(self, codes: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Log of the summed probability of all segmentations up to each character.

        `codes` has a row of code points per word. `edges` collects
        (start, end, rows, piece numbers) of every piece in the lattice.
        """
        n, length = codes.shape
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        byte_length = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        step = codes.astype(np.uint64) + np.uint64(1)
        for start in range(length):
            key = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                key = key * self.power + step[:, end - 1]
                rows, ids = self.find(key)
                if end == start + 1 and len(rows) < n:  # spelt in bytes
                    spelt = np.ones(n, bool)
                    spelt[rows] = False
                    add = alpha[spelt, start] + self.byte * byte_length[spelt, start]
                    alpha[spelt, end] = np.logaddexp(alpha[spelt, end], add)
                    if edges is not None:
                        edges.append((start, end, np.flatnonzero(spelt), None))
                if len(rows):
                    add = alpha[rows, start] + self.logp[ids]
                    alpha[rows, end] = np.logaddexp(alpha[rows, end], add)
                    if edges is not None:
                        edges.append((start, end, rows, ids))
        return alpha

    def expected(self, codes: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
        """Adds the expected uses of every piece in the weighted words to `counts`."""
        edges: list = []
        alpha = self.forward(codes, edges)
        n, length = codes.shape
        beta = np.full((n, length + 1), -np.inf)
        beta[:, length] = 0
        byte_length = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        total = alpha[:, length]
        for start, end, rows, ids in sorted(edges, key=lambda e: (-e[0], e[1])):
            logp = self.byte * byte_length[rows, start] if ids is None else self.logp[ids]
            add = beta[rows, end] + logp
            beta[rows, start] = np.logaddexp(beta[rows, start], add)
            used = np.exp(alpha[rows, start] + add - total[rows]) * weight[rows]
            if ids is None:
                counts[-1] += float((used * byte_length[rows, start]).sum())
            else:
                np.add.at(counts, ids, used)

    def long_word(self, word: str) -> float:
        """The forward sum of one word, character by character."""
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = 0.0
        for start in range(len(word)):
            ways = [
                (end, self.logp[self.index[word[start:end]]])
                for end in range(start + 1, min(len(word), start + self.longest) + 1)
                if word[start:end] in self.index
            ]
            if not ways or ways[0][0] != start + 1:
                ways.append((start + 1, self.byte * len(word[start].encode("utf-8", "surrogatepass"))))
            for end, logp in ways:
                a, b = alpha[end], alpha[start] + logp
                high = max(a, b)
                alpha[end] = high + math.log(math.exp(a - high) + math.exp(b - high))
        return alpha[-1]

    def by_length(self, words: list[str], limit: int = 1 << 18):
        """(places, code points) of the words with the mark, equal lengths together."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order])) + 1
        for part in np.split(order, edges):
            if not len(part):
                continue
            length = int(size[part[0]]) + 1
            step = max(1, limit // length)
            for first in range(0, len(part), step):
                at = part[first : first + step]
                text = "".join([MARK + words[i] for i in at.tolist()])
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                yield at, codes.reshape(len(at), length)

    def scores(self, words: list[str]) -> np.ndarray:
        """Marginal log-probability of each word."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        place = np.array(short, np.int64)
        for at, codes in self.by_length([words[i] for i in short]):
            out[place[at]] = self.forward(codes)[:, -1]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long_word(MARK + w)
        return out


def vocabulary(path: str | None = None) -> Lattice:
    """The pieces of an existing vocabulary; its ranks or log-probabilities as first scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    kept = [
        i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))
    ]
    score = np.array([model.get_score(i) for i in kept], float)
    pieces = [model.id_to_piece(i) for i in kept]
    spelt = np.array([not model.is_byte(i) for i in kept])
    if np.all(score == np.round(score)):  # ranks: as probabilities by Zipf's law
        score = -np.log(np.where(spelt, -score, len(kept)) + 10.0)
    return Lattice(pieces, score - np.logaddexp.reduce(score))


def _word_rows(docs: DataFrame, postings: bool) -> DataFrame:
    """One row per block and distinct word: (word, count in training rows) or (word, block, places)."""

    def task(batches):
        task_id, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                found = Words(part.column("text"), lower=True)
                held = np.array(part.column("held_out"))
                order = np.argsort(found.hash, kind="stable")
                sorted_hash = found.hash[order]
                new = np.ones(len(order), bool)
                new[1:] = sorted_hash[1:] != sorted_hash[:-1]
                edge = np.append(np.flatnonzero(new), len(order))
                n = part.num_rows
                word = _spelt(found, order[edge[:-1]])
                doc = found.doc[order]
                if postings:
                    # Places in ascending order of the row, two bytes each where that is enough.
                    kind = "<u2" if n <= 1 << 16 else "<u4"
                    places = np.concatenate([doc, np.arange(n)]).astype(kind).tobytes()
                    ends = np.append(edge, len(order) + n).astype(np.int64) * np.dtype(kind).itemsize
                    block = (task_id << 33) + made
                    made += 1
                    lists = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(word), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(places)]
                    ).cast(pa.binary())
                    ids = [None] * (len(word) - 1) + [_ids(part.column("doc_id"), held)]
                    yield pa.RecordBatch.from_arrays(
                        [word, pa.array(np.full(len(word), block)), lists, pa.array(ids, pa.binary())],
                        names=["word", "block", "places", "ids"],
                    )
                else:
                    learnt = np.add.reduceat(np.append(~held[doc], 0), edge[:-1]) if len(order) else []
                    count = np.append(learnt, (~held).sum()).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([word, pa.array(count)], names=["word", "count"])

    schema = "word string, block long, places binary, ids binary" if postings else "word string, count long"
    return docs.mapInArrow(task, schema)


def _spelt(found: Words, which: np.ndarray) -> pa.Array:
    """Some of the words, and the end."""
    # The bytes as a list that holds words and what lies between them in turn.
    ends = np.stack([found.start, found.stop], axis=1).ravel()
    bytes_ = pa.py_buffer(found.data.tobytes())
    ends = np.append(ends, len(found.data)).astype(np.int64)
    turns = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), bytes_])
    chosen = turns.take(pa.array(2 * which)).cast(pa.binary())
    return pa.concat_arrays([chosen, pa.array([END.encode()], pa.binary())]).cast(pa.string())


def _ids(doc_id: pa.Array, held: np.ndarray) -> bytes:
    """A block's documents: ids, whether they are null, whether they are held out."""
    ids = doc_id.cast(pa.int64()).fill_null(0)
    null = np.array(doc_id.is_null())
    return np.array(ids, "<i8").tobytes() + null.astype("u1").tobytes() + held.astype("u1").tobytes()


def learn(words: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """Piece log-probabilities from the training words (word, count), and that of the end."""
    lattice = vocabulary(path)
    first, end = np.exp(lattice.logp), 0.0
    ends = words.where(F.col("word") == END).agg(F.sum("count")).first()[0] or 0
    byte = [i for i, p in enumerate(lattice.pieces) if len(p) == 6 and p.startswith("<0x")]
    for _ in range(rounds):

        def task(batches, lattice=lattice):
            counts = np.zeros(len(lattice.pieces) + 1)
            for batch in batches:
                given = batch.column("word").to_pylist()
                weight = np.array(batch.column("count"), float)
                short = np.array([i for i, w in enumerate(given) if len(w) <= LONG], np.int64)
                for at, codes in lattice.by_length([given[i] for i in short.tolist()]):
                    lattice.expected(codes, weight[short[at]], counts)
                for i, w in enumerate(given):
                    if len(w) > LONG:
                        codes = np.frombuffer((MARK + w).encode("utf-32-le", "surrogatepass"), "<u4")
                        lattice.expected(codes.reshape(1, -1), weight[i : i + 1], counts)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["piece", "uses"]
            )

        known = words.where((F.col("count") > 0) & (F.col("word") != END))
        uses = known.mapInArrow(task, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        counts = np.zeros(len(first) + 1)
        for row in uses.collect():  # at most one row per piece of the vocabulary
            counts[row["piece"]] = row["uses"]
        spelt = counts[:-1].copy()
        spelt[byte] += counts[-1] / len(byte)
        weighed = spelt + PRIOR * first
        whole = weighed.sum() + ends + 1
        end = math.log((ends + 1) / whole)
        lattice = Lattice(lattice.pieces, np.log(weighed / whole))
    return lattice, end


def score(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    words = materialize(_word_rows(docs, False).groupBy("word").agg(F.sum("count").alias("count")))
    total = words.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.when(F.col("count") > 0, 1)).alias("v")
    ).first()
    n, v = total["n"], total["v"]
    lattice, end = learn(words, path, rounds)

    def valued(batches):
        for batch in batches:
            given = batch.column("word").to_pylist()
            value = lattice.scores(given)
            value[[w == END for w in given]] = end
            if n:  # the whole word as one edge more
                own = np.maximum(np.array(batch.column("count")) - DISCOUNT, 0) / n
                with np.errstate(divide="ignore"):
                    value = np.logaddexp(np.log(own), value + math.log(DISCOUNT * v / n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("count"), pa.array(value / LOG10)],
                names=["word", "count", "value"],
            )

    values = words.mapInArrow(valued, "word string, count long, value double")
    rows = _word_rows(docs, True).join(values, "word").select("block", "places", "ids", "count", "value")

    def summed(batches):
        """A task holds the blocks dealt to it: a few megabytes of places each."""
        held = [pa.Table.from_batches([batch]) for batch in batches if batch.num_rows]
        if not held:
            return
        got = pa.concat_tables(held)
        del held
        block, value, count = (got.column(c).to_numpy() for c in ("block", "value", "count"))
        places = got.column("places").cast(pa.large_binary()).combine_chunks()
        named = got.column("ids")
        ends = np.flatnonzero(np.asarray(named.is_valid()))  # one row of a block has its documents
        ids = dict(zip(block[ends].tolist(), named.take(pa.array(ends)).to_pylist()))
        del got, named
        # One order of summation, whatever order rows arrive in.
        order = np.lexsort((count, value, block))
        edge = np.flatnonzero(np.diff(block[order])) + 1
        for at in np.split(order, edge):
            own = places.take(pa.array(at))
            size = np.asarray(pc.binary_length(own), np.int64)
            start, end = np.frombuffer(own.buffers()[1], np.int64)[own.offset + np.array([0, len(own)])]
            yield _finished(value[at], count[at], size, own.buffers()[2][start:end], ids[int(block[at[0]])])

    def _finished(value, count, size, places, ids):
        n_docs = len(ids) // 10
        kind = "<u2" if n_docs <= 1 << 16 else "<u4"
        size = size // np.dtype(kind).itemsize
        place = np.frombuffer(places, kind)
        count, value = np.repeat(count.astype(np.int64), size), np.repeat(value, size)
        base = np.log10((count + 1) / (n + v + 1))
        sums = [np.bincount(place, w, n_docs) for w in (base, value)]
        id_, null, held = (
            np.frombuffer(ids[:8 * n_docs], "<i8"), np.frombuffer(ids[8 * n_docs : 9 * n_docs], "u1"),
            np.frombuffer(ids[9 * n_docs :], "u1"),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(id_, mask=null.astype(bool)), pa.array(held.astype(bool)),
             pa.array(np.bincount(place, minlength=n_docs)),
             pa.array(np.bincount(place[count > 0], minlength=n_docs)),
             pa.array(np.full(n_docs, n)), *map(pa.array, sums)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return rows.repartition("block").mapInArrow(
        summed,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
