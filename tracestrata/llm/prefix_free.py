"""Repeated byte strings by prefix-free parsing: dictionary and parse combine into corpus order.

Parsing. A rolling hash runs over every text. Of the first TRIGGERS hashes from a
position on, the smallest is that position's trigger; whoever shares the trigger is
one phrase: the bytes from the first such position to `length` behind the last. Equal
strings have their trigger at the same place, whatever stands around them, and the
bytes from the trigger on that all of them share make the phrase's key.

Corpus order. Two strings of `length` bytes are equal if their triggers have equal
bytes before and behind them. So the suffixes of a key's phrases are put in order from
two arrays: the parse positions, sorted by what follows the trigger, and the dictionary
phrases, sorted by what leads to it, each with the lengths its neighbours have in common.
A start `d` bytes before the trigger needs a neighbour that agrees in `d` bytes before
and `length - d` behind.

Only what may repeat goes that far. Phrases whose key occurs once are dropped by a
count; phrases that occur twice as a whole repeat as a whole; bytes are fetched for the
rest, once for each distinct phrase of a key that has several. A task parses equal texts
twice at most, phrases are counted before they are shuffled, and a key with more than
`crowded` phrases is settled by counting fingerprints of single strings instead, so no
task gets an unbounded group.

Texts go by their 128-bit hash. They are parsed where they lie and shuffled once, to
meet the wanted phrases and in the end what is removed of them.

Defined results. Strings are bytes of UTF-8, within one row. Null text: empty. Every
row is a document of its own, whatever its doc_id, which may be null. Texts shorter
than `length` keep everything.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracestrata import materialize
from tracestrata.llm.text import _bytes, mix, seeds, slices

LENGTH = 200
# Bytes of the rolling hash.
WINDOW = 16
# Positions from which a trigger is chosen, as a share of the length: the rest of it makes the key.
KEY = 50
CROWDED = 20_000
# Rows of phrases that are put in order at a time, at about 400 bytes each.
ORDER_ROWS = 20_000
SLICE = 1 << 18
_POSITION = 21  # bits of a position in a slice


@cache
def _table(stream: int) -> np.ndarray:
    return seeds(256, stream=stream)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number modulo 2^64, and their inverses."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    return tuple(
        np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)
        for b in (base, inverse)
    )


class Rolling:
    """Hashes of any part of some bytes."""

    def __init__(self, data: np.ndarray, stream: int = 101):
        size = 1 << max(12, int(len(data)).bit_length())
        powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table(stream)[data] * powers[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size : size + n] - self.sums[:n]) * self.inverse[:n])


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each `size` neighbours."""
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x


def phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first start, trigger, last start, key, phrase hash) arrays of the texts between `offsets`, part by part."""
    triggers = length - KEY + 1
    for begin in range(0, len(data), SLICE):
        part = data[begin : begin + SLICE + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            return
        rolling = Rolling(part)
        hashes = rolling.windows(WINDOW)[: n + triggers - 1]
        mask = np.uint64((1 << _POSITION) - 1)
        place = np.arange(len(hashes), dtype=np.uint64)
        at = (_least((hashes & ~mask) | place, triggers) & mask).astype(np.int64)[:n]
        # Strings that end in the text they begin in.
        edge = offsets[(offsets > begin) & (offsets < begin + len(part))] - begin
        inside = np.ones(n + 1, bool)
        for e in edge.tolist():
            inside[max(0, e - length + 1) : min(e, n)] = False
        inside[n] = False
        head = inside[:n].copy()
        head[1:] &= ~inside[: n - 1] | (at[1:] != at[:-1])
        lo = np.flatnonzero(head)
        if not len(lo):
            continue
        tail = inside[:n].copy()
        tail[:-1] &= ~inside[1:n] | (at[1:] != at[:-1])
        hi = np.flatnonzero(tail)
        anchor = at[lo]
        yield (lo + begin, anchor + begin, hi + begin, rolling.of(anchor, anchor + KEY).astype(np.int64),
               rolling.of(lo, hi + length).astype(np.int64))


# A place: first start, bytes to the trigger, starts after the first, and whether the task had the text before.
def _pack(lo, left, span, again):
    return (lo << 17) | (left << 9) | (span << 1) | again


def _unpack(place):
    return place >> 17, (place >> 9) & 255, (place >> 1) & 255


def _parse(length: int):
    """Phrases of the texts; of equal ones only the first two, the second one marked."""

    def fresh(batch: pa.RecordBatch, seen: dict) -> tuple[list[int], list[int]]:
        rows, again = [], []
        for k, name in enumerate(zip(batch.column("h").to_pylist(), batch.column("h2").to_pylist())):
            times = seen.get(name, 0)
            if times < 2:
                seen[name] = times + 1
                rows.append(k)
                again.append(times)
        return rows, again

    def task(batches):
        seen: dict = {}
        for batch in batches:
            rows, again = fresh(batch, seen)
            if len(rows) < batch.num_rows:
                batch = batch.take(pa.array(rows, pa.int64()))
            again = np.array(again, np.int64)
            done = 0
            for part in slices(batch, "text", SLICE):
                data, offsets = _bytes(part.column("text"))
                ids = [part.column(c).to_numpy(zero_copy_only=False) for c in ("h", "h2")]
                for lo, anchor, hi, key, phrase in phrases(data, offsets, length):
                    doc = np.searchsorted(offsets, lo, "right") - 1
                    place = _pack(lo - offsets[doc], anchor - lo, hi - lo, again[done + doc])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(phrase), pa.array(ids[0][doc]), pa.array(ids[1][doc]), pa.array(place)],
                        names=["key", "phrase", "h", "h2", "place"],
                    )
                done += part.num_rows

    return task


_PHRASE = "key long, h long, h2 long, begin long, span int, settled boolean, lead binary, rest binary"


def _fetch(length: int):
    """The bytes of the wanted phrases of each text, before and from the trigger on; of equal texts once."""
    names = ("key", "h", "h2", "begin", "span", "settled", "lead", "rest")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def task(batches):
        seen: set = set()
        for batch in batches:
            for k, name in enumerate(zip(batch.column("h").to_pylist(), batch.column("h2").to_pylist())):
                if name in seen:
                    continue
                seen.add(name)
                raw = memoryview(batch.column("text")[k].as_buffer())
                wanted = batch.column("wanted")[k].as_py()
                for first in range(0, len(wanted), ORDER_ROWS):
                    rows = []
                    for w in wanted[first : first + ORDER_ROWS]:
                        lo, left, span = _unpack(w["place"])
                        rows.append((w["key"], *name, lo, span, w["settled"], bytes(raw[lo : lo + left]),
                                     bytes(raw[lo + left : lo + span + length])))
                    arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    return task


def _padded(keys: np.ndarray, column: pa.Array, width: int, backward: bool) -> np.ndarray:
    """One row of bytes each: the key, then the column's bytes (the last first, if backward), then zeros."""
    size = np.asarray(pc.binary_length(column), np.int64)
    out = np.zeros((len(size), 8 + width), np.uint8)
    out[:, :8] = keys.astype(">i8").view(np.uint8).reshape(-1, 8)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    place = np.arange(width)
    body = np.zeros((len(size), width), np.uint8)
    if backward:
        body[place >= width - size[:, None]] = data
        out[:, 8:] = body[:, ::-1]
    else:
        body[place < size[:, None]] = data
        out[:, 8:] = body
    return out


def _in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and how many bytes each has in common with the one before it."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(len(order), np.int64)
    step = max(1, (8 << 20) // width)
    for first in range(1, len(order), step):
        at = order[first - 1 : first + step]
        differ = rows[at[1:]] != rows[at[:-1]]
        common[first : first + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeated(keys: np.ndarray, lead: pa.Array, rest: pa.Array, span: np.ndarray, length: int) -> np.ndarray:
    """For each phrase and each distance to its trigger, whether another phrase has that string as well."""
    n = len(keys)
    left = np.asarray(pc.binary_length(lead), np.int64)
    by_lead, lead_common = _in_order(_padded(keys, lead, length - KEY, True))
    by_rest, rest_common = _in_order(_padded(keys, rest, length, False))
    out = np.zeros((n, length - KEY + 1), bool)
    dictionary, parse = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(length - KEY + 1):
        rows = np.flatnonzero((left >= d) & (left - span <= d))
        if len(rows) < 2:
            continue
        dictionary[by_lead] = np.cumsum(lead_common < 8 + d)
        parse[by_rest] = np.cumsum(rest_common < 8 + length - d)
        pair = dictionary[rows] * (n + 1) + parse[rows]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        hit = np.zeros(len(rows), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        out[rows[hit], d] = True
    return out


_SPAN = "h long, h2 long, begin long, end long"


def _combine(length: int):
    """Spans of the phrases that occur once, from all phrases of their keys."""

    def of(rows: pa.RecordBatch) -> pa.RecordBatch:
        span = rows.column("span").to_numpy().astype(np.int64)
        found = repeated(rows.column("key").to_numpy(), rows.column("lead"), rows.column("rest"), span, length)
        found[rows.column("settled").to_numpy(zero_copy_only=False)] = False
        edge = np.zeros((len(span), found.shape[1] + 2), np.int8)
        edge[:, 1:-1] = found
        step = np.diff(edge, axis=1)
        owner, near = np.nonzero(step == 1)  # the last start of a run, counted from the trigger
        far = np.nonzero(step == -1)[1] - 1
        left = np.asarray(pc.binary_length(rows.column("lead")), np.int64)[owner]
        begin = rows.column("begin").to_numpy()[owner] + left
        ids = [rows.column(c).to_numpy()[owner] for c in ("h", "h2")]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[0]), pa.array(ids[1]), pa.array(begin - far), pa.array(begin - near + length)],
            names=["h", "h2", "begin", "end"],
        )

    def ready(parts: list[pa.RecordBatch]):
        for rows in pa.Table.from_batches(parts).combine_chunks().to_batches():
            yield of(rows)

    def task(batches):
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            waiting.append(batch)
            held += batch.num_rows
            cut = int(np.searchsorted(keys, keys[-1]))  # sorted: where the last key begins
            if held >= ORDER_ROWS and cut:
                waiting[-1] = batch.slice(0, cut)
                yield from ready(waiting)
                waiting, held = [batch.slice(cut)], batch.num_rows - cut
        if waiting:
            yield from ready(waiting)

    return task


def _strings(length: int):
    """Two fingerprints of every string of a crowded phrase."""

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["lead"] + r["rest"], np.uint8)
                one, two = (Rolling(data, stream).windows(length).astype(np.int64) for stream in (102, 103))
                n = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(n, r["h"], np.int64)),
                     pa.array(np.full(n, r["h2"], np.int64)), pa.array(r["begin"] + np.arange(n, dtype=np.int64))],
                    names=["one", "two", "h", "h2", "begin"],
                )

    return task


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch put together."""
    runs: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if runs and begin <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(runs[-1][1], end)
        else:
            runs.append((begin, end))
    return runs


def _cut(schema: pa.Schema):
    """What is removed of each text: runs of bytes, and the digest of the rest."""

    def task(batches):
        for batch in batches:
            removed, digests, spans = [], [], []
            marked = batch.column("marked")
            for k, text in enumerate(batch.column("text")):
                raw = memoryview(text.as_buffer())
                runs = _runs([(m["begin"], m["end"]) for m in marked[k].as_py() or []])
                digest, at = hashlib.sha256(), 0
                for begin, end in runs:
                    digest.update(raw[at:begin])
                    at = end
                digest.update(raw[at:])
                removed.append(sum(end - begin for begin, end in runs))
                digests.append(digest.hexdigest())
                spans.append([{"begin": begin, "end": end} for begin, end in runs])
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()),
                       pa.array(spans, schema.field("spans").type), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return task


def kept(text: Column, spans: Column) -> Column:
    """The bytes of `text` outside `spans`."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))

    def add(seen, s):
        piece = F.substring(data, (seen["at"] + 1).cast("int"), (s["begin"] - seen["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(seen["out"], piece).alias("out"))

    return F.aggregate(
        spans, start, add,
        lambda seen: F.concat(seen["out"], F.substring(data, (seen["at"] + 1).cast("int"), F.octet_length(data))),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin and end of each removed run), kept_sha256 of every row of `docs`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("2"), "text").alias("h2"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    parse = named.where(F.col("n_bytes") >= length).select("h", "h2", "text").mapInArrow(
        _parse(length), "key long, phrase long, h long, h2 long, place long"
    )
    again = F.col("place").bitwiseAND(1)
    # Stored, as is all that is joined by key below: joins then shuffle plain rows on both
    # sides, and Spark can split a key that has most of them.
    shared = materialize(
        parse.groupBy("key").agg((F.count("*") + F.max(again)).alias("n")).where("n > 1").select("key")
    )
    found = materialize(parse.join(shared, "key"))
    dictionary = materialize(
        found.groupBy("key", "phrase").agg(
            (F.count("*") + F.max(again) > 1).alias("settled"), F.first("h").alias("h"), F.first("h2").alias("h2"),
            F.first("place").alias("place"),
        )
    )
    # Phrases that occur twice: all their strings do.
    whole = dictionary.where("settled").select("key", "phrase")
    lo, span = F.shiftright("place", 17), F.shiftright("place", 1).bitwiseAND(255)
    spans = found.join(whole, ["key", "phrase"]).select("h", "h2", lo.alias("begin"), (lo + span + length).alias("end"))
    # Phrases that occur once, of keys with several: their bytes tell.
    several = materialize(
        dictionary.groupBy("key").agg(F.count("*").alias("phrases"), F.count_if(~F.col("settled")).alias("single"))
        .where("phrases > 1 and single > 0").select("key", (F.col("phrases") > crowded).alias("crowd"))
    )
    entry = F.struct("key", "place", "settled")
    wanted = (
        dictionary.join(several, "key").groupBy("h", "h2", "crowd").agg(F.collect_list(entry).alias("wanted"))
    )
    # Both joins of the texts take all their columns, so that one shuffle serves them.
    texts = ["doc_id", "n_bytes", "h", "h2", "text"]
    fetched = named.select(texts).join(wanted, ["h", "h2"])

    def of(crowd: bool) -> DataFrame:
        rows = fetched.where(F.col("crowd") if crowd else ~F.col("crowd"))
        return rows.select(*texts, "wanted").mapInArrow(_fetch(length), _PHRASE)

    grouped = of(False).repartition("key").sortWithinPartitions("key")
    strings = of(True).mapInArrow(_strings(length), "one long, two long, h long, h2 long, begin long")
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    spans = (
        spans.union(grouped.mapInArrow(_combine(length), _SPAN))
        .union(strings.join(twice, ["one", "two"]).select("h", "h2", "begin", (F.col("begin") + length).alias("end")))
    )
    marked = spans.groupBy("h", "h2").agg(F.collect_set(F.struct("begin", "end")).alias("marked"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = (
        f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<begin: bigint, end: bigint>>, kept_sha256 string"
    )
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return named.select(texts).join(marked, ["h", "h2"], "left").select(*texts, "marked").mapInArrow(_cut(schema), ddl)
