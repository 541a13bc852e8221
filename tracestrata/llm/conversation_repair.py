"""Repair of conversations: square-root checkpointed dynamic programming.

The roles of a repaired conversation read `(s?(ua)+)?`: nothing, or an optional
system turn and then user and assistant turns by turns. Four states know how
far a conversation is; an edit is Keep, Rerole, Delete or Insert. The cheapest
cost from a row to the end, one number a state, follows from the vector behind
the row. Those vectors are kept at every square-root-th row only; walking
forward, one block of them is recomputed at a time, and at each row the
ASCII-least edit that keeps the cost minimal (a tight one) is taken.

Conversations may be of any length. Rows are ordered by range partitioning, so
one conversation may lie in many partitions. What a piece of it does to the
vectors is a 4 x 4 matrix of smallest sums; the driver gets the matrices of the
first and last piece of each partition (never more than two a partition),
multiplies them backward, and hands each piece the vector behind it: the outer
checkpoints. A second look tells at which state each piece is left, so all
pieces are then repaired at the same time.

Defined results. Null role or text: one space. Rows are taken by turn, nulls
first, then by role and text. Equal rows are counted, not listed, before
anything is shuffled; all but the first are duplicates. A null conv_id is a
conversation of its own. Turns that no repair leaves give an empty audit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracestrata import materialize
from tracestrata.llm.joins import stored

# Costs of the edits, blanks, and what may end a text.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
# The state that a user or assistant turn, written or inserted, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60

# Rows and bytes of text of a partition; a task holds one partition's piece of a conversation at most.
PART_ROWS = 100_000
PART_BYTES = 16 << 20
# A chunk of repaired text on its way to a digest.
CHUNK = 1 << 20
BATCH = 4_096


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of what the damage leaves, and one row without copies for each conv_id."""

    def written(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text, role = written("text"), written("role")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their `copies` (none: the mark that there is such a conversation) and faults.

    `first`: no earlier row has this role and text, so one copy is no duplicate.
    """
    mark = F.col("copies") == 0
    kept = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # Of each conversation one mark, so that one whose rows were all dropped is not forgotten.
    marks = rows.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"),
    )
    kept = stored(kept)
    seen = kept.groupBy("conv_id", "role", "text").agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("low"), F.count("*").alias("turns")
    ).where("turns > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "unnumbered", "low"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t"))
    first = F.col("unnumbered").isNull() | F.col("turn").isNull() | (~F.col("unnumbered") & (F.col("turn") == F.col("low")))
    told = kept.join(seen, same, "left").withColumn("first", first).select(*kept.columns, "first")
    shown = F.rtrim("text", F.lit(BLANKS))
    return told.unionByName(marks.withColumn("first", F.lit(True))).select(
        "conv_id", "turn", "role", "text", "copies",
        F.when(F.col("copies") == 0, "").when(shown == "", "blank").when(~F.col("first"), "duplicate")
        .when(~F.right(shown, F.lit(1)).isin(*ENDS), "truncated").otherwise("").alias("fault"),
        mark.alias("mark"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over range partitions of bounded size, with the number of their partition as `part`."""
    rows = stored(rows)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // PART_ROWS), -(-(size["bytes"] or 0) // PART_BYTES))
    keys = [F.asc_nulls_first("conv_id"), F.desc("mark"), F.asc_nulls_first("turn"), "role", "text"]
    laid = rows.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    return materialize(laid.withColumn("part", F.spark_partition_id()))


def _closed(cost: list[int]) -> list[int]:
    """Costs with any number of inserts before what comes."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return cost


END = _closed([0, FAR, FAR, 0])


def before(symbol: tuple[str, str], after: list[int]) -> list[int]:
    """Costs before a row (initial of its role, fault) from those behind it."""
    initial, fault = symbol
    cost = [DELETE + c for c in after]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        kept = KEEP.get(initial)
        for s in range(4):
            cost[s] = min(cost[s], REROLE + extra + after[NEXT[s]])
            if kept and kept[s] is not None:
                cost[s] = min(cost[s], extra + after[kept[s]])
    return _closed(cost)


def tight(symbol: tuple[str, str], state: int, here: list[int], after: list[int]) -> tuple[str, int, int]:
    """The ASCII-least edit of least cost, its cost and the state it leads to; after an insert the row is still to come."""
    initial, fault = symbol
    if DELETE + after[state] == here[state]:
        return "D", DELETE, state
    if INSERT + here[NEXT[state]] == here[state]:
        return "I", INSERT, NEXT[state]
    extra = TRUNCATED if fault == "truncated" else 0
    kept = KEEP.get(initial)
    if kept and kept[state] is not None and extra + after[kept[state]] == here[state]:
        return "K", extra, kept[state]
    return "R", REROLE + extra, NEXT[state]


def walk(symbols: list[tuple[str, str]], state: int, behind: list[int]) -> Iterator[tuple[int, str, int, int]]:
    """(row, edit, cost, state after it) of a piece that is entered in `state`, with the costs behind it.

    Holds the square root of its rows in checkpoints and one block of vectors.
    """
    n = len(symbols)
    block = max(1, math.isqrt(n))
    points = {n: behind}
    vector = behind
    for i in range(n - 1, -1, -1):
        vector = before(symbols[i], vector)
        if i % block == 0:
            points[i] = vector
    for begin in range(0, n, block):
        end = min(n, begin + block)
        vectors = [points[end]]
        for i in range(end - 1, begin - 1, -1):
            vectors.append(before(symbols[i], vectors[-1]))
        vectors.reverse()
        for i in range(begin, end):
            while True:
                edit, cost, state = tight(symbols[i], state, vectors[i - begin], vectors[i - begin + 1])
                yield i, edit, cost, state
                if edit != "I":
                    break


def ending(state: int) -> Iterator[tuple[int, int]]:
    """(cost, state) of the inserts that end a conversation."""
    while END[state]:
        state = NEXT[state]
        yield INSERT, state


def matrix(symbols: list[tuple[str, str]]) -> list[list[int]]:
    """For each state behind the piece, the costs before it to get there."""
    columns = []
    for t in range(4):
        vector = [0 if s == t else FAR for s in range(4)]
        for symbol in reversed(symbols):
            vector = before(symbol, vector)
        columns.append(vector)
    return columns


def _through(columns: list[list[int]], behind: list[int]) -> list[int]:
    return [min(columns[t][s] + behind[t] for t in range(4)) for s in range(4)]


class Piece:
    """The rows of one conversation in one partition, as Arrow batches."""

    def __init__(self, part: int, conv_id):
        self.part, self.conv_id, self.rows = part, conv_id, []

    def symbols(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for r in self.rows:
            fault = r["fault"]
            out += [(r["role"][:1], fault)] * min(1, r["copies"])
            again = "blank" if fault == "blank" else "duplicate"
            out += [(r["role"][:1], again)] * (r["copies"] - 1)
        return out

    def texts(self) -> Iterator[dict]:
        for r in self.rows:
            for k in range(r["copies"]):
                yield r if not k or r["fault"] == "blank" else r | {"fault": "duplicate"}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    piece = None
    for batch in batches:
        for r in batch.to_pylist():
            if piece is None or piece.conv_id != r["conv_id"]:
                if piece is not None:
                    yield piece
                piece = Piece(r["part"], r["conv_id"])
            piece.rows.append(r)
    if piece is not None:
        yield piece


def _outer(pieces: Iterator[Piece]) -> Iterator[Piece]:
    """The first and the last piece."""
    last = None
    for k, piece in enumerate(pieces):
        if not k:
            yield piece
        else:
            last = piece
    if last is not None:
        yield last


def _text_of(value) -> str | None:
    return None if value is None else str(value)


_OUTER = "part int, conv string, last boolean, n long, costs array<long>, initial string"


def _matrices(batches):
    rows = []
    for piece in _outer(_pieces(batches)):
        symbols = piece.symbols()
        costs = [c for column in matrix(symbols) for c in column]
        initial = symbols[-1][0] if symbols else None
        rows.append({"part": piece.part, "conv": _text_of(piece.conv_id), "last": bool(rows), "n": len(symbols),
                     "costs": costs, "initial": initial})
    if rows:
        schema = pa.schema([("part", pa.int32()), ("conv", pa.string()), ("last", pa.bool_()), ("n", pa.int64()),
                            ("costs", pa.list_(pa.int64())), ("initial", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Chains:
    """The outer checkpoints: what each piece of a conversation in several partitions must know.

    (part, conv) -> costs behind it, state it is entered in, initial of the turn before it, whether it ends.
    At most two entries a partition.
    """

    def __init__(self, found: list):
        self.behind: dict = {}
        self.before: dict = {}
        self.enter: dict = {}
        self.last: set = set()
        found = sorted(found, key=lambda r: (r["part"], r["last"]))
        chain: list = []
        self.chains = []
        for r in found:
            if chain and (chain[-1]["conv"] != r["conv"] or chain[-1]["part"] == r["part"]):
                self._add(chain)
                chain = []
            chain.append(r)
        self._add(chain)

    def _add(self, chain: list) -> None:
        if len(chain) < 2:
            return
        self.chains.append([(r["part"], r["conv"]) for r in chain])
        self.last.add(self.chains[-1][-1])
        vector = END
        for r in reversed(chain):
            self.behind[r["part"], r["conv"]] = vector
            vector = _through([r["costs"][4 * t : 4 * t + 4] for t in range(4)], vector)
        initial = None
        for r in chain:
            self.before[r["part"], r["conv"]] = initial
            initial = r["initial"] if r["n"] else initial

    def entered(self, exits: dict) -> None:
        for chain in self.chains:
            state = START
            for key in chain:
                self.enter[key] = state
                state = exits[key][state]


def _exits(chains: Chains):
    def task(batches):
        rows = []
        for piece in _outer(_pieces(batches)):
            key = piece.part, _text_of(piece.conv_id)
            if key in chains.behind:
                symbols, out = piece.symbols(), []
                for state in range(4):
                    for _, _, _, state in walk(symbols, state, chains.behind[key]):  # noqa: B007
                        pass
                    out.append(state)
                rows.append({"part": key[0], "conv": key[1], "exits": out})
        if rows:
            schema = pa.schema([("part", pa.int32()), ("conv", pa.string()), ("exits", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return task


_EDIT = "part int, place long, opened boolean, edit string, cost long, fault string, illegal boolean, role string, text string"


def _edits(chains: Chains, schema: pa.Schema):
    def of(piece: Piece) -> Iterator[dict]:
        key = piece.part, _text_of(piece.conv_id)
        state, behind = chains.enter.get(key, START), chains.behind.get(key, END)
        texts, initial, at, row = piece.texts(), chains.before.get(key), -1, None
        base = {"conv_id": piece.conv_id, "part": piece.part, "opened": key in chains.behind}
        empty = base | {"turn": None, "edit": "", "cost": 0, "fault": "", "illegal": False, "role": None, "text": None}
        yield empty
        for i, edit, cost, state in walk(piece.symbols(), state, behind):
            if i != at:
                at, row = i, next(texts)
                now = row["role"][:1]
                illegal = initial is not None and initial + now not in ("su", "ua", "au")
                initial = now
            if edit == "I":
                yield empty | {"edit": "I", "cost": cost, "role": ROLE[state], "text": ""}
                continue
            role = ROLE[state] if edit == "R" else row["role"]
            kept = {} if edit == "D" else {"role": role, "text": row["text"]}
            yield empty | kept | {"edit": edit, "cost": cost, "illegal": illegal, "turn": row["turn"], "fault": row["fault"]}
        if key not in chains.behind or key in chains.last:
            for cost, state in ending(state):
                yield empty | {"edit": "I", "cost": cost, "role": ROLE[state], "text": ""}

    def task(batches):
        out, place = [], 0
        for piece in _pieces(batches):
            for r in of(piece):
                out.append(r | {"place": place})
                place += 1
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return task


def repair(rows: DataFrame) -> DataFrame:
    """The edits that repair conversations (conv_id, turn, role, text, copies), in order.

    One row an edit: conv_id, turn, part and place (its order), edit (K, R, D or
    I), cost, the row's fault, whether the turn before it makes it illegal, and
    the role and text that stay (null if deleted). Each piece of a conversation
    begins with a row without an edit, so conversations without rows are there.
    """
    flagged = faults(rows.select("conv_id", "turn", "role", "text", "copies"))
    laid = ordered(flagged)
    chains = Chains(laid.mapInArrow(_matrices, _OUTER).collect())
    if chains.chains:
        found = laid.mapInArrow(_exits(chains), "part int, conv string, exits array<int>").collect()
        chains.entered({(r["part"], r["conv"]): r["exits"] for r in found})
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {_EDIT}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return laid.mapInArrow(_edits(chains, schema), ddl)


class Report:
    """What is told of one conversation, or of one piece of it."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.low = self.high = None
        self.turns = self.lines = 0
        self.audit = bytearray()
        self.hash = hashlib.sha256()

    def edit(self, r: dict) -> bytes:
        """Takes an edit; returns what it adds to the repaired text."""
        self.audit += r["edit"].encode()
        self.counts["cost"] += r["cost"]
        self.counts["illegal"] += r["illegal"]
        if r["fault"]:
            self.counts[r["fault"]] += 1
        if r["turn"] is not None:
            self.turns += self.high != r["turn"]
            self.low = r["turn"] if self.low is None else self.low
            self.high = r["turn"]
        if r["role"] is None:
            return b""
        self.lines += 1
        return (b"\n" if self.lines > 1 else b"") + f"{r['role']}:{r['text']}".encode()

    def take(self, chunk: dict) -> None:
        """Takes a later piece, as `row` tells it."""
        for name in self.COUNTS:
            self.counts[name] += chunk[name]
        if chunk["low"] is not None:
            self.turns += chunk["turns"] - (self.high == chunk["low"])
            self.low = chunk["low"] if self.low is None else self.low
            self.high = chunk["high"]
        if chunk["lines"]:
            self.hash.update(b"\n" if self.lines else b"")
            self.hash.update(chunk["repaired"])
            self.lines += chunk["lines"]
        self.audit += chunk["audit"].encode()

    def row(self, part: int, seq: int, opened: bool, repaired: bytes | None) -> dict:
        return self.counts | {
            "conv_id": self.conv_id, "part": part, "seq": seq, "opened": opened, "low": self.low, "high": self.high,
            "turns": self.turns, "lines": self.lines, "audit": self.audit.decode(), "repaired": repaired,
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "repaired_sha256": self.hash.hexdigest(),
        }


_REPORT = (
    "part int, seq long, opened boolean, low long, high long, turns long, lines long, gaps long, blank long, "
    "duplicate long, truncated long, illegal long, cost long, audit string, repaired binary, repaired_sha256 string"
)


def _reports(schema: pa.Schema):
    def of(batches) -> Iterator[dict]:
        report, part, seq, opened, text = None, 0, 0, False, bytearray()

        def told():
            return report.row(part, seq, opened, bytes(text) if opened else None)

        for batch in batches:
            for r in batch.to_pylist():
                if not r["edit"]:  # a piece begins
                    if report is not None:
                        yield told()
                    report, part, seq, opened, text = Report(r["conv_id"]), r["part"], 0, r["opened"], bytearray()
                    continue
                added = report.edit(r)
                if not opened:
                    report.hash.update(added)
                    continue
                text += added
                if len(text) >= CHUNK:
                    yield told()
                    report, seq, text = Report(r["conv_id"]), seq + 1, bytearray()
        if report is not None:
            yield told()

    return lambda batches: _batched(of(batches), schema)


def _joined(schema: pa.Schema):
    def of(batches) -> Iterator[dict]:
        report = None
        for batch in batches:
            for chunk in batch.to_pylist():
                if report is None or report.conv_id != chunk["conv_id"]:
                    if report is not None:
                        yield report.row(0, 0, False, None)
                    report = Report(chunk["conv_id"])
                report.take(chunk)
        if report is not None:
            yield report.row(0, 0, False, None)

    return lambda batches: _batched(of(batches), schema)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + len(r["audit"]) + len(r["repaired"] or b"")
        if size >= CHUNK:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def report(edits: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of repaired conversations.

    A conversation that lies in one partition is told there. Those in several are sent on
    in chunks and joined in order; a digest is a sequence by its nature, so one task reads
    all chunks of such a conversation, but it holds one at a time.
    """
    ddl = f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {_REPORT}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    told = materialize(edits.mapInArrow(_reports(schema), ddl))
    chunks = told.where("opened").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    joined = chunks.mapInArrow(_joined(schema), ddl)
    return told.where("not opened").union(joined).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
