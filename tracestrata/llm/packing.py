"""Hierarchical multi-length packing of token documents.

Method. Tiers are context sizes, each a power of two. A document is cut into full
windows of the largest tier; what remains is routed to the smallest tier that holds
it. Then each tier is packed, the longest first: its longest piece opens a window, and
the gap is filled from the shorter tiers by best fit, that is by the longest piece that
still goes in; if all are longer, one is cut and its rest is routed again. So a window
of any tier is full when it is closed. Windows that stay open wait for the next block;
at the end of a task they are put together and cut into windows of the tiers, so at
most one window per task, with fewer tokens than the smallest tier, is padded.

Step groups hold windows of one tier and the same number of tokens in all tiers: `group`
windows of the largest, twice as many of half its size. Within a block they are balanced
by attention cost (sum of squared piece lengths).

A task packs the documents of its own partition, a bounded block of tokens at a
time: no shuffle, and a lost task is redone alone.

Token ids are those of the tokenizer file with special strings read as text; they are
made from the ranks file of the same vocabulary, as its package advises.

Defined results. Null text is empty and has the end token alone. Repeated rows
are separate documents. Null ids stay null. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracestrata.llm.text import slices

TOKENIZER = "byte_bpe_50k.tiktoken"
TIERS = (1024, 512, 256, 128)
END = 0
GROUP = 16
# Tokens a task holds at once, at four bytes each.
BLOCK = 1 << 20

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, window long, step_group long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
     ("window", pa.int64()), ("step_group", pa.int64())]
)


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The byte-pair merges are those of the ranks file, which holds the same
    vocabulary as the tokenizer file and gives the same ids.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def __call__(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()


class Packer:
    """Packs pieces (document, start, length) of one task into windows (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...], group: int):
        self.tiers, self.size, self.group = tuple(sorted(tiers, reverse=True)), max(tiers), group
        # Pieces of each tier that wait, the shortest first: (length, number, document, start).
        self.waiting: dict[int, list[tuple]] = {tier: [] for tier in self.tiers}
        self.open: dict[int, tuple[list[tuple], int]] = {}
        self.routed = 0

    def route(self, document: tuple, start: int, length: int) -> None:
        """To the smallest tier that holds the piece."""
        tier = min(t for t in self.tiers if t >= length)
        self.routed += 1
        insort(self.waiting[tier], (length, self.routed, document, start), key=lambda piece: piece[:2])

    def pack(self, documents: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
        """Windows that are full: (document, total, ...) cut, routed and packed tier by tier."""
        for document in documents:
            total = document[1]
            full = total // self.size * self.size
            for at in range(0, full, self.size):
                yield self.size, [(document, at, self.size)]
            if total > full:
                self.route(document, full, total - full)
        for tier in self.tiers:
            while (window := self._fill(tier)) is not None:
                yield tier, window

    def _fill(self, tier: int) -> list[tuple] | None:
        """The next full window of a tier; none if there is not enough, and then it stays open."""
        pieces, filled = self.open.pop(tier, ([], 0))
        if not pieces and self.waiting[tier]:
            length, _, document, start = self.waiting[tier].pop()
            pieces, filled = [(document, start, length)], length
        while 0 < filled < tier and (piece := self._fitting(tier - filled, tier)):
            pieces.append(piece)
            filled += piece[2]
        if filled == tier:
            return pieces
        if pieces:
            self.open[tier] = pieces, filled
        return None

    def _fitting(self, gap: int, tier: int) -> tuple | None:
        """The longest waiting piece that a gap holds, or else the beginning of one of the shortest."""
        shorter = [t for t in self.tiers if t <= tier]
        for t in shorter:
            if (at := bisect_right(self.waiting[t], gap, key=lambda piece: piece[0])):
                length, _, document, start = self.waiting[t].pop(at - 1)
                return document, start, length
        for t in reversed(shorter):
            if self.waiting[t]:
                length, _, document, start = self.waiting[t].pop(0)
                self.route(document, start + gap, length - gap)
                return document, start, gap
        return None

    def close(self) -> Iterator[tuple[int, list[tuple]]]:
        """What stays open, as windows of the tiers; the last may hold less than the smallest."""
        left = [piece for tier in self.tiers for piece in self.open.pop(tier, ([], 0))[0]][::-1]
        held = sum(length for _, _, length in left)
        while held:
            tier = next((t for t in self.tiers if t <= held), None)
            room = tier or held
            window, held = [], held - room
            while room:
                document, at, length = left.pop()
                taken = min(room, length)
                window.append((document, at, taken))
                if taken < length:
                    left.append((document, at + taken, length - taken))
                room -= taken
            yield tier or self.size, window

    def groups(self, windows: list[tuple[int, list[tuple]]]) -> list[int]:
        """Step group of each window: by tier, the costliest first to the cheapest group with room."""
        chosen, first = [0] * len(windows), 0
        for tier in self.tiers:
            own = [i for i, (t, _) in enumerate(windows) if t == tier]
            cost = {i: sum(length**2 for _, _, length in windows[i][1]) for i in own}
            size = self.group * self.size // tier
            n = -(-len(own) // size)
            # Groups of a block differ by one window at most.
            room = [len(own) // n + (g < len(own) % n) for g in range(n)]
            heap = [(0, g) for g in range(n)]
            for i in sorted(own, key=lambda i: -cost[i]):
                total, g = heapq.heappop(heap)
                chosen[i] = first + g
                room[g] -= 1
                if room[g]:
                    heapq.heappush(heap, (total + cost[i], g))
            first += n
        return chosen


def pack(
    docs: DataFrame,
    path: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    group: int = GROUP,
    block: int = BLOCK,
) -> DataFrame:
    """Pieces of every document of `docs` (doc_id, text): see SCHEMA.

    `ids` are the piece's token ids (little-endian, 32 bits each), `window` the
    context size of its sequence, `step_group` the group of sequences that one
    training step takes together.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    end = np.array([END], "<u4").tobytes()

    def task(batches):
        encode, packer = Encoder(path), Packer(tiers, group)
        base = TaskContext.get().partitionId() << 33
        given = given_groups = held = 0
        documents: list[tuple] = []

        def rows(windows):
            nonlocal given, given_groups
            out: list[list] = [[] for _ in _ARROW]
            chosen = packer.groups(windows)
            for (_, window), g in zip(windows, chosen):
                used = sum(length for _, _, length in window)
                full = used if used & (used - 1) == 0 else packer.size
                at = 0
                for (doc_id, total, ids), start, length in window:
                    piece = (doc_id, start, length, ids[4 * start : 4 * (start + length)], total,
                             base + given, at, full, base + given_groups + g)
                    for column, value in zip(out, piece):
                        column.append(value)
                    at += length
                given += 1
            given_groups += max(chosen, default=-1) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW
            )

        def packed(last=False):
            nonlocal documents, held
            windows = list(packer.pack(documents))
            if last:
                windows += packer.close()
            documents, held = [], 0
            if windows:
                yield rows(windows)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    documents.append((doc_id, len(ids) // 4, ids))
                    held += len(ids) // 4
                    if held >= block:
                        yield from packed()
        yield from packed(last=True)

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)
