"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

Method. A document is its set of distinct word shingles. A sketch of t
coordinates is filled in rounds: in round i < t every shingle is thrown into a
hashed bin, in round t + j all go to bin j; a bin keeps the smallest hash of
the first round that reached it. So every coordinate is filled, and two
coordinates agree with the probability of the sets' similarity, concentrated
as for sampling without replacement. Sketches are cut into bands; documents
that agree in a band are candidates, and every link is confirmed on full sets.

Documents with equal sets form one class and only its smallest id goes on.
Within a bucket not all pairs are listed: every member is held against one
leader, links are merged into components, and members whose component differs
from a second leader's are held against that one. Pairs within a component need
no test, so a bucket of thousands of copies costs about one comparison per
member. What is still apart is compared in full where the bucket has few
members. Members of crowded buckets are put into blocks of a bounded number of
shingles, and blocks that share a bucket are compared as matrices in one task
each; only links leave it.

A pair at similarity s is missed with probability (1 - s^r)^b over b bands of r
coordinates: 5e-6 at 0.75 with the defaults, less above.

Defined results. Null or empty text: 0 shingles, linked with nothing. Fewer
words than a shingle: the whole sequence is the one shingle. A null doc_id is
linked with nothing and has a null component. Repeated rows are one document
and each gets its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracestrata import materialize
from tracestrata.llm.components import components
from tracestrata.llm.joins import compact, sized
from tracestrata.llm.text import Words, mix, seeds, slices

SHINGLE = 5
SIMILARITY = 75
COORDINATES = 128
ROWS = 4
# Buckets with more members than this are compared in blocks of so many shingles.
CROWDED = 16
BLOCK = 300_000


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(column, lower=True)
    grams, whole = words.grams(size), words.whole(size)
    sets = []
    for first, count in zip(words.first.tolist(), words.count.tolist()):
        if count >= size:
            sets.append(np.unique(grams[first : first + count - size + 1]))
        elif count:
            part = words.hash[first : first + count] * seeds(count, stream=count + 1000)
            sets.append(mix(np.array([part.sum(dtype=np.uint64)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    assert len(whole) == len(grams)
    return sets


def sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t coordinates for each set; empty sets get the largest value throughout."""
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * t, unset, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return out.reshape(len(sets), t)
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size) * t
    for r, seed in enumerate(seeds(2 * t, stream=7)):
        hashed = mix(value ^ seed) & np.uint64(0xFFFFFFFFFFFFFFFE)  # never the value of an empty bin
        bins = ((hashed >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if r < t else r - t
        at = owner + bins
        free = out[at] == unset
        fresh = np.full(len(out), unset, np.uint64) if free.sum() * 8 > len(out) else None
        places, found = at[free], hashed[free]
        if fresh is None:  # few throws: sort them instead of touching every bin
            order = np.lexsort((found, places))
            places, found = places[order], found[order]
            new = np.ones(len(places), bool)
            new[1:] = places[1:] != places[:-1]
            out[places[new]] = found[new]
        else:
            np.minimum.at(fresh, places, found)
            out = np.where(out == unset, fresh, out)
        waiting = (out.reshape(len(sets), t) == unset).any(axis=1)
        going = waiting[owner // t]
        if not going.any():
            break
        if not going.all():
            value, owner = value[going], owner[going]
    return out.reshape(len(sets), t)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of every `rows` coordinates that is different from band to band."""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    total = (parts * seeds(rows, stream=11)).sum(axis=2, dtype=np.uint64)
    return mix(total + seeds(t // rows, stream=13)[None, :])


_SKETCHED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketched(docs: DataFrame, shingle: int, t: int, rows: int) -> DataFrame:
    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), shingle)
                size = np.array([len(s) for s in sets], np.int64)
                keys = bands(sketch(sets, t), rows).astype(np.int64)
                digest = [
                    np.array([mix(s ^ seed).sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
                    for seed in seeds(2, stream=17)
                ]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size), *map(pa.array, digest), lists],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(task, _SKETCHED)


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = materialize(
        docs.select("doc_id", "text").join(sized(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    )
    rows = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text"), "a")

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = (part.column(c).to_numpy() for c in ("a", "b"))
                ids, first = np.unique(np.concatenate([a, b]), return_index=True)
                left = first[first < len(a)]
                sets = dict(zip(a[left].tolist(), shingle_sets(part.column("text").take(pa.array(left)), shingle)))
                right = first[first >= len(a)] - len(a)
                sets |= dict(
                    zip(b[right].tolist(), shingle_sets(part.column("text_b").take(pa.array(right)), shingle))
                )
                keep = []
                for x, y in zip(a.tolist(), b.tolist()):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"]
                )

    return rows.select("a", "b", "text", "text_b").mapInArrow(task, "a long, b long")


def _links(left: list, right: list, percent: int, step: int = 128):
    """(a, b) of the rows (id, component, set) of both sides that are linked and of different components."""
    for i in range(0, len(left), step):
        for j in range(0, len(right), step):
            rows, columns = left[i : i + step], right[j : j + step]
            sides = []
            common = np.intersect1d(
                np.concatenate([r[2] for r in rows]), np.concatenate([c[2] for c in columns])
            )
            for part in (rows, columns):
                matrix = np.zeros((len(part), len(common)), np.float32)
                for k, (_, _, values) in enumerate(part):
                    matrix[k, np.searchsorted(common, values[np.isin(values, common, assume_unique=True)])] = 1
                sides.append(matrix)
            both = np.rint(sides[0] @ sides[1].T).astype(np.int64)
            sizes = [np.array([len(r[2]) for r in part]) for part in (rows, columns)]
            linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
            for x, y in zip(*np.nonzero(linked)):
                if rows[x][1] != columns[y][1]:
                    yield rows[x][0], columns[y][0]


def crowded_links(docs: DataFrame, members: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components within the buckets of `members` (bucket, leader, size, component).

    Documents whose buckets hang together are dealt into blocks of about `block`
    shingles; a block pair that shares a bucket is one task's work, of a bounded size.
    """
    tops = members.groupBy("bucket").agg(F.min("leader").alias("b"))
    ties = members.join(tops, "bucket").select(F.col("leader").alias("a"), "b").distinct()
    cluster = components(ties).toDF("leader", "cluster")
    # Dealt by hash into as many blocks as a cluster's size is worth; sizes are summed where the rows are.
    rows = members.select("leader", "size", "component").distinct().join(cluster, "leader")
    totals = sized(materialize(rows.groupBy("cluster").agg(F.sum("size").alias("total"))))
    part = F.pmod(F.xxhash64("leader"), F.ceil(F.col("total") / block))
    placed = materialize(
        rows.join(totals, "cluster").select("leader", "component", F.xxhash64("cluster", part).alias("block"))
    )
    blocks = members.join(placed.select("leader", "block"), "leader").select("bucket", "block").distinct()
    pairs = (
        blocks.toDF("bucket", "x").join(blocks.toDF("bucket", "y"), "bucket").where("x <= y")
        .select("x", "y").distinct()
    )
    texts = materialize(
        docs.withColumnRenamed("doc_id", "leader").join(sized(placed), "leader").dropDuplicates(["leader"])
    )
    sides = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        sets = shingle_sets(table.column("text").combine_chunks(), shingle)
        rows = list(zip(table.column("leader").to_pylist(), table.column("component").to_pylist(), sets))
        at = table.column("block").to_pylist()
        left, right = ([r for r, b in zip(rows, at) if b == side] for side in (x, y))
        found = sorted(_links(left, right, percent))
        return pa.table(
            {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
        )

    rows = sides.join(texts, "block").select("x", "y", "block", "leader", "component", "text")
    return rows.groupBy("x", "y").applyInArrow(task, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = SIMILARITY,
    coordinates: int = COORDINATES,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    seen = materialize(sketched(docs, shingle, coordinates, rows))
    key = ["set_a", "set_b", "n_shingles"]
    classes = materialize(
        seen.where("n_shingles > 0 and doc_id is not null").groupBy(*key)
        .agg(F.min("doc_id").alias("leader"), F.min_by("bands", "doc_id").alias("bands"))
    )
    member = classes.select("leader", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    crowded = member.join(
        member.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "bucket"
    )
    # The text that copies were made from shares more buckets with them than they
    # do with each other: held against it, most of them are linked at once.
    central = crowded.groupBy("leader").agg(F.sum("members").alias("central"))
    shared = compact(materialize(crowded.join(central, "leader").select("bucket", "leader", "size", "central")))
    # Sets whose sizes differ by more than the similarity allows are no candidates.
    fits = F.least("size", "top_size") * 100 >= F.greatest("size", "top_size") * percent

    def against(members: DataFrame, order) -> DataFrame:
        """Every member with the first of its bucket by `order`."""
        top = F.min(F.struct(order.alias("o"), F.struct("*").alias("row"))).alias("top")
        tops = members.groupBy("bucket").agg(top).select(
            "bucket", F.col("top.row.leader").alias("top"), F.col("top.row.size").alias("top_size"),
            F.col("top.row.component").alias("top_component"),
        )
        return (
            members.join(tops, "bucket").where(fits).where("leader <> top and component <> top_component")
            .select(F.least("leader", "top").alias("a"), F.greatest("leader", "top").alias("b")).distinct()
        )

    current = shared.withColumn("component", F.col("leader"))
    tested = merged = None
    orders = F.struct(-F.col("central"), "leader"), F.struct(F.xxhash64("leader", "bucket"), "leader")
    for order in (*orders, None):
        if order is not None:
            pairs = against(current, order)
        else:
            apart = current.groupBy("bucket").agg(
                F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")
            ).where("x <> y").select("bucket", "members")
            open_ = compact(materialize(current.drop("central").join(apart, "bucket")))
            few = open_.where(F.col("members") <= CROWDED).drop("members")
            other = few.toDF(*["bucket" if c == "bucket" else f"top_{c}" for c in few.columns])
            pairs = (
                few.join(other, "bucket").where("leader < top_leader and component <> top_component").where(fits)
                .select(F.col("leader").alias("a"), F.col("top_leader").alias("b"))
            )
            pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = compact(materialize(pairs))
        found = confirmed(docs, pairs, shingle, percent) if not pairs.isEmpty() else None
        if order is None:
            many = open_.where(F.col("members") > CROWDED).drop("members")
            if not many.isEmpty():
                links = crowded_links(docs, many, shingle, percent)
                found = links if found is None else found.union(links)
        if found is None:
            continue
        found = compact(materialize(found))
        tested = pairs if tested is None else tested.union(pairs)
        if merged is not None:  # what is known to be connected stays so
            found = found.union(merged.toDF("a", "b"))
        merged = compact(materialize(components(found).toDF("leader", "component")))
        # One narrow row per linked text is stored; the rows of all buckets are joined to it where they are.
        current = shared.join(sized(merged), "leader", "left").withColumn(
            "component", F.coalesce("component", "leader")
        )

    ends = classes.select(*key, "leader")
    if merged is not None:
        ends = ends.join(merged, "leader", "left").select(
            *key, F.coalesce("component", "leader").alias("component")
        )
    else:
        ends = ends.select(*key, F.col("leader").alias("component"))
    linked = seen.where("doc_id is not null").select("doc_id", *key).join(ends, key, "left")
    rest = seen.where("doc_id is null").select("doc_id", *key, F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "doc_id")
    return linked.unionByName(rest).select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
