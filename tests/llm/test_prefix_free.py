"""Prefix-free parsing against a table of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from tests_shared import FOLDER  # noqa: I001
from tracestrata.llm import prefix_free


def plain(rows, length):
    """The query's rows from (doc_id, text) by counting every string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def got(df):
    kept = prefix_free.kept
    df = df.select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", kept(df["text"], df["spans"]).alias("rest"))
    return sorted(((r[0], r[1], r[2], len(r[3]), r[4], bytes(r[5])) for r in df.collect()), key=str)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long, h string")
    # Texts are put back by row for the comparison.
    found = prefix_free.remove_repeats(docs.selectExpr("struct(doc_id, key) as doc_id", "text", "key", "h"), **options)
    back = found.selectExpr("doc_id.doc_id as doc_id", "doc_id.key as key", "n_bytes", "n_removed", "spans", "kept_sha256")
    return got(back.join(docs.select("key", "text"), "key"))


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "é", "日本", "one", "x", "repeat", "0000", "a b", "\n"]
    def some(n):
        return " ".join(rng.choice(words) + rng.choice(["", str(rng.randint(0, 99))]) for _ in range(n))
    passages = [some(n) for n in (30, 60, 90, 200)]
    rows = []
    for i in range(60):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                cut = rng.randint(0, len(p) - 1)
                p = p[cut:] if rng.random() < 0.5 else p[:cut]
            if rng.random() < 0.3:
                at = rng.randint(0, len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [p, some(rng.randint(0, 20))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    line = "=" * 150 + " a line that many share " + "-" * 60
    rows += [(100 + i, f"{some(8)} {line} {some(8)}") for i in range(12)]
    rows += [(200, "a" * 199), (201, "a" * 150 + "b" * 150), (202, "b" * 250), (203, "ab" * 300), (204, "abc" * 100), (205, "a" * 201)]
    rows += [(300, rows[3][1]), (300, rows[3][1]), (None, rows[5][1] + "x"), (None, None), (301, ""), (302, some(3)), (302, some(400))]
    return rows


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_against_plain(spark, crowded):
    rows = corpus(1)
    assert run(spark, rows, crowded=crowded) == plain(rows, 200)


@pytest.mark.parametrize("length", [64, 120])
def test_other_lengths(spark, length):
    rows = corpus(2)
    assert run(spark, rows, length=length) == plain(rows, length)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "SLICE", 700)
    monkeypatch.setattr(prefix_free, "ORDER_ROWS", 3)
    rows = corpus(3)
    assert run(spark, rows) == plain(rows, 200)


def test_empty_table(spark):
    assert run(spark, [(1, None)])[0][:4] == (1, 0, 0, 0)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert prefix_free.remove_repeats(docs).count() == 0


def test_table(spark):
    if FOLDER is None:
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = prefix_free.remove_repeats(docs).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in found) == [r[:5] for r in sorted(plain(rows, 200))]
