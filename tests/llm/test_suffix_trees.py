"""Repeated passages against a table of all windows, for every way a group is split."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracestrata.llm import substring_dedup


def plain(rows, length):
    seen: dict = {}
    for i, text in rows:
        words = (text or "").split()
        for k in range(len(words) - length + 1):
            if i is not None:
                key = tuple(words[k : k + length])
                seen[key] = min(seen.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if i is not None and seen[tuple(words[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    def some(n, kinds=40):
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]
    passages = [some(n) for n in (13, 14, 20, 30, 60)]
    rows = []
    for i in range(120):
        words = some(rng.randint(0, 20), 400)
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "x"
            words += p[rng.randint(0, 4) :] + some(rng.randint(0, 6), 400)
        rows.append((i, " ".join(words)))
    common = " ".join(some(12))  # one word less than a window, in many documents
    rows += [(200 + i, f"a{i} {common} b{i} c{i} d{i}") for i in range(40)]
    rows += [(300, "r " * 50), (301, "r " * 20), (302, "q r " * 30), (303, None), (None, rows[3][1]), (None, None), (304, rows[5][1])]
    return rows


@pytest.mark.parametrize("hot", [100_000, 30, 5, 1])
def test_against_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "SORT_ROWS", 50)
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, prefix string, hot long")
    found = substring_dedup.remove_repeats(docs, hot=hot)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()), key=str)
    assert got == plain(rows, 13)


@pytest.mark.parametrize("seed", range(4))
def test_nodes_of_a_subtree(seed):
    """Every node `length` deep, its smallest document against all others."""
    rng = np.random.default_rng(seed)
    length, least = 13, substring_dedup.LENGTHS[0]
    prefix, doc, lead, windows, words = [], [], [], [], []
    for row in range(80):
        key = rng.integers(0, 3)
        minimiser = np.arange(least) + 1000 * key
        before = rng.integers(0, 2, length - least)
        after = rng.integers(0, 2, length - least)
        most = int(rng.integers(0, length - least + 1))
        last = int(rng.integers(0, most + 1))
        content = np.concatenate([before[len(before) - most :], minimiser, after])[: most - last + length]
        prefix.append(key), doc.append(int(rng.integers(0, 30))), lead.append(most), windows.append(most - last + 1)
        words.append(content.astype(np.uint64))
    found = substring_dedup.deep_nodes(*(np.array(v) for v in (prefix, doc, lead, windows)), words, length)
    for i in range(80):
        for d in range(length - least + 1):
            own = [tuple(words[k][lead[k] - d : lead[k] - d + length]) if lead[k] - windows[k] < d <= lead[k] else None for k in range(80)]
            expected = own[i] is not None and any(own[k] == own[i] and doc[k] < doc[i] for k in range(80))
            assert found[i, d] == expected


def test_words_of_a_minimiser_are_sent_as_one(spark):
    """A window alone takes 13 - 6 + 1 words; what is sent is enough to build it again."""
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id is not null")
    marks = substring_dedup._marks(docs, 13, substring_dedup.LENGTHS, 5)
    sent = substring_dedup._suffixes(docs.join(marks, "doc_id", "left"), 13, substring_dedup.LENGTHS).collect()
    texts = {i: substring_dedup.Words(pa.array([text])) for i, text in rows if i is not None}
    assert any(r["node"] for r in sent) and any(not r["node"] and r["windows"] > 1 for r in sent)
    for r in sent:
        got, text = np.frombuffer(r["words"], "<u8"), texts[r["doc_id"]]
        if r["node"]:
            assert got.tolist() == [text.grams(13).astype(np.uint64)[r["begin"]]]
            continue
        own = text.hash[r["begin"] : r["begin"] + r["windows"] + 12].tolist()
        at = r["lead"]
        own[at : at + 6] = [text.grams(6)[r["begin"] + at]]
        assert got.tolist() == own
