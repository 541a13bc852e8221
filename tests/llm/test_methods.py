"""Operators against brute force, and every query that has SQL against DuckDB."""

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tests_shared import FOLDER, canonical, connect  # noqa: I001
from tracestrata.llm import html_text, lattice_lm, near_duplicates, packing, queries, secrets, toxicity
from tracestrata.llm.text import Words

pytestmark = pytest.mark.skipif(FOLDER is None, reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    result = connect().execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "<0x41>"]
    logp = np.log(np.array([0.2, 0.2, 0.1, 0.2, 0.1, 0.1, 0.1]))
    lattice = lattice_lm.Lattice(pieces, logp)
    for word in ("abab", "b", "aaba", "a" * 30):
        text = lattice_lm.MARK + word
        ways = 0.0
        for cuts in itertools.product((0, 1), repeat=min(len(text) - 1, 12)):
            if len(text) > 13:
                break
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:])]
            if all(p in lattice.index for p in parts):
                ways += math.exp(sum(logp[lattice.index[p]] for p in parts))
        got = lattice.scores([word])[0]
        assert math.isclose(got, lattice.long_word(text), rel_tol=1e-9)
        if len(text) <= 13:
            assert math.isclose(got, math.log(ways), rel_tol=1e-9)


def test_expected_counts_cover_every_character():
    lattice = lattice_lm.vocabulary()
    counts = np.zeros(len(lattice.pieces) + 1)
    codes = np.frombuffer("▁the".encode("utf-32-le"), "<u4").reshape(1, -1)
    lattice.expected(codes, np.array([3.0]), counts)
    assert math.isclose(sum(c * len(p) for c, p in zip(counts, lattice.pieces)), 12.0, rel_tol=1e-6)


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, block=5000).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["window"]))
    for parts in sequences.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
        assert at <= window <= 1024
    for doc_id, text in texts.items():
        own = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == doc_id)
        ids = np.frombuffer(b"".join(i for _, i in own), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    used = sum(r["length"] for r in rows)
    whole = sum(parts[0][2] for parts in sequences.values())
    assert whole - used < 1024  # one task: one window at most is not full


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(1)
    for common in (400, 150, 40):
        base = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = np.unique(base[: 400 + (400 - common) // 2]), np.unique(base[(400 - common) // 2 :][:400])
        both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_duplicates.sketch([a, b], 1024)
        assert abs((x == y).mean() - both) < 0.06
    filled = near_duplicates.sketch([np.array([5], np.uint64)], 64)
    assert (filled != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_crowded_blocks_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(120, 5, replace=False):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_duplicates, "CROWDED", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    sets = near_duplicates.shingle_sets(pa.array([t for _, t in rows]))
    least = list(range(60))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(60), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common) and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert got == dict(enumerate(least))


def test_base_secrets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    expected = {}
    for r in docs.collect():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(r["text"]) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r["text"]) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", r["text"]) if len(m[0]) >= 32]
        expected[r["doc_id"]] = [(k, a, b) for a, _, k, b in sorted(spans)]
    got = secrets.find_secrets(docs)
    for r in got.collect():
        assert [tuple(s) for s in r["spans"] if s["kind"] != "random"] == expected[r["doc_id"]]


def test_battery_tells_keys_from_text(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(rng.choice(letters, 40)) for _ in range(40)]
    plain = ["internationalizationprocedures", "some_long_snake_case_identifier", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa",
             "0000000000000000000000000000", "path/to/some/longer/file-name", "Thisisalongwordwithoutanyspace"]
    docs = spark.createDataFrame([(i, f"x {v} y") for i, v in enumerate(keys + plain)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.find_secrets(docs).where("size(spans) > 0").collect()}
    assert len(found & set(range(40))) >= 38 and not found - set(range(40))


def test_toxic_clauses():
    matcher = toxicity.Matcher({"idiot": 1.0}, {})
    plain, targeted, negated, reported = (
        matcher.features(t)[:4] for t in ("What an idiot.", "You are an idiot.", "Not an idiot.", "She said idiot.")
    )
    assert plain.tolist() == [1, 0, 0, 0] and targeted.tolist() == [0, 1, 0, 0]
    assert negated.tolist() == [0, 0, 1, 0] and reported.tolist() == [0, 0, 0, 1]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    chain = html_text.Chain(rng.normal(size=html_text.FEATURES), rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, html_text.FEATURES))
    emit = x @ chain.weights

    def value(path):
        return sum(e * p for e, p in zip(emit, path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))

    assert tuple(chain.viterbi(x)) == max(itertools.product((0, 1), repeat=7), key=value)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [{r["doc_id"] for r in docs.collect()}]
    from tracestrata import scratch_dir

    for name, stage in corpus_pipeline.STAGES[:-1]:
        where = scratch_dir(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(where)
        before, docs = docs, spark.read.parquet(where)
        assert docs.columns == before.columns
        ids.append({r["doc_id"] for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    assert ids[-1] == ids[-2]  # secrets are masked, not dropped
    assert docs.where("text rlike '[0-9a-f]{32}'").count() == 0
    packed = {r["doc_id"] for r in corpus_pipeline.pack_tokens(spark, docs, FOLDER).collect()}
    assert packed == ids[-1]


def test_false_discovery_control_is_the_step_up_procedure(spark):
    rng = np.random.default_rng(7)
    rows = [(f"v{i}", ("hex", "base62")[i % 2], int(i % 3), float(p)) for i, p in enumerate(np.concatenate([rng.uniform(size=300), rng.uniform(size=60) * 1e-4]))]
    tested = spark.createDataFrame(rows, "value string, encoding string, length_class int, p double")
    for rate in (0.001, 0.05, 0.5):
        got = {r["value"] for r in secrets.rejected(tested, "p", rate).where("rejected").collect()}
        plain, slack = set(), set()
        for group in {r[1:3] for r in rows}:
            own = sorted((p, v) for v, e, c, p in rows if (e, c) == group)
            for out, grown in ((plain, math.exp(1 / secrets.BINS_PER_UNIT)), (slack, 1.0)):
                last = max((k for k, (p, _) in enumerate(own, 1) if p * grown <= rate * k / len(own)), default=0)
                out |= {v for _, v in own[:last]}
        assert plain <= got <= slack  # bins round p-values up by a tenth of a unit at most


def test_spans_are_swept_like_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for row in range(60):
        for _ in range(rng.integers(0, 12)):
            start = int(rng.integers(0, 60))
            kind = ("random", "random", "hex", "assign")[rng.integers(0, 4)]
            rows.append((row, kind, start, start + int(rng.integers(1, 15))))
    got = {tuple(r) for r in secrets._apart(spark.createDataFrame(rows, "row long, kind string, start long, stop long")).collect()}
    expected = set()
    for row, kind, a, b in rows:
        own = [r for r in rows if r[0] == row]
        free = [(x, y) for _, k, x, y in own if k == "random" and not any(f[1] != "random" and f[2] < y and x < f[3] for f in own)]
        if kind == "random" and (a, b) in free and not any(x <= a and b <= y and (x, y) != (a, b) for x, y in free):
            expected.add((row, kind, a, b))
    assert got == expected


def test_words_are_cut_out_together():
    """The distinct words of a block, without a Python object for each."""
    texts = ["b  a\té a", "", None, "B " + "x" * 300, " ünd "]
    found = Words(pa.array(texts), lower=True)
    which = np.array([4, 0, 2, 6, 1, 5])
    assert lattice_lm._spelt(found, which).to_pylist() == ["b", "b", "é", "ünd", "a", "x" * 300, "\n"]
    assert lattice_lm._spelt(Words(pa.array([None, " "])), np.zeros(0, np.int64)).to_pylist() == ["\n"]
