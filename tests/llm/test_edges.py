"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from tracestrata.llm import (
    decontaminate, html_text, lattice_lm, near_duplicates, packing, quality, secrets, substring_dedup,
    toxicity, url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, score double, spans string, prefix long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 1, "x", 0.1, "s", 1),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None, None),
    (4, " \t\n ", None, "a", 3, None, None, None, None),
    (5, LONG, "en", "a", 9, None, None, None, None),
    (6, LONG, "en", "a", 9, None, None, None, None),
    (None, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen.", "en", "a", 1, None, None, None, None),
    (7, "a" * 50_000, "en", "a", 9, None, None, None, None),
    (8, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" idiot", "en", "a", 9, None, None, None, None),
    (8, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" idiot", "en", "a", 9, None, None, None, None),
    (9, "ÉÀ\u00a0ü 😀 word", "fr", "b", 9, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (8, 0, 1), (None, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, pos long")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=lambda r: (r[0] is None, r))


def test_quality(docs, none):
    got = by_id(quality.quality(docs), "n_words", "base_failed", "kept")
    assert len(got) == len(ROWS) and got[1] == (2, 0, True, False) and got[4][1] == 30_000
    assert quality.quality(none).count() == 0


def test_lattice(docs, none):
    got = by_id(lattice_lm.score(docs), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert len(got) == len(ROWS) and got[1][1] == 1 and all(r[5] < 0 for r in got)
    assert got[7] == got[8]
    assert lattice_lm.score(none).count() == 0


def test_toxicity(docs, labels, none):
    for given in (labels, labels.limit(0)):
        got = by_id(toxicity.score(docs, given), "score", "predicted")
        assert len(got) == len(ROWS) and all(0 <= r[1] <= 1 for r in got)
        assert toxicity.without_toxic(docs, given).columns == docs.columns
    assert toxicity.score(none, labels).count() == 0


def test_secrets(docs, none):
    got = by_id(secrets.find_secrets(docs), "spans")
    assert len(got) == len(ROWS) and got[7] == got[8]
    assert [(s["kind"], s["start"], s["stop"]) for s in got[7][1]] == [("assign", 0, 49), ("hex", 9, 49)]
    assert secrets.find_secrets(none).count() == 0


def test_secrets_behind_names_and_in_paths(spark):
    value = "24be64439e3e49cf46b2d7c9"
    mixed = "q7Rk2LxV9bTz0WmYc4HsPd8N"
    texts = [f"sid={value}", f"https://a.org/path/{value}/end?x=1", f"sid={value.upper()}&b=2", f"key-{mixed}", f"live_{mixed} x",
             f"a={mixed}==", value]
    spark_docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["stop"]] for s in r["spans"]] for r in secrets.find_secrets(spark_docs).collect()}
    # The whole of 3 and 4 looks random too; the longest span is kept.
    assert got == {0: [value], 1: [value], 2: [value.upper()], 3: [texts[3]], 4: [texts[4][:-2]], 5: [mixed + "=="], 6: [value]}


def test_every_row_is_masked_by_its_own_spans(spark):
    import corpus_pipeline

    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [(1, f"one {key} end"), (1, f"a longer beginning {key}"), (1, "nothing to hide in this text at all, nothing whatever"),
             (None, f"without id {key}"), (None, "clean"), (2, None)]
    rows = spark.createDataFrame([(i, t, t and len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.redact_secrets(spark, rows, "").collect()]
    masked = [(i, t and t.replace(key, "[SECRET]")) for i, t in texts]
    assert sorted(got, key=str) == sorted(((i, t, t and len(t)) for i, t in masked), key=str)


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (5, 6)} == {rows_total(rows, 5)}
    assert packing.pack(none).count() == 0


def rows_total(rows, doc_id):
    return sum(r["length"] for r in rows if r["doc_id"] == doc_id)


def test_decontaminate(spark, docs, none):
    items = items_of(spark, [(1, "two, three FOUR", 1), (2, None, 1), (3, "", 1), (None, "five six", 1), (1, "absent words", 1), (4, "two three four", 1)])
    got = by_id(decontaminate.decontaminate(docs, items), "n_words", "n_hit", "items", "contaminated")
    assert len(got) == len(ROWS) and got[0] == (1, 14, 3, ["1", "4"], True) and got[1] == (2, 0, 0, [], False)
    assert decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(none, items).count() == 0


def test_proximity(spark, docs):
    windows = decontaminate.test_windows(items_of(spark, [(1, "two three five", 1)]))
    index = decontaminate.build_index(docs)
    assert decontaminate.phrase_matches(index, windows).count() == 0
    found = {(r["doc_id"], r["window"]) for r in decontaminate.proximity_matches(index, windows, 1).collect()}
    assert {d for d, _ in found} == {1}


def test_near_passages(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    inserted = passage.replace("epsilon", "very epsilon")
    swapped = passage.replace("beta gamma", "gamma beta")
    far = passage.replace("alpha ", "") + " a b c alpha"
    texts = [f"x {passage} y", f"x {inserted} y", f"{swapped} y", far, "alpha beta gamma", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = items_of(spark, [(7, passage, 1)])
    got = by_id(decontaminate.decontaminate(docs, items, slack=decontaminate.SLACK), "n_hit", "contaminated", "n_near", "near_items")
    assert got == [(0, 10, True, 1, ["7"]), (1, 0, False, 1, ["7"]), (2, 0, False, 1, ["7"]), *[(i, 0, False, 0, []) for i in (3, 4, 5)]]


@pytest.mark.parametrize("hot", [250_000, 1])
def test_repeats(docs, none, hot):
    got = by_id(substring_dedup.remove_repeats(docs, hot=hot), "n_words", "n_removed")
    assert len(got) == len(ROWS)
    assert got[4][1:] == (30_000, 0) and got[5][1:] == (30_000, 30_000) and got[-1][2] == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_near_duplicates(docs, none):
    got = by_id(near_duplicates.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert len(got) == len(ROWS) and got[1] == (2, 0, 2, True) and got[5][2:] == (5, False)
    assert got[-1] == (None, 10, None, True)
    assert near_duplicates.near_duplicates(none).count() == 0


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/1"), (5, "http://a.net/es/2?x"), (5, "http://a.net/es/2?x"), (None, "x://org#f")]


def test_urls(spark):
    pages = spark.createDataFrame([(*u, "c", "d") for u in URLS], "page_id long, url string, host string, rule string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()), key=str)
    assert (4, "www.example.com", "/en/1", "www.example.com/en/", "allow") in got
    assert got.count((5, "a.net", "/es/2", "net/es/", "block")) == 2 and (1, "", "", None, "allow") in got
    assert (None, "org", "", None) in {r[:4] for r in got} and len(got) == len(URLS)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_tree_goes_down_the_whole_path(spark):
    urls = [f"http://a.org/shop/en/{k}/{w}" for k in ("casino", "help") for w in ("x", "y")]
    urls += [f"http://b.org/user/{chr(97 + i // 26)}{chr(97 + i % 26)}/posts/{w}" for i in range(40) for w in ("old", "new")]
    urls += [f"http://c.org/p/q/r/{chr(97 + i // 26)}{chr(97 + i % 26)}/end" for i in range(40)] + ["http://c.org/p/q/r"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["path"]: r["template"] for r in url_filter.templates(pages).collect()}
    assert got["/shop/en/casino/x"] == "shop/en/casino/x" and got["/shop/en/help/x"] == "shop/en/help/x"
    assert {t for p, t in got.items() if p.startswith("/user/")} == {"user/*/posts/old", "user/*/posts/new"}
    assert {t for p, t in got.items() if p.startswith("/p/q/r/")} == {"p/q/r/*/end"} and got["/p/q/r"] == "p/q/r"


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>"</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1><p>First  part<br>goes on.<p><b>Second</b> &lt;one&gt; is longer, and ends here.
<aside>Read also this</aside><div class=comments><p>Nice post!</div></article><footer>&copy; 2020</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain & text"), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    text = "Title & more\n\nFirst part goes on.\n\nSecond <one> is longer, and ends here."
    assert got[0] == got[1] == (1, text, len(text)) and got[2] == (2, "", 0) and got[3] == (3, "", 0)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_head_without_an_end():
    def texts(page):
        return [b.text for b in html_text.blocks(page)]

    assert texts("<html><head><title>T</title><body><p>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert texts("<head><meta charset=x><title>T<body><p>One.") == ["One."]
    assert texts("<head><title>A <b>b</b></title><style>p {}</style><link href=x><div>One.</div>") == ["One."]
    assert texts("<head><title>T</title> One <b>two</b>.<p>Three.") == ["One two.", "Three."]
    assert texts("<head><title>T</title></head><body>One.</body>") == ["One."]


def test_capital_letters_beyond_ascii():
    matcher = toxicity.Matcher({"crétin": 1.0, "estúpido": 1.0, "ärger": 1.0, "idiot": 1.0}, {})
    for text in ("CRÉTIN va.", "Quel CrÉtin.", "Ärger hier.", "ÄRGER", "¡Estúpido!", "«idiot» dit", "Ce n'est rien. “Idiot” ici."):
        assert matcher.features(text)[4] == 1, text
    assert matcher.features("Rien ici. Décrétine aussi.")[4] == 0


def test_near_passages_against_plain(spark):
    """Every window of every item at every place of every document."""
    import random
    import re

    rng = random.Random(3)
    kinds = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(kinds) for _ in range(n))) for i, n in enumerate((3, 10, 12, 14, 25))]
    texts = []
    for i in range(80):
        words = [rng.choice(kinds) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(passage))
                passage = passage[:at] + [rng.choice(["new", "x"])] + passage[at:] if rng.random() < 0.6 else passage[:at] + passage[at + 1 :] or ["x"]
            words += passage
        texts.append((i, " ".join(words)))
    slack = decontaminate.SLACK

    def cut(words):
        return [words[k : k + 10] for k in range(max(1, len(words) - 9))] if words else []

    split = {i: [w for w in re.split(r"[^0-9a-z]+", text) if w] for i, text in texts}
    uses: dict = {}
    for words in split.values():
        for w in words:
            uses[w] = uses.get(w, 0) + 1

    def near(words, window):
        """A start is where the rarest term puts it; every other term is within the slack of its place."""
        if any(w not in uses for w in window):
            return False
        place = min(range(len(window)), key=lambda j: (uses[window[j]], j))
        return any(
            all(any(0 <= p - place + j + s < len(words) and words[p - place + j + s] == w for s in range(-slack, slack + 1)) for j, w in enumerate(window))
            for p, word in enumerate(words) if word == window[place]
        )

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.decontaminate(docs, items_of(spark, [(i, t, 1) for i, t in items]), slack=slack)
    for r in found.collect():
        words = split[r["doc_id"]]
        assert r["near_items"] == sorted(str(i) for i, t in items if any(near(words, w) for w in cut(t.split())))
        assert set(r["items"]) <= set(r["near_items"])
