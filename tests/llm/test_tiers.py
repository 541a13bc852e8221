"""Packing by tiers, and pages that are made to be slow."""

import random
import time
from collections import Counter

import pytest

from tracestrata.llm import html_text, packing


def packed(lengths, block=None, tiers=packing.TIERS, group=4):
    """[(tier, pieces)] and step groups, of documents given by their lengths."""
    packer = packing.Packer(tiers, group)
    documents = [(i, n) for i, n in enumerate(lengths)]
    step = block or len(documents) or 1
    windows = [w for k in range(0, len(documents), step) for w in packer.pack(documents[k : k + step])]
    windows += packer.close()
    return windows, packer.groups(windows)


@pytest.mark.parametrize("seed, block", [(1, None), (2, 7), (3, 50)])
def test_every_token_lies_in_one_full_window(seed, block):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 127, 128, 129, 300, 400, 511, 512, 700, 1023, 1024, 1025, 3000]) + rng.randint(0, 3) for _ in range(400)]
    windows, _ = packed(lengths, block)
    seen = Counter()
    for tier, pieces in windows:
        for (i, _), start, length in pieces:
            assert length > 0
            for token in range(start, start + length):
                seen[i, token] += 1
        assert tier in packing.TIERS
    assert len(seen) == sum(lengths) and set(seen.values()) == {1}
    partial = [(tier, pieces) for tier, pieces in windows if sum(p[2] for p in pieces) != tier]
    assert len(partial) <= 1 and all(sum(p[2] for p in pieces) < min(packing.TIERS) for _, pieces in partial)


def test_documents_go_to_the_smallest_tier_that_holds_them():
    windows, _ = packed([400] * 40)
    assert {tier for tier, _ in windows[:-4]} == {512}
    windows, _ = packed([200] * 40 + [100] * 40)
    assert Counter(tier for tier, _ in windows)[256] >= 30
    windows, _ = packed([128] * 10 + [256] * 10 + [1024] * 10)
    assert Counter(tier for tier, _ in windows) == {128: 10, 256: 10, 1024: 10}


def test_gaps_of_long_windows_take_the_best_fitting_shorter_pieces():
    windows, _ = packed([900, 124, 100, 300])
    first = windows[0]
    assert first[0] == 1024 and sorted(p[2] for p in first[1]) == [124, 900]
    # Nothing fits: a piece is cut, and its rest is routed again.
    windows, _ = packed([1000, 200])
    assert [sorted(p[2] for p in pieces) for _, pieces in windows] == [[24, 1000], [128], [48]]


def test_step_groups_hold_one_tier_and_equal_work():
    rng = random.Random(5)
    windows, groups = packed([rng.randint(1, 1500) for _ in range(3000)], group=4)
    by_group: dict = {}
    for (tier, pieces), g in zip(windows, groups):
        by_group.setdefault(g, []).append((tier, sum(p[2] ** 2 for p in pieces)))
    for rows in by_group.values():
        assert len({tier for tier, _ in rows}) == 1 and sum(tier for tier, _ in rows) <= 4 * 1024
    for tier in packing.TIERS:
        own = [rows for rows in by_group.values() if rows[0][0] == tier]
        sizes = {len(rows) for rows in own}
        assert not own or max(sizes) - min(sizes) <= 1
        costs = sorted(sum(c for _, c in rows) / len(rows) for rows in own)
        if len(own) > 3:
            assert costs[-1] / costs[0] < 1.25
            # Dealt in the order of arrival, the same windows are spread further.
            cost = [sum(p[2] ** 2 for p in pieces) for t, pieces in windows if t == tier]
            size = max(sizes)
            plain = [sum(cost[k : k + size]) / len(cost[k : k + size]) for k in range(0, len(cost), size)]
            assert max(plain) - min(plain) >= costs[-1] - costs[0]


HOSTILE = (
    "<a " * 100_000, "<div>x" * 50_000, "<a '>" * 60_000, "<title>" * 43_000, "<b>" * 50_000 + "<div></div>" * 15_000,
    "a" * 300_000 + '"', "<" + "a" * 300_000 + '" >', "<!--" * 75_000, "<p>x" * 75_000,
    "".join(f"<x{i} class=c{i}>t" for i in range(17_000)),
)


@pytest.mark.parametrize("page", HOSTILE, ids=[p[:12] for p in HOSTILE])
def test_long_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 3  # about a quarter of a second; far more if it were quadratic


def test_what_stands_behind_the_last_tag():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    assert texts("<p>a < b <!-- c") == ["a < b"] and texts("x <a href=") == ["x <a href="]
    assert texts("<p>one</p> two <!-- c --> three <b") == ["one", "two three <b"]


def test_long_pages_are_learnt_from_in_stretches(spark):
    page = "<body><nav>menu here</nav><article>" + "".join(f"<p>Sentence number {i}, which is long enough.</p>" for i in range(900)) + "</article></body>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page.replace("article", "main"))], "page_id long, url string, html string")
    chain = html_text.train(pages)
    assert (chain.weights != html_text.Chain.start().weights).any()
    assert html_text.extract(pages).first()["n_main"] == 900
