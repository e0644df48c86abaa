"""Ball-tree search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weirflow.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain(docs, items, k=20):
    held = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for doc_id, c in held:
            m = 75 + 25 * c.total() * n_docs // length if length else 0
            score = 0
            for t in asked.keys() & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += asked[t] * w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        scores.sort()
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n, words):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "é", "x-y", "Word", "wörter"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(r.choices(vocabulary, weights, k=r.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize(("tree_docs", "tree_terms", "leaf"), [(2048, 256, 32), (40, 30, 3), (1, 1, 1)])
def test_search_equals_scoring_everything(rows, monkeypatch, tree_docs, tree_terms, leaf):
    monkeypatch.setattr(search, "TREE_DOCS", tree_docs)
    monkeypatch.setattr(search, "TREE_TERMS", tree_terms)
    monkeypatch.setattr(search.BallTree.__init__, "__defaults__", (leaf,))
    docs, items = corpus(1, 300, 200), corpus(2, 15, 200)
    assert got(search.search(rows(docs, DOCS), rows(items, ITEMS), 20)) == plain(docs, items)


def test_items_searched_in_several_passes(rows, monkeypatch):
    monkeypatch.setattr(search, "PASS_TERMS", 50)
    docs, items = corpus(3, 80, 50), corpus(4, 12, 50)
    assert got(search.search(rows(docs, DOCS), rows(items, ITEMS), 5)) == plain(docs, items, 5)


def test_odd_rows_and_ties(rows):
    docs = [(i, "Same text again") for i in range(50)] + [(7, "same text"), (None, "SAME"), (None, None), (8, None), (9, ""), (10, " .,;\x00\x7f")]
    docs += [(11, "é" * 4000 + " same " * 20_000), (12, " same text"), (-5, "same")]
    items = [(1, "same text"), (1, "same same"), (None, "same"), (2, None), (3, ""), (4, "nowhere to be found"), (5, "again " * 500)]
    assert got(search.search(rows(docs, DOCS), rows(items, ITEMS))) == plain(docs, items)


def test_empty_tables_and_clashing_names(rows):
    docs, items = corpus(5, 40, 30), corpus(6, 3, 30)
    empty = rows([], DOCS)
    assert got(search.search(empty, rows(items, ITEMS))) == []
    assert got(search.search(rows(docs, DOCS), rows([], ITEMS))) == []
    clash = ", key string, terms int, tf string, n string, score string, rank string, named int"
    more = lambda data: [(*d, "a", 1, "b", "c", "d", "e", 2) for d in data]
    found = search.search(rows(more(docs), DOCS + clash), rows(more(items), ITEMS + clash))
    assert got(found) == plain(docs, items)


def test_whole_numbers_beyond_doubles_stay_exact(rows, monkeypatch):
    monkeypatch.setattr(search, "_EXACT", 1)
    docs, items = corpus(7, 60, 40), corpus(8, 4, 40)
    assert got(search.search(rows(docs, DOCS), rows(items, ITEMS))) == plain(docs, items)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(3)
    groups = [r.integers(0, 2, 60) * r.integers(1, 10**9, 60) for _ in range(30)]
    x = np.array([g + r.integers(0, 1000, 60) for g in groups for _ in range(40)], dtype=np.float64)
    names = r.integers(0, 3, (8, 60))
    tree = search.BallTree(x)
    bounds, exact = tree.bounds(names), (x @ names.T.astype(np.float64)).astype(np.int64)
    for ball, own in enumerate(tree.rows):
        assert (exact[own].max(axis=0) <= bounds[:, ball]).all()
    best = [search.Best(5) for _ in names]
    scored = search.search_tree(tree, range(len(x)), names, best)
    assert scored < x.shape[0] * len(names) / 2
    for q, b in enumerate(best):
        assert sorted((s for s, _ in b.heap), reverse=True) == sorted(exact[:, q], reverse=True)[:5]
