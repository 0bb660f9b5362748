"""Ranked search: the treap against its grid, the operator against plain scores and its SQL."""

import collections
import math
import random
import re

import duckdb
import numpy as np

from worklake.llm import treap

SCHEMA = "doc_id long, text string, terms string, n long, uid string"


def test_treap_finds_the_best_columns_of_any_grid(monkeypatch):
    rng = np.random.default_rng(4)
    for opened, frontier in ((256, 1 << 23), (3, 1 << 23), (2, 1)):
        monkeypatch.setattr(treap, "OPENED", opened)
        monkeypatch.setattr(treap, "FRONTIER", frontier)
        for _ in range(60):
            r, c = rng.integers(1, 70, 2)
            grid = rng.integers(1, 9, (r, c)) * (rng.random((r, c)) < rng.choice([0.05, 0.3, 1.0]))
            rows, columns = np.nonzero(grid)
            if not len(rows):
                continue
            height = int(max(r - 1, c - 1)).bit_length()
            masks, drops = treap.build(rows, columns, grid[rows, columns].astype(np.int64), height)
            order = rng.permutation(c)
            asked = rng.choice(r, rng.integers(1, r + 1), replace=False)
            weights = rng.integers(0, 5, len(asked))
            scores = weights @ grid[asked]
            expected = sorted(((-s, order[j], j) for j, s in enumerate(scores) if s > 0))[:5]
            got = treap.Treap(height, masks, drops).search(asked, weights, order, 5)
            assert got == [(-s, j) for s, _, j in expected]


def plain(docs, items, k=20):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, collections.Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n, length = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text, *_ in items:
        scores = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores += [(-s, doc is None, doc or 0)] if s > 0 else []
        out += [(item, rank, None if gone else doc, -s) for rank, (s, gone, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search(spark, monkeypatch):
    random.seed(8)
    words = [f"w{i}" for i in range(300)] + ["the", "The", "É", "é", "中文", "a1"]
    weights = [1 / (i + 1) for i in range(300)] + [3] * 6
    texts = [None, "", " .,; ", "the", "THE the", "x" * 20_000, "the é. " * 3000] + [
        random.choice(" .\n-_").join(random.choices(words, weights, k=random.choice([1, 3, 30, 200]))) for _ in range(400)]
    docs = [(i, t, "x", 1, "y") for i, t in enumerate(texts)] + [(7, texts[9], "x", 1, "y"), (None, texts[9], "x", 1, "y")] + [(9, texts[9], "x", 1, "y")] * 30
    items = [(i, " ".join(random.choices(words, weights, k=12)), "x", 1, "y") for i in range(12)] + [
        (0, texts[9], "x", 1, "y"), (0, texts[9], "x", 1, "y"), (None, "é w3", "x", 1, "y"), (50, None, "x", 1, "y"), (51, "unknown", "x", 1, "y"), (52, texts[6], "x", 1, "y")]
    d = spark.createDataFrame(docs, SCHEMA).repartition(5)
    b = spark.createDataFrame(items, SCHEMA.replace("doc_id", "item_id")).repartition(3)
    expected = plain(docs, items)
    columns = ("item_id", "rank", "doc_id", "score")
    got = sorted((tuple(r[c] for c in columns) for r in treap.search(d, b).collect()), key=repr)
    assert got == expected
    monkeypatch.setattr(treap, "DOCUMENTS", 50)
    monkeypatch.setattr(treap, "ITEMS", 5)
    assert sorted((tuple(r[c] for c in columns) for r in treap.search(d, b).collect()), key=repr) == expected
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", b)):
        con.register(name + "_rows", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({treap.SQL})").fetchall(), key=repr) == expected
    assert treap.search(d.where("n > 5"), b).count() == 0 and treap.search(d, b.where("n > 5")).count() == 0


def test_ranges_below_the_best_are_not_opened():
    rng = np.random.default_rng(2)
    n = 4096
    columns, rows = np.tile(np.arange(n), 4), np.repeat(np.arange(4), n)
    impacts = np.sort(rng.integers(1, 1_000_000, n))[::-1]
    tree = treap.Treap(12, *treap.build(rows, columns, np.tile(impacts, 4), 12))
    opened = 0
    child = tree.child

    def counting(cells, quarter):
        nonlocal opened
        opened += len(cells)
        return child(cells, quarter)
    tree.child = counting
    assert [c for _, c in tree.search(np.arange(4), np.ones(4, np.int64), np.arange(n), 20)] == list(range(20))
    assert opened < n
