"""Collocations against plain counting and the SQL."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from worklake.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, a long"


def plain(docs, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in c.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        rows = []
        for p, a in c.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(rng, count):
    words = [f"w{i}" for i in range(60)] + ["The", "of", "É", "中", "\u00a0x", "a\x1cb"]
    weights = [1 / (i + 1) for i in range(60)] + [1] * 6
    for _ in range(count):
        parts = rng.choices(words, weights, k=rng.choice([0, 1, 4, 40])) + rng.choice([[], ["New", "york", "City", "hall", "is", "old"], ["new york", "city"]])
        yield "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in parts)


@pytest.mark.parametrize("unit", [col.UNIT, 50])
def test_collocations(spark, monkeypatch, unit):
    rng = random.Random(3)
    made = list(texts(rng, 700))
    docs = [(i, t, rng.choice(["en", "en", "en", "fr", None, "und"]), "x", 1) for i, t in enumerate(made)]
    docs += [(1, None, "en", "x", 1), (2, "", None, "x", 1), (3, " .. \t", "es", "x", 1), (4, "new york city " * 5000, "en", "x", 1)] + [docs[7]] * 40
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    monkeypatch.setattr(col, "UNIT", unit)
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, top in ((20, 15), (3, 10_000)):
        got = sorted(tuple(r[c] for c in columns) for r in col.collocations(df, least, top).collect())
        assert got == plain(docs, least, top) and len(got) > 20
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    sql = con.execute(f"SELECT {', '.join(columns)} FROM ({col.SQL})").fetchall()
    assert sorted(sql) == sorted(tuple(r[c] for c in columns) for r in col.collocations(df).collect()) == plain(docs, 100, 2000)
    assert col.collocations(df.where("doc_id < 0")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 10 ** 13
    rows = [("en", 0, None, big), ("en", 1, "a", big // 3), ("en", 1, "b", big // 7), ("en", 2, "a b", big // 9)]
    got = col.ranked(spark.createDataFrame(rows, col.ENTRIES)).first()
    assert got.score == 1000 * (big // 9) * big // ((big // 3) * (big // 7))


def test_pairs_on_the_map(spark):
    entries = spark.createDataFrame([("en", 2, "new york", 100), ("fr", 2, "la vie", 100), ("en", 1, "new", 200)], col.ENTRIES)
    bits = np.frombuffer(col.pair_map(entries, 16), np.uint8)
    crc = [np.int64(col.zlib.crc32(w)) for w in (b"new", b"york", b"la", b"vie")]
    expected = {int(col.pair_bits("en", crc[0], crc[1], 16)), int(col.pair_bits("fr", crc[2], crc[3], 16))}
    assert {i for i in range(1 << 16) if bits[i >> 3] >> (i & 7) & 1} == expected
