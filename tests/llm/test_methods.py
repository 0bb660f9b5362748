"""Permutations, draws, the index of licence words and the leaves of long texts against plain computations."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from worklake.llm import bpe, licenses, mixture


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permuted(spark, n):
    at = mixture.permuted(F.col("id"), F.col("n"), F.lit(7), F.col("key"))
    rows = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("key", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", at).collect()
    of = {k: [r.at for r in sorted(rows, key=lambda r: r.id) if r.key == k] for k in (0, 1)}
    assert all(sorted(x) == list(range(n)) for x in of.values())
    if n >= 1000:
        assert of[0] != of[1]
        steps = collections.Counter((b - a) % n for a, b in zip(of[0], of[0][1:]))
        assert max(steps.values()) < n / 20  # no stride
        half = sorted(of[0][:n // 2])
        assert abs(sum(half) / len(half) - n / 2) < 3 * n / math.sqrt(12 * len(half))  # a part of a pass comes from everywhere


def test_draws(spark):
    goals = spark.createDataFrame([("a", 0, 900_000, 600_000.0), ("b", 1, 1000, 2000.0), ("c", 2, 0, 0.0), (None, 3, 300_000, 450_123.4)],
                                  "source string, sid int, source_size long, target double")
    sources = {r.sid: r for r in mixture.numbered(goals).collect()}
    drawn = mixture.draws(mixture.numbered(goals)).collect()
    assert all(sum(r["count"] for r in drawn if r.sid == s) == sources[s].slots for s in (0, 1, 3)) and {r.sid for r in drawn} == {0, 1, 3}
    shards = collections.Counter()
    for r in drawn:
        shards[r.shard] += r["count"]
    total = sum(shards.values())
    assert [shards[k] for k in sorted(shards)] == [mixture.SHARD] * (total // mixture.SHARD) + [total % mixture.SHARD] * (total % mixture.SHARD > 0)
    for s in (0, 1, 3):
        at = 0
        for r in sorted((r for r in drawn if r.sid == s), key=lambda r: r.shard):
            assert r.first == at
            at += r["count"]
    share = sources[0].slots / total
    got = [r["count"] for r in drawn if r.sid == 0 and shards[r.shard] == mixture.SHARD]
    spread = sum((x - mixture.SHARD * share) ** 2 for x in got) / len(got)
    assert 0.2 < spread / (mixture.SHARD * share * (1 - share)) < 3  # as much as draws have
    found = mixture.slots(goals).collect()
    assert len(found) == total and len({(r.sid, r.epoch, r.block) for r in found}) == total
    for s, words in ((0, 600_000), (1, 2000), (3, 450_123)):
        assert sum(r.words for r in found if r.sid == s) == words
    assert mixture.slots(goals.where("sid > 9")).count() == 0


def _matches(texts: list[str]) -> list[tuple[set, float]]:
    """Labels and score by looking at every place of every template."""
    split = [[w for w in re.split(licenses.NO_WORD, t.lower()) if w] for t in texts]
    held = collections.Counter(w for words in split for w in set(words) & set(licenses.INDEX))
    idf = {w: max(0.01, math.log((len(texts) + 1) / (n + 0.5))) for w, n in held.items()}
    out = []
    for words in split:
        labels, best = set(), 0.0
        for label, notice, key in licenses.TEMPLATES:
            notice, key = notice.split(), key.split()
            off = next(i for i in range(len(notice)) if notice[i:i + len(key)] == key)
            weight = sum(idf.get(w, 0) for w in notice if w not in licenses.STOP)
            for i in range(len(words)):
                if words[i:i + len(key)] == key:
                    agreed = sum(idf[w] for j, w in enumerate(notice) if w not in licenses.STOP and 0 <= i - off + j < len(words) and words[i - off + j] == w)
                    if weight and agreed / weight >= licenses.AGREE:
                        labels.add(label)
                        best = max(best, agreed / weight)
        out.append((labels, best))
    return out


def test_license_index_against_every_place(spark):
    rng, texts = random.Random(3), []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            lo = rng.randrange(len(words)) if rng.random() < 0.5 else 0
            parts.append(" ".join(w if rng.random() < 0.95 else "other" for w in words[lo:]))
            parts.append(" ".join(rng.choice(["license", "the", "code", "software", "public", "x"]) for _ in range(rng.randrange(6))))
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = _matches(texts)
    assert sum(bool(x[0]) for x in expected) > 50
    for i, (labels, best) in enumerate(expected):
        assert set(filter(None, got[i].labels.split(","))) - set(got[i].base_labels.split(",")) == labels - set(got[i].base_labels.split(",")), texts[i]
        if not got[i].n_base:
            assert got[i].score == pytest.approx(min(1, best))


def test_leaves(spark):
    texts = ["a\nb\r\n😀" * 700, "", "é" * 100, "ab" * 51]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = collections.defaultdict(dict)
    for r in bpe.leaves(df, 100).collect():
        cut[r.doc_id][r.k] = r.text
    for i, t in enumerate(texts):
        assert [cut[i][k] for k in sorted(cut[i])] == [t[a:a + 100] for a in range(0, len(t), 100)]
