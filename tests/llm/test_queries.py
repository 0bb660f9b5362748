"""The operators on small tables with nulls, ties, repeated rows, empty tables and columns of clashing names."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from worklake.llm import bpe, counts, edits, fagin, jaccard, langid, licenses, mixture, pii, quality, registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, node string, sid string"
LICENSE = "The code is good.\nReleased under the MIT License.\nWork under the GNU General Public License, version 3. CC BY."
TEXTS = [None, "", " \t ", "one", "One two", "the cat and the dog sat on the mat near the house " * 3, "THE cat and the dog sat on the mat near the house " * 3,
         "le chat et le chien sont dans la maison avec les enfants " * 4, LICENSE, "write to a.b@mail.example.com or +1 (555) 555-1234 at 10.0.0.1",
         "中文 😀 é <|endoftext|> it's", "word " * 9000 + "end", "x" * 40_000]
ROWS = [(i, t, "fr" if t and t.startswith("le ") else "en", (None, "a", "b", "é")[i % 4], len(t or ""), 0.5, "x", "y", "z") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5], (50, TEXTS[5], "en", "a", 1, 0.5, "x", "y", "z"), (None, TEXTS[5], None, None, None, 0.5, "x", "y", "z"), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_queries_are_there():
    numbers = [int(n[2:].split("_")[0]) for n in registered.all_queries()]
    assert len(set(numbers)) == len(numbers) and set(range(1, 11)) <= set(numbers) <= set(range(1, 14))


def test_bpe(spark, docs, empty):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    expected = []
    for r in ROWS:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), bpe.sha(",".join(map(str, ids))), bpe.sha(tok.decode(ids, skip_special_tokens=False))))
    for leaf in (bpe.LEAF, 1000):
        assert rows(bpe.encode_decode(docs, bpe.vocabulary(), leaf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)
    assert {r.decoded for r in bpe.encode_decode(docs, bpe.vocabulary(), ids=True).collect()} == {t or "" for t in TEXTS}
    assert bpe.encode_decode(empty, bpe.vocabulary()).count() == 0


def test_counts(spark, docs, empty):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary())
    changes = spark.createDataFrame([(5, 2, 0, 3, "A"), (5, 1, 10 ** 9, 10 ** 9, " the end"), (1, 1, 0, 0, "new"), (3, 1, None, 2, "x"), (3, 2, 1, 2, None)],
                                    "doc_id long, seq int, start long, stop long, text string")
    got = {r.doc_id: r for r in counts.count_edits(counts.with_edits(docs, changes), bpe.vocabulary()).collect()}
    for i, text in ((5, "A" + TEXTS[5][3:] + " the end"), (1, "new"), (3, "oe"), (0, "")):
        assert (got[i].edited_chars, got[i].edited_tokens) == (len(text), len(tok.encode(text, add_special_tokens=False).ids))
    assert counts.count_edits(counts.sample_edits(docs), bpe.vocabulary()).count() == len(ROWS)
    assert counts.count_edits(counts.sample_edits(empty), bpe.vocabulary()).count() == 0


def test_fingerprints(spark, docs, empty):
    ordered = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in ROWS))
    expected = []
    for (gone, i, t), (_, _, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        expected.append((None if gone else i, len(t), hashlib.sha256(changed.encode()).hexdigest()))
    got = edits.fingerprints(docs)
    assert rows(got, "doc_id", "n_chars", "edited_sha256") == sorted(expected, key=repr)
    prints = collections.defaultdict(set)
    for r in got.collect():
        prints[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[5] == prints[50] and prints[5] != prints[6]
    assert (50, 5) in rows(edits.near_copies(got), "doc_id", "first_id")
    assert edits.fingerprints(empty).count() == 0
    assert edits.fingerprints(docs.where("doc_id = 3")).first().near_next == 1


def test_jaccard(spark, docs, empty, monkeypatch):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    base = [f"w{i}" for i in range(60)]
    family = [(100 + k, " ".join(w if (i * 7 + k) % 61 else f"new{k}" for i, w in enumerate(base)), "en", "a", 1, 0.0, "x", "y", "z") for k in range(40)]
    whole = docs.unionByName(spark.createDataFrame(family, SCHEMA))
    sets = [(r[0], shingles(r[1])) for r in ROWS + family]
    root = list(range(len(sets)))
    for i, (_, s) in enumerate(sets):
        for j, (_, t) in enumerate(sets[:i]):
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                root = [root[j] if r == root[i] else r for r in root]
    ids = {r: min((sets[i][0] for i in range(len(sets)) if root[i] == r and sets[i][0] is not None), default=None) for r in root}
    expected = sorted(((d, len(s), ids[r] if s else d) for (d, s), r in zip(sets, root)), key=repr)
    assert rows(jaccard.join(whole), "doc_id", "n_shingles", "component_id") == expected
    monkeypatch.setattr(jaccard, "GROUP", 7)  # blocks of a large cluster
    assert rows(jaccard.join(whole), "doc_id", "n_shingles", "component_id") == expected
    assert jaccard.join(empty).count() == 0
    kept_ids = [r.doc_id for r in jaccard.stage(spark, docs, "").collect()]
    assert kept_ids.count(5) == 1 and 6 not in kept_ids and 50 not in kept_ids and kept_ids.count(None) == 2 and {0, 1, 2, 3, 8, 9} <= set(kept_ids)


@pytest.mark.parametrize("n, least, words", [(3, 90, 11), (5, 80, 8)])
@pytest.mark.parametrize("parts", [1, 2])
def test_jaccard_keeps_nodes_with_just_enough(spark, n, least, words, parts):
    text = " ".join(f"w{i}" for i in range(words))  # 9 of 10 shingles at 0.9, 4 of 5 at 0.8
    pair = [(i, t, "en", "a", 1, 0.0, "x", "y", "z") for i, t in enumerate((text, text + " more"))]
    got = jaccard.join(spark.createDataFrame(pair, SCHEMA).repartition(parts, "doc_id"), n, least)
    assert rows(got, "doc_id", "n_shingles", "component_id") == [(0, words - n + 1, 0), (1, words - n + 2, 0)]


def test_licenses(spark, docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LICENSE.lower())
    starts = [i for i in range(len(words)) for p in licenses.BASE if words[i:i + len(p.split())] == p.split()]
    r = got[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), min(starts), max(starts), "cc-by,gpl,mit")
    assert r.labels.split(",") == sorted(set(r.labels.split(","))) and {"cc-by", "gpl", "mit", "mit-notice"} <= set(r.labels.split(","))
    assert (got[5].n_base, got[5].first_word, got[5].labels, got[5].score, got[0].n_words) == (0, None, "", 0, 0)
    assert licenses.scan_licenses(docs).count() == len(ROWS) and licenses.scan_licenses(empty).count() == 0


def test_licenses_of_a_file_with_many_notices(spark, empty):
    four = [notice for label, notice, _ in licenses.TEMPLATES if label in ("mit-text", "bsd-text", "isc-text", "mpl-2.0")]
    texts = [" and so on. ".join(four), "\n\n".join(t[1] for t in licenses.TEMPLATES), "nothing of the kind", four[0]]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert {"mit-text", "bsd-text", "isc-text", "mpl-2.0"} <= set(got[0].labels.split(",")) and got[0].score == 1
    assert {t[0] for t in licenses.TEMPLATES} <= set(got[1].labels.split(","))
    assert got[2].labels == "" and got[3].labels == "mit-text"


def test_languages_of_many_scripts():
    profile = {"zh": [chr(0x4E00 + i) for i in range(200)] + [chr(0x4E00 + i) + chr(0x4E00 + i * 7 % 200) for i in range(150)],
               "ru": [chr(0x430 + i) for i in range(32)] + [chr(0x430 + i) + chr(0x430 + i * 5 % 32) for i in range(32)],
               "el": [chr(0x3B1 + i) for i in range(25)] + [chr(0x3B1 + i) + chr(0x3B1 + i * 3 % 25) for i in range(25)],
               "aa": [" a", "a ", "a"]}
    texts = ["".join(profile["zh"][150:200]), "".join(profile["ru"][:20]), "".join(profile["el"][:20]), "a a", "ქართული", "1 2"]
    both = []
    for dense in (langid.DENSE, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(langid, "DENSE", dense, raising=False)
            both.append(langid.Ranker(profile)(texts))
    assert both[0] == both[1] and both[0][0] == ["zh", "ru", "el", "aa", "aa", "und"]
    assert min(both[0][1][:4]) > 0.05 and both[0][1][4:] == [0, 0]


def test_languages(spark, docs, empty):
    found = langid.profiles(langid.sample(docs))
    got = {r.doc_id: r for r in langid.predict(docs, found).collect()}
    assert (got[5].lang_pred, got[7].lang_pred, got[0].lang_pred, got[2].lang_pred, got[0].score) == ("en", "fr", "und", "und", 0)
    assert all(r.lang_pred == "und" for r in langid.predict(docs, langid.profiles(langid.sample(empty))).collect())
    assert langid.predict(empty, found).count() == 0
    left = [r.doc_id for r in langid.stage(spark, docs, "").collect()]
    assert 0 not in left and 2 not in left and {5, 6, 7, 8, 9} <= set(left)


def test_quality(spark, docs, empty):
    good, bad = TEXTS[5], "BAD!! BAD!! BAD!! BAD!! "
    net = quality.fit([good, bad] * 30, [1, 0] * 30)
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and all(0 <= s <= 1 for s in got.values()) and got[5] > 0.5
    assert quality.fit([], []) == 0.5 and quality.fit(["a"], [1]) == 1.0
    assert {r.score for r in quality.score(docs, 0.5).collect()} == {0.5} and quality.score(empty, net).count() == 0
    labels = spark.createDataFrame([(5, 1), (5, None), (7, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(quality.sample(docs, labels)[1]) == [0, 1, 1, 1]


def test_pii(spark, docs, empty):
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    spans = [m.span() for p in (r"a\.b@[a-z.]+", r"10\.0\.0\.1", r"\+1 .*1234") for m in re.finditer(p, TEXTS[9])]
    base = ",".join(f"{k}:{a}:{b}" for k, (a, b) in zip(("email", "ip", "phone"), spans))
    assert got[9].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (got[9].n_email, got[9].n_ip, got[9].n_card, got[9].n_phone) == (1, 1, 0, 1)
    assert set(base.split(",")) <= set(got[9].spans.split(",")) and got[0].spans == "" and pii.detect(empty).count() == 0
    masked = {r.doc_id: r for r in pii.stage(spark, docs, "").collect()}
    assert masked[9].text == "write to <EMAIL> or <PHONE> at <IP>" and masked[9].n_chars == len(masked[9].text)
    assert masked[5].text == TEXTS[5] and masked[0].text is None


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    vectors += [vectors[0], (400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (500, [0.0] * 8), (501, [0.0] * 8), (502, vectors[7][1])]
    vectors += [(100, vectors[3][1]), (100, [9.0] * 8), (5, vectors[6][1]), (5, vectors[6][1]), (600, [1.0, 2.0]), (601, [1e9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("e", pytest.importorskip("pyspark.sql.functions").lit(1))
    got = rows(fagin.top_k(df), "query_id", "rank", "vec_id", "score")
    con = duckdb.connect()
    con.register("source", df.toPandas())
    con.execute("CREATE VIEW embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM source")
    assert got == sorted(con.execute(fagin.SQL).fetchall(), key=repr)
    assert sum(r[0] == 100 for r in got) == 30 and sum(r[0] == 0 and r[2] == 0 for r in got) <= 2  # rows of one id are queries and candidates each
    assert fagin.top_k(df.where("vec_id < 0")).count() == 0


def test_top_k_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    one = [(1, 0, 4 * 1024 * 1024), (2, 1, 3 * 1024 * 1024), (3, 1, 3 * 1024 * 1024), (4, 2, 3 * 1024 * 512)]
    assert rows(fagin.top_k(df), "query_id", "rank", "vec_id", "score") == sorted([(0, *r) for r in one] * 2, key=repr)


def test_mixture(spark, docs, empty):
    extra = [(1000 + i, "w " * (i * 37 % 400), None, f"s{i % 7}" if i % 3 else "s0", 1, 0.0, "x", "y", "z") for i in range(400)]
    whole = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    sizes = collections.Counter()
    for r in ROWS + extra:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = {}, set()
    while True:  # reshare what is above twice the source until none is
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        goal = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if goal[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    got = mixture.taken(whole).collect()
    assert len(got) == len(ROWS) + len(extra)
    named = {r[0]: r[3] for r in ROWS + extra if r[0] is not None}
    used = collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        if r.doc_id is not None:
            assert r.target == pytest.approx(goal[named[r.doc_id]]) and r.source_size == sizes[named[r.doc_id]]
        used[r.source_size] += r.taken
    for n, words in used.items():
        assert abs(words - sum(goal[s] for s in order if sizes[s] == n)) <= sum(sizes[s] == n for s in order)
    assert sorted(map(repr, got)) == sorted(map(repr, mixture.taken(whole.repartition(3)).collect()))
    assert mixture.taken(empty).count() == 0


def test_mixture_of_whole_documents(spark):
    lengths = {"a": [500] * 60, "hot": [3000] * 20, "k": [100, 900] * 20, "l": [500] * 60, "m": [500] * 20, "n": [500] * 40, "o": [500] * 60}  # the hot source is mixed to a part of its size
    docs = [(i, f"d{i} " + "w " * (n - 1), "en", s, n) for i, (s, n) in enumerate((s, n) for s, of in lengths.items() for n in of)]
    docs += [(None, "w " * 50, "en", "a", 1)] * 3
    whole = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = mixture.taken(whole).collect()
    shards = collections.Counter()
    for r in found:
        assert sum(x.words for x in r.spans) == r.taken and all(0 <= x.first and x.first + x.words <= r.size for x in r.spans)
        for x in r.spans:
            shards[x.shard] += x.words
    size = {s: sum(len(d[1].split()) for d in docs if d[3] == s) for s in lengths}
    goal = {s: next(r.target for r in found if r.source_size == size[s]) for s in lengths}
    assert sum(shards.values()) == pytest.approx(sum(goal.values()), abs=3) and len(shards) > 1 and goal["hot"] < 0.5 * size["hot"]
    mixed = mixture.stage(spark, whole, "").collect()
    for s in lengths:
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - goal[s]) <= max(lengths[s]), s


def test_pipeline(spark, docs, empty, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: docs)
    got = corpus_pipeline.run(spark, "")
    texts = {r.doc_id: r.decoded for r in got.collect()}
    assert not {0, 1, 2, 6, 50} & set(texts)  # without a letter, or a near copy
    assert texts.get(9, "<EMAIL>").count("@") == 0
    assert set(texts) <= set(range(13)) | {None}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty.drop("score"), "").columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert zlib.crc32(b"1")  # folds of the queries are those of zlib
    assert docs.selectExpr("crc32(cast(doc_id as string)) c", "doc_id").where("doc_id = 1").first().c == zlib.crc32(b"1")
