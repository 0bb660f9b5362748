"""Parts without Spark against brute force."""

import collections
import itertools
import random
import sys

import numpy as np
import pytest
import regex

from worklake.llm import bpe, counts, edits, jaccard, langid, licenses, pii

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

BITS = ["a", "the", " ", "'", "re", "'s", "<|endoftext|>", "<|", "endoftext", "|>", "\n", "  ", "!!", "9", "é", "²", "中文字", "՘", "😀",
        "ing", "Z" * 300, "ab" * 400, "\t", "-", "ſ", "　", "1234567"]


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def test_classes_of_characters_agree(plain):
    cut = plain.pre_tokenizer.pre_tokenize_str
    for c in map(chr, range(sys.maxunicode + 1)):
        text = f"a{c}1{c}!{c}{c} {c}b"
        if bpe.STABLE.fullmatch(c):
            assert [text[a:b] for _, (a, b) in cut(text)] == bpe.PATTERN.findall(text), hex(ord(c))
        if bpe.EUROPEAN.fullmatch(c):
            assert bpe.WORDS.findall(text) == bpe.PATTERN.findall(text), hex(ord(c))


def test_tree_equals_whole_encoding(plain):
    random.seed(1)
    c = bpe.codec(bpe.vocabulary())
    for _ in range(600):
        text = "".join(random.choice(BITS) for _ in range(random.randrange(1, 40)))
        step = random.choice([3, 7, 20, 90])
        ids = plain.encode(text, add_special_tokens=False).ids
        assert c.tree([c.part(text[i:i + step]) for i in range(0, len(text), step)]).ids == ids
        assert c.encoded(text) == (len(ids), ",".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False))


def test_edited_counts_equal_full_counts(plain):
    random.seed(2)
    c = bpe.codec(bpe.vocabulary())
    for _ in range(150):
        text = "".join(random.choice(BITS) for _ in range(random.randrange(0, 200)))
        tree = counts.Tree(c, text)
        for _ in range(4):
            a = random.randrange(len(text) + 1)
            b = min(len(text), a + random.choice([0, 1, 5, 200]))
            new = "".join(random.choice(BITS) for _ in range(random.choice([0, 1, 3, 400])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert (tree.text, tree.total) == (text, len(plain.encode(text, add_special_tokens=False).ids))


def groups(n, found, shift=0):
    root = list(range(n))
    for i, j in found:
        a, b = root[i], root[j + shift]
        root = [b if r == a else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == r) for r in root}


@pytest.mark.parametrize("least", [80, 90])
def test_search_connects_what_is_linked(least):
    rng = np.random.default_rng(3)
    random.seed(3)
    for _ in range(12):
        base = [np.unique(rng.integers(0, 1 << 40, random.choice([3, 12, 40, 100])).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = base[random.randrange(4)].copy()
            k = rng.random(len(s)) < random.choice([0, .02, .05, .1])
            s[k] = rng.integers(0, 1 << 40, k.sum()).astype(np.uint64)
            sets.append(np.unique(s))

        def linked(s, t):
            o = len(np.intersect1d(s, t))
            return 100 * o >= least * (len(s) + len(t) - o)
        every = [(i, j) for i in range(40) for j in range(i) if linked(sets[i], sets[j])]
        assert groups(40, jaccard.search(sets, sets, least, True)) == groups(40, every)
        across = [(i, j) for i in range(20) for j in range(20) if linked(sets[i], sets[20 + j])]
        assert groups(40, jaccard.search(sets[:20], sets[20:], least, False), 20) == groups(40, across, 20)
        parts = jaccard.Parts(least)
        marks = [set(parts.of(s).tolist()) for s in sets]
        assert all(marks[i] & marks[j] for i, j in every)  # every linked pair shares a part
        heads = [set(jaccard.prefix(s, least).tolist()) for s in sets]
        need = [jaccard.common(-(-least * len(s) // 100)) for s in sets]
        assert all(len(heads[i] & heads[j]) >= max(need[i], need[j]) for i, j in every)  # and enough of the prefixes


def test_base_spans_equal_the_patterns():
    random.seed(4)
    bits = ["a.b", "@", "x", "mail.de", ".", "1", "12", "256", "4111 1111 1111 1111", "-", " ", "+", "(555)", "4", "%", "0", "é", "378282246310005", "a@b.c"]
    email = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = regex.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        text = "".join(random.choice(bits) for _ in range(random.randrange(1, 30)))
        found = pii.base_spans(text)
        assert found[0] == [m.span() for m in email.finditer(text)], text
        assert found[1] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))], text
        cards = [(m.span(), "".join(c for c in m[0] if c.isdigit())) for m in regex.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
        assert found[2] == [s for s, d in cards if 16 <= len(d) <= 19 and pii.luhn(d)], text
    assert pii.base_spans("1" * 50_000 + "@")[0] == []
    assert len(pii.base_spans("a" * 200_000 + "@b.c")[0]) == 1


def test_secrets_of_any_length_are_candidates():
    for token in ("eyJ" + "aB3_" * 200, "sk-abcdefghijklmnopqrstuv"):
        assert [c[:3] for c in pii.candidates(f"the key {token} is")] == [(4, 8, 8 + len(token))]
    assert pii.candidates("a" * 19 + " " + "b" * 19) == []


def test_em_tells_good_votes_from_bad():
    rows = [(0, "1111" + "5", 500), (2, "1112" + "5", 300), (4, "2111" + "6", 80), (4, "2000" + "6", 90), (3, "0121" + "5", 9), (3, "0000" + "5", 40)]
    good = {k for k, p in pii.posteriors(rows).items() if p >= pii.CUT}
    assert (4, "21116") in good and (4, "20006") not in good and (3, "00005") not in good
    assert pii.posteriors([]) == {} and pii.train([]) == []


def test_walk_one_by_one_equals_walk_together(monkeypatch):
    random.seed(5)
    texts = ["".join(random.choice("abcde é😀") for _ in range(n)) for n in (0, 1, 2, 50, 400, 401, 3000)]
    codes = [edits.codes_of(t) for t in texts]
    alone = edits.Walk().bits(codes)
    monkeypatch.setattr(edits, "FEW", 0)
    together = edits.Walk().bits(codes)
    assert all(np.array_equal(a, b) for a, b in zip(alone, together))
    assert all(np.array_equal(edits.Walk().bits([c])[0], b) for c, b in zip(codes, together))


def test_walks_of_short_texts_do_not_depend_on_their_number():
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product("abcdefghijklmnop", repeat=n)]
    walk, codes = edits.Walk(), [edits.codes_of(t) for t in texts]
    many = [b for i in range(0, len(codes), 1000) for b in walk.bits(codes[i:i + 1000])]
    assert all(np.array_equal(walk.bits([c])[0], b) for c, b in zip(codes, many))


def test_likeness_falls_with_edits():
    random.seed(6)
    text = "".join(random.choice("etaoin shrdlu") for _ in range(3000))
    walk, near = edits.Walk(), []
    for times in (0, 30, 300, 6000):
        other = list(text)
        for _ in range(times):
            other[random.randrange(len(other))] = random.choice("etaoin shrdlu")
        a, b = walk.bits([edits.codes_of(text), edits.codes_of("".join(other))])
        near.append(edits.likeness((len(text), a), (len(other), b)))
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and near[1] > 0.7


def test_index_words_are_in_the_notices():
    assert all(notice.count(key) == 1 for _, notice, key in licenses.TEMPLATES)


@pytest.mark.parametrize("least, most", [(80, 0.05), (90, 0.01)])
def test_unrelated_sets_share_no_part_by_chance(least, most):
    rng = np.random.default_rng(1)
    parts = jaccard.Parts(least)
    for size in (200, 1000, 2000, 10_000):
        signed = [set(parts.of(np.sort(rng.integers(0, 2 ** 64, size, dtype=np.uint64))).tolist()) for _ in range(30)]
        tied = sum(bool(a & b) for a, b in itertools.combinations(signed, 2))
        assert tied <= most * 435


@pytest.mark.parametrize("least", [80, 90])
def test_linked_sets_share_a_part(least):
    rng = np.random.default_rng(2)
    parts = jaccard.Parts(least)
    for size in (1, 2, 5, 8, 9, 10, 30, 100, 1000):
        for _ in range(50):
            a = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
            cut = int(rng.integers(0, size // 3 + 1))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2 ** 64, int(rng.integers(0, size // 3 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= least * (len(a) + len(b) - both):
                assert set(parts.of(a).tolist()) & set(parts.of(b).tolist())


def test_slices_hold_every_row():
    import pyarrow as pa

    from worklake.llm import common

    texts = ["a" * n if n % 7 else None for n in (0, 1, 5, 7, 100, 3, 14, 2, 50)] + [""]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    for limit in (1, 10, 60, 10 ** 6):
        cut = list(common.slices([batch, batch.slice(0, 0)], limit))
        assert [r for part in cut for r in part.to_pylist()] == batch.to_pylist() and (limit > 1000) == (len(cut) == 1)
        assert all(part.num_rows == 1 or sum(len(t or "") + 1 for t in part["text"].to_pylist()[:-1]) <= limit + 1 for part in cut)


def planted():
    """(text, spans) of personal data among look-alikes and clean prose, each form many times with other characters."""
    random.seed(8)
    word = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    digits = lambda n: "".join(random.choice("123456789") for _ in range(n))
    hexed = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    forms = [
        ("mail me at ", lambda: f"{word(5)}.{word(3)}@{word(6)}.com"), ("write to ", lambda: f"{word(6)} [at] {word(5)}.org"),
        ("from ", lambda: f"{random.randrange(11, 99)}.{digits(2)}.{digits(2)}.{digits(2)}"), ("call ", lambda: f"+1 (555) {digits(3)}-{digits(4)}"),
        ("phone ", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("api_key ", lambda: "sk-" + hexed(30)), ("password=", lambda: hexed(20)),
        ("ssn ", lambda: f"1{digits(2)}-{digits(2)}-{digits(4)}"), ("token ", lambda: hexed(40)),
    ]
    clean = [("the ", lambda: word(24)), ("version ", lambda: f"{digits(1)}.{digits(1)}"), ("a ", lambda: f"{word(12)}-{word(12)}"), ("in ", lambda: digits(4)),
             ("order ", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"), ("of ", lambda: "_".join(word(7) for _ in range(4)))]
    out = []
    for i in range(600):
        text, spans = " ".join(word(random.randrange(2, 9)) for _ in range(6)) + " ", []
        for lead, make in random.sample(forms, random.randrange(0, 3)) + random.sample(clean, 2):
            text += lead
            a, value = len(text), make()
            if (lead, make) in forms:
                spans.append((a, a + len(value)))
            text += value + f" {word(4)} {word(5)} "
        out.append((text, spans))
    return out


def test_planted_personal_data_is_found_and_clean_text_is_left_alone(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, (t, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    found = {i: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for i, r in got.items()}
    assert all(r.n_spans == len(found[i]) for i, r in got.items())
    meet = lambda s, others: any(a < s[1] and b > s[0] for a, b in others)
    wanted = [(i, s) for i, (_, spans) in enumerate(rows) for s in spans]
    made = [(i, s) for i, spans in found.items() for s in spans]
    recall = sum(meet(s, found[i]) for i, s in wanted) / len(wanted)
    precision = sum(meet(s, rows[i][1]) for i, s in made) / len(made)
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)
    for r in pii.stage(spark, docs, "").collect():  # the stage decides as the query does
        text = rows[r.doc_id][0]
        for a, b in sorted(found[r.doc_id], reverse=True):
            text = text[:a] + "<>" + text[b:]
        assert regex.sub("<[A-Z_]+>", "<>", r.text) == text


def test_features_hold_no_votes_and_fit_their_table():
    for text in ("x@y.zz", "key sk-" + "a1B_" * 500, "iban DE89 3704 0044 0532 0130 00 ok", "ssn 123-45-6789", "4111 1111 1111 1111\n+1 (555) 555-1234"):
        for kind, a, b, _, _, places in pii.candidates(text):
            assert places == sorted(set(places)) and 0 <= places[0] and places[-1] < pii.FEATURES
            assert places == pii.features(kind, text[a:b], text[max(0, a - pii.BEFORE):a], text[b:b + pii.AFTER])
    weights = pii.train([([0, 5], 1.0, 3.0), ([0, 6], 0.0, 2.0), ([0], 0.5, 1.0)])
    slope = [sum(n * (p - 1 / (1 + 2.718281828459045 ** -pii.evidence(weights, x))) for x, p, n in (([0, 5], 1.0, 3.0), ([0, 6], 0.0, 2.0), ([0], 0.5, 1.0)) if j in x) - weights[j] for j in (0, 5, 6)]
    assert max(map(abs, slope)) < 1e-6  # at the minimum of the penalised loss


def test_languages_by_plain_out_of_place_distance():
    random.seed(5)
    letters = {"aa": "abcde", "bb": "cdefgé", "cc": "жзиa"}

    def grams(text):
        spaced = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [g for n in (1, 2, 3) for i in range(len(spaced) - n + 1) if " " not in (g := spaced[i:i + n])[1:-1] and g.strip() and not g.startswith("  ")]

    def words(lang, n):
        return " ".join("".join(random.choice(letters[lang]) for _ in range(random.randrange(1, 6))) for _ in range(n))
    found = {}
    for lang in letters:
        counts = collections.Counter(grams(words(lang, 400)))
        found[lang] = sorted(counts, key=lambda g: (-counts[g], g))[:60]
    known, furthest = {g for x in found.values() for g in x}, 60
    texts = [words(random.choice(list(letters)), random.randrange(1, 30)) for _ in range(300)] + ["", "12 34", "zzz", "A, b! C?", "abc" * 3000]
    for cells in (1, 10_000, langid.CELLS):
        names, scores = langid.Ranker(found, cells)(texts)
        for text, name, score in zip(texts, names, scores):
            counts = collections.Counter(g for g in grams(text) if g in known)
            top = sorted(counts, key=lambda g: (-counts[g], g))[:furthest]
            far = {lang: sum(abs(i - (x.index(g) if g in x else furthest)) for i, g in enumerate(top)) for lang, x in found.items()}
            best = min(sorted(far), key=far.get)
            if not any(c.isalpha() for c in text):
                assert (name, score) == (langid.UNKNOWN, 0.0), text
            else:
                assert name == best and abs(score - (1 - far[best] / (len(top) * furthest) if top else 0.0)) < 1e-12, text
