"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates their reliabilities, a span classifier decides.

Candidates are the strict (base) spans and looser ones of more kinds that overlap no strict span. Four labelers vote on each: its
pattern, gazetteers (domains, ranges, prefixes, checks), the words before it, and its digits. Votes are counted over all documents per
kind, votes and length class, at most a few thousand different rows. EM on these counts gives the labelers' reliabilities and a
posterior for each row. A logistic span classifier learns these posteriors from what the labelers do not see: shape and characters of
the span and the words around it. It is fitted on a bounded sample, PER_VOTES different spans for each kind and votes, and scores every
span. Strict spans always stay; a looser one stays at CUT or more.

Null or empty text: no spans. Null ids and repeated rows: each row by itself. No candidates: nothing is trained and nothing added.
Very long texts are read whole. Positions are code points, ends are exclusive. A looser e-mail has at most 64 characters before its
(at), labels of 63 and nine labels; the context of a span is 40 characters before it and 20 behind it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import COLUMNS, kept, map_texts, query, table

KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban")
BASE_KINDS = 4
LABELERS = 4
CUT = 0.5
NO, YES, NONE = 0, 1, 2  # votes
PER_VOTES = 300  # spans that the classifier is fitted on, for each kind and votes of the four labelers
BEFORE, AFTER = 40, 20  # characters of context
CONTEXT = 256  # places for hashed words around a span
SEPARATORS = " .-_/+=("
# Places of a span's features: per kind its length class and shape, then separators, marks beside it and hashed words.
SIZES, SHAPES = 10, 20
OF_KIND = 1 + SIZES + SHAPES
SIGNS = len(KINDS) * OF_KIND
WORDS = SIGNS + 2 * len(SEPARATORS)
FEATURES = WORDS + CONTEXT
WORD = re.compile(r"[^\W\d_]+")

# The base patterns as the contract gives them, anchored where that changes no match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser candidates; none can take more than a bounded number of steps at a place.
LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")),
    (3, re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+")),
    (5, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (6, re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
)
# Words before a span that speak for its kind, and words that speak against any.
CUES = tuple(re.compile(rf"(?i)\b(?:{c})\b\W*$") for c in (
    "e-?mail|mail|contact|write to|reach|address", "ip|host|server|address|from|peer", "card|visa|mastercard|amex|credit|payment|number",
    "phone|call|tel|telephone|fax|mobile|contact|whatsapp", "token|key|api[_ ]?key|secret|password|passwd|bearer|auth",
    "ssn|social security|national id|id", "iban|account|bank"))
AGAINST = re.compile(r"(?i)\b(?:version|ver|v|isbn|issn|order|invoice|item|section|figure|chapter|sha|commit)\b\W*$")
# Common top-level domains, and prefixes of well-known credentials.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu us ca it nl ch at be pt pl info biz co dev app".split())
SECRETS = ("sk-", "ghp_", "gho_", "AKIA", "xox", "AIza", "glpat-", "hf_")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it (back to the last match) and a domain after it: what the pattern finds, in linear time."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Strict spans of each base kind, by place."""
    out: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out[1].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out[2].append(m.span())
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out[3].append(m.span())
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _gazetteer(kind: int, s: str) -> int:
    d = _digits(s[:64])
    if kind == 0:
        return YES if s.rpartition(".")[2].lower() in DOMAINS else NO
    if kind == 1:
        parts = [int(p[-3:]) for p in s.split(".")]
        return NO if parts[0] in (0, 127) or parts[0] >= 240 or max(parts) < 10 else YES
    if kind == 2:
        return YES if d[:1] in ("3", "4", "5", "6") else NO
    if kind == 3:
        return YES if s[0] == "+" and d[0] != "0" else NONE
    if kind == 4:
        hexed = len(s) in (32, 40, 64) and all(c in "0123456789abcdef" for c in s)
        return YES if hexed or s.startswith(SECRETS) else NO if s.isalpha() else NONE  # letters alone: a long word
    if kind == 5:
        return NO if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else YES
    return YES if _iban(s) else NO


def _variety(kind: int, s: str) -> int:
    if kind == 0:
        return NONE
    distinct = len(set(s)) if kind == 4 else len(set(_digits(s[:64])))
    if kind == 4:
        return YES if distinct >= 8 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else NO
    return YES if distinct >= 3 else NO


def features(kind: int, s: str, before: str, after: str) -> list[int]:
    """Places of the features that hold for a span: nothing of how the labelers vote."""
    first, n = kind * OF_KIND, len(s)
    shape = first + 1 + SIZES
    digits, capitals = sum("0" <= c <= "9" for c in s), sum("A" <= c <= "Z" for c in s)
    out = [first, first + 1 + min(9, n.bit_length()), shape + 5 * digits // (n + 1), shape + 5 + 5 * capitals // (n + 1), shape + 10 + min(9, len(set(s)).bit_length())]
    out += [SIGNS + i for i, c in enumerate(SEPARATORS) if c in s]
    out += [SIGNS + len(SEPARATORS) + i for i, c in enumerate(SEPARATORS) if before.endswith(c)]
    words = [f"-{i}{w.lower()}" for i, w in enumerate(reversed(WORD.findall(before)[-2:]))] + [f"+{w.lower()}" for w in WORD.findall(after)[:1]]
    return sorted({*out, *(WORDS + zlib.crc32(w.encode("utf-8", "surrogatepass")) % CONTEXT for w in words)})


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(kind, start, end, strict, votes, features) by kind and start. votes: a digit for each labeler, then the length class."""
    if not re.search(r"[0-9@]|\([aA][tT]\)|\[[aA][tT]\]|[A-Za-z0-9_/+=-]{20}", text):
        return []
    spans = [(k, a, b, True) for k, found in enumerate(base_spans(text)) for a, b in found]
    held = sorted((a, b) for _, a, b, _ in spans)
    loose = []
    for kind, pattern in LOOSE:
        loose += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    at, last = 0, 0
    for a, b, kind in sorted(loose, key=lambda x: (x[0], -x[1], x[2])):
        while at < len(held) and held[at][1] <= a:
            at += 1
        if a >= last and not any(h[0] < b and h[1] > a for h in held[at:at + 1]):
            spans.append((kind, a, b, False))
            last = b
    out = []
    for kind, a, b, strict in sorted(spans):
        s, before = text[a:b], text[max(0, a - BEFORE):a]
        name = s.partition("=")[0] if kind == 4 and "=" in s.rstrip("=") else ""  # of `name=value`: a word before the value
        cue = (before + name)[-BEFORE:]
        context = YES if CUES[kind].search(cue) else NO if AGAINST.search(cue) else NONE
        votes = (YES if strict else NO if kind < BASE_KINDS else NONE, _gazetteer(kind, s), context, _variety(kind, s))
        out.append((kind, a, b, strict, "".join(map(str, votes)) + str(min(9, (b - a).bit_length())),
                    features(kind, s, before + name, text[b:b + AFTER])))
    return out


def reliabilities(rows: list[tuple[int, str, int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over (kind, votes, count): labelers' chances of each vote given the class, a prior for each kind, posteriors of the rows."""
    kinds = np.array([r[0] for r in rows])
    votes = np.array([[int(c) for c in r[1][:LABELERS]] for r in rows])
    n = np.array([r[2] for r in rows], np.float64)
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    p = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        chance = np.ones((LABELERS, 2, 3))  # an abstention says nothing: 1 for either class
        for j in range(LABELERS):
            for v in (NO, YES):
                chance[j, 1, v] = (n * p)[votes[:, j] == v].sum() + (2 if v == YES else 1)
                chance[j, 0, v] = (n * (1 - p))[votes[:, j] == v].sum() + (2 if v == NO else 1)
        chance[:, :, :NONE] /= chance[:, :, :NONE].sum(2, keepdims=True)
        prior = np.array([((n * p)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
        z = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for j in range(LABELERS):
            z = z + np.log(chance[j, 1, votes[:, j]]) - np.log(chance[j, 0, votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return chance, prior, p


def posteriors(rows: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """EM's chance that a span of (kind, votes) is personal data."""
    return {(r[0], r[1]): float(p) for r, p in zip(rows, reliabilities(rows)[2])} if rows else {}


def train(spans: list[tuple[list[int], float, float]], rounds: int = 15) -> list[float]:
    """A weight for each feature, from (features, chance, weight) of spans: logistic regression by Newton steps. No spans: no weights."""
    if not spans:
        return []
    w = np.zeros(FEATURES)
    chance, n = np.array([s[1] for s in spans]), np.array([s[2] for s in spans], np.float64)
    for _ in range(rounds):
        slope, curve = -w, np.eye(FEATURES)
        for a in range(0, len(spans), 4096):
            part = spans[a:a + 4096]
            x = np.zeros((len(part), FEATURES))
            for i, (places, _, _) in enumerate(part):
                x[i, places] = 1
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = slope + x.T @ (n[a:a + 4096] * (chance[a:a + 4096] - q))
            curve = curve + (x * (n[a:a + 4096] * q * (1 - q))[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def evidence(weights: list[float], places: list[int]) -> float:
    """Summed in order, as the query does, so that both decide alike (Python's sum rounds otherwise)."""
    total = 0.0
    for p in places:
        total += weights[p]
    return total


LEAST = float(np.log(CUT / (1 - CUT)))  # of a span's summed weights
SPAN = "struct<kind:int,start:int,stop:int,strict:boolean,votes:string,features:array<int>>"


def found(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of every document; the only pass over the texts."""
    def make():
        def fn(cols):
            names = ("kind", "start", "stop", "strict", "votes", "features")
            return {"doc_id": cols["doc_id"], "spans": [[dict(zip(names, c)) for c in candidates(t)] for t in cols["text"]]}
        return fn
    return map_texts(docs.select("doc_id", "text"), make, f"doc_id long, spans array<{SPAN}>")


def fitted(spans: DataFrame) -> list[float]:
    """Weights of the span classifier. To the driver come counts of kinds, votes and length classes over all candidates, at most
    7 * 81 * 10 rows, and at most 7 * 81 * PER_VOTES different spans. Copies of a span are one, weighed by the root of their number."""
    alike = kept(spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count(), "pii-alike")
    counts = alike.groupBy("kind", "votes").agg(F.sum("count").alias("n")).orderBy("kind", "votes").collect()
    chance = posteriors([(r["kind"], r["votes"], r["n"]) for r in counts])
    order = Window.partitionBy("kind", F.substring("votes", 1, LABELERS)).orderBy(F.xxhash64("votes", "features"), "votes", "features")
    sample = alike.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PER_VOTES).drop("place")
    rows = sorted(sample.collect(), key=lambda r: (r["kind"], r["votes"], r["features"]))
    return train([(r["features"], chance[r["kind"], r["votes"]], r["count"] ** 0.5) for r in rows])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of strict spans, base_sha256, spans of every document, and n_spans, the number of all its spans."""
    all_spans = kept(found(docs), "pii-spans")
    weights = fitted(all_spans)
    names = F.array(*map(F.lit, KINDS))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    strict = chosen = F.filter("spans", lambda s: s["strict"])
    if weights:
        table_of = F.array(*map(F.lit, weights))
        chosen = F.filter("spans", lambda s: s["strict"] | (F.aggregate(s["features"], F.lit(0.0), lambda t, f: t + F.get(table_of, f)) >= LEAST))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    return all_spans.select("doc_id", *counts, F.sha2(text(strict), 256).alias("base_sha256"), text(chosen).alias("spans"),
                            F.size(chosen).cast("long").alias("n_spans"))


def _of_kind(kind: int):
    return F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind in angle brackets; n_chars follows. No document goes."""
    docs = docs.select(*COLUMNS)
    weights = fitted(kept(found(docs), "pii-spans"))

    def make():
        def fn(cols):
            texts = []
            for raw in cols["raw"]:
                done, parts = 0, []
                for kind, a, b, strict, _, places in sorted(candidates(raw or ""), key=lambda c: (c[1], -c[2])):
                    if (strict or evidence(weights, places) >= LEAST) and b > done:
                        parts += [raw[done:a], f"<{KINDS[kind].upper()}>"] if a >= done else []
                        done = b
                texts.append(raw if not parts else "".join(parts) + raw[done:])
            sizes = [n if t is r else len(t) for t, r, n in zip(texts, cols["raw"], cols["n_chars"])]
            return {c: cols[c] for c in COLUMNS} | {"text": texts, "n_chars": sizes}
        return fn
    return map_texts(docs, make, ", ".join(f"{c} {t}" for c, t in docs.dtypes))
