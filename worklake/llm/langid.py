"""Language ID by rank order: a document's most frequent n-grams against each language's profile, by out-of-place distance.

A profile is the PROFILE most frequent n-grams (1 to 3 letters, words padded with a space) of a bounded sample of labelled documents:
at most PER_LANGUAGE a language, LABELLED in all, taken by a hash of the id. Only n-grams of some profile are ranked in a document: any
other is as far from every language.

Null text or text without a letter: `und`, score 0. Letters but no known n-gram: the first language, score 0. Ties: the language that
sorts first. Labelled rows with null text teach nothing. No labelled rows: `und` for all. Repeated rows and null ids: each row by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import COLUMNS, give_back, map_texts, query, slices, table

PROFILE = 400
PER_LANGUAGE = 3000
LABELLED = 50_000
UNKNOWN = "und"
DENSE = 1 << 22  # codes of n-grams up to which a table is held for them; more are looked up in sorted order
CELLS = 4_000_000  # counts of documents and n-grams that are held together
STAGE_CELLS = 500_000  # the same in the pipeline, where the JVM holds whole texts as well


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, labelled: int = LABELLED) -> DataFrame:
    """text and lang of the rows to learn from; their ids, at most `labelled`, are broadcast.

    A language's rows are thinned by their hashes to about twice per_language before they are ranked, so that a ranking task's rows don't
    grow with the input. Of more languages than `labelled` only the first by name can be in the sample; so many rows hold their counts.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    counts = known.groupBy("lang").count().orderBy("lang").limit(labelled)
    by_hash = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    thinned = known.join(F.broadcast(counts), "lang").where(by_hash / F.lit(2.0 ** 63) * F.col("count") <= 2 * per_language)
    first = Window.partitionBy("lang").orderBy(by_hash, "doc_id")
    ids = thinned.select("doc_id", "lang").withColumn("place", F.row_number().over(first))
    ids = ids.where(F.col("place") <= per_language).orderBy("place", "lang").limit(labelled).select("doc_id").distinct()
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").where("lang IS NOT NULL").select("text", "lang")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
            clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
            words.setdefault(lang, Counter()).update(clean.split())
        for lang, seen in words.items():
            own = counts.setdefault(lang, Counter())
            for word, n in seen.items():
                padded = f" {word} "
                for order in (1, 2, 3):
                    for i in range(len(padded) - order + 1):
                        own[padded[i:i + order]] += n
    rows = [(lang, g, n) for lang, own in counts.items() for g, n in own.items() if g != " "]
    for at in range(0, len(rows), 50_000):
        part = list(zip(*rows[at:at + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1]), pa.array(part[2], pa.int64())], ["lang", "gram", "n"])


def profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, most frequent first. size rows a language come to the driver."""
    counts = labelled.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append(r.gram)
    return found


class Numbers:
    """Numbers 0, 1, ... of codes in their order; `none` for any other code."""

    def __init__(self, codes: dict[int, int], none: int, most: int):
        self.none = none
        self.codes = np.array(sorted(codes) or [-1], np.int64)
        self.numbers = np.array([codes[c] for c in sorted(codes)] or [none], np.int32)
        self.table = None
        if most <= DENSE:
            self.table = np.full(most, none, np.int32)
            self.table[list(codes)] = list(codes.values())

    def __getitem__(self, asked: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[asked]
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        return np.where(self.codes[at] == asked, self.numbers[at], self.none)


class Ranker:
    """Profiles over signs: all letters of the profiles are numbered, an n-gram is a code of one to three signs. 0 is no letter, the last
    sign any letter that no profile has."""

    def __init__(self, found: dict[str, list[str]], cells: int = CELLS):
        self.langs, self.cells = sorted(found), cells
        letters = sorted({c for grams in found.values() for g in grams for c in g if c != " "})
        self.sign = {c: i + 1 for i, c in enumerate(letters)}
        self.base = len(letters) + 2
        known = sorted({g for grams in found.values() for g in grams})
        self.size = len(known)
        number = {g: i for i, g in enumerate(known)}
        codes: list[dict[int, int]] = [{}, {}, {}]
        for g, i in number.items():
            at = 0
            for c in g:
                at = at * self.base + self.sign.get(c, 0)
            codes[len(g) - 1][at] = i
        self.tables = [Numbers(c, self.size, self.base ** (k + 1)) for k, c in enumerate(codes)]
        self.furthest = max(map(len, found.values()), default=1)
        self.ranks = np.full((len(self.langs), self.size), self.furthest, np.int32)
        for row, lang in zip(self.ranks, self.langs):
            for rank, g in enumerate(found[lang]):
                row[number[g]] = rank
        self.signs = None

    def _signs(self, codes: np.ndarray) -> np.ndarray:
        if self.signs is None:  # once a worker; not sent from the driver
            self.signs = np.fromiter((self.base - 1 if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)
            for c, i in self.sign.items():
                self.signs[ord(c)] = i
        return self.signs[codes]

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        step = min(256, max(1, self.cells // (self.size + 1)))
        for at in range(0, len(texts), step):
            low = [t.lower() for t in texts[at:at + step]]
            n = len(low)
            signs = self._signs(np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32))
            lengths = np.array([len(t) + 1 for t in low])
            lengths[-1] += 1
            doc = np.concatenate([[0], np.repeat(np.arange(n), lengths)])[:len(signs)]
            wide, index = self.size + 1, signs.astype(np.int64)
            counts = np.zeros(n * wide, np.int64)
            for order in (1, 2, 3):
                if order > 1:
                    index = index[:-1] * self.base + signs[order - 1:]
                held = self.tables[order - 1][index]
                counts += np.bincount(doc[order - 1:] * wide + held, minlength=n * wide)  # an n-gram counts where it ends
            counts = counts.reshape(n, wide)[:, :self.size]
            letters = np.bincount(doc, weights=signs > 0, minlength=n) > 0
            order = np.argsort(-counts, axis=1, kind="stable")[:, :self.furthest]
            seen = np.take_along_axis(counts, order, 1) > 0
            place = np.arange(order.shape[1])
            far = np.stack([np.where(seen, np.abs(place - r[order]), 0).sum(1) for r in self.ranks]) if self.langs else np.zeros((1, n))
            best, most = far.argmin(0), np.maximum(1, seen.sum(1)) * self.furthest
            for i in range(n):
                ok = letters[i] and self.langs
                names.append(self.langs[best[i]] if ok else UNKNOWN)
                scores.append(float(max(0.0, 1 - far[best[i], i] / most[i])) if ok and seen[i].any() else 0.0)
        return names, scores


def predict(docs: DataFrame, found: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred, score; whole texts."""
    def make():
        ranker = Ranker(found)

        def fn(cols):
            names, scores = ranker(cols["text"])
            return {"doc_id": cols["doc_id"], "lang_pred": names, "score": scores}
        return fn
    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def _part(docs: DataFrame):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = profiles(sample(docs.where(_part(docs) != 2)))
    return predict(docs, found).select("doc_id", F.coalesce(_part(docs) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.05) -> DataFrame:
    """Documents in a language that can be told: those without a letter, and those unlike every profile, go."""
    found = profiles(sample(docs))

    @F.arrow_udf("boolean")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # texts go to the worker, only the decision comes back
        ranker = Ranker(found, cells=STAGE_CELLS)
        for texts in batches:
            keep: list[bool] = []
            for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 500_000):
                keep += [lang != UNKNOWN and s >= least for lang, s in zip(*ranker([t or "" for t in part.column(0).to_pylist()]))]
            yield pa.array(keep, pa.bool_())
            give_back()
    return docs.select(*COLUMNS).where(told("text"))
