"""Phrase collocations by stripes: each prefix keys a counter of the words after it.

The counters of a unit of texts (about UNIT words) are built in the task and packed by the hash of (language, prefix, part of the next
words), so that a prefix's counter is dealt over PARTS groups and the one of the empty prefix (all words) over all groups. A group's
stripes are merged elementwise; what is counted LEAST times or more stays. An entry of a stripe is the count of prefix and word
together, so the same structure holds the extensions of a phrase, the totals of its prefixes and rests (entries of shorter stripes) and
the largest count of the phrases it lies in.

Two passes: stripes of prefixes of none and one word, then of two to four words, whose stripes go on only over frequent pairs of words.
Which pairs are frequent is a map of 2 ** PAIR_BITS hashed bits (16 MB at most); a pair let through by chance is counted and falls at LEAST.
Larger corpora fill the map, which costs work and changes no result.

Null or empty text: no words. Null lang: `und`. Null ids, repeated rows: each row counts. Ties: see the order of `ranked`. Very long texts
are cut into pieces at separators only. No rows: no rows. Products are decimals: exact up to 10 ** 15 words a language.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import kept, query, table

LEAST = 100
LONGEST = 5
TOP = 2000
UNIT = 1_000_000  # words counted together in a task
PARTS = 64
GROUP = 1_000_000  # entries of a group of stripes, about
PAIR_BITS = 27
SALTS = 8

# As the contract gives them, separators of pieces become line feeds, tabs spaces, and A-Z are lower-cased.
FOLD = bytes(10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

STRIPES = "grp long, lang string, prefixes array<binary>, sizes array<int>, words array<binary>, counts array<long>"
_STRIPES = pa.schema([("grp", pa.int64()), ("lang", pa.string()), ("prefixes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())),
                      ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
ENTRIES = "lang string, size int, phrase string, a long"
_ENTRIES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("a", pa.int64())])


def pair_bits(lang: str, first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs of words in the map, from the words' hashes."""
    return ((first * 1_000_003 + second) ^ zlib.crc32(lang.encode())) & ((1 << bits) - 1)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Unit:
    """Words of texts of one language as numbers; 0 stands between pieces, 1 for the nothing between two blanks."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.ids = lang, Numbers({b"\n": 0, b"": 1}), array("q", [0])

    def add(self, text: bytes) -> int:
        words = text.translate(FOLD).replace(b"\n", b" \n ").split(b" ")
        self.ids.extend(map(self.numbers.__getitem__, words))
        self.ids.append(0)
        return len(words)

    def stripes(self, pairs: np.ndarray | None, bits: int, groups: int) -> Iterator[pa.RecordBatch]:
        """Packed stripes: of prefixes of none and one word without a map of pairs, of two to four words with one."""
        ids = np.frombuffer(self.ids, np.int64)
        ids = ids[ids != 1]
        names = list(self.numbers)
        words = np.array(names, object)
        hashes = np.array([zlib.crc32(w) for w in names], np.int64)
        arrow = pa.array(names, pa.binary())
        places = np.flatnonzero(ids > 0)
        if not len(places):
            return
        if pairs is None:
            counts = np.bincount(ids[places], minlength=len(words))
            word = np.flatnonzero(counts)
            yield self._packed([b""], np.zeros(len(word), np.int64), word, arrow, hashes, counts[word], groups)
        phrases, last, prefix_at = words, np.arange(len(words)), ids[places]  # the phrase that ends at a place, its last word
        for size in range(1, 2 if pairs is None else LONGEST):
            on = ids[places + 1] > 0  # the last id is a 0
            places, prefix_at = places[on] + 1, prefix_at[on]
            if pairs is not None:
                bit = pair_bits(self.lang, hashes[last[prefix_at]], hashes[ids[places]], bits)
                on = (pairs[bit >> 3] >> (bit & 7) & 1).astype(bool)
                places, prefix_at = places[on], prefix_at[on]
            if not len(places):
                return
            code, found = np.unique(prefix_at * len(words) + ids[places], return_inverse=True)
            prefix, word = code // len(words), code % len(words)
            if pairs is None or size > 1:
                yield self._packed(phrases.tolist(), prefix, word, arrow, hashes, np.bincount(found), groups)
            if pairs is not None:
                phrases, last, prefix_at = phrases[prefix] + b" " + words[word], word, found

    def _packed(self, phrases: list[bytes], prefix, word, arrow: pa.Array, hashes, counts, groups: int) -> pa.RecordBatch:
        """The stripes of one length of prefix, a row for each group."""
        seed = zlib.crc32(self.lang.encode())
        start = np.array([zlib.crc32(p, seed) for p in phrases], np.int64)
        part = hashes[word] if phrases == [b""] else (hashes[word] >> 7) % PARTS
        group = ((start[prefix] * 1_000_003 + part) % 2_147_483_647) % groups
        order = np.lexsort((word, prefix, group))
        group, prefix, word, counts = group[order], prefix[order], word[order], counts[order]
        new_group = np.r_[True, group[1:] != group[:-1]]
        heads = np.flatnonzero(new_group | np.r_[True, prefix[1:] != prefix[:-1]])  # where a stripe begins
        cuts = np.flatnonzero(new_group)
        ends = pa.array(np.append(cuts, len(group)), pa.int32())
        of_heads = pa.array(np.searchsorted(heads, np.append(cuts, len(group))), pa.int32())
        sizes = np.diff(np.append(heads, len(group))).astype(np.int32)
        columns = [pa.array(group[cuts], pa.int64()), pa.array([self.lang] * len(cuts), pa.string()),
                   pa.ListArray.from_arrays(of_heads, pa.array(phrases, pa.binary()).take(pa.array(prefix[heads]))),
                   pa.ListArray.from_arrays(of_heads, pa.array(sizes)), pa.ListArray.from_arrays(ends, arrow.take(pa.array(word))),
                   pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, schema=_STRIPES)


def stripes(docs: DataFrame, groups: int, pairs: bytes | None = None, bits: int = 0) -> DataFrame:
    """Packed stripes of all texts; see Unit.stripes."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs) if pairs is not None else None  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        units: dict[str, Unit] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                lang = lang.as_py()
                unit = units.get(lang) or units.setdefault(lang, Unit(lang))
                held += unit.add(text.as_py() or b"")
                if held >= UNIT:
                    for u in units.values():
                        yield from u.stripes(found, bits, groups)
                    units, held = {}, 0
        for u in units.values():
            yield from u.stripes(found, bits, groups)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, STRIPES)


def _merge(least: int):
    def run(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _ENTRIES.names}
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(group["lang"].to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        for lang, at in by_lang.items():
            part = group.take(at)
            flat = {c: part[c].combine_chunks() for c in ("prefixes", "sizes", "words", "counts")}
            flat = {c: (v.chunk(0) if isinstance(v, pa.ChunkedArray) else v).flatten() for c, v in flat.items()}
            prefixes, words = flat["prefixes"].dictionary_encode(), flat["words"].dictionary_encode()
            prefix = np.repeat(np.asarray(prefixes.indices), np.asarray(flat["sizes"])).astype(np.int64)
            code, found = np.unique(prefix * len(words.dictionary) + np.asarray(words.indices), return_inverse=True)
            counts = np.zeros(len(code), np.int64)
            np.add.at(counts, found, np.asarray(flat["counts"]))
            root = pc.index(prefixes.dictionary, pa.scalar(b"", pa.binary())).as_py()
            if root >= 0:  # this group's part of the language's words
                for name, value in zip(out, (lang, 0, None, int(counts[code // len(words.dictionary) == root].sum()))):
                    out[name].append(value)
            for c, a in zip(code[counts >= least].tolist(), counts[counts >= least].tolist()):
                p, w = prefixes.dictionary[c // len(words.dictionary)].as_py(), words.dictionary[c % len(words.dictionary)].as_py()
                out["lang"].append(lang)
                out["size"].append(p.count(b" ") + 2 if p else 1)
                out["phrase"].append((p + b" " + w if p else w).decode())
                out["a"].append(a)
        return pa.table(out, schema=_ENTRIES)
    return run


def merged(packed: DataFrame, groups: int, least: int) -> DataFrame:
    """lang, size, phrase, a of the entries of all stripes that reach least; rows of size 0 hold parts of a language's words."""
    return packed.repartition(max(8, groups // 4), "grp").groupBy("grp").applyInArrow(_merge(least), ENTRIES)


def pair_map(entries: DataFrame, bits: int) -> bytes:
    """The bits of the frequent pairs, or'ed together in Spark by chunks of the map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(lang, *map(zlib.crc32, phrase.encode().split(b" "))) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"bit": pa.array([pair_bits(lang, a, b, bits) for lang, a, b in pairs], pa.int64())})

    numbers = entries.where("size = 2").select("lang", "phrase").mapInArrow(run, "bit long").select((F.col("bit") + 1).alias("bit"))
    chunks = numbers.groupBy(F.expr("bitmap_bucket_number(bit)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in chunks.collect():  # the map's own chunks
        part = np.frombuffer(row["map"], np.uint8)
        out[(row["at"] - 1) * len(part):row["at"] * len(part)] = part
    return out.tobytes()


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, a of all phrases of one to LONGEST words that stand least times or more; rows of size 0 sum up to n."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0  # at most as many words
    groups = max(8, -(-chars // (4 * GROUP)))
    bits = min(PAIR_BITS, max(16, int(chars // 8).bit_length()))
    short = kept(merged(stripes(docs, groups), groups, least), "collocations-1")
    long = merged(stripes(docs, groups, pair_map(short, bits), bits), groups, least)
    return short.unionByName(kept(long, "collocations-2"))


def ranked(counts: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases by score and a, falling, and phrase, from frequent()."""
    n = counts.where("size = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    phrases = counts.where("size >= 2").select("lang", "size", "phrase", "a", F.split("phrase", " ").alias("words"))
    part = counts.where("size >= 1").select("lang", "phrase", "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def joined(frm, length):
        return F.array_join(F.slice("words", frm, length), " ")
    # what lies in a phrase of one word more at the same count goes; a longer phrase that holds it passes through one of these
    inside = phrases.where("size >= 3").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    left = phrases.join(inside, ["lang", "phrase"], "left").where("above IS NULL OR above < a").drop("above")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = cuts.join(part.select("lang", "salt", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "salt", "first"])
    cuts = cuts.join(part.select("lang", "salt", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "salt", "rest"])
    cuts = cuts.join(n, "lang")  # a row for each language

    def wide(column: str):
        return F.col(column).cast("decimal(15,0)")
    cuts = cuts.withColumn("above", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", wide("l") * wide("r"))
    score = F.expr("above div below")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
  SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size)
      GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size >= 2),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS longer ON c.lang = longer.lang AND longer.size > c.size
           AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * longer.a >= 100 * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c ANTI JOIN inside USING (lang, phrase)) AS c),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
b AS (SELECT lang, phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    return ranked(frequent(docs.select("lang", "text"), least), top)


@query("op12_collocations", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
