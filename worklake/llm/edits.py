"""Document fingerprints by randomised edit embedding: near copies differ in few places of a walk that all documents share.

The walk stands at a character; at step j a random bit of (j, character), the same for every document, says whether it goes on to the
next one. Walks part at an edit and soon meet again, so edit distance turns into Hamming distance. A walk has 3n steps; behind the
last character a blank follows. The fingerprint samples one bit of the character at WIDTH steps of every octave of steps, so it grows
with the logarithm of the length: `length in hex - bits in hex`. Likeness is the share of equal bits, each octave weighed by its steps
(up to twice the longer length, where walks end), with the share that chance gives taken off. Bands of sampled bits find candidates
for near copies, which are verified by the likeness of whole fingerprints.

Null text is empty. Empty texts: fingerprint `0-`, likeness 1 to each other and 0 to others. Rows of one id follow each other by text.
Null ids come last, by text. A single row is its own next document. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from worklake.llm.common import pieces, query, table

WIDTH = 128  # sampled steps of an octave
CHUNK = 1 << 16  # steps whose random numbers are drawn together
KEPT = 64  # chunks that stay in memory
FEW = 32  # walks that go on one by one
GAP = 33  # blanks behind a text, more than the steps between two looks at the ends
BANDS, BAND_BITS = 12, 20
ROWS = 1000  # documents of a bucket of neighbours, about
MOST_BUCKETS = 65_536


class Walk:
    """The shared random numbers: for each step a multiplier and a shift for moving on, for each sampled step another pair for its bit."""

    def __init__(self, seed: int = 11):
        self.seed = seed
        self.chunks: dict[int, np.ndarray] = {}
        self.columns: dict[int, int] = {}
        self.marks = np.zeros((2, 0), np.uint32)

    def moves(self, chunk: int) -> np.ndarray:
        """Numbers of CHUNK steps; the first KEPT chunks stay, later ones are drawn again when needed."""
        if chunk in self.chunks:
            return self.chunks[chunk]
        drawn = np.random.default_rng([self.seed, 0, chunk]).integers(0, 1 << 32, (2, CHUNK), np.uint32)
        drawn[0] |= 1
        if chunk < KEPT:
            self.chunks[chunk] = drawn
        return drawn

    def reach(self, octaves: int) -> None:
        for octave in range(self.marks.shape[1] // WIDTH + 1, octaves + 1):
            for i, j in enumerate(samples(octave, self.seed)):
                self.columns[int(j)] = (octave - 1) * WIDTH + i
            drawn = np.random.default_rng([self.seed, 1, octave]).integers(0, 1 << 32, (2, WIDTH), np.uint32)
            self.marks = np.concatenate([self.marks, drawn | np.uint32([[1], [0]])], axis=1)

    def bits(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The sampled bits of each text, given as character codes. Long tails of few texts are walked one by one."""
        if not codes:
            return []
        lengths = np.array([len(c) for c in codes], np.int64)
        octaves = [octaves_of(n) for n in lengths]
        self.reach(max(octaves))
        wide = max(octaves) * WIDTH
        out = np.empty((len(codes), wide), np.uint8)
        out[:] = self.marks[1, :wide] >> 31  # of a blank
        row = np.argsort(-lengths, kind="stable")
        flat, pos, here = np.zeros(int(lengths.sum()) + GAP * len(codes), np.uint32), np.zeros(len(codes), np.int64), 0
        for k, i in enumerate(row):
            pos[k] = here
            flat[here:here + lengths[i]] = codes[i]
            here += lengths[i] + GAP
        end, limit, j = pos + lengths[row], 3 * lengths[row], 0
        while True:
            if j % 32 == 0:
                on = (pos < end) & (limit > j)
                if not on.all():
                    pos, end, limit, row = pos[on], end[on], limit[on], row[on]
                if len(row) <= FEW:
                    break
                if j % CHUNK == 0:
                    move, shift = self.moves(j // CHUNK)
            c = flat[pos]
            column = self.columns.get(j)
            if column is not None and column < wide:
                on = limit > j  # a walk ends at its limit, also between two looks at the ends
                out[row[on], column] = (c[on] * self.marks[0, column] + self.marks[1, column]) >> 31
            pos = pos + ((c * move[j % CHUNK] + shift[j % CHUNK]) >> 31)
            j += 1
        for r, p, e in zip(row.tolist(), pos.tolist(), end.tolist()):
            self._alone(flat[p:e], j, out[r], 3 * int(lengths[r]))
        return [o[:k * WIDTH] for o, k in zip(out, octaves)]

    def _alone(self, codes: np.ndarray, j: int, out: np.ndarray, limit: int) -> None:
        text, columns, p, n = codes.tolist(), self.columns, 0, len(codes)
        while p < n and j < limit:
            upto = min(limit, (j // CHUNK + 1) * CHUNK, j + 8192)
            move, shift = self.moves(j // CHUNK)[:, j % CHUNK:j % CHUNK + upto - j].tolist()
            for j, a, b in zip(range(j, upto), move, shift):
                c = text[p]
                if j in columns and (column := columns[j]) < len(out):
                    out[column] = ((c * int(self.marks[0, column]) + int(self.marks[1, column])) & 0xFFFFFFFF) >> 31
                p += ((c * a + b) & 0xFFFFFFFF) >> 31
                if p == n:
                    return
            j += 1


def span(octave: int) -> tuple[int, int]:
    """Steps of an octave, counted from 1; 0 is before the first."""
    return (0, WIDTH) if octave == 1 else (WIDTH << octave - 2, WIDTH << octave - 1) if octave else (0, 0)


def samples(octave: int, seed: int = 11) -> np.ndarray:
    first, last = span(octave)
    return first + np.sort(np.random.default_rng([seed, octave]).choice(last - first, WIDTH, replace=False))


def octaves_of(n: int) -> int:
    """Octaves that 3n steps reach."""
    return 0 if not n else 1 + max(0, (3 * int(n) - 1) // WIDTH).bit_length()


def codes_of(text: str) -> np.ndarray:
    """Character codes without 0, which is the blank."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)


def as_text(n: int, bits: np.ndarray) -> str:
    return f"{n:x}-{np.packbits(bits).tobytes().hex()}"


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], seed: int = 11) -> float:
    """Of two (length, bits), 0 to 1."""
    (n, x), (m, y) = a, b
    if n == m and np.array_equal(x, y):
        return 1.0
    if not n or not m:
        return 0.0
    last, octaves = 2 * max(n, m), max(len(x), len(y)) // WIDTH
    total = weight = 0.0
    for k in range(1, octaves + 1):
        first = span(k)[0]
        steps = min(last, span(k)[1]) - first
        if steps <= 0:
            break
        used = int(np.searchsorted(_steps(k, seed), last))
        p, q = x[(k - 1) * WIDTH:][:used], y[(k - 1) * WIDTH:][:used]
        if used:
            total += steps * (float(np.mean(p == q)) if len(p) == len(q) else 0.5)
            weight += steps
    return min(1.0, max(0.0, 2 * total / weight - 1))


_known: dict[tuple[int, int], np.ndarray] = {}


def _steps(octave: int, seed: int) -> np.ndarray:
    if (octave, seed) not in _known:
        _known[octave, seed] = samples(octave, seed)
    return _known[octave, seed]


def bands(n: int, bits: np.ndarray, seed: int = 11) -> list[str]:
    """Keys of sampled bits. All but the last two octaves are used, which texts of nearly one length share; short texts use what there is."""
    octaves = len(bits) // WIDTH
    if not octaves:
        return ["empty"]
    out = []
    for top in {max(1, octaves - 2), max(1, octaves - 3)}:
        rng = np.random.default_rng([seed, top, 1])
        for b in range(BANDS):
            chosen = rng.choice(top * WIDTH, BAND_BITS, replace=False)
            out.append(f"{top}:{b}:{np.packbits(bits[chosen]).tobytes().hex()}")
    return out


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by as many of the following text's first ones, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, tail: documents in buckets of neighbouring ids, and the first of each also as the tail of the bucket before.

    One row for each bucket comes to the driver and is broadcast: its least id, MOST_BUCKETS at most.
    """
    docs = docs.select("doc_id", "text")
    n = docs.where("doc_id IS NOT NULL").count()
    count = min(MOST_BUCKETS, max(1, n // ROWS))
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", [i / count for i in range(1, count)], 1 / (4 * count)))) if count > 1 else []

    def placed(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("bucket", F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long"))
        cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="id", outputCol="place", handleInvalid="keep")
        df = cut.transform(df.withColumn("id", F.col("doc_id").cast("double")))
        return df.withColumn("bucket", F.col("place").cast("long")).drop("id", "place")
    firsts = placed(docs.select("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()
    before = [(r["first"], firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    tails = docs.sparkSession.createDataFrame(before, "first long, tail_of long")
    rows = placed(docs).join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail")), F.struct(F.col("tail_of").alias("bucket"), F.lit(1).alias("tail")))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("tail_of").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("b"))
    rows = rows.select("doc_id", "text", "b.bucket", "b.tail")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
       "near_next double, bands array<string>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands of every document."""
    out = to_arrow_schema(StructType.fromDDL(OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, rows = Walk(), []
        for batch in batches:
            cols = batch.to_pydict()
            rows += list(zip(cols["bucket"], cols["tail"], cols["doc_id"], (t or "" for t in cols["text"])))
            for a, b in pieces([r[3] for r in rows[:-1]], 8_000_000):  # the last row waits for the one that follows
                yield from _made(walk, rows[a:b + 1])
            rows = rows[-1:]

    def _made(walk: Walk, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return
        after = [edited(texts[i], texts[i + 1]) for i in pairs]
        bits = walk.bits([codes_of(t) for t in texts] + [codes_of(t) for t in after])
        own, changed = bits[:len(texts)], bits[len(texts):]
        made = []
        for i, t, c in zip(pairs, after, changed):
            n, x = len(texts[i]), own[i]
            made.append((rows[i][2], n, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), as_text(n, x), as_text(len(t), c),
                         likeness((n, x), (len(t), c)), likeness((n, x), (len(texts[i + 1]), own[i + 1])), bands(n, x)))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)
    return neighbours(docs).mapInArrow(run, OUT)


def near_copies(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, first_id, near: documents verified to be near the smallest id with which they share a band. No pairs within a band."""
    keys = prints.select("doc_id", F.explode("bands").alias("band")).where("doc_id IS NOT NULL")
    firsts = keys.groupBy("band").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    links = keys.join(firsts, "band").where("doc_id <> first_id").select("doc_id", "first_id").distinct()
    one = prints.groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"))
    first = one.select(F.col("doc_id").alias("first_id"), F.col("fingerprint").alias("first_print"))

    def run(batches):
        for batch in batches:
            near = [likeness(_parsed(a), _parsed(b)) for a, b in zip(batch["fingerprint"].to_pylist(), batch["first_print"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["first_id"], pa.array(near, pa.float64())], ["doc_id", "first_id", "near"])
    joined = links.join(one, "doc_id").join(first, "first_id").select("doc_id", "first_id", "fingerprint", "first_print")
    return joined.mapInArrow(run, "doc_id long, first_id long, near double").where(F.col("near") >= least)


def _parsed(text: str) -> tuple[int, np.ndarray]:
    n, _, bits = text.partition("-")
    return int(n, 16), np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8))


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
