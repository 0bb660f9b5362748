"""Ranked lexical search over a K2-treap of the term-document grid.

One pass over the texts keeps, per document, its size and how often it holds each term that items may ask for. A fixed map of TERM_BITS
hashed terms (128 KB) says which those are; a term let through by chance only lies in the index. Documents are dealt into blocks of
bounded size. A block's grid has its terms as rows and its documents as columns; it is cut into quarters down to single cells, empty
quarters are left out, and every quarter keeps the largest impact in it (as the difference to the quarter it lies in), so the children
of a quarter are found by counting bits. An item's terms go down their rows together: the bound of a range of documents is the sum of
weight times largest impact over the terms' quarters there, the ranges with the best bounds are opened first, and ranges below the
k-th score are never opened. Ranges as good as the k-th score are opened, since a smaller id may lie there. The k best of each block are merged.

Null or empty text: no terms. Rows repeated or with one id: each is a document, each row of the items is an item, with ranks of its
own. Null ids come after all others among equal scores. Very long texts are counted whole. No documents, or items: no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import kept, query, table

TERM_BITS = 1 << 20
DOCUMENTS, POSTINGS = 8192, 1_000_000  # of a block, about
ITEMS = 1024  # of a group
OPENED = 256  # ranges opened at a time
FRONTIER = 1 << 23  # rows times ranges waiting; beyond it the deepest ranges go first

# What separates terms, as the contract gives it; only A-Z are lower-cased, in the bytes of UTF-8.
TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256))

COUNTED = "uid long, doc_id long, n long, terms array<binary>, counts array<int>"
INDEX = "block long, side int, ids array<long>, terms array<binary>, masks binary, drops array<int>"
ASKED = "item long, item_id long, terms array<binary>, weights array<long>"
FOUND = "item long, item_id long, doc_id long, score long"


def counted(df: DataFrame, key: str, asked: bytes | None = None) -> DataFrame:
    """uid (a number of the row), key as doc_id, n, terms with their counts; only terms on the map, where one is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 33
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("uid", "doc_id", "n", "terms", "counts")}
            held = 0
            for i, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                found = (text.as_py() or b"").translate(TERMS).split()
                tf = Counter(found)
                if asked is not None:
                    tf = {t: c for t, c in tf.items() if asked[(h := zlib.crc32(t) % TERM_BITS) >> 3] >> (h & 7) & 1}
                for name, value in zip(out, (uid, i.as_py(), len(found), list(tf), list(tf.values()))):
                    out[name].append(value)
                uid += 1
                held += len(tf)
                if held > POSTINGS:
                    yield _batch(out)
                    out, held = {c: [] for c in out}, 0
            yield _batch(out)

    return df.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def term_map(items: DataFrame) -> bytes:
    """A bit for each hashed term of the items; at most TERM_BITS numbers come to the driver, whatever the number of items."""
    bits = np.zeros(TERM_BITS // 8, np.uint8)
    numbers = items.select(F.explode("terms").alias("t")).select((F.crc32("t") % TERM_BITS).cast("int").alias("h")).distinct()
    for batch in numbers.toArrow().to_batches():
        h = batch.column(0).to_numpy(zero_copy_only=False)
        np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
    return bits.tobytes()


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x at every second place."""
    out = np.zeros(len(x), np.int64)
    for b in range(31):
        out |= (x >> b & 1) << (2 * b)
    return out


def build(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of four bits and drops of the maxima, from the root down and left to right. The last level has no children, its masks are 0."""
    code = _spread(rows) << 1 | _spread(columns)
    order = np.argsort(code, kind="stable")
    code, top = code[order], impacts[order]
    masks, drops = [np.zeros(len(code), np.uint8)], []
    for _ in range(height):
        parent = code >> 2
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        upper = np.maximum.reduceat(top, first)
        drops.append(np.repeat(upper, np.diff(np.r_[first, len(code)])) - top)
        masks.append(np.bitwise_or.reduceat((1 << (code & 3)).astype(np.uint8), first))
        code, top = parent[first], upper
    drops.append(-top)  # the root's own maximum, below zero
    return np.concatenate(masks[::-1]), np.concatenate(drops[::-1]).astype(np.int32)


class Treap:
    """One block's grid, read back from masks and drops."""

    BITS = np.array([bin(m).count("1") for m in range(16)], np.int32)

    def __init__(self, height: int, masks: np.ndarray, drops: np.ndarray):
        self.height, self.masks = height, masks
        self.first = np.cumsum(self.BITS[masks], dtype=np.int32) - self.BITS[masks] + 1  # a level's children lie behind all before it
        self.top = np.zeros(len(masks) + 1, np.int64)  # the last entry stands for an empty quarter
        start, width = 0, 1
        for _ in range(height + 1):
            level = slice(start, start + width)
            self.top[level] = -drops[level] if start == 0 else above - drops[level]
            above = np.repeat(self.top[level], self.BITS[masks[level]])
            start, width = start + width, len(above)
        self.masks = np.append(masks, np.uint8(0))
        self.first = np.append(self.first, np.int32(0))

    def child(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.masks[cells]
        at = self.first[cells] + self.BITS[mask & ((1 << quarter) - 1)]
        return np.where(mask >> quarter & 1, at, len(self.masks) - 1)

    def search(self, rows: np.ndarray, weights: np.ndarray, order: np.ndarray, k: int) -> list[tuple[int, int]]:
        """[(score, column)] of the k best columns with a score above 0; equal ones by order."""
        best: list[tuple[int, int, int]] = []  # heap of (score, -order, column)
        level, start = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int64)
        bound = self.top[cells] @ weights
        if not self.height:
            return [(int(bound[0]), 0)] if bound[0] > 0 else []
        while len(bound):
            least = best[0][0] if len(best) == k else 1
            chosen = np.arange(len(bound))
            if len(bound) > OPENED:
                by = level if cells.size > FRONTIER else bound
                chosen = np.argpartition(-by, OPENED)[:OPENED]
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            row = (rows[None, :] >> (self.height - 1 - level[chosen])[:, None] & 1) << 1
            halves = [self.child(cells[chosen], row | side) for side in (0, 1)]
            new_cells = np.concatenate(halves)
            new_level = np.tile(level[chosen] + 1, 2)
            new_start = np.concatenate([start[chosen] * 2, start[chosen] * 2 + 1])
            new_bound = self.top[new_cells] @ weights
            done = (new_level == self.height) & (new_bound >= least)
            for score, column in zip(new_bound[done].tolist(), new_start[done].tolist()):
                entry = (score, -int(order[column]), column)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            least = best[0][0] if len(best) == k else 1
            go, stay = (new_level < self.height) & (new_bound >= least), rest & (bound >= least)
            level, start = np.concatenate([level[stay], new_level[go]]), np.concatenate([start[stay], new_start[go]])
            bound, cells = np.concatenate([bound[stay], new_bound[go]]), np.concatenate([cells[stay], new_cells[go]])
        return [(score, column) for score, _, column in sorted(best, reverse=True)]


def _index(documents: int, length: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        n = np.asarray(group["n"])
        order = np.argsort(n, kind="stable")  # ranges of documents of like size
        group = group.take(pa.array(order))
        m = [75 + 25 * x * documents // length for x in n[order].tolist()]
        sizes = np.array([len(t) for t in group["terms"]], np.int64)
        columns = np.repeat(np.arange(len(m)), sizes)
        names: dict[bytes, int] = {}
        rows = np.array([names.setdefault(t, len(names)) for part in group["terms"] for t in part.as_py()], np.int64)
        tf = group["counts"].combine_chunks()
        tf = np.asarray((tf.chunk(0) if isinstance(tf, pa.ChunkedArray) else tf).flatten()).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        impacts = np.array([1_000_000_000 * c // (1000 * c + 12 * m[d]) for c, d in zip(tf.tolist(), columns.tolist())], np.int64)
        if not len(rows):
            return pa.table({"block": [], "side": [], "ids": [], "terms": [], "masks": [], "drops": []}, schema=_INDEX)
        height = max(len(m) - 1, len(names) - 1).bit_length()
        masks, drops = build(rows, columns, impacts, height)
        return pa.table({"block": [key[0].as_py()], "side": [height], "ids": [group["doc_id"].to_pylist()], "terms": [list(names)],
                         "masks": [masks.tobytes()], "drops": [drops]}, schema=_INDEX)
    return run


_INDEX = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())),
                    ("masks", pa.binary()), ("drops", pa.list_(pa.int32()))])
_FOUND = pa.schema([(c, pa.int64()) for c in ("item", "item_id", "doc_id", "score")])


def _search(k: int):
    def run(blocks: pa.Table, items: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _FOUND.names}
        for b in range(blocks.num_rows):
            number = {t: i for i, t in enumerate(blocks["terms"][b].as_py())}
            ids = blocks["ids"][b].as_py()
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            drops = np.asarray(blocks["drops"][b].values)
            treap = Treap(blocks["side"][b].as_py(), np.frombuffer(blocks["masks"][b].as_py(), np.uint8), drops)
            for i in range(items.num_rows):
                asked = [(number[t], w) for t, w in zip(items["terms"][i].as_py(), items["weights"][i].as_py()) if t in number and w]
                if asked:
                    rows, weights = (np.array(x, np.int64) for x in zip(*asked))
                    for score, column in treap.search(rows, weights, order, k):
                        for name, value in zip(out, (items["item"][i].as_py(), items["item_id"][i].as_py(), ids[column], score)):
                            out[name].append(value)
        return pa.table(out, schema=_FOUND)
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    asked = kept(counted(items, "item_id"), "treap-items")
    held = kept(counted(docs, "doc_id", term_map(asked)).where("n > 0"), "treap-counts")
    documents, length, postings = held.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms"))).first()
    blocks = max(1, math.ceil(max(documents / DOCUMENTS, (postings or 0) / POSTINGS)))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))  # copies have numbers of their own
    index = kept(dealt.groupBy("block").applyInArrow(_index(documents, length or 1), INDEX), "treap-index")

    df = held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.select("uid", "doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("uid", "doc_id", F.col("x.terms").alias("t"), "x.counts")
    w = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("counts")
    weighted = terms.join(df, "t").groupBy("uid", "doc_id").agg(F.collect_list(F.struct("t", w.alias("w"))).alias("x"))
    groups = max(1, math.ceil(asked.count() / ITEMS))
    weighted = weighted.select(F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group"), F.col("uid").alias("item"), F.col("doc_id").alias("item_id"),
                               F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    pairs = index.withColumn("group", every(groups)).groupBy("block", "group").cogroup(
        weighted.withColumn("block", every(blocks)).groupBy("block", "group"))
    found = pairs.applyInArrow(_search(k), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents, abc),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark, abc),
s AS (SELECT uid, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
m AS (SELECT uid, doc_id, 75 + (25 * n * docs) // words AS m FROM s, total),
tf AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM s) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((CAST(2 AS DOUBLE) * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM b) GROUP BY ALL),
scores AS (SELECT item, item_id, uid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (uid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""


@query("op11_ranked_search", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
