"""Edit-aware token counts: a segment tree over a document's pre-tokens; an edit re-encodes its region and the context at its borders.

Leaves hold the lengths and token counts of about LEAF pre-tokens, inner nodes sums. An edit finds its leaves by the sums of lengths,
cuts the region anew with pre-tokens on both sides, wider until the first and the last two pre-tokens are the old ones, puts the new
counts in these leaves and updates the sums above them. The total of the tree is the count of the edited text.

Edits are (start, stop, text) in code points, applied one after the other; places outside of the text are moved to its borders, a null
text is empty, null edits change nothing. Null or empty document: a tree without pre-tokens, which edits may fill. Null ids and
repeated rows: each row by itself. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.bpe import Codec, codec, vocabulary
from worklake.llm.common import map_texts, query, table

LEAF = 32  # pre-tokens of a leaf
CONTEXT = 8  # pre-tokens on each side of an edit, at least
EDITS = "array<struct<start:long,stop:long,text:string>>"


class Tree:
    def __init__(self, c: Codec, text: str):
        self.codec, self.text, self.recounted = c, text, 0
        self._build(self._counted(text))

    def _counted(self, text: str) -> list[tuple[int, int]]:
        """(length, tokens) of each pre-token."""
        pres = self.codec.cut(text)
        return [(len(p), g[1]) for p, g in zip(pres, self.codec.known(pres))]

    def _build(self, pres: list[tuple[int, int]]) -> None:
        self.leaves = [pres[i:i + LEAF] for i in range(0, len(pres), LEAF)] or [[]]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [[] for _ in range(self.base - len(self.leaves))]
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i in range(self.base):
            self._sum(i)
        for i in range(self.base - 1, 0, -1):
            self._above(i)

    def _sum(self, leaf: int) -> None:
        self.chars[self.base + leaf] = sum(p[0] for p in self.leaves[leaf])
        self.tokens[self.base + leaf] = sum(p[1] for p in self.leaves[leaf])

    def _above(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return sum(map(len, self.leaves))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first place."""
        node, first = 1, 0
        while node < self.base:
            node *= 2
            if place >= first + self.chars[node] and self.chars[node + 1]:
                first += self.chars[node]
                node += 1
        return node - self.base, first

    def edit(self, start: int, stop: int, text: str) -> None:
        n = len(self.text)
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        new = self.text[:start] + text + self.text[stop:]
        (lo, first), (hi, last) = self._leaf_at(start), self._leaf_at(stop)
        last += self.chars[self.base + hi]
        context = CONTEXT
        while True:
            while lo > 0 and self._held(lo, first, start, True) < context:
                lo -= 1
                first -= self.chars[self.base + lo]
            while hi < self.base - 1 and self._held(hi, last, stop, False) < context:
                hi += 1
                last += self.chars[self.base + hi]
            old = [p for leaf in self.leaves[lo:hi + 1] for p in leaf]
            counted = self._counted(new[first:last + len(new) - n])
            self.recounted += len(counted)
            left = first == 0 or bool(counted) and counted[0][0] == old[0][0]
            right = last == n or [p[0] for p in counted[-2:]] == [p[0] for p in old[-2:]]
            if left and right:
                break
            context *= 2
        self.text = new
        each = -(-len(counted) // (hi - lo + 1))
        if each > 8 * LEAF:
            self._build([p for leaf in self.leaves[:lo] for p in leaf] + counted + [p for leaf in self.leaves[hi + 1:] for p in leaf])
            return
        for i in range(lo, hi + 1):
            self.leaves[i] = counted[(i - lo) * each:(i - lo + 1) * each]
            self._sum(i)
        a, b = (self.base + lo) // 2, (self.base + hi) // 2
        while a:
            for node in range(a, b + 1):
                self._above(node)
            a, b = a // 2, b // 2

    def _held(self, leaf: int, border: int, place: int, before: bool) -> int:
        """Pre-tokens wholly between the border of the window and the edit, counted up to what is asked at most twice over."""
        count = 0
        step = 1 if before else -1
        while 0 <= leaf < self.base:
            for length, _ in (self.leaves[leaf] if before else reversed(self.leaves[leaf])):
                border += step * length
                if border > place if before else border < place:
                    return count
                count += 1
            leaf += step
        return count


def count_edits(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, edited_chars, edited_tokens, recounted of rows doc_id, text, edits."""
    def make():
        c = codec(path)

        def fn(cols):
            out = {k: [] for k in ("n_tokens", "n_pretokens", "edited_chars", "edited_tokens", "recounted")}
            for text, edits in zip(cols["text"], cols["edits"]):
                tree = Tree(c, text)
                out["n_tokens"].append(tree.total)
                out["n_pretokens"].append(tree.size)
                for e in edits or ():
                    if e is not None and e["start"] is not None and e["stop"] is not None:
                        tree.edit(e["start"], e["stop"], e["text"] or "")
                out["edited_chars"].append(len(tree.text))
                out["edited_tokens"].append(tree.total)
                out["recounted"].append(tree.recounted)
            return {"doc_id": cols["doc_id"]} | out
        return fn
    return map_texts(docs.select("doc_id", "text", "edits"), make, "doc_id long, n_tokens long, n_pretokens long, edited_chars long, edited_tokens long, recounted long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text, edits from a table of edits (doc_id, seq, start, stop, text); a document's edits by seq."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "text")))
    lists = edits.groupBy(F.col("doc_id").alias("edited_id")).agg(F.transform(rows, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("edited_id"), "left").select("doc_id", "text", "edits")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: of every document a twentieth is cut out at a third, its first 40 characters are put in at the half, and its
    last tenth becomes capitals."""
    n = F.char_length("text").cast("long")

    def edit(start, stop, text):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))
    cut = edit(F.floor(n / 3), F.floor(n / 3) + F.floor(n / 20), F.lit(""))
    put = edit(F.floor(n / 2), F.floor(n / 2), F.substring("text", 1, 40))
    tail = F.floor(n / 10).cast("int")
    length = n - F.floor(n / 20) + F.least(n, F.lit(40))
    capitals = edit(length - tail, length, F.when(tail > 0, F.upper(F.right("text", tail))).otherwise(""))
    return docs.select("doc_id", "text").select("doc_id", "text", F.when(F.col("text").isNotNull(), F.array(cut, put, capitals)).alias("edits"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(sample_edits(table(spark, sf_dir, "documents")), vocabulary())
