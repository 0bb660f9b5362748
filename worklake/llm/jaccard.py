"""N-gram Jaccard join by T-occurrence search with DivideSkip, exact, over sets of distinct word shingles.

Equal sets are one node. Of each node the least shingles by hash are looked at first: a prefix so long that two linked nodes have several
shingles in common in their prefixes (a few for a small node, more for a large one). A node whose prefix holds fewer shingles that occur
elsewhere has no link. The nodes that remain are cut into parts: two sets that are alike enough differ in at most `differ` shingles; cut
into more parts than that (by the shingles' hashes), they agree in a whole part. Nodes that share a part are candidates; a part's nodes
are tied to its least node only. Parts go by classes of sizes, and so do ties: a node is tied in its own class and in the next, so that
nodes of other sizes don't join a cluster. The clusters of tied nodes are searched: each node asks the inverted lists of the cluster's shingles
for nodes that reach the overlap T its size demands. The longest lists are put aside, the short ones are merged by a heap, and only what
comes often enough in these is looked up in the long ones by binary search. A cluster of more than GROUP nodes is searched in pairs of
blocks. Links give components.

Shingles and sets are told apart by 64-bit hashes. Null or empty text, or text without words: no shingles, no links, its own component.
Null ids: such rows are linked as others are, but a component's id is the least id there is (null if it has none). Repeated rows have
equal sets and share a component. No rows: no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import COLUMNS, give_back, kept, map_texts, query, table
from worklake.llm.components import components

GROUP = 3000  # nodes of a block; a task searches one block, or two
SHINGLES = 1_000_000  # of a block
CACHED = 300_000
MANY = 64  # entries of a list that is held as an array
HEAP = 2000  # entries that a heap merges; more are merged as sorted runs
FEW_IDS = 1_000_000  # ids (16 bytes each) that are broadcast; more are joined by a shuffle
SPARE = 10  # one in so many of a node's shingles is how many linked nodes have in common in their prefixes
SKIP = 0.001  # weight of the longest list's length in the number of lists put aside

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[0]
    return h ^ (h >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, n: int = 3):
        self.n, self.seen = n, {}

    def _word(self, w: bytes) -> int:
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) >= CACHED:
                self.seen.clear()
            got = self.seen[w] = xxhash.xxh3_64_intdigest(w)
        return got

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z fold, and ASCII white space splits
        if not words:
            return np.zeros(0, np.uint64)
        h = np.array([self._word(w) for w in words], np.uint64)
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = mix(total + h[i:len(h) - n + 1 + i]) * _M[1]
        return np.unique(total)


def node_of(s: np.ndarray) -> int:
    """The set's number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


class Parts:
    """Signatures of a set's parts. Sizes are in classes, so wide that sets of one link lie in one class or in neighbouring ones."""

    def __init__(self, least: int):
        self.least, self.bounds = least, [1]
        self.spares: dict[int, int] = {}

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * 100 // self.least + 1)
        return int(np.searchsorted(self.bounds, n, side="right")) - 1

    def of(self, s: np.ndarray) -> np.ndarray:
        """Signatures for the set's own class and, where a larger partner would lie, the next."""
        own = self.size_class(len(s))
        return np.concatenate([self.signed(s, q) for q in (own, own + 1)]) if len(s) else np.zeros(0, np.int64)

    def spare(self, q: int, differ: int) -> int:
        """So many empty parts need not be told: what a set of the class before, the smallest signed here, has by chance. An empty part
        that is told ties unrelated sets; too many spare parts are shorter ones. Either way no link is lost."""
        lowest, most = self.bounds[max(0, q - 1)], 4 + differ // 8 if differ else 0
        spare = 0
        while spare < most:
            n = differ + 1 + spare
            empty = n * math.exp(-lowest / n)
            if empty + 4 * math.sqrt(empty) <= spare:
                break
            spare += 1
        return spare

    def signed(self, s: np.ndarray, q: int) -> np.ndarray:
        while len(self.bounds) < q + 2:
            self.bounds.append(self.bounds[-1] * 100 // self.least + 1)
        largest = self.bounds[q + 1] - 1
        differ = 2 * largest * (100 - self.least) // (100 + self.least)
        if q not in self.spares:
            self.spares[q] = self.spare(q, differ)
        spare = self.spares[q]
        n = differ + 1 + spare
        place = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # rises with the hash: a part lies together
        first = np.searchsorted(place, np.arange(n, dtype=np.uint64))
        full = np.flatnonzero(np.diff(np.append(first, len(s))))
        sums = np.add.reduceat(mix(s), first[full])
        number = full.astype(np.uint64)
        if n - len(full) > spare:
            empty = np.setdiff1d(np.arange(n), full).astype(np.uint64)
            sums, number = np.append(sums, np.zeros(len(empty), np.uint64)), np.append(number, empty)
        return mix(mix(sums + number * _M[2]) + np.uint64(q * int(_M[1]) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def search(asked: list[np.ndarray], held: list[np.ndarray], least: int, same: bool) -> list[tuple[int, int]]:
    """Links (i, j) of asked[i] and held[j]; with same, the two are one list and j < i. Enough of them to connect what is linked.

    T-occurrence with DivideSkip: of a set's lists the longest are put aside, the others are merged by a heap.
    """
    if same:
        shared, times = np.unique(np.concatenate(held), return_counts=True)
        shared = shared[times > 1]
    else:
        shared = np.intersect1d(np.concatenate(asked), np.concatenate(held))
    lists: list[list[int]] = [[] for _ in shared]
    for j, s in enumerate(held):
        for h in _among(s, shared):
            lists[h].append(j)
    lists = [np.array(x) if len(x) > MANY else x for x in lists]
    parent = list(range(len(asked) + (0 if same else len(held))))
    shift = 0 if same else len(asked)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    out = []
    for i, s in enumerate(asked):
        need = -(-least * len(s) // 100)  # an overlap below it is too small for any partner
        own = sorted((lists[h] for h in _among(s, shared)), key=len)
        if len(own) < need:
            continue
        aside = min(need - 1, int(need / (SKIP * math.log2(len(own[-1]) + 1) + 1)))
        short, long = own[:len(own) - aside], own[len(own) - aside:]
        counts = {j: n for j, n in _merged(short, i if same else None) if n >= need - aside}
        sizes = [j for j in counts if least * max(len(s), len(held[j])) <= 100 * min(len(s), len(held[j])) and root(i) != root(j + shift)]
        if not sizes:
            continue
        # A component's most promising candidates first: once one of them links, the others of its component need no look.
        sizes.sort(key=lambda j: -counts[j])
        asked_of: dict[int, int] = {}
        turns: list[list[int]] = []
        for j in sizes:
            turn = asked_of[root(j + shift)] = asked_of.get(root(j + shift), -1) + 1
            turn = min(turn, turn.bit_length() + 3)
            turns += [[] for _ in range(turn + 1 - len(turns))]
            turns[turn].append(j)
        for turn in turns:
            todo = [j for j in turn if root(j + shift) != root(i)]
            for j in _probed(todo, [counts[j] for j in todo], long, len(s), held, least) if todo else ():
                a, b = root(i), root(j + shift)
                if a != b:
                    parent[a] = b
                    out.append((i, j))
    return out


def _among(s: np.ndarray, shared: np.ndarray) -> list[int]:
    """Places in shared of what s has of it."""
    at = np.searchsorted(shared, s)
    return at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)].tolist() if len(shared) else []


def _merged(lists: list, before: int | None) -> Iterator[tuple[int, int]]:
    """(entry, number of lists that hold it) in order, of the entries below `before`."""
    if sum(map(len, lists)) <= HEAP:
        for j, times in groupby(heapq.merge(*(x.tolist() if len(x) > MANY else x for x in lists))):
            if before is not None and j >= before:
                return
            yield j, sum(1 for _ in times)
    else:
        entries, times = np.unique(np.concatenate([np.asarray(x)[:None if before is None else np.searchsorted(x, before)] for x in lists]), return_counts=True)
        yield from zip(entries.tolist(), times.tolist())


def _probed(js: list[int], counts: list[int], long: list, size: int, held: list[np.ndarray], least: int) -> list[int]:
    """Those of js that link: binary search in the lists put aside, until too few are left to reach the overlap of the two sizes."""
    at, total = np.array(js), np.array(counts)
    need = np.array([-(-least * (size + len(held[j])) // (100 + least)) for j in js])
    for left in range(len(long) - 1, -1, -1):
        places = long[len(long) - 1 - left]
        if len(at) > 16:
            found = np.searchsorted(places, at)
            found[found == len(places)] = 0
            total = total + (np.asarray(places)[found] == at)
        else:
            total = total + np.array([_holds(places, j) for j in at.tolist()])
        alive = total + left >= need
        if not alive.all():
            at, total, need = at[alive], total[alive], need[alive]
            if not len(at):
                break
    return at[total >= need].tolist()


def _holds(places: list[int], j: int) -> bool:
    at = bisect_left(places, j)
    return at < len(places) and places[at] == j


def common(n: int) -> int:
    """Shingles that a node of n has in common with any other of its size in their prefixes, if they link."""
    return max(1, n // SPARE)


def prefix(s: np.ndarray, least: int) -> np.ndarray:
    """The least shingles by hash. At most len(s) - overlap of a set's shingles are missing in its partner, so that the first common(n)
    of what both have lie within this prefix of either."""
    return s[:len(s) - -(-least * len(s) // 100) + common(len(s))]


def prints(docs: DataFrame, n: int, least: int) -> DataFrame:
    """doc_id, n_shingles, node, prefix (hashes); the only pass over all texts."""
    def make():
        shingles = Shingles(n)

        def fn(cols):
            sets = [shingles.of(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets],
                    "prefix": [prefix(s, least).view(np.int64) for s in sets]}
        return fn
    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, node long, prefix array<long>")


def claims(marks: DataFrame, least: int) -> DataFrame:
    """Rows of a batch of nodes: for each shingle of the prefixes one row (shingle, one of its nodes, known: it has several nodes in the
    batch), and for each node one row (known null, credit: its shingles with several nodes in the batch, less what it needs).

    However frequent a shingle is, a batch sends one row of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, rows = np.unique(np.asarray(batch["node"]), return_index=True)  # copies in a batch count once
            batch = batch.take(pa.array(rows))
            shingles = np.asarray(batch["prefix"].flatten())
            own = np.repeat(np.arange(len(nodes)), np.asarray(batch["prefix"].value_lengths()))
            order = np.argsort(shingles, kind="stable")
            found, first, times = np.unique(shingles[order], return_index=True, return_counts=True)
            here = np.bincount(own[order][np.repeat(times > 1, times)], minlength=len(nodes))
            # A partner may be as small as least percent of the node, and has its own, shorter prefix.
            need = np.array([common(-(-least * n // 100)) for n in batch["n_shingles"].to_pylist()])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([found, nodes])), pa.array(np.concatenate([nodes[own[order][first]], nodes])),
                pa.array((times > 1).tolist() + [None] * len(nodes), pa.bool_()),
                pa.array([None] * len(found) + (here - need).tolist(), pa.int64())], names=["shingle", "node", "known", "credit"])
        give_back()
    return marks.where("node IS NOT NULL").select("node", "n_shingles", "prefix").mapInArrow(run, "shingle long, node long, known boolean, credit long")


def promising(marks: DataFrame, least: int) -> DataFrame:
    """node of those that have enough shingles in their prefix which other nodes have too. A node in several batches is credited with
    each shingle once in each of them, and its need is subtracted as often."""
    rows = claims(marks, least).withColumn("of_node", F.col("known").isNull())
    w = Window.partitionBy("shingle", "of_node")
    shared = F.max("known").over(w) | (F.min("node").over(w) != F.max("node").over(w))
    rows = rows.select("node", "credit", "known", "of_node", shared.alias("shared"))
    credit = F.coalesce("credit", (F.col("shared") & ~F.col("known")).cast("long"))
    # A node's own row stays at credit 0 too: it may be all that says the node has just what it needs.
    return rows.select("node", "of_node", credit.alias("credit")).where("of_node OR credit <> 0").groupBy("node").agg(F.sum("credit").alias("credit")).where("credit >= 0").select("node")


def signed(sets: DataFrame, least: int) -> DataFrame:
    """node (numbered anew for each class of sizes that it is tied in), part (signatures) of nodes with their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(least)
        for batch in batches:
            for node, own, s in zip(batch["node"].to_pylist(), batch["class"].to_pylist(), batch["shingles"].to_pylist()):
                for q in (own, own + 1):
                    marks = parts.signed(np.frombuffer(s, np.uint64), q)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), node)), pa.array(np.full(len(marks), q, np.int32)), pa.array(marks)], names=["node", "q", "part"])
        give_back()
    return sets.select("node", "class", "shingles").mapInArrow(run, "node long, q int, part long").select(F.xxhash64("node", "q").alias("node"), "part")


def candidates(parts: DataFrame) -> DataFrame:
    """u, v: each node that shares a part with another set, tied to the least node of the part."""
    shared = parts.groupBy("part").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").drop("last")
    return parts.join(shared, "part").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def members(docs: DataFrame, marks: DataFrame, nodes: DataFrame, n: int, least: int) -> DataFrame:
    """node, size, class (of sizes), shingles (bytes) of the nodes, each once: their texts are read again, others aren't."""
    wanted = marks.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("at"))
    wanted = kept(wanted, "jaccard-wanted")
    ids = wanted.select(F.col("at").alias("wanted_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= FEW_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def make():
        shingles, parts = Shingles(n), Parts(least)

        def fn(cols):
            sets = [shingles.of(t) for t in cols["text"]]
            return {"node": [node_of(s) if len(s) else None for s in sets], "size": [len(s) for s in sets],
                    "class": [parts.size_class(len(s)) for s in sets], "shingles": [s.tobytes() for s in sets]}
        return fn
    found = map_texts(texts, make, "node long, size long, class int, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def links(sets: DataFrame, clusters: DataFrame, least: int) -> DataFrame:
    """u, v: links within the clusters, enough to connect what is linked. A large cluster's blocks meet pair by pair."""
    need = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("size") / SHINGLES))
    placed = sets.select("node", "size", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("q"))
    placed = placed.select(F.col("node").alias("of"), "size", F.xxhash64("node", "q").alias("node")).join(clusters, "node").drop("node").withColumnRenamed("of", "node")
    blocks = placed.groupBy("root").agg(need.cast("int").alias("blocks"))
    placed = placed.select("node", "root").join(blocks, "root")
    rows = sets.select("node", "shingles").join(placed, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "shingles")

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group["node"]), kind="stable")
        nodes, block = np.asarray(group["node"])[order], np.asarray(group["block"])[order]
        raw = group["shingles"].to_pylist()
        all_sets = [np.frombuffer(raw[i], np.uint64) for i in order]
        a, b = group["a"][0].as_py(), group["b"][0].as_py()
        left = [i for i in range(len(nodes)) if block[i] == a]
        right = left if a == b else [i for i in range(len(nodes)) if block[i] == b]
        found = search([all_sets[i] for i in left], [all_sets[j] for j in right], least, a == b)
        if len(nodes) > GROUP // 10:
            give_back()  # the lists of a large block
        return pa.table({"u": pa.array([int(nodes[left[i]]) for i, _ in found], pa.int64()), "v": pa.array([int(nodes[right[j]]) for _, j in found], pa.int64())})
    return rows.groupBy("root", "a", "b").applyInArrow(run, "u long, v long")


def join(docs: DataFrame, n: int = 3, least: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link at a Jaccard likeness of least percent."""
    marks = kept(prints(docs, n, least), "jaccard-prints")
    sets = kept(members(docs, marks, promising(marks, least), n, least), "jaccard-sets")
    clusters = components(candidates(signed(sets, least)))
    linked = components(links(sets, clusters, least))
    nodes = marks.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = nodes.join(linked, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = rooted.join(least_id, "root").select(F.col("node").alias("of"), "component_id")
    joined = marks.select("doc_id", "n_shingles", "node").join(of_node, F.col("node") == F.col("of"), "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go: of each component over five-word shingles with a likeness of 0.8 the document with the least id stays, once if its
    row is repeated. Rows without an id stay."""
    groups = join(docs, 5, 80).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(groups, "doc_id").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)
    return named.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))
