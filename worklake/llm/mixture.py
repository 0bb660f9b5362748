"""Mixing sources to target weights: fixed-length blocks, counts drawn per shard, index permutations, a join by block index.

Only DataFrame functions. Every document's words lie in one stream per source, cut into blocks of BLOCK words. A source's goal is
met by whole passes over its blocks and one part of a pass; in each pass the blocks follow a pseudorandom permutation (a keyed Feistel
network), so no block comes twice in a pass. Output shards have SHARD slots each; how many of them each source fills is a multinomial
draw under the condition that every source keeps its total. Each document says which spans of it go to which shard, in order.

Null text: size 0. Null source: a source of its own, the last. Null ids and repeated rows: each row is a document; rows of equal id
are ordered by a hash of their text. Documents without words take up no block and have taken 0. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.llm.common import COLUMNS, kept, query, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256  # words of a block
SHARD = 256  # blocks of an output shard
BUCKETS = 1024  # pieces of a source's stream that are numbered apart
WEIGHTS = (3, 1, 2)
SPANS = "array<struct<epoch:long,first:long,words:long,shard:long,block:long>>"
CLASSES, DEALT = 64, 64  # classes of sizes (four an octave) and pieces of each, in which whole copies are rounded
ROUNDS = 6  # of the permutations' network
CHUNK = 4096  # shards whose draws are added up together


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie (a hash of the text), bucket (of the source's stream), row (two hashes of the whole row)."""
    row = F.struct(F.xxhash64(*COLUMNS).alias("a"), F.xxhash64(F.lit(1), *COLUMNS).alias("b"))
    return (docs.select("doc_id", "source", row.alias("row"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                        F.xxhash64("text").alias("tie"))
            .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(BUCKETS)).cast("int")))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, sid, source_size, target. One row a source, so the ordering windows hold as many rows as there are sources.

    Targets are level * weight, at most `most` times the source. In the order of most * size / weight, the level that the sources
    from some place on would need if all before are full is highest at the true level.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = rows.withColumn("sid", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return rows.select("source", "sid", "source_size",
                       F.least(F.col("source_size") * F.lit(float(most)), F.col("level") * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """The place of index in a pseudorandom permutation of 0 to n - 1, another one for each key.

    A Feistel network over pairs of an a x b grid of at least n places: by turns one half is turned by a hash of the other, which can be
    undone. A place outside n goes through the network again until it's inside; less than a places are outside, so as many turns do.
    """
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")
    b = F.ceil(n / a).cast("long")

    def turned(pair: Column, i: Column) -> Column:
        def by(other: Column, base: Column) -> Column:
            return F.pmod(F.xxhash64(*key, i, other), base)
        return F.when(i % 2 == 0, F.struct(((pair["l"] + by(pair["r"], a)) % a).alias("l"), pair["r"].alias("r"))).otherwise(
            F.struct(pair["l"].alias("l"), ((pair["r"] + by(pair["l"], b)) % b).alias("r")))

    def network(x: Column) -> Column:
        x = x.cast("long")
        pair = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), pair, turned, lambda pair: pair["l"] * b + pair["r"])

    once = network(index)
    again = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), a * b - n)), once, lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(once < n, once).otherwise(again)


def numbered(goals: DataFrame) -> DataFrame:
    """sid, full, blocks, epochs, rest, slots, before, total: what a source gives to the mix, and the slots of the sources before it."""
    size, goal = F.col("source_size"), F.floor(F.col("target") + 0.5)
    g = goals.where("source_size > 0").select("sid", size, F.floor(size / BLOCK).alias("full"), F.ceil(size / BLOCK).alias("blocks"),
                                              F.floor(goal / size).alias("epochs"), (goal % size).alias("rest"))
    g = g.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK)).where("slots > 0")
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)  # a row a source
    return g.withColumn("before", F.sum("slots").over(upto) - F.col("slots")).withColumn("total", F.sum("slots").over(Window.partitionBy(F.lit(0))))


def draws(sources: DataFrame, seed: int = 0) -> DataFrame:
    """sid, shard, count, first: how many slots of each source a shard draws, and how many the shards before it draw of that source.

    All shards have SHARD places, the last one what is left. The places draw from an urn that holds every source's slots: multinomial
    counts under the condition that each source's total is what it should be.
    """
    step, tasks = 8192, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiny rows that become many: not to be coalesced
    g = sources.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / step)))).repartition(tasks, "sid", "part")
    g = g.withColumn("j", F.explode(F.sequence(F.col("part") * step, F.least(F.col("part") * step + step, F.col("slots")) - 1)))
    place = permuted(F.col("before") + F.col("j"), F.col("total"), F.lit(seed + 2))
    counts = g.select("sid", F.floor(place / SHARD).alias("shard")).groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("chunk", F.floor(F.col("shard") / CHUNK))
    upto = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.groupBy("sid", "chunk").agg(F.sum("count").alias("held"))
    firsts = firsts.withColumn("start", F.sum("held").over(upto) - F.col("held")).drop("held")
    within = Window.partitionBy("sid", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.repartition(tasks, "sid", "chunk").withColumn("upto", F.sum("count").over(within))
    return counts.join(firsts.hint("merge"), ["sid", "chunk"]).select("sid", "shard", "count", (F.col("start") + F.col("upto") - F.col("count")).alias("first"))


def slots(goals: DataFrame, seed: int = 0) -> DataFrame:
    """sid, shard, epoch, block, words: every slot of the mix. A shard's slots of a source follow those of the shards before it, and each
    goes through the permutation of the source and the pass to its block."""
    sources = numbered(goals)
    g = draws(sources, seed).join(sources, "sid")
    g = g.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    g = g.withColumn("epoch", F.floor(F.col("j") / F.col("blocks"))).withColumn("rank", F.col("j") % F.col("blocks"))
    at = permuted(F.col("rank"), F.greatest(F.col("full"), F.lit(1)), F.lit(seed), F.col("sid"), F.col("epoch"))
    block = F.when(F.col("rank") < F.col("full"), at).otherwise(F.col("full"))
    held = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    left = F.when(F.col("epoch") == F.col("epochs"), F.col("rest") - F.col("rank") * BLOCK).otherwise(F.lit(BLOCK))
    return g.withColumn("block", block).withColumn("words", F.least(held, left)).select("sid", "shard", "epoch", "block", "words")


def streams(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """doc_id, sid, size, tie, row, source_size, target, start: the place of each document's first word in its source's stream."""
    key = ["source", "bucket"]
    firsts = sizes.groupBy(*key).agg(F.sum("size").alias("held"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    firsts = firsts.withColumn("first", F.sum("held").over(upto) - F.col("held")).drop("held")
    within = Window.partitionBy(*key).orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("in_bucket", F.sum("size").over(within) - F.col("size"))
    firsts = firsts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    placed = placed.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    goals = goals.withColumnRenamed("source", "g")
    return (placed.join(goals, F.col("source").eqNullSafe(F.col("g")))
            .select("doc_id", "sid", "size", "tie", "row", "source_size", "target", (F.col("first") + F.col("in_bucket")).alias("start")))


def spans(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, sid, tie, row, size, source_size, target, taken, spans of every document, as taken() has them."""
    sizes = kept(sized(docs), "mixture-sizes")
    goals = kept(targets(sizes, share, most), "mixture-goals")
    placed = streams(sizes, goals)
    end = F.col("start") + F.col("size")
    parts = (placed.where("size > 0")
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
             .withColumn("lo", F.greatest(F.lit(0), F.col("start") - F.col("block") * BLOCK))
             .withColumn("hi", F.least(F.lit(BLOCK), end - F.col("block") * BLOCK)))
    uses = F.collect_list(F.struct("epoch", "shard", "words")).alias("uses")  # a use a pass, most + 1 at most
    by_block = slots(goals, seed).groupBy("sid", "block").agg(uses)
    first = F.col("block") * BLOCK + F.col("lo") - F.col("start")
    used = F.transform("uses", lambda u: F.struct(u["epoch"].alias("epoch"), first.alias("first"), (F.least(F.col("hi"), u["words"]) - F.col("lo")).alias("words"),
                                                  u["shard"].alias("shard"), F.col("block").alias("block")))
    used = (parts.join(by_block.hint("merge"), ["sid", "block"]).select("sid", "start", F.filter(used, lambda u: u["words"] > 0).alias("spans"))
            .groupBy("sid", "start").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    # A document without words starts where the next one does: it has no part in the join.
    full = placed.where("size > 0").join(used.hint("merge"), ["sid", "start"], "left")
    none = F.array().cast(SPANS)
    out = ["doc_id", "sid", "tie", "row", "size", "source_size", "target"]
    found = full.select(*out, F.coalesce(F.col("spans").cast(SPANS), none).alias("spans")).unionByName(placed.where("size = 0").select(*out, none.alias("spans")))
    return found.withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda a, u: a + u["words"]))


def taken(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, spans of every document: the words that the mix takes of it, repeats counted, and each
    stretch of them (pass, first word within the document, words, the shard it goes to, block of the source)."""
    return spans(docs, share, most, seed).select("doc_id", "size", "source_size", "target", "taken", "spans")


@query("op10_mix_sources")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


def copies(taken_of: DataFrame) -> DataFrame:
    """row, times: whole copies of each different row with some. A document comes taken / size times, rounded down or up.

    What is left behind whole copies is summed along each source's documents by size, and a document gets one copy more where the sum
    passes a half. So copies of a source are off by less than one, and words by about its largest document.
    """
    key = ["sid", "class", "piece"]
    share = F.col("taken") / F.col("size")
    rows = taken_of.where("size > 0").select("sid", "size", "doc_id", "tie", "row", F.floor(share).alias("whole"), (share - F.floor(share)).cast("decimal(24,18)").alias("rest"),
                                             F.least(F.lit(CLASSES - 1), F.floor(4 * F.log2("size"))).alias("class"), F.pmod(F.col("row.a"), F.lit(DEALT)).alias("piece"))
    upto = Window.partitionBy("sid").orderBy("class", "piece").rowsBetween(Window.unboundedPreceding, 0)  # CLASSES * DEALT rows at most
    firsts = rows.groupBy(*key).agg(F.sum("rest").alias("held"))
    firsts = firsts.withColumn("before", F.sum("held").over(upto) - F.col("held")).drop("held")
    within = Window.partitionBy(*key).orderBy("size", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("rest").over(within)).join(firsts, key)
    passed = [F.floor(F.col("before") + F.col("sum") - x + F.lit("0.5").cast("decimal(2,1)")) for x in (F.lit(0), F.col("rest"))]
    times = (F.col("whole") + passed[0] - passed[1]).cast("long")
    return rows.groupBy("row").agg(F.sum(times).cast("int").alias("times")).where("times > 0")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents: each comes as often as the mix takes it, rounded so that each source has the words it should have.

    The columns of documents hold no shard: which shard a stretch of a document goes to is a column of taken().
    """
    taken_of = kept(spans(docs).select("doc_id", "sid", "tie", "row", "size", "taken"), "mixture-taken")
    counts = copies(taken_of).select(F.col("row.a").alias("a"), F.col("row.b").alias("b"), "times")
    # Equal rows share their copies: each different row is taken once.
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("a"), F.xxhash64(F.lit(1), *COLUMNS).alias("b")).dropDuplicates(["a", "b"])
    return (rows.join(counts, ["a", "b"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS))
