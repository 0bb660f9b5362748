"""Running count / sum / max over ordered groups of any size, by a two-level prefix scan.

Rows are stored and cut along group and order into pieces of about `spark.worklake.pieceRows` rows, whatever groups they belong to:
as many pieces as the rows need, with bounds that a sample gives. Each piece is scanned by its own task, and what a group has in the
pieces before is added. A large group is spread over many pieces, many small groups share one; the rows decide how many pieces there
are, not how they are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.session import materialize, piece_rows, stored_rows

COUNT, SUM, MAX = "count", "sum", "max"
CHUNK = "_chunk"
SAMPLED = 100  # rows of the sample for each piece


def chunk(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """df cut into consecutive pieces along keys and order, stored, with the piece's number in _chunk.

    Several scans in the same order (also over finer keys) can share one cutting: running() uses a _chunk column it finds.
    With a rising order the number is an expression over bounds, so that only the scan itself moves the rows. Otherwise Spark cuts, and
    the number comes from spark_partition_id, which is stable only once written.
    """
    stored, rows = stored_rows(df, "rows")
    pieces = max(1, -(-rows // piece_rows(df.sparkSession)))
    if pieces == 1:  # one piece holds everything
        return stored.withColumn(CHUNK, F.lit(0))
    if not any(word in str(c) for c in order for word in ("DESC", "NULLS")):
        return stored.withColumn(CHUNK, _piece(stored, [*[F.col(k) for k in keys], *order], pieces, rows))
    return materialize(stored.repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
                             .withColumn(CHUNK, F.spark_partition_id()), "pieces")


def _piece(stored: DataFrame, columns: list[Column], pieces: int, rows: int) -> Column:
    """Number of a row's piece, by comparing with bounds; they come from a sample of about SAMPLED rows a piece."""
    names = [f"_b{i}" for i in range(len(columns))]
    values = stored.select(*[c.alias(n) for c, n in zip(columns, names)])
    types = [f.dataType for f in values.schema.fields]
    sample = values.sample(min(1.0, SAMPLED * pieces / rows), seed=1).orderBy(*names).collect()
    bounds = [sample[len(sample) * i // pieces] for i in range(1, pieces)] if sample else []
    row = F.struct(*[c.alias(n) for c, n in zip(columns, names)])
    literals = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(b, types, names)]) for b in bounds]

    def among(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        mid = (first + last) // 2
        return F.when(row < literals[mid], among(first, mid)).otherwise(among(mid + 1, last))
    return among(0, len(bounds))


def _local(kind: str, value: Column | None, window) -> Column:
    if kind == COUNT:
        return F.row_number().over(window).cast("bigint")
    frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(frame) if kind == SUM else F.max(value).over(frame)


def running(df: DataFrame, keys: list[str], order: list[Column], aggs: dict[str, tuple]) -> DataFrame:
    """Add one running aggregate per entry of aggs: name -> (COUNT,) | (SUM, column) | (MAX, column).

    `order` has to be a total order within the group.
    """
    specs = {n: (s[0], s[1] if len(s) > 1 else None) for n, s in aggs.items()}
    chunked = df if CHUNK in df.columns else chunk(df, keys, order)
    totals = chunked.groupBy(*keys, CHUNK).agg(*[
        (F.count(F.lit(1)) if k == COUNT else F.sum(v) if k == SUM else F.max(v)).alias(f"_t_{n}")
        for n, (k, v) in specs.items()])
    # one row per piece and group in it, at most pieces + groups rows
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(CHUNK).alias("_k_chunk"),
        *[(F.max if k == MAX else F.sum)(f"_t_{n}").over(before).alias(f"_o_{n}") for n, (k, _) in specs.items()])
    # only a group that began in an earlier piece has something to add: as many rows as pieces, or fewer, so the rows needn't move for it
    carried = F.broadcast(offsets.where(F.coalesce(*[F.col(f"_o_{n}").cast("string") for n in specs]).isNotNull()))
    same = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    scanned = chunked.select("*", *[_local(k, v, w).alias(f"_l_{n}") for n, (k, v) in specs.items()])
    out = []
    for n, (k, _) in specs.items():
        off, loc = F.col(f"_o_{n}"), F.col(f"_l_{n}")
        if k == MAX:
            out.append(F.greatest(off, loc).alias(n))
        elif k == COUNT:
            out.append((F.coalesce(off, F.lit(0)) + loc).alias(n))
        else:
            out.append(F.coalesce(off + loc, off, loc).alias(n))
    return scanned.join(carried, same, "left").select(*df.columns, *out)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position within the group."""
    return running(df, keys, order, {name: (COUNT,)})
