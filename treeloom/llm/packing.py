"""Best-fit packing planned on a histogram of lengths.

Documents are cut into full pieces of ``capacity`` tokens and a remainder. Only
the counts of remainders by length reach the driver (at most ``capacity`` of
them, whatever the corpus); best-fit decreasing runs over counts, a whole count
of equal lengths at a time, and yields runs of slots: ranks ``first_rank`` and
on of a length go to bins ``first_bin`` and on. Documents are ranked within
their length and take the slots by a join on length and rank.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

CAPACITY = 2048
SALTS = 32
SLOTS = "length int, first_rank long, n long, first_bin long, per_bin long, first_offset int"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slot runs (length, first rank, documents, first bin, documents a bin, offset) and the number of bins.

    It is what best-fit decreasing does document by document: each takes the
    fullest bin that has room; a bin takes as many of a length as it can before
    the next fuller one is looked at, for it is then the fullest with room.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs of bins (first, n)
    rooms: list[int] = []
    slots, bins = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted((k for k, c in counts.items() if c and k > 0), reverse=True):
        left, rank = counts[length], 0
        at = bisect.bisect_left(rooms, length)
        pending = []
        while left and at < len(rooms):
            room = rooms[at]
            each = room // length
            runs = free[room]
            while left and runs:
                first, n = runs.pop()
                full = min(n, left // each)
                if full:
                    slots.append((length, rank, full * each, first, each, capacity - room))
                    pending.append((room - each * length, first, full))
                    rank, left = rank + full * each, left - full * each
                if full < n:
                    if left:  # the last few go to one more bin
                        slots.append((length, rank, left, first + full, left, capacity - room))
                        pending.append((room - left * length, first + full, 1))
                        rank, left, full = rank + left, 0, full + 1
                    if n > full:
                        runs.append((first + full, n - full))
            if not runs:
                del free[room]
                rooms.pop(at)
        for room, first, n in pending:
            add(room, first, n)
        if left:
            each = capacity // length
            full = left // each
            if full:
                slots.append((length, rank, full * each, bins, each, 0))
                add(capacity - each * length, bins, full)
                rank, left, bins = rank + full * each, left - full * each, bins + full
            if left:
                slots.append((length, rank, left, bins, left, 0))
                add(capacity - left * length, bins, 1)
                bins += 1
    return slots, bins


def token_count(text: str = "text"):
    """Tokens of a text: maximal runs of non-space characters, worked out inside the JVM."""
    return F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset: every token of every document in one bin.

    Pieces of a document are numbered from 0; all but the last fill a bin of
    ``capacity`` tokens. Bins are numbered from 0, those of full pieces last,
    and bin_offset is where the piece begins in its bin. Every row with a doc_id
    is packed, repeated rows each for itself; rows with a null or empty text
    have no token and no piece, and rows with a null doc_id, which the result
    could not name, are left out. Equal lengths take slots in order of a hash
    of doc_id. Texts of any length are packed entire. An empty table gives no
    row. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    lengths = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), token_count().cast("int").alias("total")).where("total > 0")
    lengths = lengths.select("doc_id", "total", F.pmod("total", F.lit(capacity)).cast("int").alias("length"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    lengths = materialize(lengths, "lengths")
    groups = lengths.groupBy("length", "salt").agg(F.count("*").alias("n"), F.sum(F.expr(f"total div {capacity}")).cast("long").alias("full"))
    table = groups.collect()  # at most capacity x SALTS rows
    counts: dict[int, int] = {}
    for r in table:
        counts[r.length] = counts.get(r.length, 0) + r.n
    slots, bins = plan(counts, capacity)
    starts, seen = [], {}
    full_at = bins
    for r in sorted(table, key=lambda r: (r.length, r.salt)):
        starts.append((r.length, r.salt, seen.get(r.length, 0), full_at))
        seen[r.length] = seen.get(r.length, 0) + r.n
        full_at += r.full
    # Ranks: within (length, salt) by a window, and counts of the salts before; a hot length is many tasks.
    base = spark.createDataFrame(starts, "length int, salt int, rank_base long, full_base long")
    w = Window.partitionBy("length", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "total")
    full = F.expr(f"total div {capacity}")
    ranked = lengths.withColumn("r", F.row_number().over(w) - 1).withColumn("full_r", F.coalesce(F.sum(full).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(F.broadcast(base), ["length", "salt"]).select("doc_id", "total", "length", (F.col("r") + F.col("rank_base")).alias("rank"), (F.col("full_r") + F.col("full_base")).alias("full_bin"))
    runs: dict[int, list] = {}
    for s in slots:
        runs.setdefault(s[0], []).append(s)
    # One row per length with its runs in order of rank: the join is on length, the run is found by rank.
    plan_rows = [(k, [(x[1], x[2], x[3], x[4], x[5]) for x in v]) for k, v in runs.items()]
    planned = spark.createDataFrame(plan_rows, "length int, runs array<struct<first_rank: long, n: long, first_bin: long, per_bin: long, first_offset: int>>")
    placed = ranked.join(F.broadcast(planned), "length", "left").withColumn("s", F.element_at(F.filter("runs", lambda x: (x.first_rank <= F.col("rank")) & (F.col("rank") < x.first_rank + x.n)), 1)).drop("runs")
    # One pass makes all pieces of a document: full ones, then the remainder if there is one.
    pieces = placed.withColumn("piece", F.explode(F.expr(f"sequence(0, int((total - 1) div {capacity}))")))
    whole, off = F.col("piece") < F.expr(f"total div {capacity}"), F.col("rank") - F.col("s.first_rank")
    return pieces.select(
        "doc_id", "piece", (F.col("piece") * capacity).cast("int").alias("first_token"), F.when(whole, F.lit(capacity)).otherwise(F.col("length")).alias("n_tokens"),
        F.when(whole, F.col("full_bin") + F.col("piece")).otherwise(F.col("s.first_bin") + F.floor(off / F.col("s.per_bin"))).cast("long").alias("bin_id"),
        F.when(whole, F.lit(0)).otherwise(F.col("s.first_offset") + F.pmod(off, F.col("s.per_bin")) * F.col("length")).cast("int").alias("bin_offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
