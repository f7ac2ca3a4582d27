"""Operator 7: sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells, whatever the input.  A key's cell is a hash of its
id, text hash and size, so null ids or one id of many rows spread over the ring; each shard owns `replicas` virtual nodes; a key belongs to the next virtual node
clockwise.  Shards are bounded: the first (rows mod shards) hold one row more than the
others and together they hold every row, so counts differ by one at most.  Keys that
meet a full shard continue clockwise to the next virtual node with room.

Only the number of keys in each cell (at most `CELLS` numbers) reaches the driver, which
walks the ring once and returns a table of ranges: ranks [from, to) of a cell go to a
shard, from a slot on.  Ranks come from a window over one cell's rows, a 65,536th of all
rows that differ in id or text; rows equal in both share a cell.

Groups of equal texts are not held together: the law is `rows`, and full shards pass any
row on.

Edge cases: null ids are placed by their text; rows with equal ids are ordered by text
hash and size; null text has no bytes; fewer rows than shards leave shards empty; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Places on the ring: the bound of what the driver sees.
CELLS, REPLICAS = 1 << 16, 64


def cell_of(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 48).cast("int")


def ring(shards: int, replicas: int = REPLICAS, cells: int = CELLS) -> list[tuple[int, int]]:
    """Virtual nodes as (cell, shard), clockwise; a shard's nodes don't depend on the number of shards."""
    out = []
    for s in range(shards):
        for r in range(replicas):
            out.append((int.from_bytes(hashlib.sha256(f"{s}/{r}".encode()).digest()[:4], "big") % cells, s))
    return sorted(out)


def place(counts: dict[int, int], shards: int, nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, from rank, to rank, shard, first slot) that put every row into a shard with room."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    places = [c for c, _ in nodes]
    waiting: dict[int, list[list[int]]] = {}
    for cell, n in sorted(counts.items()):  # to the next node clockwise
        waiting.setdefault(bisect_left(places, cell) % len(nodes), []).append([cell, 0, n])
    out, carried, at = [], [], 0
    while waiting or carried:  # full shards pass their keys on; each turn of the ring fills a shard or ends
        queue, rest = waiting.pop(at, []) + carried, []
        shard = nodes[at][1]
        for cell, lo, hi in queue:
            n = min(hi - lo, room[shard] - used[shard])
            if n:
                out.append((cell, lo, lo + n, shard, used[shard]))
                used[shard] += n
            if lo + n < hi:
                rest.append([cell, lo + n, hi])
        carried, at = rest, (at + 1) % len(nodes)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", replicas: int = REPLICAS) -> DataFrame:
    """Per row: doc_id, size (bytes of text plus 1), text_crc32, law, shard, slot (gapless in a shard), grown_shard (null: bounds tie rows together)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("cell", cell_of(F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    counts = {r[0]: r[1] for r in rows.groupBy("cell").count().collect()}
    ranges = place(counts, shards, ring(shards, replicas))
    table = F.broadcast(spark.createDataFrame(ranges, "cell int, lo long, hi long, shard int, base long"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("rank", rank).join(table, "cell").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
