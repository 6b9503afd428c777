"""Operator 10, resharding by a minimum-cost flow.

A layout is a folder with one subfolder of Parquet files a shard; a row's slot is its position: the rows of the shard's files before its own, in
the order of their names, and its place within its file. To change a layout, its rows are cut into blocks by a hash of file and place, so that
repeated or null ids spread like any others; the blocks' sizes (about BLOCKS rows, whatever the data's size) come to the driver. A flow network
sends bytes from old shards to new ones of equal capacity; a byte that stays in the shard of its number costs nothing, one that moves costs 1,
so the solution moves the fewest bytes. Old shards without a new shard of their number have equal costs everywhere and are one source,
which changes no cost, so the network grows with the new shards alone. Each old shard's flows are then filled with its blocks, largest first,
what one rounding leaves over being passed to the next.

Only files of shards that give rows away are rewritten: what stays is copied without a shuffle, what moves is shuffled. A shard that
only gets rows keeps its files and gets new ones.

The law is ``bytes``: shards get near equal sizes, up to about a block of smallest size (a document larger than a shard stays alone in one).

Defined cases: a null text has 0 bytes and crc32 0; repeated rows have slots of their own; an empty table gives an empty result; the layout adds
the columns _shard and, when read, _slot and keeps all others (those with such a name as <name>_in).
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.llm.scratch import folder, materialize

SHARDS, BLOCKS = 40, 1 << 16
#: Bytes of moved text in a task of the shuffle, and the most tasks that it has (tasks grow beyond that).
PIECE_BYTES, MOST_PIECES = 8 << 20, 1 << 15
EXTRA = 16
#: The old layout that the query writes: so many shards of uneven size, of so many pieces of the table's files at least.
OLD, OLD_PIECES = 32, 256
_OWN = ("_shard", "_slot", "_gen", "_file", "_at", "_block", "_to", "_metadata")


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Flow from rows to columns that ships all supply within the capacities at the least cost (primal-dual: shortest paths, then blocking flows)."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    s, t = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    price: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(z)
            price.append(v)

    first = 0
    for i in range(n):
        for j in range(m):
            arc(i, n + j, supply[i], int(cost[i, j]))
    for i, x in enumerate(supply):
        arc(s, i, x, 0)
    for j, x in enumerate(capacity):
        arc(n + j, t, x, 0)
    height = [0] * (n + m + 2)
    left = sum(supply)
    while left:
        dist = [1 << 60] * (n + m + 2)
        dist[s] = 0
        todo = [(0, s)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > dist[a]:
                continue
            for e in out[a]:
                if cap[e] and (new := d + price[e] + height[a] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]] = new
                    heapq.heappush(todo, (new, to[e]))
        for a in range(n + m + 2):
            height[a] += min(dist[a], dist[t])
        while True:  # blocking flows over arcs without reduced cost
            level = {s: 0}
            line = [s]
            for a in line:
                for e in out[a]:
                    if cap[e] and to[e] not in level and price[e] + height[a] - height[to[e]] == 0:
                        level[to[e]] = level[a] + 1
                        line.append(to[e])
            if t not in level:
                break
            at = [0] * (n + m + 2)
            while True:
                path: list[int] = []
                a = s
                while a != t:
                    while at[a] < len(out[a]):
                        e = out[a][at[a]]
                        if cap[e] and level.get(to[e], -1) == level[a] + 1 and price[e] + height[a] - height[to[e]] == 0:
                            break
                        at[a] += 1
                    if at[a] == len(out[a]):
                        if a == s:
                            break
                        a = to[path.pop() ^ 1]
                        at[a] += 1
                    else:
                        path.append(out[a][at[a]])
                        a = to[path[-1]]
                if a != t:
                    break
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                left -= push
    return np.array([cap[first + 2 * k + 1] for k in range(n * m)], object).reshape(n, m)


class Plan:
    """Where each block of a numbered layout goes. blocks: (old shard, block, bytes, rows)."""

    def __init__(self, blocks: list[tuple[int, int, int, int]], shards: int):
        by_old: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for old, block, size, rows in sorted(blocks):
            by_old[old].append((size, block, rows))
        total = {o: sum(x[0] for x in by_old[o]) for o in sorted(by_old)}
        # old shards beyond the new ones cost 1 everywhere, so they are one source
        own, beyond = [o for o in total if o < shards], [o for o in total if o >= shards]
        sources = [[o] for o in own] + ([beyond] if beyond else [])
        whole = sum(total.values())
        capacity = [whole * (k + 1) // shards - whole * k // shards for k in range(shards)]
        cost = np.ones((len(sources), shards), int)
        for i, o in enumerate(own):
            cost[i, o] = 0
        self.flow = min_cost_flow([sum(total[o] for o in s) for s in sources], capacity, cost)
        self.least = int((self.flow * cost).sum())
        self.to: dict[tuple[int, int], int] = {}
        self.bytes = [0] * shards
        self.moved = 0
        over = [0] * shards
        for i, members in enumerate(sources):
            need = [(-(int(self.flow[i, j]) + over[j]), j) for j in range(shards) if self.flow[i, j]]
            heapq.heapify(need)
            for size, o, block in sorted(((size, o, block) for o in members for size, block, _ in by_old[o]), reverse=True):
                want, j = need[0]
                heapq.heapreplace(need, (want + size, j))
                self.to[o, block] = j
                self.bytes[j] += size
                self.moved += size * (o != j)
            for want, j in need:
                over[j] = -want
        self.giving = sorted({o for (o, _), s in self.to.items() if s != o})


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + EXTRA


def lay_out(docs: DataFrame, shard: Column, path: str) -> StructType:
    """Write ``docs`` as a layout below ``path``, each row in the shard that the column says; no shuffle. Returns the layout's schema."""
    docs = docs.withColumn("_to", shard) if "_to" not in docs.columns else docs.withColumnRenamed("_to", "_to_in").withColumn("_to", shard)
    docs = docs.withColumnsRenamed({c: f"{c}_in" for c in docs.columns if c in _OWN and c != "_to"}).withColumnRenamed("_to", "_shard")
    docs = docs.withColumn("_shard", F.col("_shard").cast("int"))
    docs.write.partitionBy("_shard").parquet(path)
    return StructType([f for f in docs.schema if f.name != "_shard"]).add("_shard", "integer")


def _read(spark: SparkSession, path: str, schema: StructType, shards: list[int] | None = None) -> DataFrame:
    """Rows of a layout, or of some shards of it, with their file and place."""
    rows = spark.read.schema(schema).parquet(path)
    if shards is not None:
        rows = rows.filter(F.col("_shard").isin(shards))
    return rows.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})


def _blocked(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("_block", F.pmod(F.xxhash64("_file", "_at"), F.lit(blocks)).cast("int"))


def reshard(spark: SparkSession, path: str, schema: StructType, new: str, shards: int, text: str = "text", blocks: int = BLOCKS) -> Plan:
    """Change the layout below ``path`` to ``shards`` shards: those that give rows away (``giving`` of the plan) are rewritten below ``new``, where
    moved rows go too. slotted() reads the result."""
    n_old = max(1, spark.read.schema(schema).parquet(path).select("_shard").distinct().count())  # folders alone
    each = max(1, blocks // n_old)
    sums = _blocked(_read(spark, path, schema), each).groupBy("_shard", "_block").agg(F.sum(size_of(text)).alias("b"), F.count(F.lit(1)).alias("n"))
    plan = Plan([(r._shard, r._block, r.b, r.n) for r in sums.collect()], shards)  # BLOCKS rows, or one a shard if there are more shards
    table = spark.createDataFrame([(o, b, s) for (o, b), s in plan.to.items() if o in set(plan.giving)], "_shard int, _block int, _to int")
    given = _blocked(_read(spark, path, schema, plan.giving), each).join(F.broadcast(table), ["_shard", "_block"])
    names = [f.name for f in schema if f.name != "_shard"]
    out = [*(f"`{c}`" for c in names), F.col("_to").alias("_shard")]
    pieces = min(MOST_PIECES, max(spark.sparkContext.defaultParallelism, plan.moved // PIECE_BYTES + 1))
    moved = given.filter("_to != _shard").repartition(pieces, "_to", F.pmod("_block", F.lit(pieces // shards + 1)))
    given.filter("_to = _shard").select(*out).unionAll(moved.select(*out)).write.partitionBy("_shard").parquet(new)
    return plan


def slotted(spark: SparkSession, layouts: list[tuple[str, list[int] | None]], schema: StructType) -> DataFrame:
    """Rows of the shards in ``layouts`` (path, shards; None: all) with _shard and _slot, gapless from 0 in each shard."""
    rows = None
    for gen, (path, shards) in enumerate(layouts):
        part = _read(spark, path, schema, shards).withColumn("_gen", F.lit(gen))
        rows = part if rows is None else rows.unionAll(part)
    files = rows.groupBy("_shard", "_gen", "_file").agg((F.max("_at") + 1).alias("n"))
    before = Window.partitionBy("_shard").orderBy("_gen", "_file").rowsBetween(Window.unboundedPreceding, -1)  # the files of one shard
    first = materialize(files.select("_shard", "_gen", "_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "files")
    placed = rows.join(first, ["_shard", "_gen", "_file"])  # broadcast only while the list of files is small
    return placed.select(*(f"`{f.name}`" for f in schema), (F.col("_first") + F.col("_at")).alias("_slot"))


def uneven(doc_id: str, n_files: int) -> Column:
    """Old shards of the query: pieces of the table's files, dealt so that the first shards get far more than the last ones."""
    piece = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit(10)), F.lit(-(-OLD_PIECES // n_files)))
    lot = F.pmod(F.xxhash64(F.element_at(F.split(F.input_file_name(), "/"), -1), piece), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(lot * lot * OLD).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an uneven layout of OLD shards, as a growing table has it, and changes it to SHARDS equal ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old, new = folder(spark, "old"), folder(spark, "new")
    schema = lay_out(docs, uneven("doc_id", max(1, len(docs.inputFiles()))), old)
    plan = reshard(spark, old, schema, new, SHARDS)
    rows = slotted(spark, [(old, [o for o in range(OLD) if o not in plan.giving]), (new, None)], schema)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return rows.select("doc_id", size_of("text").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
