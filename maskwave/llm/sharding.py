"""Operator 13: resharding by minimum-cost flow."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Shards that the query starts from (a plain hash of the texts) and ends with.
OLD_SHARDS, SHARDS = 6, 8
#: Blocks of a shard: what is moved as one. Groups of equal texts over a shard's capacity have PIECES of their own.
BLOCKS, PIECES = 1024, 64
#: Blocks of more than one in so many rows are numbered in PIECES parts.
LARGE = 1000


def least_cost_flow(supply: list[int], capacity: list[int], cost: list[list[float]]) -> list[list[int]]:
    """How much goes from each old shard to each new one at the least total cost, by successive cheapest paths with potentials.

    Each path fills a whole remaining supply, capacity or flow that it takes back; shards are few, so this runs on the driver."""
    old, new = len(supply), len(capacity)
    flow = [[0] * new for _ in range(old)]
    left, room = list(supply), list(capacity)
    up, down = [0.0] * old, [min((cost[i][j] for i in range(old)), default=0.0) for j in range(new)]
    while sum(left) and sum(room):
        far, back, queue = {}, {}, [(0.0, 0, i) for i in range(old) if left[i]]
        best = {(0, i): 0.0 for _, _, i in queue}
        while queue:
            d, side, i = heapq.heappop(queue)
            if (side, i) in far:
                continue
            far[side, i] = d
            if side == 0:
                steps = [(d + cost[i][j] + up[i] - down[j], 1, j) for j in range(new)]
            else:
                steps = [(d - cost[k][i] + down[i] - up[k], 0, k) for k in range(old) if flow[k][i]]
            for step in steps:
                if step[0] < best.get(step[1:], float("inf")) - 1e-12:
                    best[step[1:]], back[step[1:]] = step[0], (side, i)
                    heapq.heappush(queue, step)
        end = min((j for j in range(new) if room[j]), key=lambda j: far[1, j] + down[j])
        reach = far[1, end]
        path, at = [], (1, end)
        while at in back:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at[1]], room[end], *(flow[b[1]][a[1]] for a, b in path if a[0] == 1)])
        for a, b in path:
            i, j, sign = (a[1], b[1], 1) if a[0] == 0 else (b[1], a[1], -1)
            flow[i][j] += sign * amount
        left[at[1]] -= amount
        room[end] -= amount
        for i in range(old):
            up[i] += min(far.get((0, i), reach), reach)
        for j in range(new):
            down[j] += min(far.get((1, j), reach), reach)
    return flow


def move_blocks(blocks: dict[tuple[int, int], int], shards: int, cost: list[list[float]] | None = None) -> dict[tuple[int, int], int]:
    """(old shard, block) -> new shard, for blocks given with their bytes.

    Capacities are equal parts of all bytes. The flow says how many bytes go from where to where (staying costs nothing, by default
    moving costs each byte the same); blocks that fit are sent, in order of number (a hash), until less is left than any block. Then the
    fullest shard gives to the emptiest the block that evens them out best, while that helps, so shards differ by little more than a
    small block."""
    held = defaultdict(list)
    for (old, block), size in blocks.items():
        held[old].append((size, block))
    total, olds = sum(blocks.values()), max(held, default=-1) + 1
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    cost = cost or [[float(i != j) for j in range(shards)] for i in range(olds)]
    flow = least_cost_flow([sum(s for s, _ in held[i]) for i in range(olds)], capacity, cost)
    goes, sizes = {}, [0] * shards
    for i in range(olds):
        # The shard itself comes last: what fits no transfer stays, or, where the shard is given up, goes where most of it goes.
        order = sorted((j for j in range(shards) if flow[i][j] and j != i), key=lambda j: (-flow[i][j], j))
        rest = i if i < shards else (order[0] if order else 0)
        left = {j: flow[i][j] for j in order}
        for size, block in sorted(held[i], key=lambda x: x[1]):
            to = next((j for j in order if size <= left[j]), rest)
            if to in left:
                left[to] -= size
            goes[i, block] = to
            sizes[to] += size
    within = defaultdict(list)
    for key, to in goes.items():
        within[to].append((blocks[key], key))
    for _ in range(16 * shards):
        full, empty = max(range(shards), key=lambda j: (sizes[j], j)), min(range(shards), key=lambda j: (sizes[j], j))
        gap = sizes[full] - sizes[empty]
        fits = [(abs(gap - 2 * s), k) for s, k in within[full] if 0 < s < gap]
        if not fits:
            break
        key = min(fits)[1]
        within[full].remove((blocks[key], key))
        within[empty].append((blocks[key], key))
        goes[key], sizes[full], sizes[empty] = empty, sizes[full] - blocks[key], sizes[empty] + blocks[key]
    return goes


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _group(text: Column) -> Column:
    """A number that equal texts share."""
    return F.xxhash64(text, F.crc32(text.cast("binary")))


def measured(df: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, group (of equal texts) and row, a number for each row of the files that are read."""
    text = _text()
    return df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _group(text).alias("group"), F.monotonically_increasing_id().alias("row"))


def reshard(rows: DataFrame, old: str, shards: int, blocks: int = BLOCKS, cost: list[list[float]] | None = None, piece: Column | None = None) -> DataFrame:
    """Adds block, shard, moved and slot to rows that have doc_id, size, group, row (as ``measured`` makes them) and an old shard in
    ``old`` that is the same for a whole group, numbered from 0.

    A block is a hash range of a shard's groups, so equal texts stay together; only a group of more bytes than a new shard holds (fewer than
    ``shards`` of those) is dealt into 64 pieces, by row or by the number that ``piece`` gives. The driver holds one size a block: old shards x blocks numbers, whatever the
    input. Slots number each shard's rows from 0 by block, then doc_id; blocks of over a thousandth of the rows are numbered in 64 parts, so no
    window holds a whole shard. ``rows`` must give the same numbers each time it is read: a written table."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = [r[0] for r in rows.groupBy("group").agg(F.sum("size").alias("size")).where(F.col("size") > total // shards).select("group").collect()]
    part = F.pmod(F.col("row"), F.lit(PIECES))
    block = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(blocks))
    for k, g in enumerate(sorted(large)):
        block = F.when(F.col("group") == g, blocks + k * PIECES + (part if piece is None else piece)).otherwise(block)
    dealt = rows.withColumn("block", block)
    found = [tuple(r) for r in dealt.groupBy(old, "block").agg(F.sum("size"), F.count("*")).collect()]
    goes = move_blocks({(o, b): s for o, b, s, _ in found}, shards, cost)
    count = {(o, b): n for o, b, _, n in found}
    limit = max(sum(count.values()) // LARGE, 1)
    spark = rows.sparkSession
    moves = spark.createDataFrame([(o, b, to, count[o, b] > limit) for (o, b), to in sorted(goes.items())], f"{old} long, block long, shard int, wide boolean")
    placed = dealt.withColumn(old, F.col(old).cast("long")).join(F.broadcast(moves), [old, "block"])  # a row a block, by parameter
    placed = placed.withColumn("part", F.when(F.col("wide"), part).otherwise(F.lit(0)).cast("long")).drop("wide")
    cells = placed.groupBy("shard", old, "block", "part").count().orderBy("shard", old, "block", "part").collect() if large or any(n > limit for n in count.values()) else [(goes[k], *k, 0, n) for k, n in sorted(count.items(), key=lambda x: (goes[x[0]], x[0]))]
    starts, at = [], defaultdict(int)
    for shard, o, b, part, n in cells:
        starts.append((o, b, part, at[shard]))
        at[shard] += n
    start = spark.createDataFrame(starts, f"{old} long, block long, part long, start long")
    nth = F.row_number().over(Window.partitionBy(old, "block", "part").orderBy("doc_id", "row")) - 1
    out = placed.withColumn("nth", nth).join(F.broadcast(start), [old, "block", "part"])
    return out.withColumns({"slot": F.col("start") + F.col("nth"), "moved": F.col(old) != F.col("shard")}).drop("start", "nth", "part")


def shard_documents(df: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved: documents that lie in ``old_shards`` hash shards dealt to
    ``shards`` of near equal bytes, with the fewest bytes moved.

    Null texts have size 1 and count as empty ones. Rows without an id, or of one id, are rows like others; equal texts share a shard unless
    they are more than one shard holds. Extra columns are ignored. An empty table gives an empty result. Ties of slots are broken by the
    row's place in the files."""
    rows = written(measured(df), "measured").withColumn("old_shard", F.pmod(F.xxhash64("group"), F.lit(old_shards)))
    out = reshard(rows, "old_shard", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old_shard").cast("int").alias("old_shard"), "moved")


#: Files of a shard in a stored layout: a file holds the blocks whose number has its remainder.
FILES = 32


def store(df: DataFrame, path: str, shards: int, blocks: int = BLOCKS) -> None:
    """Writes documents as a layout of ``shards`` hash shards: generation 0 of ``path``. Columns of the documents stay as they are; their
    names must not start with ``__``."""
    rows = df.withColumn("__group", _group(_text()))
    file = F.pmod(F.pmod(F.xxhash64("__group", F.lit(1)), F.lit(blocks)), F.lit(FILES))
    rows = rows.withColumn("__shard", F.pmod(F.xxhash64("__group"), F.lit(shards)).cast("int")).withColumn("__name", F.concat_ws("-", F.lit("g0"), "__shard", file.cast("string")))
    rows.write.partitionBy("__name").parquet(f"{path}/files")
    spark = df.sparkSession
    spark.read.parquet(f"{path}/files").select("__name", "__shard").distinct().write.parquet(f"{path}/generation=0")


def _files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/files").parquet(*[f"{path}/files/__name={n}" for n in names])


def _listed(spark: SparkSession, path: str, generation: int) -> list[str]:
    return [r[0] for r in spark.read.parquet(f"{path}/generation={generation}").select("__name").distinct().collect()]  # shards x files names


def stored(spark: SparkSession, path: str, generation: int) -> DataFrame:
    """The documents of a generation, with __shard; files that later or broken runs left are not read."""
    return _files(spark, path, _listed(spark, path, generation)).drop("__group", "__name")


def rewrite(spark: SparkSession, path: str, shards: int, generation: int, blocks: int = BLOCKS) -> dict[str, int]:
    """Reshards generation ``generation`` of a stored layout to ``shards`` and writes the next one: files that lose rows are written anew
    without them, what arrives goes to new files, all others stay as they are. The list of the generation's files is written last, so a run
    that breaks leaves the old generation whole and can be repeated. A group of equal texts that is more than a shard holds is cut by the
    hash of doc_id. Returns how many files there were, were written anew, and came.
    """
    names = spark.read.parquet(f"{path}/generation={generation}")
    listed = _listed(spark, path, generation)
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(PIECES))
    docs = _files(spark, path, listed)
    narrow = docs.select("doc_id", F.col("__group").alias("group"), "__shard", "__name", (F.octet_length(_text()) + 1).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    plan = reshard(written(narrow, "layout"), "__shard", shards, blocks, piece=piece).where("moved")
    moving = written(plan.select("__name", F.col("group").alias("__group"), piece.alias("__piece"), F.col("shard").alias("__to")).distinct(), "moving")
    losing = [r[0] for r in moving.select("__name").distinct().collect()]
    kept = names.where(~F.col("__name").isin(losing))
    if losing:
        touched = _files(spark, path, losing).withColumn("__piece", piece).join(moving, ["__name", "__group", "__piece"], "left")
        own = F.regexp_replace("__name", "^g[0-9]+-", "")
        arrived = F.concat(F.col("__to").cast("string"), F.lit("-from-"), F.col("__shard").cast("string"))
        made = touched.withColumn("__name", F.concat(F.lit(f"g{generation + 1}-"), F.coalesce(arrived, own))).withColumn("__shard", F.coalesce("__to", "__shard"))
        made.drop("__to", "__piece").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__name").parquet(f"{path}/files")
        fresh = written(made.select("__name", "__shard").distinct(), "names")
        kept = kept.unionByName(fresh)
    kept.write.mode("overwrite").parquet(f"{path}/generation={generation + 1}")
    came = kept.where(F.col("__name").contains("-from-") & F.col("__name").startswith(f"g{generation + 1}-")).count()
    return {"files": len(listed), "rewritten": len(losing), "new": came}


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shard_documents`` of all documents."""
    return shard_documents(table(spark, sf_dir, "documents"))
