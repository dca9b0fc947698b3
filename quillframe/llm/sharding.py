"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Law `rows`: shards differ by one row at most. Equal texts are linked, each group through one hub, so that a group's
state is the number of its documents in each shard, never a list of them or of their pairs. Every document begins in the
shard of its hash. In each round a group is drawn to the shard that already holds most of it; documents elsewhere ask to
move there. Requests are summed by source, target and hashed slice (n_shards x n_shards x SLICES numbers come to the
driver), granted as far as room and the moves out of the target allow, and the grants are joined back and moved, fractions of a
document being rounded at a hashed number. Cut
edges never grow, as documents only leave shards that hold no more of their group. Documents without links then fill what room is left, with
documents above a quota, so that the law holds exactly.

Counts become rows by gapless ranks, which are taken in parts (see grouped_rank), so that a hot group is in no one task.

Nulls and edge cases: a null text counts no bytes, has the CRC of the empty text and no links; repeated rows and rows of
one doc_id are sharded each; with fewer rows than shards some shards are empty, and of an empty table comes an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import discard, grouped_rank, written

N_SHARDS = 24
ROUNDS = 6
SLICES = 16
#: Rows of a part in which ranks are taken, in the mean.
PART_ROWS = 50_000


def _largest(counts: Column, shards: list[int]) -> Column:
    """The shard, of those given, with most of the group; of equals a hashed one."""
    best = F.array_max(F.array(*[F.struct(F.element_at(counts, s + 1).alias("n"), F.xxhash64(F.col("g"), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in shards]))
    return best["s"]


def feasible(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest scaled-down moves (from, to) that no shard's room forbids; what leaves a shard makes room in it."""
    moves = asked.astype(float)
    for _ in range(500):
        limit, coming = np.maximum(room + moves.sum(axis=1), 0), moves.sum(axis=0)
        scale = np.divide(limit, coming, out=np.ones_like(limit), where=coming > limit)
        if (scale > 1 - 1e-9).all():
            break
        moves *= scale[None, :]
    return moves


def propagated(groups: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(g, counts array) of linked groups, moved within the quotas.

    Every other round draws groups to shards with room only (a quarter of the largest at least, so that the rest of a rounding
    attracts none), so that what a full shard can't take goes elsewhere together.
    """
    k, spark = len(quota), groups.sparkSession
    asks = F.expr("posexplode(transform(counts, (n, s) -> if(s != target and n > 0 and n <= element_at(counts, target + 1), n, 0L)))")
    for turn in range(rounds):
        load = groups.agg(*[F.sum(F.element_at("counts", s + 1)) for s in range(k)]).first()
        room = np.array([quota[s] - (load[s] or 0) for s in range(k)])
        near = [s for s in range(k) if room[s] > 0 and 4 * room[s] >= room.max()] if turn % 2 else list(range(k))
        if not near:
            continue
        drawn = groups.withColumn("target", _largest(F.col("counts"), near)).withColumn("slice", F.pmod(F.xxhash64("g"), F.lit(SLICES)).cast("int"))
        rows = drawn.select("target", "slice", asks.alias("source", "n")).groupBy("source", "target", "slice").agg(F.sum("n").alias("n")).filter("n > 0").collect()
        if not rows and not turn % 2:
            break
        asked = np.zeros((k, k, SLICES))
        for r in rows:
            asked[r["source"], r["target"], r["slice"]] = r["n"]
        granted = feasible(asked.sum(axis=2), room)
        before = np.cumsum(asked, axis=2) - asked
        share = np.clip(np.divide(granted[:, :, None] - before, asked, out=np.zeros_like(asked), where=asked > 0), 0, 1)
        if not share.any():
            continue
        grants = [(b, c, [float(x) for x in share[:, b, c]]) for b in range(k) for c in range(SLICES) if share[:, b, c].any()]
        table = spark.createDataFrame(grants, "target int, slice int, share array<double>")
        joined = drawn.join(F.broadcast(table), ["target", "slice"], "left")
        gone = F.expr(f"transform(counts, (n, s) -> if(share is not null and s != target and n <= element_at(counts, target + 1), cast(floor(n * share[s] + pmod(xxhash64(g, s, {turn}), 1000) / 1001D) as bigint), 0L))")
        moved = joined.withColumn("gone", gone).withColumn("came", F.expr("aggregate(gone, 0L, (a, n) -> a + n)"))
        after = written(moved.select("g", F.expr("transform(counts, (n, s) -> n - gone[s] + if(s = target, came, 0L))").alias("counts")), "shard-groups")
        discard(groups)
        groups = after
    return groups


def sharded(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5("text").alias("g"))
    rows = written(base.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")), "shard-rows")
    total = rows.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = rows.filter("g is not null").groupBy("g", F.pmod("h", F.lit(n_shards)).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    per_group = cells.groupBy("g").agg(*[F.sum(F.when(F.col("s") == s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in range(n_shards)], F.sum("n").alias("all"))
    linked = written(per_group.filter("all > 1").select("g", F.array(*[f"c{s}" for s in range(n_shards)]).alias("counts")), "shard-groups")
    groups = propagated(linked, quota, rounds)
    running = F.expr("transform(counts, (n, i) -> aggregate(slice(counts, 1, i + 1), 0L, (a, x) -> a + x))")
    state = groups.select("g", running.alias("upto"))
    salts = max(32, -(-total // PART_ROWS))
    salt = F.pmod("h", F.lit(salts))
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    joined = written(rows.join(state, "g", "left"), "shard-joined")
    ranked = grouped_rank(joined.filter("upto is not null"), ["g"], order, salt, "r")
    placed = ranked.withColumn("shard", F.size(F.filter("upto", lambda x: x <= F.col("r"))).cast("int")).drop("upto", "r", "g")
    placed = written(grouped_rank(placed, ["shard"], order, salt, "slot", bounded=True), "shard-placed")
    limit = F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    kept = placed.filter(F.col("slot") < limit)
    loads = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    pool = joined.filter("upto is null").drop("upto", "g").unionByName(placed.filter(F.col("slot") >= limit).drop("shard", "slot"))
    pool = grouped_rank(pool, [], order, salt, "r", bounded=True)
    upto, at = [], 0
    for s in range(n_shards):
        at += quota[s] - loads.get(s, 0)
        upto.append(at)
    ends = F.array(*[F.lit(x).cast("long") for x in upto])
    begins = F.array(*[F.lit(x - (quota[s] - loads.get(s, 0)) - loads.get(s, 0)).cast("long") for s, x in enumerate(upto)])
    filled = pool.withColumn("shard", F.size(F.filter(ends, lambda x: x <= F.col("r"))).cast("int"))
    filled = filled.withColumn("slot", F.col("r") - F.element_at(begins, F.col("shard") + 1)).drop("r")
    out = kept.unionByName(filled)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
