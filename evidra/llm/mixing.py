"""Mixing sources to target shares of all tokens, by Sainte-Lague apportionment of equal-token blocks.

Blocks go one after another to the source with the highest quotient share / (2 * blocks + 1), never beyond what the source
can give with its repeats; the blocks of a source go to its shards in the same way, by their tokens. That gives whole
quotas. Within a shard the documents stand in a seeded order: as many full copies as the quota holds, then round by
round each document that still fits into the rest, so nothing depends on file order.

The default size of the mix is the largest at which every source that has documents can give its share; sources without any
leave their share to the others, in proportion, and are reported with none. Defined cases: names of sources match without
regard to case, blanks and separators; documents of other or null sources, and empty ones, are in no mix; a target with a
null or negative share or repeats below one counts as zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import cut, in_parts, map_arrow

#: At most so many blocks are apportioned, and a source has at most so many shards; both bound what the driver holds.
MOST_BLOCKS, MOST_SHARDS, SHARD_TOKENS = 100_000, 4096, 2_000_000


def source_key(c: Column) -> Column:
    """A source name in lower case with single underscores between its words."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def apportion(weights: dict, caps: dict, seats: int) -> dict:
    """Seats by highest quotients weight / (2 * seats + 1), ties to the smaller name, no one beyond its cap."""
    given = dict.fromkeys(weights, 0)
    heap = [(-Fraction(w), name) for name, w in weights.items() if w > 0 and caps[name] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, name = heapq.heappop(heap)
        given[name] += 1
        if given[name] < caps[name]:
            heapq.heappush(heap, (-Fraction(weights[name]) / (2 * given[name] + 1), name))
    return given


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Times each document is used in a round: once if it still fits into the rest, with the full copies in the first."""
    shard, left = None, 0
    for b in batches:
        used = []
        for source, number, tokens, copies, rest, turn, most in zip(*(b.column(c).to_pylist() for c in ("source", "shard", "tokens", "copies", "rest", "round", "most"))):
            if (source, number) != shard:
                shard, left = (source, number), rest
            fits = tokens <= left and copies + turn <= most
            left -= tokens * fits
            used.append((copies if turn == 1 else 0) + fits)
        made = pa.array(used, pa.int32())
        batch = pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), b.column("tokens"), made], ["key", "source", "tokens", "times_used"])
        yield batch.filter(pc.greater(made, 0))


def mix(documents: DataFrame, key: str, source: str, tokens: str, targets: list[tuple[str, float, int]], size: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents with ``times_used`` above zero, and the report of shares; ``targets`` are (source, share, max_repeats)."""
    spark = documents.sparkSession
    wanted = {name: (max(0.0, share or 0.0), max(0, repeats or 0)) for name, share, repeats in targets}
    rows = cut(documents.select(F.col(key).alias("key"), source_key(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("tokens")).where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)))
    have = {r["source"]: (r["docs"], r["total"]) for r in rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total")).collect()}  # a row per target
    able = {n: (s, r, have[n][1]) for n, (s, r) in wanted.items() if n in have and s > 0 and r > 0}
    whole = sum(s for s, _, _ in able.values())
    most = int(min((t * r * whole / s for s, r, t in able.values()), default=0))
    size = most if size is None else size
    block = max(1, -(-size // MOST_BLOCKS))
    blocks = apportion({n: s for n, (s, _, _) in able.items()}, {n: t * r // block for n, (_, r, t) in able.items()}, size // block)
    shards = {n: min(MOST_SHARDS, max(1, -(-t // SHARD_TOKENS))) for n, (_, _, t) in able.items()}
    number = F.create_map(*[x for n, k in shards.items() for x in (F.lit(n), F.lit(k))])[F.col("source")] if shards else F.lit(1)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key"), number))
    by_shard: dict[str, dict[int, int]] = {n: {} for n in able}
    for r in sharded.where(F.col("source").isin(list(able))).groupBy("source", "shard").agg(F.sum("tokens").alias("total")).collect() if able else []:  # at most MOST_SHARDS a target
        by_shard[r["source"]][r["shard"]] = r["total"]
    quotas = []
    for n, parts in by_shard.items():
        caps = {k: -(-t * able[n][1] // block) for k, t in parts.items()}
        for k, b in apportion(parts, caps, blocks[n]).items():
            quota = min(b * block, parts[k] * able[n][1])
            quotas.append((n, k, quota // parts[k], quota % parts[k], able[n][1]))
    quota = spark.createDataFrame(quotas, "source string, shard long, copies long, rest long, most int")
    # The documents of a shard pass one task in seeded order, once for each time they may still be repeated; nothing of a
    # shard is held, so shards may be of any size.
    rounds = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("most") - F.col("copies")).cast("int"))))
    placed = sharded.join(F.broadcast(quota), ["source", "shard"]).select("key", "source", "shard", "tokens", "copies", "rest", "most", F.xxhash64(F.lit(seed + 1), "key").alias("turn"), rounds.alias("round"))
    # As many tasks as shards, so that the work is spread whatever the session's shuffle partitions are.
    ordered = placed.repartition(in_parts(max(1, sum(shards.values())), 1), "source", "shard").sortWithinPartitions("source", "shard", "round", "turn", "key")
    kind = documents.schema[key].dataType.simpleString()
    filled = map_arrow(ordered, _fill, f"key {kind}, source string, tokens long, times_used int")
    mixed = cut(filled.groupBy(F.col("key").alias(key), "source", "tokens").agg(F.sum("times_used").cast("int").alias("times_used")))
    given = {r["source"]: r for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times_used")).alias("used"), F.max("times_used").alias("most")).collect()}  # a row per target
    total = sum(r["used"] for r in given.values())
    facts = [(n, s, r, *have.get(n, (0, 0)), blocks.get(n, 0) * block, *((given[n]["used"], given[n]["most"], given[n]["used"] / total) if n in given else (0, 0, 0.0))) for n, (s, r) in wanted.items()]
    report = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, documents long, available_tokens long, quota_tokens long, used_tokens long, most_repeats int, actual_share double")
    return mixed, report
