"""What changed between consecutive full snapshots.

Per snapshot and key the row delivered last counts. Its content is reduced to a digest, so that texts are never shuffled.
The keys are range-partitioned once for all snapshots and each snapshot's sorted keys are cut into content-defined chunks:
a chunk ends after a key whose own hash says so, hence the cuts are the same in two snapshots but next to keys that came or
went. Chunks with the same digest in both snapshots are discarded unseen; only rows of the others are joined by key.

Defined cases: rows without a snapshot number or key take no part; of equal delivery times the row with the largest
``row_id`` counts; null content is a content of its own, equal to null only; content that is not JSON counts as its exact
text; a key delivered in no two neighbouring snapshots is added and later removed; the first snapshot yields nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.jsontext import INVALID, member, parse, unwrap
from evidra.session import cut, in_parts, join_small, map_arrow

#: The fields of a discussion that make up its content.
POST_FIELDS = ("id", "title", "author", "createdUtc", "selftext", "permalink")
COMMENT_FIELDS = ("id", "author", "depth", "parentId", "createdUtc", "body", "visibility")
MORE_FIELDS = ("id", "parentId", "count", "childIds", "depth")

#: A chunk has so many keys on average, and at most so many times as many; after a cut for size the next own cut is common again.
CHUNK_KEYS, MOST_CHUNKS = 64, 32


def _picked(value: Any, fields: tuple[str, ...]) -> list | None:
    value = unwrap(value, True)
    return [member(value, f) for f in fields] if isinstance(value, dict) else value


def _list(value: Any, fields: tuple[str, ...]) -> list:
    value = unwrap(value, True)
    return [_picked(x, fields) for x in value] if isinstance(value, list) else []


def content_of(text: str | None) -> str | None:
    """The content of a discussion in a canonical form: equal exactly for equal content."""
    if text is None:
        return None
    value = unwrap(parse(text, True), True)
    if value is INVALID:
        return "text:" + text
    if not isinstance(value, dict):
        return "json:" + json.dumps(value, sort_keys=True)
    more = _list(value.get("unresolvedMore"), MORE_FIELDS)
    for x in more:
        if isinstance(x, list) and len(x) == len(MORE_FIELDS):
            x[3] = unwrap(x[3], True)
    return json.dumps([_picked(value.get("post"), POST_FIELDS), _list(value.get("comments"), COMMENT_FIELDS), more], sort_keys=True)


def digest(text: str | None) -> bytes:
    return b"" if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _digests(content: Callable[[str | None], str | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([digest(content(t)) for t in b.column("content").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("snapshot"), b.column("key"), b.column("delivered"), b.column("tie"), made], ["snapshot", "key", "delivered", "tie", "digest"])

    return run


def _chunks(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: int, keys: list[str], digests: list[bytes]) -> pa.RecordBatch:
            total = hashlib.blake2b(digest_size=16)
            for k, d in zip(keys, digests):
                name = k.encode("utf-8", "surrogatepass")
                total.update(len(name).to_bytes(8, "big") + name + len(d).to_bytes(1, "big") + d)
            return pa.RecordBatch.from_pydict({"place": pa.array([at], pa.int32()), "chunk": pa.array([total.digest()], pa.binary()), "keys": pa.array([keys], pa.list_(pa.string())), "digests": pa.array([digests], pa.list_(pa.binary()))})

        at, keys, digests, made = None, [], [], []
        for b in batches:
            for place, key, d in zip(b.column("place").to_pylist(), b.column("key").to_pylist(), b.column("digest").to_pylist()):
                if keys and (place != at or len(keys) >= MOST_CHUNKS * every or crc32(keys[-1].encode("utf-8", "surrogatepass")) % every == 0):
                    made.append(out(at, keys, digests))
                    keys, digests = [], []
                at = place
                keys.append(key)
                digests.append(d)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
                made = []
        if keys:
            yield out(at, keys, digests)

    return run


def snapshot_changes(df: DataFrame, snapshot: str, key: str, content: str, delivered: str, tie: str, canonical: Callable[[str | None], str | None] = content_of, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """Columns snapshot (the later of the two), key and change_kind (added, removed or changed)."""
    rows = df.select(F.col(snapshot).cast("int").alias("snapshot"), F.lower(F.col(key)).alias("key"), F.col(delivered).alias("delivered"), F.col(tie).cast("long").alias("tie"), F.col(content).alias("content")).where("snapshot IS NOT NULL AND key IS NOT NULL")
    when = df.schema[delivered].dataType.simpleString()
    digests = map_arrow(rows, _digests(canonical), f"snapshot int, key string, delivered {when}, tie long, digest binary")
    # The partial aggregation on each task keeps one row per snapshot and key, so a key delivered very often is no hot key.
    last = cut(digests.groupBy("snapshot", "key").agg(F.max(F.struct("delivered", "tie", "digest"))["digest"].alias("digest")))
    # One row per snapshot number: delivered numbers are few, and each knows the one before it.
    numbers = last.groupBy("snapshot").count()
    total, newest = numbers.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    order = numbers.select("snapshot", F.row_number().over(Window.orderBy("snapshot")).cast("int").alias("place"))
    placed = last.join(order, "snapshot").select("place", "key", "digest")
    sorted_keys = placed.repartitionByRange(in_parts(total, 100_000), "key").sortWithinPartitions("place", "key")
    chunks = cut(map_arrow(sorted_keys, _chunks(chunk_keys), "place int, chunk binary, keys array<string>, digests array<binary>"))
    # Only places and digests of chunks are compared; the keys within are read again for the chunks that have no equal.
    ids = chunks.select("place", "chunk")
    lost = ids.where(F.col("place") < newest).join(ids.select((F.col("place") - 1).alias("place"), "chunk"), ["place", "chunk"], "left_anti").withColumn("side", F.lit("old"))
    come = ids.where("place > 1").join(ids.select((F.col("place") + 1).alias("place"), "chunk"), ["place", "chunk"], "left_anti").withColumn("side", F.lit("new"))
    lonely = cut(lost.unionByName(come))
    opened = join_small(chunks, lonely, ["place", "chunk"], "inner", lonely.count()).select("place", "side", F.explode(F.arrays_zip("keys", "digests")).alias("x"))
    old = opened.where("side = 'old'").select((F.col("place") + 1).alias("place"), F.col("x.keys").alias("key"), F.col("x.digests").alias("old"))
    new = opened.where("side = 'new'").select("place", F.col("x.keys").alias("key"), F.col("x.digests").alias("new"))
    joined = old.join(new, ["place", "key"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return joined.select("place", "key", kind.alias("change_kind")).where("change_kind IS NOT NULL").join(order, "place").select("snapshot", "key", "change_kind")

