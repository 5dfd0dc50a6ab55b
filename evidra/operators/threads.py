"""Raw discussion threads to one normalized record each, with its two digests.

The record keeps post, comments in reading order, placeholders and a validation block. The full digest covers all of it, the
content digest only what people wrote: neither scores nor counters change it. Digests are SHA-256 of canonical JSON: sorted
keys, no blanks, characters as they are, whole numbers without a fraction.

Defined cases: what is no two-listing thread with a root post gives a row with ``problem`` set and nulls elsewhere; fields
of another type are missing; threads may be of any depth.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.jsontext import INVALID, elements, member, parse, unwrap
from evidra.operators.nested import AUTOMATON, COMMENT, MORE
from evidra.operators.snapshots import COMMENT_FIELDS, POST_FIELDS
from evidra.session import map_arrow

NORMALIZER = "thread/v1"


def _finite(value: Any) -> int | float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return None
    return value


def _whole(value: Any, fallback: int) -> int:
    number = _finite(value)
    return int(number) if number is not None and number == int(number) else fallback


def _text(value: Any) -> str:
    return value if isinstance(value, str) else ""


def _text_or_none(value: Any) -> str | None:
    return value if isinstance(value, str) and value else None


def _iso(seconds: int | float | None) -> str | None:
    if seconds is None:
        return None
    try:
        at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=math.floor(seconds * 1000))
    except OverflowError:
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _plain(value: Any) -> Any:
    """Whole floats as integers, all the way down, without recursion into depth: records are flat but for child ids."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def canonical(value: Any) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def _comment(data: dict, level: int) -> dict:
    author, body, created = _text_or_none(data.get("author")), _text(data.get("body")), _finite(data.get("created_utc"))
    gone = "[deleted]" in (author, body)
    return {
        "id": _text_or_none(data.get("name")) or "t1_" + data["id"], "commentId": data["id"], "author": author, "score": _finite(data.get("score")),
        "depth": _whole(data.get("depth"), level), "parentId": _text_or_none(data.get("parent_id")), "createdUtc": created, "createdIso": _iso(created),
        "body": body, "visibility": "deleted" if gone else "removed" if body == "[removed]" else "visible",
    }


def _more(data: dict, level: int) -> dict:
    children = data.get("children")
    return {"id": _text_or_none(data.get("id")), "parentId": _text_or_none(data.get("parent_id")), "count": _finite(data.get("count")) or 0, "childIds": children if isinstance(children, list) else [], "depth": _whole(data.get("depth"), level)}


def _post(data: dict) -> dict:
    created = _finite(data.get("created_utc"))
    kind = "self" if data.get("is_self") else "video" if data.get("is_video") else "link_or_media"
    return {
        "id": _text_or_none(data.get("name")) or "t3_" + data["id"], "postId": data["id"], "title": _text(data.get("title")), "author": _text_or_none(data.get("author")),
        "score": _finite(data.get("score")), "upvoteRatio": _finite(data.get("upvote_ratio")), "subreddit": _text_or_none(data.get("subreddit_name_prefixed")),
        "totalReportedComments": _finite(data.get("num_comments")), "createdUtc": created, "createdIso": _iso(created), "selftext": _text(data.get("selftext")),
        "permalink": _text_or_none(data.get("permalink")), "postType": kind, "locked": bool(data.get("locked")),
    }


def _counter_class(reported: float | None, extracted: int, hidden: int) -> str:
    """The rule of ``rollup.counter_class`` for a record that is being made in a worker."""
    if reported is None:
        return "unknown"
    missing = reported - extracted
    return "match" if missing == 0 else "negative_counter_lag" if missing < 0 else "within_unresolved_more" if missing <= hidden else "exceeds_visible_tree"


def _validation(post: dict, comments: list[dict], more: list[dict]) -> dict:
    places: dict[str, list[int]] = defaultdict(list)
    for place, c in enumerate(comments):
        places[c["id"]].append(place)
    again = sorted((own for own, at in places.items() if len(at) > 1), key=lambda own: places[own][1])  # in the order in which the repetition is noticed
    reported, hidden = post["totalReportedComments"], sum(len(m["childIds"]) for m in more)
    return {
        "extractedCommentCount": len(comments), "uniqueCommentCount": len(places), "duplicateIds": again,
        "missingParentReferences": [{"id": c["id"], "parentId": c["parentId"]} for c in comments if c["parentId"] not in places and c["parentId"] != post["id"]],
        "maxDepth": max((c["depth"] for c in comments), default=None), "unresolvedMoreNodeCount": len(more), "unresolvedMoreChildCount": hidden,
        "sourceTreeExhausted": not more, "reportedCommentDelta": None if reported is None else reported - len(comments), "counterDeltaClass": _counter_class(reported, len(comments), hidden),
    }


def normalize(thread: Any) -> dict | str:
    """The record of a thread's two listings, or what is wrong with them."""
    listings = elements(thread)
    if len(listings) < 2:
        return "not a two-listing array"
    first = elements(member(member(listings[0], "data"), "children"))
    root = member(first[0] if first else None, "data")
    if not isinstance(root, dict) or not _text_or_none(root.get("id")):
        return "no root post"
    post, comments, more = _post(root), [], []
    todo = [(iter(elements(member(member(listings[1], "data"), "children"))), 0)]
    while todo:
        rest, level = todo[-1]
        for x in rest:
            state, data = AUTOMATON.raw(x)
            if state == COMMENT:
                comments.append(_comment(data, level))
                below = elements(member(member(unwrap(data.get("replies")), "data"), "children"))
                if below:
                    todo.append((iter(below), level + 1))
                    break
            elif state == MORE:
                more.append(_more(data, level))
        else:
            todo.pop()
    record = {"post": post, "comments": comments, "unresolvedMore": more, "validation": _validation(post, comments, more)}
    content = {"post": {f: post[f] for f in POST_FIELDS}, "comments": [{f: c[f] for f in COMMENT_FIELDS} for c in comments], "unresolvedMore": more}
    return record | {"normalizedSha256": digest(record), "normalizedContentSha256": digest(content)}


_COLUMNS = (("problem", pa.string()), ("post_id", pa.string()), ("reported", pa.float64()), ("comments", pa.int64()), ("duplicates", pa.int64()), ("missing_parents", pa.int64()), ("max_depth", pa.int64()), ("more_nodes", pa.int64()), ("more_children", pa.int64()), ("exhausted", pa.bool_()), ("counter_class", pa.string()), ("normalized_sha256", pa.string()), ("normalized_content_sha256", pa.string()), ("record", pa.string()))
_SQL = {"string": "string", "double": "double", "int64": "long", "bool": "boolean"}


def _row(text: str | None) -> tuple:
    value = parse(text)
    value = unwrap(value) if value is not INVALID else None
    thread = value.get("content") if isinstance(value, dict) else value
    record = normalize(thread)
    if isinstance(record, str):
        return (record, *[None] * (len(_COLUMNS) - 1))
    v, post = record["validation"], record["post"]
    reported = post["totalReportedComments"]
    return (None, post["id"], None if reported is None else float(reported), v["extractedCommentCount"], len(v["duplicateIds"]), len(v["missingParentReferences"]), v["maxDepth"], v["unresolvedMoreNodeCount"], v["unresolvedMoreChildCount"], v["sourceTreeExhausted"], v["counterDeltaClass"], record["normalizedSha256"], record["normalizedContentSha256"], canonical(record))


def _normalizing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = list(zip(*[_row(t) for t in b.column("doc").to_pylist()])) or [()] * len(_COLUMNS)
        yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(list(c), t) for c, (_, t) in zip(columns, _COLUMNS)]], ["key", *[n for n, _ in _COLUMNS]])


def normalized_threads(df: DataFrame, key: str, raw: str) -> DataFrame:
    """The key with problem, digests, validation figures and the record as canonical JSON, for each raw thread."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{n} {_SQL[str(t)]}" for n, t in _COLUMNS)
    return map_arrow(df.select(F.col(key).alias("key"), F.col(raw).alias("doc")), _normalizing, schema).withColumnRenamed("key", key)
