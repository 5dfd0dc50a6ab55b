"""Identities: name-based UUIDs, digests, canonical JSON, work-item ids and page cursors."""

import base64
import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.session import ship

#: The namespaces of name-based ids.
DISCUSSION_NS = "a6364574-5df2-46ae-a1bd-1a135f12b4c5"
VERSION_NS = "547720a9-8fed-487d-a67e-67460aa444b6"
PROVENANCE_NS = "bfac70b1-04e0-463f-990c-4befc9f446d1"
BUNDLE_NS = "f5e0ab8c-97e8-4b02-a8f2-c919a2cbbf8d"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of UTF-8 text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *parts)


def discussion_id(workspace: Column, platform: Column, external_id: Column) -> Column:
    return uuid5(DISCUSSION_NS, _joined(workspace, F.lower(F.trim(platform)), external_id))


def version_id(discussion: Column, normalizer: Column, content_sha256: Column) -> Column:
    return uuid5(VERSION_NS, _joined(discussion, normalizer, content_sha256))


def provenance_id(version: Column, observation: Column) -> Column:
    return uuid5(PROVENANCE_NS, _joined(version, observation))


def bundle_id(workspace: Column, bundle_sha256: Column) -> Column:
    return uuid5(BUNDLE_NS, F.concat(workspace, F.lit(":"), bundle_sha256))


def work_item_id(external_id: Column) -> Column:
    return F.concat(F.lit("thread_"), F.substring(F.sha2(external_id, 256), 1, 32))


def job_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *parts)


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no blanks and whole numbers without a fraction; null for what is no JSON.

    Numbers of a size whose text needs an exponent keep it, so two spellings of such a number may differ.
    """
    return F.to_json(F.try_parse_json(text))


def json_digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def _ascii_digest(text):
    """SHA-256 of canonical JSON in ASCII; nothing for what is no JSON."""
    try:
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def ascii_json_digest(text: Column) -> Column:
    """SHA-256 of canonical JSON in ASCII: sorted keys, no blanks, other characters escaped. Null for what is no JSON.

    No built-in function escapes so, hence an Arrow-batched function.
    """
    ship(SparkSession.active())

    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(_ascii_digest)

    return F.pandas_udf(digests, T.StringType())(text)


def encode_cursor(namespace: Column, position: Column) -> Column:
    """URL-safe Base64 of ``namespace:position`` without padding."""
    plain = F.base64(F.encode(F.concat_ws(":", namespace, position.cast("string")), "UTF-8"))
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))


def decode_cursor(namespace: str, cursor: str) -> int:
    """The position of a cursor, checked; a driver-side function for a request's single argument."""
    if len(cursor) > 200:
        raise ValueError("cursor too long")
    try:
        name, _, position = base64.b64decode((cursor + "=" * (-len(cursor) % 4)).encode("ascii"), altchars=b"-_", validate=True).decode("utf-8").rpartition(":")
    except (ValueError, UnicodeError) as e:
        raise ValueError("not a cursor") from e
    if name != namespace or not position.isascii() or not position.isdigit() or int(position) < 1:
        raise ValueError("not a cursor of this list")
    return int(position)
