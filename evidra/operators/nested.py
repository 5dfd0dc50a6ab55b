"""Deeply nested discussion records to flat tables that keep parent and child links.

Every node gets a state from a bottom-up tree automaton that runs in post-order. The state of a value follows from its type
and, for objects and arrays, from the states of all fields and elements in it; the state of a node follows from its kind,
its own value's state without the nodes below it, and what the states of its child nodes hold: their own states and those
below them, as a set. There are finitely many states for finitely many field names and types, however deep the trees are:
a chain of alike replies does not make new states. Two nodes share a state only if the shapes that occur in and below them
are the same. In raw threads the nodes below are the nested replies, in normalized discussions those whose parent reference
names the node. The state routes a node to the typed table of its kind and, in it, to its variant; a common supertype table
keeps owner, kind, id, parent and place of every node.

A state is numbered by a digest of kind and shapes, so that all tasks number alike without a shared table. How often a
shape stands below and in which order does not count. The column ``variant`` spells out the telling fields of the topmost
level. Parent references that run in a cycle have no leaves: nodes on or above one take the mark ``ring`` in place of the
states that cannot be found.

Defined cases: a value that is null or no JSON gives no rows; a JSON string that holds JSON counts as that JSON; elements
of other types or kinds are no rows, nor is anything below them, yet they count in the places of the others; missing ids and
ids of another type are empty strings, but a raw comment needs a string id; repeated rows and elements give one row per
owner, kind, id, parent and place. Documents may nest to any depth.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions.jsontext import elements, member, parse, text_or_empty, unwrap
from evidra.session import map_arrow

COMMENT, MORE, MORE_CHILD = "comment", "more", "more_child"
NODE_SCHEMA = "owner string, owner_key long, node_kind string, node_id string, parent_id string, pos int, variant string, depth int, author string, body string, score double, created_utc double, child_count long, state string"


class TreeAutomaton:
    """States from the leaves up: null, flag, number, text, blank and so on for values, then those of nodes.

    A node's transition takes its kind, the states of the fields that tell shapes apart, and the set of states below it.
    """

    def leaf(self, value: Any) -> str:
        if value is None:
            return "null"
        if isinstance(value, bool):
            return "flag"
        if isinstance(value, (int, float)):
            return "number"
        if isinstance(value, str):
            return "text" if value else "blank"
        if isinstance(value, list):
            return "array" if value else "none"
        return "object" if value else "hollow"

    def shape(self, value: Any, fields: tuple[str, ...]) -> str:
        """The transition of an object: the states of its telling fields, in their order, missing ones marked."""
        return "/".join(f"{f}:{self.leaf(value[f]) if f in value else 'absent'}" for f in fields)

    def below(self, children: list) -> str:
        """The kinds of the elements directly below, as they stand in the variant."""
        states = {self.raw(unwrap(x))[0] or "other" for x in children}
        return "below:" + ("+".join(sorted(states)) or "none")

    def raw(self, element: Any) -> tuple[str | None, dict]:
        """State and data of an element of a raw listing; no state for what is no node."""
        kind, data = member(element, "kind"), unwrap(member(element, "data"))
        if not isinstance(data, dict):
            return None, {}
        if kind == "t1" and self.leaf(data.get("id")) == "text":
            return COMMENT, data
        if kind == "more" and data:
            return MORE, data
        return None, {}


    def value(self, value: Any) -> str:
        """The state of a value of any depth, from its leaves up, without recursion."""
        if not isinstance(value, (dict, list)) or not value:
            return self.leaf(value)
        done: dict[int, str] = {}
        todo: list[tuple[Any, bool]] = [(value, False)]
        while todo:
            at, opened = todo.pop()
            inner = list(at.values()) if isinstance(at, dict) else at
            if not opened:
                todo.append((at, True))
                todo += [(x, False) for x in inner if isinstance(x, (dict, list)) and x]
                continue
            state = lambda x: done[id(x)] if isinstance(x, (dict, list)) and x else self.leaf(x)
            if isinstance(at, dict):
                done[id(at)] = self.named("{" + ",".join(sorted(f"{k}:{state(v)}" for k, v in at.items())) + "}")
            else:
                done[id(at)] = self.named("[" + ",".join(sorted({state(x) for x in at})) + "]")
        return done[id(value)]

    def own(self, data: dict, below: tuple[str, ...]) -> str:
        """The state of a node's own value: of all its fields, those that hold nodes below by their type alone."""
        return self.named("{" + ",".join(sorted(f"{k}:{self.leaf(v) if k in below else self.value(v)}" for k, v in data.items())) + "}")

    @staticmethod
    @lru_cache(1 << 16)
    def named(shape: str) -> str:
        """A short name of a shape."""
        return blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()

    @staticmethod
    @lru_cache(1 << 16)
    def state(kind: str, own: str, below: frozenset[str]) -> str:
        """The transition of a node: its kind, its own part and what the states below hold."""
        return f"{kind}:{blake2b(chr(0).join((own, *sorted(below))).encode(), digest_size=8).hexdigest()}"


AUTOMATON = TreeAutomaton()
RING = "ring"
_COMMENT_TELLS, _MORE_TELLS = ("author", "body", "score", "replies"), ("id", "count", "children")
_VERSION_TELLS, _VERSION_MORE = ("author", "body", "score", "parentId"), ("id", "count", "childIds")


def _number(value: Any) -> float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return float(value)
    except OverflowError:
        return None


def _text(value: Any) -> str | None:
    return value if isinstance(value, str) else None


Row = tuple


def _more(data: dict, parent: str, pos: int, children: list, tells: tuple[str, ...], depth: float | None) -> tuple[list[Row], set[str]]:
    """A placeholder and the ids it stands for, and what its state holds."""
    own = text_or_empty(data.get("id"))
    ids: list[Row] = []
    for place, child in enumerate(children):
        leaf = AUTOMATON.value(child)
        ids.append((MORE_CHILD, text_or_empty(child), own, place, AUTOMATON.leaf(child), None, None, None, None, None, None, AUTOMATON.state(MORE_CHILD, leaf, frozenset())))
    shape, mine, below = AUTOMATON.shape(data, tells), AUTOMATON.own(data, ("children", "childIds")), {x[-1] for x in ids}
    return [(MORE, own, parent, pos, shape, depth, None, None, None, None, len(children), AUTOMATON.state(MORE, mine, frozenset(below))), *ids], {f"{MORE}:{mine}", *below}


def version_rows(text: str | None, typed: bool = True) -> Iterator[Row]:
    """Nodes of a normalized discussion: kind, id, parent and place, and if ``typed`` variant and typed fields.

    All nodes are classified; without ``typed`` only their keys are given.
    """
    return _version_nodes(text) if typed else (r[:4] for r in _version_nodes(text))


def _reference(text: str) -> str:
    """An id or parent reference of a comment without letter case and kind prefix."""
    return text.strip().lower().removeprefix("t1_")


def _states_by_links(comments: list[Row], own: list[str], below: dict[str, set[str]]) -> list[str]:
    """States of comments that are linked by parent reference, from the leaves up; ``own`` are the states of their own values,
    ``below`` holds what is already known under an id.

    Comments of one id share what is below it. An id is ready once all comments that name it as parent have their states.
    """
    groups, waiting = defaultdict(list), defaultdict(int)
    for i, (_, name, parent, *_) in enumerate(comments):
        # A comment without an id can be named by none.
        groups[_reference(name) or i].append(i)
        waiting[_reference(parent)] += 1
    states = [""] * len(comments)
    ready = [k for k in groups if not waiting.get(k)]
    while ready:
        key = ready.pop()
        held = below.get(key, set())
        for i in groups.pop(key):
            states[i] = AUTOMATON.state(COMMENT, own[i], frozenset(held))
            above = _reference(comments[i][2])
            below[above] |= {f"{COMMENT}:{own[i]}", *held}
            waiting[above] -= 1
            if not waiting[above] and above in groups:
                ready.append(above)
    for key, members in groups.items():
        for i in members:
            states[i] = AUTOMATON.state(COMMENT, own[i], frozenset(below.get(key, ())) | {RING})
    return states


def _version_nodes(text: str | None) -> Iterator[Row]:
    doc = unwrap(parse(text))
    comments: list[Row] = []
    shapes: list[str] = []
    for pos, x in enumerate(elements(member(doc, "comments"))):
        x = unwrap(x)
        if isinstance(x, dict):
            own = COMMENT, text_or_empty(x.get("id")), text_or_empty(x.get("parentId")), pos
            comments.append((*own, AUTOMATON.shape(x, _VERSION_TELLS), _number(x.get("depth")), _text(x.get("author")), _text(x.get("body")), _number(x.get("score")), _number(x.get("createdUtc")), None))
            shapes.append(AUTOMATON.own(x, ()))
    rest: list[Row] = []
    below: dict[str, set[str]] = defaultdict(set)
    for pos, x in enumerate(elements(member(doc, "unresolvedMore"))):
        x = unwrap(x)
        if isinstance(x, dict):
            more, held = _more(x, text_or_empty(x.get("parentId")), pos, elements(x.get("childIds")), _VERSION_MORE, _number(x.get("depth")))
            below[_reference(more[0][2])] |= held
            rest += more
    for row, state in zip(comments, _states_by_links(comments, shapes, below)):
        yield *row, state
    yield from rest


def _post_id(listing: Any) -> str:
    for x in elements(member(unwrap(member(listing, "data")), "children")):
        data = unwrap(member(x, "data"))
        if member(x, "kind") == "t3" and isinstance(data, dict):
            if name := text_or_empty(data.get("name")):
                return name
            own = text_or_empty(data.get("id"))
            return own and "t3_" + own
    return ""


def raw_rows(text: str | None, typed: bool = True) -> Iterator[Row]:
    """Nodes of the raw thread in an artifact record, in reading order, without recursion; columns as ``version_rows``."""
    return _raw_nodes(text) if typed else (r[:4] for r in _raw_nodes(text))


def _raw_nodes(text: str | None) -> Iterator[Row]:
    listings = elements(member(unwrap(parse(text)), "content"))
    if len(listings) < 2:
        return
    top = elements(member(unwrap(member(unwrap(listings[1]), "data")), "children"))
    out: list[Row] = []
    # Of each open comment: what is left below it, its id and level, its place in ``out``, what the states below hold, and its own value's state.
    todo: list[tuple] = [(enumerate(top), _post_id(unwrap(listings[0])), 0, -1, set(), "")]
    while todo:
        rest, parent, level, at, states, mine = todo[-1]
        for pos, x in rest:
            x = unwrap(x)
            kind, data = AUTOMATON.raw(x)
            if kind == COMMENT:
                own = text_or_empty(data.get("name")) or "t1_" + data["id"]
                below = elements(member(unwrap(member(unwrap(data.get("replies")), "data")), "children"))
                out.append((COMMENT, own, parent, pos, AUTOMATON.shape(data, _COMMENT_TELLS) + "/" + AUTOMATON.below(below), level, _text(data.get("author")), _text(data.get("body")), _number(data.get("score")), _number(data.get("created_utc")), None))
                todo.append((enumerate(below), own, level + 1, len(out) - 1, set(), AUTOMATON.own(data, ("replies",))))
                break
            if kind == MORE:
                more, held = _more(data, parent, pos, elements(data.get("children")), _MORE_TELLS, level)
                states |= held
                out += more
        else:
            todo.pop()
            if todo:
                out[at] = (*out[at], AUTOMATON.state(COMMENT, mine, frozenset(states)))
                todo[-1][4].update(states)
                todo[-1][4].add(f"{COMMENT}:{mine}")
    yield from out


_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string())
_NAMES = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
KEYS = _NAMES[:6]


def _depth(value: Any) -> int | None:
    return int(value) if value is not None and abs(value) < 2**31 else None


def _flattener(owner: str, rows: Callable[[str | None], Iterator[Row]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[Row]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

        out: list[Row] = []
        for b in batches:
            for key, text in zip(b.column("owner_key").to_pylist(), b.column("doc").to_pylist()):
                seen = set()
                for r in rows(text):
                    if r[:4] not in seen:
                        seen.add(r[:4])
                        out.append((owner, key, *r[:5], _depth(r[5]), *r[6:]))
                if len(out) > 20_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return run


def flatten(df: DataFrame, owner: str, key: str, doc: str, typed: bool = True) -> DataFrame:
    """The nodes of every document of ``df``: with ``typed`` all columns of NODE_SCHEMA, else the supertype's keys of the same classified nodes.

    ``owner`` is ``version`` for normalized discussions, ``observation`` for artifact records with a raw thread.
    """
    rows = {"version": version_rows, "observation": raw_rows}[owner]
    documents = df.select(F.col(key).cast("long").alias("owner_key"), F.col(doc).alias("doc")).where("doc IS NOT NULL")
    nodes = map_arrow(documents, _flattener(owner, rows), NODE_SCHEMA)
    rest = [c for c in _NAMES if c not in KEYS]
    # Repeated deliveries may differ beside the keys: the same one is taken each time.
    nodes = nodes.groupBy(*KEYS).agg(F.min(F.struct("state", *(c for c in rest if c != "state"))).alias("node")).select(*KEYS, *(f"node.{c}" for c in rest))
    return nodes if typed else nodes.select(*KEYS)


#: Columns of the subtype tables beside the keys.
SUBTYPES = {COMMENT: ("variant", "state", "depth", "author", "body", "score", "created_utc"), MORE: ("variant", "state", "depth", "child_count"), MORE_CHILD: ("variant", "state")}


def subtype_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The supertype table ``node`` and the typed tables to which the states route, all with the same keys; ``state`` tells their variants apart."""
    routed = F.substring_index("state", ":", 1)
    parts = {kind: nodes.where(routed == kind).select(*KEYS, *columns) for kind, columns in SUBTYPES.items()}
    return {"node": nodes.select(*KEYS)} | parts


def write_variants(nodes: DataFrame, path: str) -> None:
    """The subtype tables as parquet, one folder per kind and within it one per variant; state, keys and parent links in each."""
    for kind, part in subtype_tables(nodes).items():
        part.write.partitionBy(*(["variant"] if "variant" in part.columns else [])).parquet(f"{path}/{kind}")
