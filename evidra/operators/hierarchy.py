"""Parent-child rows to full hierarchies: root, depth, path, descendants and cycles.

Every node has at most one parent, so a hierarchy is a forest whose trees may hang on an outer anchor (the post), end at a
node without a known parent (orphan), or run into a cycle. First the connected components are found; each component is
co-located in one task and walked there by one iterative depth-first traversal with node colouring, from its head down. On
the way down a node gets its depth and path, on the way up its number of descendants and the sum of their values. A ring's
nodes head the trees below them; the parent link that closes the ring is its back edge.

No link leaves a scope (thread), so a scope of up to ``max_block`` nodes is co-located as it is, and the components are found
within the task by a union of linked nodes. A larger scope is never gathered: pointer doubling over joins finds the component
of each node, in a number of rounds that grows with the logarithm of the depth, and its components are then spread over the
tasks. A single component beyond ``max_block`` nodes gets depths and ends by doubling, too; its descendants are counted and
summed over the same pointers.

A component is named by its ``root``: each has exactly one topmost node, or one cycle whose least id it is. The nodes on the
cycle itself are marked ``on_ring``, apart from those whose chain leads into it; ``back_edges`` gives the link that closes it.

Defined cases: a null or blank id is no node and is left out; a null or blank parent is no parent, so the node is the head
of an orphan chain; several rows of an id count once, the one with the latest version, then the largest tie-break; a node
that names itself is a cycle of one; a parent in another scope is not there. Empty input gives an empty result. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.session import cut, in_parts, join_small, map_arrow

POST, ORPHAN, CYCLE = "post", "orphan", "cycle"
MAX_BLOCK = 200_000
_WHITE, _GREY, _BLACK = 0, 1, 2


def reference_key(c: Column) -> Column:
    """A reference without surrounding blanks, letter case and kind prefix; null where nothing is left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^t[0-9]+_", "")
    return F.nullif(bare, F.lit(""))


def latest_nodes(df: DataFrame, node: str, parent: str, scope: str, version: str, tie: str, keep: str) -> DataFrame:
    """One row per node key: the latest version. Columns node, parent, scope, kept."""
    keyed = df.select(
        reference_key(F.col(node)).alias("node"), reference_key(F.col(parent)).alias("parent"), reference_key(F.col(scope)).alias("scope"),
        F.col(version).alias("version"), F.col(tie).alias("tie"), F.col(keep).alias("kept"),
    ).where("node IS NOT NULL")
    best = keyed.groupBy("node").agg(F.max(F.struct("version", "tie", "parent", "scope", "kept")).alias("best"))
    return best.select("node", "best.parent", F.coalesce("best.scope", F.lit("")).alias("scope"), "best.kept")


def components(up: list[int]) -> list[int]:
    """The component of each node, as the index of one of its nodes; ``up`` holds the parent's index or a negative number."""
    mark = list(range(len(up)))

    def find(x: int) -> int:
        while mark[x] != x:
            mark[x] = mark[mark[x]]
            x = mark[x]
        return x

    for i, p in enumerate(up):
        if p >= 0:
            a, b = find(i), find(p)
            if a != b:
                mark[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(up))]


class Forest:
    """Whole components, walked one after another.

    Of each node its root's index, depth, end, ring mark, number of nodes below and sum of values from it down; ``ways`` gives
    the nodes in depth-first order. For a cycle the root is the node of the least id on it and the depth -1; a chain that ends
    at the anchor has its topmost node as root.
    """

    def __init__(self, nodes: list[str], parents: list[str | None], scopes: list[str], values: list | None = None):
        index = {(s, n): i for i, (n, s) in enumerate(zip(nodes, scopes))}
        self.nodes = nodes
        self.up = [-1 if p is None else -2 if p == s else index.get((s, p), -1) for p, s in zip(parents, scopes)]
        size = len(nodes)
        self.root, self.depth, self.end, self.ring = [0] * size, [0] * size, [""] * size, bytearray(size)
        self.level, self.below = [0] * size, [0] * size
        self.total = [v or 0 for v in values] if values is not None else [0] * size
        self.down: list[list[int]] = [[] for _ in nodes]
        for i, p in enumerate(self.up):
            if p >= 0:
                self.down[p].append(i)
        members: dict[int, list[int]] = {}
        for i, c in enumerate(components(self.up)):
            members.setdefault(c, []).append(i)
        self.colour = bytearray(size)
        self.heads: list[list[int]] = [self._walk(m) for m in members.values()]

    def _walk(self, members: list[int]) -> list[int]:
        """One component: its heads, and the marks of all its nodes."""
        up, colour = self.up, self.colour
        at, trail = members[0], []
        while at >= 0 and colour[at] == _WHITE:
            colour[at] = _GREY
            trail.append(at)
            at = up[at]
        if at >= 0:  # a grey node met again: the link to it is a back edge
            ring = trail[trail.index(at) :]
            head = min(ring, key=self.nodes.__getitem__)
            heads, end = ring, CYCLE
            for x in ring:
                self.ring[x] = 1
        else:
            head = trail[-1]
            heads, end = [head], POST if at == -2 else ORPHAN
        for x in trail:
            colour[x] = _WHITE
        for start in heads:
            colour[start], stack = _GREY, [(start, iter(self.down[start]))]
            while stack:
                x, rest = stack[-1]
                for child in rest:
                    if colour[child] == _WHITE and not self.ring[child]:
                        colour[child] = _GREY
                        self.level[child] = len(stack)
                        stack.append((child, iter(self.down[child])))
                        break
                else:
                    stack.pop()
                    colour[x] = _BLACK
                    self.root[x], self.end[x], self.depth[x] = head, end, -1 if end == CYCLE else self.level[x]
                    if stack:
                        over = stack[-1][0]
                        self.below[over] += self.below[x] + 1
                        self.total[over] += self.total[x]
        if end == CYCLE:
            whole = sum(self.total[x] for x in heads)
            for x in heads:  # all others of the component are below each node on the ring
                self.below[x], self.total[x] = len(members) - 1, whole
        return heads

    def ways(self) -> Iterator[list[int]]:
        """The nodes from the head down to each node, for all nodes; the list is reused."""
        for heads in self.heads:
            for start in heads:
                way, todo = [], [(start, 0)]
                while todo:
                    x, level = todo.pop()
                    del way[level:]
                    way.append(x)
                    yield way
                    todo += [(child, level + 1) for child in self.down[x] if not self.ring[child]]

    def places(self) -> dict[int, tuple[list[int], int]]:
        """Of each node on a ring its ring, upwards by parent links, and its place there."""
        found: dict[int, tuple[list[int], int]] = {}
        for heads in self.heads:
            if self.ring[heads[0]]:
                ring, at = [], heads[0]
                for _ in heads:
                    ring.append(at)
                    at = self.up[at]
                found.update((x, (ring, i)) for i, x in enumerate(ring))
        return found


def walk_parents(nodes: list[str], parents: list[str | None], scopes: list[str]) -> tuple[list[int], list[int], list[str], bytearray]:
    """Root index, depth, end and ring mark of each node of whole components."""
    f = Forest(nodes, parents, scopes)
    return f.root, f.depth, f.end, f.ring


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, by: str = "part") -> Iterator[pa.Table]:
    """Rows sorted by the scope or component they are co-located by, cut where one ends once ``rows`` are together."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        all_held = pa.Table.from_batches(held)
        scopes = all_held.column(by).to_pylist()
        last, k = scopes[-1], len(scopes)
        while k and scopes[k - 1] == last:
            k -= 1
        if k:
            yield all_held.slice(0, k)
        held = all_held.slice(k).to_batches()
        count = len(scopes) - k
    if held:
        yield pa.Table.from_batches(held)


#: So many ids of paths, or pairs, are written at once.
_CHUNK = 500_000


def _walker(with_paths: bool, rings_as_heads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 20_000):
            columns = [block.column(c).to_pylist() for c in ("node", "parent", "scope", "value")]
            nodes, forest = columns[0], Forest(*columns)
            out = {
                "node": block.column("node"), "scope": block.column("scope"), "root": pa.array([nodes[r] for r in forest.root], pa.string()),
                "real_depth": pa.array(forest.depth, pa.int32()), "chain_end": pa.array(forest.end, pa.string()), "on_ring": pa.array(map(bool, forest.ring), pa.bool_()),
                "below": pa.array(forest.below, pa.int64()), "total": pa.array(forest.total, pa.int64()), "parent": block.column("parent"), "kept": block.column("kept"),
            }
            whole = pa.table(out).combine_chunks()
            if not with_paths:
                yield from whole.to_batches()
                continue
            # Paths in depth-first order, written as they are found: never more than a chunk of ids is held.
            order, paths, size = [], [], 0
            for way in forest.ways():
                x = way[-1]
                order.append(x)
                paths.append([nodes[i] for i in way] if rings_as_heads or forest.end[x] != CYCLE else None)
                size += len(way)
                if size > _CHUNK:
                    yield from whole.take(order).append_column("path", pa.array(paths, pa.list_(pa.string()))).combine_chunks().to_batches()
                    order, paths, size = [], [], 0
            if order:
                yield from whole.take(order).append_column("path", pa.array(paths, pa.list_(pa.string()))).combine_chunks().to_batches()

    return run


def _pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(scope, ancestor, descendant, distance) for every node and each other node above it, by the shortest way."""
    for block in _blocks(batches, 20_000):
        columns = [block.column(c).to_pylist() for c in ("node", "parent", "scope")]
        nodes, scopes, forest = columns[0], columns[2], Forest(*columns)
        places = forest.places()
        rows: list[list] = [[], [], [], []]

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.string(), pa.int32()))], ["scope", "ancestor", "descendant", "distance"])

        for way in forest.ways():
            x, level = way[-1], len(way) - 1
            above = [(a, level - i) for i, a in enumerate(way[:-1])]
            if way[0] in places:
                ring, place = places[way[0]]
                above += [(ring[(place + k) % len(ring)], level + k) for k in range(1, len(ring))]
            for a, far in above:
                for column, value in zip(rows, (scopes[x], nodes[a], nodes[x], far)):
                    column.append(value)
            if len(rows[0]) > _CHUNK:
                yield made()
                rows = [[], [], [], []]
        if rows[0]:
            yield made()


def _ended(state: DataFrame, before: tuple[int, int | None] | None) -> tuple[bool, tuple[int, int | None]]:
    """Whether pointer doubling has come to its end, and what to compare the next round with.

    Depths have no gaps: if no chain has ended in a round, all nodes that still move lead into cycles. Their pointers are just
    the nodes on cycles once these get no fewer, and the least id covers its whole cycle once it falls no more.
    """
    still = state.where("ptr IS NOT NULL")
    moving, fell = still.agg(F.count("*"), F.count_if("fell")).first()
    arrived = still.select("scope", "ptr").distinct().count() if before and moving == before[0] and not fell else None
    return not moving or (arrived is not None and arrived == before[1]), (moving, arrived)


def _labelled(nodes: DataFrame) -> DataFrame:
    """Columns scope, root, node, parent, kept and value: the component of every node of scopes too large for one task.

    By pointer doubling, in which a node takes part only until it has found its root, so that a round costs no more than what
    still moves.
    """
    known = nodes.select("scope", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(known, ["scope", "parent"], "left")
    up = F.when(F.col("there") & ~F.coalesce(F.col("parent") == F.col("scope"), F.lit(False)), F.col("parent"))
    state = cut(linked.select("scope", "node", "parent", "kept", "value", up.alias("ptr"), F.col("node").alias("root"), F.lit(True).alias("fell")))
    done = state.where("ptr IS NULL")
    over, seen = _ended(state, None)
    while not over:
        moving = state.where("ptr IS NOT NULL")
        ahead = done.unionByName(moving).select("scope", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("root").alias("root2"))
        least = F.when(F.col("ptr2").isNull(), F.col("root2")).otherwise(F.least("root", "root2"))
        moved = join_small(ahead, moving, ["scope", "ptr"], "inner", seen[0]).select("scope", "node", "parent", "kept", "value", F.col("ptr2").alias("ptr"), least.alias("root"), (F.col("root2") < F.col("root")).alias("fell"))
        # A broadcast join has a part for each of all parts before; they would multiply from round to round.
        state = cut(moved.coalesce(max(nodes.sparkSession.sparkContext.defaultParallelism, in_parts(seen[0], 60_000))))
        done = done.unionByName(state.where("ptr IS NULL"))
        over, seen = _ended(state, seen)
    columns = ["scope", "root", "node", "parent", "kept", "value"]
    if not seen[0]:
        return done.select(columns)
    # What still moves runs in a cycle; its pointer is a node on it, whose least id covers the whole cycle.
    moving = state.where("ptr IS NOT NULL")
    heads = moving.select("scope", F.col("node").alias("ptr"), "root")
    return done.select(columns).unionByName(join_small(heads, moving.drop("root"), ["scope", "ptr"], "inner", seen[0]).select(columns))


def _by_component(large: DataFrame, max_block: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of large scopes, co-located by component, and those of single components that are too large for a task."""
    labelled = _labelled(large)
    sizes = labelled.groupBy("scope", "root").count()
    many, giants = sizes.agg(F.coalesce(F.sum(F.when(F.col("count") <= max_block, F.col("count"))), F.lit(0)), F.count_if(F.col("count") > max_block)).first()
    if not giants:
        return _located(labelled, many, "scope", "root"), None
    giant = sizes.where(F.col("count") > max_block).select("scope", "root")
    return _located(join_small(labelled, giant, ["scope", "root"], "left_anti", giants), many, "scope", "root"), join_small(labelled, giant, ["scope", "root"], "left_semi", giants).drop("root")


def _double(nodes: DataFrame, with_paths: bool) -> DataFrame:
    """Root, depth and end of every node by pointer doubling, for components too large for one task."""
    known = nodes.select("scope", F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(known, ["scope", "parent"], "left")
    to_post = F.coalesce(F.col("parent") == F.col("scope"), F.lit(False))
    state = cut(linked.select(
        "scope", "node", "parent", "kept", "value", F.lit(0).cast("long").alias("below"), F.coalesce("value", F.lit(0)).cast("long").alias("total"),
        F.when(~to_post & F.col("there"), F.col("parent")).alias("ptr"),
        F.when(to_post, POST).when(F.col("there").isNull(), ORPHAN).alias("chain_end"),
        F.lit(0).cast("long").alias("dist"), F.col("node").alias("top"), F.col("node").alias("least"), F.lit(True).alias("fell"),
        *([F.array("node").alias("path")] if with_paths else []),
    ).withColumn("dist", F.when(F.col("ptr").isNotNull(), 1).otherwise(0).cast("long")))
    over, seen = _ended(state, None)
    while not over:
        ahead = state.select("scope", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("chain_end").alias("end2"), F.col("dist").alias("dist2"), F.col("top").alias("top2"), F.col("least").alias("least2"), *([F.col("path").alias("path2")] if with_paths else []))
        # What lies up to twice as far below: the own part and the parts of those whose pointer comes here.
        arriving = state.where("ptr IS NOT NULL").groupBy("scope", F.col("ptr").alias("node")).agg(F.sum(F.col("below") + 1).alias("more_below"), F.sum("total").alias("more_total"))
        grown = state.join(arriving, ["scope", "node"], "left").withColumn("below", F.col("below") + F.coalesce("more_below", F.lit(0))).withColumn("total", F.col("total") + F.coalesce("more_total", F.lit(0))).drop("more_below", "more_total")
        moving = grown.where("ptr IS NOT NULL").join(ahead, ["scope", "ptr"])
        moved = moving.select(
            "scope", "node", "parent", "kept", "value", "below", "total", F.col("ptr2").alias("ptr"), F.col("end2").alias("chain_end"), (F.col("dist") + F.col("dist2")).alias("dist"),
            F.when(F.col("ptr2").isNull(), F.col("top2")).otherwise(F.col("top")).alias("top"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("fell"),
            *([F.concat("path2", "path").alias("path")] if with_paths else []),
        )
        state = cut(grown.where("ptr IS NULL").unionByName(moved))
        over, seen = _ended(state, seen)
    # What still moves now runs in a cycle; its pointer is a node on it, whose least id covers the whole cycle.
    ended = state.where("ptr IS NULL").select("node", "scope", F.col("top").alias("root"), F.col("dist").cast("int").alias("real_depth"), "chain_end", F.lit(False).alias("on_ring"), "below", "total", "parent", "kept", "value", *(["path"] if with_paths else []))
    moving = state.where("ptr IS NOT NULL").select("scope", "node", "ptr", "parent", "kept", "value", "below", "total")
    heads = state.select("scope", F.col("node").alias("ptr"), F.col("least").alias("root"))
    # After that many steps every node of a cycle is the pointer of another of its nodes, and no other node is a pointer.
    ring = moving.select("scope", F.col("ptr").alias("node")).distinct().withColumn("hit", F.lit(True))
    looping = moving.join(heads, ["scope", "ptr"]).join(ring, ["scope", "node"], "left")
    sizes = looping.groupBy("scope", "root").agg((F.count("*") - 1).alias("ring_below"), F.sum(F.coalesce("value", F.lit(0))).cast("long").alias("ring_total"))
    hit = F.coalesce("hit", F.lit(False))
    around = looping.join(sizes, ["scope", "root"]).select("node", "scope", "root", F.lit(-1).alias("real_depth"), F.lit(CYCLE).alias("chain_end"), hit.alias("on_ring"), F.when(hit, F.col("ring_below")).otherwise(F.col("below")).alias("below"), F.when(hit, F.col("ring_total")).otherwise(F.col("total")).alias("total"), "parent", "kept", "value", *([F.lit(None).cast("array<string>").alias("path")] if with_paths else []))
    return ended.unionByName(around)


def _split(nodes: DataFrame, max_block: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Nodes of scopes that fit into a task, how many nodes there are in all, and those of larger scopes if there are any."""
    sizes = nodes.groupBy("scope").count()
    total, large = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.when(F.col("count") > max_block, 1))).first()
    if not large:
        return nodes, total, None
    hot = sizes.where(F.col("count") > max_block).select("scope")
    return join_small(nodes, hot, ["scope"], "left_anti", large), total, join_small(nodes, hot, ["scope"], "left_semi", large)


def _located(nodes: DataFrame, rows: int, *by: str) -> DataFrame:
    """Nodes co-located and sorted by the columns that tell their scope or component, named by ``part``."""
    parted = nodes.withColumn("part", F.concat_ws("\u0000", *by)).select("node", "parent", "scope", "kept", "value", "part")
    return parted.repartition(in_parts(rows, 60_000), "part").sortWithinPartitions("part")


def hierarchy(nodes: DataFrame, with_paths: bool = False, max_block: int = MAX_BLOCK, value: str | None = None, rings_as_heads: bool = False) -> DataFrame:
    """Columns node, scope, root, real_depth, chain_end, on_ring, below, total, parent, kept and, on demand, path, for nodes as ``latest_nodes`` gives them.

    ``chain_end`` is ``post``, ``orphan`` or ``cycle``; ``below`` is the number of descendants, ``total`` the sum of ``value``
    over a node and all of them. ``path`` holds as many ids as the node is deep, so ask for it only where the paths themselves
    are wanted; of cycles it is null unless ``rings_as_heads`` lets it start at the ring.
    """
    nodes = cut(nodes.withColumn("value", F.col(value).cast("long") if value else F.lit(None).cast("long")))
    schema = "node string, scope string, root string, real_depth int, chain_end string, on_ring boolean, below long, total long, parent string, kept " + nodes.schema["kept"].dataType.simpleString() + (", path array<string>" if with_paths else "")
    usual, total, large = _split(nodes, max_block)
    walker = _walker(with_paths, rings_as_heads)
    found = map_arrow(_located(usual, total, "scope"), walker, schema)
    if large is None:
        return found
    located, giant = _by_component(large, max_block)
    found = found.unionByName(map_arrow(located, walker, schema))
    if giant is not None:
        kept = cut(_double(giant, with_paths)).drop("value")
        found = found.unionByName(with_rings_as_heads(kept) if with_paths and rings_as_heads else kept)
    return found


def descendants(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a hierarchy with paths, each node being its own at distance 0."""
    return paths.where("path IS NOT NULL").select("scope", F.col("node").alias("descendant"), "real_depth", F.posexplode("path").alias("level", "ancestor")).select("scope", "ancestor", "descendant", (F.col("real_depth") - F.col("level")).alias("distance"))


def with_rings_as_heads(found: DataFrame) -> DataFrame:
    """``found`` with a path for every node: of cycles, each node on the ring heads the tree below it, and paths start there."""
    cycles = found.where(F.col("chain_end") == CYCLE)
    trees = hierarchy(cycles.select("node", F.when(~F.col("on_ring"), F.col("parent")).alias("parent"), "scope", "kept"), True).select("scope", "node", "path")
    return found.where(F.col("chain_end") != CYCLE).unionByName(cycles.drop("path").join(trees, ["scope", "node"]))


def all_descendants(nodes: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """(scope, ancestor, descendant, distance) for every node and each other node below it, rings included, by the shortest way
    down. The pairs come from the walk itself; only those of single components beyond ``max_block`` are made of their paths."""
    nodes = cut(nodes.withColumn("value", F.lit(None).cast("long")))
    usual, total, large = _split(nodes, max_block)
    schema = "scope string, ancestor string, descendant string, distance int"
    pairs = map_arrow(_located(usual, total, "scope"), _pairing, schema)
    if large is None:
        return pairs
    located, giant = _by_component(large, max_block)
    pairs = pairs.unionByName(map_arrow(located, _pairing, schema))
    if giant is not None:
        pairs = pairs.unionByName(_pairs_of_paths(hierarchy(giant.drop("value"), True, max_block, rings_as_heads=True)))
    return pairs


def _pairs_of_paths(whole: DataFrame) -> DataFrame:
    pairs = descendants(whole.withColumn("real_depth", F.size("path") - 1)).where("distance > 0")
    cycles = whole.where(F.col("chain_end") == CYCLE)
    # Places on a ring, counted down from its least node, whose own parent link closes the ring.
    ring = cycles.where("on_ring").select("node", F.when(F.col("node") != F.col("root"), F.col("parent")).alias("parent"), "scope", "kept")
    places = hierarchy(ring).select("scope", "root", F.col("node").alias("entry"), F.col("real_depth").alias("place"))
    length = places.groupBy("scope", "root").agg(F.count("*").alias("length"))
    entries = cycles.select("scope", "root", F.col("node").alias("descendant"), F.col("path")[0].alias("entry"), (F.size("path") - 1).alias("level")).join(places, ["scope", "root", "entry"])
    others = places.select("scope", "root", F.col("entry").alias("ancestor"), F.col("place").alias("from")).join(length, ["scope", "root"])
    around = entries.join(others, ["scope", "root"]).where("ancestor <> entry")
    return pairs.unionByName(around.select("scope", "ancestor", "descendant", (F.col("level") + F.expr("pmod(place - `from`, length)")).cast("int").alias("distance")))


def back_edges(found: DataFrame) -> DataFrame:
    """For each cycle its least node, the parent link that leads back into it, and how many nodes are on it and lead to it."""
    cycles = found.where(F.col("chain_end") == CYCLE)
    return cycles.groupBy("scope", F.col("root").alias("node")).agg(F.max(F.when(F.col("node") == F.col("root"), F.col("parent"))).alias("back_to"), F.count_if("on_ring").alias("ring_nodes"), F.count("*").alias("nodes"))
