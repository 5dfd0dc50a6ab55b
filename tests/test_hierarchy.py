from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidra.operators.hierarchy import back_edges, descendants, hierarchy, latest_nodes, walk_parents
from evidra.plans import problems

SCHEMA = "row_id long, id string, parent_id string, thread_id string, depth int, fetched_at timestamp, node string, scope string"


RINGS: dict[str, set] = {}


def brute(rows):
    """Chain of each node by repeated lookup."""
    key = lambda s: None if s is None or not s.strip() else (s.strip().lower().split("_", 1)[1] if s.strip().lower()[:1] == "t" and "_" in s else s.strip().lower()) or None
    best = {}
    for r in rows:
        k = key(r[1])
        if k is not None and (k not in best or (r[5] is not None, r[5], r[0]) > (best[k][5] is not None, best[k][5], best[k][0])):
            best[k] = r
    up = {k: (key(r[3]) or "", key(r[2])) for k, r in best.items()}
    out = {}
    for k, (scope, _) in up.items():
        chain, at = [k], k
        while True:
            parent = up[at][1]
            if parent is not None and parent == scope:
                out[k] = (chain[-1], len(chain) - 1, "post", list(reversed(chain)))
                break
            if parent is None or parent not in up or up[parent][0] != scope:
                out[k] = (chain[-1], len(chain) - 1, "orphan", list(reversed(chain)))
                break
            if parent in chain:
                ring = chain[chain.index(parent):]
                out[k] = (min(ring), -1, "cycle", None)
                RINGS.setdefault(min(ring), set()).update(ring)
                break
            chain.append(parent)
            at = parent
    return out


def made(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        thread = r.choice(["t3_a", "t3_b", "T3_B", "t3_hot", "t3_hot", "t3_hot", None])
        scope = thread
        parent = r.choice([scope, f"t1_n{r.randrange(n)}", f" T1_N{r.randrange(n)} ", f"n{r.randrange(n)}", None, "", "  ", "t1_gone", f"t1_n{i}"])
        rows.append((i, r.choice([f"t1_n{i}", f"t1_n{i}", f"t1_n{r.randrange(n)}", None if r.random() < 0.1 else f"T1_n{i}"]), parent, thread, r.choice([None, 0, 1, 5]), None, "clash", "clash"))
    import datetime as dt

    return [(*x[:5], None if r.random() < 0.05 else dt.datetime(2026, 1, 1 + r.randrange(5)), *x[6:]) for x in rows]


def run(spark, rows, max_block, with_paths=True):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = latest_nodes(df, "id", "parent_id", "thread_id", "fetched_at", "row_id", "depth")
    return hierarchy(nodes, with_paths, max_block)


@pytest.mark.parametrize(("seed", "max_block"), [(1, 10_000), (1, 20), (2, 0), (3, 60)])
def test_like_brute_force_co_located_and_by_doubling(spark, seed, max_block):
    rows = made(seed)
    found = run(spark, rows, max_block)
    collected = found.collect()
    RINGS.clear()
    assert {r["node"]: (r["root"], r["real_depth"], r["chain_end"], r["path"]) for r in collected} == brute(rows)
    assert {r["node"] for r in collected if r["on_ring"]} == set().union(*RINGS.values())
    edges = {r["node"]: r for r in back_edges(found).collect()}
    assert {k: r["ring_nodes"] for k, r in edges.items()} == {k: len(v) for k, v in RINGS.items()} and all(r["back_to"] in RINGS[k] for k, r in edges.items())


def test_deep_chain_and_long_cycle(spark):
    chain = [(i, f"t1_c{i}", f"t1_c{i - 1}" if i else "t3_x", "t3_x", None, None, "", "") for i in range(3000)]
    ring = [(10_000 + i, f"t1_r{i:04d}", f"t1_r{(i + 1) % 700:04d}", "t3_x", None, None, "", "") for i in range(700)]
    for block in (10_000, 5):
        got = {r["node"]: r for r in run(spark, chain + ring, block, False).collect()}
        assert got["c2999"]["real_depth"] == 2999 and got["c2999"]["root"] == "c0" and got["c2999"]["chain_end"] == "post"
        assert got["r0500"]["root"] == "r0000" and got["r0500"]["real_depth"] == -1 and got["r0500"]["chain_end"] == "cycle"


def test_empty(spark):
    assert run(spark, [], 10).count() == 0


def test_descendants(spark):
    rows = [(1, "t1_a", "t3_x", "t3_x", 0, None, "", ""), (2, "t1_b", "t1_a", "t3_x", 1, None, "", ""), (3, "t1_c", "t1_b", "t3_x", 2, None, "", "")]
    got = {(r["ancestor"], r["descendant"], r["distance"]) for r in descendants(run(spark, rows, 10)).collect()}
    assert got == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_partitioning_does_not_matter(spark):
    rows = made(9)
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for parts in (1, 7):
        nodes = latest_nodes(df.repartition(parts).orderBy(F.rand(parts)), "id", "parent_id", "thread_id", "fetched_at", "row_id", "depth")
        results.append(sorted(map(tuple, hierarchy(nodes, False, 30).collect()), key=str))
    assert results[0] == results[1]


def test_colouring_walks_without_recursion():
    n = 50_000
    root, depth, end, ring = walk_parents([f"x{i}" for i in range(n)], [None, *[f"x{i}" for i in range(n - 1)]], ["s"] * n)
    assert depth[-1] == n - 1 and root[-1] == 0 and end[-1] == "orphan" and not any(ring)


def test_rings_head_their_trees(spark, tmp_path):
    up = {"a": "b", "b": "c", "c": "a", "d": "b", "e": "d", "f": "e", "s": "s", "t": "s", "p": "x", "q": "p", "o": "gone"}
    rows = [(i, f"t1_{k}", f"t3_{v}" if v == "x" else f"t1_{v}", "t3_x", None, None, "", "") for i, (k, v) in enumerate(up.items())]
    expected = {}
    for k in up:
        at, far = up[k], 1
        while at in up and (at, k) not in expected and at != k:
            expected[at, k] = far
            at, far = up[at], far + 1
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "deep_comments.parquet"))
    pairs = problems.p5_descendants(spark, str(tmp_path)).collect()
    assert len(pairs) == len(expected) and {(r["ancestor_id"][3:], r["descendant_id"][3:]): r["distance"] for r in pairs} == expected
    got = {r["id"][3:]: r for r in problems.p5_hierarchy(spark, str(tmp_path)).collect()}
    assert {k: r["descendants"] for k, r in got.items()} == {k: sum(x == k for x, _ in expected) for k in up}
    assert got["f"]["path"] == "b/d/e/f" and got["a"]["path"] == "a" and got["q"]["path"] == "p/q" and got["f"]["real_depth"] == -1


@pytest.mark.parametrize("max_block", [10_000, 25, 0])
def test_descendants_are_counted_and_summed(spark, max_block):
    rows = made(5)
    chains = brute(rows)
    nodes = latest_nodes(spark.createDataFrame(rows, SCHEMA), "id", "parent_id", "thread_id", "fetched_at", "row_id", "depth")
    kept = {r["node"]: r["kept"] or 0 for r in nodes.collect()}
    below = dict.fromkeys(chains, 0)
    total = dict(kept)
    for node, (_, _, end, chain) in chains.items():
        for above in (chain or [])[:-1]:
            below[above] += 1
            total[above] += kept[node]
    got = {r["node"]: r for r in hierarchy(nodes, False, max_block, "kept").collect()}
    trees = {k for k, c in chains.items() if c[2] != "cycle"}
    assert {k: (got[k]["below"], got[k]["total"]) for k in trees} == {k: (below[k], total[k]) for k in trees}
    for k, c in chains.items():
        if c[2] == "cycle" and got[k]["on_ring"]:
            members = [x for x, y in chains.items() if y[2] == "cycle" and y[0] == c[0]]
            assert got[k]["below"] == len(members) - 1 and got[k]["total"] == sum(kept[x] for x in members)


@pytest.mark.parametrize("max_block", [10_000, 3])
def test_pairs_do_not_depend_on_the_block(spark, max_block):
    from evidra.operators.hierarchy import all_descendants

    nodes = latest_nodes(spark.createDataFrame(made(6), SCHEMA), "id", "parent_id", "thread_id", "fetched_at", "row_id", "depth")
    pairs = all_descendants(nodes, max_block).collect()
    counts = {}
    for r in pairs:
        counts[r["ancestor"]] = counts.get(r["ancestor"], 0) + 1
    assert len(pairs) == len({(r["scope"], r["ancestor"], r["descendant"]) for r in pairs})
    assert counts == {r["node"]: r["below"] for r in hierarchy(nodes).collect() if r["below"]}


def test_components_by_union():
    from evidra.operators.hierarchy import components

    assert components([-1, 0, 1, -2, 3, -1]) == [0, 0, 0, 3, 3, 5]
    assert components([1, 2, 0]) == [0, 0, 0] and components([]) == []


def test_doubling_keeps_no_growing_size_estimate_and_stops_early(spark, monkeypatch):
    """The estimate of a loop of joins doubled its digits each round, and a cycle kept the rounds going until the driver was full."""
    from evidra.operators import hierarchy as h

    rows = [(f"c{i}", f"c{i - 1}" if i else "x", "x", None, None) for i in range(100)] + [(f"r{i}", f"r{(i + 1) % 3}", "x", None, None) for i in range(3)]
    rows += [(f"x{i}", "x", "x", None, None) for i in range(4000)]
    nodes = spark.createDataFrame(rows, "node string, parent string, scope string, kept int, value long")
    rounds = []
    cut = h.cut
    monkeypatch.setattr(h, "cut", lambda df: rounds.append(1) or cut(df))
    for found in (h._labelled(nodes), h._double(nodes, False)):
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
        assert {r["node"]: r["root"] for r in found.collect()} == {n: "c0" if n[0] == "c" else "r0" if n[0] == "r" else n for n, *_ in rows}
        assert len(rounds) <= 11  # at most three more than the logarithm of the depth
        rounds.clear()
