"""Components and reachability against runs from each node."""

import random

from lodestone.operators import components


def brute(edges):
    """name -> nodes reached by at least one edge, and name -> component."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reached = {}
    for n in out:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reached[n] = seen
    return reached, {n: min([n, *(m for m in reached[n] if n in reached[m])]) for n in out}


def graph(seed):
    rnd = random.Random(seed)
    ring = [(f"r{i:02}", f"r{(i + 1) % 6:02}") for i in range(6)]
    loose = [(f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}") for _ in range(38)]
    return [*ring, *loose, *loose[:5], ("r03", "n01"), ("n02", "a0"), ("a0", "a1"), ("a1", "a2"), ("self", "self"), ("x", "self"), ("b0", "b1"), ("b1", "b0"), ("b1", "r00")]


def test_components_and_reach(spark):
    edges = graph(1)
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "src string, dst string").selectExpr("*", "'q' AS name", "1 AS component")
    reached, component = brute(edges)
    members = {r["name"]: r["component"] for r in components.strong_components(df).collect()}
    assert members == component and len(set(component.values())) < len(component)
    held = spark.createDataFrame(list(members.items()), "name string, component string")
    pairs = [(r["component"], r["reached"]) for r in components.reach(df, held).collect()]
    assert len(pairs) == len(set(pairs))
    of = {}
    for n, c in members.items():
        of.setdefault(c, set()).add(n)
    assert {(a, b) for x, y in pairs for a in of[x] for b in of[y]} == {(a, b) for a in reached for b in reached[a]}
    got = {r["name"]: r["affected"] for r in components.affected_exactly(df, held).collect()}
    assert got == {n: sum(n in s for s in reached.values()) for n in reached}


def test_ends_stay_out_of_the_rounds(spark, monkeypatch):
    """Nodes that lead nowhere on, most of a call graph, take no part in the rounds; edges are read once."""
    seen, plain = [], components._closed
    monkeypatch.setattr(components, "_closed", lambda on: seen.extend(on.collect()) or plain(on))
    edges = [("r", "m1"), ("r", "m2"), ("m1", "m2"), ("m2", "m1"), *((m, f"leaf{i}") for i in range(50) for m in ("m1", "m2", "r")), ("m1", "loop"), ("loop", "loop")]
    df = spark.createDataFrame([*edges, (None, "m1"), *edges[:9]], "src string, dst string")
    reached, component = brute(edges)
    got = {r["name"]: (r["component"], r["affected"]) for r in components.affected_exactly(df).collect()}
    assert got == {n: (component[n], sum(n in s for s in reached.values())) for n in reached}
    assert [tuple(r) for r in seen] == [("r", "m1")]
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(20)], "src string, dst string")
    assert {r["name"]: r["affected"] for r in components.affected_exactly(chain).collect()} == {f"c{i:02}": i for i in range(21)}


def test_no_edges(spark):
    df = spark.createDataFrame([], "src string, dst string")
    assert components.strong_components(df).count() == 0 == components.affected_exactly(df).count()
