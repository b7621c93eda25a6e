"""What walks write: no more than their results ask for."""

from metaloom.operators import traverse as T

from .test_traverse import TYPES, frames

EDGES = {"s": [(f"e{i}", "n0", f"n{i}", TYPES[0]) for i in range(1, 5)] + [("f", "n1", "n2", TYPES[2])]}


def written(monkeypatch, module):
    got = []

    def record(df, name, f=module.written):
        out = f(df, name)
        got.append((name, out))
        return out

    monkeypatch.setattr(module, "written", record)
    return got


def levels(got):
    return [df.dtypes for name, df in got if name == "level"]


def test_levels_of_walks_hold_no_names(spark, monkeypatch):
    g, seeds = frames(spark, EDGES)
    monkeypatch.setattr(T, "FEW", 0)
    for walk in (lambda: T.impact_many(g, seeds), lambda: T.impact_bounded(g, seeds, "both", 2, 3), lambda: T.filtered_traversal(g, seeds, "both", 2, 3)):
        got = written(monkeypatch, T)
        walk()
        assert levels(got) and not [c for of in levels(got) for c, kind in of if "string" in kind]


def test_levels_of_traces_hold_a_hop_once(spark, monkeypatch):
    g, seeds = frames(spark, EDGES)
    monkeypatch.setattr(T, "FEW", 0)
    got = written(monkeypatch, T)
    T.trace_bounded(g, seeds, "both", 2, 3)
    texts = {(c, kind) for of in levels(got) for c, kind in of if "string" in kind}
    assert texts == {("path", "array<struct<node:string,edge_type:string,out:boolean>>")}


def test_only_what_a_budget_fetches_becomes_rows(spark, monkeypatch):
    """Four nodes of a level lead back to a hub each; with 6 edges left the fifth and sixth are fetched, no more are listed."""
    edges = [(f"a{i}", "n0", f"n{i}", TYPES[3]) for i in range(1, 5)] + [(f"b{i}{k}", f"n{i}", f"n{5 + k}", TYPES[3]) for i in range(1, 5) for k in (0, 1)]
    g, seeds = frames(spark, {"s": edges})
    got = written(monkeypatch, T)
    hits = T.impact_bounded(g, seeds, "outbound", 2, 6).hits
    assert sorted((r.node_key, r.position) for r in hits.collect()) == [("n1", 1), ("n2", 2), ("n3", 3), ("n4", 4), ("n5", 5), ("n6", 6)]
    placed = [df for name, df in got if name == "level" and "before" in df.columns]
    assert [df.count() for df in placed] == [1, 2]


def test_few_seeds_walk_over_edges_near_them(spark, monkeypatch):
    far = [(f"x{i}", "n5", "n6", TYPES[0]) for i in range(9)]
    g, seeds = frames(spark, {"s": EDGES["s"] + far})
    got = written(monkeypatch, T)
    T.impact_bounded(g, seeds, "both", 2, 10)
    assert [df.count() for name, df in got if name == "edges"] == [5]
