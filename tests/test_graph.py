"""Connected components: few links shuffle nothing, many do, and both find the same."""

from __future__ import annotations

import random

from siftline.operators import graph


def test_few_links_take_one_partition_and_many_find_the_same(spark, monkeypatch):
    draw = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(60)] + [(1, 1), (None, 2), (500, 501), (501, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    expected = sorted((x, find(x)) for x in root)
    frame = spark.createDataFrame(links, "a long, b long")
    few = graph.connected_components(frame)
    assert sorted(map(tuple, few.collect())) == expected
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    edges = graph.durable(frame.where("a > b").select("b", "a").toDF("a", "b")).coalesce(1)
    for large in (True, False):
        assert "Exchange" not in graph._star(edges, large, 16, 1)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(graph, "LINKS", 20)
    assert sorted(map(tuple, graph.connected_components(frame).collect())) == expected
    assert graph.connected_components(frame.where("a is null")).count() == 0


def test_links_to_several_others_shrink_before_they_are_doubled(spark, monkeypatch):
    """Nodes tied to 40 others each, as keys tie the classes of a large group: no star that looks both ways takes them all."""
    links = [(1000 + k, j) for k in range(60) for j in range(40) if (k + j) % 3]
    star, taken = graph._star, []

    def counted(edges, large, ways, parts):
        if large:
            taken.append(edges.count())
        out = star(edges, large, ways, parts)
        assert parts == 1 or "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(graph, "_star", counted)
    for most in (50_000, 300):
        monkeypatch.setattr(graph, "LINKS", most)
        got = graph.connected_components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == [(k, 0) for k in [*range(40), *range(1000, 1060)]]
    assert max(taken) <= 200
