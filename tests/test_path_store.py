import glob
import json

import pytest

from tests.test_streaming import MESSAGES, tables
from waymesh.operators.nearest import index_nodes
from waymesh.operators.requests import parse_requests
from waymesh.operators.tiles import tile_edges
from waymesh.sources.path_store import PathStore
from waymesh.sources.paths import CACHE_SCHEMA
from waymesh.streaming import requests as job


def rows(df):
    return sorted((r.node1, r.node2, r.cost_c, r.hops, r.path) for r in df.collect())


def entries(spark, *pairs):
    return spark.createDataFrame([(a, b, c, 1, [a, b]) for a, b, c in pairs], CACHE_SCHEMA)


def test_loads_repeat_break_off_and_compact(spark, tmp_path):
    paths = PathStore(spark, str(tmp_path / "s"), buckets=8)
    assert paths.loads() == [] and rows(paths.read()) == [] and paths.compact() is None
    asked = spark.createDataFrame([(1, 2), (5, 6), (5, 6)], "node1 long, node2 long")
    for _ in range(2):  # a repeated batch writes over itself
        paths.append(entries(spark, (1, 2, 9), (3, 4, 7)), "a", asked=asked)
    want = [(1, 2, 9, 1, [1, 2]), (3, 4, 7, 1, [3, 4]), (5, 6, None, None, None)]
    key = lambda r: (r[0], r[1])
    assert sorted(rows(paths.read().filter("path is not null"))) == want[:2]
    assert rows(paths.lookup(asked)) == [want[0], want[2]]
    # a load that broke off has no mark and does not count
    paths.append(entries(spark, (7, 8, 1)), "broken")
    (tmp_path / "s" / "load=broken" / "_SUCCESS").unlink()
    assert paths.loads() == ["a"]
    # found later, and cheaper
    paths.append(entries(spark, (5, 6, 4), (1, 2, 3)), "b")
    # a note that is not whole replaces nothing
    (tmp_path / "s" / "notes" / ".gen-x" / "a").mkdir(parents=True)
    assert paths.loads() == ["a", "b"]
    name = paths.compact()
    assert paths.loads() == [name]
    after = [(1, 2, 3, 1, [1, 2]), (3, 4, 7, 1, [3, 4]), (5, 6, 4, 1, [5, 6])]
    assert sorted(rows(paths.read()), key=key) == after
    assert not paths.append(entries(spark, (1, 2, 1)), "a")  # the generation holds this batch already
    paths.append(entries(spark, (9, 9, 0)), "c")
    paths.compact()
    assert not paths.append(entries(spark, (1, 2, 1)), "a") and not paths.append(entries(spark, (1, 2, 1)), "c")
    assert sorted(rows(paths.read()), key=key) == [*after, (9, 9, 0, 1, [9, 9])]
    assert len(glob.glob(str(tmp_path / "s" / "load=gen-*"))) == 1
    with pytest.raises(ValueError):
        PathStore(spark, str(tmp_path / "s"), buckets=9)


def test_lookup_reads_the_asked_buckets_only(spark, tmp_path):
    paths = PathStore(spark, str(tmp_path / "s"), buckets=16)
    paths.append(entries(spark, *[(i, i + 1, i) for i in range(400)]), "a")
    asked = spark.createDataFrame([(7, 8)], "node1 long, node2 long")
    found = paths.lookup(asked)
    assert rows(found) == [(7, 8, 7, 1, [7, 8])]
    chosen = [r[0] for r in asked.select(paths._bucket()).collect()]
    plan = paths.read(chosen)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_no_pair_is_searched_twice(spark, tmp_path, monkeypatch):
    nodes, edges = tables(spark)
    searched = []
    real = job.shortest_paths
    monkeypatch.setattr(job, "shortest_paths", lambda e, p: searched.extend(sorted(map(tuple, p.collect()))) or real(e, p))
    paths = PathStore(spark, str(tmp_path / "s"), buckets=4)
    lines = spark.createDataFrame([(str(i), json.dumps(m)) for i, m in enumerate(MESSAGES)], "request_id string, value string")
    index, tiles = index_nodes(nodes), tile_edges(edges, nodes)
    seen = []
    for load in ("0", "0", "1"):
        answers = job.answer_batch(parse_requests(lines), index, tiles, paths, load)
        seen.append(sorted((r.request_id, r.node1, r.node2, r.status, r.cost_c, r.path) for r in answers.collect()))
    assert seen[0] == seen[1] == seen[2]
    assert [r[3] for r in seen[0]] == ["found", "found", "found", "unreachable", "invalid"]
    assert searched == [(0, 24), (3, 20), (30, 4)]
    assert len(rows(paths.read().filter("path is not null"))) == 2 and paths.read().count() == 3
