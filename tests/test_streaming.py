import json

from waymesh.operators.requests import answer_requests, misses_of, parse_requests
from waymesh.sources.messages import read_requests
from waymesh.sources.paths import CACHE_SCHEMA, open_cache
from waymesh.streaming.requests import request_job, start

NODES = [(y * 5 + x, 46.0 + y * 0.01, -117.0 + x * 0.01) for y in range(5) for x in range(5)]
EDGES = [(a, b, 3 + (a + b) % 4) for a in range(25) for b in (a + 1, a - 1, a + 5, a - 5)
         if 0 <= b < 25 and (abs(a - b) == 5 or a // 5 == b // 5)] + [(30, 31, 1)]


def near(node, dlat=0.001, dlng=0.002):
    return {"lat": NODES[node][1] + dlat, "lng": NODES[node][2] + dlng}


def tables(spark):
    return (
        spark.createDataFrame(NODES + [(30, 60.0, 10.0), (31, 61.0, 10.0)], "id long, lat double, lon double"),
        spark.createDataFrame(EDGES, "u long, v long, cost_c long"),
    )


MESSAGES = [
    {"markers": [near(0), near(24)]}, {"node1": 3, "node2": 20}, {"markers": [near(0), near(24, 0.002)]},
    {"markers": [{"lat": 60.0, "lng": 10.0}, near(4)]}, {"nothing": 1},
]


def test_payloads(spark):
    lines = [json.dumps(m) for m in MESSAGES[:2]] + ["not json", '{"markers":[{"lat":1.5,"lon":2}]}']
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    got = [(r.lat1, r.lng2, r.node1, r.node2) for r in parse_requests(df).collect()]
    assert got == [(46.001, NODES[24][2] + 0.002, None, None), (None, None, 3, 20), (None, None, None, None), (1.5, None, None, None)]


def test_answers(spark):
    nodes, _ = tables(spark)
    df = spark.createDataFrame([(str(i), json.dumps(m)) for i, m in enumerate(MESSAGES)], "request_id string, value string")
    cache = spark.createDataFrame([(0, 24, 30, 8, [0, 24])], CACHE_SCHEMA)
    answers = answer_requests(parse_requests(df), nodes, cache)
    got = {r.request_id: (r.node1, r.node2, r.status, r.path) for r in answers.collect()}
    assert got == {
        "0": (0, 24, "found", [0, 24]), "2": (0, 24, "found", [0, 24]), "1": (3, 20, "queued", None),
        "3": (30, 4, "queued", None), "4": (None, None, "invalid", None),
    }
    assert sorted(map(tuple, misses_of(answers).collect())) == [(3, 20), (30, 4)]


def test_marker_stream_matches_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, m in enumerate(MESSAGES):
        (tmp_path / "in" / f"{i}.txt").write_text(json.dumps(m) + "\n")
    stream = parse_requests(read_requests(spark, "text", path=str(tmp_path / "in")))
    query = start(stream, "memory", name="markers", available_now=True)
    query.awaitTermination()
    batch = parse_requests(spark.read.text(str(tmp_path / "in")))
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(spark.table("markers").collect()) == key(batch.collect())


def test_request_job_computes_stores_and_resumes(spark, tmp_path):
    nodes, edges = tables(spark)
    folder, cache, out = tmp_path / "in", str(tmp_path / "cache"), str(tmp_path / "out")
    folder.mkdir()

    def send(name, *payloads):
        (folder / name).write_text("".join(json.dumps(p) + "\n" for p in payloads))

    def run():
        stream = read_requests(spark, "text", {"maxFilesPerTrigger": "1"}, str(folder))
        request_job(stream, nodes, edges, cache, out, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()

    send("a.txt", *MESSAGES)
    send("b.txt", MESSAGES[0], {"node1": 7, "node2": 7})
    run()
    stored = {(r.node1, r.node2): r for r in open_cache(spark, cache).collect()}
    assert set(stored) == {(0, 24), (3, 20), (7, 7)}
    assert stored[0, 24].path[0] == 0 and stored[0, 24].path[-1] == 24 and stored[0, 24].hops == len(stored[0, 24].path) - 1
    answers = spark.read.parquet(out)
    assert sorted(r.status for r in answers.collect()) == ["found"] * 5 + ["invalid", "unreachable"]
    send("c.txt", MESSAGES[1])
    run()
    assert open_cache(spark, cache).count() == 3
    assert spark.read.parquet(out).count() == 8
