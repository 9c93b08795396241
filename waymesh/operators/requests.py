"""Route requests: payloads to marker columns, nearest nodes, cached answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh import schemas
from waymesh.operators.cache import one_per_pair
from waymesh.operators.nearest import NodeIndex, index_nodes, nearest_node
from waymesh.runtime import store


def parse_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON payloads to ``lat1, lng1, lat2, lng2, node1, node2``; other columns stay.

    Accepts two markers (``lat`` with ``lng`` or ``lon``) or two node ids; what a
    payload lacks, or a payload that is no JSON, gives NULL. Works on batches and streams.
    """
    rest = [c for c in messages.columns if c != value]
    data = F.from_json(F.col(value).cast("string"), schemas.REQUEST_PAYLOAD)
    parsed = messages.select(*rest, data.alias("data"))

    def marker(i: int, *names: str):
        return F.coalesce(*[F.get(F.col("data.markers"), i).getField(n) for n in names])

    columns = [
        marker(0, "lat").alias("lat1"), marker(0, "lng", "lon").alias("lng1"),
        marker(1, "lat").alias("lat2"), marker(1, "lng", "lon").alias("lng2"),
        F.col("data.node1").alias("node1"), F.col("data.node2").alias("node2"),
    ]
    if "request_id" not in rest:
        columns.insert(0, F.col("data.request_id").alias("request_id"))
    return parsed.select(*rest, *columns)


def locate_requests(requests: DataFrame, nodes: DataFrame | NodeIndex) -> DataFrame:
    """Fill missing ``node1``/``node2`` with the nodes nearest to the markers."""
    index = nodes if isinstance(nodes, NodeIndex) else index_nodes(nodes)
    requests = store(requests).df  # parsed once, read by column several times below
    spots = reduce(DataFrame.unionByName, [
        requests.filter(f"node{i} IS NULL").select(F.col(f"lat{i}").alias("lat"), F.col(f"lng{i}").alias("lng"))
        for i in (1, 2)
    ]).distinct()
    found = nearest_node(spots, index, "lat", "lng", distance=None)
    out = requests
    for i in (1, 2):
        side = found.select(F.col("lat").alias(f"lat{i}"), F.col("lng").alias(f"lng{i}"), F.col("node").alias("near"))
        # rows without a marker stay out of the join: their NULL keys would all meet in one task
        lacking = F.col(f"node{i}").isNull() & F.col(f"lat{i}").isNotNull() & F.col(f"lng{i}").isNotNull()
        filled = out.filter(lacking).join(side, [f"lat{i}", f"lng{i}"], "left").withColumn(f"node{i}", F.col("near"))
        out = filled.select(*requests.columns).unionByName(out.filter(~lacking))
    return out.select(*requests.columns)


def answer_requests(requests: DataFrame, nodes: DataFrame | NodeIndex, cache: DataFrame) -> DataFrame:
    """Each located request with its cached path, or ``status = 'queued'``.

    ``status``: ``found``, ``queued`` (to be computed) or ``invalid`` (no two places).
    """
    placed = store(locate_requests(requests, nodes)).df
    # requests without two places stay out of the join: their NULL keys would all meet in one task
    located = F.col("node1").isNotNull() & F.col("node2").isNotNull()
    valid = placed.filter(located)
    known = one_per_pair(cache, valid)
    extra = [c for c in known.columns if c not in ("node1", "node2")]
    status = F.when(F.col("hit").isNotNull(), "found").otherwise("queued")
    answered = valid.join(known.withColumn("hit", F.lit(True)), ["node1", "node2"], "left").select(
        *requests.columns, *extra, status.alias("status")
    )
    invalid = placed.filter(~located).select(
        *requests.columns, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in extra], F.lit("invalid").alias("status")
    )
    return answered.unionByName(invalid)


def misses_of(answers: DataFrame) -> DataFrame:
    """Pairs to compute, each once."""
    return answers.filter("status = 'queued'").select("node1", "node2").distinct()
