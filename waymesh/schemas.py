"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
]))

NODES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

EDGES = T.StructType([
    T.StructField("u", T.LongType()),
    T.StructField("v", T.LongType()),
    T.StructField("way_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("highway", T.StringType()),
    T.StructField("oneway", T.BooleanType()),
    T.StructField("length_m", T.DoubleType()),
    T.StructField("speed", T.IntegerType()),
    T.StructField("cost_c", T.LongType()),
    T.StructField("road", POINTS),
])

PATHS = T.StructType([
    T.StructField("path_id", T.StringType()),
    T.StructField("node1", T.LongType()),
    T.StructField("node2", T.LongType()),
    T.StructField("cost_c", T.LongType()),
    T.StructField("hops", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.LongType())),
])

EDGE_CENTRALITY = T.StructType([
    T.StructField("u", T.LongType()),
    T.StructField("v", T.LongType()),
    T.StructField("uses", T.LongType()),
    T.StructField("centrality", T.DoubleType()),
])

#: First version of the CSV files: cost is speed times miles, one row per segment.
NODES_CSV_V1 = T.StructType([
    T.StructField("osmid", T.LongType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])
EDGES_CSV_V1 = T.StructType([
    T.StructField("osmid_x", T.LongType()),
    T.StructField("x", T.LongType()),
    T.StructField("y", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("weighted_dist", T.DoubleType()),
    T.StructField("oneway", T.StringType()),
    T.StructField("highway", T.StringType()),
])
#: Second version: cost is length over speed, geometry as text.
NODES_CSV_V2 = T.StructType([
    T.StructField("osmid", T.LongType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
])
EDGES_CSV_V2 = T.StructType([
    T.StructField("u", T.LongType()),
    T.StructField("v", T.LongType()),
    T.StructField("oneway", T.StringType()),
    T.StructField("weighted_distance", T.DoubleType()),
    T.StructField("road", T.StringType()),
])

_TAGS = T.ArrayType(T.StructType([
    T.StructField("_k", T.StringType()),
    T.StructField("_v", T.StringType()),
]))
OSM_NODE = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("_lat", T.DoubleType()),
    T.StructField("_lon", T.DoubleType()),
    T.StructField("tag", _TAGS),
])
OSM_WAY = T.StructType([
    T.StructField("_id", T.LongType()),
    T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))),
    T.StructField("tag", _TAGS),
])

#: Both payload shapes of a route request: two markers, or two node ids.
REQUEST_PAYLOAD = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("markers", T.ArrayType(T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]))),
    T.StructField("node1", T.LongType()),
    T.StructField("node2", T.LongType()),
])

PATH_EXPORT = T.MapType(T.StringType(), T.StructType([
    T.StructField("x", T.LongType()),
    T.StructField("y", T.LongType()),
    T.StructField("path", T.ArrayType(T.LongType())),
]))
