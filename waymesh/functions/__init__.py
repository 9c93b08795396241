"""Column functions: everything here stays in the JVM and in code generation."""

from waymesh.functions.cleaning import (
    default_speed, first_class, is_oneway, parse_speed, travel_cost, weighted_dist,
)
from waymesh.functions.geo import (
    geo_distance, line_text, morton, parse_linestring, road_from_text, road_latlon,
)
from waymesh.functions.numeric import iterate_map, iterate_map_pandas
from waymesh.functions.text import edge_label, parse_id_list, project_tags, split_label, tag_map

__all__ = [
    "default_speed", "edge_label", "first_class", "geo_distance", "is_oneway", "iterate_map",
    "iterate_map_pandas", "line_text", "morton", "parse_id_list", "parse_linestring", "parse_speed",
    "project_tags", "road_from_text", "road_latlon", "split_label", "tag_map", "travel_cost",
    "weighted_dist",
]
