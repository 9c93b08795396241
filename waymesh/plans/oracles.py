"""The same queries as single DuckDB statements over the test tables.

Every statement builds what it needs from common table expressions; nothing here is
used by the library itself.
"""

from __future__ import annotations

import re

# name -> (tables it builds on, body)
_TABLES: dict[str, str] = {
    "r_nodes": """
        select p_partkey as id, p_partkey % 100 as gx, p_partkey // 100 as gy,
               46.0::double + (p_partkey // 100) * 0.01::double as lat,
               -118.0::double + (p_partkey % 100) * 0.01::double as lon, p_type, p_size
        from part""",
    "r_raw": """
        select a.id as u, b.id as v, a.id % 9 = 0 as oneway,
               case when a.p_size % 7 = 0 then [lower(a.p_type), 'standard'] else [lower(a.p_type)] end as highway,
               case a.p_size % 5 when 0 then null when 1 then ['signals'] when 2 then ['25 mph', '36 mph']
                    else [(20 + a.p_size) || ' mph'] end as maxspeed,
               100.0::double + a.p_size * 10 as length_m,
               a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2, a.p_size
        from r_nodes a cross join (values (1), (100)) k(step) join r_nodes b
          on b.id = a.id + k.step and (k.step = 100 or a.gx < 99)""",
    "r_speed": """
        select *, highway[1] as hw,
               case when maxspeed is null or list_contains(list_transform(maxspeed,
                         lambda x: try_cast(split_part(x, ' ', 1) as int) is null), true) then null
                    else nullif(trunc(list_avg(list_transform(maxspeed,
                         lambda x: try_cast(split_part(x, ' ', 1) as int))))::int, 0) end as speed
        from r_raw""",
    "r_class": "select hw as h, trunc(avg(speed))::int as cls from r_speed where speed is not null group by 1",
    "r_clean": """
        select u, v, oneway, hw, length_m, coalesce(speed, cls) as speed,
               greatest(1, floor(length_m * 100 / coalesce(speed, cls) + 0.5)::bigint) as cost_c,
               maxspeed, lon1, lat1, lon2, lat2
        from r_speed left join r_class on h = hw""",
    "r_edges": """
        select u, v, oneway, cost_c, lon1, lat1, lon2, lat2 from r_clean
        union all
        select v, u, oneway, cost_c, lon2, lat2, lon1, lat1 from r_clean where not oneway""",
    "r_parallel": """
        select u, v, cost_c from r_edges
        union all select u, v, cost_c + 5 from r_edges where u % 4 = 0""",
    "r_cut": """
        select u, v from r_edges
        where not (abs(u - v) = 1 and least(u, v) % 100 in (9, 29, 59))""",
    "r_central": "select u, v, cost_c, ((u * 37 + v) % 1000) / 1000.0::double as centrality from r_edges",
    "r_middle": """
        select min(lat) + (max(lat) - min(lat)) / 4 as s, max(lat) - (max(lat) - min(lat)) / 4 as n,
               min(lon) + (max(lon) - min(lon)) / 4 as w, max(lon) - (max(lon) - min(lon)) / 4 as e
        from r_nodes""",
    "r_window": """
        select c.u, c.v, c.centrality from r_central c join r_nodes a on a.id = c.u join r_nodes b on b.id = c.v, r_middle m
        where a.lat between m.s and m.n and a.lon between m.w and m.e
          and b.lat between m.s and m.n and b.lon between m.w and m.e""",
    "r_ranked": """
        select centrality as c, row_number() over (order by centrality) - 1 as i, count(*) over () as n from r_window""",
    "r_q3": """
        select avg(c) as q3 from r_ranked where
          case when n = 1 then i = 0
               when (n // 2) % 2 = 1 then i = n - n // 2 + (n // 2) // 2
               else i in (n - n // 2 + (n // 2) // 2 - 1, n - n // 2 + (n // 2) // 2) end""",
    "p_steps": """
        select user_id * 100 + day(ts) as path_id, floor(value)::bigint % 25 as node,
               row_number() over (partition by user_id, day(ts) order by ts, event_id) - 1 as pos
        from events""",
    "p_edges": """
        select path_id, pos, node, lead(node) over (partition by path_id order by pos) as next_node from p_steps""",
    "p_uses": """
        select node as u, next_node as v, count(*) as uses,
               count(*) / (select count(distinct path_id) from p_steps)::double as centrality
        from p_edges where next_node is not null group by 1, 2""",
    "p_paths": """
        select path_id, list(node order by pos) as path from p_steps group by 1""",
    "p_path_text": """
        select path_id, path[1] as node1, path[-1] as node2, array_to_string(path, '>') as path from p_paths""",
    "q_base": """
        select event_id as e, (select max(p_partkey) // 100 + 1 from part) as n from events""",
    "q_cells": """
        select e, (e * 7 + e // 100) % n as y1, (e * 13 + e // 10) % 100 as x1,
               (e * 5 + e // 20 + 3) % n as y2, (e * 11 + e // 7 + 1) % 100 as x2 from q_base""",
    "q_requests": """
        select e as request_id, 46.003::double + y1 * 0.01::double as lat1, -117.996::double + x1 * 0.01::double as lng1,
               46.003::double + y2 * 0.01::double as lat2, -117.996::double + x2 * 0.01::double as lng2,
               y1 * 100 + x1 as node1, y2 * 100 + x2 as node2 from q_cells""",
    "q_cache": """
        select q.node1, q.node2, abs(q.node1 - q.node2) + 1 as cost_c, 1::int as hops, q.node1 || '>' || q.node2 as path
        from (select distinct node1, node2 from q_requests) q join r_nodes n on n.id = q.node1 where n.p_size <= 25""",
    "q_spots": "select distinct lat1 as lat, lng1 as lng from q_requests",
    "q_near": """
        select lat, lng, id, {haversine:lat,lng,nlat,nlon} as dist from q_spots,
          (select id, lat as nlat, lon as nlon from r_nodes)
        qualify row_number() over (partition by lat, lng order by dist, id) = 1""",
    "s_sample": "select id, md5('w:' || id) as draw from r_nodes order by draw, id limit 5",
    "d": """
        select id, id, 0::bigint, 0::bigint from s_sample
        union
        select s, v, k // 1000000, k % 1000000 from (
          select d.s, b.v, min((d.c + b.cost_c) * 1000000 + d.h + 1) as k
          from d join r_edges b on d.n = b.u left join recurring.d r on r.s = d.s and r.n = b.v
          where (d.c + b.cost_c) * 1000000 + d.h + 1 < coalesce(r.c * 1000000 + r.h, 9223372036854775807)
          group by 1, 2)""",
    "d_tree": """
        select a.s, a.n, a.c, a.h, min(b.n) as prev
        from d a left join (select d.s, d.n, d.c, d.h, e.v, e.cost_c from d join r_edges e on e.u = d.n) b
          on a.n <> a.s and b.s = a.s and b.v = a.n and b.c + b.cost_c = a.c and b.h + 1 = a.h
        group by 1, 2, 3, 4""",
    "d_walk": """
        select t.s, t.n as t, t.n as here, t.h as pos, t.prev from d_tree t join s_sample x on x.id = t.n where t.n <> t.s
        union all
        select w.s, w.t, t.n, t.h, t.prev from d_walk w join d_tree t on t.s = w.s and t.n = w.prev""",
    "d_paths": """
        select w.s as node1, w.t as node2, max(t.c) as cost_c, max(t.h)::int as hops, string_agg(w.here, '>' order by w.pos) as path
        from d_walk w join d_tree t on t.s = w.s and t.n = w.t group by 1, 2""",
    "d_uses": """
        select u, v, count(*) / (select count(*) from d_paths)::double as centrality
        from (select prev as u, here as v from d_walk where prev is not null) group by 1, 2""",
    "c_links": """
        select u, v from r_cut union all select v, u from r_cut union all select id, id from r_nodes""",
    "c": """
        select id, id from r_nodes
        union
        select l.v, min(c.m) from c join c_links l on l.u = c.n join recurring.c r on r.n = l.v
        where c.m < r.m group by 1""",
    "t_nodes": """
        select id, lat, lon from r_nodes
        union all select id + 1000000, lat + 0.0001::double, lon from r_nodes where id % 10 = 0""",
    "t_edges": """
        select u, v, cost_c from r_edges
        union all select id, id + 1000000, 1 from r_nodes where id % 10 = 0""",
    "t_links": """
        select a.id as u, b.id as v from (select *, unnest(range((lat * 500)::bigint - 2, (lat * 500)::bigint + 3)) as k from t_nodes) a
        join (select *, (lat * 500)::bigint as k from t_nodes) b using (k)
        where abs(a.lon - b.lon) < 0.002 and {haversine:a.lat,a.lon,b.lat,b.lon} <= 80""",
    "t": """
        select id, id from t_nodes
        union
        select l.v, min(t.m) from t join t_links l on l.u = t.n join recurring.t r on r.n = l.v
        where t.m < r.m group by 1""",
    "x_half": """
        select c.u, c.v, c.length_m, c.cost_c, c.hw, coalesce(c.maxspeed[1], 'none') as ms from r_clean c
        where c.v = c.u + 1 or c.u in (select id from r_nodes where p_size <= 5)""",
    "x_edges": "select * from x_half union all select v, u, length_m, cost_c, hw, ms from x_half",
    "x_pass": "select u as id from x_edges group by 1 having count(*) = 2",
    "x_walk": """
        select u as a, v as b, u as last, v as cur, length_m, cost_c, 1 as pieces, [hw] as hws, [ms] as mss
        from x_edges where u not in (select id from x_pass)
        union all
        select w.a, w.b, e.u, e.v, w.length_m + e.length_m, w.cost_c + e.cost_c, w.pieces + 1,
               list_append(w.hws, e.hw), list_append(w.mss, e.ms)
        from x_walk w join x_edges e on e.u = w.cur and e.v <> w.last
        where w.cur in (select id from x_pass)""",
    "o_raw": """
        select u, v, u * 1000 + v - u as way_id, oneway, lon1, lat1, lon2, lat2, p_size,
               ['tertiary', 'service', 'residential', 'secondary', 'primary', 'trunk', 'unclassified'][p_size % 7 + 1] as hw, speed
        from r_speed
        where not (v = u + 1 and u % 100 in (9, 29, 59))""",
    "o_drive": "select * from o_raw where hw <> 'service'",
    "o_class": "select hw as h, trunc(avg(speed))::int as cls from o_drive where speed is not null group by 1",
    "o_clean": "select *, coalesce(speed, cls) as used from o_drive left join o_class on h = hw",
    "o_links": "select u, v from o_clean union all select v, u from o_clean union all select u, u from o_clean union all select v, v from o_clean",
    "o": """
        select u, u from o_links group by 1
        union
        select l.v, min(o.m) from o join o_links l on l.u = o.n join recurring.o r on r.n = l.v
        where o.m < r.m group by 1""",
}

# roads as ways of many nodes, walked from junction to junction
_TABLES |= {
    "y_seg": """
        select way_id, row_number() over (partition by way_id order by u) - 1 as pos, u, v from (
          select a.gy * 100 + a.gx // 8 as way_id, a.id as u, b.id as v from r_nodes a join r_nodes b on b.id = a.id + 1 where a.gx < 99
          union all select a.id + 1000000, a.id, b.id from r_nodes a join r_nodes b on b.id = a.id + 100 where a.p_size <= 5)""",
    "y_raw": """
        select s.u, s.v, way_id, way_id % 4 = 0 as oneway, {haversine:a.lat,a.lon,b.lat,b.lon} as length_m, a.lon as lon1, a.lat as lat1, b.lon as lon2, b.lat as lat2,
               ['tertiary', 'service', 'residential', 'secondary', 'primary', 'trunk', 'unclassified'][way_id % 7 + 1] as hw,
               case when way_id % 5 = 0 then []::varchar[] when way_id % 5 = 1 then ['signals'] when way_id % 5 = 2 then ['25 mph', '36 mph']
                    else [(way_id % 40 + 20) || ' mph'] end as ms,
               case when way_id % 3 <> 0 then 'Road ' || way_id % 10 end as name
        from y_seg s join r_nodes a on a.id = s.u join r_nodes b on b.id = s.v""",
    "y_edges": """
        select u, v, way_id, oneway, length_m, lon2, lat2, hw, ms, name from y_raw where hw <> 'service'
        union all select v, u, way_id, oneway, length_m, lon1, lat1, hw, ms, name from y_raw where hw <> 'service' and not oneway""",
    "y_pass": """
        select id from (
          select id, other, sum(o) as outs, sum(1 - o) as ins from (
            select u as id, v as other, 1 as o from y_edges union all select v, u, 0 from y_edges) group by 1, 2)
        group by 1 having count(*) = 2 and sum(outs) = sum(ins) and max(outs) = 1""",
    "y_walk": """
        select u as a, u as last, v as cur, length_m, oneway, 1::bigint as pieces, lon2, lat2, [hw] as hws, ms as mss, [way_id] as ways, [name] as names
        from y_edges where u not in (select id from y_pass)
        union all
        select w.a, e.u, e.v, w.length_m + e.length_m, w.oneway, w.pieces + 1, w.lon2, w.lat2,
               list_append(w.hws, e.hw), list_concat(w.mss, e.ms), list_append(w.ways, e.way_id), list_append(w.names, e.name)
        from y_walk w join y_edges e on e.u = w.cur and e.v <> w.last
        where w.cur in (select id from y_pass)""",
    "y_roads": """
        select a as u, cur as v, length_m, oneway, pieces, lon2, lat2, list_sort(list_distinct(hws)) as hws, list_sort(list_distinct(mss)) as mss,
               array_to_string(list_transform(list_filter(range(1, len(ways) + 1), lambda i: i = 1 or ways[i] <> ways[i - 1]), lambda i: ways[i]), '>') as way_ids,
               array_to_string(list_transform(list_filter(range(1, len(names) + 1),
                 lambda i: names[i] is not null and (i = 1 or names[i] is distinct from names[i - 1])), lambda i: names[i]), '>') as names
        from y_walk where cur not in (select id from y_pass)""",
    "y_speed": """
        select *, hws[1] as hw,
               case when len(mss) = 0 or list_contains(list_transform(mss, lambda x: try_cast(split_part(x, ' ', 1) as int) is null), true) then null
                    else nullif(trunc(list_avg(list_transform(mss, lambda x: try_cast(split_part(x, ' ', 1) as int))))::int, 0) end as speed
        from y_roads""",
    "y_class": "select hw as h, trunc(avg(speed))::int as cls from y_speed where speed is not null group by 1",
    "y_priced": "select *, coalesce(speed, cls) as used from y_speed left join y_class on h = hw",
    "y_links": "select u, v from y_priced union all select v, u from y_priced union all select u, u from y_priced union all select v, v from y_priced",
    "y": """
        select u, u from y_links group by 1
        union
        select l.v, min(y.m) from y join y_links l on l.u = y.n join recurring.y r on r.n = l.v
        where y.m < r.m group by 1""",
}

# shortest paths of all pairs inside the map window, source by source: distances, then numbers of paths forward
# and what depends on a node backward, both hop by hop along the edges some shortest path uses
_TABLES |= {
    "w_sub": """
        select least(u, v) as u, greatest(u, v) as v, min(cost_c) as cost_c
        from r_edges join r_nodes a on a.id = u join r_nodes b on b.id = v, r_middle m
        where a.lat between m.s and m.n and a.lon between m.w and m.e
          and b.lat between m.s and m.n and b.lon between m.w and m.e group by 1, 2""",
    "w_edges": "select u, v, cost_c from w_sub union all select v, u, cost_c from w_sub",
    "w_nodes": "select distinct u as id from w_edges",
    "w_size": "select count(*) as n from w_nodes",
    "w_d": """
        select id, id, 0::bigint, 0::bigint from w_nodes
        union
        select s, v, k // 1000000, k % 1000000 from (
          select d.s, b.v, min((d.c + b.cost_c) * 1000000 + d.h + 1) as k
          from w_d d join w_edges b on d.n = b.u left join recurring.w_d r on r.s = d.s and r.n = b.v
          where (d.c + b.cost_c) * 1000000 + d.h + 1 < coalesce(r.c * 1000000 + r.h, 9223372036854775807)
          group by 1, 2)""",
    "w_tight": """
        select a.s, e.u, e.v from w_d a join w_edges e on e.u = a.n join w_d b on b.s = a.s and b.n = e.v
        where a.c + e.cost_c = b.c""",
    "w_p": """
        select id, id, 1.0::double, 0 from w_nodes
        union all
        select p.s, t.v, sum(p.k), max(p.h) + 1 from w_p p join w_tight t on t.s = p.s and t.u = p.n group by 1, 2""",
    "w_paths": "select s, n, sum(k) as k from w_p group by 1, 2",
    "w_share": """
        select t.s, t.u, t.v, a.k / b.k as f from w_tight t
        join w_paths a on a.s = t.s and a.n = t.u join w_paths b on b.s = t.s and b.n = t.v""",
    "w_x": """
        select s, n, 1.0::double, 0 from w_d where s <> n
        union all
        select x.s, t.u, sum(x.x * t.f), max(x.r) + 1 from w_x x join w_share t on t.s = x.s and t.v = x.n group by 1, 2""",
    "w_tree": """
        select b.s, b.n, min(e.u) as prev from w_d b join w_edges e on e.v = b.n join w_d a on a.s = b.s and a.n = e.u
        where b.n <> b.s and a.c + e.cost_c = b.c and a.h + 1 = b.h group by 1, 2""",
    "w_walk": """
        select s, n, prev from w_tree
        union all
        select w.s, t.n, t.prev from w_walk w join w_tree t on t.s = w.s and t.n = w.prev""",
    "w_last": "select s, arg_max(c, n) as far from w_d group by 1 having max(n) <> s",
}

_HEADS = {
    "w_d": "w_d(s, n, c, h) using key (s, n)", "w_p": "w_p(s, n, k, h)", "w_x": "w_x(s, n, x, r)", "w_walk": "w_walk(s, n, prev)",
    "d": "d(s, n, c, h) using key (s, n)", "d_walk": "d_walk(s, t, here, pos, prev)",
    "c": "c(n, m) using key (n)", "t": "t(n, m) using key (n)", "o": "o(n, m) using key (n)", "x_walk": "x_walk",
    "y": "y(n, m) using key (n)", "y_walk": "y_walk",
}

_QUERIES: dict[str, str] = {
    "path_edge_betweenness": "select u, v, uses, centrality from p_uses",
    "path_edge_label": "select '(' || u || ',' || v || ')' as edge, uses, u, v from p_uses",
    "path_steps": """
        select path_id, pos::int as pos, node as u, next_node as v from (
          select path_id, pos, node, lead(node) over (partition by path_id order by pos) as next_node
          from p_steps) where next_node is not null""",
    "class_speed_mean": "select h as highway, cls as class_speed from r_class",
    "clean_edges": "select u, v, oneway, hw as highway, length_m, speed, cost_c from r_clean",
    "default_speed_cost": """
        select x, y, highway, mph, floor(metres + 0.5)::bigint as metres,
               floor(mph * (metres / 1609.344::double) * 100 + 0.5)::bigint as weighted_c from (
          select u as x, v as y, hw as highway, {haversine:lat1,lon1,lat2,lon2} as metres,
                 coalesce(try_cast(trim(maxspeed[1], 'mph') as double), case hw when 'tertiary' then 30.0
                   when 'service' then 20.0 when 'residential' then 20.0 when 'secondary' then 25.0 when 'primary' then 60.0
                   when 'trunk' then 60.0 end, 0.0)::double as mph
          from (select *, ['tertiary', 'service', 'residential', 'secondary', 'primary', 'trunk', 'unclassified'][p_size % 7 + 1] as hw
                from r_raw)) where mph <> 0""",
    "linestring_points": "select u, v, 2::int as points, lon1, lat1, lon2, lat2 from r_raw",
    "road_points_latlon": """
        select u, v, 0::int as pos, lat1 as lat, lon1 as lon from r_edges
        union all select u, v, 1::int, lat2, lon2 from r_edges""",
    "way_segments": "select way_id, pos::int as pos, u as x, v as y from y_seg",
    "directed_edges": "select u, v, oneway, cost_c from r_edges",
    "one_way_edges": "select u, v, cost_c from r_clean where oneway",
    "node_count": "select count(*) as nodes from part",
    "referenced_nodes": "select u as id from r_clean where oneway union select v from r_clean where oneway",
    "edges_with_endpoints": """
        select u, v, cost_c from r_edges where u in (select id from r_nodes where p_size > 10)
          and v in (select id from r_nodes where p_size > 10)""",
    "merge_nodes": "select id, lat, lon from r_nodes",
    "simple_edges": "select least(u, v) as u, greatest(u, v) as v, min(cost_c) as cost_c from r_parallel group by 1, 2",
    "neighbors": """
        select distinct u as id, v as next, cost_c from r_parallel""",
    "node_sample": "select id, draw from s_sample",
    "sample_pairs": "select a.id as node1, b.id as node2 from s_sample a, s_sample b where a.id <> b.id",
    "bbox_subgraph": """
        select least(u, v) as u, greatest(u, v) as v, min(cost_c) as cost_c
        from r_edges join r_nodes a on a.id = u join r_nodes b on b.id = v,
             (select *, {haversine:s,w,n,e} / (111045 * 2) as g from r_middle) m
        where a.lat between s - g and n + g and a.lon between w - g and e + g
          and b.lat between s - g and n + g and b.lon between w - g and e + g group by 1, 2""",
    "edges_in_box": """
        select u, v, cost_c from r_edges join r_nodes a on a.id = u join r_nodes b on b.id = v, r_middle
        where a.lat between s and n and a.lon between w and e and b.lat between s and n and b.lon between w and e""",
    "nearest_node_batch": """
        select request_id, id as node, floor(dist + 0.5)::bigint as metres
        from q_requests join q_near on lat = lat1 and lng = lng1""",
    "nearest_node_single": """
        select id, floor(dist + 0.5)::bigint as metres from (
          select id, {haversine:lat,lon,46.218040530022094::double,-117.88330078125001::double} as dist from r_nodes)
        order by dist, id limit 1""",
    "parse_requests": """
        select request_id, case when marked then lat1 end as lat1, case when marked then lng1 end as lng1,
               case when marked then lat2 end as lat2, case when marked then lng2 end as lng2,
               case when not marked then node1 end as node1, case when not marked then node2 end as node2
        from (select *, request_id % 3 <> 0 as marked from q_requests)""",
    "answer_requests": """
        select request_id, q.node1, q.node2, cost_c, hops, case when cost_c is null then 'queued' else 'found' end as status
        from (select request_id, case when request_id % 3 = 0 then node1 else a.id end as node1,
                     case when request_id % 3 = 0 then node2 else b.id end as node2
              from q_requests left join q_spot_nodes a on a.lat = lat1 and a.lng = lng1
                left join q_spot_nodes b on b.lat = lat2 and b.lng = lng2) q
          left join q_cache c on c.node1 = q.node1 and c.node2 = q.node2""",
    "queued_messages": """
        select distinct '{{"node1":' || q.node1 || ',"node2":' || q.node2 || '}}' as value
        from q_requests q left join q_cache c on c.node1 = q.node1 and c.node2 = q.node2 where c.node1 is null""",
    "sssp_sample": "select s as source, n as node, c as cost_c, h::int as hops, prev from d_tree",
    "shortest_paths_sample": "select node1, node2, cost_c, hops, path from d_paths",
    "route_pairs": "select node1, node2, cost_c, hops, path from d_paths",
    "publish_importance": """
        select e.u, e.v, e.cost_c, d.centrality from r_edges e left join d_uses d on d.u = e.u and d.v = e.v""",
    "route_cache_hits": """
        select request_id, q.node1, q.node2, cost_c, hops, path
        from q_requests q join q_cache c on c.node1 = q.node1 and c.node2 = q.node2""",
    "partitioned_cache_lookup": """
        select request_id, q.node1, q.node2, cost_c, hops, case when c.node1 is null then 'no path' else 'found' end as status
        from q_requests q left join q_cache c on c.node1 = q.node1 and c.node2 = q.node2""",
    "route_cache_misses": """
        select distinct q.node1, q.node2 from q_requests q left join q_cache c on c.node1 = q.node1 and c.node2 = q.node2
        where c.node1 is null""",
    "cache_stats": """
        select sum(k)::bigint as entries, count(*) as pairs, max(k)::bigint as most_repeated from (
          select case when n.p_size <= 10 then 2 else 1 end as k from q_cache c join r_nodes n on n.id = c.node1)""",
    "paths_from_string": "select node1, node2, path, count(*) as times from p_path_text group by 1, 2, 3",
    "path_export_roundtrip": "select node1, node2, path, count(*) as times, 1::bigint as keys from p_path_text group by 1, 2, 3",
    "path_log_parse": "select node1, node2, path, count(*) as times from p_path_text group by 1, 2, 3",
    "route_geometry": """
        select path_id, count(lat1) as steps, (count(lat1) * 2)::int as points,
               arg_min(lat1, pos) filter (lat1 is not null) as lat1, arg_min(lon1, pos) filter (lat1 is not null) as lon1,
               arg_max(lat2, pos) filter (lat1 is not null) as lat2, arg_max(lon2, pos) filter (lat1 is not null) as lon2
        from (select path_id, pos, e.* from (
                select path_id, pos, node, lead(node) over (partition by path_id order by pos) as next_node
                from p_steps) s left join r_edges e on e.u = node and e.v = next_node where next_node is not null)
        group by 1""",
    "edge_betweenness_window": """
        select least(t.u, t.v) as u, greatest(t.u, t.v) as v, round(sum(x.x * t.f), 6) as credit,
               round(sum(x.x * t.f) / max(w_size.n * (w_size.n - 1)), 9) as betweenness
        from w_x x join w_share t on t.s = x.s and t.v = x.n, w_size group by 1, 2""",
    "node_betweenness_window": """
        select x.n as node, round(sum(x.x), 6) as credit, round(sum(x.x) / max((w_size.n - 1) * (w_size.n - 2)), 9) as betweenness
        from w_x x, w_size where r > 0 and x.n <> x.s group by 1""",
    "all_pairs_score_window": """
        select least(w.n, prev) as u, greatest(w.n, prev) as v, round(sum(1.0::double / far) * max(w_size.n - 2), 6) as score
        from w_walk w join w_last l on l.s = w.s, w_size where prev is not null group by 1, 2""",
    "attach_centrality": """
        select e.u, e.v, e.cost_c, coalesce(p.centrality, e.centrality) as centrality
        from r_central e left join p_uses p on p.u = e.u and p.v = e.v""",
    "attach_centrality_way": """
        select u, v, u // 3 as way_id, coalesce(m, centrality) as centrality
        from r_central left join (select u // 3 as w, max(centrality + 1) as m from r_central where cost_c > 800 group by 1) on w = u // 3""",
    "centrality_in_window": "select u, v, centrality from r_window",
    "window_stats": "select round(avg(centrality), 9) as mean_c, min(centrality) as min_c, max(centrality) as max_c from r_window",
    "window_q3": "select q3 from r_q3",
    "above_q3": "select u, v, centrality from r_window, r_q3 where centrality >= q3",
    "overlay_colors": """
        select u, v, centrality, case when centrality < q3 then null
          when p > 50 then 'rgb(255,0,' || floor(255 * (p / 100) + 0.5)::bigint || ')'
          else 'rgb(' || floor(255 * (p / 100) + 0.5)::bigint || ',0,255)' end as color
        from (select *, case when top - q3 = 0 then 100 else (centrality - q3) / (top - q3) * 100 end as p
              from r_window, r_q3, (select max(centrality) as top from r_window))""",
    "connected_components": "select n as id, m as component from c",
    "largest_component": """
        select n as id from c where m = (select m from c group by m order by count(*) desc, m limit 1)""",
    "consolidate_nodes": """
        select m as id, round(avg(lat), 7) as lat, round(avg(lon), 7) as lon, count(*) as merged
        from t join t_nodes on id = n group by 1""",
    "consolidate_edges": """
        select a.m as u, b.m as v, min(cost_c) as cost_c from t_edges join t a on a.n = u join t b on b.n = v
        where a.m <> b.m group by 1, 2""",
    "simplify_chains": """
        select a as u, cur as v, length_m, cost_c::bigint as cost_c, pieces::bigint as pieces,
               array_to_string(list_sort(list_distinct(hws)), ',') as highway,
               array_to_string(list_sort(list_distinct(mss)), ',') as maxspeed
        from x_walk where cur not in (select id from x_pass)""",
    "drivable_network": """
        select u, v, way_id, hw as highway, oneway, used as speed,
               floor({haversine:lat1,lon1,lat2,lon2} + 0.5)::bigint as metres
        from o_clean join o on o.n = u
        where o.m = (select m from o group by m order by count(*) desc, m limit 1)""",
    "osm_xml_nodes": """
        select id, lat, lon, case when id % 5 = 0 then lower(split_part(p_type, ' ', 1)) end as highway from r_nodes""",
    "osm_xml_ways": """
        select way_id, nd, ['tertiary', 'service', 'residential', 'secondary', 'primary', 'trunk', 'unclassified'][way_id % 7 + 1] as highway,
               case when way_id % 5 = 0 then null when way_id % 5 = 1 then 'signals' when way_id % 5 = 2 then '25 mph;36 mph'
                    else (way_id % 40 + 20) || ' mph' end as maxspeed,
               case when way_id % 3 <> 0 then 'Road ' || way_id % 10 end as name
        from (
          select gy * 100 + b as way_id, string_agg(id::varchar, '>' order by id) as nd
          from (select *, unnest(case when gx % 8 = 0 and gx > 0 then [gx // 8 - 1, gx // 8] else [gx // 8] end) as b from r_nodes) group by 1
          union all
          select a.id + 1000000, a.id || '>' || b.id from r_nodes a join r_nodes b on b.id = a.id + 100 where a.p_size <= 5)""",
    "load_nodes_csv": "select id, lat, lon from r_nodes",
    "csv_judged": """
        select osmid, lat, lon, array_to_string(reasons, ',') as reasons
        from (
        select id, case when id % 11 <> 3 then id end as osmid,
               case when id % 7 = 1 then null when id % 7 = 2 then 91.5::double else lat end as lat, case when id % 13 <> 4 then lon end as lon,
               list_filter([case when id % 11 = 3 then 'osmid type' end, case when id % 7 = 1 then 'y type' when id % 7 = 2 then 'y range' end,
                            case when id % 13 = 4 then 'x missing' end], lambda r: r is not null) as reasons
        from r_nodes)""",
    "csv_loaded_and_rejected": """
        select coalesce(reason, 'loaded') as reason, count(*) as lines
        from (select unnest(case when len(reasons) = 0 then [null] else reasons end) as reason from (
        select id, case when id % 11 <> 3 then id end as osmid,
               case when id % 7 = 1 then null when id % 7 = 2 then 91.5::double else lat end as lat, case when id % 13 <> 4 then lon end as lon,
               list_filter([case when id % 11 = 3 then 'osmid type' end, case when id % 7 = 1 then 'y type' when id % 7 = 2 then 'y range' end,
                            case when id % 13 = 4 then 'x missing' end], lambda r: r is not null) as reasons
        from r_nodes))
        group by all""",
    "load_edges_csv": "select u, v, oneway, cost_c, 2::int as points, lon1 as lon, lat1 as lat from r_edges",
    "stored_edges": "select u, v, cost_c from r_edges where u % 10 <> 0 and v % 10 <> 0",
    "appended_paths": "select node1, node2, cost_c, hops, path from q_cache",
    "network_v2": """
        select u, v, pieces, hw as highway, array_to_string(hws, ',') as highways, used as speed,
               greatest(1, floor(length_m * 100 / used + 0.5)::bigint) as cost_c, oneway, floor(length_m + 0.5)::bigint as metres,
               pieces + 1 as points, lon2, lat2, way_ids, names
        from y_priced join y on y.n = u
        where y.m = (select m from y group by m order by count(*) desc, m limit 1)""",
    "iterate_map_native": """
        select event_id, list_reduce(list_prepend(value / 1000, list_transform(range(100), lambda i: 0.0::double)),
               lambda r, i: r * r - 0.5::double) as result from events""",
}
_QUERIES |= {
    "sssp_tiled": _QUERIES["sssp_sample"], "shortest_paths_tiled": _QUERIES["shortest_paths_sample"],
    "route_pairs_tiled": _QUERIES["route_pairs"],
}
_QUERIES["window_importance"] = f"""
    select 'edge' as kind, e.u as a, e.v as b, e.u // 3 as way_id, m.c as centrality
    from ({_QUERIES["edges_in_box"]}) e left join (
      select y.u // 3 as w, max(f.betweenness) as c
      from ({_QUERIES["edges_in_box"]}) y join ({_QUERIES["edge_betweenness_window"]}) f on f.u = least(y.u, y.v) and f.v = greatest(y.u, y.v)
      group by 1) m on m.w = e.u // 3
    union all
    select 'node', q.id, null, null, f.betweenness
    from r_nodes q join r_middle k on q.lat between k.s and k.n and q.lon between k.w and k.e
      left join ({_QUERIES["node_betweenness_window"]}) f on f.node = q.id"""
_QUERIES["streamed_requests"] = _QUERIES["parse_requests"]
_QUERIES["iterate_map_vectorised"] = _QUERIES["iterate_map_native"]

_TABLES["q_all_spots"] = "select lat1 as lat, lng1 as lng from q_requests union select lat2, lng2 from q_requests"
_TABLES["q_spot_nodes"] = _TABLES["q_near"].replace("q_spots", "q_all_spots")


def _haversine(match: re.Match) -> str:
    lat1, lon1, lat2, lon2 = match.group(1).split(",")
    return (
        f"(2 * 6371008.8::double * asin(sqrt(least(1.0::double, pow(sin(radians({lat2} - ({lat1})) / 2), 2) + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - ({lon1})) / 2), 2)))))"
    )


def _expand(sql: str) -> str:
    return re.sub(r"\{haversine:([^}]*)\}", _haversine, sql).replace("{{", "{").replace("}}", "}")


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"(?:from|join|,)\s+([a-z]\w*)", sql):
        if name in _TABLES and name not in seen:
            seen.append(name)  # guards against the self-reference of recursive tables
            _needed(_TABLES[name], seen)
            seen.remove(name)
            seen.append(name)
    for name in re.findall(r"\bin \(select \w+ from (\w+)", sql):
        if name in _TABLES and name not in seen:
            _needed(f"from {name}", seen)
    return seen


def statement(query: str) -> str:
    body = _QUERIES[query]
    order = _needed(body, [])
    parts = [
        f"{_HEADS[n]} as ({_expand(_TABLES[n])})" if n in _HEADS else f"{n} as materialized ({_expand(_TABLES[n])})"
        for n in order
    ]
    return (f"with recursive {', '.join(parts)} " if parts else "") + _expand(body)


def all_oracles() -> dict[str, str]:
    return {name: statement(name) for name in _QUERIES}
