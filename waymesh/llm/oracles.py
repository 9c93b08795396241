"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

_ORACLES = {
    "op5_exact_dedup": """
select doc_id,
       max(doc_id) over w as keep_id,
       count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window w as (partition by coalesce(text, ''))
""",
    "op6_perspectives": """
with said as (
    select conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as body,
           row_number() over (partition by conv_id order by coalesce(turn, -1), replace(coalesce(role, 'unknown'), '<|', '< |'),
                              replace(coalesce(text, ''), '<|', '< |')) - 1 as pos
    from conversations
),
speakers as (select distinct conv_id, role as perspective from said where role <> 'system'),
pieces as (
    select s.conv_id, perspective, pos // 512 as part, pos, role = perspective as mine,
           case when role = perspective then '<|assistant|>' || chr(10) when role = 'system' then '<|system|>' || chr(10)
                else '<|user name=' || role || '|>' || chr(10) end as head,
           body || '<|end|>' as tail
    from said s join speakers p on s.conv_id is not distinct from p.conv_id
),
placed as (
    select *, coalesce(sum(length(head) + length(tail) + 1) over (
               partition by conv_id, perspective, part order by pos rows between unbounded preceding and 1 preceding), 0) as offset_here
    from pieces
)
select conv_id, perspective, part, count(*) as n_turns, string_agg(head || tail || chr(10), '' order by pos) as rendered,
       coalesce(string_agg((offset_here + length(head))::bigint || ':' || (offset_here + length(head) + length(tail))::bigint, ',' order by pos)
                filter (where mine), '') as mask
from placed group by conv_id, perspective, part
""",
    "op11_conversation_trie": """
with own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as body,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
    from conversations where conv_id is not null
),
ids as (
    select conv_id, conv_id - conv_id % 5 as base, count(*) as n_own,
           xor(list_reduce(
               list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
               lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::bigint
           ), 4294967295::bigint) % 9 as shared
    from own group by conv_id
),
plan as (
    select i.*, least(i.shared, coalesce(b.n_own, 0)) as taken from ids i left join ids b on b.conv_id = i.base
),
turns as (
    select p.conv_id, o.pos + 1 as depth, role, body from plan p join own o on o.conv_id = p.base where o.pos < p.taken
    union all
    select p.conv_id, o.pos - p.shared + p.taken + 1, role, body from plan p join own o on o.conv_id = p.conv_id where o.pos >= p.shared
),
steps as (
    select conv_id, depth, strlen(body) as octets,
           sha256(list({'r': role, 'b': body}) over (partition by conv_id order by depth)::json::varchar) as key
    from turns
    union all
    select conv_id, 0, 0, 'root' from ids
),
paths as (
    select *, lag(key) over (partition by conv_id order by depth) as parent,
           row_number() over (partition by conv_id order by depth desc) = 1 as ends
    from steps
),
nodes as (
    select key, min(conv_id) as conv_id, min(depth) as depth, min(parent) as parent, count(*) as n_convs, min(octets) as octets,
           sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from paths group by key
),
grown as (
    select n.*, coalesce(c.n, 0) as n_children from nodes n
    left join (select parent as key, count(*) as n from nodes where parent is not null group by parent) c using (key)
),
-- a node lies in the subtrees of all nodes on the way of its smallest member
sums as (
    select p.key, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * g.octets)::bigint as saved_tokens
    from grown g join paths p on p.conv_id = g.conv_id and p.depth <= g.depth group by p.key
)
select g.conv_id, g.depth, u.conv_id as parent_conv_id, g.n_convs, g.n_children, n_leaves, saved_tokens, g.ends_sha256
from grown g join sums using (key) left join nodes u on u.key = g.parent
""",
    "op12_quality_rules": """
with words as (
    select doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as body,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') as ws,
           row_number() over () as uid
    from documents
),
windows as (
    select uid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram
    from (select uid, ws, unnest(range(1, len(ws) - 1)) as i from words)
),
again as (select uid, i from windows qualify count(*) over (partition by uid, gram) > 1),
covered as (select uid, count(distinct i + k) as n from again, range(3) r(k) group by uid),
lines as (
    select uid, count(*) - count(distinct line) as n
    from (select uid, unnest(string_split(body, chr(10))) as line from words)
    where regexp_matches(line, '[^ \\t-\\r]') group by uid
),
base as (
    select w.uid, doc_id, stratum, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
           (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols,
           coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
    from words w left join lines l using (uid) left join covered c using (uid)
),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
grid(rule, step) as (
    values ('symbols', 10), ('repeated_lines', 4), ('repeated_words', 8), ('long_words', 4), ('short_words', 2), ('few_words', 10)
),
measures as (
    select uid, doc_id, stratum, base_failed, rule, step,
           case rule when 'symbols' then 1000 * n_symbols // n_words when 'repeated_lines' then 1000 * n_dup_lines // n_words
                when 'repeated_words' then 1000 * n_repeat_words // n_words when 'long_words' then 10 * word_chars // n_words
                when 'short_words' then greatest(0, 128 - 10 * word_chars // n_words) else greatest(0, 640 - n_words) end as badness
    from judged, grid where n_words > 0
),
marks as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id),
counts as (
    select stratum, rule, least(64, (badness + step - 1) // step) as above,
           count(*) filter (where quality = 1) as good, count(*) filter (where quality <> 1) as bad
    from measures join marks using (doc_id) where not base_failed group by all
),
tests as (
    select c.stratum, c.rule, cutoff, n_good, sum(good)::bigint as lost, sum(bad)::bigint as caught
    from counts c join (select stratum, rule, sum(good)::bigint as n_good from counts group by all) t
      on t.stratum = c.stratum and t.rule = c.rule
    join range(64) r(cutoff) on cutoff < above group by all
),
certified as (
    select * from tests
    where lost <= n_good * (0.02::double / 6)
      and list_sum(list_transform(range(lost + 1), lambda k: exp(
              lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1)
              + k * ln(0.02::double / 6) + (n_good - k) * ln(1 - 0.02::double / 6))))
          <= 0.05::double / (6 * (select count(distinct stratum) from counts))
      and caught - 20 * lost > 0
    qualify row_number() over (partition by stratum, rule order by caught - 20 * lost desc, cutoff desc) = 1
),
failed as (
    select uid, list(m.rule) as rules from measures m join certified c on c.stratum = m.stratum and c.rule = m.rule
    where badness > cutoff * step group by uid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rules is null as kept,
       array_to_string(list_filter(['symbols', 'repeated_lines', 'repeated_words', 'long_words', 'short_words', 'few_words'],
                                   lambda r: list_contains(coalesce(rules, []), r)), ',') as failed_rules
from judged left join failed using (uid)
""",
    "op13_collocations": """
with pieces as (
    select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') as ws
    from (select coalesce(lang, 'und') as lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[.,;:!?\\n-\\r]')) as piece
          from documents)
),
totals as (select lang, sum(len(ws))::bigint as n from pieces group by lang),
phrases as (
    select lang, k as size, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
    from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from pieces, range(1, 5) r(k) where len(ws) >= k)
    group by all
),
found as (select lang, size, phrase, string_split(phrase, ' ') as ws, f as a from phrases where size > 1 and f >= 30),
longer as (
    select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, max(a) as most
    from (select lang, ws, a, k, unnest(range(1, size - k + 2)) as i from found, range(2, 4) r(k) where k < size) group by 1, 2
),
kept as (
    select f.* from found f left join longer l on l.lang = f.lang and l.phrase = f.phrase
    where most is null or 100 * most < 80 * a
),
cuts as (
    select c.lang, c.phrase, a, k, l.f as l, r.f as r, (2000000::hugeint * a // (l.f + r.f))::bigint as score
    from (select *, unnest(range(1, size)) as k from kept) c
    join phrases l on l.lang = c.lang and l.phrase = array_to_string(ws[:k], ' ')
    join phrases r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:], ' ')
),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best join totals using (lang)
qualify rank <= 2000
""",
}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
