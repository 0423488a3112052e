"""SQL that says what the registered queries return, where SQL can."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SOURCE_DIVERGENCE = rf"""
with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                     translate(coalesce("text", ''), '{_UPPER}', '{_LOWER}') as body from documents),
found as (select id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from found group by all having count(distinct id) >= 30),
counted as (select f.lang, f.source, f.term, count(*) as n from found f join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
totals as (select lang, source, sum(n) as total from counted group by all),
groups as (select d.lang, d.source, coalesce(t.total, 0)::hugeint as total, coalesce(l.v, 0)::hugeint as v
           from (select distinct lang, source from docs) d left join totals t using (lang, source) left join langs l using (lang)),
shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) as p,
                  1 + (1000000000::hugeint * (k.n + 5)) // (l.total::hugeint + 5 * l.v) as q
           from groups g join kept k using (lang) join langs l using (lang)
           left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gaps as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
         from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(g.value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
           from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""

SOURCE_MIXING = r"""
with rows as (select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^ \t-\r]+'))::bigint as size,
                     md5('17:' || coalesce(doc_id::varchar, '') || ':' || coalesce("text", '')) as place from documents),
named as (select source, sum(size)::bigint as size, row_number() over (order by source nulls last) as i from rows group by source),
weighed as (select *, (i - 1) % 3 + 1 as w, 3 * size as most from named),
levels as (select *, (sum(size) over () - coalesce(sum(most) over (order by most / w, i rows between unbounded preceding and 1 preceding), 0))::double as words,
                  sum(w) over (order by most / w, i rows between current row and unbounded following)::double as weights,
                  row_number() over (order by most / w, i) as nth from weighed),
chosen as (select words, weights from levels where words * w <= most * weights order by nth limit 1),
sources as (select l.source, l.size, l.i, case when l.most * c.weights < l.w * c.words then l.most::double else l.w * c.words / c.weights end as target
            from levels l left join chosen c on true),
unit as (select greatest(1, least(512, min(size) filter (size > 0) // 1000)) as b, sum(size) as total from sources),
seats as (select i, row_number() over (order by target / (2 * k - 1) desc, i) as nth
          from (select i, target, unnest(range(1, (target / b)::bigint + 50)) as k from sources, unit where target > 0)),
quotas as (select i, count(*) as quota from seats, unit where nth <= (total + b // 2) // b group by i),
sharded as (select r.*, s.i, s.size as source_size, s.target, coalesce(q.quota, 0) as quota,
                   ('0x' || substr(r.place, 1, 8))::bigint % greatest(1, least(4096, ceil(s.size / 16384))::bigint) as shard
            from rows r join sources s on r.source is not distinct from s.source left join quotas q using (i)),
shards as (select i, shard, sum(size)::bigint as words, any_value(quota) as quota from sharded where size > 0 group by all),
shard_seats as (select i, shard, quota, row_number() over (partition by i order by words::double / (2 * k - 1) desc, shard) as nth
                from (select *, unnest(range(1, quota + 1)) as k from shards)),
shard_quotas as (select i, shard, count(*) as blocks from shard_seats where nth <= quota group by all),
runs as (select i, shard, words, least(coalesce(blocks, 0) * b, 3 * words) as take,
                b * (('0x' || substr(md5('17:' || i || ':' || shard), 1, 8))::bigint % ceil(words / b)::bigint) as begun
         from shards left join shard_quotas using (i, shard), unit),
laid as (select d.*, r.words, r.take // r.words as rounds, r.take % r.words as more, r.begun,
                coalesce(sum(d.size) over (partition by d.i, d.shard order by d.place, d.doc_id rows between unbounded preceding and 1 preceding), 0) as behind
         from sharded d join runs r using (i, shard) where d.size > 0)
select doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(begun + more - behind, size) - greatest(begun - behind, 0))
        + greatest(0, least(begun - words + more - behind, size) - greatest(begun - words - behind, 0)))::bigint as taken from laid
union all select doc_id, size, source_size, target, 0::bigint from sharded where size = 0
"""

PREFIX_TRIE = r"""
with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as pos,
                      coalesce(role, '') as role, coalesce("text", '') as body from conversations where conv_id is not null),
convs as (select conv_id, max(pos) as n, list({'role': role, 'body': body} order by pos) as said from turns group by conv_id),
heads as (select *, xor(4294967295, list_reduce([4294967295::bigint] || [ascii(c)::bigint for c in string_split(conv_id::varchar, '')],
              lambda crc, byte: list_reduce([xor(crc, byte)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0],
                  lambda x, step: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 9 as h from convs),
rebuilt as (select c.conv_id, list_concat(coalesce(b.said, [])[1:c.h], c.said[c.h + 1:]) as said
            from heads c left join heads b on b.conv_id = c.conv_id - c.conv_id % 5),
prefixes as (select conv_id, d as depth, said[1:d] as path, d = len(said) as ends
             from (select conv_id, said, unnest(range(0, len(said) + 1)) as d from rebuilt)),
nodes as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
                 (count(*) - 1) * coalesce(strlen(path[depth].body), 0) as value,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
          from prefixes group by depth, path),
kids as (select p.depth, p.path, count(*) as n from nodes p join nodes c on c.depth = p.depth + 1 and c.path[1:p.depth] = p.path group by all),
sums as (select p.depth, p.path, sum(s.value) as saved, count(*) filter (k.n is null) as leaves
         from nodes p join nodes s on s.depth >= p.depth and s.path[1:p.depth] = p.path
         left join kids k on k.depth = s.depth and k.path = s.path group by all)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.leaves as n_leaves,
       s.saved::bigint as saved_tokens, n.ends_sha256
from nodes n join sums s on s.depth = n.depth and s.path = n.path left join kids k on k.depth = n.depth and k.path = n.path
left join nodes up on n.depth > 0 and up.depth = n.depth - 1 and up.path = n.path[1:n.depth - 1]
"""
