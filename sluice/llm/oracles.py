"""DuckDB SQL for the operators that SQL can express on whole tables.

Toxicity and language ID are models, suffix dedup goes by single bytes: these are held against plain Python in the tests.
The SQL of the two near-duplicate searches compares all pairs.
"""

from .queries import URL_RULES

OP7 = f"""
with rules(verdict, rule_host, rule_path) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
fits as (
  select p.page_id, p.host, p.path, rule_host || rule_path as rule, coalesce(verdict, 'allow') as verdict,
    row_number() over (partition by p.page_id order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as place
  from p left join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path))
select page_id, host, path, rule, verdict from fits where place = 1
"""

OP9 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
r as (
  select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
    first_value(doc_id) over best as keep_id, row_number() over best as place
  from d window best as (partition by text_sha256 order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from r
"""


#: The table of the CRC-32 from its rule, and a text's CRC out of it, byte by byte.
CRC_TABLE = """
crc_table as (select list(c order by i) as crcs from (
  select i, list_reduce(list_prepend(i::uinteger, range(0, 8)::uinteger[]), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384::uinteger) else a >> 1 end) as c
  from range(0, 256) r(i)))"""
TEXT_CRC = """xor(list_reduce(list_prepend(4294967295::uinteger, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::uinteger)),
    lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255)::int + 1])), 4294967295::uinteger)::bigint"""
N_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
GROUP = "case when source is null then 'n' else 'v' || source end"

OP2 = f"""
with {CRC_TABLE},
d as (select doc_id, source, {GROUP} as g, octet_length(encode(coalesce(text, ''))) + 1 as size, {TEXT_CRC} as text_crc32 from documents, crc_table),
k as (select *, md5(concat_ws(':', '17', coalesce(doc_id::varchar, ''), text_crc32, size)) as key, ('0x' || substr(md5('17:' || g), 1, 8))::bigint / 4294967296.0 as jitter from d),
r as (select *, row_number() over (partition by g order by key, doc_id, text_crc32, size) - 1 as place, count(*) over (partition by g) as total from k),
p as (select *, row_number() over (order by (place + jitter) / total, key, g, doc_id, text_crc32, size) - 1 as position, count(*) over () as n from r),
s as (select *, (16 * (position + 1) - 1) // n as shard from p)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, position - (shard * n) // 16 as slot, null::int as grown_shard, source from s
"""

OP3 = f"""
with {CRC_TABLE},
d as (select doc_id, source, {GROUP} as g, {N_WORDS} as size, {TEXT_CRC} as crc from documents, crc_table),
sizes as (select g, any_value(source) as source, sum(size)::bigint as size from d group by g),
w as (select *, ([5.0, 2.0, 1.0]::double[])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, size * 2.0::double as cap, sum(size) over () as everything from sizes),
l as (select *, (everything * 1.5::double - coalesce(sum(cap) over (order by cap / weight, g rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, g rows between current row and unbounded following) as level from w),
t as (select *, cap <= level * weight as capped, min(case when cap > level * weight then cap / weight end) over () as lowest from l),
u as (select *, (select level from t x where not x.capped order by x.cap / x.weight, x.g limit 1) as common_level from t),
v as (select *, case when capped then cap else common_level * weight end as target, case when not capped and size > 0 then weight end as open_w from u),
x as (select *, sum(open_w) over () as sum_w, min(open_w) over () as min_w, sum(case when open_w > 0 then target else 0 end) over () as open_words from v),
y as (select *, greatest(1, ceil(open_words / (coalesce(greatest(512, ceil(16 * sum_w / min_w)), 512) * 16)))::bigint as block from x),
z as (select *, round(open_words / block)::bigint as seats, ceil(size / block)::bigint as blocks from y),
seats as (
  select g, k - 1 as draw, row_number() over (order by weight / (2 * k - 1) desc, g, k) - 1 as seat, seats, greatest(1, ceil(seats / 16))::bigint as per_shard
  from z, range(1, seats + 2) r(k) where open_w > 0),
won as (select g, draw, (seat // per_shard)::int as shard from seats where seat < seats),
plan as (select z.*, case when capped then 2 * blocks else least(coalesce(n, 0), 2 * blocks) end as quota from z left join (select g, count(*) as n from won group by g) using (g)),
draws as (
  select g, draw, shard from won
  union all select g, draw, ((16 * (2 * draw + 1)) // (2 * quota))::int from plan, range(0, quota) r(draw) where capped),
times as (
  select draws.g, draw % blocks as place, count(*) as times, string_agg(shard::varchar, ',' order by shard) as shards
  from draws join plan using (g) where draw < quota group by all),
cut as (select g, block, least(block, size - spot * block) as length, spot, row_number() over (partition by g order by md5(concat_ws(':', '23', g, spot)), spot) - 1 as place from plan, range(0, blocks) r(spot)),
b as (
  select cut.g, block, spot, length, coalesce(times, 0) as times, coalesce(shards, '') as shards,
    coalesce(sum(length * coalesce(times, 0)) over (partition by cut.g order by spot rows between unbounded preceding and 1 preceding), 0) as before
  from cut left join times on cut.g = times.g and cut.place = times.place),
placed as (
  select d.*, sum(size) over (partition by g order by md5(concat_ws(':', '23', coalesce(doc_id::varchar, ''), crc, size)), doc_id, crc, size rows between unbounded preceding and current row) - size as start from d)
select p.doc_id, p.size, plan.size as source_size, plan.target,
  case when p.size = 0 then 0 else ((e.before + e.times * (start + p.size - e.spot * e.block)) - (f.before + f.times * (start - f.spot * f.block)))::bigint end as taken,
  coalesce(f.times, case when plan.blocks > 0 then plan.quota // plan.blocks else 0 end)::int as copies, coalesce(f.shards, '') as shards, p.source
from placed p join plan using (g) left join b f on p.g = f.g and start // plan.block = f.spot
left join b e on p.g = e.g and greatest(start, start + p.size - 1) // plan.block = e.spot
"""


def least_padding(buckets: int) -> str:
    """The layers of the dynamic programme: cost * 2**20 + previous cut, the smallest cut of equal costs."""
    layers = ["b0 as (select 0::bigint as j, 0::hugeint as cost, 0::bigint as cut)"]
    for k in range(1, buckets + 1):
        layers.append(
            f"""b{k} as materialized (
  select j, (v >> 20)::hugeint as cost, (v & 1048575)::bigint as cut from (
    select e.i as j, min(((p.cost + e.length * (e.n - coalesce(s.n, 0)) - (e.words - coalesce(s.words, 0)))::bigint << 20) + p.j) as v
    from b{k - 1} p left join h s on s.i = p.j join h e on e.i > p.j group by e.i)
  union all select 0, 0, 0)"""
        )
    ends = [f"e{buckets} as (select max(i)::bigint as j from h)"] + [f"e{k - 1} as (select cut as j from b{k} join e{k} using (j))" for k in range(buckets, 1, -1)]
    return ",\n".join([*layers, *ends])


OP4 = f"""
with {CRC_TABLE},
d as (select doc_id, {N_WORDS} as n_tokens, {TEXT_CRC} as crc from documents, crc_table),
c as (select greatest(1, n_tokens)::bigint as length, count(*)::bigint as count from d group by 1),
h as materialized (select row_number() over (order by length) as i, length, sum(count) over (order by length)::bigint as n, sum(count * length) over (order by length)::bigint as words from c),
{least_padding(16)},
bounds as (select list(distinct length order by length) as bounds from h where i in ({" union all ".join(f"select j from e{k}" for k in range(1, 17))})),
r as (select *, len(list_filter(bounds, lambda b: b < n_tokens))::int as bucket from d, bounds),
p as (select *, bounds[bucket + 1] as padded, row_number() over (partition by bucket order by md5(concat_ws(':', '31', coalesce(doc_id::varchar, ''), crc, n_tokens)), doc_id, crc, n_tokens) - 1 as start from r)
select doc_id, n_tokens, bucket, padded, start // greatest(1, 16384 // padded) as batch, (start % greatest(1, 16384 // padded))::int as slot, padded - n_tokens as padding from p
"""

OP5 = """
with recursive v as (
  select vec_id as id, label, embedding::double[] as x from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs as (
  select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id <> b.id and len(a.x) = len(b.x)
  where list_dot_product(a.x, b.x) >= 0.93 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
reach(id, other) as (select a, b from pairs union select r.id, p.b from reach r join pairs p on r.other = p.a),
joined as (select id, min(other) as least from reach group by id),
counts as (select a as id, count(*) as n from pairs group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(j.least, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(j.least, e.vec_id)) as kept
from embeddings e left join counts c on c.id = e.vec_id left join joined j on j.id = e.vec_id
"""

OP10 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') as words from documents),
s as (
  select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(words) - 4) + 1), lambda i: hash(array_to_string(words[i:i + 4], ' '))))) as grams
  from w where len(words) > 0 and doc_id is not null),
c as materialized (select min(doc_id) as class_id, count(*) as copies, grams from s group by grams),
g as materialized (select class_id, copies, len(grams) as size, unnest(grams) as gram from c),
links as materialized (
  select a.class_id as a, b.class_id as b, any_value(b.copies) as copies from g a join g b on a.gram = b.gram and a.class_id <> b.class_id
  group by all having 5 * count(*) >= 4 * (any_value(a.size) + any_value(b.size) - count(*))),
reach(id, other) as (select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a),
joined as (select id, min(other) as least from reach group by id),
counts as (select a as id, sum(copies)::bigint as n from links group by a),
found as (select c.grams, c.class_id, c.copies - 1 + coalesce(n, 0) as n_links, least(c.class_id, coalesce(j.least, c.class_id)) as component_id from c left join counts t on t.id = c.class_id left join joined j on j.id = c.class_id)
select w.doc_id, coalesce(class_id, w.doc_id) as class_id, coalesce(n_links, 0) as n_links, coalesce(component_id, w.doc_id) as component_id, w.doc_id is not distinct from coalesce(component_id, w.doc_id) as kept
from w left join s on s.doc_id = w.doc_id left join found on found.grams = s.grams
"""

ORACLES: dict[str, str] = {"op2_sharding": OP2, "op3_mixing": OP3, "op4_packing": OP4, "op5_embedding_dedup": OP5, "op7_url_filter": OP7, "op9_exact_dedup": OP9, "op10_ngram_join": OP10}
