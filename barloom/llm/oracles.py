"""DuckDB statements for the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {WORDS} as w from documents),
g as (select r, i, list_aggregate(w[i:i + 4], 'string_agg', chr(1)) as five from d, unnest(range(1, greatest(len(w) - 3, 1))) as u(i)),
h as (select r, i, count(*) over (partition by r, five) as c from g),
p as (select r, i, lag(i) over (partition by r order by i) as before from h where c > 1),
n as (select r, sum(least(5, i - coalesce(before, i - 5))) as n_repeat_words from p group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
      from d, unnest(string_split(t, chr(10))) as u(x) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m as (
  select doc_id, len(w)::bigint as n_words,
    coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::bigint as n_capitals,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::bigint as n_letters,
    length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_exclaims
  from d left join l using (r) left join n using (r)),
b as (
  select *, (case when n_words < 10 then 1 else 0 end
    + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end
    + case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end
    + case when n_words > 0 and (2 * word_chars < 3 * n_words or word_chars > 15 * n_words) then 16 else 0 end
    + case when 10 * n_capitals > 6 * n_letters then 32 else 0 end
    + case when 10 * n_exclaims > 6 * n_words then 64 else 0 end)::bigint as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
  fail_bits = 0 as kept, fail_bits, n_lines, n_capitals, n_letters, n_exclaims
from b
"""

OP6 = rf"""
with recursive d as (select doc_id, source, len({WORDS})::bigint as size, md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as turn from documents),
s as (select source, sum(size)::double as source_size, (case (row_number() over (order by source collate "binary" nulls last) - 1) % 3 when 0 then 1 when 1 then 2 else 3 end)::double as w from d group by source),
fill(round, source, w, cap, fixed) as (
  select 0, source, w, 3 * source_size, false from s
  union all
  select round + 1, source, w, cap, fixed or w * ((select sum(source_size) from s) - coalesce(sum(cap) filter (fixed) over (), 0)) > cap * coalesce(sum(w) filter (not fixed) over (), 0)
  from fill where round < 60),
t as (select source, cap, fixed, w, coalesce(sum(cap) filter (fixed) over (), 0) as used, sum(w) filter (not fixed) over () as open from fill where round = 60),
a as (select s.source, s.source_size, case when fixed then cap else t.w * ((select sum(source_size) from s) - used) / open end as target
      from s join t on s.source is not distinct from t.source),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from a),
n as (select *, greatest(0, round(target)::bigint - whole * source_size::bigint) as need from e),
o as (select d.doc_id, d.source, d.size, n.source_size, n.target, n.whole, n.need,
        coalesce(sum(d.size) over (partition by d.source order by turn, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join n on d.source is not distinct from n.source)
select doc_id, source, size, source_size::bigint as source_size, target, (whole * size + least(size, greatest(0, need - before)))::bigint as taken from o
"""

OP10 = """
with p as (select page_id, coalesce(html, '') as t from pages),
d as (select page_id, octet_length(encode(t))::bigint as payload_bytes, sha256(t) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from f
"""

ORACLES = {"op2_quality_ledger": OP2, "op6_mixture": OP6, "op10_warc_archives": OP10}
