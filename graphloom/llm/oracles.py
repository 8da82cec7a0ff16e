"""SQL for the queries that SQL can express."""

_STATEMENTS = r"""
with bared as (
  select row_id, [regexp_replace(lower(upper(x)), '[\p{P}\p{S}\p{Z}\p{C}]+', '', 'g') for x in [subject, predicate, object]] as b
  from drug_repurposing_graph
  where not regexp_full_match(subject, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*')
    and not regexp_full_match(predicate, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*')
    and not regexp_full_match(object, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*')
), spaced as (
  select row_id, b, [y for y in [case when regexp_matches(x, '[0-9]') then regexp_extract(x, '^(hgnc|uniprot|chembl|mondo)', 1) else '' end for x in b] if y <> ''] as s
  from bared
), keyed as (
  select row_id, array_to_string(case when len(s) = 2 and len(list_distinct(s)) = 1 then b else list_sort(b) end, chr(31)) as k from spaced
), grouped as (
  select row_id, min(row_id) over (partition by k) as first_row_id, count(*) over (partition by k) as n from keyed
)
"""

ORACLES: dict[str, str] = {
    "p1_found": _STATEMENTS + "select row_id, first_row_id from grouped where n > 1",
    "p1_copies": _STATEMENTS + "select first_row_id, count(*) as copies from grouped group by first_row_id",
}

ORACLES["p3_found"] = r"""
with recursive edges as (
  select distinct left_id as a, right_id as b from match_pairs
  where origin in ('auto_merged_pairs', 'alias_map', 'source_alias_map')
    and not regexp_full_match(left_id, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*') and not regexp_full_match(right_id, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]*')
), both_ways as (select a, b from edges union select b, a from edges),
reached as (select a as origin, a as node from both_ways union select r.origin, e.b from reached r join both_ways e on e.a = r.node)
select origin as member_id, min(node) as group_id from reached group by origin
"""

_LONG = r"""
with long as (
  select canonical_id, record_id, updated_at,
    exists (select 1 from aligned_source_pairs p where p.canonical_id = e.source_canonical_id and p.is_ground_truth) as trusted,
    unnest(['label', 'group_name', 'color', 'description']) as field_name, unnest([label, group_name, color, description]) as value
  from canonical_entities e
), normed as (
  select *, regexp_replace(lower(upper(value)), '[\p{P}\p{S}\p{Z}\p{C}]+', '', 'g') as norm, count(*) over (partition by canonical_id, field_name) as records from long
), voting as (
  select * from normed where norm <> '' and norm not in ('na', 'nan', 'nil', 'none', 'null', 'tba', 'tbc', 'tbd', 'unknown', 'undefined', 'unspecified', 'missing',
    'notavailable', 'notapplicable', 'notknown', 'notspecified', 'tobeannounced', 'tobeconfirmed', 'tobedetermined')
)
"""
ORACLES["p2_found"] = _LONG + """
select canonical_id, field_name, record_id from voting where records >= 2
qualify row_number() over (partition by canonical_id, field_name order by trusted desc, updated_at desc nulls last, record_id) = 1
"""
ORACLES["p2_survivors"] = _LONG + """
, votes as (
  select canonical_id, field_name, norm, arg_max(value, row(trusted, coalesce(updated_at, timestamp '0001-01-01'), -record_id)) as value,
    max(row(trusted, coalesce(updated_at, timestamp '0001-01-01'), -record_id)) as best,
    round(sum(case when trusted then 3.0::double else 1.0::double end * pow(0.5::double,
      coalesce(date_sub('second', updated_at, (select max(updated_at) from canonical_entities)) / 86400.0::double / 180.0::double, 10.0::double))), 9) as vote
  from voting group by all
), won as (
  select canonical_id, field_name, arg_max(value, row(vote, best)) as value from votes group by all
)
select n.canonical_id, max(value) filter (field_name = 'label') as label, max(value) filter (field_name = 'group_name') as group_name,
  max(value) filter (field_name = 'color') as color, max(value) filter (field_name = 'description') as description, max(n.records) as records
from (select canonical_id, count(*) as records from canonical_entities group by canonical_id) n left join won on won.canonical_id = n.canonical_id group by n.canonical_id
"""
