"""SQL for the queries of this subpackage that SQL can say on whole tables."""

from __future__ import annotations

# White space and its complement in the Unicode sense, as the insides of character classes.
_S, _N = r"\s\x{85}\p{Z}", r"^\s\x{85}\p{Z}"

_TOKENS = rf"""
    (len(regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[{_N}\p{{L}}\p{{N}}]+'))
     + len(regexp_extract_all(text, '[{_S}] [{_N}]'))
     + len(regexp_extract_all(text, '[\t\n\r\f\v\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}][{_N}]'))
     + len(regexp_extract_all(text, '[{_S}][\t\n\r\f\v\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}][{_N}]'))
     + regexp_matches(text, '[{_S}]$')::int)"""

SQL = {
    "p2_found": rf"""
        with d as (select distinct id, body from scraped_articles where body is not null),
             l as (select id, unnest(string_split(body, chr(10))) as line from d where len(regexp_extract_all(body, '[{_N}]+')) > 512),
             w as (select id, line, len(regexp_extract_all(line, '[{_N}]+')) as n from l),
             s as (select id, n, list_max(list_transform(string_split(regexp_replace(line, '([.!?"''”’»“›])[{_S}]+', '\1' || chr(10), 'g'), chr(10)),
                          lambda x: len(regexp_extract_all(x, '[{_N}]+')))) as longest from w)
        select id, case when max(n) <= 512 then 'line' when max(longest) <= 512 then 'sentence' else 'none' end as boundary from s group by id""",
    "p4_found": r"""
        with lines as (
            select distinct id, source, unnest(string_split(body, chr(10))) as line,
                   unnest(range(len(string_split(body, chr(10)))))::int as line_no
            from scraped_articles where source is not null and body is not null),
        folded as (select id, source, line_no, regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g') as k from lines),
        often as (select source, k from folded where k <> '' group by all having count(distinct id) >= 5)
        select distinct id, line_no from folded join often using (source, k)""",
    "p2_totals": rf"""
        select id, len(regexp_extract_all(body, '[{_N}]+'))::bigint as n_words, true as within, true as overlaps_within
        from (select distinct id, body from scraped_articles where body is not null)""",
    "p4_sources": r"""
        with lines as (select distinct id, source, unnest(string_split(body, chr(10))) as line from scraped_articles where source is not null and body is not null),
        folded as (select id, source, regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g') as k from lines),
        often as (select source, k, count(distinct id) as n from folded where k <> '' group by all having count(distinct id) >= 5)
        select source, count(*) as n_lines, sum(n)::bigint as n_uses, max(n) as most from often group by 1""",
    "p4_clean": r"""
        with d as (select distinct id, source, body from scraped_articles where body is not null),
        lines as (select id, source, body, unnest(string_split(body, chr(10))) as line, unnest(range(len(string_split(body, chr(10)))))::int as n from d),
        folded as (select *, regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g') as k from lines),
        often as (select source, k from folded where k <> '' and source is not null group by all having count(distinct id) >= 5),
        cut as (select distinct f.id, f.n from folded f join often o on f.source = o.source and f.k = o.k),
        kept as (select f.id, f.source, f.body, coalesce(string_agg(f.line, chr(10) order by f.n) filter (c.id is null or f.source is null), '') as b
                 from folded f left join cut c on c.id = f.id and c.n = f.n group by 1, 2, 3)
        select id, length(b)::int as n_chars, md5(b) as md5 from kept""",
    "p5_found": rf"""
        with w as (select distinct id, regexp_extract_all(lower(coalesce(title, '') || ' ' || body), '[\p{{L}}\p{{N}}]+') as t
                   from scraped_articles where regexp_matches(body, '[{_N}]')),
             s as (select id, list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) as g from w where len(t) >= 5),
             e as (select id, len(g) as n, unnest(g) as x from s),
             c as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.x = b.x and a.id < b.id group by all)
        select distinct id_a, id_b from c where c >= 0.5 * (na + nb - c)""",
    "p8_found": f"select doc_id from documents where {_TOKENS} > 1024",
    "p8_placement": f"""
        with n as (select {_TOKENS} as n from documents where text is not null)
        select sum(n)::bigint as tokens, sum(ceil(n / 1024))::bigint as parts, 0::bigint as overfull, true as well_filled,
               count(*) as documents, 0::bigint as divided_needlessly, 0::bigint as placed_twice from n where n > 0""",
    "p9_sizes": f"""
        with d as (select source, {_TOKENS} as n from documents where text is not null),
             n as (select source, count(*) as docs, sum(n)::bigint as n from d group by 1),
             m as (select m.source, target_share, max_repeats, coalesce(docs, 0) as docs, coalesce(n.n, 0)::bigint as tokens from mix_targets m left join n using (source))
        select source, docs, tokens, round(target_share * (select sum(tokens) from m))::bigint as target_tokens, max_repeats * tokens as capacity,
               target_share * (select sum(tokens) from m) <= max_repeats * tokens as reachable from m""",
    "p9_found": f"""
        with n as (select source, sum({_TOKENS}) as n from documents where text is not null group by 1),
             m as (select m.*, coalesce(n.n, 0) as n from mix_targets m left join n using (source))
        select source from m where target_share * (select sum(n) from m) > max_repeats * n""",
}
