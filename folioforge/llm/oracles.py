"""DuckDB SQL of the queries whose results follow from whole tables by plain rules, however the operators find them."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(words: str, k: int) -> str:
    """sets (r, s): the distinct shingles of k words of docs (r, w), all words as one where there are fewer; sizes (r, n)."""
    return f"""words as (select row_number() over () as r, doc_id, {words} as w from documents),
sets as (select distinct r, unnest(case when len(w) >= {k} then [array_to_string(w[i : i + {k - 1}], ' ') for i in range(1, len(w) - {k - 2})] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select r, count(*) as n from sets group by r),
pairs as (select a.r as x, b.r as y, count(*) as k from sets a join sets b on a.s = b.s and a.r < b.r group by a.r, b.r),
links as (select x, y from pairs join sizes a on a.r = x join sizes b on b.r = y where 100 * k >= 80 * (a.n + b.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select r as x, r as y from words union select reach.x, both_ways.y from reach join both_ways on reach.y = both_ways.x),
least as (select reach.x as r, min(doc_id) as least from reach join words on words.r = reach.y group by reach.x)"""


#: Two-word shingles in ASCII lower case; documents that links connect.
OP11 = f"""with recursive {_shingles(WORDS.format(text=ASCII_LOWER), 2)}
select doc_id, coalesce(n, 0)::bigint as n_shingles, least as component_id, doc_id is not distinct from least as kept from words left join sizes using (r) join least using (r)"""

#: Five-word shingles in lower case, words at any white space; links to rows and to different sets.
OP1 = rf"""with recursive {_shingles(r"regexp_extract_all(lower(coalesce(text, '')), '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x{b}]+')", 5)},
named as (select r, md5(string_agg(s, chr(10) order by s)) as name from sets group by r),
counts as (select x as r, count(*) as n_links, count(distinct b.name) filter (a.name != b.name) as n_texts from both_ways join named a on a.r = x join named b on b.r = y group by x)
select doc_id, case when n_links > 0 then least else doc_id end as class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_texts, 0)::bigint as n_texts from words left join counts using (r) join least using (r)"""

#: Word and line counts of whole texts, and all rules.
OP8 = rf"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, {WORDS.format(text="coalesce(text, '')")} as w from documents),
runs as (select r, i, array_to_string(w[i : i + 4], ' ') as s from (select r, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) > 4)),
again as (select r, i from runs qualify count(*) over (partition by r, s) > 1),
covered as (select r, count(distinct i + j) as n_repeat_words from again, (select unnest(range(0, 5)) as j) group by r),
lines as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
f as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines from docs left join lines using (r) left join covered using (r)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not (base_failed or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 50 * n_lines or word_chars < 2 * n_words or word_chars > 40 * n_words) as kept from j"""
