"""SQL for DuckDB that gives the rows of those operators that SQL can express."""

from __future__ import annotations

from .decontamination import WINDOW
from .lexical import TOP
from .prefix_trie import GROUP, MOST_SHARED
from .secrets import ADDED, BASE, COPIED_BY, COPIED_IN, PASSWORD_VARIETY, PASSWORDS, VARIETY
from .suffix_dedup import LENGTH

_CONTROL = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}'),
e as (select *, row_number() over (partition by conv_id order by turn, role, text) as n,
  length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) as role_chars, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as text_chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + role_chars + 1 + text_chars + 10 + 1) as bigint) as formatted_chars
from e group by conv_id
"""


def _words(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
with d as (select row_number() over () as r, doc_id, {_words("text")} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_words("text")} as w from benchmark),
m as (select item, w, least({WINDOW}, len(w)) as m from b where len(w) > 0),
win as (select distinct item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as k from (select *, unnest(range(1, len(w) - m + 2)) as i from m)),
sizes as (select distinct m from win),
places as (select r, m, w, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m),
hit as (select a.r, a.i, a.m, win.item from places a join win on win.m = a.m and win.k = array_to_string(list_slice(a.w, a.i, a.i + a.m - 1), ' ')),
words as (select r, count(distinct p) as n from (select r, unnest(range(i, i + m)) as p from hit) group by r),
items as (select r, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct r, item from hit) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items, sha256(coalesce(items.l, '')) as items_sha256, words.n is not null as contaminated
from d left join words on words.r = d.r left join items on items.r = d.r
"""


def _secrets() -> str:
    def kind(order: int, name: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        found = f"regexp_extract_all(t, '{p}', 0)"
        return f"""select r, {order} as o, '{name}' as kind, {least} as least, unnest(range(len({found}))) as i, unnest({found}) as m, unnest(regexp_extract_all(t, '{p}', {group})) as v,
  unnest(list_slice(string_split_regex(t, '{p}'), 1, len({found}))) as p from d where regexp_matches(t, '{p}')"""

    parts = " union all ".join(kind(i, *row) for i, row in enumerate([*BASE, *ADDED]))
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k, *_ in BASE)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, chr(1)) as owner, coalesce(text, '') as t from documents),
f as ({parts}),
a as (select *, coalesce(sum(length(p) + length(m)) over (partition by r, o order by i rows between unbounded preceding and 1 preceding), 0) + length(p) as s from f),
k as (select a.r, a.o, a.kind, a.v, cast(a.s as varchar) as s, a.s as n, cast(a.s + length(a.m) as varchar) as e, d.owner, coalesce(cast(d.doc_id as varchar), '') as repo from a join d on d.r = a.r where length(a.v) >= a.least),
owners as (select v, count(*) as n_owners, sum(n) as n_repos from (select v, owner, count(distinct repo) as n from k group by v, owner) group by v),
j as (select k.*, case when n_owners >= {COPIED_BY} or n_repos >= {COPIED_IN} * n_owners then 'copied' when len(list_distinct(string_split(k.v, ''))) >= case when k.kind in {PASSWORDS} then {PASSWORD_VARIETY} else {VARIETY} end then 'live' else 'dull' end as verdict from k join owners on owners.v = k.v),
g as (select r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' order by n, o) filter (where o < {len(BASE)}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by n, o) as spans,
  count(*) filter (where verdict = 'live') as n_live, count(*) filter (where verdict = 'copied') as n_copied from j group by r)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join g on g.r = d.r
"""


SECRETS = _secrets()


def _terms(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


_LAST = 2**63 - 1

SUFFIXES = f"""
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, {_LAST}) as id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select r, id, i, substring(x, 2 * i + 1, {2 * LENGTH}) as k from (select *, unnest(range(0, length(x) // 2 - {LENGTH - 1})) as i from d where length(x) >= {2 * LENGTH})),
m as (select k, min(id) as least from w group by k),
hit as (select w.r, w.i, lag(w.i) over (partition by w.r order by w.i) as p from w join m on m.k = w.k where m.least < w.id),
g as (select r, i, sum(case when p is null or i > p + {LENGTH} then 1 else 0 end) over (partition by r order by i) as n from hit),
s as (select r, min(i) as a, max(i) + {LENGTH} as b from g group by r, n),
b as (select s.r, a, s.b, d.x, coalesce(lag(s.b) over (partition by s.r order by a), 0) as before from s join d on d.r = s.r),
k as (select r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substring(any_value(x), 2 * max(b) + 1) as x from b group by r)
select d.doc_id, cast(length(d.x) // 2 as bigint) as n_bytes, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.x, d.x))) as kept_sha256
from d left join k on k.r = d.r
"""

# crc32 bit by bit: the bits of each byte, lowest first, through the reversed polynomial
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast({c} as varchar), ''), lambda ch: list_transform(range(8), lambda n: ((ascii(ch) >> n) & 1)::bigint)))), lambda c, bit: xor(c >> 1, 3988292384 * xor(c & 1, bit))), 4294967295)"

TRIE = f"""
with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null),
own as (select c, list({{'role': role, 'text': text}} order by n) as l from t group by c),
h as (select c, l, cast({_CRC.format(c="c")} % {MOST_SHARED} as int) as h from own),
r as (select h.c, list_concat(coalesce(list_slice(b.l, 1, h.h), []), list_slice(h.l, h.h + 1, len(h.l))) as l from h left join own b on b.c = h.c - h.c % {GROUP}),
p as (select c, len(l) as size, d, list_slice(l, 1, d) as k from (select *, unnest(range(0, len(l) + 1)) as d from r)),
n as (select k, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where size = d), '')) as ends_sha256, case when d = 0 then 0 else len(regexp_extract_all(k[d].text, '[^\x20\x09-\x0D]+')) end as words from p group by k, d),
ch as (select list_slice(k, 1, d - 1) as k, d - 1 as d, count(*) as n_children from n where d > 0 group by 1, 2),
x as (select n.*, coalesce(ch.n_children, 0) as n_children from n left join ch on ch.k = n.k and ch.d = n.d),
below as (select a.k, a.d, sum(case when b.n_children = 0 then 1 else 0 end) as n_leaves, sum((b.n_convs - 1) * b.words) as saved from (select k, d, n_children, n_convs, words, unnest(range(0, d + 1)) as at from x) b join x a on a.d = b.at and a.k = list_slice(b.k, 1, b.at) group by a.k, a.d)
select x.conv_id, cast(x.d as bigint) as depth, q.conv_id as parent_conv_id, x.n_convs, x.n_children, cast(below.n_leaves as bigint) as n_leaves, cast(below.saved as bigint) as saved_tokens, x.ends_sha256
from x join below on below.k = x.k and below.d = x.d left join n q on x.d > 0 and q.d = x.d - 1 and q.k = list_slice(x.k, 1, x.d - 1)
"""

RANKED = f"""
with d as (select row_number() over () as r, doc_id, {_terms("text")} as w from documents),
s as (select count(*) as n, sum(len(w)) as l from d where len(w) > 0),
i as (select row_number() over () as q, item_id, list_distinct({_terms("text")}) as w from benchmark),
t as (select q, unnest(w) as term from i),
p as (select r, doc_id, term, count(*) as tf, any_value(n) as n from (select r, doc_id, len(w) as n, unnest(w) as term from d) where term in (select term from t) group by r, doc_id, term),
f as (select term, count(*) as df from p group by term),
x as (select t.q, p.r, p.doc_id, cast(floor(1000 * ln((2 * s.n + 2) / (2 * f.df + 1))) as bigint) * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.n) // s.l))) as v from t join p on p.term = t.term join f on f.term = t.term, s),
y as (select q, r, doc_id, cast(sum(v) as bigint) as score from x group by q, r, doc_id having sum(v) > 0),
z as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from y)
select i.item_id, cast(z.rank as int) as rank, z.doc_id, z.score from z join i on i.q = z.q where z.rank <= {TOP}
"""
