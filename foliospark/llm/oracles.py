"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import secrets, url_filter

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CHAT = """with t as (select conv_id, list({'r': role, 'x': text} order by turn nulls first, role nulls first, text nulls first) as l from conversations where conv_id is not null group by conv_id),
 w as (select min(conv_id) as conv_id, l from t group by l),
 k as (select conv_id, l from w a where not exists (select 1 from w b where len(b.l) > len(a.l) and b.l[1:len(a.l)] = a.l))
 select conv_id, cast(len(l) as bigint) as n_turns, array_to_string(list_transform(l, lambda z: '<|im_start|>' || coalesce(z.r, '') || chr(10) || coalesce(z.x, '') || '<|im_end|>' || chr(10)), '') as rendered from k"""

NGRAMS = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as l from documents),
 s as (select distinct doc_id, g from (select doc_id, unnest(case when len(l) = 0 then []::varchar[] when len(l) < 3 then [array_to_string(l, ' ')] else list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) end) as g from w)),
 n as (select doc_id, count(*) as c from s group by doc_id),
 p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 90 * (nx.c + ny.c - i)),
 both_ways as (select x as a, y as b from e union all select y, x from e),
 r(v, c) as (select doc_id, doc_id from documents union select b, r.c from r join both_ways on a = r.v)
 select d.doc_id, coalesce(max(n.c), 0) as n_shingles, min(r.c) as component_id from documents d left join n on n.doc_id = d.doc_id join r on r.v = d.doc_id group by d.doc_id"""


def _spans(kind: str, pattern: str, group: int = 0) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, source, {secrets.KINDS.index(kind)} as kind_no, '{kind}' as kind, list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as start, length(m[i]) as size, v[i] as value
 from (select doc_id, source, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v, regexp_split_to_array(t, '{pattern}') as s, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) as i from d)"""


# the guard before a token only spares Java's engine work: leftmost longest runs are the same without it
SECRETS = f"""with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as t from documents),
 base as (select *, start + size as stop from (select * from ({_spans('assign', secrets.ASSIGN, 2)}) where length(value) >= 6 union all {_spans('access', secrets.ACCESS)} union all {_spans('hex', secrets.HEX)})),
 tok as (select *, start + size as stop from ({_spans('owned', secrets.TOKEN.split(')', 1)[1])}) where regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT}),
 free as (select * from tok where not exists (select 1 from base b where b.doc_id = tok.doc_id and b.start < tok.stop and tok.start < b.stop)),
 every as (select * from base union all select * from free),
 held as (select value, count(distinct source) as n_owners from every group by value),
 shown as (select e.*, n_owners <= 1 as live from every e join held using (value) where kind <> 'owned' or n_owners <= 1),
 a as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) filter (where kind <> 'owned') as b,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as s, count(*) filter (where live) as n_live from shown group by doc_id)
 select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans, coalesce(n_live, 0) as n_live from d left join a using (doc_id)"""

# bytes are written as two hex digits each
REPEATS = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
 w as (select doc_id, p, substr(x, 2 * p + 1, 100) as k from (select doc_id, x, unnest(range(0, n - 49)) as p from h where n >= 50)),
 f as (select k, min(doc_id) as first from w group by k having max(doc_id) > min(doc_id)),
 hit as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from w join f using (k) where first < doc_id),
 g as (select doc_id, p, sum(case when before is null or p - before > 50 then 1 else 0 end) over (partition by doc_id order by p) as grp from hit),
 span as (select doc_id, grp, min(p) as s, max(p) + 50 as e from g group by doc_id, grp),
 q as (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as pe from span),
 r as (select q.doc_id, sum(e - s) as removed, count(*) as n_spans, string_agg(substr(x, 2 * pe + 1, 2 * (s - pe)), '' order by s) || substr(any_value(x), 2 * max(e) + 1) as kept from q join h using (doc_id) group by q.doc_id)
 select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from h left join r using (doc_id)"""


def _urls(rounds: int = 12, damping: int = 85, threshold: float = 0.5) -> str:
    """Rules, and the rounds of propagation written out one by one."""
    one = url_filter.ONE
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    fits = [(v, r, f"(host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}')") for v, r in rules]
    case = lambda at: "case " + " ".join(f"when {f[2]} then '{f[at]}'" for f in fits) + " end"
    link = url_filter.LINK.replace("'", "''")
    steps = []
    for name, seed, src, dst in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        steps.append(f"{name}e as (select {src} as src, {dst} as dst, n * {one} // (sum(n) over (partition by {src})) as share from edges)")
        steps.append(f"{name}0 as (select host, cast({seed} * {100 - damping} // 100 as hugeint) as score from hosts where {seed} > 0)")
        for k in range(rounds):
            steps.append(f"{name}{k + 1} as (select host, sum(score) as score from (select * from {name}0 union all select dst, score * share * {damping} // {100 * one} from {name}{k} join {name}e on src = host) group by host)")
    return f"""with u as (select page_id, {host('url')} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
 j as (select *, {case(1)} as rule, {case(0)} as said from u),
 hosts as (select host, count(*) filter (said = 'allow') * {one} // count(*) as allowed, count(*) filter (said = 'block') * {one} // count(*) as blocked from j group by host),
 l as (select {host('url')} as src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') as dst from pages where html like '%//%'),
 edges as (select src, dst, count(*) as n from l where src <> dst and src <> '' group by src, dst),
 {', '.join(steps)},
 s as (select host, cast(coalesce(t.score, 0) * 100 // {100 - damping} as bigint) as trust, cast(coalesce(d.score, 0) * 100 // {100 - damping} as bigint) as distrust from hosts left join t{rounds} t using (host) left join d{rounds} d using (host))
 select page_id, host, path, rule, coalesce(said, case when host <> '' and distrust - trust > {int(threshold * one)} then 'block' else 'allow' end) as verdict, trust, distrust from j left join s using (host)"""


URLS = _urls()

STATISTICS = """with w as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as l from documents),
 g as (select doc_id, unnest(list_transform(range(1, len(l) - 3), lambda i: {'i': i, 'x': l[i : i + 4]})) as s from w where len(l) > 4),
 r as (select doc_id, s.i as i from g qualify count(*) over (partition by doc_id, s.x) > 1),
 c as (select doc_id, count(distinct i + k) as n from r, range(0, 5) as o(k) group by doc_id),
 z as (select w.doc_id, cast(len(l) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, coalesce(c.n, 0) as n_repeat_words from w left join c using (doc_id))
 select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from z"""

# the checksum's table, one entry a byte, and its steps over the digits of an id
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"


def _crc(of: str, table: str = "crc_table") -> str:
    bytes_ = f"list_transform(string_split(cast({of} as varchar), ''), lambda z: cast(ascii(z) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bytes_}), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)"


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda z: z <> '')"

LANGUAGES = f"""with crc as (select {_CRC_TABLE} as crc_table),
 d as (select doc_id, text, lang, coalesce({_crc('doc_id')} % 3 = 1, false) as held_out from documents, crc),
 t as materialized (select row_number() over () as r, *, ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')) || ' ' as x from d),
 u as (select * from t where regexp_matches(text, '\\p{{L}}')),
 g as (select r, unnest(list_transform(range(1, length(x) + 1), lambda i: substr(x, i, 1))) as s from u
  union all select r, unnest(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) from u
  union all select r, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) from u),
 c as (select r, s, count(*) as n from g where s <> ' ' and not (length(s) = 3 and substr(s, 2, 1) = ' ') group by r, s),
 k as (select s, list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(s, ''), lambda z: case when z = ' ' then 1 else cast(unicode(z) as bigint) end)), lambda a, b: a * 2097152 + b) as code from (select distinct s from c)),
 mine as (select r, code, row_number() over (partition by r order by n desc, code) - 1 as pos from c join k using (s) qualify pos < 300),
 learned as (select lang, code, row_number() over (partition by lang order by n desc, code) - 1 as place from (select lang, code, sum(n) as n from c join k using (s) join u using (r) where not held_out and lang is not null group by lang, code) qualify place < 300),
 langs as (select distinct lang from learned),
 far as (select r, l.lang, sum(coalesce(abs(place - pos), 300)) as distance, count(*) as size from mine m cross join langs l left join learned e on e.lang = l.lang and e.code = m.code group by r, l.lang),
 best as (select r, lang, distance, size from far qualify row_number() over (partition by r order by distance, lang) = 1)
 select doc_id, held_out, coalesce(best.lang, 'und') as lang_pred, coalesce(1.0::double - distance::double / (size * 300), 0.0::double) as score from t left join best using (r)"""

# runs of a period are islands of words that equal the word one period on; of such stretches that lie in one of a smaller
# period, the period is a multiple and no smallest one
RUNS = f"""with crc as (select {_CRC_TABLE} as crc_table),
 a as (select doc_id, {_WORDS} as w, {_crc('doc_id')} as h from documents, crc),
 b as (select *, len(w) as n, h // 10 as g from a),
 c as (select *, case when h % 10 = 0 and n > 0 then g % n end as a, case when h % 10 = 0 and n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from b),
 d as (select doc_id, n, case when p is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from c),
 e as (select doc_id, n, unnest(w) as word, unnest(range(0, n)) as i from d),
 f as (select x.doc_id, x.i, y.i - x.i as q from e x join e y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
 s as (select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from f) group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
 runs as (select * from s x where not exists (select 1 from s y where y.doc_id = x.doc_id and y.q < x.q and y.start <= x.start and y.start + y.length >= x.start + x.length)),
 best as (select * from runs qualify row_number() over (partition by doc_id order by length desc, start, q) = 1),
 said as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as t from runs group by doc_id),
 gone as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs),
 left_over as (select doc_id, string_agg(word, ' ' order by i) as t from e where not exists (select 1 from gone where gone.doc_id = e.doc_id and gone.i = e.i) group by doc_id)
 select d.doc_id, coalesce(n_runs, 0) as n_runs, cast(start as bigint) as start, cast(length as bigint) as length, cast(q as bigint) as period, cast(1000 * length // q as bigint) as exponent_milli, sha256(coalesce(said.t, '')) as runs_sha256, sha256(coalesce(left_over.t, '')) as collapsed_sha256
 from d left join best on best.doc_id = d.doc_id left join said on said.doc_id = d.doc_id left join left_over on left_over.doc_id = d.doc_id"""

# every document goes through every order by itself
_FAIL = {
    "A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x)", "D": "regexp_matches(x, '[#$%&*|]')",
    "E": "coalesce(doc_id > min(doc_id) over (partition by x), false)",
}
AUDIT = f"""with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as x, {_WORDS} as w from documents),
 marks as (select doc_id, max(quality) filter (quality = 1) as good, max(toxic) filter (toxic = 1) as toxic from labels group by doc_id),
 j as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {', '.join(f'{v} as f{k}' for k, v in _FAIL.items())} from d left join marks using (doc_id)),
 k as (select part, fA, fB, fC, fD, fE, count(*) as n, sum(good) as good, sum(toxic) as toxic from j group by all),
 perms(o) as (select '' union all select o || f from perms, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(o, f)),
 orders as (select o as filter_order from perms where length(o) = 5),
 fails as (select *, concat(case when fA then 'A' else '' end, case when fB then 'B' else '' end, case when fC then 'C' else '' end, case when fD then 'D' else '' end, case when fE then 'E' else '' end) as failing from k),
 went as (select part, filter_order, n, good, toxic, failing, coalesce(list_min(list_transform(string_split(failing, ''), lambda z: case when z = '' then null else strpos(filter_order, z) end)), 9) as went_at from fails, orders),
 steps as (select part, filter_order, step, sum(n) filter (went_at > step) as kept, sum(n) filter (went_at = step) as removed, sum(n) filter (contains(failing, filter_order[step]) and went_at < step) as redundant,
  sum(n) filter (failing = filter_order[step]) as unique_fails, sum(good) filter (went_at = step) as good_lost, sum(toxic) filter (went_at = step) as toxic_lost from went, (select unnest(range(1, 6)) as step) group by part, filter_order, step)
 select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
 cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, filter_order[step]) as bigint) as shapley from steps"""
