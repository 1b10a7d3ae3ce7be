"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from climspark.llm.collocations import MIN_COUNT, REPLACED, SCALE, TOP
from climspark.llm.quality import COUNTED, EPSILON, FENCES, LOOSEN, NOISE, PRIOR, SPREAD
from climspark.llm.sharding import SEED, SHARDS
from climspark.llm.urls import DAMPING, ROUNDS, RULES, THRESHOLD

# Words of the contract, with only A-Z put into lower case.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
LOWER = f"translate(coalesce(text, ''), {_AZ})"
ALNUM_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# --- op2: rules as a table; the ranks' rounds written out.

_HOST = rf"coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '')"
_HREF = r"""(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)"""
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _ranked(name: str, column: str, src: str, dst: str) -> str:
    """CTEs for one personalised rank; the last is ``<name>``."""
    parts = [
        f"{name}_all as materialized (select sum({column}) as total from counts)",
        f"{name}_seed as materialized (select host, {column} / greatest(total, 1) as seed from counts, {name}_all where {column} > 0)",
        f"{name}_share as materialized (select {src} as src, {dst} as dst, n / sum(n) over (partition by {src}) as share from edges)",
        f"{name}_0 as materialized (select host, seed as mass from {name}_seed)",
    ]
    for i in range(ROUNDS):
        parts += [
            f"{name}_got{i} as materialized (select dst as host, {DAMPING} * sum(share * mass) as got "
            f"from {name}_share join {name}_{i} on src = host group by dst)",
            f"{name}_{i + 1} as materialized (select host, coalesce(got, 0) + coalesce(seed, 0) * "
            f"(1 - coalesce((select sum(got) from {name}_got{i}), 0)) as mass "
            f"from {name}_got{i} full join {name}_seed using (host))",
        ]
    parts.append(f"{name} as (select host, mass * total as {name} from {name}_{ROUNDS}, {name}_all)")
    return ",\n".join(parts)


OP2 = rf"""
with urls as (
  select page_id, {_HOST} as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, html from pages),
rules as (select * from (values {_RULES}) as r(says, h, p)),
fitting as (
  select page_id, max_by(h || p, length(h || p)) as rule, max_by(says, length(h || p)) as says
  from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id),
judged as (select u.page_id, host, path, rule, says from urls u left join fitting f on f.page_id = u.page_id),
counts as materialized (
  select host, sum((says = 'allow')::int) as allowed, sum((says = 'block')::int) as blocked
  from judged where says is not null group by host),
links as (
  select host as src, unnest(regexp_extract_all(coalesce(html, ''), '{_HREF}', 1)) as link from urls),
edges as materialized (
  select src, dst, count(*) as n from (
    select src, coalesce(translate(regexp_extract(case when starts_with(link, '//') then ':' || link else link end,
                                                  '://([^/?#]*)', 1), {_AZ}), '') as dst
    from links where contains(link, '//'))
  where src <> '' and dst <> '' and src <> dst group by src, dst),
{_ranked("trust", "allowed", "src", "dst")},
{_ranked("distrust", "blocked", "dst", "src")},
hosts as (select host, coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust
          from trust full join distrust using (host))
select page_id, host, path, rule,
       coalesce(says, case when distrust > trust * {THRESHOLD} then 'block' end, 'allow') as verdict,
       round(coalesce(trust, 0), 6) as trust, round(coalesce(distrust, 0), 6) as distrust
from judged left join hosts using (host)
"""

# --- op3: windows of the benchmark are looked up among the documents' windows of the same length.

OP3 = f"""
with items as (select cast(item_id as varchar) as item, {ALNUM_WORDS} as w from benchmark),
sized as (select item, w, least(13, len(w)) as n from items where len(w) > 0),
windows as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
lengths as (select distinct n from windows),
docs as (select doc_id, {ALNUM_WORDS} as w from documents),
places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)),
found as (select distinct doc_id, item, n, i from places join windows using (n, win)),
hit as (select doc_id, count(distinct j) as n_hit
        from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
          from (select distinct doc_id, item from found where item is not null) group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit on hit.doc_id = docs.doc_id left join named on named.doc_id = docs.doc_id
"""

# --- op4: the two orders by row numbers; crc32 byte by byte over its table, which eight steps a value make.

_STEP = "case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end"

_CRC_TABLE = f"""recursive steps(v, c, k) as (
  select range, range, 0 from range(256)
  union all select v, {_STEP}, k + 1 from steps where k < 8),
crc_table as (select list(c order by v) as t from steps where k = 8)"""

OP4 = f"""
with {_CRC_TABLE},
texts as (select doc_id, source, coalesce(text, '') as text from documents),
digits as (
  select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) as b
  from texts),
crcs as (
  select doc_id,
         xor(list_reduce(list_prepend(cast(4294967295 as bigint), b),
                         lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) as text_crc32
  from digits, crc_table),
keyed as (
  select doc_id, source, octet_length(encode(text)) + 1 as size,
         md5('{SEED}|' || cast(doc_id as varchar)) as key from texts),
ranked as (
  select *, (2 * row_number() over (partition by source order by key) - 1) / (2 * count(*) over (partition by source)) as fraction
  from keyed),
placed as (
  select *, row_number() over (order by fraction, key) - 1 as place, count(*) over () as total from ranked),
cut as (select *, (place * {SHARDS}) // total as shard from placed)
select cut.doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law,
       cast(shard as int) as shard, cast(place - ((shard * total + {SHARDS - 1}) // {SHARDS}) as bigint) as slot,
       cast(null as int) as grown_shard
from cut join crcs using (doc_id)
"""

# --- op9: repeated windows by counting, quantiles by rank.

_WORDS9 = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_QUANTILES = ", ".join(
    [f"quantile_disc(({c} + {p}) / ({of} + {2 * p}), [0.1, 0.5, 0.9]) as q_{m}" for m, (c, of, p) in COUNTED.items()]
    + ["quantile_disc(log_length, [0.1, 0.5, 0.9]) as q_lengths"]
)


def _fence9(m: str) -> str:
    """Condition that a document lies within the fence of ``m``; null measures do."""
    q, sign = f"q_{m if m in COUNTED else 'lengths'}", "-" if m == "shorter" else "+"
    way = "{0}[2] - {0}[1]" if m == "shorter" else "{0}[3] - {0}[2]"
    own, all_ = way.format(f"g.{q}"), way.format(f"o.{q}")
    most = f"{LOOSEN} * ({all_})" + (f" + g.{q}[2]" if m in COUNTED else "")
    fence = (f"(coalesce(g.n, 0) * coalesce(g.{q}[2] {sign} {SPREAD} * least({own}, {most}), 0)"
             f" + {PRIOR} * (o.{q}[2] {sign} {SPREAD} * ({all_}))) / (coalesce(g.n, 0) + {PRIOR})")
    if m in COUNTED:
        count, of, pseudo = COUNTED[m]
        return f"not coalesce(({count} - {2 * pseudo}) / ({of} + {2 * pseudo}) - {fence} > {EPSILON:.9f}, false)"
    return f"not coalesce({sign}(log_length - {fence}) - {NOISE} / sqrt(nullif(n_words, 0)) > {EPSILON:.9f}, false)"


OP9 = rf"""
with docs as (select doc_id, lang, source, coalesce(text, '') as text from documents),
counted as (
  select doc_id, lang, source, {_WORDS9} as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols
  from docs),
windows as (
  select doc_id, i, array_to_string(w[i : i + 7], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from counted)),
repeated as (
  select doc_id, count(distinct j) as n from (
    select doc_id, unnest(range(i, i + 8)) as j from (
      select doc_id, i, count(*) over (partition by doc_id, win) as c from windows) where c > 1)
  group by doc_id),
basic as (
  select c.doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(n_symbols as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
  from counted c left join repeated r on r.doc_id = c.doc_id),
ratios as (
  select *, ln(nullif(word_chars, 0) / nullif(n_words, 0)) as log_length,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
  from basic),
grouped as (select lang, source, count(*) as n, {_QUANTILES} from ratios where not base_failed group by lang, source),
overall as (select {_QUANTILES} from ratios where not base_failed)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(_fence9(m) for m in FENCES)} as kept
from ratios r left join grouped g on g.lang is not distinct from r.lang and g.source is not distinct from r.source, overall o
"""

# --- op11: every phrase counted; cuts and longer phrases by joins.

OP11 = rf"""
with docs as (select coalesce(lang, 'und') as lang, {LOWER} as text from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from split group by lang),
phrases as (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i
        from split, (select unnest(range(1, 5)) as size) where len(w) >= size)),
frequent as (
  select lang, size, phrase, count(*) as f from phrases group by lang, size, phrase having count(*) >= {MIN_COUNT}),
cuts as (
  select lang, phrase, f as a, k, array_to_string(w[:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from frequent where size > 1)),
scored as (
  select c.lang, c.phrase, a, k, l.f as l, r.f as r, cast(({SCALE}::hugeint * a) // (l.f + r.f) as bigint) as score
  from cuts c join frequent l on l.lang = c.lang and l.phrase = first join frequent r on r.lang = c.lang and r.phrase = rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, array_to_string(w[i : i + s - 1], ' ') as phrase, max(f) as held
  from (select lang, f, w, s, unnest(range(1, len(w) - s + 2)) as i
        from (select *, string_split(phrase, ' ') as w, unnest(range(2, size)) as s from frequent where size > 2))
  group by all),
kept as (
  select b.* from best b left join inner_ i on i.lang = b.lang and i.phrase = b.phrase
  where coalesce(100::hugeint * held < {REPLACED}::hugeint * a, true)),
ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= {TOP}
"""

# --- op13: nodes as lists of turns; every node's own figures go to each of its prefixes.

OP13 = rf"""
with {_CRC_TABLE},
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
ids as (
  select conv_id, list_transform(regexp_extract_all(hex(encode(cast(conv_id as varchar))), '..'),
                                 lambda x: cast('0x' || x as bigint)) as b
  from (select distinct conv_id from turns)),
convs as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_prepend(cast(4294967295 as bigint), b),
                         lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 4 as h
  from ids, crc_table),
rebuilt as (
  select c.conv_id, 0 as part, pos, role, text from convs c join turns t on t.conv_id = c.base and pos < h
  union all select c.conv_id, 1, pos, role, text from convs c join turns t on t.conv_id = c.conv_id and pos >= h),
sequences as (
  select conv_id, list(struct_pack(role := role, text := text) order by part, pos) as seq from rebuilt group by conv_id),
whole as (select conv_id, coalesce(seq, []) as seq from convs left join sequences using (conv_id)),
paths as (
  select conv_id, d, seq[1:d] as node, len(seq) = d as ends,
         case when d > 0 then len(regexp_extract_all(seq[d].text, '[^\x20\x09-\x0D]+')) else 0 end as words
  from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from whole)),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
         coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as ends
  from paths group by node, d),
linked as (
  select n.*, p.conv_id as parent from nodes n left join nodes p on p.d = n.d - 1 and p.node = n.node[1:n.d - 1]),
kids as (select parent as conv_id, d - 1 as d, count(*) as n_children from linked where d > 0 group by parent, d),
own as (
  select l.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saving
  from linked l left join kids k on k.conv_id = l.conv_id and k.d = l.d),
above as (select p.conv_id as member, p.d, n.conv_id from paths p join nodes n on n.d = p.d and n.node = p.node),
totals as (
  select a.conv_id, a.d, sum(saving) as saved, sum((n_children = 0)::int) as leaves
  from own o join above a on a.member = o.conv_id and a.d <= o.d group by a.conv_id, a.d)
select o.conv_id, cast(o.d as bigint) as depth, case when o.d > 0 then parent end as parent_conv_id, n_convs, n_children,
       cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from own o join totals t on t.conv_id = o.conv_id and t.d = o.d
"""

ORACLE: dict[str, str] = {
    "op2_urls": OP2,
    "op3_decontaminate": OP3,
    "op4_sharding": OP4,
    "op9_quality": OP9,
    "op11_collocations": OP11,
    "op13_prefix_trie": OP13,
}
