"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from trailmark.llm import chat, licenses, mixing, warc, winnow
from trailmark.llm.common import UPPER


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lower_sql(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


def op1(base_ts: int, delay: int) -> str:
    rest = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    return f"""
with p as (
  select page_id, {rest} as rest, {base_ts} + page_id * 60 as t0,
         '"' || substr(md5(html), 1, 16) || '"' as tag, sha256(html) as digest, strlen(html) as len
  from pages
), u as (
  select *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as base,
         list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'),
                   lambda x: x <> '' and not regexp_matches(x, {quoted(warc.TRACKING)}))) as ps
  from p
), c as (
  select *, base || case when len(ps) > 0 then '?' || array_to_string(ps, '&') else '' end as canon from u
), rev as (
  select page_id, canon, case when page_id % 13 = 0 then t0 - 1 else t0 + {delay} end as ts,
         case when page_id % 7 = 0 then '"stale"' when page_id % 5 = 0 or page_id % 11 = 0 then null else 'W/' || tag end as tag,
         case when page_id % 11 = 0 then null else t0::varchar end as lm
  from c
), hit as (
  select rev.*, max(row(c.t0, c.page_id)) as ref
  from rev left join c on c.canon = rev.canon and c.t0 < rev.ts
  group by all
), j as (
  select hit.*, c.page_id as ref_page, c.t0 as ref_t, c.tag as ref_tag, c.t0::varchar as ref_lm, c.digest, c.len as ref_len,
         case when c.page_id is null then 'no_earlier_response'
              when hit.tag is null and hit.lm is null then 'unverified'
              when hit.tag is not null and replace(hit.tag, 'W/', '') = c.tag then 'resolved'
              when hit.tag is null and hit.lm = c.t0::varchar then 'resolved'
              else 'validator_mismatch' end as outcome
  from hit left join c on c.page_id = ref[2] and c.t0 = ref[1]
)
select 2 * page_id + 1 as record_id, canon as canonical_url, ts, outcome, 2 * ref_page as ref_id, ref_t as ref_ts,
       case when outcome = 'resolved' then digest end as payload_digest,
       case when outcome = 'resolved' then
         'Set-Cookie: sid=' || ref_page || chr(10) || 'Date: ' || ts || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(10)
         || 'Content-Length: ' || ref_len || chr(10) || 'ETag: ' || coalesce(tag, ref_tag) || chr(10) || 'Set-Cookie: a=1' || chr(10)
         || 'cache-control: max-age=60' || chr(10) || 'Last-Modified: ' || ref_lm || chr(10) || 'Vary: Accept' end as headers
from j
"""


def op3(window: int = winnow.WINDOW) -> str:
    words = f"regexp_extract_all({lower_sql("coalesce(text, '')")}, {quoted(winnow.WORD)})"
    return f"""
with d as (
  select row_number() over () as k, doc_id, {words} as w from documents
), b as (
  select item_id::varchar as item, {words} as w from benchmark
), bw as (
  select distinct item, n, array_to_string(w[i + 1:i + n], ' ') as win
  from (select item, w, least(len(w), {window}) as n, unnest(range(0, len(w) - least(len(w), {window}) + 1)) as i from b where len(w) > 0)
), ns as (
  select distinct n from bw
), dw as (
  select k, i, n, array_to_string(w[i + 1:i + n], ' ') as win
  from (select k, w, n, unnest(range(0, len(w) - n + 1)) as i from d, ns where len(w) >= n)
), hit as (
  select k, i, n, item from dw join bw using (n, win)
), pos as (
  select k, count(distinct p) as n_hit from (select k, unnest(range(i, i + n)) as p from hit) group by k
), it as (
  select k, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, item from hit) group by k
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (k) left join it using (k)
"""


def op4(t: chat.Template = chat.Template()) -> str:
    def esc(x: str) -> str:
        return rf"regexp_replace({x}, '([<\[\\])', '\1\\', 'g')"

    fixed = len(t.open) + len(t.after_role) + len(t.close)
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), w as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
         coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text), 'start') as before
  from c
), m as (
  select *, not ((before = 'start' and role in ('system', 'user')) or (before in ('system', 'assistant') and role = 'user')
                 or (before = 'user' and role = 'assistant')) as bad from w
), g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by n) as alltext,
         coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '') as loss,
         sum({fixed} + length(replace({esc("role")}, chr(10), '[n')) + length({esc("text")})) as formatted_chars,
         min(n) filter (where bad) as first_bad, arg_max(role, n) as final_role
  from m group by conv_id
)
select conv_id, n_turns, sha256(alltext) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars::bigint as formatted_chars, first_bad is null and final_role = 'assistant' as valid,
       first_bad::int as first_bad_turn
from g
"""


def crc32_sql(octets: str) -> str:
    """CRC-32 of a list of octets, four bits at a time; the table follows from the polynomial."""
    rest = list(range(16))
    for _ in range(4):
        rest = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in rest]
    held = "[" + ", ".join(f"{c}::bigint" for c in rest) + "]"

    def step(c: str, x: str) -> str:
        return f"xor({c} >> 4, {held}[(xor({c}, {x}) & 15) + 1])"

    return f"xor(list_reduce({octets}, lambda a, x: {step(step('a', 'x'), '(x >> 4)')}, 4294967295::bigint), 4294967295::bigint)"


def op5(shards: int, slots: int, parts: int) -> str:
    """Slots, or pieces of them, largest first, each to the least loaded shard: a recursion with one step a piece."""
    crc = crc32_sql("list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::bigint)")
    return f"""
with recursive c as materialized (
  select doc_id, coalesce(strlen(text), 0)::bigint + 1 as size, {crc} as crc from documents
), h as materialized (
  select *, (('0x' || substr(md5(concat_ws(':', doc_id::varchar, crc::varchar)), 1, 8))::bigint % {slots})::int as vslot from c
), w as (
  select *, row_number() over (partition by vslot order by doc_id nulls first, crc nulls first, size) - 1 as inside, count(*) over (partition by vslot) as n,
         (sum(size) over (partition by vslot) * {shards * parts})::bigint as share, (sum(size) over ())::bigint as total from h
), d as materialized (
  select *, (inside * case when share <= total then 1 else least(n, (ceil(ceil(share / total) / {shards}) * {shards})::bigint) end // n)::int as piece from w
), s as materialized (
  select v::int as vslot, coalesce(piece, 0) as piece, coalesce(sum(size), 0)::bigint as bytes, count(size) as n, row_number() over (order by coalesce(sum(size), 0) desc, v, coalesce(piece, 0)) as k
  from range({slots}) t(v) left join d on d.vslot = t.v group by v, piece
), g as (
  select 0::bigint as k, 0 as at, list_transform(range({shards}), lambda i: 0::bigint) as loads
  union all
  select s.k, list_position(g.loads, list_min(g.loads))::int - 1,
         list_transform(g.loads, lambda v, i: case when i = list_position(g.loads, list_min(g.loads)) then v + s.bytes else v end)
  from g join s on s.k = g.k + 1
), m as (
  select s.vslot, s.piece, g.at as shard, coalesce(sum(s.n) over (partition by g.at order by s.vslot, s.piece rows between unbounded preceding and 1 preceding), 0) as start,
         case when sum(s.bytes) over (partition by g.at order by s.vslot, s.piece) * {shards + 1} <= sum(s.bytes) over (partition by g.at) * {shards} then g.at else {shards} end as next_shard
  from g join s using (k)
)
select doc_id, size, crc as text_crc32, 'bytes' as law, shard,
       (start + row_number() over (partition by vslot, piece order by inside) - 1)::bigint as slot, null::int as grown_shard, vslot, piece, next_shard::int as next_shard
from d join m using (vslot, piece)
"""


def op6(marginals: dict[str, mixing.Marginal], keep: float, rules, default: str, sweeps: int, salt: str) -> str:
    topic = " ".join(f"when regexp_matches(text, {quoted(p)}) then {quoted(n)}" for n, p in rules)
    out = [
        f"d as (select doc_id, coalesce(source, '') as _source, coalesce(lang, '') as _lang, "
        f"case {topic} else {quoted(default)} end as _topic, "
        f"coalesce(len(regexp_extract_all(text, {quoted(mixing.WORD)})), 0)::bigint as n_tokens from "
        f"(select doc_id, source, lang, coalesce(text, '') as text from documents))",
        "c0 as (select * from (select _source, _lang, _topic, sum(n_tokens)::double as n from d group by all) where n > 0)",
    ]
    for label, m in marginals.items():
        if m.power is not None:
            raw = f"pow(m, {m.power!r})"
        else:
            case = " ".join(f"when {quoted(k)} then {v!r}::double" for k, v in m.shares.items() if k != "other")
            names = ", ".join(quoted(k) for k in m.shares if k != "other")
            other = float(m.shares.get("other", 0.0))
            raw = f"coalesce(case when {label} in ({names}) then case {label} {case} end else {other!r} * m / sum(case when {label} not in ({names}) then m end) over () end, 0.0)"
        out.append(f"t{label} as (select {label}, raw / sum(raw) over () as t from (select {label}, {raw} as raw from (select {label}, sum(n) as m from c0 group by {label})))")
    out.append("w0 as (select c0.*, n as w from c0)")
    k = 0
    for _ in range(sweeps):
        for label in marginals:
            out.append(f"w{k + 1} as materialized (select _source, _lang, _topic, n, case when s > 0 then w * t / s else 0.0 end as w from (select w{k}.*, sum(w) over (partition by {label}) as s from w{k}) x join t{label} using ({label}))")
            k += 1
    out += [
        "gap as (select max(abs(s - t)) as residual from (" + " union all ".join(f"select sum(w) as s, any_value(t) as t from w{k} join t{label} using ({label}) group by {label}" for label in marginals) + "))",
        f"r as (select *, w / n as r from w{k})",
        f"f as (select *, ({keep!r} * sum(n) over () - coalesce(sum(n) over q, 0)) / nullif(case when sum(w) over () - coalesce(sum(w) over q, 0) > 1e-15 then sum(w) over () - coalesce(sum(w) over q, 0) else 0 end, 0) as f from r window q as (order by r desc, _lang, _source, _topic rows between unbounded preceding and 1 preceding))",
        "g as (select arg_min(f, -r) filter (where f * r <= 1.0) as factor from f)",
        "ch as (select _source, _lang, _topic, w, case when factor is null then case when w > 0 then 1.0 else 0.0 end else least(1.0, greatest(0.0, factor * r)) end as p from f, g)",
    ]
    draw = f"(('0x' || substr(md5(concat_ws(':', coalesce(doc_id::varchar, ''), {quoted(salt)})), 1, 12))::bigint::double / {float(16**12)!r})"
    return (
        "with " + ",\n".join(out) + f"\nselect doc_id, _source as source, _lang as lang, _topic as topic, n_tokens, "
        f"round(coalesce(w, 0.0), 6) as weight, round(coalesce(p, 0.0), 6) as probability, {draw} < coalesce(p, 0.0) as kept, case when w is not null then round((select residual from gap), 6) end as residual "
        "from d left join ch using (_source, _lang, _topic)"
    )


def op8() -> str:
    """Lines are joined and sentences cut as by the operator; rules are matched by patterns over the joined identifiers."""
    marks, gaps, head, hint = (quoted(x) for x in (licenses.MARKS, licenses.GAPS, licenses.HEAD, f"(?i){licenses.HINT}"))
    opening, closing = (quoted(re.sub(r"([+*?])\+", r"\1", x)) for x in (licenses.OPENING, licenses.CLOSING_BACKWARDS))

    def normalised(x: str) -> str:
        return f"regexp_replace(trim(regexp_replace(regexp_replace({lower_sql(x)}, {marks}, '', 'g'), {gaps}, ' ', 'g')), {head}, '')"

    def covers(entries, more: str = "") -> str:
        return " ".join(f"when regexp_full_match(s, {quoted(p)}){more} then {quoted(n)}" for n, p in entries)

    case = " ".join((covers(licenses.TAGS), covers(licenses.GRANTS, f" and not regexp_matches(s, {quoted(licenses.DENIAL)})"), covers(licenses.SENTENCES)))
    notice = f"(regexp_matches(s, {quoted(licenses.NOTICE)}) and not regexp_matches(s, {quoted(licenses.NO_NOTICE)}))"
    hinted = f"regexp_matches(bare, {hint})"
    opens = f"regexp_matches(s, {quoted(f'^(?:{licenses.OPENERS})')}) or ({hinted} and ({notice} or regexp_matches(s, {quoted(licenses.STARTS)})))"
    closes = f"{hinted} and ({notice} or regexp_matches(s, {quoted(licenses.ENDS)}))"
    line, held = "chr(10)", "chr(57599)"
    version = "(^|[^0-9A-Za-z_])([A-Zv])\\."
    cut = f"regexp_replace(regexp_replace(u, '{version}', '\\1\\2' || {held}, 'g'), '{version}', '\\1\\2' || {held}, 'g')"
    cut = f"regexp_replace(regexp_replace({cut}, '[.!?](\\s|$)', {line}, 'g'), '(conditions|are met):\\s', '\\1' || {line}, 'g')"
    cut = f"replace({cut}, {held}, '.')"
    for _ in range(3):
        cut = f"regexp_replace({cut}, {quoted(licenses.OPERATOR)}, '\\1 \\2' || {line} || '\\1 ', 'g')"
    gap = f"(?:,(?:{'|'.join(map(re.escape, licenses.BETWEEN))}),)*"
    rules = ", ".join(f"({k}, {quoted(name)}, {quoted(gap.join(f',{re.escape(i)},' for i in run))})" for k, (name, run) in enumerate(licenses.RULES))
    return f"""with recursive d as materialized (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
a as (select k, unnest(ls) as raw, generate_subscripts(ls, 1) as i from (select k, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from d where regexp_matches(text, {hint}))),
b as (select k, i, reverse(regexp_replace(reverse(regexp_replace(raw, {opening}, '')), {closing}, '')) as bare from a),
c as (select k, i, bare, {normalised("regexp_replace(bare, '[.!?]\\s*$', '')")} as s from b),
j as (select k, string_agg(case when not regexp_matches(bare, '[\\p{{L}}\\p{{N}}]') then {line}
  else case when {opens} then {line} else '' end || bare || case when {closes} then {line} else ' ' end end, '' order by i) as u from c group by k),
e as (select k, list_filter(regexp_split_to_array({cut}, '\\n+'), lambda s: regexp_matches(s, {hint})) as ss from j),
f as (select k, unnest(ss) as s, generate_subscripts(ss, 1) as i from e),
n as (select k, i, {normalised('s')} as s from f),
m as materialized (select k, list(case {case} else '?' end order by i) as ids from n group by k),
r(step, name, run) as (values {rules}),
l(k, step, t, names) as (select k, 0, array_to_string(list_transform(ids, lambda i: ',' || i || ','), ''), []::varchar[] from m
  union all select k, l.step + 1, case when regexp_matches(t, run) then regexp_replace(t, run, ',-,', 'g') else t end, case when regexp_matches(t, run) then list_append(names, name) else names end from l join r on r.step = l.step),
z as (select k, names from l where step = {len(licenses.RULES)})
select doc_id, case when len(names) > 0 then array_to_string(list_sort(list_distinct(names)), ',')
       when len(list_filter(ids, lambda i: i = '?')) > 0 then 'UNKNOWN' else 'NONE' end as licences,
       coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(len(ids), 0)::bigint as n_licence_sentences,
       coalesce(len(list_filter(ids, lambda i: i = '?')), 0)::bigint as n_unknown
from d left join m using (k) left join z using (k)"""


def op12() -> str:
    return """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id as id, list_inner_product(a.v, r.v)::bigint as score from r a join r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id, score from (select *, row_number() over (partition by anchor_id order by score desc, id) as k from s where same) where k <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
