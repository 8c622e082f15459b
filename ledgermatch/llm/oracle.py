"""The queries of ``queries.py`` that SQL can express, for DuckDB: written from the definitions, pair by pair and word by word.

The trained models (1, 3), the tokenizer (5), the iterated pattern scores (9) and the pipeline have no SQL; tests compare those with
held-out labels, the public library and plain versions.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_SAID = "<|im_end|><|im_start|>assistant ok"

_CHAT = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')
), m as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) <> role, true) as opens,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') as escaped,
    replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') as shown
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(escaped) + case when opens then length('<|im_start|>' || shown || chr(10) || '<|im_end|>' || chr(10)) else length('<|im_join|>') end) as bigint) as formatted_chars
from m group by conv_id
"""


def _places(kind: str, pattern: str, keep: str) -> str:
    """Spans of one kind: the running lengths of the matches and of the text between them."""
    return rf"""
  select doc_id, '{kind}' as kind, cast(a as integer) as a, cast(a + length(v) as integer) as b, v from (
    select doc_id, vs[i] as v, coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0) as a
    from (select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as vs, string_split_regex(coalesce(text, ''), '{pattern}') as gs from documents) m,
      unnest(range(1, len(vs) + 1)) as u(i)
  ) p where {keep}"""


_NAMED = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_VALUE = rf"regexp_replace(v, '^{_NAMED}', '')"
_SECRETS = f"""
with base as ({_places("assign", _NAMED + "[A-Za-z0-9+/_.=-]+", f"length({_VALUE}) >= 8")}
  union all {_places("access", "AKIA[A-Z0-9]+", "length(v) >= 16")}
  union all {_places("hex", "[0-9a-f]+", "length(v) >= 32")}
), shaped as ({_places("live", "[A-Za-z0-9+/_=-]{20,}", "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')")}
), more as (
  select * from shaped s where not exists (select 1 from base b where b.doc_id = s.doc_id and s.a < b.b and b.a < s.b)
), seen as (
  select *, {_VALUE} as value from (select * from base union all select * from more)
), placed as (
  select value, text, min(struct_pack(known := source is not null, source := coalesce(source, ''), repo := cast(doc_id as varchar))) as place from seen join documents using (doc_id) group by all
), held as (
  select value, place.known as known, place.source as source, count(distinct place.repo) as n from placed group by all
), owned as (
  select value, sum(n) * sum(n) * 2 <= sum(n * n) * 3 as live from held group by value
), judged as (
  select doc_id, count(*) filter (live) as n_live, count(*) filter (not live) as n_example from seen join owned using (value) group by doc_id
), shown as (
  select doc_id, kind, a, b from base union all select doc_id, kind, a, b from more join owned on value = v where live
), joined as (
  select doc_id, string_agg(kind || ':' || a || ':' || b, ',' order by a, list_position(['assign', 'access', 'hex', 'live'], kind), b) as spans,
    coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, list_position(['assign', 'access', 'hex'], kind), b) filter (kind <> 'live'), '') as listed,
    count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex
  from shown group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(listed, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from documents left join joined using (doc_id) left join judged using (doc_id)
"""

_WORDS = f"words as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents)"

_JACCARD = f"""
with recursive {_WORDS}, grams as (
  select distinct doc_id, array_to_string(ws[p:p + 4], ' ') as g from words, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) as u(p)
), sizes as (
  select doc_id, count(*) as n from grams group by doc_id
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by all
), links as (
  select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where s.n >= 0.8 * (x.n + y.n - s.n)
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select doc_id, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as class_id, (select count(*) from links where a = doc_id) as n_links from documents
"""

#: One row per word, without the lists that they come from.
_EACH = f"""each as materialized (
  select doc_id, i, ws[i] as word from (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as ws from documents) s, unnest(range(1, len(ws) + 1)) as u(i)
)"""
_DOUBLED = ", ".join(f"h{2 * n} as (select *, md5(h{n} || ' ' || lead(h{n}, {n}) over (partition by doc_id order by i)) as h{2 * n} from h{n})" for n in (1, 2, 4, 8, 16))

_REPEATS = f"""
with {_EACH}, h1 as (select *, word as h1 from each), {_DOUBLED}, windows as (
  select doc_id, i, word, md5(h32 || ' ' || lead(h16, 32) over (partition by doc_id order by i) || ' ' || lead(h2, 48) over (partition by doc_id order by i)) as h from h32
), firsts as (
  select h, min(doc_id) as low from windows where h is not null group by h
), marked as (
  select w.doc_id, i, word, coalesce(bool_or(low < w.doc_id) over (partition by w.doc_id order by i rows between 49 preceding and current row), false) as gone from windows w left join firsts using (h)
), counted as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from marked group by doc_id
)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join counted using (doc_id)
"""


def _quality() -> str:
    from ledgermatch.llm.quality import MOST_LINE_CHARS, MOST_REPEATED

    sizes = (3, *MOST_REPEATED)
    grams = ", ".join("word" + "".join(f" || ' ' || lead(word, {k}) over w" for k in range(1, n)) + f" as g{n}" for n in sizes)
    # of three words every occurrence counts, of more words those after the first
    twice = ", ".join(f"g{n} is not null and {'count(*)' if n == 3 else 'row_number()'} over (partition by doc_id, g{n}{'' if n == 3 else ' order by i'}) > 1 as t{n}" for n in sizes)
    cover = ", ".join(f"coalesce(bool_or(t{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row), false) as c{n}" for n in sizes)
    shares = ", ".join(f"coalesce(sum(length(word)) filter (c{n}), 0) / greatest(sum(length(word)), 1) as cover_{n}" for n in MOST_REPEATED)
    none = ", ".join(f"coalesce(cover_{n}, 0.0) as cover_{n}" for n in MOST_REPEATED)
    fine = " and ".join(f"cover_{n} <= {most}" for n, most in MOST_REPEATED.items())
    return f"""
with {_EACH}, zero as (
  select doc_id, i, word, {grams} from each window w as (partition by doc_id order by i)
), one as (
  select doc_id, i, word, {twice} from zero
), two as (
  select doc_id, i, word, {cover} from one
), three as (
  select doc_id, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars, count(*) filter (c3) as n_repeat_words, {shares} from two group by doc_id
), lines as (
  select doc_id, ls[k] as line, row_number() over (partition by doc_id, ls[k] order by k) > 1 as again
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) s, unnest(range(1, len(ls) + 1)) as u(k) where regexp_matches(ls[k], '[^\\x20\\x09-\\x0D]')
), dups as (
  select doc_id, count(*) filter (again) as n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) filter (again), 0) as dup_chars from lines group by doc_id
), all_of as (
  select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(dup_chars, 0) / greatest(coalesce(word_chars, 0), 1) as line_cover, {none}
  from documents left join three using (doc_id) left join dups using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and line_cover <= {MOST_LINE_CHARS} and {fine} as kept from all_of
"""


def _leaks() -> str:
    from ledgermatch.llm.decontam import SPAN, STRETCH, SUBSTITUTED

    plain = rf"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{{-~\x00-\x08\x0E-\x1F\x7F]', '', 'g'), {_WORD})"
    return f"""
with dw as (
  select doc_id, i, ws[i] as word from (select doc_id, {plain} as ws from documents) s, unnest(range(1, len(ws) + 1)) as u(i)
), items as (
  select item_id, len(ws) as n, least(len(ws), {STRETCH}) as size, case when len(ws) >= {STRETCH} then {SUBSTITUTED} else 0 end as wrong, ws from (select item_id, {plain} as ws from benchmark) s where len(ws) >= {SPAN}
), iw as (
  select item_id, n, size, wrong, j, ws[j] as word from items, unnest(range(1, len(ws) + 1)) as u(j)
), laid as (
  select doc_id, item_id, i - j as shift, any_value(n) as n, any_value(size) as size, any_value(wrong) as wrong, list(j) as js
  from dw join iw using (word) group by all having count(*) >= any_value(size - wrong)
), good as (
  select doc_id, item_id, shift, s, size, js from laid, unnest(range(1, n - size + 2)) as u(s) where len(list_filter(js, lambda j: j between s and s + size - 1)) >= size - wrong
), covered as (
  select doc_id, item_id, shift, count(distinct j) as words from (select doc_id, item_id, shift, unnest(list_filter(js, lambda j: j between s and s + size - 1)) as j from good) group by all
), best as (
  select doc_id, item_id, max(words) as words from covered group by all
), found as (
  select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by item_id) as item_ids, string_agg(cast(words as varchar), ',' order by item_id) as item_words from best group by doc_id
)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, coalesce(item_ids, '') as item_ids, coalesce(item_words, '') as item_words from documents left join found using (doc_id)
"""


#: CRC-32 of a text column as a list fold over its UTF-8 bytes; the table of 256 values comes from its polynomial.
_CRC_TABLE = "select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as crcs"


def _crc(text: str) -> str:
    data = f"list_transform(range(cast(octet_length(encode({text})) as bigint)), lambda i: cast(('0x' || substr(hex(encode({text})), cast(2 * i + 1 as bigint), 2)) as bigint))"
    return f"xor(list_reduce({data}, lambda c, b: xor(crcs[cast((xor(c, b) & 255) + 1 as bigint)], c >> 8), cast(4294967295 as bigint)), 4294967295)"


def _least(readings: list[str]) -> str:
    return f"list_min([{', '.join(readings)}])"


def _edit(state: str, cost: str, letter: str, line: str = "''", unless: str = "false") -> str:
    """A reading one edit further on; an impossible one costs more than all others."""
    return f"struct_pack(cost := {state}.cost + case when {unless} then 1000000 else {cost} end, audit := {state}.audit || '{letter}', said := {state}.said || {line})"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
#: Readings by what was said last: nothing (n), a system turn (s), a user (u), an assistant (a); first with inserts, then with the row.
_INSERTED = f"""n, s,
    {_least(["u", *(_edit(x, "3", "I", _USER) for x in "nsa")])} as u,
    {_least(["a", _edit("u", "3", "I", _ASSISTANT), *(_edit(x, "6", "II", f"{_USER} || {_ASSISTANT}") for x in "ns")])} as a"""
_KEPT = "chr(10) || role || ':' || text"
_BAD = "fault in ('blank', 'duplicate')"
_CUT = "case when fault = 'truncated' then 3 else 0 end"


def _keep(state: str, initial: str) -> str:
    return _edit(state, _CUT, "K", _KEPT, f"{_BAD} or role[1] <> '{initial}' or role = ''")


def _rerole(state: str, name: str) -> str:
    return _edit(state, f"3 + {_CUT}", "R", f"{name} || text", _BAD)


_REPAIR = f"""
with recursive crc as materialized ({_CRC_TABLE}), said as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fault
  from conversations, crc
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from said, unnest(case when fault = 3 then [0, 1] else [0] end) as x(copy) where fault <> 0
), placed as (
  select *, row_number() over w as place, lag(role) over w as before from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)
), judged as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault
  from placed
), start as (
  select distinct conv_id, cast(0 as bigint) as place, struct_pack(cost := 0, audit := '', said := '') as n, struct_pack(cost := 1000000, audit := '', said := '') as o from conversations
), read(conv_id, place, n, s, u, a) as (
  select conv_id, place, n, o, o, o from start
  union all
  select conv_id, place, {_edit("n", "4", "D")}, {_least([_edit("s", "4", "D"), _keep("n", "s")])},
    {_least([_edit("u", "4", "D"), *(_keep(x, "u") for x in "nsa"), *(_rerole(x, _USER) for x in "nsa")])},
    {_least([_edit("a", "4", "D"), _keep("u", "a"), _rerole("u", _ASSISTANT)])}
  from (select j.conv_id, j.place, role, text, fault, {_INSERTED} from read r join judged j on j.conv_id is not distinct from r.conv_id and j.place = r.place + 1)
), counted as (
  select conv_id, count(*) as held, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before[1] || role[1] not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
), ended as (
  select r.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    {_least(["n", "a"])} as best
  from (select conv_id, place, {_INSERTED} from read) r left join counted c on c.conv_id is not distinct from r.conv_id where r.place = coalesce(c.held, 0)
)
select conv_id, gaps, blank, duplicate, truncated, illegal, cast(best.cost as bigint) as cost, best.audit as audit, sha256(substr(best.said, 2)) as repaired_sha256 from ended
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RESAMPLING = rf"""
with crc as materialized ({_CRC_TABLE}), texts as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), said as (select doc_id, unnest(ws) as word from texts), wanted as (
  select unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
), known as (
  select word, {_crc("word")} % 10000 as bucket from (select distinct word from (select word from said union all select word from wanted)), crc
), corpus as (select bucket, count(*) as s from said join known using (word) group by bucket), target as (
  select bucket, count(*) as t from wanted join known using (word) group by bucket
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from said) + 10000.0::double) / ((s + 1.0::double) * ((select count(*) from wanted) + 10000.0::double)))) as gain
  from corpus left join target using (bucket)
), weighed as (
  select doc_id, floor(sum(gain) / count(*)) as weight from said join known using (word) join gains using (bucket) group by doc_id
), scored as (
  select doc_id, cast(len(ws) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
    cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from texts left join weighed using (doc_id)
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20
  qualify rank <= (select count(*) * 10 // 100 from scored where n_features >= 20)
)
select doc_id, n_features, weight, score, rank from scored left join ranked using (doc_id)
"""

_LINES = f"""
with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), lines as (
  select doc_id, i, ls[i] as line, {_LOWER.format("trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from texts, unnest(range(1, len(ls) + 1)) as u(i)
), repeated as (
  select key, max(doc_id) as last from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (select doc_id, i, line, coalesce(doc_id <> last, false) as gone from lines left join repeated using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by doc_id
"""

SQL: dict[str, str] = {
    "op2_chat_format": _CHAT,
    "op4_secret_scan": _SECRETS,
    "op6_jaccard_join": _JACCARD,
    "op7_substring_dedup": _REPEATS,
    "op8_quality_rules": _quality(),
    "op10_decontamination": _leaks(),
    "op11_conversation_repair": _REPAIR,
    "op12_importance_resampling": _RESAMPLING,
    "op13_line_dedup": _LINES,
}
