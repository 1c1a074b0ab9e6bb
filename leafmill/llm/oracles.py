"""SQL for the rows of those queries that SQL can express (over tables whose ids are unique)."""

from __future__ import annotations

from leafmill.llm.linefreq import LOWER, UPPER

#: chr() for what a literal cannot show.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_FREQUENCY = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, hash(text) as whole from documents),
w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
wins as (
  select doc_id, p, array_to_string(w[p : p + 4], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from w where len(w) >= 5)),
twice as (select doc_id, win from wins group by all having count(*) >= 2),
covered as (
  select doc_id, count(distinct p + k) as n from wins join twice using (doc_id, win), unnest(range(0, 5)) u(k) group by doc_id),
raw_lines as (
  select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where length(translate(line, {_BLANKS}, '')) > 0),
dups as (select doc_id, count(*) - count(distinct line) as n from raw_lines group by doc_id),
norm as (
  select doc_id, source, whole, trim(line) as line from (
    select doc_id, source, whole, unnest(string_split(regexp_replace(translate(text,
      '{UPPER}123456789' || chr(9) || chr(11) || chr(12) || chr(13), '{LOWER}{"0" * 9}    '), ' {{2,}}', ' ', 'g'), chr(10))) as line
    from d)
  where trim(line) <> ''),
sizes as (select source, count(distinct whole) as host_docs from d group by source),
above as (
  select source, line from norm join sizes using (source) group by source, line, host_docs
  having count(distinct whole) > 10 and count(distinct whole) > 0.05 * host_docs),
gone as (
  select doc_id, count(*) as lines, sum(length(line) - length(replace(line, ' ', '')) + 1) as words
  from norm join above using (source, line) group by doc_id),
rows as (
  select d.doc_id, len(w)::bigint as n_words, length(translate(text, {_BLANKS}, ''))::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dups.n, 0)::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(gone.lines, 0)::bigint as n_lines_removed,
    coalesce(gone.words, 0)::bigint as n_words_removed
  from d join w using (doc_id) left join dups using (doc_id) left join covered using (doc_id) left join gone using (doc_id)),
based as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from rows)
select *, not base_failed and not (n_lines_removed > 0 and (n_words - n_words_removed < 10 or n_words_removed > 0.5 * n_words)) as kept
from based
"""

FILL_IN_MIDDLE = """
with seeds as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(doc_id::varchar, '')) as seed
  from documents),
drawn as (
  select doc_id, text, units, len(units) as n,
    list_transform([0, 1, 2, 3], lambda j: list_sum(list_transform(range(0, 8),
      lambda i: (instr('0123456789abcdef', substr(seed, 8 * j + i + 1, 1)) - 1) * (16 ** (7 - i))::bigint))::bigint) as h
  from seeds),
cut as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as low, greatest(h[1] % (n + 1), h[2] % (n + 1)) as high,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain'
      when h[4] % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(units[1 : low], '') as prefix, array_to_string(units[low + 1 : high], '') as middle, array_to_string(units[high + 1 : ], '') as suffix
  from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from parts
"""

#: The check sum runs over bytes: of ASCII one a character, of the other letters two, 195 first.
SPELLING = f"""
with recursive steps as (
  select list(c order by b) as t from (
    select b, list_reduce(list_prepend(b::bigint, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(0, 256) r(b))),
runs as (
  select doc_id, run, count(*) as times from (
    select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents)
  group by all),
bytes as (
  select run, times, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] else [195, (unicode(ch) - 64)::bigint] end)) as bytes
  from runs),
sums as (
  select run, times, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as h
  from bytes, steps),
words as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from sums),
vocab as (select word, sum(times)::bigint as n from words where length(word) >= 5 group by word having sum(times) >= 3),
places as (select word, n, unnest(range(0, length(word))) as i from vocab),
cards as (select word, n, i, substr(word, 1, i) as head, substr(word, i + 2) as tail from places),
pairs as (
  select a.word, b.word as near, b.n as near_n from cards a join cards b using (i, head, tail) where a.word <> b.word
  union select c.word, v.word, v.n from cards c join vocab v on v.word = c.head || c.tail
  union select v.word, c.word, c.n from cards c join vocab v on v.word = c.head || c.tail),
best as (
  select word, count(*)::bigint as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from pairs group by word),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * n then near end as form, case when near_n >= 2 * n then near_n end as form_n
  from vocab v left join best using (word)),
chains as (
  select word, form, form as at from forms where form is not null
  union all select c.word, c.form, f.form from chains c join forms f on f.word = c.at where f.form is not null),
ends as (select c.word, c.at from chains c join forms f on f.word = c.at where f.form is null)
select word, form, coalesce(e.at, word) as root, n, n_near, form_n from forms left join ends e using (word)
"""
