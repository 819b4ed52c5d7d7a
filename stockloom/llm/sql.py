"""SQL texts of operators that SQL can express, for the comparison with another engine."""

from __future__ import annotations

from stockloom.llm import line_rules

#: Check sums of the texts ``t`` of a table ``texts``, as a table ``sums`` (t, crc). A CRC is linear in the bytes: each byte adds what it
#: leaves after the bytes behind it, to what as many zero bytes leave.
CRC32 = """
crc_bits as (
  select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as x
  from (select unnest(range(256)) as b)),
crc_bytes as (
  select t, i, octet_length(encode(t)) - i as k,
    16 * (strpos('0123456789ABCDEF', substr(hex(encode(t)), 2 * i - 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(encode(t)), 2 * i, 1)) - 1 as b
  from (select t, unnest(range(1, octet_length(encode(t)) + 1)) as i from texts)),
crc_far(k, b, x) as (
  select 0, b, x from crc_bits
  union all
  select k + 1, f.b, xor(s.x, f.x >> 8) from crc_far f join crc_bits s on s.b = f.x & 255 where k < (select max(k) from crc_bytes)),
crc_zero(n, x) as (
  select 0, 4294967295::bigint
  union all
  select n + 1, xor(s.x, z.x >> 8) from crc_zero z join crc_bits s on s.b = z.x & 255 where n <= (select max(k) from crc_bytes)),
sums as (
  select t, xor(4294967295, xor(any_value(z.x), bit_xor(f.x))) as crc
  from crc_bytes join crc_far f using (k, b) join crc_zero z on z.n = octet_length(encode(t)) group by t)"""

VARIANTS = f"""
with recursive
runs as materialized (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run
  from documents),
counted as materialized (select id || ':' || run as t, run, count(*) as c from runs where length(run) >= 6 group by all),
texts as materialized (select distinct t from counted),
{CRC32},
made as (
  select case when crc % 199 = 0 then left(run, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word, c
  from counted join sums using (t)),
words as materialized (select word, sum(c)::bigint as n from made where length(word) >= 6 group by word having sum(c) >= 5),
cuts as materialized (
  select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest
  from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select a.word, a.n, b.word as other, b.n as other_n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select c.word, c.n, w.word, w.n from cuts c join words w on c.rest = w.word
  union
  select w.word, w.n, c.word, c.n from cuts c join words w on c.rest = w.word),
best as (
  select word, any_value(n) as n, count(*) as n_near, max(other_n) as top_n, min(struct_pack(m := -other_n, w := encode(other))) as top from near group by word),
forms as materialized (
  select word, n_near, case when top_n >= 5 * n then decode(top.w) end as form, case when top_n >= 5 * n then top_n end as form_n from best),
chain as (
  select word, form as here, 1 as step from forms where form is not null
  union all
  select c.word, f.form, step + 1 from chain c join forms f on f.word = c.here where f.form is not null),
ends as (select word, arg_max(here, step) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, coalesce(n_near, 0) as n_near, form_n
from words left join forms using (word) left join ends using (word)
"""

#: The tree by levels, each leaf's siblings joined level by level, and a fold over their list.
MANIFEST = f"""
with recursive
texts as materialized (select distinct doc_id::varchar as t from documents where doc_id is not null),
{CRC32},
rows as materialized (
  select d.doc_id, coalesce('=' || lang, '') as tree, coalesce(crc % 7 = 0, false) as hit,
    case when doc_id is null then '-' else length(doc_id::varchar) || ':' || doc_id end
      || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') as head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') as tail
  from documents d left join sums on t = doc_id::varchar),
leaves as materialized (
  select doc_id, tree, sha256(head || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when hit and n_chars is not null then sha256(head || length((n_chars + 1)::varchar) || ':' || (n_chars + 1) || tail)
      else sha256(head || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') || tail) end as presented
  from rows),
numbered as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by tree) as size from leaves),
levels(tree, level, i, h, size) as (
  select tree, 0, i, leaf, size from numbered
  union all
  select tree, level + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(size) + 1) // 2
  from levels where size > 1 group by tree, level, i // 2),
subroots as materialized (
  select tree, h as subroot, row_number() over (order by encode(tree)) - 1 as i, count(*) over () as size from levels where size = 1),
tops(level, i, h, size) as (
  select 0, i, subroot, size from subroots
  union all
  select level + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(size) + 1) // 2 from tops where size > 1 group by level, i // 2),
steps as materialized (
  select n.tree, n.i, l.level, case when s.h is null then '-' when l.i % 2 = 1 then 'L' || s.h else 'R' || s.h end as step
  from numbered n join levels l on l.tree = n.tree and l.i = n.i >> l.level and l.size > 1
  left join levels s on s.tree = l.tree and s.level = l.level and s.i = xor(l.i, 1)),
top_steps as materialized (
  select r.tree, l.level + 100 as level, case when s.h is null then '-' when l.i % 2 = 1 then 'L' || s.h else 'R' || s.h end as step
  from subroots r join tops l on l.i = r.i >> l.level and l.size > 1 left join tops s on s.level = l.level and s.i = xor(l.i, 1)),
proofs as (
  select tree, i, list(step order by level) as path
  from (select * from steps union all select n.tree, n.i, t.level, t.step from numbered n join top_steps t on t.tree = n.tree) group by tree, i),
done as (
  select doc_id, leaf, subroot, (select h from tops where size = 1) as root,
    sha256(array_to_string(list_transform(coalesce(path, []), lambda x: substr(x, 2)), '')) as proof_sha256,
    list_reduce(list_prepend(presented, coalesce(path, [])), lambda node, x: case when x[1] = 'L' then sha256(substr(x, 2) || node) else sha256(node || substr(x, 2)) end) as folded_root
  from numbered join subroots using (tree) left join proofs p on p.tree = numbered.tree and p.i = numbered.i)
select *, folded_root = root as verified from done
"""


def quoted(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def line_cleaning() -> str:
    """Counts and verdicts of the line rules, from the rules' own fixed values."""
    def pattern(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    symbols = " + ".join(f"length({{0}}) - length(replace({{0}}, '{c}', ''))" for c in line_rules.SYMBOLS)
    return f"""
with texts as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from texts),
worded as materialized (
  select r, i, line, regexp_extract_all(line, {pattern(line_rules.WORD)}) as words,
    lead(line) over (partition by r order by i) as following
  from split where regexp_matches(line, {pattern(line_rules.WORD)})),
plain as (
  select *, len(words) as n, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    len(list_filter(words, lambda w: w in ({quoted(line_rules.SEPARATORS)}))) as parted from worded),
judged as materialized (
  select r, i, line, words, n,
    (n <= {line_rules.NOTICE_WORDS} and regexp_matches(low, {pattern(line_rules.NOTICE)}))
    or low in ({quoted(line_rules.NAVIGATION)}) or (parted >= 2 and 3 * parted >= n)
    or not (regexp_matches(line, {pattern(line_rules.FINISHED)}) or regexp_matches(coalesce(following, ''), {pattern(line_rules.GOES_ON)}))
    or 10 * ({symbols.format("line")}) > 3 * n or 5 * len(regexp_extract_all(line, {pattern(line_rules.SHOUTS)})) > n as failed
  from plain),
by_text as (
  select r, sum(n) as n_words, sum(list_sum(list_transform(words, lambda w: length(w)))) as word_chars,
    count(*) - count(distinct line) as n_dup_lines, coalesce(sum(n) filter (failed), 0) as lost from judged group by r),
words as materialized (
  select r, word, row_number() over (partition by r order by i, j) as p
  from (select r, i, unnest(words) as word, generate_subscripts(words, 1) as j from judged)),
windows as (
  select r, p, word || ' ' || lead(word) over w || ' ' || lead(word, 2) over w as seen from words window w as (partition by r order by p)),
again as (
  select r, p from (select r, p, count(*) over (partition by r, seen) as times from windows where seen is not null) where times > 1),
repeated as (
  select r, count(distinct p + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) group by r),
counted as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    ({symbols.format("text")})::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost
  from texts left join by_text using (r) left join repeated using (r)),
based as (select *, n_words < {line_rules.FEWEST_WORDS} or 100 * n_repeat_words > {line_rules.MOST_REPEATED} * n_words as base_failed from counted)
select * exclude (lost), not base_failed and 100 * lost <= {line_rules.MOST_LOST} * n_words as kept from based
"""
