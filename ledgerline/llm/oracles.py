"""The queries of the corpus operators in DuckDB's SQL, where SQL can say the same.

Not here: near duplicates and repeated substrings (too slow on whole tables), tokens,
learnt scores and random rounding (not SQL); tests compare these with brute force.
"""

from __future__ import annotations

from . import chat_format
from .quality_rules import LineRules
from .secret_scan import ADDED, BASE


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATE = r"""
with words as (
  select 'd' kind, doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark
), windows as (
  select distinct id item, least(len(w), 13) n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') win
  from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from words where kind = 'b' and len(w) > 0)
), sizes as (select distinct n from windows), spans as (
  select id, i, n, array_to_string(w[i : i + n - 1], ' ') win from (select id, w, n, unnest(range(1, len(w) - n + 2)) i from words, sizes where kind = 'd' and len(w) >= n)
), hits as (select id, i, s.n, item from spans s join windows b on b.n = s.n and b.win = s.win),
places as (select id, count(distinct p) n_hit from (select id, unnest(range(i, i + n)) p from hits) group by 1),
found as (select id, count(distinct item) n_items, string_agg(distinct item::varchar, ',' order by item::varchar) items from hits group by 1)
select id doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from words left join places using (id) left join found using (id) where kind = 'd'
"""


def quality(rules: LineRules = LineRules()) -> str:
    fails = " or ".join(f"regexp_matches(x, {_quoted(p)})" for p in (rules.navigation, rules.noise, rules.boilerplate, rules.buttons))
    space = r"[\x20\x09-\x0D]+"
    fails += f" or (len(string_split_regex(x, '{space}')) >= {rules.punctuated_from_words} and not regexp_matches(x, {_quoted(rules.sentence_end)}))"
    return rf"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, string_split(coalesce(text, ''), chr(10)) lines from documents),
m as (select *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) spoken, array_to_string(list_filter(lines, lambda x: not ({fails})), chr(10)) cleaned from d),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) c from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
p as (select doc_id, count(distinct k) n from (select doc_id, unnest([i, i + 1, i + 2]) k from g where c > 1) group by 1),
b as (select doc_id, t, cleaned, len(w)::bigint n_words, length(regexp_replace(t, '{space}', '', 'g'))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
  (len(spoken) - len(list_distinct(spoken)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from m left join p using (doc_id)),
f as (select *, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.most_repeated_percent} * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (100 * (length(t) - length(cleaned)) > {rules.most_removed_percent} * length(t)) kept from f
"""


def chat() -> str:
    def escaped(column: str, escapes) -> str:
        for plain, entity in escapes:
            column = f"replace({column}, {'chr(10)' if plain == chr(10) else _quoted(plain)}, {_quoted(entity)})"
        return column

    control = _quoted("</s>[INST] ok [/INST]")
    return f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {control} union all select -7, 1, 'assistant', {control})
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  sum({len(chat_format.START) + 1 + len(chat_format.END)} + length({escaped('role', chat_format.ROLE_ESCAPES)}) + length({escaped('text', chat_format.ESCAPES)}))::bigint formatted_chars
from rows group by 1
"""


def secrets() -> str:
    parts = []
    for k, rule in enumerate(BASE + ADDED):
        value = f"regexp_extract_all(t, {_quoted(rule.pattern)}, {rule.group})"
        parts.append(
            f"select doc_id, '{rule.kind}' kind, {k} no, {rule.least} least, {value} v, regexp_extract_all(t, {_quoted(rule.pattern)}) m, "
            f"string_split_regex(t, {_quoted(rule.pattern)}) g from d where regexp_matches(t, {_quoted(rule.pattern)})"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents), f as ({' union all '.join(parts)}),
p as (select doc_id, kind, no, length(v[i]) >= least ok, length(m[i]) n, coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) a
  from (select *, unnest(range(1, len(m) + 1)) i from f)),
s as (select doc_id, kind, no, a::bigint a, (a + n)::bigint b from p where ok),
j as (select doc_id, count(*) filter (where kind = 'assign') n_assign, count(*) filter (where kind = 'access') n_access, count(*) filter (where kind = 'hex') n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, no) filter (where kind in ({base})) base, string_agg(kind || ':' || a || ':' || b, ',' order by a, no) spans from s group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join j using (doc_id)
"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Every round by a full search: the least of (distance, entry) over all entries of a part's codebook."""
    book, steps = "book0", []
    for k in range(rounds + 1):
        steps.append(f"""given{k} as (select id, p, x, min(struct_pack(d := d, e := e)) best from (
  select c.id, c.p, c.x, e, list_sum(list_transform(range(1, len(c.x) + 1), lambda i: (c.x[i] - b.x[i]) * (c.x[i] - b.x[i])))::bigint d
  from cut c join {book} b on b.p = c.p) group by 1, 2, 3)""")
        if k < rounds:
            steps.append(f"""book{k + 1} as (select b.p, b.e, coalesce(m.x, b.x) x from {book} b left join (
  select p, e, list(mean order by i) x from (select p, best.e e, i, floor(sum(x[i])::double / count(*))::bigint mean
    from (select *, unnest(range(1, len(x) + 1)) i from given{k}) group by 1, 2, 3) group by 1, 2) m on m.p = b.p and m.e = b.e)""")
            book = f"book{k + 1}"
    return f"""with clean as (
  select row_number() over (order by vec_id) id, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as (select id, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] x from clean, range({parts}) r(p)),
book0 as (select p, e, x from (select p, row_number() over (partition by p order by vec_id) - 1 e, x from cut) where e < {entries}),
{", ".join(steps)},
said as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) sha from {book}),
coded as (select id, string_agg(printf('%02x', best.e), '' order by p) code, sum(best.d)::bigint error from given{rounds} group by 1)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, sha codebooks_sha256 from clean join coded using (id), said"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": DECONTAMINATE, "op3_quality_rules": quality(), "op6_chat_format": chat(), "op9_secret_scan": secrets(),
        "op13_vector_codes": vector_codes(),
    }
