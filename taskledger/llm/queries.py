"""Registered queries of this subpackage, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import secrets
from .ann import neighbours
from .bpe import round_trip_digests
from .collocations import collocations
from .common import table
from .conversations import Repair, damage
from .fingerprints import edited_likeness
from .html import extract_articles
from .lm import cross_entropy_difference
from .mixing import mix
from .quality import quality
from .secrets import secret_spans
from .simhash_dedup import near_duplicates
from .substring import remove_repeats
from .toxicity import toxicity

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_dedup(spark, sf_dir):
    """Every row of documents with its fingerprint and component, over three-word shingles. Null, empty, repeated and very long texts, ties and clashing columns: as near_duplicates() says."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=3, words=3)


@query
def op4_toxicity(spark, sf_dir):
    """Every row of documents with its score; learned from labels outside fold 0. Odd rows, and no labels: as learn_lexicon() and score_documents() say."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_bpe(spark, sf_dir):
    """Every row of documents with its token count and digests. A null text is empty; rows that repeat each give a row."""
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_mixing(spark, sf_dir):
    """Every row of documents with the words that the mix takes of it. Null sources, repeated rows, empty tables: as mix() says."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_mixing"] = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5('7:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (
  select *, row_number() over (order by source asc nulls last) as rank, source_size * cast(2 as double) as most,
    case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then cast(5 as double) when 1 then cast(2 as double) else cast(1 as double) end as weight
  from s),
l as (
  select *, row_number() over (order by most / weight, source asc nulls last) as turn, (sum(source_size) over () * cast(1.5 as double)
      - coalesce(sum(most) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from r),
t as (
  select source, source_size, least(most, coalesce(arg_min(level, case when level <= most / weight then turn end) over () * weight, most)) as target from l),
g as (
  select *, cast(floor(target + 0.5) as bigint) as goal,
    case when source_size > 0 then cast(floor(target + 0.5) as bigint) // source_size else 0 end as passes from t),
k as (select source, key, sum(size) as words, count(*) as n from d group by source, key),
p as (select *, sum(words) over (partition by source order by key) - words as start from k)
select d.doc_id, cast(d.size as bigint) as size, g.source_size, g.target,
  cast(g.passes * d.size + case
    when p.start + p.words <= goal - passes * source_size then d.size
    when p.start <= goal - passes * source_size then (goal - passes * source_size - p.start) // p.n
    else 0 end as bigint) as taken
from d join g on d.source is not distinct from g.source join p on d.source is not distinct from p.source and d.key = p.key
"""


@query
def op5_secrets(spark, sf_dir):
    """Every row of documents with its spans. A null text has none; time grows with the text, however many or long its candidates."""
    return secret_spans(table(spark, sf_dir, "documents"))


def _secrets_sql() -> str:
    """Spans of each pattern from the lengths of its matches and of what stands between them; windows of candidates one by one."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def any_case(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    names = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
    assign = quoted(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    access, hexadecimal, candidate = map(quoted, (secrets.ACCESS, secrets.HEX, secrets.CANDIDATE))

    def located(pattern: str, kind: int, keep: str) -> str:
        between, matches = f"string_split_regex(x, {pattern})", f"regexp_extract_all(x, {pattern})"
        return f"""
  select doc, {kind} as kind, s as "start", s + length(m) as "end", m from (
    select doc, m, cast(i - 1 as int) as i, (list_sum(list_transform(b[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda g: length(g))), 0))::bigint as s
    from (select doc, a, b, unnest(a) as m, unnest(range(1, len(a) + 1)) as i from (select doc, {matches} as a, {between} as b from d) where len(a) > 0)) where {keep}"""

    classes = " ".join(f"when regexp_full_match(m, {quoted(p)}) then {bits}" for p, bits in secrets.CLASSES)
    known = " or ".join(f"regexp_full_match(m, {quoted(p)})" for p in secrets.ALLOW)
    n = secrets.WINDOW
    return f"""
with d as (select row_number() over () as doc, doc_id, coalesce(text, '') as x from documents),
base as ({located(assign, 0, f"length(regexp_extract(m, {assign}, 2)) >= {secrets.ASSIGN_VALUE}")}
  union all {located(access, 1, "true")}
  union all {located(hexadecimal, 2, "true")}),
runs as (select *, case {classes} else 9.0 end as bound from ({located(candidate, 3, f"regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') and not ({known})")})),
windows as (
  select doc, "start", bound, i, list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: (length(w) - length(replace(w, c, ''))) * log2(length(w) - length(replace(w, c, ''))))) as total
  from (select doc, "start", bound, i, m[i + 1:i + {n}] as w from (select *, unnest(range(0, length(m) - {n - 1})) as i from runs))),
dense as (
  select doc, 3 as kind, "start" + min(i) as "start", "start" + max(i) + {n} as "end" from windows
  where {n} * log2({n}) - total >= bound * {n} - 1e-9 group by doc, windows."start"),
extra as (select * from dense e where not exists (select 1 from base b where b.doc = e.doc and b."start" < e."end" and e."start" < b."end")),
names as (select * from (values (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'entropy')) t(kind, name)),
every as (select doc, kind, "start", "end" from base union all select doc, kind, "start", "end" from extra),
lists as (
  select doc, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
    string_agg(name || ':' || "start" || ':' || "end", ',' order by "start", kind) filter (where kind < 3) as base_spans,
    string_agg(name || ':' || "start" || ':' || "end", ',' order by "start", kind) as spans
  from every join names using (kind) group by doc)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join lists using (doc)
"""


ORACLE_SQL["op5_secrets"] = _secrets_sql()


@query
def op10_fingerprints(spark, sf_dir):
    """Every row of documents with both fingerprints, and for each hundredth the rows within the radius. Null and repeated ids, single rows: as edited_likeness() says."""
    return edited_likeness(table(spark, sf_dir, "documents"))


@query
def op8_nearest(spark, sf_dir):
    """Up to 20 neighbours of every twentieth vector. Odd vectors, ties, repeated ids, few rows: as neighbours() says."""
    return neighbours(table(spark, sf_dir, "embeddings"))


@query
def op6_html(spark, sf_dir):
    """Every row of pages with its main text. Null and broken pages and odd URLs: as extract_articles() and with_host() say."""
    return extract_articles(table(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark, sf_dir):
    """Every row of documents without its repeated passages. Null and repeated ids, empty texts, texts that repeat whole: as remove_repeats() says."""
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op9_lm_scores(spark, sf_dir):
    """Every row of documents with both losses and their difference. No target, empty texts, repeated rows and labels: as cross_entropy_difference() says."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_conversation_repair(spark, sf_dir):
    """Every conversation, after damage, with its faults, the cheapest edits and a digest of what they give. Nulls, repeated rows, odd roles: as damage() and Repair say."""
    return Repair(damage(table(spark, sf_dir, "conversations"))).report()


@query
def op13_collocations(spark, sf_dir):
    """Each language's first 2,000 phrases. Null langs and texts, repeated rows, no candidates: as collocations() says."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from (select row_number() over () as doc, lang, text from documents)),
lists as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, 1 as k, unnest(w) as phrase from lists
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from lists where len(w) > 1
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from lists where len(w) > 2),
f as (select lang, k, phrase, count(*) as n from grams group by all),
total as (select lang, cast(sum(n) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, n as a, string_split(phrase, ' ') as w from f where k > 1 and n >= 10),
cuts as (
  select *, w[1] as head, array_to_string(w[2:], ' ') as tail, 1 as cut from c
  union all select *, w[1] || ' ' || w[2], w[3], 2 from c where k = 3),
scored as (
  select cuts.lang, cuts.k, cuts.phrase, a, w, cut, l.n as l, r.n as r, (cast(1000000 as hugeint) * a * a) // (cast(l.n as hugeint) * r.n) as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = head and l.k = cut join f r on r.lang = cuts.lang and r.phrase = tail and r.k = cuts.k - cut),
best as (select * from scored qualify row_number() over (partition by lang, k, phrase order by score, cut) = 1),
longer as (
  select lang, part, max(a) as a from (
    select lang, w[1] || ' ' || w[2] as part, a from c where k = 3 union all select lang, w[2] || ' ' || w[3], a from c where k = 3) group by all),
kept as (select best.* from best left join longer on longer.lang = best.lang and part = phrase and best.k = 2 where longer.a is null or 100 * longer.a < 50 * best.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, total.n as n, cast(score as bigint) as score
from kept join total on total.lang = kept.lang
qualify rank <= 2000
"""


@query
def op12_quality(spark, sf_dir):
    """Every row of documents with its score; learned from labels outside fold 1 of three. Odd rows, and no labels: as learn_quality() and score_quality() say."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
