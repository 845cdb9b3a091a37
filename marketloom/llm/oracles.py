"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _grams(n: int) -> str:
    """Runs of n words of x(rid, i, word) as one string, null where the text ends before."""
    return "word || " + " || ".join(f"' ' || lead(word, {k}) over p" for k in range(1, n))


#: Links between distinct shingle sets that share a shingle, then the smallest id that can be reached.
NEAR = rf"""
with recursive d as (
    select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents
), x as (
    select rid, unnest(w) as word, generate_subscripts(w, 1) as i from d where len(w) >= 5
), g as (
    select rid, {_grams(5)} as g from x window p as (partition by rid order by i)
), t as (
    select rid, list_sort(list(distinct g)) as s from g where g is not null group by rid
), s as (
    select d.doc_id, coalesce(t.s, case when len(d.w) = 0 then [] else [array_to_string(d.w, ' ')] end) as s from d left join t on d.rid = t.rid
), c as (
    select s, min(doc_id) as rep from s where len(s) > 0 group by s
), e as (
    select rep, len(s) as n, unnest(s) as g from c
), p as (
    select a.rep as a, b.rep as b, count(*) as shared, any_value(a.n) as n, any_value(b.n) as m
    from e a join e b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep
), l as (
    select a, b from p where 100 * shared >= 85 * (n + m - shared)
), u as (
    select a as x, b as y from l union all select b, a from l
), r(x, y) as (
    select rep, rep from c union select r.x, u.y from r join u on r.y = u.x
), k as (
    select x, min(y) as component from r group by x
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(k.component, s.doc_id) as component_id,
    s.doc_id = coalesce(k.component, s.doc_id) as kept
from s left join c on len(s.s) > 0 and c.s = s.s left join k on k.x = c.rep
"""

SUBSTRINGS = rf"""
with d as (
    select row_number() over () as rid, doc_id, {_WORDS} as w from documents
), x as (
    select rid, doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d
), g as (
    select rid, doc_id, i, md5({_grams(13)}) as h from x window p as (partition by rid order by i)
), f as (
    select h, min(doc_id) as first from g where h is not null group by h
), hit as (
    select distinct rid, i + k as i from (select g.rid, g.i from g join f on g.h = f.h where g.doc_id > f.first),
        (select unnest(range(0, 13)) as k)
), kept as (
    select x.rid, string_agg(x.word, ' ' order by x.i) as t, count(*) as n
    from x anti join hit on x.rid = hit.rid and x.i = hit.i group by x.rid
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(kept.n, 0) as bigint) as n_removed,
    sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept on d.rid = kept.rid
"""

_BENCH_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = rf"""
with b as (
    select item_id, {_BENCH_WORDS} as w from benchmark
), p as (
    select distinct item_id, least(13, len(w)) as m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
    from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)
), d as (
    select doc_id, {_BENCH_WORDS} as w from documents
), g as (
    select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as g
    from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from p) where len(w) >= m)
), o as (
    select g.doc_id, g.i, g.m, p.item_id from g join p on g.m = p.m and g.g = p.g
), h as (
    select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + m)) as k from o) group by doc_id
), t as (
    select doc_id, count(*) as n, string_agg(x, ',' order by x) as x
    from (select distinct doc_id, cast(item_id as varchar) as x from o) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items,
    sha256(coalesce(t.x, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(d.w) as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""


def _secrets() -> str:
    from .secret_scan import BASE, RULES

    kinds = []
    for o, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(
            f"select id, list_zip(list_transform(string_split_regex(t, '{p}'), lambda x: length(x)),"
            f" list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)),"
            f" list_transform(regexp_extract_all(t, '{p}', {r.value}), lambda x: length(x))) as z,"
            f" {o} as o, '{r.kind}' as kind, {r.min_value} as least from d where regexp_matches(t, '{p}')"
        )
    union = " union all ".join(kinds)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    zeros = ", ".join(f"coalesce(c.n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""
with d as (
    select row_number() over () as id, doc_id, coalesce(text, '') as t from documents
), m as (
    {union}
), s as (
    select id, o, kind, cast(list_sum(list_transform(z[1:i], lambda x: x[1])) + coalesce(list_sum(list_transform(z[1:i - 1], lambda x: x[2])), 0) as bigint) as s, z[i][2] as n
    from (select *, unnest(range(1, len(z) + 1)) as i from m) where z[i][3] >= least and z[i][2] is not null
), c as (
    select id, {counts},
        string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) filter (o < {len(BASE)}) as base,
        string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, o) as spans
    from s group by id
)
select d.doc_id, {zeros}, sha256(coalesce(c.base, '')) as base_sha256, coalesce(c.spans, '') as spans
from d left join c on d.id = c.id
"""


_TAG = r"unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>'))"
URLS = rf"""
with recursive parts as (
    select page_id, url, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), hosts as (
    select page_id, url, html, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) as tail from parts
), p as (
    select page_id, url, html, host, regexp_extract(tail, '^[^?#]*') as path,
        case when host <> '' then host || regexp_extract(tail, '^[^#]*') end as key from hosts
), tags as (
    select key, url, host, {_TAG} as tag from p where key is not null
), links as (
    select key as a, url, host, replace(case
        when regexp_matches(tag, '(?i)^<link\b') and regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') then regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        when regexp_matches(tag, '(?i)^<meta\b') and regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        end, '&amp;', '&') as link from tags
), targets as (
    select a, case when contains(link, '://') then substr(link, strpos(link, '://') + 3)
        when starts_with(link, '//') then substr(link, 3)
        when starts_with(link, '/') then host || link
        else coalesce(nullif(regexp_extract(url, '^[^?#]*?://([^?#]*/)', 1), ''), host || '/') || link end as rest
    from links where link <> ''
), e as (
    select distinct a, b from (select a, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}
        || regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^#]*') as b from targets
        where regexp_extract(rest, '^[^/?#]*') <> '') where a <> b
), u as (
    select a as x, b as y from e union select b, a from e
), r(x, y) as (
    select x, x from u union select r.x, u.y from r join u on r.y = u.x
), rules(verdict, host, path) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), nodes as (
    select distinct x as key, regexp_extract(x, '^[^/?#]*') as host, regexp_extract(substr(x, length(regexp_extract(x, '^[^/?#]*')) + 1), '^[^?#]*') as path from u
), fits as (
    select n.key, arg_max(q.verdict, length(q.host || q.path) * 1000 + length(q.host)) as verdict from nodes n
    join rules q on (n.host = q.host or ends_with(n.host, '.' || q.host)) and starts_with(n.path, q.path) group by n.key
), blocked as (
    select distinct r.x as key from r join fits f on f.key = r.y where f.verdict = 'block'
), own as (
    select p.page_id, p.key, p.host, p.path, q.host || q.path as rule, q.verdict,
        row_number() over (partition by p.page_id, p.url order by length(q.host || q.path) desc, length(q.host) desc) as rank
    from p left join rules q on (p.host = q.host or ends_with(p.host, '.' || q.host)) and starts_with(p.path, q.path)
)
select o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, case when b.key is not null then 'block' else 'allow' end) as verdict
from own o left join blocked b on o.key = b.key where o.rank = 1
"""

SEARCH = rf"""
with d as (
    select row_number() over () as rid, doc_id, {_BENCH_WORDS} as w from documents where doc_id is not null
), s as (
    select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_words from d where len(w) > 0
), q as (
    select item_id, term, count(*) as q from (select item_id, unnest(w) as term from (select item_id, {_BENCH_WORDS} as w from (select distinct item_id, text from benchmark))) group by item_id, term
), t as (
    select rid, term, count(*) as tf from (select rid, unnest(w) as term from d) where term in (select term from q) group by rid, term
), f as (
    select term, count(*) as df from t group by term
), z as (
    select q.item_id, q.term, q.q * cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1))) as bigint) as w from q join f on q.term = f.term, s
), i as (
    select t.rid, d.doc_id, t.term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_words)) as impact from t join d on t.rid = d.rid, s
), r as (
    select z.item_id, i.rid, any_value(i.doc_id) as doc_id, cast(sum(z.w * i.impact) as bigint) as score from z join i on z.term = i.term group by z.item_id, i.rid
)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0) where rank <= 20
"""

NEGATIVES = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
    from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as int) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3
"""

SQL = {
    "op6_near_duplicates": NEAR,
    "op7_secrets": _secrets(),
    "op8_url_filter": URLS,
    "op9_substrings": SUBSTRINGS,
    "op10_decontamination": CONTAMINATION,
    "op12_ranked_search": SEARCH,
    "op13_hard_negatives": NEGATIVES,
}
