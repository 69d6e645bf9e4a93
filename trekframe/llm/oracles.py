"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import math

from trekframe.llm import collocations, license_scan, mixing, quality_rules, terms

_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"

EXACT = """
    with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents)
    select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
           doc_id is not distinct from max(doc_id) over (partition by h) as kept, h as text_sha256
    from t"""

MIXING = f"""
    with d as (select doc_id, source, len({_WORDS}) as size,
        -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint + 0.5::double) / {float(1 << 48)!r}::double)
        / greatest(0.05::double, 1 - 5.0::double * (length(coalesce(text,'')) - length(regexp_replace(coalesce(text,''), '[#*$%&|<>]', '', 'g'))) / greatest(length(coalesce(text,'')), 1)) as key from documents),
    s as (select source, sum(size)::double as z from d group by 1),
    r as (select *, [{", ".join(f"{w!r}::double" for w in mixing.WEIGHTS)}][(row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1] as w from s),
    o as (select *, {mixing.CAP} * z as most, row_number() over (order by {mixing.CAP} * z / w, source nulls last) as k from r),
    l as (select a.k, ({mixing.TOTAL} * (select sum(z) from s) - coalesce(sum(b.most), 0)) / ((select sum(w) from o) - coalesce(sum(b.w), 0)) as level from o a left join o b on b.k < a.k group by a.k),
    f as (select level from o join l using (k) where most / w >= level order by k limit 1),
    p as (select source, z, least(most, w * (select level from f)) as target from o),
    e as (select d.*, z, target, case when z > 0 then floor(target / z) else 0 end as epochs, sum(size) over (partition by d.source order by key, doc_id rows unbounded preceding) as upto from d join p on p.source is not distinct from d.source)
    select doc_id, size, z::bigint as source_size, target, (epochs * size + greatest(0, least(size, round(target) - epochs * z - (upto - size))))::bigint as taken from e"""


def quality() -> str:
    q = quality_rules
    step, first, reach, prior = repr(math.log(q._gamma())), repr(math.log(2 / (q._gamma() + 1))), q.REACH, q.PRIOR_ROWS
    shares = {
        "word_len": "word_chars / greatest(n_words, 1)::double",
        "mark_share": "n_marks / greatest(n_words, 1)::double",
        "upper_share": "n_upper / greatest(word_chars, 1)::double",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)::double",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)::double",
    }
    values = " union all ".join(f"select lang, source, '{k}' as feature, {v} as v from b where not base_failed" for k, v in shares.items())

    def fences(keys: str, tag: str) -> str:
        group = f"{keys}, " if keys else ""
        at = lambda p: f"(min(case when seen >= {p}::double * total then bucket end) * {step}::double + {first}::double)"
        return f"""{tag}c as (select {group}feature, bucket, count(*) as n from sk where bucket is not null group by {group}feature, bucket),
        {tag}q as (select {group}feature, bucket, sum(n) over (partition by {group}feature) as total, sum(n) over (partition by {group}feature order by bucket rows unbounded preceding) as seen from {tag}c),
        {tag}v as (select {group}feature, max(total)::double as n, {", ".join(f"{at(p)} as {k}" for k, p in q._AT.items())} from {tag}q group by {group}feature),
        {tag} as (select {group}feature, n, case when q80 - q60 > 0 then q60 - {reach}::double * (q80 - q60) end as low, case when q40 - q20 > 0 then q40 + {reach}::double * (q40 - q20) end as high from {tag}v)"""

    one, two, three = fences("lang, source", "t1"), fences("lang", "t2"), fences("", "t3")
    both = "'" + "','".join(k for k, two_sided in q.FEATURES if two_sided) + "'"
    wide = lambda c: f"coalesce((x2.n * x2.{c} + {prior} * x3.{c}) / (x2.n + {prior}), x3.{c}, x2.{c})"
    pick = lambda c: f"coalesce((x1.n * x1.{c} + {prior} * {wide(c)}) / (x1.n + {prior}), {wide(c)}, x1.{c})"
    count = lambda chars: f"length(coalesce(text,'')) - length(regexp_replace(coalesce(text,''), '{chars}', '', 'g'))"
    return f"""
    with w as (select doc_id, lang, source, text, {_WORDS} as ws, list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents),
    u as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
    g3 as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) > 1 as again, c is not null as whole from (select *, lead(a) over o as b, lead(a, 2) over o as c from u window o as (partition by doc_id order by i))),
    rp as (select doc_id, count_if(hit) as n_repeat_words from (select doc_id, bool_or(again and whole) over (partition by doc_id order by i rows between 2 preceding and current row) as hit from g3) group by 1),
    f as (select w.doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        {count("[#*$%&|<>]")} as n_symbols, {count("[!-/:-@[-`{-~]")} as n_marks, {count("[A-Z]")} as n_upper, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join rp using (doc_id)),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
    sk as (select lang, source, feature, case when v > 0 then ceil(ln(v) / {step}::double) end as bucket from ({values})),
    {one}, {two}, {three},
    vals as (select doc_id, lang, source, g.feature, case g.feature {" ".join(f"when '{k}' then {v}" for k, v in shares.items())} end as v from b cross join (values {", ".join(f"('{k}')" for k in shares)}) g(feature)),
    lim as (select vals.doc_id, vals.feature, case when vals.v > 0 then ln(vals.v) end as v, {pick("low")} as low, {pick("high")} as high from vals
        left join t1 x1 on x1.lang is not distinct from vals.lang and x1.source is not distinct from vals.source and x1.feature = vals.feature
        left join t2 x2 on x2.lang is not distinct from vals.lang and x2.feature = vals.feature left join t3 x3 on x3.feature = vals.feature),
    ver as (select doc_id, bool_and(coalesce(v <= high, true) and (feature not in ({both}) or coalesce(v >= low, true))) as ok from lim group by 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept from b join ver using (doc_id)"""


def near(size: int, num: int, den: int) -> str:
    gram = ", ".join(f"coalesce(lead(a, {k}) over o, '')" for k in range(1, size))
    return f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
    u as (select doc_id, len(ws) as n, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
    s as (select distinct doc_id, h from (select doc_id, n, i, concat_ws(chr(31), least(n, {size})::varchar, a, {gram}) as h from u window o as (partition by doc_id order by i)) where i <= greatest(1, n - {size - 1})),
    c as (select doc_id, count(*) as n from s group by 1),
    rare as (select h from s group by 1 having count(*) > 1),
    sr as (select s.* from s join rare using (h)),
    p as (select a.doc_id as x, b.doc_id as y, count(*) as k from sr a join sr b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
    l as (select x, y from p join c cx on cx.doc_id = x join c cy on cy.doc_id = y where {den} * k >= {num} * (cx.n + cy.n - k)),
    e as (select x, y from l union all select y, x from l),
    t as (select doc_id as node, doc_id as root from c union select e.y, t.root from t join e on e.x = t.node)
    select documents.doc_id, coalesce(c.n, 0) as n_shingles, coalesce(r.root, documents.doc_id) as component_id from documents left join c using (doc_id) left join (select node, min(root) as root from t group by 1) r on r.node = documents.doc_id"""


def licenses() -> str:
    t = license_scan.THRESHOLD
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    strings = lambda x: f"[{', '.join(map(quote, x))}]::varchar[]"
    grams = {k: license_scan.bigrams(v) for k, v in sorted(license_scan.TEMPLATES.items())}
    table = ", ".join(f"({quote(k)}, {strings(g)}, {strings(license_scan.needs(k, g))}, {strings(license_scan.variants(g))})" for k, g in grams.items())
    words = "|".join(sorted(set().union(*[license_scan.anchors(license_scan.bigrams(v), t) for v in license_scan.TEMPLATES.values()])))
    return f"""
    with t as (select * from (values {table}) v(name, grams, needs, variants)),
    n as (select doc_id, regexp_replace(lower(coalesce(text,'')), '[^a-z0-9\\n]+', ' ', 'g') as norm from documents),
    g as (select doc_id, unnest(list_distinct(list_concat(list_concat(string_split(norm, chr(10)), string_split_regex(norm, '\\n *\\n')), [norm]))) as part from n),
    s as (select distinct doc_id, trim(regexp_replace(part, '[\\n ]+', ' ', 'g'), ' ') as part from g),
    a as (select * from s where regexp_matches(part, '(^| )({words})($| )')),
    w as (select doc_id, part, string_split(part, ' ') as ws from a),
    b as (select doc_id, part, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as grams from w),
    m as (select doc_id, name, needs, variants, b.grams, 2.0::double * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) as dice from b cross join t),
    ok as (select * from m where dice >= {t} and (len(needs) = 0 or list_has_any(grams, needs)) and list_sort(list_intersect(list_distinct(flatten(list_transform(grams, lambda g: string_split(g, ' ')))), {strings(sorted(license_scan.VARIANTS))})) = variants),
    best as (select doc_id, name, dice, row_number() over (partition by doc_id order by dice desc, name) as k from ok),
    every as (select doc_id, string_agg(distinct name, ',' order by name) as names from ok group by 1)
    select documents.doc_id, name as license, coalesce(dice, 0.0::double) as dice, coalesce(c.n, 0) as n_segments, coalesce(every.names, '') as licenses from documents left join best on best.doc_id = documents.doc_id and k = 1 left join every on every.doc_id = documents.doc_id left join (select doc_id, count(*) as n from a group by 1) c on c.doc_id = documents.doc_id"""


_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '{terms.TERM}')"

SEARCH = f"""
    with d as (select row_number() over () as row, doc_id, {_TERMS} as ws from documents),
    size as (select count(*)::bigint as nn, sum(len(ws))::bigint as ll from d where len(ws) > 0),
    post as (select row, w, count(*)::bigint as tf from (select row, unnest(ws) as w from d) group by all),
    df as (select w, count(*)::bigint as df from post group by 1),
    i as (select row_number() over () as item, item_id, list_distinct({_TERMS}) as ws from benchmark),
    q as (select item, item_id, w, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as weight from (select item, item_id, unnest(ws) as w from i) join df using (w), size),
    m as (select row, doc_id, 10 + (90 * len(ws)::bigint * nn) // ll as m from d, size where len(ws) > 0),
    s as (select item, item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from q join post using (w) join m using (row) group by all),
    r as (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from r where rank <= 10"""

LEAKS = f"""
    with d as (select row_number() over () as row, doc_id, {_TERMS} as ws from documents),
    i as (select coalesce(item_id::varchar, '') as item, {_TERMS} as ws from benchmark),
    w as (select distinct item, least(10, len(ws)) as n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') as win from (select item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from i where len(ws) > 0)),
    u as (select row, unnest(ws) as a, generate_subscripts(ws, 1) as p from d),
    g as (select row, p, n, win from (select row, p, {", ".join(f"case when count(*) over (o rows between current row and {n - 1} following) = {n} then string_agg(a, ' ') over (o rows between current row and {n - 1} following) end as w{n}" for n in range(1, 11))} from u window o as (partition by row order by p)) unpivot (win for n in ({", ".join(f"w{n}" for n in range(1, 11))}))),
    h as (select row, p, substr(g.n, 2)::int as n, item from g join w on w.win = g.win and 'w' || w.n = g.n),
    c as (select row, count(distinct pos) as n_hit from (select row, unnest(range(p, p + n)) as pos from h) group by 1),
    t as (select row, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row, item from h) group by 1)
    select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (row) left join t using (row)"""


def phrases() -> str:
    c = collocations
    longer = [f"select lang, k, phrase, count(*)::bigint as f from (select lang, {k} as k, case when count(*) over (o rows between current row and {k - 1} following) = {k} then string_agg(a, ' ') over (o rows between current row and {k - 1} following) end as phrase from u window o as (partition by row, piece order by p)) where phrase is not null group by all" for k in range(1, c.LONGEST + 1)]
    return f"""
    with d as (select row_number() over () as row, coalesce(lang, 'und') as lang, string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]') as ps from documents),
    q as (select row, lang, generate_subscripts(ps, 1) as piece, regexp_extract_all(unnest(ps), '[^\\x20\\x09]+') as ws from d),
    u as (select row, lang, piece, unnest(ws) as a, generate_subscripts(ws, 1) as p from q),
    f as materialized (select * from ({" union all ".join(longer)}) where k = 1 or f >= {c.SUPPORT}),
    n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
    x as (select * from f where k > 1),
    held as (select distinct a.lang, a.phrase from x a join x b on a.lang = b.lang and b.k > a.k and b.f = a.f and contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ')),
    cut as (select x.lang, x.phrase, x.f as a, unnest(range(1, k)) as c, k from x anti join held using (lang, phrase)),
    s as (select cut.lang, cut.phrase, a, c, l.f as l, r.f as r, n, ((1000::hugeint * a * n) // (l.f::hugeint * r.f))::bigint as score from cut join n using (lang)
        join f l on l.lang = cut.lang and l.phrase = array_to_string(string_split(cut.phrase, ' ')[1:c], ' ') join f r on r.lang = cut.lang and r.phrase = array_to_string(string_split(cut.phrase, ' ')[c + 1:], ' ')),
    b as (select *, row_number() over (partition by lang, phrase order by score, c) as worst from s),
    z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b where worst = 1)
    select lang, rank, phrase, a, l, r, n, score from z where rank <= {c.TOP}"""


ORACLES = {"op11_ranked_search": SEARCH, "op12_decontaminate": LEAKS, "op13_collocations": phrases(), "op1_exact_dedup": EXACT, "op2_license_scan": licenses(), "op3_quality_rules": quality(), "op4_mixing": MIXING, "op8_jaccard_join": near(4, 85, 100)}
