"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from collections.abc import Mapping

from . import chat_format, language_model, license_scan, mixing, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(text: str) -> str:
    """Words between white space."""
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


def decontamination(docs: str = "documents", items: str = "benchmark", window: int = 10) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
    with item as (select cast(item_id as varchar) as item_id, {words} as w from {items}),
    windows as (
        select distinct item_id, least(len(w), {window}) as k, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') as g
        from item, unnest(generate_series(1, greatest(len(w) - {window - 1}, 1))) as t(i) where len(w) > 0),
    doc as materialized (select row_number() over () as rid, doc_id, {words} as w from {docs}),
    places as (
        select rid, k, i, array_to_string(w[i : i + k - 1], ' ') as g
        from doc, (select distinct k from windows), unnest(generate_series(1, len(w) - k + 1)) as t(i) where len(w) >= k),
    found as materialized (select p.rid, p.i, p.k, w.item_id from places p join windows w on p.k = w.k and p.g = w.g),
    hit as (select rid, count(distinct j) as n from (select distinct rid, i, k from found), unnest(generate_series(i, i + k - 1)) as t(j) group by rid),
    ids as (select rid, count(distinct item_id) as n, string_agg(distinct item_id, ',' order by item_id) as s from found group by rid)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(ids.n, 0) as bigint) as n_items,
        sha256(coalesce(ids.s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
    from doc left join hit h using (rid) left join ids using (rid)"""


def license_scan_sql(docs: str = "documents", templates=license_scan.TEMPLATES) -> str:
    def shingles(text: str) -> str:
        words = f"list_filter(string_split_regex(lower({text}), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
        return f"(select list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from (select {words} as w))"

    values = ", ".join(f"({_text(i)}, {_text(t)})" for i, t in templates)
    return f"""
    with template as (select template_id, {shingles('template')} as s from (values {values}) v(template_id, template)),
    doc as materialized (select doc_id, {shingles("coalesce(text, '')")} as s from {docs}),
    pairs as (select doc_id, template_id, cast(len(list_intersect(t.s, d.s)) as bigint) as n_found, cast(len(t.s) as bigint) as n_shingles from doc d cross join template t)
    select * from pairs where n_shingles > 0 and 100 * n_found >= {license_scan.CONTAINMENT_PERCENT} * n_shingles"""


def quality_sql(docs: str = "documents") -> str:
    """The rows of op4: documents that the references of the code, as literals, keep are pooled, and all are judged by that."""
    rest = lambda pattern: f"length(regexp_replace(b, '{pattern}', '', 'g'))"
    counts = [f"length(b) - {rest(p.replace(chr(39), chr(39) * 2))}" for p in ("[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+")]
    counts += [rest("[\\x00-\\x7F]+"), f"length(b) - {rest(_SPACE)}"]
    common = " ".join(
        f"when {_text(language)} then list_transform([{', '.join(map(_text, listed))}], lambda c: len(list_filter(plain, lambda x: x = c)))" for language, listed in quality.COMMON_WORDS.items()
    )
    listed = lambda xs: "[" + ", ".join(f"{x}e0" for x in xs) + "]"
    references = ", ".join(f"({_text(language)}, {listed(classes)}, {listed(words)})" for language, (classes, words) in quality.REFERENCES.items())
    distance = lambda p, q: f"""case when list_sum({p}) > 0 and list_sum({q}) > 0 then round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i:
            (case when {p}[i] > 0 then {p}[i] / list_sum({p}) * log2(2 * {p}[i] / list_sum({p}) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) else 0 end)
            + (case when {q}[i] > 0 then {q}[i] / list_sum({q}) * log2(2 * {q}[i] / list_sum({q}) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) else 0 end))) / 2, 0)), 9) end"""  # noqa: E731
    bad = "(len(w) < 10 or 100 * coalesce(r.n, 0) > 20 * len(w))"
    far = f"(coalesce({distance('c', 'rc')}, 0) > {quality.MAX_CLASS_DISTANCE} or coalesce({distance('m', 'rm')}, 0) > {quality.MAX_WORD_DISTANCE})"
    pool = lambda a, n: f"(select list(s order by i) from (select i, sum(case when list_sum({a}) > 0 then floor({a}[i] * 1e6 / list_sum({a})) else 0 end) as s from close_ k, unnest(range(1, {n + 1})) as t(i) where k.lang = o.lang group by i))"
    return f"""
    with doc as materialized (select row_number() over () as rid, *, coalesce(text, '') as b, {_words('text')} as w,
            list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+'), lambda x: x <> '') as plain,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') as lines from {docs}),
    window_ as (select rid, i, count(*) over (partition by rid, g) as n
        from (select rid, i, array_to_string(w[i : i + 4], ' ') as g from doc, unnest(generate_series(1, len(w) - 4)) as t(i) where len(w) > 5)),
    repeated as (select rid, count(distinct j) as n from window_, unnest(generate_series(i, i + 4)) as t(j) where window_.n > 1 group by rid),
    counted as (select rid, [{', '.join(counts)}] as c, case lang {common} end as m, len(plain) as n_plain from doc),
    hist as materialized (select rid, list_transform(list_append(c, (select length(b) from doc d where d.rid = counted.rid) - list_sum(c)), lambda x: cast(x as double)) as c,
            list_transform(list_append(m, n_plain - list_sum(m)), lambda x: cast(x as double)) as m from counted),
    fixed as (select * from (values {references}) v(lang, rc, rm)),
    close_ as materialized (select distinct doc.lang, c, m from doc join hist using (rid) left join repeated r using (rid) join fixed on fixed.lang = doc.lang
        where len(w) >= {quality.MIN_WORDS} and not {bad} and not {far}),
    pooled as (select lang, {pool('c', 7)} as pc, {pool('m', 13)} as pm from (select distinct lang from close_) o),
    ref as (select fixed.lang, coalesce(pc, rc) as rc, coalesce(pm, rm) as rm from fixed left join pooled using (lang)),
    judged as (select doc.*, coalesce(r.n, 0) as rep, {bad} as bad, case when len(w) >= {quality.MIN_WORDS} then {far} else false end as far
        from doc join hist using (rid) left join repeated r using (rid) left join ref on ref.lang = doc.lang)
    select doc_id, cast(len(w) as bigint) as n_words, cast({rest(_SPACE)} as bigint) as word_chars,
        cast(length(b) - {rest(quality.SYMBOLS)} as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(rep as bigint) as n_repeat_words, bad as base_failed, not bad and not far as kept from judged"""


def mixing_sql(percent: int, weights: Mapping[str, Mapping[str, int]], epochs: int, seed: int, docs: str = "documents") -> str:
    """The rows of op6."""
    number = "try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)"
    steps = [
        f"""row_ as materialized (select doc_id, case when {number} % 5 = 0 then 'web' when {number} % 5 < 3 then 'books' when {number} % 5 < 5 then 'forums' else 'other' end as domain,
            lang as language, source, cast(len({_words('text')}) as bigint) as tokens, coalesce(cast(doc_id as varchar), '') as id from {docs})""",
        "leaf as materialized (select domain, language, source, cast(sum(tokens) as bigint) as tokens from row_ group by all)",
        f"budget0 as (select cast(coalesce(sum(tokens), 0) as bigint) * {percent} // 100 as budget from leaf)",
    ]
    for depth, level in enumerate(mixing.LEVELS, 1):
        keys, above = list(mixing.LEVELS[:depth]), list(mixing.LEVELS[: depth - 1])
        weight = "case " + level + " " + " ".join(f"when {_text(k)} then {v}" for k, v in weights.get(level, {}).items()) + " else 1 end" if weights.get(level) else "1"
        over = ("partition by " + ", ".join(above) + " " if above else "") + f"order by capacity / weight, {level} nulls first"
        same = " and ".join(f"n.{k} is not distinct from p.{k}" for k in above) or "true"
        steps += [
            f"""node{depth} as (select {', '.join('n.' + k for k in keys)}, n.capacity, {weight.replace('case ' + level, 'case n.' + level)} as weight, p.budget
                from (select {', '.join(keys)}, cast(sum(tokens) * {epochs} as bigint) as capacity from leaf group by all) n join budget{depth - 1} p on {same})""",
            f"""ranked{depth} as (select *, budget - coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as free,
                sum(weight) over (w rows between current row and unbounded following) as weights from node{depth} window w as ({over}))""",
            f"filled{depth} as (select *, free * weight >= capacity * weights as fills from ranked{depth})",
            f"""rest{depth} as (select *, first_value(case when not fills then free end ignore nulls) over (w rows between unbounded preceding and unbounded following) as rest,
                first_value(case when not fills then weights end ignore nulls) over (w rows between unbounded preceding and unbounded following) as rest_weights,
                sum(case when fills then 0 else weight end) over (w rows between unbounded preceding and current row) as upto from filled{depth} window w as ({over}))""",
            f"""budget{depth} as materialized (select {', '.join(keys)}, cast(case when fills then capacity
                else least((rest * upto) // rest_weights - (rest * (upto - weight)) // rest_weights, capacity) end as bigint) as budget from rest{depth})""",
        ]
    steps += [
        """plan as materialized (select l.domain, l.language, l.source, b.budget // l.tokens as whole, b.budget % l.tokens as rest from leaf l join budget3 b
            on l.domain is not distinct from b.domain and l.language is not distinct from b.language and l.source is not distinct from b.source where b.budget > 0)""",
        f"""placed as materialized (select r.*, p.whole, p.rest, md5('{seed}:' || p.whole || ':' || r.id) as rank from row_ r join plan p
            on r.domain is not distinct from p.domain and r.language is not distinct from p.language and r.source is not distinct from p.source)""",
        """taken as (select *, whole + case when coalesce(sum(tokens) over (partition by domain, language, source order by rank
            range between unbounded preceding and current row exclude group), 0) < rest then 1 else 0 end as epochs from placed)""",
    ]
    return "with " + ",\n".join(steps) + "\nselect doc_id, domain, language, source, tokens, cast(e as bigint) as epoch from taken, unnest(range(0, epochs)) as t(e)"


def jaccard_sql(docs: str = "documents", shingle: int = 3, threshold: int = 90) -> str:
    """The rows of op8."""
    return f"""
    with recursive doc as materialized (select row_number() over () as rid, doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} as w from {docs}),
    shingled as materialized (select rid, doc_id, case when len(w) = 0 then [] when len(w) < {shingle} then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) end as s from doc),
    class as materialized (select min(rid) as c, list_sort(s) as k, any_value(s) as s, len(any_value(s)) as n from shingled where len(s) > 0 group by list_sort(s)),
    item as materialized (select c, n, unnest(s) as g from class),
    link as materialized (select a.c as a, b.c as b from item a join item b on a.g = b.g and a.c < b.c and 100 * a.n >= {threshold} * b.n and 100 * b.n >= {threshold} * a.n
        group by a.c, b.c, a.n, b.n having 100 * count(*) >= {threshold} * (a.n + b.n - count(*))),
    either as (select a, b from link union all select b, a from link),
    reach(c, r) as (select distinct a, a from either union select reach.c, either.b from reach join either on reach.r = either.a),
    least_ as (select c, min(r) as r from reach group by c),
    member as (select s.doc_id, len(s.s) as n, coalesce(l.r, k.c, -s.rid) as root from shingled s left join class k on len(s.s) > 0 and list_sort(s.s) = k.k left join least_ l on l.c = k.c)
    select doc_id, cast(n as bigint) as n_shingles, case when n = 0 then doc_id else min(doc_id) over (partition by root) end as component_id from member"""


def chat_sql(added: str) -> str:
    escaped = "replace(replace(replace(text, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"
    role = "replace(replace(replace(replace(replace(role, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>'), chr(10), '\\n'), ':', '\\:')"
    frame = len(chat_format._HEAD + chat_format._COLON + chat_format._TAIL)
    return f"""
    with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (
        select conv_id, turn, role, text from conversations union all select -7, 0, 'user', {_text(added)} union all select -7, 1, 'assistant', {_text(added)}))
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        cast(sum(length({role}) + length({escaped}) + {frame}) as bigint) as formatted_chars
    from turns group by conv_id"""


def filter_audit_sql(docs: str = "documents", labels: str = "labels") -> str:
    """The rows of op11, from each row's five verdicts."""
    letters = "('A'), ('B'), ('C'), ('D'), ('E')"
    taken = "s.filter_order[:s.step - 1]"
    before = f"len(list_intersect(d.fails, string_split({taken}, ''))) > 0"
    fails = "list_contains(d.fails, s.filter_order[s.step])"
    return f"""
    with label as (select doc_id, max(quality) as quality, max(toxic) as toxic from {labels} where doc_id is not null group by doc_id),
    doc as materialized (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {_words('text')} as w from {docs}),
    verdict as materialized (select part, doc_id, list_filter([
            case when len(w) < 100 then 'A' end, case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' end,
            case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' end, case when regexp_matches(t, '[#$%&*|]') then 'D' end,
            case when doc_id > min(doc_id) over (partition by t) then 'E' end], lambda x: x is not null) as fails from doc),
    d as materialized (select v.part, v.fails, coalesce(l.quality = 1, false) as good, coalesce(l.toxic = 1, false) as toxic, count(*) as n
        from verdict v left join label l on v.doc_id = l.doc_id group by all),
    orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from (values {letters}) a(x), (values {letters}) b(x), (values {letters}) c(x), (values {letters}) d(x), (values {letters}) e(x)
        where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select filter_order, cast(k as int) as step from orders, range(1, 6) r(k)),
    counted as (select d.part, s.filter_order, s.step, s.filter_order[s.step] as f,
            sum(case when not ({before}) and not ({fails}) then n else 0 end) as kept, sum(case when not ({before}) and {fails} then n else 0 end) as removed,
            sum(case when {before} and {fails} then n else 0 end) as redundant, sum(case when len(d.fails) = 1 and {fails} then n else 0 end) as unique_fails,
            sum(case when not ({before}) and {fails} and good then n else 0 end) as good_lost, sum(case when not ({before}) and {fails} and toxic then n else 0 end) as toxic_lost
        from d, s group by all)
    select part, filter_order, step, {', '.join(f'cast({c} as bigint) as {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
        cast(sum(removed) over (partition by part, f) as bigint) as shapley from counted"""


def clustering_sql(k: int, rounds: int, size: int, scale: int, seed: str, vectors: str = "embeddings") -> str:
    """The rows of op12, a round after the other."""
    steps = [
        f"""kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda c: cast(floor({scale} * cast(c as double)) as bigint)) as x from {vectors}
            where len(embedding) = {size} and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = {size})""",
        f"item as materialized (select rid, unnest(x) as x, unnest(range({size})) as i from kept)",
        f"""first_ as (select row_number() over (order by sha256({_text(seed + ':')} || coalesce(cast(vec_id as varchar), '')), x) - 1 as c, x from kept qualify c < {k})""",
        f"centre0 as materialized (select c, unnest(x) as x, unnest(range({size})) as i from first_)",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} as materialized (select rid, c, d from (select v.rid, m.c, cast(sum((v.x - m.x) * (v.x - m.x)) as bigint) as d from item v join centre{r} m on v.i = m.i group by v.rid, m.c)
                qualify row_number() over (partition by rid order by d, c) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""centre{r + 1} as materialized (select m.c, coalesce(n.x, m.x) as x, m.i from centre{r} m left join (
                    select c, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x from near{r} join item using (rid) group by c, i) n on n.c = m.c and n.i = m.i)"""
            )
    return "with " + ",\n".join(steps) + f"""
    select k.vec_id, cast(n.c as int) as cluster, n.d as distance, cast(sum(n.d) over (partition by n.c) as bigint) as cluster_inertia, cast(sum(n.d) over () as bigint) as inertia, s.centroid_sha256
    from near{rounds} n join kept k using (rid) join (select c, sha256(string_agg(x, ',' order by i)) as centroid_sha256 from centre{rounds} group by c) s on s.c = n.c"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bit = "xor(a >> 1, 3988292384 * (a & 1))"
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: cast(ascii(c) as bigint))),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {bit})), 4294967295)"""


def lm_scoring_sql(docs: str = "documents") -> str:
    """The rows of op13; the end of a text is the empty word."""
    strength, step = language_model.STRENGTH, language_model.STEP
    return f"""
    with doc as materialized (select row_number() over () as rid, doc_id, {_crc32("coalesce(cast(doc_id as varchar), '')")} % 10 = 0 as held_out,
            list_append({_words(f"translate(text, '{_UPPER}', '{_LOWER}')")}, '') as w from {docs}),
    token as materialized (select rid, held_out, unnest(w) as t, unnest(list_prepend(null, w[:-2])) as v from doc),
    word as materialized (select t, count(*) as c from token where not held_out group by t),
    total as materialized (select coalesce(sum(c), 0) as n, count(*) as types from word),
    pair as materialized (select v, t, count(*) as c from token where not held_out and v is not null group by all),
    one as materialized (select k.rid, k.t, k.v, coalesce(w.c, 0) as c, coalesce(u.c, 0) as cv, p.c as cp,
            (coalesce(w.c, 0) + 0.1) / (x.n + 0.1 * (x.types + 1)) as p1 from token k cross join total x
        left join word w on w.t = k.t left join word u on u.t = k.v left join pair p on p.v = k.v and p.t = k.t),
    scored as (select rid, count(*) as n_tokens, count(*) filter (c > 0) as n_known, sum(log10(p1)) as base_score,
            sum(case when v is null then log10(p1) when cp is null then log10({strength} / (cv + {strength})) + log10(p1)
                else round(log10((cp + {strength} * p1) / (cv + {strength})) / {step}) * {step} end) as score from one group by rid)
    select doc_id, held_out, n_tokens, n_known, cast(x.n as bigint) as train_tokens, base_score, score from scored join doc using (rid) cross join total x"""
