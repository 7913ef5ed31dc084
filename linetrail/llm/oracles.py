"""Longer DuckDB SQL of this package's queries."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DIVERGENCE = f"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
groups as (select distinct lang, source from d),
t as (select i, lang, source, unnest(ts) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct i) >= 30),
v as (select lang, cast(count(*) as hugeint) as v from kept group by lang),
c as (select t.lang, source, t.term, count(*) as n from t join kept k on t.lang = k.lang and t.term = k.term group by all),
cells as (select g.lang, g.source, k.term, cast(coalesce(c.n, 0) as hugeint) as n from groups g join kept k on g.lang = k.lang
          left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
gn as (select lang, source, sum(n) as total from cells group by lang, source),
gp as (select cells.lang, cells.source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) as p
       from cells join gn on cells.lang = gn.lang and cells.source = gn.source join v on v.lang = cells.lang),
lc as (select lang, term, sum(n) as n from cells group by lang, term),
ln as (select lang, sum(n) as total from lc group by lang),
lp as (select lc.lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) as q from lc join ln on lc.lang = ln.lang join v on v.lang = lc.lang),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
        from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
ahead as (select gp.lang, gp.source, 'term' as part, gp.term as item, cast(p - q as bigint) as value
          from gp join lp on gp.lang = lp.lang and gp.term = lp.term where n > 0 and p > q),
everything as (select * from pairs union all select * from ahead),
placed as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from everything)
select * from placed where part = 'pair' or rank <= 50"""


def _merkle(leaf_levels: int = 8, group_levels: int = 4) -> str:
    """Trees of up to ``8 ** leaf_levels`` leaves, level by level; a level without a run of its own passes nodes on."""
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    crc = ("xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id as varchar), ''), "
           "lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), "
           "lambda x, y: case when xor(x, y) % 2 = 1 then xor(xor(x, y) // 2, 3988292384::bigint) else xor(x, y) // 2 end), 4294967295::bigint)")
    out = [f"""with docs as (select doc_id, coalesce('v' || lang, '') as g, sha256({fields('text')}) as leaf,
 sha256({fields(f"case when {crc} % 3 = 0 then translate(text, {_AZ}) else text end")}) as altered from documents),
ranked as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as rank from docs),
n0 as (select g, rank as i, leaf as h from ranked)"""]

    def level(k: int, nodes: str, keys: str, made: str, sides: str) -> str:
        by = f"partition by {keys}" if keys else ""
        run = f"partition by {keys + ', ' if keys else ''}i // 8 order by i"
        pick = keys + ", " if keys else ""
        return f"""{sides} as (select {pick}i, h, count(*) over ({by}) > 1 as many,
 coalesce(string_agg(h, '') over ({run} rows between unbounded preceding and 1 preceding), '') as l,
 coalesce(string_agg(h, '') over ({run} rows between 1 following and unbounded following), '') as r from {nodes}),
{made} as (select {pick}i // 8 as i, case when bool_and(many) then sha256(string_agg(h, '' order by i)) else any_value(h) end as h from {sides} group by {pick}i // 8)"""
    for k in range(leaf_levels):
        out.append(level(k, f"n{k}", "g", f"n{k + 1}", f"s{k}"))
    out.append(f"m0 as (select g, row_number() over (order by g) - 1 as i, h from n{leaf_levels})")
    for k in range(group_levels):
        out.append(level(k, f"m{k}", "", f"m{k + 1}", f"t{k}"))
    steps, joins = [], []
    for k in range(leaf_levels):
        joins.append(f"join s{k} on s{k}.g = r.g and s{k}.i = r.rank // {8 ** k}")
        steps.append(f"s{k}")
    joins.append("join m0 on m0.g = r.g")
    for k in range(group_levels):
        joins.append(f"join t{k} on t{k}.i = m0.i // {8 ** k}")
        steps.append(f"t{k}")
    proof = " || ".join(f"case when {s}.many then {s}.l || {s}.r else '' end" for s in steps)
    top = ", ".join(f"{s}.many as many{j}, {s}.l as l{j}, {s}.r as r{j}" for j, s in enumerate(steps))
    out.append(f"""f0 as (select r.doc_id, r.leaf, m0.h as subroot, m{group_levels}.h as root, sha256({proof}) as proof_sha256, r.altered as x, {top}
 from ranked r {' '.join(joins)} cross join m{group_levels})""")
    for j in range(len(steps)):
        out.append(f"f{j + 1} as (select * replace (case when many{j} then sha256(l{j} || x || r{j}) else x end as x) from f{j})")
    return ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, proof_sha256, x as folded_root, x = root as verified from f{len(steps)}"


MERKLE = _merkle()
