"""Parts of DuckDB SQL that several queries share: folds over ordered rows, common subsequences, amounts in words."""

from __future__ import annotations

from docledger.functions import words


def fold(rows: str, by: str, order: str, empty: str, step: str, out: str) -> str:
    """A fold over the rows of each group in order. rows: SQL of a table; empty: the first state; step: SQL of `s2` (the new state) and
    other columns from o (the row) and s (the state before); out: the columns to give.
    """
    return f"""select {out} from (with recursive ordered as (select *, row_number() over (partition by {by} order by {order}) as nth from ({rows}) q),
 f as (select *, cast(0 as bigint) as upto, {empty} as s2 from ordered where nth = 1
  union all select o.*, o.nth as upto, {step} from (select f.s2 as s, f.upto, f.{by} as whose from f) p join ordered o on o.{by} = p.whose and o.nth = p.upto + 1)
 select * from f where upto > 0) folded"""


def ratio(pairs: str, a: str, b: str) -> str:
    """SQL of a table (a, b, ratio): twice the longest common subsequence over both lengths, in percent, of distinct pairs of texts."""
    return f"""(with recursive p as (select distinct {a} as a, {b} as b from ({pairs}) q),
 l as (select a, b, 0 as i, list_transform(range(len(b) + 1), lambda x: 0) as r from p
  union all select a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_slice(t, 1, j))) from (
   select a, b, i, list_transform(range(1, len(b) + 2), lambda j: case when j = 1 then 0 else greatest(r[j], r[j - 1] + case when substr(a, i + 1, 1) = substr(b, j - 1, 1) then 1 else 0 end) end) as t from l where i < len(a)) s)
 select a, b, case when len(a) + len(b) = 0 then 100.0 else 200.0 * r[len(b) + 1] / (len(a) + len(b)) end as ratio from l where i = len(a))"""


def _small(n: str) -> str:
    """A number below 100 in words."""
    units = "[" + ", ".join(f"'{w}'" for w in words.UNITS) + "]"
    tens = "[" + ", ".join(f"'{w}'" for w in words.TENS) + "]"
    return f"(case when {n} < 20 then {units}[{n} + 1] else {tens}[{n} // 10 - 1] || case when {n} % 10 > 0 then ' ' || {units}[{n} % 10 + 1] else '' end end)"


def in_words(whole: str) -> str:
    """A whole number below a thousand millions in words, with the Indian scales."""
    parts = [f"case when {whole} // {s} {'' if s == 10_000_000 else f'% {m}'} > 0 then {_small(f'({whole} // {s}' + ('' if s == 10_000_000 else f' % {m}') + ')')} || ' {name}' end" for s, m, name in ((10_000_000, 0, "crore"), (100_000, 100, "lakh"), (1_000, 100, "thousand"), (100, 10, "hundred"))]
    last = f"case when {whole} % 100 > 0 or {whole} = 0 then {_small(f'({whole} % 100)')} end"
    return f"concat_ws(' ', {', '.join([*parts, last])})"


def rupees(amount: str) -> str:
    """An amount of two places in words."""
    whole, paise = f"cast(floor({amount}) as bigint)", f"cast(round(({amount} - floor({amount})) * 100) as bigint)"
    return f"({in_words(whole)} || ' rupees' || case when {paise} > 0 then ' and ' || {_small(paise)} || ' paise' else '' end || ' only')"
