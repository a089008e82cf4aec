"""DuckDB fragments for the derived columns, for use in the queries' SQL."""

from __future__ import annotations

from meibo.functions import derive as d
from meibo.schema import PREFECTURES, REGIONS

_P = "|".join(PREFECTURES)


def t(c: str) -> str:
    return f"coalesce({c}, '')"


def first(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"


def rules(c: str, table, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in table) + f" ELSE '{default}' END"


PREF = first(f"trim({t('address')}, ' ')", f"({_P})")
CITY = first(f"trim({t('address')}, ' ')", f"(?:{_P})([^0-9０-９ 　－-]+?(?:市|区|町|村))")
REGION = "CASE " + " ".join(f"WHEN prefecture IN ({', '.join(repr(p) for p in ps)}) THEN '{r}'" for r, ps in REGIONS.items()) + " END"
_E = t("established_date")
_DIGITS = f"regexp_replace({_E}, '[^0-9]', '', 'g')"
YM = f"""CASE WHEN trim({_E}, ' ') = '' THEN NULL WHEN length({_DIGITS}) >= 6 THEN substr({_DIGITS}, 1, 6)
 WHEN regexp_matches({_E}, '[12][0-9]{{3}}[^0-9]*[0-9]')
 THEN {first(_E, '([12][0-9]{3})')} || lpad({first(_E, '[12][0-9]{3}[^0-9]*([0-9]{1,2})')}, 2, '0') END"""
_C = f"trim({t('capital')}, ' ')"
CAPITAL = f"""CASE WHEN regexp_matches({_C}, '{d.NUMBER}') THEN try_cast({_C} AS decimal(38,6))
 WHEN regexp_replace({_C}, '[^0-9]', '', 'g') <> '' THEN try_cast(regexp_replace({_C}, '[^0-9]', '', 'g') AS decimal(38,6)) END"""
_N = f"regexp_replace({t('employee_count')}, '[,，]', '', 'g')"
_PERSONS = r"([0-9]+)[ \t\r\n\f\x0B]*(?:名|人)"


def _before(words: str) -> str:
    return f"try_cast({first(_N, f'(?:{words})[^0-9]{{0,12}}{_PERSONS}')} AS decimal(38,6))"


def _after(words: str) -> str:
    return f"try_cast({first(_N, f'{_PERSONS}[^0-9]{{0,12}}(?:{words})')} AS decimal(38,6))"


_KINDS = f"regexp_extract_all({_N}, '(?:{d.EMPLOYMENT})[^0-9]{{0,12}}{_PERSONS}', 1)"
EMPLOYEES = f"""coalesce({_before(d.CONSOLIDATED)}, {_after(d.CONSOLIDATED)},
 CASE WHEN len({_KINDS}) >= 2 THEN cast(list_sum(list_transform({_KINDS}, lambda x: cast(x AS bigint))) AS decimal(38,6)) END,
 {_before(d.STANDALONE)}, {_after(d.STANDALONE)},
 cast(list_max(list_transform(regexp_extract_all({_N}, '{_PERSONS}', 1), lambda x: cast(x AS bigint))) AS decimal(38,6)),
 CASE WHEN regexp_matches({_N}, '^[0-9]+$') THEN try_cast({_N} AS decimal(38,6)) END)"""
INDUSTRY = rules(f"trim({t('big_industry')}, ' ')", d.INDUSTRY_RULES, d.OTHER)
TAG_PARENT = rules("trim(tag, ' ')", d.TAG_RULES, d.OTHER)
TAGS = f"list_filter(list_transform(regexp_split_to_array({t('tag')}, '\\s*;\\s*'), lambda x: trim(x, ' ')), lambda x: x <> '')"
BLANK = "regexp_replace(coalesce({0}, ''), '[\\s　]+', '', 'g') = ''"
