"""Porter's suffix stripping as SQL common table expressions, to check the engine's own against."""

from __future__ import annotations

from sparkloom.functions.porter import DOUBLE_SUFFIXES, ENDINGS, FULL_SUFFIXES


def _shape(word: str) -> str:
    """V or C for each letter; y is a vowel after a consonant."""
    s = f"regexp_replace(regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(4):  # runs of up to eight y
        s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
    return s


def _cut(n: int, of: str = "w") -> str:
    return f"left({of}, length({of}) - {n})"


def _more(shape: str, least: int) -> str:
    """The measure is more than ``least``."""
    return f"regexp_matches({shape}, '{'.*'.join(['VC'] * (least + 1))}')"


def _short_end(word: str, shape: str) -> str:
    return f"(ends_with({shape}, 'CVC') and not regexp_matches({word}, '[wxy]$'))"


def _suffixes(rules: list[tuple[str, str]]) -> str:
    cases = [f"when ends_with(w, '{x}') then case when {_more(_cut(len(x), 's'), 0)} then concat({_cut(len(x))}, '{new}') else w end" for x, new in sorted(rules, key=lambda r: -len(r[0]))]
    return f"case {' '.join(cases)} else w end"


def _endings() -> str:
    cases = []
    for x in sorted(ENDINGS, key=len, reverse=True):
        able = _more(_cut(len(x), "s"), 1) + (f" and regexp_matches({_cut(3)}, '[st]$')" if x == "ion" else "")
        cases.append(f"when ends_with(w, '{x}') then case when {able} then {_cut(len(x))} else w end")
    return f"case {' '.join(cases)} else w end"


def stem_sql(vocabulary: str, name: str) -> str:
    """CTEs up to ``name`` (term, stem) for the terms, of three letters or more, of the relation ``vocabulary``."""
    doubled = "length(w) > 1 and right(w, 1) = right(left(w, length(w) - 1), 1) and ends_with(s, 'C') and not regexp_matches(w, '[lsz]$')"
    one = f"({_more('s', 0)} and not {_more('s', 1)})"
    rest, rest_shape = _cut(1), _cut(1, "s")
    steps = [
        f"case when ends_with(w, 'sses') or ends_with(w, 'ies') then {_cut(2)} when ends_with(w, 'ss') then w when ends_with(w, 's') then {_cut(1)} else w end",
        f"case when ends_with(w, 'eed') then case when {_more(_cut(3, 's'), 0)} then {_cut(1)} else w end"
        f" when ends_with(w, 'ed') and contains({_cut(2, 's')}, 'V') then concat({_cut(2)}, '+') when ends_with(w, 'ing') and contains({_cut(3, 's')}, 'V') then concat({_cut(3)}, '+') else w end",
        f"case when not cut then w when regexp_matches(w, '(at|bl|iz)$') then concat(w, 'e') when {doubled} then {_cut(1)} when {one} and {_short_end('w', 's')} then concat(w, 'e') else w end",
        f"case when ends_with(w, 'y') and contains({_cut(1, 's')}, 'V') then concat({_cut(1)}, 'i') else w end",
        _suffixes(DOUBLE_SUFFIXES),
        _suffixes(FULL_SUFFIXES),
        _endings(),
        f"case when ends_with(w, 'e') and ({_more(rest_shape, 1)} or ({_more(rest_shape, 0)} and not {_more(rest_shape, 1)} and not {_short_end(rest, rest_shape)})) then {rest} else w end",
        f"case when ends_with(w, 'll') and {_more('s', 1)} then {_cut(1)} else w end",
    ]
    made, last = [], f"(select term, term as w from {vocabulary})"
    for n, step in enumerate(steps):
        # a word that lost -ed or -ing has a mark behind it for one step
        word = f"(select term, rtrim(w, '+') as w, ends_with(w, '+') as cut from {last})"
        made.append(f"{name}_{n} as materialized (select term, {step} as w from (select *, {_shape('w')} as s from {word}))")
        last = f"{name}_{n}"
    return ", ".join(made) + f", {name} as (select term, w as stem from {last})"
