"""Canonical text of companies, titles, terms and places, as Column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(value: str | int) -> str:
    """A literal of Spark SQL."""
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> Column:
    """A literal array, parsed at once: a call for each element would take longer than the query."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def mapping(table: dict) -> Column:
    """A literal map."""
    return F.expr(f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in table.items())})")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a plain expression would repeat it at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words."""
    return "|".join(rf"\b{re.escape(p)}\b" for p in phrases)


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has something to keep: (from, to, longer results).

    Built from the Unicode tables by rule, for every code point: decompose, drop combining
    marks, lower. Combining marks come last in ``from`` and so are deleted by ``translate``.
    """
    single, plain, longer, marks = [], [], {}, []
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if not unicodedata.combining(char) and not unicodedata.decomposition(char):
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
        if not folded:
            marks.append(char)
        elif re.search("[a-z0-9&]", folded):
            if len(folded) == 1:
                single.append(char)
                plain.append(folded)
            else:
                longer[char] = folded
    return "".join(single) + "".join(marks), "".join(plain), longer


def _folded(text: Column) -> Column:
    """The text with all characters folded: a hashed table for those that fold to one, a search table for those that fold to several."""
    source, target, longer = _folds()
    # a class of scattered characters is tried one by one; cut with a range, it is tried for the few characters beyond Latin-1 only
    low, high = ({c: v for c, v in longer.items() if (c > "\xff") == beyond} for beyond in (False, True))
    near, far = mapping(low), mapping(high)
    one = lambda c: F.coalesce(F.when(c > "\xff", F.try_element_at(far, c)).when(c > "\x7f", F.try_element_at(near, c)), c)
    split = F.array_join(F.transform(F.split(text, ""), one), "")
    text = F.when(text.rlike(f"[{''.join(low)}[\u0100-\U0010ffff&&[{''.join(high)}]]]"), split).otherwise(text)
    return F.translate(text, source, target)


def basic_text(text: Column | str) -> Column:
    """No accents, lower case, ``&`` as "and", everything but a-z and 0-9 as one space. Null is empty."""
    text = let(F.coalesce(col(text), F.lit("")), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), _folded(t)).otherwise(t))
    text = F.replace(F.lower(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalize_company(company: Column | str) -> Column:
    """Legal suffixes off the end, then aliases."""
    name = F.regexp_replace(basic_text(company), "^the ", "")
    name = F.regexp_replace(name, rf"(?:(?:^| )(?:{'|'.join(R.LEGAL_SUFFIXES)}))+$", "")
    aliases = mapping(R.COMPANY_ALIASES)
    return let(name, lambda n: F.coalesce(F.try_element_at(aliases, n), n))


def without_dates(text: Column) -> Column:
    for pattern in (R.SEASON_YEAR, R.BARE_YEAR, R.REQUISITION):
        text = F.regexp_replace(text, pattern, " ")
    return text


def _tokens(text: Column, dropped: list[str]) -> Column:
    held = strings(["", *dropped])
    return F.filter(F.split(text, " +"), lambda t: ~F.array_contains(held, t))


def paren_is_noise(inner: Column) -> Column:
    """Nothing in the parenthesis tells one posting from another."""
    rest = _tokens(without_dates(basic_text(inner)), [*R.TITLE_NOISE, *R.SEASONS, *R.PAREN_NOISE])
    return F.size(rest) == 0


def _unwrapped(title: Column) -> Column:
    """Noise in parentheses dropped, the rest taken into the title."""
    pattern = r"[(\[{]([^)\]}]*)[)\]}]"
    inner = F.regexp_extract_all(title, F.lit(pattern), F.lit(1))
    outer = F.split(title, pattern)
    inner = F.transform(inner, lambda p: F.when(paren_is_noise(p), F.lit(" ")).otherwise(F.concat(F.lit(" "), p, F.lit(" "))))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(outer.alias("o"), inner.alias("i")), lambda x: F.array(x["o"], F.coalesce(x["i"], F.lit(""))))), "")
    return F.when(title.rlike(pattern), joined).otherwise(title)


def split_level(text: Column) -> tuple[Column, Column]:
    """(stem, level or null); the last marker gives the level, all trailing ones are peeled."""
    tail = rf"(?:\s+{R.LEVEL_MARK})+$"
    last = F.regexp_extract(text, rf"\s+({R.LEVEL_MARK})$", 1)
    mark = F.regexp_extract(last, r"^(?:(?:level|lvl|grade|band)\s*|(?:ic|[lept])\s?(?=\d))?(.+)$", 1)
    words = mapping(R.LEVEL_WORDS)
    level = F.coalesce(F.try_element_at(words, mark), mark.try_cast("int"))
    return F.trim(F.regexp_replace(text, tail, "")), level


def normalize_title(title: Column | str) -> Column:
    """The words that tell one role from another, with a level above entry at the end."""
    text = basic_text(let(F.coalesce(col(title), F.lit("")), _unwrapped))
    text = without_dates(F.regexp_replace(text, R.CLASS_OF, " "))
    for phrase in R.TITLE_PHRASES_DROPPED:
        text = F.regexp_replace(text, phrase, " ")
    for phrase, other in R.TITLE_REWRITES:
        text = F.regexp_replace(text, phrase, other)
    return let(F.array_join(_tokens(text, [*R.TITLE_NOISE, *R.SEASONS]), " "), _with_level)


def _with_level(text: Column) -> Column:
    stem, level = split_level(text)
    stem = F.regexp_replace(stem, r"(?<!\S)(\S+)(?: \1)+(?!\S)", "$1")
    return F.concat(stem, let(level, lambda n: F.when(n > 1, F.concat(F.lit(" l"), n.cast("string"))).otherwise("")))


def primary_location(location: Column | str) -> Column:
    """The first place of several, with a short code after it joined on."""
    parts = F.filter(F.transform(F.split(F.trim(F.coalesce(col(location), F.lit(""))), R.SEVERAL_PLACES), lambda p: F.trim(p)), lambda p: p != "")

    def joined(some: Column) -> Column:
        first, second = F.coalesce(F.get(some, F.lit(0)), F.lit("")), F.get(some, F.lit(1))
        return F.when(second.rlike(r"^\p{L}{1,3}$"), F.concat_ws(" ", first, second)).otherwise(first)

    return let(parts, joined)


def has_marker(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in R.REMOTE_MARKERS])


def is_remote(location: Column | str, hint: Column | str) -> Column:
    """The hint where given; hybrid is not remote."""
    return F.coalesce(col(hint), let(basic_text(location), lambda t: ~t.contains("hybrid") & has_marker(t)))


def with_state_codes(text: Column) -> Column:
    """N8, first half: spelled-out states as codes, longest first."""
    for name in sorted(R.STATE_NAMES, key=len, reverse=True):
        text = F.regexp_replace(text, rf"\b{name}\b", R.STATE_NAMES[name])
    return text


def split_country(text: Column) -> tuple[Column, Column]:
    """N8, second half: (rest, country code or null) of one trailing country name."""
    pattern = rf"\s*\b({'|'.join(sorted(R.COUNTRIES, key=len, reverse=True))})\s*$"
    table = mapping(R.COUNTRIES)
    return F.trim(F.regexp_replace(text, pattern, "")), F.try_element_at(table, F.regexp_extract(text, pattern, 1))


def state_of(core: Column) -> Column:
    """The state code at the end, or null."""
    code = F.regexp_extract(core, r"\b([a-z]{2})$", 1)
    return F.when(code.isin(R.STATES), code)


def _term_in(text: Column) -> Column:
    """The term that a canonical text names, or null."""
    table = mapping({f"{season}{year % 100}": term for (season, year), term in R.TERM_OF_SEASON.items()})

    def first_term(pattern: str, season: int, year: int) -> Column:
        pairs = F.zip_with(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(season)), F.regexp_extract_all(text, F.lit(pattern), F.lit(year)), lambda s, y: F.try_element_at(table, F.concat(s, y))
        )
        return F.get(F.filter(pairs, lambda t: t.isNotNull()), F.lit(0))

    new_grad = reduce(lambda a, b: a | b, [text.contains(m) for m in R.NEW_GRAD_MARKERS])
    new_grad = new_grad | text.rlike(r"\bclass of (?:'|20)?27\b")
    new_grad = new_grad | (text.rlike(r"^graduate\s+(?!research\b)") & ~text.rlike(r"\b(intern|internship|co op|coop)\b"))
    return F.coalesce(first_term(R.SEASON_YEAR, 1, 2), first_term(R.YEAR_SEASON, 2, 1), F.when(new_grad, "new-grad"))


def named_term(text: Column | str) -> Column:
    """The term that a text names, or null. A text of ASCII characters without any sign of one needs no canonical form."""
    plain = F.octet_length(col(text)) == F.char_length(col(text))
    sign = let(F.lower(col(text)), lambda t: reduce(lambda a, b: a | b, [t.contains(s) for s in R.TERM_SIGNS]))
    return F.when(~plain | sign, let(basic_text(text), _term_in))


def infer_term(title: Column | str, body: Column | str, default: Column | str, of_title: Column | None = None) -> Column:
    """The title's term (``of_title`` where it is known), else the body's, else the source's default where valid, else unknown."""
    given = F.lower(F.trim(col(default)))
    return F.coalesce(named_term(title) if of_title is None else of_title, named_term(body), F.when(given.isin(R.TERMS), given), F.lit("unknown"))


def dedupe_key(company: Column | str, title: Column | str, location: Column | str, term: Column | str) -> Column:
    return F.concat_ws("|", col(company), col(title), col(location), col(term))


def posting_id(key: Column | str) -> Column:
    """N11."""
    return F.substr(F.sha2(col(key), 256), F.lit(1), F.lit(16))


def role_head(title: Column | str) -> Column:
    """The part of a title that names the function."""
    return F.trim(F.get(F.split(F.coalesce(col(title), F.lit("")), R.ROLE_HEAD_END, 2), F.lit(0)))


def min_years(body: Column | str) -> Column:
    """The smallest number of required years from 1 to 30, or null; a body that has no "year" is not searched."""
    years = F.transform(F.regexp_extract_all(F.coalesce(col(body), F.lit("")), F.lit("(?iU)" + R.YEARS), F.lit(1)), lambda y: y.try_cast("int"))
    return F.when(F.lower(col(body)).contains("year"), F.array_min(F.filter(years, lambda y: (y > 0) & (y <= 30))))
