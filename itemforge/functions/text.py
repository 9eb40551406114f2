"""Text as Column functions: cleaning, folding, hashing, masking, matching, markers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of typeset text and what they stand for; the last line is dropped.
TYPOGRAPHY = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    " ": " ", " ": " ", " ": " ", " ": " ",
    "﻿": "", "​": "", "‌": "", "‍": "", "­": "",
}
#: Punctuation that counts as legible.
PUNCTUATION = ".,;:!?()[]{}\"'`´/\\|@#$%&*+-=<>_~^°ºª§–—…"
#: Delimiters after a marker, and words before a question's number, without accents.
DELIMITERS = ".)]:-‐‑‒–—―"
QUESTION_WORD = r"^(questao|quest\.|q\.)\s*"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


@lru_cache(maxsize=1)
def _compatibility() -> tuple[str, str, str, dict[str, str], dict[str, str]]:
    """What NFKC does to single characters of the basic plane, by rule: those that become one other, as
    two strings; a class of all that it may change; those that become several or none; and sequences
    of a letter and marks that become one letter."""
    one, several, joined, changed = {}, {}, {}, []
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(code)
        new, apart = unicodedata.normalize("NFKC", c), unicodedata.normalize("NFD", c)
        if new != c:
            (one if len(new) == 1 else several)[c] = new
        if new != c or unicodedata.combining(c):
            changed.append(code)
        if len(apart) > 1 and not 0xAC00 <= code < 0xD7B0 and unicodedata.normalize("NFC", apart) == c:
            joined[apart] = c
    return "".join(one), "".join(one.values()), _char_class(changed), several, joined


def _lookup(text: Column, pattern: str, table: dict[str, str]) -> Column:
    """The text with each match of a pattern that the table has replaced by what the table says. Only the
    distinct matches are looked up."""
    pairs = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, text, lambda done, x: F.replace(done, x, F.coalesce(F.try_element_at(pairs, x), x)))


def _translated(text: Column, before: str, after: str) -> Column:
    """F.translate() of characters beyond ASCII: each distinct one that stands in the text is replaced by
    itself, since F.translate() looks up every character."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_char_class(sorted(map(ord, before)))), F.lit(0)))
    return F.aggregate(found, text, lambda done, x: F.replace(done, x, F.translate(x, before, after)))


def _beyond(text: Column) -> Column:
    """Whether a text has a character beyond ASCII."""
    return text.rlike(r"[^\x00-\x7F]")


def _odd(text: Column) -> Column:
    """Whether a text has anything but single spaces and visible ASCII, so that cleaning may do more than trim."""
    return text.rlike(r"[^\x20-\x7E]") | F.contains(text, F.lit("  "))


def compose(text: Column) -> Column:
    """NFKC of a text, by Spark's own functions, for characters of the basic plane and for letters with
    up to two marks. A text without any character that NFKC could change is not touched."""
    before, after, changed, several, joined = _compatibility()
    alone = _char_class(sorted(map(ord, several)))

    def composed(t: Column) -> Column:
        single = _lookup(_translated(t, before, after), alone, several)
        return _lookup(_lookup(single, r"\P{M}\p{M}{2}", joined), r"\P{M}\p{M}", joined)

    # Most texts have no character beyond ASCII and the letters of Latin-1, and are not looked at again.
    other = text.rlike(r"[^\x00-\x7F\xC0-\xFF]")
    return F.when(other, _let(text, lambda t: F.when(t.rlike(changed), composed(t)).otherwise(t))).otherwise(text)


def clean(text: Column) -> Column:
    """NFKC, typographic characters as plain ones, white space collapsed and trimmed, null as empty."""
    kept = {k: v for k, v in TYPOGRAPHY.items() if v}
    gone = "".join(k for k, v in TYPOGRAPHY.items() if not v)

    def plain(t: Column) -> Column:
        t = F.replace(compose(t), F.lit("…"), F.lit("..."))
        return F.regexp_replace(_translated(t, "".join(kept) + gone, "".join(kept.values())), r"(?U)[\s&&[^ ]]\s*| \s+", " ")

    # Only white space that is not a single space is touched.
    return _let(F.coalesce(text, F.lit("")), lambda t: F.trim(F.when(_beyond(t), plain(t)).otherwise(F.regexp_replace(t, r"[\t-\r]\s*| \s+", " "))))


def _char_class(codes: list[int]) -> str:
    """A pattern for one of the characters, none of them ASCII, by runs. Plain characters are refused by one
    comparison, since a class of many runs is slow."""
    runs = [[codes[0], codes[0]]]
    for code in codes[1:]:
        if code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return r"[[^\x00-\x7F]&&[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]]"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str, dict[str, str], str]:
    """What is left of a character of the basic plane when its decomposition loses all combining marks,
    by rule: those that become one other character, as two strings; those that become several; and a
    class of the marks themselves. Hangul syllables are left whole on purpose: their parts are no
    marks, and whole they equal what clean() composes."""
    one, several, marks = {}, {}, []
    for code in [*range(0xC0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(code)
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if base != c:
            (one if len(base) == 1 else several)[c] = base
    return "".join(one), "".join(one.values()), several, _char_class(marks)


def fold_accents(text: Column) -> Column:
    """The text without combining marks, be they parts of a letter or characters of their own, in every
    script of the basic plane. Characters beyond it stay as they are."""
    before, after, several, marks = _accents()
    latin = sum(ord(c) < 0x100 for c in before)

    def folded(t: Column) -> Column:
        whole = F.regexp_replace(_lookup(_translated(t, before, after), _char_class(sorted(map(ord, several))), several), marks, "")
        # Most texts have no character beyond ASCII, or none beyond Latin-1.
        return F.when(~_beyond(t), t).when(t.rlike(r"[^\x00-\xFF]"), whole).otherwise(_translated(t, before[:latin], after[:latin]))

    return _let(text, folded)


def normalize(text: Column) -> Column:
    return F.lower(fold_accents(clean(text)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the normalised parts that are not empty, a line each."""
    return content_hash_array(F.array(*parts))


def content_hash_array(parts: Column) -> Column:
    given = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.sha2(F.array_join(F.transform(given, lambda p: normalize(p)), "\n"), 256)


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def line_key(text: Column) -> Column:
    """What recurring lines share: normalised text with numbers masked. Plain texts take no nested functions."""
    text = F.coalesce(text, F.lit(""))
    return F.when(_odd(text), mask_digits(normalize(text))).otherwise(mask_digits(F.lower(F.trim(text))))


def tokens(text: Column) -> Column:
    """Folded words in order, each after a space, for phrase and prefix search."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(fold_accents(text)), r"[^\p{L}\p{N}]+", " ")))


def matches_all(text: Column, query: str) -> Column:
    """Every word of the query begins some word of the text; quotes count as spaces, case and accents
    do not count. A query without words matches nothing."""
    words = [F.rtrim(tokens(F.lit(w))) for w in query.replace('"', " ").split()]
    if not words:
        return F.lit(False)
    # The text's words are put in order once, then each of the query's is looked for.
    return F.exists(F.array(tokens(text)), lambda t: F.forall(F.array(*words), lambda w: F.contains(t, w)))


def term_hits(text: Column, term: Column | str) -> Column:
    """Places where a term begins a word of normalised text; what follows does not matter."""
    term = F.lit(term) if isinstance(term, str) else term
    return F.regexp_count(text, F.concat(F.lit("(?<![a-z0-9])"), term))


def _trie_pattern(terms: list[str]) -> str:
    """A pattern for the longest of the terms at a place. Terms that begin alike share that beginning, so
    a place is read once, however many terms there are."""
    tree: dict = {}
    for t in terms:
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        parts = []
        for c in sorted(k for k in node if k):
            child, run = node[c], re.escape(c)
            while len(child) == 1 and "" not in child:  # a stretch without branches
                ((c, child),) = child.items()
                run += re.escape(c)
            parts.append(run + pattern(child))
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + ("?" if "" in node else "")

    return pattern(tree)


def longest_terms(text: Column, terms: list[str]) -> Column:
    """The longest of the terms at each place of normalised text where one begins a word, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9])(?=({_trie_pattern(terms)}))"), F.lit(1))


def legible_share(text: Column, sample: int = 20_000) -> Column:
    """Share of letters, digits, spaces and usual punctuation in the first characters; null for none."""
    part = F.substring(text, 1, sample)
    escaped = "".join(f"\\{c}" for c in PUNCTUATION)
    good = F.length(F.regexp_replace(part, rf"[^\p{{L}}\p{{N}}\s{escaped}]", ""))
    return F.when(F.length(part) > 0, good / F.length(part))


def letter(position: Column) -> Column:
    """A for 0, B for 1."""
    return F.chr(position + 65)


def tidy_letter(text: Column) -> Column:
    return F.upper(F.substring(F.trim(text), 1, 1))


def fix_leading_zero(text: Column) -> Column:
    """An o before a digit at the start, as scanners misread it, is a zero."""
    return F.regexp_replace(text, r"^[oO](?=\d)", "0")


_LEADERS, _PLAIN_LEADERS = r"[_.‐-―-]{3,}", r"[_.-]{3}"


def strip_leaders(text: Column) -> Column:
    """Without runs of three or more rules, dots or dashes."""
    return F.when(_odd(text) | text.rlike(_PLAIN_LEADERS), clean(F.regexp_replace(text, _LEADERS, " "))).otherwise(F.coalesce(F.trim(text), F.lit("")))


def escape_markup(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def safe_file_name(hash_hex: Column, name: Column) -> Column:
    return F.concat(F.substring(hash_hex, 1, 12), F.lit("-"), F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"))


def column_index(reference: Column) -> Column:
    """Zero-based column of a cell reference: A1 is 0, AB7 is 27."""
    letters = F.filter(F.split(F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1)), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def _after(text: Column, taken: Column) -> Column:
    return F.substring(text, F.length(taken) + 1, F.length(text))


def _delimiter(text: Column) -> Column:
    """The delimiter that a text begins with, else nothing."""
    first = F.substring(text, 1, 1)
    return F.when((first != "") & F.contains(F.lit(DELIMITERS), first), first).otherwise("")


MARKER = "struct<value:string,rest:string,strong:boolean>"


def _rest(rest: Column, others: Column | None) -> Column:
    """The rest of a marker's fragment with the rest of its line."""
    return strip_leaders(F.concat_ws(" ", rest, F.lit("") if others is None else others))


def _split(parts: Column, take: Callable[[Column], Column]) -> Column:
    """parts(taken array, rest) after one more part was taken off the rest's beginning."""
    return _let(parts, lambda p: _let(take(p["rest"]), lambda t: F.struct(F.concat(p["taken"], F.array(t)).alias("taken"), _after(p["rest"], t).alias("rest"))))


def _parts(text: Column, *takes: Callable[[Column], Column]) -> Column:
    parts = F.struct(F.array().cast("array<string>").alias("taken"), text.alias("rest"))
    for take in takes:
        parts = _split(parts, take)
    return parts


#: The markers of plain text: word or bracket, value, delimiter, and what follows. Numbers begin with digits or
#: with an o for a zero.
_WORD, _DIGITS, _MARK = r"(?i:questao|quest\.|q\.) *+", r"(?:[0-9]{1,3}|[oO][0-9]{1,2})(?![0-9])", r"[.)\]:-]"
_NUMBER = rf"^({_WORD})?+({_DIGITS}) *+({_MARK}?+)(.*)"
_LETTER = rf"^([(\[]?+)([A-Ea-e])({_MARK}?+)(.*)"
#: Those that count: after a word, before a delimiter that opens a text, or alone; and those that are strong.
_NUMBER_COUNTS = rf"^(?:{_WORD}[0-9]{{1,3}}(?![0-9])|{_DIGITS} *+(?:{_MARK}(?=[ A-Za-z])|{_MARK}?+ *+$))"
_NUMBER_STRONG = rf"^(?:{_WORD}[0-9]{{1,3}}(?![0-9])|{_DIGITS} *+{_MARK}(?:[ A-Za-z]|$))"
_LETTER_STRONG = rf"^(?:[(\[][A-Ea-e]|[A-Ea-e]{_MARK})"
_LETTER_COUNTS = rf"{_LETTER_STRONG}|^[A-Ea-e] *+$"


#: Kinds of markers: patterns of those that count, of strong ones and of their parts, and what a first fragment
#: becomes before it is taken apart.
_KINDS = {"number": (_NUMBER_COUNTS, _NUMBER_STRONG, _NUMBER, fix_leading_zero), "letter": (_LETTER_COUNTS, _LETTER_STRONG, _LETTER, lambda t: t)}


def _plain_marker(kind: str, first: Column, rest: Callable[[Column], Column]) -> Column:
    """MARKER of a plain first fragment, by patterns alone."""
    counts, strong, pattern, given = _KINDS[kind]
    text = F.trim(first)
    return F.when(text.rlike(counts), F.struct(F.regexp_extract(given(text), pattern, 2).alias("value"), rest(F.regexp_extract(given(text), pattern, 4)).alias("rest"), text.rlike(strong).alias("strong")))


def _marker(kind: str, first: Column, others: Column | None, whole: Callable[[Column], Column]) -> Column:
    """MARKER of a line. A plain first fragment is told by patterns alone; any other is cleaned and taken apart
    by `whole`, an array of at most one found(value, rest, strong)."""
    first = F.coalesce(first, F.lit(""))
    found = F.try_element_at(F.transform(whole(clean(first)), lambda m: F.struct(m["value"].alias("value"), _rest(m["rest"], others).alias("rest"), m["strong"].alias("strong"))), F.lit(1))
    return F.when(_odd(first), found).otherwise(_plain_marker(kind, first, lambda r: _rest(r, others)))


@lru_cache(maxsize=1 << 16)
def plain_marker(kind: str, first: str) -> tuple[str, str, bool] | None:
    """What number_marker() or letter_marker() finds in a plain first fragment, told outside Spark: few of them are
    distinct."""
    counts, strong, pattern = map(re.compile, _KINDS[kind][:3])
    text = first.strip(" ")
    given = re.sub(r"^[oO](?=[0-9])", "0", text) if kind == "number" else text
    parts = pattern.match(given) if counts.match(text) else None
    return (parts[2], parts[4].strip(" "), bool(strong.match(text))) if parts else None


def plain_line(first: Column, others: Column) -> Column:
    """Whether a line's markers are those of plain_markers() and its rest needs no cleaning but trimming."""
    text = F.concat_ws(" ", first, others)
    return ~(_odd(text) | text.rlike(_PLAIN_LEADERS))


def _whole_number(text: Column) -> Column:
    """An array of at most one number found(value, rest, strong) in a cleaned text."""

    def word(t: Column) -> Column:
        return F.substring(t, F.lit(1), F.length(F.regexp_extract(F.lower(fold_accents(t)), QUESTION_WORD, 0)))

    def found(p: Column) -> Column:
        given, digits, mark, rest = p["taken"][0], p["taken"][1], p["taken"][3], p["rest"]
        alone, opens = F.trim(rest) == "", (mark != "") & rest.rlike(r"^(\s|\p{L})")
        good = F.length(digits).between(1, 3) & (alone | opens | (given != ""))
        return F.filter(F.array(F.struct(digits.alias("value"), F.ltrim(rest).alias("rest"), ((given != "") | (mark != "")).alias("strong"))), lambda m: good)

    parts = _parts(fix_leading_zero(text), word, lambda t: F.regexp_extract(t, "^[0-9]+", 0), lambda t: F.regexp_extract(t, "^ +", 0), _delimiter)
    return _let(parts, found)


def _whole_letter(text: Column) -> Column:
    """An array of at most one letter found(value, rest, strong) in a cleaned text."""

    def found(p: Column) -> Column:
        bracket, value, mark, rest = p["taken"][0], p["taken"][1], p["taken"][2], p["rest"]
        good = F.upper(value).isin("A", "B", "C", "D", "E") & ((F.trim(rest) == "") | (mark != "") | (bracket != ""))
        return F.filter(F.array(F.struct(value.alias("value"), F.ltrim(rest).alias("rest"), ((bracket != "") | (mark != "")).alias("strong"))), lambda m: good)

    parts = _parts(text, lambda t: F.regexp_extract(t, r"^[(\[]", 0), lambda t: F.substring(t, 1, 1), _delimiter)
    return _let(parts, found)


def number_marker(first: Column, others: Column | None = None) -> Column:
    """The question number that a line's first fragment opens with.

    The strictest is a number that stands alone, perhaps after a word for question and before a
    delimiter. A delimiter makes text after it a question's if a space or a letter follows, so that a
    decimal is none. The word makes any text one. The number has three digits at most.
    """
    return _marker("number", first, others, _whole_number)


def strong_number(first: Column) -> Column:
    """Whether number_marker() finds a strong number."""
    first = F.coalesce(first, F.lit(""))
    found = F.exists(_whole_number(clean(first)), lambda m: m["strong"])
    return F.when(_odd(first), found).otherwise(F.trim(first).rlike(_NUMBER_STRONG))


def letter_marker(first: Column, others: Column | None = None) -> Column:
    """The option letter, A to E, that a line's first fragment opens with: alone, before a delimiter, or
    after an opening bracket, which a scanner may have left unclosed."""
    return _marker("letter", first, others, _whole_letter)


def answer_letter(raw: Column, letters: str = "ABCDE") -> Column:
    """The first word of a model's answer that is a letter in range."""
    return F.try_element_at(F.regexp_extract_all(F.upper(raw), F.lit(rf"\b([{letters}])\b"), F.lit(1)), F.lit(1))


def answer_index(raw: Column, n: Column) -> Column:
    """The first number of a model's answer, null for 0 and out of range."""
    value = F.regexp_extract(raw, r"(\d+)", 1).try_cast("int")
    return F.when(value.between(1, n), value)


def assemble(*parts: Column, limit: int | None = None) -> Column:
    """The parts that are not empty, a line each, cut to a limit of characters."""
    text = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n")
    return F.substring(text, 1, limit) if limit else text


def invert_map(pairs: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(e["value"], e["key"])))


def parse_pairs(text: Column) -> Column:
    """A map from 'k: v; k2: v2', cut at the first colon of each part; blank keys and values go."""
    parts = F.transform(F.split(text, ";"), lambda p: F.split(p, ":", 2))
    entries = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]), F.trim(p[1])))
    return F.map_from_entries(F.filter(entries, lambda e: (e["col1"] != "") & (e["col2"] != "")))
