"""Text normalisation, tagging and similarity as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling pairs (applied in this order) and patterns.
SPELLING = (
    ("license", "licence"),
    ("licensed", "licenced"),
    ("marshall", "marshal"),
    ("center", "centre"),
    ("organisation", "organization"),
)
# A letter-dot pair that starts, or directly continues, a run of two or more.
# What can't begin with a letter and a dot is passed over first.
ACRONYM_DOT = r"(?=[a-z]\.)(?:\G(?!^)|(?<![\p{L}\p{N}_])(?=(?:[a-z]\.){2}))([a-z])\."
NON_ALNUM = r"[^a-z0-9]+"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same white space as classes: what ends a line, and what doesn't.
_BREAKS = r"\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}"
_BLANKS = r"\t\x1F \x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
HEADING = r"^[A-Z][A-Z &]{2,}$"
BULLET = r"^[-•*]\s*(.+)$"
FUZZY_THRESHOLD = 88.0

#: Phrase lists ride inside the plan as literals, so their size is checked here.
MAX_LITERAL_PHRASES = 2_000


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def canonical_text(text: Column) -> Column:
    lowered = F.regexp_replace(F.lower(text), ACRONYM_DOT, "$1")
    for variant, canonical in SPELLING:
        lowered = F.replace(lowered, F.lit(variant), F.lit(canonical))
    return F.trim(F.regexp_replace(lowered, NON_ALNUM, " "))


def lines_of(text: Column) -> Column:
    """Stripped, non-blank lines."""
    raw = F.split(text, LINE_BREAK)
    return F.filter(F.transform(raw, strip), lambda line: line != "")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def body_of(stripped: Column) -> Column:
    """The lines of :func:`lines_of` as one string, a line feed before each, from text without white space at its ends.

    No line holds a line feed, so a pattern that never takes one finds in the whole what it finds line by line, at
    the price of one compiled call where a function over an array is interpreted for every line.
    """
    gap = f"(?![!-~])(?<![{_BLANKS}])[{_BLANKS}]*+[{_BREAKS}][{_BREAKS}{_BLANKS}]*+"
    return F.when(stripped != "", F.concat(F.lit("\n"), F.regexp_replace(stripped, gap, "\n"))).otherwise("")


def by_line(pattern: str) -> str:
    """A pattern written for one line, for :func:`body_of`: its white space is never the end of a line."""
    return pattern.replace(r"\s", r"[\s&&[^\n]]").replace("(.+)$", r"([^\n]+)")


def bullets_in(body: Column) -> Column:
    """:func:`bullets_of` of the lines of a body."""
    return F.regexp_extract_all(body, F.lit(rf"\n[-•*][{_BLANKS}]*([^\n]+)"), F.lit(1))


def section_blocks(body: Column, headings: Sequence[str]) -> Column:
    """The lines under each of these headings as a body, in the order of the text; a heading that comes again comes apart."""
    heading = HEADING.strip("^$")
    known = "|".join(r"\Q" + h + r"\E" for h in headings if re.fullmatch(heading, h)) or "(?!)"
    opening = rf"\A(?=\n)(?!\n{heading}(?:\n|\z))|" if "" in headings else ""
    # Possessive, so that the lines of a section are passed over in a loop, however many they are.
    pattern = rf"(?:{opening}\n(?:{known})(?=\n|\z))((?:\n(?!{heading}(?:\n|\z))[^\n]++)*+)"
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(1))


def bullets_of(lines: Column) -> Column:
    marked = F.filter(lines, lambda line: line.rlike(BULLET))
    return F.transform(marked, lambda line: strip(F.regexp_extract(line, BULLET, 1)))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sections_of(lines: Column) -> Column:
    """``array<struct<heading, lines>>`` in the order first seen, opening block under "".

    A heading that comes again goes on with its section. Lines are found by their
    places and taken as they stand, so no character of a text is altered.
    """
    # Places of the headings, after the opening block's; a section ends where the next begins.
    headed = F.filter(F.transform(lines, lambda line, i: F.when(is_heading(line), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(-1)), headed)

    def cut(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, k: F.struct(
                F.when(at < 0, F.lit("")).otherwise(F.get(lines, at)).alias("heading"),
                F.slice(lines, at + 2, F.coalesce(F.get(starts, k + 1), F.size(lines)) - at - 1).alias("lines"),
            ),
        )

    def merge(blocks: Column) -> Column:
        headings = F.array_distinct(blocks["heading"])
        joined = lambda h: F.flatten(F.filter(blocks, lambda b: b["heading"] == h)["lines"])
        merged = F.transform(headings, lambda h: F.struct(h.alias("heading"), joined(h).alias("lines")))
        return F.when(F.size(headings) == F.size(blocks), blocks).otherwise(merged)

    return F.when(lines.isNotNull(), _bind(_bind(starts, cut), merge))


def _phrase_pairs(vocabulary: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    pairs = [(code, phrase) for code, phrases in vocabulary.items() for phrase in phrases]
    if len(pairs) > MAX_LITERAL_PHRASES:
        raise ValueError(f"{len(pairs)} phrases exceed the literal limit of {MAX_LITERAL_PHRASES}")
    return pairs


def canonical_keys(vocabulary: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Canonical phrase to code for a literal vocabulary; a later duplicate wins.

    Plain-Python twin of :func:`canonical_text` for the few ASCII phrases of the
    vocabulary; a test holds the two together.
    """

    def canon(phrase: str) -> str:
        text = phrase.lower()
        text = re.sub(r"(?<![a-z0-9_])(?:[a-z]\.){2,}", lambda m: m[0].replace(".", ""), text)
        for variant, canonical in SPELLING:
            text = text.replace(variant, canonical)
        return re.sub(NON_ALNUM, " ", text).strip()

    return {canon(phrase): code for code, phrase in _phrase_pairs(vocabulary)}


def tag_phrases(canonical: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Codes with a phrase present on word boundaries of already canonical text."""
    padded = F.concat(F.lit(" "), canonical, F.lit(" "))
    by_code: dict[str, list[str]] = {}
    for phrase, code in canonical_keys(vocabulary).items():
        by_code.setdefault(code, []).append(phrase)
    flags = []
    for code, phrases in sorted(by_code.items()):
        present = F.contains(padded, F.lit(f" {phrases[0]} "))
        for phrase in phrases[1:]:
            present = present | F.contains(padded, F.lit(f" {phrase} "))
        flags.append(F.when(present, F.lit(code)))
    # The codes differ, so this drops the nulls alone; ``array_compact`` would have the flags interpreted.
    return F.array_except(F.array(*flags), F.array(F.lit(None).cast("string")))


def _alternation(phrases: Sequence[str]) -> str:
    firsts = "".join(sorted({_escaped(p[0]) for p in phrases if p}))
    # A look at the first character spares most places the look behind.
    ahead = f"(?=[{firsts}])" if phrases and all(phrases) else ""
    return rf"{ahead}(?<![\p{{L}}\p{{N}}_])({_tree(sorted(set(phrases)))})(?![\p{{L}}\p{{N}}_])"


def _escaped(character: str) -> str:
    return "\\" + character if character.isascii() and not character.isalnum() else character


def _tree(phrases: Sequence[str]) -> str:
    """An alternation in which phrases share their beginnings. Of two that match in one place, the longer is tried first."""
    rests: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            rests.setdefault(phrase[0], []).append(phrase[1:])
    branches = [_escaped(first) + _tree(rest) for first, rest in rests.items()]
    if "" in phrases:
        return f"(?:{'|'.join(branches)})?" if branches else ""
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def entity_spans(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Distinct lower-case dictionary matches on token boundaries, longest first."""
    phrases = [phrase.lower() for _, phrase in _phrase_pairs(vocabulary)]
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_alternation(phrases)), F.lit(1)))


def codes_of_spans(spans: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    lookup = _literal_map({phrase.lower(): code for code, phrase in _phrase_pairs(vocabulary)})
    return F.array_distinct(F.transform(spans, lambda span: F.try_element_at(lookup, span)))


def _literal_map(entries: Mapping[str, object]) -> Column:
    flat: list[Column] = []
    for key, value in entries.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def match_exact(canonical: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    return F.try_element_at(_literal_map(canonical_keys(vocabulary)), canonical)


def match_contained(canonical: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Code of the longest key that is a raw substring; null when there is none."""
    keys = canonical_keys(vocabulary)
    order = {key: i for i, key in enumerate(keys)}
    result = F.lit(None).cast("string")
    # Build from the weakest key outwards so that the longest (and, among equals,
    # the earliest) is tested first.
    for key in sorted(keys, key=lambda k: (len(k), -order[k])):
        result = F.when(F.contains(canonical, F.lit(key)), F.lit(keys[key])).otherwise(result)
    # One pattern for all keys spares the texts that hold none the walk through them.
    return F.when(canonical.rlike(_tree(sorted(keys))), result)


# Canonical text is made of a blank, digits and lower-case letters: codes 32 to 122.
_FIRST_CODE, _LAST_CODE = 32, 122


def char_codes(canonical: Column) -> Column:
    """Positions of the characters in the canonical alphabet, ready for :func:`lcs_similarity`."""
    return F.transform(F.split(canonical, ""), lambda ch: F.ascii(ch) - _FIRST_CODE)


def _mask_table(keys: Mapping[str, str]) -> Column:
    """The vocabulary as one array literal: per key its code, length and character masks.

    Written as a single SQL expression: the optimiser folds it into a constant.
    """
    rows = []
    for order, (key, code) in enumerate(keys.items()):
        if not 0 < len(key) <= 61:
            raise ValueError("a vocabulary phrase must have 1 to 61 characters")
        masks = [0] * (_LAST_CODE - _FIRST_CODE + 1)
        for i, ch in enumerate(key):
            masks[ord(ch) - _FIRST_CODE] |= 1 << i
        listed = ", ".join(f"{m}L" for m in masks)
        quoted = code.replace("\\", "\\\\").replace("'", "\\'")
        rows.append(
            f"named_struct('order', {-order}, 'code', '{quoted}', 'n', {len(key)}, "
            f"'full', {(1 << len(key)) - 1}L, 'masks', array({listed}))"
        )
    return F.expr(f"array({', '.join(rows)})")


def lcs_similarity(codes: Column, key: Column) -> Column:
    """``200 * LCS / (len(text) + len(key))`` of coded text against a mask-table entry.

    Bit-parallel longest common subsequence (Crochemore et al. 2001): one word of
    state per key, one indexed mask per character of the text.
    """
    state = F.aggregate(
        codes,
        key["full"],
        lambda v, code: _lcs_step(v, v.bitwiseAND(F.get(key["masks"], code)), key["full"]),
    )
    return F.lit(200.0) * (key["n"] - F.bit_count(state)) / (F.size(codes) + key["n"])


def _lcs_step(v: Column, hit: Column, full: Column) -> Column:
    return (v + hit).bitwiseOR(v - hit).bitwiseAND(full)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_fuzzy(
    canonical: Column, vocabulary: Mapping[str, Sequence[str]], threshold: float = FUZZY_THRESHOLD
) -> Column:
    """Code of the most similar key at or above ``threshold``, else null.

    LCS is at most the shorter length, so a key whose length is too far from the
    text's cannot reach the threshold; which those are is listed for every length.
    """
    keys = canonical_keys(vocabulary)
    longest = int(max(len(key) for key in keys) * (200.0 - threshold) / threshold)
    near = [
        [i for i, key in enumerate(keys) if 200.0 * min(n, len(key)) / (n + len(key)) >= threshold]
        for n in range(longest + 1)
    ]
    listed = "array(" + ", ".join(f"cast(array({', '.join(map(str, places))}) as array<int>)" for places in near) + ")"

    def best(codes: Column) -> Column:
        scored = F.transform(
            F.transform(F.get(F.expr(listed), F.size(codes)), lambda i: F.get(_mask_table(keys), i)),
            lambda key: F.struct(
                lcs_similarity(codes, key).alias("similarity"), key["order"].alias("order"), key["code"].alias("code")
            ),
        )
        kept = F.filter(F.array(F.array_max(scored)), lambda w: w["similarity"] >= threshold)
        return F.get(F.transform(kept, lambda w: w["code"]), F.lit(0))

    return F.when(F.length(canonical).between(1, longest), _let(char_codes(canonical), best))


def match_cascade(canonical: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Exact, then contained, then fuzzy; ``coalesce`` stops at the first answer."""
    return F.when(
        canonical != "",
        F.coalesce(
            match_exact(canonical, vocabulary),
            match_contained(canonical, vocabulary),
            match_fuzzy(canonical, vocabulary),
        ),
    )


def repr_quoted(text: Column) -> Column:
    """Quoted the way the warning texts show an entry."""
    only_single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(only_single, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
