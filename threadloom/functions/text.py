"""Column functions over free text: mentions, cleaning, sentence splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import rules

EMPTY = "array<string>"
# Unicode classes, so that accented letters and non-Latin digits count as such.
UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Drop white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_text(text: Column) -> Column:
    return F.lower(strip(text))


def normalise_plate(plate: Column) -> Column:
    return F.upper(F.regexp_replace(plate, r"(?U)\s", ""))


def normalise_phone(phone: Column) -> Column:
    """Digits only, with a leading plus kept."""
    plus = F.when(F.startswith(phone, F.lit("+")), F.lit("+")).otherwise(F.lit(""))
    return F.concat(plus, F.regexp_replace(phone, r"(?U)\D", ""))


#: Rules whose matches hold a digit, reach at most 4 characters beyond their first and last one, leave no gap of 11 between
#: two and neither start nor end with white space.
NEAR_DIGITS = frozenset(rules.PLATE_PATTERNS_WIDE + rules.PHONE_PATTERNS_WIDE + rules.ACCOUNT_PATTERNS)
#: What stands for the text between two parts near digits; no rule matches it and it is no part of a word.
APART = "\u0001"


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def near_digits(text: Column) -> Column:
    """The text with what lies more than 5 characters from any digit cut to one mark.

    A match of ``NEAR_DIGITS`` keeps its characters and the one on either side, which settles word boundaries.
    """
    far = r"(\D{5})\D{6,}+(?<=(\D{5}))"
    kept = f"$1{APART}$2"
    return F.when(_ascii(text), F.regexp_replace(text, far, kept)).otherwise(F.regexp_replace(text, UNICODE + far, kept))


def _once(text: Column, found) -> Column:
    """``found`` of the text as the one element of a list: named in several places, it would be worked out anew for each."""
    return F.get(F.transform(F.array(text), found), F.lit(0))


def find_all(text: Column, patterns: list[str], flags: str = UNICODE) -> Column:
    """All matches of all patterns, in pattern order, repeats kept.

    Patterns with a fixed part are tried only on texts that contain it.
    """
    def found(pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
        for part in ("+91", "BH"):
            if part in pattern.replace("\\", "") and "i" not in flags:
                return _guarded(F.contains(text, F.lit(part)), hits)
        return hits

    return F.concat(*[found(p) for p in patterns])


def _plain_find_all(text: Column, patterns: list[str]) -> Column:
    """``find_all``, without the cost of Unicode classes on ASCII texts, where both find the same."""
    return F.when(_ascii(text), find_all(text, patterns, "")).otherwise(find_all(text, patterns))


def _guarded(possible: Column, found: Column) -> Column:
    """Skip the pattern scans on texts that lack what the patterns need."""
    return F.when(possible, found).otherwise(F.array().cast(EMPTY))


def _distinct_stripped(found: Column) -> Column:
    return F.array_distinct(F.transform(found, strip))


def _ten_digits(found: Column) -> Column:
    return F.filter(found, lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")) >= 10)


def _least_digits(pattern: str) -> int:
    return sum(int(n) for n in re.findall(r"\\d\{(\d+)", pattern))


def _phones(near: Column, patterns: list[str]) -> Column:
    """Digits are counted only where the pattern itself does not ask for ten."""
    found = [(_plain_find_all(near, [p]), _least_digits(p)) for p in patterns]
    return F.array_distinct(F.concat(*[hits if least >= 10 else _ten_digits(hits) for hits, least in found]))


def _plates(near: Column, patterns: list[str]) -> Column:
    return F.array_distinct(_plain_find_all(near, patterns))


#: How every match of the wide plate patterns begins in an ASCII text in upper case, and all that it can go on with.
PLATE_RUN = r"\b(?:[A-Z]{1,3}[\s-]?\d|\d{2,3}\s?[A-Z]{2})[A-Z\d\s-]*+_?"


def _plates_wide(near: Column) -> Column:
    """Of ASCII texts, only the runs that may hold a plate are searched, in upper case."""
    def plain(runs: Column) -> Column:
        return _guarded(runs != "", find_all(runs, rules.PLATE_PATTERNS_WIDE, ""))

    runs = F.array_join(F.regexp_extract_all(F.upper(near), F.lit(PLATE_RUN), F.lit(0)), APART)
    other = F.transform(find_all(near, rules.PLATE_PATTERNS_WIDE, "(?iU)"), F.upper)
    return F.array_distinct(F.when(_ascii(near), _once(runs, plain)).otherwise(other))


def _in_near(text: Column, needed: str, found) -> Column:
    """``found`` of the parts near digits, where they hold what the patterns need."""
    return _once(near_digits(text), lambda near: _guarded(near.rlike(UNICODE + needed), found(near)))


def phone_mentions(text: Column, patterns: list[str] = rules.PHONE_PATTERNS) -> Column:
    if not NEAR_DIGITS.issuperset(patterns):
        return _guarded(text.rlike(r"(?U)\d{5}"), _distinct_stripped(_ten_digits(find_all(text, patterns))))
    return _in_near(text, r"\d{5}", lambda near: _phones(near, patterns))


def phone_mentions_wide(text: Column) -> Column:
    return _in_near(text, r"\d{3}", lambda near: _phones(near, rules.PHONE_PATTERNS_WIDE))


def plate_mentions(text: Column, patterns: list[str] = rules.PLATE_PATTERNS) -> Column:
    if not NEAR_DIGITS.issuperset(patterns):
        return _guarded(text.rlike(r"(?U)\d{4}"), _distinct_stripped(find_all(text, patterns)))
    return _in_near(text, r"\d{4}", lambda near: _plates(near, patterns))


def plate_mentions_wide(text: Column) -> Column:
    return _in_near(text, r"\d", _plates_wide)


def digit_parts(text: Column) -> Column:
    """The parts of a text that can hold phones and plates; searched one by one they give what the whole text gives."""
    return F.filter(F.split(near_digits(text), APART), lambda part: part.rlike(r"(?U)\d{4}"))


def account_mentions(text: Column) -> Column:
    def found(near: Column) -> Column:
        return F.filter(F.array_distinct(find_all(near, rules.ACCOUNT_PATTERNS, "(?iU)")), lambda x: F.length(x) >= 4)

    return _in_near(text, r"\d{6}", found)


def watch_list_mentions(text: Column, names: list[str] = rules.WATCH_LIST) -> Column:
    """Names of a short fixed list that occur anywhere in the text."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda name: F.contains(text, name))


def clean_person(name: Column) -> Column:
    """Drop a leading honorific and a trailing possessive."""
    bare = strip(F.regexp_replace(name, r"^(Smt\.|Shri\.|Mr\.|Mrs\.)\s*", ""))
    return strip(F.regexp_replace(bare, "['’]s$", ""))


def is_probable_date(text: Column) -> Column:
    bare = strip(text)
    hit = F.lit(False)
    for pattern in rules.DATE_PATTERNS:
        hit = hit | bare.rlike(pattern)
    return hit


def is_valid_person(name: Column) -> Column:
    return (strip(name) != "") & ~name.isin(rules.PERSON_STOP_WORDS) & ~is_probable_date(name)


def is_valid_place(place: Column) -> Column:
    return ~place.isin(rules.PLACE_NOISE) & ~is_probable_date(place) & (F.length(place) > 2)


#: What stands between two sentences, and white space of ASCII texts.
BOUNDARY, BLANK = "\u0002", " \t\n\u000b\f\r"


def sentences(text: Column) -> Column:
    """Sentences with their end marks; abbreviations and single initials do not end one."""
    def marked(body: Column) -> Column:
        # the full stop comes first in the pattern, so that what stands before is looked at only there
        held = F.regexp_replace(body, r"\.(?<=(?<!\S)(?:Rs|Mr|Mrs|Smt|Shri|[A-Z])\.)", "\u0001")
        return F.regexp_replace(held, r"([.!?]+)\s+", "$1" + BOUNDARY)

    def restored(part: Column) -> Column:
        return F.replace(part, F.lit("\u0001"), F.lit("."))

    # the cuts leave no white space at the ends of an ASCII sentence, so such a text is stripped as a whole
    plain = F.split(restored(marked(F.btrim(text, F.lit(BLANK)))), BOUNDARY)
    other = F.transform(F.split(marked(text), BOUNDARY), lambda s: strip(restored(s)))
    cut = F.when(_ascii(text) & ~F.contains(text, F.lit(BOUNDARY)), plain).otherwise(other)
    return F.filter(cut, lambda s: s != "")


def words(text: Column) -> Column:
    """Word tokens; inner apostrophes and hyphens stay, possessive endings go."""
    plain = F.regexp_extract_all(text, F.lit(r"\w++(?:['-]\w++)*+"), F.lit(0))
    other = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}_]++(?:['’-][\p{L}\p{M}\p{N}_]++)*+"), F.lit(0))
    found = F.when(_ascii(text), plain).otherwise(other)
    bare = F.transform(found, lambda w: F.regexp_replace(w, "['’]s$", ""))
    return F.when(F.contains(text, F.lit("'s")) | F.contains(text, F.lit("’s")), bare).otherwise(found)


def has_trigger(sentence: Column, rel: str, whole_word: bool = False) -> Column:
    """Any trigger of ``rel`` inside the lower-cased sentence."""
    return _trigger_in(F.lower(sentence), rel, whole_word)


def triggers_of(sentence: Column, rels: list[str], whole_word: bool = False) -> Column:
    """Those of ``rels`` with a trigger inside the sentence, which is lowered once."""
    def fired(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(_trigger_in(low, rel, whole_word), F.lit(rel)) for rel in rels]))

    return _once(F.lower(sentence), fired)


def _trigger_in(low: Column, rel: str, whole_word: bool) -> Column:
    if whole_word:
        either = "|".join(re.escape(k) for k in rules.TRIGGERS[rel])
        return low.rlike(r"(?U)(^|\W)(" + either + r")(\W|$)")
    # not by a lambda over the triggers, which would lower the sentence anew for each
    hit = F.lit(False)
    for trigger in rules.TRIGGERS[rel]:
        hit = hit | F.contains(low, F.lit(trigger))
    return hit


def relationship_name(raw: Column) -> Column:
    """Safe upper-case relationship name, or null where nothing is left."""
    runs = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), "[^A-Za-z0-9]+", "_")
    upper = F.upper(F.regexp_replace(runs, "^_+|_+$", ""))
    named = F.when(upper.rlike("^[A-Z]"), upper).otherwise(F.concat(F.lit("REL_"), upper))
    return F.when(upper != "", F.left(named, F.lit(60)))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise."""
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
