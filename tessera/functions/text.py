"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes that stemming strips, for Russian and for English words.
RU_SUFFIXES = (
    "ующих", "ующим", "ивший", "ившая", "ившее", "ующий", "ующая", "ующее", "иями", "иям", "иях", "ием", "ями", "ами", "ах", "ях",
    "ого", "его", "ому", "ему", "ыми", "ими", "ов", "ев", "ии", "ям", "ам", "ие", "ия", "ию", "ая", "яя", "ое", "ее", "ой", "ей",
    "ый", "ий", "ом", "ем", "ых", "их", "ые", "ою", "ею", "ую", "юю", "ать", "ять", "еть", "ить", "оть", "уть", "ыть", "ть", "ти",
    "а", "я", "у", "ю", "е", "ы", "и", "о", "ь",
)
EN_SUFFIXES = (
    "izations", "ational", "ousness", "iveness", "fulness", "ically", "ization", "ation", "tions", "ators", "ables", "ibles",
    "edly", "ions", "ings", "able", "ible", "ment", "ness", "fully", "tion", "sion", "ence", "ance", "ative",
    "ous", "ive", "ize", "ise", "ies", "ied", "ier", "ing", "ed", "es", "ly", "s", "y",
)
#: Fixed value: characters that a stem keeps at least.
MIN_STEM = 3
#: Fixed value: what counts as a token.
TOKEN = "[а-яёА-ЯЁa-zA-Z0-9][а-яёА-ЯЁa-zA-Z0-9-]*"
#: White space as the rules mean it: with the no-break space.
SPACE = r"[\s\x{00A0}]+"
#: The inside of a character class for all white space that patterns of headings mean.
WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def trimmed(text: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def tokens(text: Column) -> Column:
    """Word tokens: letters of either script, digits, and hyphens inside."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def stripped(word: Column, suffixes: Sequence[str]) -> Column:
    """The word without its longest suffix of the list.

    The shortest prefix of at least ``MIN_STEM`` characters that a listed suffix completes leaves the longest
    suffix, which is the rule.
    """
    return F.regexp_replace(word, f"^(.{{{MIN_STEM},}}?)(?:{'|'.join(suffixes)})$", "$1")


def stem(word: Column) -> Column:
    """The stem of a token in lower case, by its script; tokens of mixed script are only lowered."""
    low = F.lower(F.trim(word))
    return F.when(low.rlike("^[а-яё-]+$"), stripped(low, RU_SUFFIXES)).when(low.rlike("^[a-z-]+$"), stripped(low, EN_SUFFIXES)).otherwise(low)


def stem_phrase(text: Column) -> Column:
    """All tokens' stems, joined by spaces."""
    return F.array_join(F.transform(tokens(text), stem), " ")


def stem_equals(a: Column, b: Column) -> Column:
    return stem_phrase(a) == stem_phrase(b)


def cyrillic_endings(stem_form: str) -> str:
    """A pattern for a Cyrillic stem with any ending."""
    return f"{stem_form}[а-яё]*"


def normal_title(title: Column) -> Column:
    """A heading in lower case without its leading number."""
    return F.trim(F.regexp_replace(F.lower(title), r"^\d+(\.\d+)*\s*", ""))


def normal_words(text: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_words(text), " "), lambda w: w != ""))


# Fixed value: marks that quotes are compared without.
QUOTE_MARKS = "[«»\"'`„“”‘’(),;:!?–—-]"


def normal_quote(text: Column) -> Column:
    """A quote in lower case, squeezed and without quotation marks, brackets and most punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "), QUOTE_MARKS, ""))


# Fixed value: what ``SPACE`` takes as white space.
BLANKS = "\t\n\x0b\f\r\xa0"


def quote_words(text: Column) -> Column:
    """The words of ``normal_quote``, each once; one pass over the characters is cheaper than its patterns."""
    flat = F.translate(F.lower(F.coalesce(text, F.lit(""))), BLANKS + QUOTE_MARKS[1:-1], " " * len(BLANKS))
    return F.array_remove(F.array_distinct(F.split(flat, " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared words by all words of two word sets (without repeats); 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


# Word characters of both scripts.
WORD_CHAR = "[а-яА-ЯёЁa-zA-Z0-9_]"
WORD_BOUNDARY = f"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"


def unicode_pattern(pattern: str) -> str | None:
    """A rule's pattern with boundaries and word characters of both scripts and without inline flags; null if invalid."""
    plain = re.sub(r"\(\?[imsu]+\)", "", pattern).replace(r"\b", WORD_BOUNDARY).replace(r"\w", WORD_CHAR)
    try:
        re.compile(plain)
    except re.error:
        return None
    return plain


def fits(text: Column, pattern: str) -> Column:
    """Whether a rule's pattern is found in a lowered text; an invalid one never is."""
    plain = unicode_pattern(pattern)
    return F.lit(False) if plain is None else F.coalesce(text.rlike(plain), F.lit(False))


def found(text: Column, pattern: str) -> Column:
    """What a rule's pattern matches first in a lowered text, or nothing."""
    plain = unicode_pattern(pattern)
    return F.lit("") if plain is None else F.regexp_extract(text, plain, 0)


def content_digest(text: Column, chars: int = 200) -> Column:
    """SHA-256 of the first characters of the trimmed text; empty for blank text."""
    head = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, chars)
    return F.when(head == "", "").otherwise(F.sha2(head, 256))


def fingerprint(text: Column) -> Column:
    """What joins two renderings of one paragraph: squeezed, lowered, first 80 characters."""
    return F.substring(F.lower(squeeze(text)), 1, 80)


# Named entities; the ampersand is decoded last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def decode_entities(text: Column) -> Column:
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def html_text(html: Column) -> Column:
    """The text of a piece of HTML: no tags, entities decoded, white space squeezed."""
    return squeeze(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def inline_text(html: Column) -> Column:
    """The text of an element: its tags leave nothing behind, as in a word with bold letters."""
    return squeeze(decode_entities(F.regexp_replace(html, "<[^>]*>", "")))


def clean_value(raw: Column) -> Column:
    """An extracted value: squeezed, cut at the end of a sentence and at 120 characters, no trailing separators."""
    flat = squeeze(raw)
    cut = F.regexp_instr(flat, F.lit(r"[.;]\s"))  # from 1; 0: none
    first = F.when((cut > 1) & (cut < F.length(flat)), F.trim(F.substring(flat, F.lit(1), cut - 1))).otherwise(flat)
    head = F.substring(first, 1, 121)
    space = 122 - F.locate(" ", F.reverse(F.rpad(head, 121, "x")))  # the last space's place, from 1
    there = F.contains(head, F.lit(" "))
    short = F.when(there & (space > 21), F.trim(F.substring(first, F.lit(1), space - 1))).otherwise(F.trim(F.substring(first, 1, 120)))
    return F.regexp_replace(F.when(F.length(first) > 120, short).otherwise(first), r"[,;:\s]+$", "")


# Units of durations, and Roman phases.
DURATION_UNITS = {
    "week": "weeks", "weeks": "weeks", "wk": "weeks", "wks": "weeks", "нед": "weeks", "недел": "weeks", "недель": "weeks", "недели": "weeks", "неделя": "weeks",
    "month": "months", "months": "months", "mo": "months", "mos": "months", "мес": "months", "месяц": "months", "месяца": "months", "месяцев": "months",
    "day": "days", "days": "days", "d": "days", "день": "days", "дня": "days", "дней": "days",
    "year": "years", "years": "years", "yr": "years", "yrs": "years", "год": "years", "года": "years", "лет": "years",
}
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """The table's value, or the key itself."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.element_at(pairs, key), key)


def canonical_text(raw: Column) -> Column:
    return stem_phrase(squeeze(F.lower(raw)))


def canonical_phase(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    arabic, roman = r"(\d+)(?:\s*/\s*(\d+))?", r"\b(i{1,3}v?|iv|v)(?:\s*/\s*(i{1,3}v?|iv|v))?\b"
    a, b = (F.regexp_extract(low, arabic, i) for i in (1, 2))
    c, d = (looked_up(F.regexp_extract(low, roman, i), ROMAN) for i in (1, 2))
    return (
        F.when(a != "", F.when(b != "", F.concat_ws("/", a, b)).otherwise(a))
        .when(low.rlike(roman), F.when(d != "", F.concat_ws("/", c, d)).otherwise(c))
        .otherwise(canonical_text(raw))
    )


def canonical_duration(raw: Column) -> Column:
    pattern = r"(\d+)\s*([a-zA-Zа-яА-ЯёЁ.]+)"
    number = F.regexp_replace(F.regexp_extract(raw, pattern, 1), "^0+(?=.)", "")
    unit = F.regexp_replace(F.lower(F.regexp_extract(raw, pattern, 2)), r"\.+$", "")
    return F.when(raw.rlike(pattern), F.concat_ws(" ", number, looked_up(unit, DURATION_UNITS))).otherwise(canonical_text(raw))


def canonical(fact_key: Column, raw: Column) -> Column:
    """The canonical form of a fact's value, by its key; empty for blank values."""
    number = F.regexp_replace(F.regexp_extract(raw, r"(\d+)", 1), "^0+(?=.)", "")
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "")
        .when(fact_key == "protocol_number", F.regexp_replace(F.upper(F.trim(raw)), SPACE, ""))
        .when(fact_key == "sample_size", F.when(number != "", number).otherwise(canonical_text(raw)))
        .when(fact_key == "study_phase", canonical_phase(raw))
        .when(fact_key == "study_duration", canonical_duration(raw))
        .otherwise(canonical_text(raw))
    )


# Default coefficients of the confidence calibration.
ALPHA, BETA, GAMMA = 1.0, 0.3, 0.15


def calibrated(confidence: Column, prior: Column, sources: Column, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> Column:
    """Sigmoid of confidence, prior and the number of sources."""
    x = alpha * (confidence - 0.5) + beta * F.coalesce(prior, F.lit(0.0)) + gamma * F.log(1 + F.greatest(F.lit(0), sources - 1))
    return 1 / (1 + F.exp(-x))


def severity_intra(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low == "critical", "high").when(low == "major", "medium").when(low == "minor", "low").when(low.isin("high", "low", "info"), low).otherwise("medium")


def severity_inter(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low == "major", "high").when(low == "minor", "medium").otherwise("info")


def severity_rank(severity: Column) -> Column:
    """Rank in declaration order: critical first."""
    return F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), severity)


def dedup_key(kind: Column, ref: Column, target: Column, ref_value: Column, target_value: Column) -> Column:
    """The key of equal findings; null where neither side has a canonical value."""
    parts = [F.coalesce(c, F.lit("?")) for c in (kind, ref, target, ref_value, target_value)]
    return F.when(ref_value.isNull() & target_value.isNull(), None).otherwise(F.concat_ws("|", *parts))


def section_anchor(number: Column, order: Column, kind: Column) -> Column:
    """``[S1.2:kind]`` for numbered sections, ``[S#order:kind]`` for the others, ``[S?]`` without either."""
    path = F.nullif(F.trim(number), F.lit(""))
    suffix = F.when(F.trim(kind).rlike("^[a-z][a-z0-9_]*$"), F.concat(F.lit(":"), F.trim(kind))).otherwise("")
    return F.coalesce(F.concat(F.lit("[S"), F.coalesce(path, F.concat(F.lit("#"), order.cast("string"))), suffix, F.lit("]")), F.lit("[S?]"))


def parsed_anchor(text: Column) -> Column:
    """Number and kind of the first anchor in a text."""
    pattern = r"\[S(#?[0-9.]+)(?::([^\]]+))?\]"
    return F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("number"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("kind"))


def normal_cell(value: Column) -> Column:
    """A schedule cell: crosses and ticks are x, dashes are a hyphen, the rest is trimmed and lowered."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("x", "х", "✓", "✔", "+"), "x").when(low.isin("-", "–", "—"), "-").otherwise(low)


def scored_cell(value: Column) -> Column:
    """A schedule cell as it is scored: a Latin x, ticks and a plus are x, dashes are a hyphen, the rest is trimmed and lowered."""
    low = F.lower(trimmed(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("x", "✓", "✔", "+"), "x").when(low.isin("-", "–", "—"), "-").otherwise(low)


def excluded(section: Column, prefixes: list[str]) -> Column:
    """Whether a section starts with an excluded prefix; a null section never does."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(section, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def html_cells(row_html: Column, tag: str = "td") -> Column:
    """The texts of a table row's cells."""
    return F.transform(F.regexp_extract_all(row_html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), html_text)


def html_table(table_html: Column) -> Column:
    """Headers and rows of a table: header cells, else the first row, and the rows that have cells."""
    rows = F.filter(F.transform(F.regexp_extract_all(table_html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: html_cells(r)), lambda r: F.size(r) > 0)
    heads = html_cells(table_html, "th")
    plain = (F.size(heads) == 0) & (F.size(rows) > 0)
    return F.struct(F.when(plain, F.get(rows, F.lit(0))).otherwise(heads).alias("headers"), F.when(plain, F.slice(rows, F.lit(2), F.size(rows))).otherwise(rows).alias("rows"))


def footnote_marks(text: Column) -> Column:
    """Markers in a paragraph that start a footnote: a symbol or number with ``)``, ``:`` or ``.`` behind."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|\s)(\*|†|‡|§|¶|\d+)\s*[):.]"), F.lit(1))


def footnote_references(text: Column) -> Column:
    """Numbers of references in brackets or superscript."""
    found = F.regexp_extract_all(text, F.lit(r"\[\d+\]|<sup>\d+</sup>"), F.lit(0))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)", 1))
