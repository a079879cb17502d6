"""Text functions on columns, and the helpers that build patterns from user input."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))


#: Lower-case Latin, Greek and Cyrillic letters with marks, what they are without, and the marks that stand alone, which go.
_MARKED = [chr(c) for r in (range(0xC0, 0x530), range(0x1E00, 0x2000)) for c in r if chr(c).lower() == chr(c) and len(_bare(chr(c))) == 1 and _bare(chr(c)) != chr(c)]
MARKED = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370)))
BARE = "".join(map(_bare, _MARKED))


#: Signs that begin a list item (fixed values).
BULLETS = "•●○◦▪▫‣·§–—−"


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def folded(text: Column) -> Column:
    """Collapsed, lower case, without marks on letters."""
    return unmarked(collapsed(text), text)


def unmarked(text: Column, source: Column | None = None) -> Column:
    """Lower case without marks; ``source``, by default the text, tells whether there can be any."""
    source, low = text if source is None else source, F.lower(text)
    return F.when(F.octet_length(source) == F.length(source), low).otherwise(F.translate(low, MARKED, BARE))


def fold_word(word: str) -> str:
    return _bare(word.lower())


def query_terms(query: str, whole: bool = False) -> list[str]:
    """The trimmed query as one term, or its words of more than one character."""
    if whole:
        return [query.strip()] if query.strip() else []
    return [t for t in re.split(r"[\W_]+", query) if len(t) > 1]


def word_count(query: str) -> int:
    """White-space tokens with a letter or digit."""
    return sum(any(c.isalnum() for c in t) for t in query.split())


def terms(text: Column) -> Column:
    """As ``query_terms`` of a column."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def occurrences(folded_text: Column, folded_term: Column) -> Column:
    """Non-overlapping occurrences of a term, both folded."""
    n = F.length(folded_term)
    return F.when(n > 0, ((F.length(folded_text) - F.length(F.replace(folded_text, folded_term, F.lit("")))) / n).cast("int")).otherwise(0)


def case_variants(term: str, most: int = 24) -> list[str]:
    """The spellings a case-sensitive search should try."""
    forms = [term, term.lower(), " ".join(w[:1].upper() + w[1:].lower() for w in term.split(" "))]
    if len(term) <= 5:
        forms.append(term.upper())
    return list(dict.fromkeys(forms))[:most]


def contains_any(text: Column, variants: list[str]) -> Column:
    out = F.lit(False)
    for v in variants:
        out = out | F.contains(text, F.lit(v))
    return out


def escaped(term: str) -> str:
    """A term as a pattern; the two spellings of one Cyrillic letter match each other."""
    return re.sub("[её]", "[её]", re.sub("[ЕЁ]", "[ЕЁ]", re.escape(term)))


def alternation(words: list[str], boundary: bool = True) -> str:
    """Any of the words in any case, at the left boundary of a word only."""
    left = r"(^|[^\p{L}\p{N}_])" if boundary else ""
    return f"(?iu){left}({'|'.join(map(escaped, words))})"


def preview(text: Column, n: int = 160, mark: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def estimated_tokens(text: Column, chars: float = 3.5) -> Column:
    return F.greatest(F.lit(1), F.round(F.length(text) / F.lit(chars)).cast("int"))


def capitalised(text: Column) -> Column:
    """Words between spaces with their first letter in upper case, the others in lower case."""
    return F.array_join(F.transform(F.split(F.lower(text), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")


def has_word(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, the first spelling of each kept."""
    clean = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.filter(clean, lambda t, i: F.array_position(F.transform(clean, lambda x: F.lower(x)), F.lower(t)) == i + 1)


def masked(text: Column) -> Column:
    """Keys, tokens and passwords hidden."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***")
    return F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|password|secret)\s*[=:]\s*\"?)[^\s\",;]+", "$1***")


def list_marker(line: Column) -> Column:
    """Whether a line begins a list item: a bullet, ``-``, ``+`` or ``*`` and a space, or a number with its dots and a bracket or space."""
    number = line.rlike(r"^\p{N}[\p{N}.]{0,10}\)") | (line.rlike(r"^\p{N}[\p{N}.]{0,10} ") & line.rlike(r"^\p{N}+\."))
    return line.rlike("^[" + BULLETS + "]") | line.rlike(r"^[-+*] ") | number


def table_row(line: Column) -> Column:
    """Whether a line is a row of a Markdown table: framed by bars."""
    return F.regexp_replace(line, r"^[ \t]+|[ \t]+$", "").rlike(r"^\|.+\|$")


def table_separator(line: Column) -> Column:
    """Whether a line is what stands below the head of a Markdown table."""
    return line.rlike(r"^[ \t]*\|([ \t]*[-:]+[ \t]*\|)+[ \t]*$")
