"""Text expressions: name keys, script shares, trigrams, substrings, tails in another script."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PUNCTUATION = r"[\p{P}\p{S}\p{Z}\p{C}]"
KANA = "[ぁ-んァ-ヶ]"


def stripped_key(c: Column) -> Column:
    """Lower case without punctuation, symbols, blanks and control characters."""
    return F.regexp_replace(F.lower(c), PUNCTUATION, "")


@F.pandas_udf(StringType())
def name_key(s: pd.Series) -> pd.Series:
    """Key under which names are compared: NFKC, case folded, without categories P, S, Z and C. Null stays null."""

    def key(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFKC", x).casefold() if unicodedata.category(ch)[0] not in "PSZC")

    return s.map(key, na_action="ignore")


def class_share(c: Column, chars: str) -> Column:
    """Share of the characters of ``c`` that match the class ``chars``; 0 for an empty text."""
    return F.regexp_count(c, F.lit(chars)) / F.greatest(F.length(c), F.lit(1))


def is_japanese(c: Column, threshold: float = 0.20) -> Column:
    return class_share(c, KANA) > threshold


MARKER = r"[\[【]\s*(?:简介原文|原文|日文简介|日文原文)\s*[\]】]"  # fixed value


def without_tail(c: Column, chars: str = KANA, dirty: float = 0.03, block_share: float = 0.08, keep: int = 8, most: float = 0.05, ratio: float = 0.15) -> Column:
    """``c`` without its end in the script of ``chars``: what follows ``MARKER``, or else trailing paragraphs.

    A text with the marker is cut there or nowhere. Only a text with more than ``dirty`` of it is touched; paragraphs of more than ``block_share`` are cut from
    the end, and the cut holds if ``keep`` characters and ``ratio`` of the text stay and at most ``most`` of what
    stays is in that script.
    """
    blocks = F.split(c, r"\n\s*\n")
    last = F.array_max(F.transform(blocks, lambda b, i: F.when(class_share(b, chars) <= block_share, i).otherwise(F.lit(-1))))
    by_blocks = F.trim(F.array_join(F.slice(blocks, 1, F.greatest(last + 1, F.lit(0))), "\n\n"))
    at = F.regexp_instr(c, F.lit(MARKER))
    kept = F.when(at > 0, F.regexp_replace(F.left(c, at - 1), r"^\s+|\s+$", "")).otherwise(by_blocks)
    safe = (F.length(kept) >= keep) & (class_share(kept, chars) <= most) & (F.length(kept) >= ratio * F.length(c))
    return F.when((class_share(c, chars) > dirty) & safe, kept).otherwise(c)


def blank_to_null(c: Column) -> Column:
    """Without blanks around it; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def substrings(c: Column, shortest: int = 2, longest: int = 16) -> Column:
    """All distinct substrings of ``shortest`` to ``longest`` characters."""
    n = F.length(c)
    at = F.when(n >= shortest, F.sequence(F.lit(1), n - shortest + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda i: F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), n - i + 1)), lambda k: F.substring(c, i, k))
    return F.array_distinct(F.flatten(F.transform(at, of)))


def occurrences(text: Column, needle: Column) -> Column:
    """Start positions, from 1, of all occurrences, overlapping ones too."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(needle)) == needle)


def whole_word(text: Column, needle: Column, start: Column) -> Column:
    """Whether an ASCII needle stands at word borders; needles of other scripts always do."""
    side = lambda at: F.when(at < 1, F.lit("")).otherwise(F.substring(text, at, F.lit(1)))
    free = ~side(start - 1).rlike("[a-z0-9]") & ~side(start + F.length(needle)).rlike("[a-z0-9]")
    return ~needle.rlike("^[a-z0-9]+$") | free


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of ``c``, each padded with two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared part of two trigram sets; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))
