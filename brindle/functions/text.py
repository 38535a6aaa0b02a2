"""Column expressions on text: lines, identifier tokens, CJK groups, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line break that ends a line of text, the two-character one first.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: ASCII runs first; a run that begins with another letter takes ASCII along.
WORD = r"[A-Za-z0-9]+|[\p{L}\p{N}]+"
CJK = "[\\u3400-\\u9fff]"


def text_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no further line; null and empty text have none."""
    parts = F.split(text, LINE_BREAK, -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(trimmed)


def spaced_identifier(word: Column) -> Column:
    """Blanks where case or digits change inside an ASCII word."""
    word = F.regexp_replace(word, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    word = F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2")
    word = F.regexp_replace(word, "([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(word, "([0-9])([A-Za-z])", "$1 $2")


def cjk_groups(word: Column) -> Column:
    """Groups of two, then of three characters, that hold a CJK ideograph."""

    def groups(size: int) -> Column:
        starts = F.when(F.length(word) >= size, F.sequence(F.lit(1), F.length(word) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.substr(word, i, F.lit(size))), lambda g: g.rlike(CJK))

    return F.concat(groups(2), groups(3))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def identifier_tokens(text: Column) -> Column:
    """Tokens in order, repeats kept: parts of ASCII words in small letters; other words as
    they are, followed by their CJK groups. Null text has none.

    Where no word mixes scripts, words are cut and lowered in the text as a whole; only the
    texts that hold a letter of another script right before an ASCII one are taken word by
    word."""
    text = F.coalesce(text, F.lit(""))
    words = lambda t: F.regexp_extract_all(t, F.lit(WORD), 0)
    ascii_word = lambda w: w.rlike("^[A-Za-z0-9]+$")
    single = F.flatten(F.transform(words(text), lambda w: F.when(ascii_word(w), F.split(F.lower(spaced_identifier(w)), " ")).otherwise(F.concat(F.array(w), cjk_groups(w)))))
    whole = words(F.translate(spaced_identifier(text), _CAPITALS, _SMALL))
    grouped = F.flatten(F.transform(whole, lambda w: F.when(ascii_word(w), F.array(w)).otherwise(F.concat(F.array(w), cjk_groups(w)))))
    mixed = text.rlike(r"[\p{L}\p{N}&&[^A-Za-z0-9]][A-Za-z0-9]")
    return F.when(mixed, single).when(text.rlike(CJK), grouped).otherwise(whole)


def distinct_lower(tokens: Column) -> Column:
    """Small letters, first occurrence of each kept in order."""
    return F.array_distinct(F.transform(tokens, lambda t: F.lower(t)))


def folded(text: Column) -> Column:
    """Case-folded text: small letters, sharp s as ss, final sigma and long s as the plain
    letters. Full case folding also takes ligatures and some rare letters apart."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), F.substring(F.sha2(content, 256), 1, 16)), 256)


def bounded_text(text: Column, most: int = 2000, head: int = 1500, tail: int = 499) -> Column:
    """Text for an embedding request: beyond ``most`` characters its head, a line break and its tail."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit("\n"), F.right(text, F.lit(tail)))).otherwise(text)
