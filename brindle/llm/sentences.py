"""Sentence units across languages and scripts.

Ordered rule tables decide: a rule is a pattern of what stands before a position, one
of what stands after it, and whether it breaks there; the first rule that matches
decides the position. The tables of a document's language come first, then those of
the other languages of the script (texts quote other languages, and labels are wrong
at times), then the tables of all languages.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import spread

# --- rule tables ---------------------------------------------------------------
# Abbreviations per language. ``number`` ones are abbreviations only
# before a number, ``open`` ones never end a sentence, ``either`` ones end it before
# a capital letter only.
ABBREVIATIONS = {
    "en": {
        "open": "Dr Mr Mrs Ms Prof Rev Gen Col Sgt Capt Lt Gov Sen Rep Hon St Mt Ft e.g i.e cf vs approx incl ca viz resp Messrs",
        "number": "no No nos sec Sec fig Fig figs eq Eq eqs p pp vol Vol ch Ch art Art para ver v max min Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
        "either": "etc al a.m p.m U.S U.K U.N E.U Inc Ltd Co Corp Jr Ph.D ed eds est dept",
    },
    "de": {
        "open": "Dr Prof Hr Fr Frl Hrn Dipl Ing ca vgl bzw z.B d.h u.a u.U z.T i.d.R o.g s.o s.u evtl ggf inkl exkl zzgl sog bes insb allg Abb Tab Abs Nr Art Kap Bd Hrsg geb gest St Str Mio Mrd Tsd max min mind zw lt gem einschl entspr",
        "number": "S Z Nr Abb Kap Bd Abs Ziff",
        "either": "usw etc ff u.v.m u.s.w",
    },
    "fr": {
        "open": "M MM Mme Mmes Mlle Me Dr Pr St Ste cf env p.ex c.-à-d ex éd apr av bd boul chap coll fig hab ill réf resp tél vol",
        "number": "p pp n no art sect § al par t",
        "either": "etc",
    },
    "es": {
        "open": "Sr Sra Srta Sres Dr Dra D Dña Prof Profa Ud Uds Lic Ing aprox cf p.ej v.gr pág págs art arts núm núms fig vol cap Cía Av Avda c.f",
        "number": "n nº núm pág art tel",
        "either": "etc EE.UU",
    },
    "ru": {
        "open": "г гг см ср напр т.е т.н т.к им проф акад доц д-р ок прим стр рис табл гл ул пр пер руб коп тыс млн млрд т.о обл р-н",
        "number": "с п ст гл рис стр № кв д к",
        "either": "т.д т.п др пр",
    },
    "el": {"open": "κ κα κος Δρ π.χ δηλ βλ πρβλ αρ σελ περ λεωφ", "number": "αρ σελ", "either": "κ.λπ κλπ κ.ά"},
    "ar": {"open": "د أ م ص ج", "number": "ص ج", "either": ""},
    "hi": {"open": "डॉ श्री पं प्रो", "number": "पृ सं", "either": ""},
}
#: Languages whose abbreviations may stand in a text of a script.
BY_SCRIPT = {"Latin": ("en", "de", "fr", "es"), "Cyrillic": ("ru",), "Greek": ("el",), "Arabic": ("ar",), "Devanagari": ("hi",)}

CLOSERS = r"[\"'’”“»›)\]}）】〉》」』〕*_`]"
CLOSED = rf"(?:[^\S\n]?»|{CLOSERS})"
#: What parts units: white space, with the prefixes of quoted or commented lines.
SPACE = r"(?:\s+(?:(?<=\n)(?:>+|//+|--)[ \t]+)?)"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯"
#: A name of code, which opens a sentence in small letters: fooBar, foo_bar, a.b.c, foo().
_NAME = r"[\p{Ll}\d][\p{L}\p{N}]*(?:(?=[\p{Lu}])|[_\d]|\.[\p{L}_]|\(\))"
_OPENING = rf"[\"'“„«‹(\[¿¡`*_「『（{{]*"

# Rules for all languages: (breaks, before, after).
COMMON: list[tuple[bool, str, str]] = [
    # ideographic and danda marks end a unit without a blank, but not inside what goes on after a closing mark
    (False, rf"[。！？!?…]{CLOSERS}+", rf"[{_CJK}\p{{L}}]"),
    (True, r"[。！？｡]|……|[।॥]", r""),
    (True, r"[؟۔]|[।॥]", r""),
    # an ellipsis inside a sentence: it stands alone or the sentence goes on in small letters
    (False, r"\s(?:\.{3}|…)", rf"{SPACE}\p{{Ll}}"),
    # what ends in a closing mark goes on before a small letter, unless a name of code or an abbreviation opens the next sentence
    (True, rf"[.!?…]{CLOSED}*", rf"{SPACE}{_OPENING}(?:{_NAME}|e\.g\.\s|i\.e\.\s|z\. ?B\.\s)"),
    (False, rf"[.!?…]{CLOSED}+", rf"{SPACE}{_OPENING}\p{{Ll}}"),
    # a bare end before a small letter: after a word, a number or a bracket, not after what may be an abbreviation
    (True, r"(?:\p{L}{4}|[\p{N})\]_\"”“»’'`]|\p{So}\ufe0f?)(?:\.|…|\.{3})|[!?]", rf"{SPACE}{_OPENING}\p{{Ll}}"),
    (False, rf"[.!?…]{CLOSED}*", rf"{SPACE}{_OPENING}\p{{Ll}}"),
    # a Greek question mark
    (True, r"(?<=\p{Greek}[^\S\n]?);", rf"{SPACE}{_OPENING}[\p{{L}}\p{{N}}]"),
    (True, rf"[.!?…]{CLOSED}*", rf"{SPACE}"),
    # a missing blank
    (True, rf"(?:[\p{{Ll}}\p{{Lo}}\p{{Nd}})\]»”“\"’`…]|\p{{So}}️?)(?:\.{{3}}|[.!?…]){CLOSERS}*", r"[„«“¿¡\"]?\p{Lu}(?:[\p{Ll}\s.]|-)"),
    (True, rf"[!?]{CLOSERS}*", rf"[{_CJK}]"),
]


def _join(words: str) -> str:
    """Longest first; those in small letters may be written with blanks (z. B.)."""
    escaped = ((w, regex.escape(w)) for w in sorted(words.split(), key=lambda w: (-len(w), w)))
    return "|".join(e if w.isupper() else e.replace(r"\.", r"\.\s?") for w, e in escaped)


@functools.lru_cache(maxsize=64)
def rule_tables(languages: tuple[str, ...]) -> list[tuple[bool, regex.Pattern]]:
    """The cascade for a text: the tables of ``languages`` in order, then the common ones."""
    rules: list[tuple[bool, str, str]] = []
    edge = r"(?<![\p{L}\p{N}_-])"
    for language in languages:
        words = ABBREVIATIONS.get(language, {})
        if words.get("either"):
            rules.append((False, rf"{edge}(?:{_join(words['either'])})\.", rf"{SPACE}(?!{_OPENING}\p{{Lu}})"))
            rules.append((True, rf"{edge}(?:{_join(words['either'])})\.{CLOSERS}*", rf"{SPACE}{_OPENING}\p{{Lu}}"))
        if words.get("number"):
            rules.append((False, rf"{edge}(?:{_join(words['number'])})\.", rf"{SPACE}\p{{Nd}}"))
        if words.get("open"):
            rules.append((False, rf"{edge}(?:{_join(words['open'])})\.", rf"{SPACE}"))
    # ordinals and dates of German
    rules.append((False, r"(?<![\p{L}\p{N}])(?:[Dd](?:ie|er|as|en|em|es)|[AaIi]m|[Vv]om|[Zz]um|[Zz]ur|[Bb]is|[Ss]eit|[Jj]ede[rsn]?)\s+\d{1,4}\.", rf"{SPACE}\p{{Lu}}"))
    rules.append((False, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", rf"{SPACE}(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b"))
    # a unit of measure after its number
    rules.append((True, r"\d[^\S\n]?[smhdgLWVAKNJB]\.", rf"{SPACE}"))
    # initials, also joined by hyphens, and letters of spaced abbreviations
    rules.append((False, r"(?<![\p{L}\p{N}_])\p{L}\.", rf"{SPACE}"))
    rules.extend(COMMON)
    return [(breaks, regex.compile(rf"(?<={before})(?={after})", regex.V1)) for breaks, before, after in rules]


# --- structure -------------------------------------------------------------------
_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = regex.compile(r"\s{0,3}(`{3,}|~{3,})")
_HEADING = regex.compile(r"\s{0,3}#{1,6}\s")
_BULLET = regex.compile(r"\s*[-*+•]\s+\S")
_NUMBERED = regex.compile(r"\s*(\d{1,4})[.)]\s+\S")
#: Where a unit may end: after a mark and what closes with it, before a blank or a letter.
_CANDIDATE = regex.compile(rf"(?:[.!?…]+|[。！？｡]+|[।॥؟۔]+|;)(?:[   ]?[»]|{CLOSERS})*")
_THAI_BLANK = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})")
#: Marks that open and close what stands inside a sentence, of any length; `„` has two ends.
_PAIRS = {"(": ")", "（": "）", "[": "]", "【": "】", "「": "」", "『": "』", "„": "“”", "“": "”", "«": "»", "‹": "›"}
_MARK = regex.compile(r"[()（）\[\]【】「」『』„“”«»‹›\"`]")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{N}\"]")
#: What is opened so shortly before the end and never closed is a quotation all the same.
UNCLOSED = 90


def quoted_spans(body: str) -> list[tuple[int, int]]:
    """Outermost quotes and brackets of a paragraph, in order: one scan with a stack.

    A closing mark closes the last one of its kind that is open; what was opened since
    and never closed is no bracket. A straight quote opens before a letter or mark and not
    after a word; a backquote ends with its line."""
    stack: list[tuple[str, int]] = []  # closing marks wanted, place
    waiting: dict[str, int] = {}  # how often each closing mark is wanted
    spans: list[tuple[int, int]] = []

    def close(mark: str, end: int) -> None:
        while True:
            wanted, at = stack.pop()
            for c in wanted:
                waiting[c] -= 1
            if mark in wanted:
                break
        while spans and spans[-1][0] > at:
            spans.pop()
        spans.append((at, end))

    def push(wanted: str, at: int) -> None:
        stack.append((wanted, at))
        for c in wanted:
            waiting[c] = waiting.get(c, 0) + 1

    past = 0  # the end of the last code between backquotes
    for m in _MARK.finditer(body):
        mark, at = m.group(), m.start()
        if at < past:
            continue
        if mark == "`":
            line = body.find("\n", at)
            end = body.find("`", at + 1, line if line >= 0 else len(body))
            if end >= 0:
                past = end + 1
                spans.append((at, past))
            continue
        blank_before, blank_after = at == 0 or body[at - 1].isspace(), at + 1 >= len(body) or body[at + 1].isspace()
        if waiting.get(mark) and not (mark == '"' and blank_before):
            close(mark, at + 1)
        elif mark in _PAIRS:
            push(_PAIRS[mark], at)
        elif mark == '"' and not blank_after and not (at and _WORD_BEFORE.match(body, at - 1)):
            push(mark, at)
    open_at = min((at for wanted, at in stack if wanted in (")", "）", "“”", "”", "»", "」", '"') and len(body) - at - 1 <= UNCLOSED), default=None)
    if open_at is not None:
        while spans and spans[-1][0] > open_at:
            spans.pop()
        spans.append((open_at, len(body)))
    return spans


_SCRIPTS = {name: regex.compile(rf"\p{{Script={name}}}") for name in BY_SCRIPT}


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)``: fences, headings, list entries and paragraphs, in order."""
    start = None  # of the open paragraph
    fence = None
    listed = False
    for m in _LINE.finditer(text):
        line, low, high = m.group(), m.start(), m.end()
        if low == high:
            continue
        if fence is not None:
            if (f := _FENCE.match(line)) and f.group(1)[0] == fence[1][0] and len(f.group(1)) >= len(fence[1]) and not line.strip().strip("`~"):
                yield "whole", fence[0], high
                fence = None
            continue
        number = _NUMBERED.match(line)
        entry = _BULLET.match(line) or (number and (start is None or listed or int(number.group(1)) == 1))
        special = _FENCE.match(line) or _HEADING.match(line) or entry
        if start is not None and (special or not line.strip()):
            yield ("whole" if listed else "running"), start, low
            start = None
        listed = False if start is None else listed
        if f := _FENCE.match(line):
            fence = (low, f.group(1))
        elif _HEADING.match(line):
            yield "whole", low, high
        elif line.strip() and start is None:
            start, listed = low, bool(entry)
    if fence is not None:
        yield "whole", fence[0], len(text)
    if start is not None:
        yield ("whole" if listed else "running"), start, len(text)


def _running(text: str, start: int, end: int, language: str | None) -> Iterator[int]:
    """Ends of the sentences of a paragraph, but for the last."""
    body = text[start:end]
    scripts = [name for name, pattern in _SCRIPTS.items() if pattern.search(body)]
    languages = dict.fromkeys([language] if language in ABBREVIATIONS else [])
    for name in scripts:
        languages.update(dict.fromkeys(BY_SCRIPT[name]))
    rules = rule_tables(tuple(languages))
    quoted = quoted_spans(body)
    opened = [low for low, _ in quoted]
    ends = {m.start() for m in _THAI_BLANK.finditer(body)}
    for m in _CANDIDATE.finditer(body):
        at = m.end()
        n = bisect.bisect_left(opened, at) - 1
        if n >= 0 and at < quoted[n][1]:
            continue
        for breaks, pattern in rules:
            if pattern.match(body, at):
                if breaks:
                    ends.add(at)
                break
    last = len(body.rstrip())
    yield from (start + at for at in sorted(ends) if at < last)


def unit_ends(text: str | None, language: str | None = None) -> list[int]:
    """End positions, in code points, of the units of ``text``; none for null and blank text."""
    if not text or not text.strip():
        return []
    language = (language or "").strip().lower()[:2] or None
    ends = []
    for kind, start, end in _blocks(text):
        last = start + len(text[start:end].rstrip())
        if last == start:
            continue
        if kind == "running":
            ends.extend(_running(text, start, end, language))
        ends.append(last)
    return ends


def sentence_units(documents: DataFrame) -> DataFrame:
    """Units of every document: ``doc_id, unit, start_pos, end_pos, sentence``.

    ``documents`` has ``doc_id, text, lang``. ``start_pos`` is after the end of the unit
    before, white space skipped; ``end_pos`` as in ``unit_ends``. Null and blank texts
    have no units; ``lang`` may be null or wrong; a null ``doc_id`` is kept as null;
    repeated rows give repeated units. A document is split where it is read; only a table of
    few splits is dealt out first.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, language in zip(batch["doc_id"], batch["text"], batch["lang"]):
                before = 0
                for n, end in enumerate(unit_ends(text, language)):
                    piece = text[before:end]
                    start = before + len(piece) - len(piece.lstrip())
                    rows.append((doc, n, start, end, text[start:end]))
                    before = end
            yield pd.DataFrame(rows, columns=["doc_id", "unit", "start_pos", "end_pos", "sentence"])

    read = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return spread(read, "doc_id").mapInPandas(split, "doc_id bigint, unit int, start_pos bigint, end_pos bigint, sentence string")
