"""Sentence units of prose and Markdown in any script.

A document is read line by line into blocks: headings, table rows and fenced
code are units as they are; paragraphs and list items are cut into sentences.
End marks, closing marks, continuing marks and lower-case letters are those of
the standard Sentence_Break property (STerm and ATerm, Close, SContinue, Lower),
plus the ellipsis. A mark ends a sentence together with the closing quotes and
brackets after it, unless

* it belongs to an abbreviation, initial, ordinal, number or address,
* it stands in a quotation or bracket after which the sentence goes on,
* it is followed by a continuing mark (comma, dash, ...), or
* it is an ellipsis and a word follows that continues the sentence.

Thai has no end marks: a space between Thai characters ends a sentence.

Abbreviations are those of the paragraph's languages. The language tags of a
corpus are not reliable, so the languages are told from the paragraph: by its
scripts and, among those of Latin script, by the function words in it. A
paragraph that gives no evidence may be in any of its script's languages. A unit
of measure after a number ("5 mm.") is no title, and a single letter is an
initial only before what may be a name.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.session import spread

SCHEMA = "doc_id {key}, sent_start int, sent_end int"

#: Never end a sentence before another word, by language (fixed values).
ALWAYS = {
    "en": "dr mr mrs ms prof st messrs vs cf incl resp approx eg ie viz",
    "de": "dr prof st hr fr dipl ing bzw vgl ca inkl evtl ggf sog vs resp",
    "fr": "dr prof st ste mme mmes mlle mlles mm mgr env cf vs",
    "es": "dr dra sr sra sres srta prof ud uds aprox cf vs",
    "ru": "см ср напр им проф акад",
    "hi": "डॉ श्री प्रो",
}
#: End none before a number.
NUMBERED = {
    "en": "no nos fig figs sec sect ch chap vol pp eq eqs tab app ver rev art jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "nr abs abb kap bd ziff anl art tab fig jan feb mär apr jun jul aug sep sept okt nov dez",
    "fr": "art arts chap fig figs vol pp tab sect no nos num janv févr avr juil sept oct nov déc",
    "es": "núm pág págs cap art fig tab vol ene feb mar abr jun jul ago sep sept oct nov dic",
    "ru": "рис гл стр табл разд пп ст",
}
#: End one unless the next word continues it.
LISTS = {"en": "etc", "de": "usw usf etc", "fr": "etc", "es": "etc", "ru": "др"}
#: End one only before a word that looks like a beginning.
NAMES = {"en": "inc ltd co corp jr bros llc plc a.m p.m", "de": "gmbh co inc ltd", "fr": "inc ltd cie", "es": "inc ltd cía a.m p.m"}
#: Words after an ellipsis, 'etc.' or a quotation that continue the sentence.
CONTINUING = (
    "and or but nor so yet then that which who when while where because until unless if than as to of in on at by for from with is are was were be been has have had can may will "
    "und oder aber dann sondern weil wenn als dass bis nach im mit von zu ist sind war "
    "et ou mais puis car donc que qui quand de du des dans pour par avec est sont "
    "y o pero luego que cuando de del en para por con es son e "
    "и или но а затем что когда в на с для по это"
)
#: After these a number with a full stop is a German ordinal.
ORDINAL_BEFORE = frozenset("der die das dem den des im am zum zur vom beim seit ab bis jeder jedem jeden jedes jede ein einem einen eines".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
#: What a Japanese sentence goes on with after a quotation.
PARTICLE = re.compile(r"と|って|は|が|を|に|の|も|で|や|へ|から|まで|など|なら|なの|だ|か[、らを]|、|，")

#: Words that tell the languages of Latin script apart: function words that only one of them has.
EVIDENCE = {
    "en": "the and is are was were of to with that this for it by from not has have which when",
    "de": "der die das und ist sind nicht mit von ein eine einen dem den zu im auf für wird werden bei nach wenn",
    "fr": "le les et est sont une dans pour qui sur avec ce cette il elle au aux par pas ne",
    "es": "el los y las una con para por del es son que se lo su como pero cuando si",
}
#: Words that begin a sentence rather than being a name: pronouns and their like, adverbs of sequence.
STARTERS = frozenset(
    (
        "the this that these those it he she they we you its his her their our there here then nobody nothing everybody everyone somebody no not each every both "
        "however therefore thus also but when while after before later next finally "
        "er sie es wir ihr dies diese dieser dieses dann danach aber niemand nichts alle jeder jede kein keine nun jetzt später "
        "il elle ils elles nous vous ce cette ces puis mais ensuite personne rien chaque aucun "
        "ella ellos nosotros este esta luego pero nadie nada cada después "
        "он она оно они мы вы это этот эта эти потом затем но никто ничто каждый после теперь"
    ).split()
)
#: Nouns that take a letter as their name ("plan B"): the letter after one is no initial.
LABELS = frozenset(
    "plan vitamin type class group grade option version case part point section appendix table figure item step phase team unit zone hepatitis typ klasse gruppe teil anhang variante fall phase zone plan groupe classe annexe cas partie grupo clase anexo caso parte план тип класс группа вариант часть".split()
)
#: Units of measure that are titles or abbreviations too.
UNITS = frozenset("mm ms st hr h s g m l min sec cm km kg mg ml kb mb gb tb hz мм см км кг г м с ч мин сек гг вв".split())

_sets = lambda groups: {lang: frozenset(line.split()) for lang, line in groups.items()}
_ALWAYS, _NUMBERED, _LISTS, _NAMES, _EVIDENCE = _sets(ALWAYS), _sets(NUMBERED), _sets(LISTS), _sets(NAMES), _sets(EVIDENCE)
_LISTED = frozenset().union(*(words for kind in (_ALWAYS, _NUMBERED, _LISTS, _NAMES) for words in kind.values()))
_KNOWN = _LISTED | UNITS | {"ex", "ej", "al"}
_GO_ON, _NONE = frozenset(CONTINUING.split()), frozenset()

OPENERS = {"“": "”", "„": "“”", "‟": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"', "＂": "＂"}
BRACKETS = "([（【"
_NBSP = "\u00a0\u2007\u2009\u202f"

_MARKER = re.compile(r"[ \t]*(?:[-*+]|(\d{1,9})[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})([^`]*)$")
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_LINE = re.compile(r"\r\n|\n|\r")
_WORD = re.compile(r"[^\W\d_]+")
_CODE = re.compile(r"`[^`\n]+`")
_SPECIAL = re.compile("[" + re.escape("".join(OPENERS) + "”»›」』》〉)）]】") + "]")
#: What may stand behind 'eq.' or 'Sec.': a number, a Roman number, a letter with a digit, one of them in brackets.
_NUMBER = re.compile(r"[(\[]?[#№§]?(?:\d|[A-Za-z]\.?\d|[IVXLC]+\b|[A-Za-z][)\]])")
_UNSPACED = "⺀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
#: A run without white space and characters of scripts that put none.
_RUN = re.compile(f"[^\\s{_UNSPACED}]*")
_ADDRESS = re.compile(r"://|[@\\/]")
_MORE_STOPS = re.compile(rf"(?:[ {_NBSP}]\.)+(?![^\W_])")
_THAI = re.compile("[\u0e00-\u0e7f]")
_ASCII_MARKS = frozenset(".!?")
_DEVANAGARI, _CYRILLIC = re.compile("[\u0900-\u097f]"), re.compile("[\u0400-\u052f]")


@functools.cache
def _property(name: str) -> frozenset:
    """All characters with a value of the standard Sentence_Break property."""
    import regex

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    return frozenset(regex.findall(rf"\p{{Sentence_Break={name}}}", every))


class _Rules:
    """Character classes of the standard property and the patterns made of them."""

    def __init__(self) -> None:
        self.sterm, aterm = _property("STerm"), _property("ATerm")
        #: Closing marks: Close without what opens only; the quotes that close in one language and open in another stay.
        self.closers = frozenset(c for c in _property("Close") if unicodedata.category(c) not in ("Ps", "Pi")) | {"“", "’", '"', "'", "＂"}
        self.continues = _property("SContinue") | frozenset("‐؛・…")
        self.lower = _property("Lower")
        self.marks = self.sterm | aterm | {"…"}

    def scanner(self, text: str) -> re.Pattern:
        """Finds the mark clusters of a text, and Thai spaces. A class of the text's own marks is far faster to scan for than one of all."""
        return _scanner(_ASCII_MARKS if text.isascii() else self.marks.intersection(text), not text.isascii() and _THAI.search(text) is not None)


@functools.lru_cache(1024)
def _scanner(marks: frozenset, thai: bool) -> re.Pattern:
    own = "".join(map(re.escape, sorted(marks | _ASCII_MARKS)))
    spaces = "|(?<=[\u0e00-\u0e7f])[ \u00a0\u3000]+(?=[\u0e00-\u0e7f])" if thai else ""
    return re.compile(f"[{own}][{own}]*{spaces}")


_rules = functools.cache(_Rules)


def _unspaced(ch: str) -> bool:
    """Characters of scripts that put no spaces between sentences."""
    return "⺀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "ｦ" <= ch <= "ﾟ" or "\U00020000" <= ch <= "\U0003ffff"


def languages(w: str) -> tuple[str, ...]:
    """The languages a paragraph may be in, by its scripts and the function words of Latin script in it."""
    out = []
    if not w.isascii():
        out += ["ru"] if _CYRILLIC.search(w) else []
        out += ["hi"] if _DEVANAGARI.search(w) else []
    found = frozenset(w.lower().split())
    latin = [lang for lang, words in _EVIDENCE.items() if not words.isdisjoint(found)]
    return (*out, *(latin or _EVIDENCE))


class _Paragraph:
    """What the rules ask about a paragraph, worked out once and only when asked."""

    def __init__(self, w: str):
        self.w, self.known, self.lists = w, None, {}
        self.run_end, self.run_begin, self.address, self.ticks, self.ticks_to = -1, 0, False, 0, 0

    def has(self, kind: dict[str, frozenset], token: str) -> bool:
        if self.known is None:
            self.known = languages(self.w)
        return any(token in kind.get(lang, _NONE) for lang in self.known)

    def in_run(self, i: int) -> tuple[int, bool]:
        """Where the run without white space around ``w[i]`` begins, and whether it has the look of an address. ``i`` only grows."""
        if i >= self.run_end:
            begin, low, w = i, max(self.run_end, 0), self.w
            while begin > low and not (w[begin - 1].isspace() or _unspaced(w[begin - 1])):
                begin -= 1
            end = _RUN.match(w, i).end()
            self.run_begin, self.run_end = begin, max(end, i + 1)
            self.address = _ADDRESS.search(w, begin, end) is not None
            self.ticks, self.ticks_to = 0, begin
        return self.run_begin, self.address

    def ticks_before(self, i: int) -> int:
        """Backticks between the beginning of the run and ``i``."""
        self.ticks += self.w.count("`", self.ticks_to, i)
        self.ticks_to = i
        return self.ticks


def _token_before(w: str, i: int) -> int:
    """Where the token of letters, marks and inner full stops that ends before ``w[i]`` begins."""
    k = i
    while k:
        ch = w[k - 1]
        if not ch.isalpha() and not (ch == "." and k < i and w[k].isalpha()) and (ch.isascii() or unicodedata.category(ch)[0] != "M"):
            break
        k -= 1
    while k < i and not w[k].isalpha():
        k += 1
    return k


def _next(w: str, k: int) -> tuple[int, str]:
    n = len(w)
    while k < n and w[k].isspace():
        k += 1
    return k, w[k] if k < n else ""


def _goes_on_with(w: str, at: int) -> bool:
    """A lower-case word at ``at`` that continues a sentence rather than beginning one."""
    m = _WORD.match(w, at)
    return bool(m) and m.group().lower() in _GO_ON and not (m.end() < len(w) and w[m.end()] in "._" and m.end() + 1 < len(w) and w[m.end() + 1].isalnum())


def _word_before(w: str, at: int) -> str:
    """The lower-case word before ``at``, past white space."""
    while at and w[at - 1].isspace():
        at -= 1
    end = at
    while at and w[at - 1].isalpha():
        at -= 1
    return w[at:end].lower()


def _continued(w: str, opened: int, closed: int, rules: _Rules) -> bool:
    """Whether the sentence goes on after the quotation or bracket ``w[opened:closed + 1]``."""
    k, sterm, closers = closed + 1, rules.sterm, rules.closers
    while k < len(w) and w[k] in closers and w[k] not in "“\"":
        k += 1
    inner = closed - 1
    while inner > opened and w[inner].isspace():
        inner -= 1
    ended = w[inner] in sterm or w[inner] in ".．…"
    if not ended:
        return True
    at, ch = _next(w, k)
    if not ch:
        return False
    if ch in rules.continues or (at == k and (ch in sterm or ch in ".．")):
        return True
    before = opened - 1
    while before >= 0 and w[before].isspace():
        before -= 1
    if w[opened] in BRACKETS:
        # a bracket that begins where a sentence ended is a sentence of its own
        own = before < 0 or w[before] in sterm or w[before] in ".．…" or w[before] in closers
        return not own and (ch in rules.lower or _unspaced(ch))
    colon = before >= 0 and w[before] in ":："
    if ch in rules.lower:
        return _goes_on_with(w, at) if colon else True
    if _unspaced(ch) and at == k:
        return bool(PARTICLE.match(w, at)) if colon else True
    if ch.isupper() or ch in OPENERS or ch in "¿¡":
        return False
    if ch == "`" or ch.isdigit():
        return not colon and w[closed] in "」』”" and at == k
    return not colon and ch.isalpha()


def _quiet(w: str, rules: _Rules) -> list[tuple[int, int]]:
    """Spans in which no mark ends a sentence: continued quotations and brackets, and inline code."""
    spans, stack = [], []
    depths: dict[str, list[int]] = {}  # of every closing mark, where on the stack what it closes lies
    for m in _SPECIAL.finditer(w):
        ch, at = m.group(), m.start()
        own = depths.get(ch)
        while own and (own[-1] >= len(stack) or ch not in OPENERS[stack[own[-1]][0]]):
            own.pop()
        if own:
            hit = own.pop()
            opened = stack[hit][1]
            del stack[hit:]
            if _continued(w, opened, at, rules):
                spans.append((opened, at))
        elif ch in OPENERS:
            for close in OPENERS[ch]:
                depths.setdefault(close, []).append(len(stack))
            stack.append((ch, at))
    if "`" in w:
        spans += [m.span() for m in _CODE.finditer(w)]
    spans.sort()
    return spans


def _letter_ends(w: str, i: int, last: int, at: int, ch: str, rules: _Rules) -> bool:
    """Whether the full stop behind the single letter ``w[i - 1]`` ends a sentence; ``w[last]`` is the last character before the letter.

    An initial, which ends none, stands before a name. No initial are the unit
    after a number, the letter after a noun that takes one ("plan B"), and a
    letter before a word that begins sentences.
    """
    if not ch.isupper() or last < 0 or last == i - 2 or w[last] == ".":
        return False
    word = _WORD.match(w, at)
    starts = word is not None and word.group().lower() in STARTERS
    if w[last].isdigit():
        return starts or w[i - 1].lower() in UNITS and w[i - 1] in rules.lower
    return w[last].isalpha() and (starts or _word_before(w, last + 1) in LABELS)


def _full_stop_ends(p: _Paragraph, i: int, k: int, at: int, ch: str, rules: _Rules) -> bool:
    """Whether the single full stop ``w[i]`` (closers up to ``k``, next character ``ch`` at ``at``) ends a sentence."""
    w = p.w
    if at == k:  # the space is missing
        if _unspaced(ch):
            return True
        if not (ch.isupper() or ch in "“„«(¿¡`"):
            return False
        begin, address = p.in_run(i)
        if address or p.ticks_before(i) % 2:
            return False
        if i - begin < 2 and not (i and _unspaced(w[i - 1])) or not (w[i - 1] in rules.lower or w[i - 1].isdigit() or w[i - 1] in ")”»`" or _unspaced(w[i - 1])):
            return False
        if ch.isupper():
            end = k
            while end < len(w) and (w[end].isalnum() or w[end] == "_"):
                end += 1
            if end + 1 < len(w) and w[end] == "." and (w[end + 1].isalnum() or w[end + 1] == "_"):
                return False
    start = _token_before(w, i)
    if start == i:
        if i and w[i - 1].isdigit():
            k = i - 1
            while k and w[k - 1].isdigit():
                k -= 1
            word = _WORD.match(w, at) if i - k <= 2 and not (k and (w[k - 1] in ".,_" or w[k - 1].isalpha())) else None
            if word and (word.group().lower() in MONTHS or _word_before(w, k) in ORDINAL_BEFORE):
                return False
        return True
    if start and (w[start - 1].isdigit() or w[start - 1] == "_"):
        return True
    token = w[start:i].lower()
    if len(token) > 1 and token not in _KNOWN and "." not in token:
        return True
    spaced = start > 0 and w[start - 1] == " "
    last = start - 1
    while last >= 0 and w[last].isspace():
        last -= 1
    stopped = last >= 0 and w[last] == "."
    if len(token) == 1:
        if token in "дп" and stopped and last and w[last - 1] == "т" or token == "h" and spaced and not stopped:
            return not (ch in rules.lower and _goes_on_with(w, at))
        return _letter_ends(w, i, last, at, ch, rules)
    if token in UNITS and last >= 0 and last < start - 1 and w[last].isdigit():
        return ch not in rules.lower
    if token in ("ex", "ej") and stopped and last and w[last - 1] == "p":
        return False
    if p.has(_NAMES, token):
        return not (ch in rules.lower or ch in ",;)")
    if p.has(_LISTS, token):
        return not (ch in rules.lower and _goes_on_with(w, at))
    if "." in token:
        if max(map(len, token.split("."))) > 2:
            return True
        word = _WORD.match(w, at) if ch.isupper() and w[start].isupper() else None
        return word is not None and word.group().lower() in STARTERS
    if p.has(_ALWAYS, token):
        return False
    if token == "al" and w[last - 1 : last + 1].lower() == "et":
        return False
    return not (p.has(_NUMBERED, token) and _NUMBER.match(w, at))


def cut_sentences(w: str, begin: int = 0, marks: re.Pattern | None = None) -> list[int]:
    """Offsets in ``w`` right behind each sentence end, from ``begin`` on; ``marks`` may be the scanner of a longer text."""
    rules = _rules()
    closers, continues = rules.closers, rules.continues
    marks = marks or rules.scanner(w)
    p = _Paragraph(w)
    ends, quiet, q, reach, past = [], None, 0, -1, -1
    for m in marks.finditer(w, begin):
        i, j = m.span()
        cluster, n = m.group(), len(w)
        if i < past:
            continue
        if cluster == "." and j < n and (w[j] == "_" or w[j].isascii() and (w[j].isdigit() or w[j].islower())):
            continue
        if cluster[0].isspace():
            ends.append(i)
            continue
        if quiet is None:
            quiet = _quiet(w, rules)
        while q < len(quiet) and quiet[q][0] < i:
            reach, q = max(reach, quiet[q][1]), q + 1
        if i < reach:
            continue
        if cluster == "." and j + 1 < n and w[j + 1] == "." and (more := _MORE_STOPS.match(w, j)):  # a spaced ellipsis
            j = past = more.end()
            cluster = "..."
        k = j
        while k < n:
            c = w[k]
            if c in closers and not (c in "“\"'" and (k + 1 < n and not w[k + 1].isspace() and w[k + 1] not in closers and w[k + 1] not in continues)):
                k += 1
            elif c in " " + _NBSP and k + 1 < n and w[k + 1] in "»›" and (c != " " or "«" in w):
                k += 2
            elif c in "*_" and re.match(r"[*_]+(?=\s|$)", w[k : k + 4]):
                k += 1
            else:
                break
        at, ch = _next(w, k)
        if not ch:
            break
        if ch in continues and not (ch == "-" and at > k) and ch != "…":
            continue
        last = cluster[-1]
        if cluster == ".":
            if _full_stop_ends(p, i, k, at, ch, rules):
                ends.append(k)
        elif not cluster.strip(".…"):
            if at > k and not (ch in rules.lower and _goes_on_with(w, at)):
                ends.append(k)
        elif at > k or last not in "!?.":
            if last == "．" and i and w[i - 1].isalnum() and not _unspaced(w[i - 1]) and at == k and (ch.isdigit() or ch.isalpha() and not _unspaced(ch)):
                continue
            ends.append(k)
        elif _unspaced(ch) or ch in "“„«「（(¿¡`" or ch.isupper():
            run, address = p.in_run(i)
            if not address and (i > run or i and _unspaced(w[i - 1])):
                ends.append(k)
    return ends


def _add(text: str, begin: int, end: int, out: list[tuple[int, int]]) -> None:
    """Adds ``text[begin:end]`` without white space at its ends, if anything is left."""
    part = text[begin:end]
    bare = part.lstrip()
    if bare:
        begin = end - len(bare)
        out.append((begin, begin + len(bare.rstrip())))


class _Reader:
    """Collects the units of one document."""

    def __init__(self, text: str):
        self.text, self.units, self.marks = text, [], _rules().scanner(text)
        self.begin = self.content = -1
        self.item: str | int | None = None
        self.masks: list[tuple[int, int]] = []
        self.lead = -1

    def open(self, begin: int, content: int, item: str | int | None) -> None:
        self.begin, self.content, self.item = begin, content, item
        if self.lead >= 0:
            self.begin, self.lead = self.lead, -1

    def close(self, end: int) -> None:
        if self.begin < 0:
            return
        w, base = self.text[self.begin : end], self.begin
        if self.masks:
            chars = list(w)
            for a, b in self.masks:
                if a >= base:
                    chars[a - base : b - base] = " " * (b - a)
            w = "".join(chars)
        at = base
        for cut in cut_sentences(w, self.content - base, self.marks):
            _add(self.text, at, base + cut, self.units)
            at = base + cut
        _add(self.text, at, end, self.units)
        self.begin, self.masks = -1, []

    def whole(self, begin: int, end: int) -> None:
        if self.lead >= 0:
            begin, self.lead = self.lead, -1
        _add(self.text, begin, end, self.units)


def sentence_units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every unit, in code points; null and blank texts have none."""
    r, fence, fence_at, number = _Reader(text), None, 0, None
    start, size = 0, len(text)
    while start <= size:
        m = _LINE.search(text, start)
        end, after = (m.start(), m.end()) if m else (size, size + 1)
        body_at = start
        line = text[start:end]
        if ">" in line and (q := _QUOTE.match(line)):
            body_at, line = start + q.end(), line[q.end() :]
        if fence:
            s = line.strip()
            if s and s[0] == fence[0] and len(s) >= len(fence) and not s.strip(fence[0]):
                r.whole(fence_at, end)
                fence = None
        elif not line or line.isspace():
            r.close(start)
            number = None if number is None else -abs(number)
            if body_at > start:  # a quotation's empty line: its mark goes to the unit that follows
                if r.lead < 0:
                    r.lead = start
            elif r.lead >= 0:
                r.whole(r.lead, start)
        else:
            c = line.lstrip()[:1]
            if c in "`~" and (f := _FENCE.match(line)):
                r.close(start)
                fence, fence_at = f.group(1), start
                if r.lead >= 0:
                    fence_at, r.lead = r.lead, -1
            elif c == "#" and _ATX.match(line):
                r.close(start)
                r.whole(start, end)
                number = None
            elif c in "=-" and r.begin >= 0 and r.item is None and _SETEXT.match(line):
                begin, r.begin, r.masks = r.begin, -1, []
                r.whole(begin, end)
                number = None
            elif c == "|":
                r.close(start)
                r.whole(start, end)
            elif c in "-*_" and _BREAK.match(line):
                r.close(start)
                r.whole(start, end)
            else:
                k = _MARKER.match(line) if c in "-*+" or c.isdigit() else None
                if k and k.group(1):
                    n = int(k.group(1))
                    inside = r.begin >= 0
                    word = _WORD.match(line, k.end())
                    # a wrapped line may begin with a number: inside a paragraph only the next number of the list, or 1, is a marker
                    if inside and (n != (abs(number) + 1 if number is not None else 1) or (word and word.group().lower() in MONTHS)):
                        k = None
                    else:
                        number = n
                if k:
                    r.close(start)
                    r.open(start, body_at + k.end(), "item")
                elif r.begin < 0:
                    r.open(start, body_at, None)
                if r.begin >= 0 and body_at > start:
                    r.masks.append((start, body_at))
        start = after
    if fence:
        r.whole(fence_at, size)
    r.close(size)
    if r.lead >= 0:
        r.whole(r.lead, size)
    return r.units


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_start, sent_end) for every document, as a map over its rows.

    Units are in order, do not overlap and cover everything but white space.
    Null and blank texts have none; repeated rows are cut once per row.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [sentence_units(t) if t else [] for t in b.column(1).to_pylist()]
            counts = np.array([len(u) for u in units], dtype=np.int64)
            flat = np.array([x for u in units for x in u], dtype=np.int32).reshape(-1, 2)
            owner = b.column(0).take(pa.array(np.repeat(np.arange(len(units)), counts)))
            yield pa.RecordBatch.from_arrays([owner, pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["doc_id", "sent_start", "sent_end"])

    return spread(documents.select(key, text)).mapInArrow(split, SCHEMA.format(key=dict(documents.dtypes)[key])).withColumnRenamed("doc_id", key)
