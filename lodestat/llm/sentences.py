"""Sentence units across languages and scripts.

A document is cut into blocks at blank lines; a block is a list of items or running text.  In
running text every terminator is a node of a lattice, whose edges are decided from its neighbours:
the word before it (abbreviation, initial, ordinal, label), open quotes and brackets, closing marks
after it and the opening of what follows.  Scripts without spaces are segmented by dictionary word lattices
(``words``), and each of their gaps - white space, or a closed quotation - is classified by the final particle or the
open word before it and the opening or bound word after it.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestat.llm import words

# Abbreviations, labels, months and particles of the languages covered.

#: Words before a full stop that never end a sentence.
NEVER_END = frozenset(
    """dr prof mr mrs ms mme mlle hr fr frl sr sra srta dra d.ª st mt rev hon gen capt lt sgt dipl ing mag
    fig figs tab tabs abb eq eqs sec secs ref refs app exp exps ch chap vol nos pp art bd ed eds
    núm pág págs fig lám nr no s p v ver cf vgl vs viz bzw ca approx aprox env circa etwa resp
    e.g i.e z.b z d.h d u.a u c.-à-d p.ej ej i e g ee dept univ incl inkl excl exkl ggf evtl sog bes zzgl std
    tabl jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago
    рис табл см напр ср проф акад доц им тов ул гр стр с т п гл
    βλ σχ πίν π.χ π χ δρ κ κα καθ σελ αρ
    د أ م डॉ प्रो श्री सं""".split()
)
#: Words before a full stop that end a sentence only where the next word opens one.
MAY_END = frozenset(
    """etc al inc ltd co corp plc gmbh jr sr a.m p.m am pm u.s u.k u.s.a uu e.u ph.d m.d b.a usw u.s.w ff f ebd ibid
    min max sec hr hrs wk yr yrs
    г гг в вв др пр т.е т.д т.п чел руб тыс млн кг κ.λπ κλπ κ.ά""".split()
)
#: Abbreviations only before a number; else ordinary words.
BEFORE_NUMBER = frozenset("no nos s p pp v c n art tab fig ref ch may".split())
#: Words before an ordinal number with its full stop (German).
ORDINAL_AFTER = frozenset("im am der die das dem den des zum zur vom beim in ab bis seit und vor nach jeder jede jedes".split())
#: Labels whose number and full stop introduce what follows.
LABELS = (
    "fig figure figs table tab tables abb abbildung tabelle tableau figura tabla cuadro рис рисунок табл таблица σχ σχήμα πίν πίνακας "
    "box panel appendix app exp experiment study scheme plate chart graph eq equation note anm hinweis"
)
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep sept okt nov dez".split()
)
_SPACELESS = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005\u3006\uff66-\uff9f]"
_NOTES = r"(?:\[\d+(?:[,–-]\s?\d+)*\]|[¹²³⁰-⁹]+)"
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "‘": "’"}
_CLOSE = set(_OPEN.values())

_BLANK = regex.compile(r"[\n\u2029](?:[^\S\n\u2029]*+[\n\u2029])+|\u2029|\r(?!\n)[^\S\r\n]*+\r(?!\n)")
_ITEM = regex.compile(r"[^\S\n]*(?:(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|([-–—•*·‣▪◦])|\((\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})\))\s+\S")
_EVENTS = regex.compile(
    r"[(\[{“”„«»「」『』（）［］【】《》〈〉)\]}\"‘]"
    r"|(?<=\p{Ll}\p{Ll}|\.\p{Ll})[.!?](?=\p{Lu}\p{Ll})"
    r"|[.!?…]+(?=[\s\"'”’»“)\]}」』\[¹²³⁰-⁹]|$)|[!?]+(?=" + _SPACELESS + r")"
    r"|[。！？｡⁇‽؟۔।॥።፧፨։។။༎]+|[;\u037e](?=[\s\"”»)\]]|$)"
)
_NOTE = regex.compile(_NOTES)
#: Closing marks that stay with the sentence even where nothing was open.
_LOOSE = set("'”’»)]}」』】〉》）］")
#: Lower-case openings that are no continuing prose: symbols in formulas and names like mTurk.
_SYMBOL = regex.compile(r"\p{L}\s?[=<>≤≥]|\p{Ll}+\p{Lu}|\p{Ll} (?:values?|test|levels?)\b|[αβηωχ]\b")
#: The word, and the shorter word before it, that end where a match is asked for: both are read from the right.
_WORD = regex.compile(r"(?r)[\p{L}\p{M}\p{N}.\-’'ª]+")
_WORD_BEFORE = regex.compile(r"(?r)(?<!\S)(\S{1,16})\s*")
_LABEL = regex.compile(rf"(?:{'|'.join(LABELS.split())})\.?(?:\s*(?:\d+(?:\.\d+)*|[A-Z]))?(?:[a-z]?)$", regex.I)
_NEXT = regex.compile(r"\s*([\"'“„«¿¡(\[‘「『]*)\s?(\S?)")
_DOTTED = regex.compile(r"\p{L}\.")
_NEXT_WORD = regex.compile(r"[\p{L}\p{M}]+")
_GREEK = regex.compile(r"[\u0370-\u03ff\u1f00-\u1fff]")
_RUN_ON = regex.compile(r"\p{Lu}\p{Ll}")
_SPACELESS_CHAR = regex.compile(_SPACELESS)
_HARD = set("。！？｡⁇‽")


def _is_abbreviation(text: str, start: int, at: int, opens: str, nxt: str, rest: int) -> bool:
    """Whether the full stop at ``at`` belongs to the word before it rather than to the sentence."""
    found = _WORD.match(text, start, at)
    if found is None:
        return False
    word = found.group().strip("'’-")
    low = unicodedata.normalize("NFC", word.lower())
    upper = nxt.isupper() or nxt.istitle()
    if _LABEL.match(text, start, at):
        return True  # a label at the start stays with what it introduces
    if word.isdigit():
        if found.start() == start:
            return True  # a number that opens the unit
        if nxt.isalpha() and len(word) <= 2:
            w = _NEXT_WORD.match(text, rest)
            return w.group().lower() in MONTHS or (not opens and _word_before(text, start, found.start()) in ORDINAL_AFTER)
        return False
    if low in BEFORE_NUMBER:
        if nxt.isdigit():
            return True
        if len(low) > 1:
            return low not in ("no", "nos", "art", "may")
    if low in ("ms", "mr", "mrs", "mme") and word.islower():
        return False  # milliseconds and the like: titles are capitalised
    if len(word) == 1 and word.isalpha() and _DOTTED.match(text, rest):
        return True  # one of several dotted letters
    if low in NEVER_END:
        return not (len(word) == 1 and word.islower() and upper)
    if len(word) == 1 and word.isalpha():
        if word.isupper() or not word.islower():
            if _word_before(text, start, found.start()).rstrip(".") in ("app", "study", "group", "appendix", "panel", "part", "scale", "vitamin", "type", "box"):
                return not upper
            return nxt.isalnum()
        return not upper
    if low in MAY_END:
        return opens[:1] in ("(", "[") or (not opens and (nxt.islower() or nxt.isdigit()))
    if "." in word and regex.fullmatch(r"(?:\p{L}\.)+\p{L}", word):  # dotted initials
        return not upper
    return False


def _word_before(text: str, start: int, at: int) -> str:
    """The word before ``at``, in lower case; longer ones than any that is listed are none."""
    m = _WORD_BEFORE.match(text, start, at)
    return m.group(1).lower() if m else ""


def block_bounds(text: str) -> Iterator[tuple[int, int]]:
    """The blocks between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _ordinal(marker: str) -> int:
    """The place of a marker in its numbering: 3, c and iii are third; a bullet has none."""
    if marker.isdigit():
        return int(marker)
    low = marker.lower()
    if len(low) > 1 or low in "iv":
        romans = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
        return romans.index(low) + 1 if low in romans else 0
    return ord(low) - ord("a") + 1


def _items(text: str, start: int, end: int) -> list[tuple[int, int]] | None:
    """The items of a block that is a list: its first line starts with a marker, and each line that starts
    with the next marker of that style opens a new one.  None for running text."""
    first = _ITEM.match(text, start, end)
    if first is None:
        return None
    style = first.lastindex
    marker = first.group(style)
    place = 0 if style == 2 else _ordinal(marker)
    if style != 2 and not marker.isdigit() and place != 1:
        return None  # an initial, as in "J. Smith found"
    starts, at = [start], text.find("\n", start, end)
    while at >= 0:
        m = _ITEM.match(text, at + 1, end)
        if m is not None and m.lastindex == style:
            same = m.group(2) == marker if style == 2 else _ordinal(m.group(style)) == place + 1 or (place == 8 and m.group(style).lower() == "i")
            if same:
                starts.append(at + 1)
                place += 1
        at = text.find("\n", at + 1, end)
    if len(starts) == 1 and (style == 1 and not marker.isdigit() or style == 2 and marker in "–—*·"):
        return None
    return list(zip(starts, [*starts[1:], end]))


class _Marks:
    """Open quotations and brackets of a block, nested to any depth.  A mark that is never closed opens nothing."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.open: list[tuple[str, int]] = []  # the closing mark expected, where it opened
        self.waiting: Counter[str] = Counter()  # how many open ones expect each mark
        self.last: dict[str, int] = {}

    def _comes(self, mark: str, at: int) -> bool:
        if mark not in self.last:
            self.last[mark] = self.text.rfind(mark, self.start, self.end)
        return self.last[mark] > at

    def _push(self, expected: str, at: int) -> None:
        self.open.append((expected, at))
        self.waiting[expected] += 1

    def cut(self, left: int) -> None:
        """Closes all but the ``left`` outermost."""
        while len(self.open) > left:
            self.waiting[self.open.pop()[0]] -= 1

    def see(self, mark: str, at: int) -> bool:
        """Takes note of a mark; False if it is neither quotation nor bracket."""
        if mark in _OPEN and not (mark == "“" and self.open and self.open[-1][0] == "“"):
            if self._comes(_OPEN[mark], at) or (mark == "„" and self._comes("”", at)):
                self._push(_OPEN[mark], at)
        elif mark == '"' and not self.waiting['"']:
            if self._comes('"', at):
                self._push('"', at)
        elif mark in _CLOSE or mark == '"':
            if self.waiting[mark] or (mark == "”" and self.waiting["“"]):
                left = len(self.open)
                while not _closes(mark, self.open[left - 1][0]):
                    left -= 1
                self.cut(left - 1)
        else:
            return False
        return True


def _closes(mark: str, expected: str) -> bool:
    return mark == expected or (expected == "“" and mark == "”")


def _closing_marks(text: str, at: int, end: int, open_: list[tuple[str, int]]) -> tuple[int, int, int]:
    """What closes after a terminator: the end of the closing marks and note numbers, how many marks stay open, where the outermost
    closed mark had opened (-1 for none)."""
    left, opened = len(open_), -1
    while at < end:
        ch = text[at]
        if left and _closes(ch, open_[left - 1][0]):
            left -= 1
            opened = open_[left][1]
        elif ch.isspace() and left and open_[left - 1][0] == "»" and text[at + 1 : at + 2] == "»":
            pass  # French sets a space before the closing mark
        elif ch in "[¹²³⁰⁴⁵⁶⁷⁸⁹":
            note = _NOTE.match(text, at, end)
            if note is None:
                break
            at = note.end() - 1
        elif ch not in _LOOSE:
            break
        at += 1
    return at, left, opened


def _ends_after_quote(text: str, begin: int, opened: int, opens: str, nxt: str, rest: int, prose: bool, spaceless: bool) -> bool:
    """Whether a sentence ends with a quotation or bracket that a terminator closed."""
    if text[opened] in "([（［{【":
        return opened == begin  # a bracketed sentence within another does not end it
    if prose or (nxt and nxt in ",;:،؛،、，；：—–-"):
        return False
    if not spaceless:
        return True
    intro = text[begin:opened].rstrip()
    if not intro:
        return bool(opens)  # a quotation that opens the sentence: what follows says who spoke
    if intro[-1] in ":：":
        return True
    return not words.goes_on(words.run_after(text, rest), after_comma=intro[-1] in ",，")


def _sentences(text: str, start: int, end: int) -> list[int]:
    """The ends of the sentences of a block of running text, the last one left out."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    cuts: list[int] = []
    begin = skip = start
    marks = _Marks(text, start, end)
    gaps = words.gaps(text, start, end)
    gap = 0

    def take(cut: int) -> None:
        nonlocal begin
        cuts.append(cut)
        begin = cut
        while begin < end and text[begin].isspace():
            begin += 1

    def take_gaps(before: int) -> None:
        nonlocal gap
        while gap < len(gaps) and gaps[gap][0] <= before:
            a, _, ends = gaps[gap]
            gap += 1
            if ends and not marks.open and a > begin:
                take(a)

    for m in _EVENTS.finditer(text, start, end):
        at, mark = m.start(), m.group()
        take_gaps(at)
        if at < skip or marks.see(mark, at):
            continue
        one, stop = mark[0], m.end()
        after, left, opened = _closing_marks(text, stop, end, marks.open)
        if left or after >= end:
            continue  # inside of something that goes on, or the end of the block
        spaced, hard = text[after].isspace(), one in _HARD
        if one in ";\u037e" and not (spaced and _GREEK.match(text[max(start, at - 1) : at])):
            continue
        if not (spaced or hard or (one in "!?" and _SPACELESS_CHAR.match(text, after)) or _RUN_ON.match(text, stop, end)):
            continue
        look = _NEXT.match(text, after, end)
        opens, nxt, rest = look.group(1), look.group(2), look.start(2)
        prose = nxt.islower() and _SYMBOL.match(text, rest) is None
        if opened >= 0:
            ends = _ends_after_quote(text, begin, opened, opens, nxt, rest, prose, hard or (not spaced and _SPACELESS_CHAR.match(text, rest) is not None))
        elif mark == ".":
            ends = after > stop or not _is_abbreviation(text, begin, at, opens, nxt, rest)
        elif set(mark) <= {".", "…"}:  # an ellipsis
            ends = not (prose or (nxt and nxt in ",;"))
        else:
            ends = hard or not (nxt and nxt in ",;،、，")
        if ends:
            marks.cut(left)
            take(after)
            skip = after
    take_gaps(end)
    return cuts


def split_units(text: str | None) -> list[tuple[int, int]]:
    """The units of a text as (first code point, the one after the last), in order.

    Null, empty and blank texts have none.
    """
    if not text:
        return []
    out = []
    for start, end in block_bounds(text):
        parts = _items(text, start, end)
        if parts is None:
            cuts = _sentences(text, start, end)
            parts = list(zip([start, *cuts], [*cuts, end]))
        for a, b in parts:
            piece = text[a:b]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                out.append((a + left, a + len(piece.rstrip())))
    return out


def sentence_units(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The sentence units of every document: ``key``, start_char, end_char.

    Positions are code points from 0, the end being the one after the last; white space around a unit is left
    out.  Null, empty and blank texts give no rows.  A repeated document gives its rows again; an
    empty table gives none; a null key stays null.  Texts are handled whole, of any length.

    Scale: one scan without a shuffle; a batch of texts is all that a worker holds.
    """
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            counts = np.zeros(len(batch), dtype=np.int64)
            starts: list[int] = []
            ends: list[int] = []
            for i, t in enumerate(texts.to_pylist()):
                units = split_units(t)
                counts[i] = len(units)
                for a, b in units:
                    starts.append(a)
                    ends.append(b)
            index = pa.array(np.repeat(np.arange(len(batch)), counts))
            yield pa.RecordBatch.from_arrays(
                [keys.take(index), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "start_char", "end_char"]
            )

    schema = f"`{key}` {kind.simpleString()}, start_char bigint, end_char bigint"
    return documents.select(key, documents[text].cast("string").alias("__text")).mapInArrow(run, schema)
