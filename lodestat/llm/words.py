"""Words of scripts without spaces: dictionary lattices, and what a gap between two words says.

The dictionaries hold the function words that decide at gaps (what leaves a sentence open, ends it, opens one, or is bound to what
stands before) and plain words that look as if they began or ended with one.  All other text is unknown words, whose
edges keep to the script: no mark is cut off its base, no leading vowel from what it leads, and runs of one kind of
character (kanji, katakana, digits, letters) stay together.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import regex

#: The costs of a word of the dictionary, and of an unknown word with and for each of its characters.
KNOWN, UNKNOWN, UNKNOWN_CHARACTER = 1.0, 0.5, 1.3


@dataclass(frozen=True)
class Language:
    """The words of a language by what they do at a gap, and whether a gap ends a sentence by itself."""

    spaced_sentences: bool
    open: frozenset[str]  # before a gap: the sentence goes on
    final: frozenset[str]  # before a gap: the sentence may end
    opening: frozenset[str]  # after a gap: a sentence may begin
    bound: frozenset[str]  # after a gap: belongs to what stands before
    plain: frozenset[str] = frozenset()
    words: frozenset[str] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "words", self.open | self.final | self.opening | self.bound | self.plain)
        object.__setattr__(self, "longest", max(map(len, self.words)))


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Function words of the languages, by what they do at a gap.
LANGUAGES = {
    "thai": Language(
        True,
        _words("และ หรือ แต่ ว่า ซึ่ง ของ จาก คือ เช่น ได้แก่ โดย กับ เพื่อ เพราะ ถ้า หาก เมื่อ ระหว่าง ตาม ต่อ ด้าน แก่ แด่"),
        _words("ๆ ฯลฯ ฯ ครับ ค่ะ คะ นะ ด้วย แล้ว"),
        _words("อย่างไรก็ตาม นอกจากนี้ ดังนั้น เรา การ ความ ผู้ ผล กลุ่ม ใน จากนั้น ต่อมา ทั้งนี้ คะแนน"),
        _words("ๆ ฯลฯ ฯ ครับ ค่ะ คะ นะ ด้วย แล้ว"),
        _words("กว่า คณะ ชนะ ขณะ ลักษณะ แล้วจึง ด้วยเหตุ ต่างหาก วิธีการ นัก อายุ ที่ ไม่ มี ให้ แต่ละ เพราะฉะนั้น แต่งงาน ว่าง กับดัก ของขวัญ ตามปกติ ต่อไป ต่อต้าน"),
    ),
    "lao": Language(
        True,
        _words("ແລະ ຫຼື ແຕ່ ວ່າ ເຊິ່ງ ຊຶ່ງ ຂອງ ຈາກ ຄື ເຊັ່ນ ໂດຍ ກັບ ເພື່ອ ເພາະ ຖ້າ ເມື່ອ"),
        _words("ແລ້ວ ເດີ້ ເນາະ ໆ"),
        _words("ພວກເຮົາ ນອກຈາກນັ້ນ ດັ່ງນັ້ນ ຜູ້ ກຸ່ມ ການ ຄວາມ ໃນ"),
        _words("ໆ ເດີ້ ເນາະ ແລ້ວ"),
    ),
    "khmer": Language(
        False,
        _words("និង ឬ ប៉ុន្តែ ថា ដែល របស់ ពី ដោយ ជាមួយ ដើម្បី ព្រោះ ប្រសិនបើ ក្នុង នៃ"),
        _words("ហើយ ទេ ណា ផង ទៀត"),
        _words("យើង ដូច្នេះ លើសពីនេះ អ្នក ក្រុម ការ ទោះជា បន្ទាប់មក នៅ"),
        _words("ៗ ទេ ផង"),
    ),
    "burmese": Language(
        False,
        _words("နှင့် သို့မဟုတ် ၏ မှ ကို တွင် က သော ရန် အတွက်"),
        _words("သည် တယ် ပါသည် ပါတယ် မည် မယ် ပြီ ခဲ့သည် ကြသည်"),
        _words("သို့သော် ထို့ကြောင့် ထို့အပြင် ကျွန်ုပ်တို့ ဤ ထို ယင်း အဖွဲ့"),
        _words("နှင့် ကို ၏ မှ"),
    ),
    "chinese": Language(
        False,
        _words("和 与 及 或 但 而 的 在 对 从 把 被 为 是 以 因为 如果 当 由 于 比 向 以及 并且 或者"),
        _words("了 吗 呢 吧 啊 过 止 等等"),
        _words("但是 然而 因此 所以 此外 另外 首先 其次 最后 同时 例如 我们 本研究 结果 这些 其中 随后 接着 总之 不过 一方面 另一方面 总体"),
        _words("才 就 便 又 也 再 并 而 但 地 的 之 这 等 来 一 主试 他 她 他们 她们 问 说 道 答 写 喊 回答 指出 问道 说道 参与者 研究者 受试者"),
        _words("一个 一些 一般 一旦 这里 来自 等级 但愿 地点 的确 之后 之前 也许 再次 就是 又一次 便是 写作 答案 道路 问题 问卷 说明"),
    ),
    "japanese": Language(
        False,
        _words("は が を に で と の も や から より ため ので のに ば て まで へ として による について"),
        _words("です ます でした ました である であった ない なかった ません た だ れた った いた した する なる か ね よ"),
        _words("しかし また そして なお 一方 次に まず さらに その この これ これら それ 本研究 我々 私たち ただし したがって そこで 例えば 最後に つまり でも もし はい いいえ とくに とりわけ などと"),
        _words("と って という との とは とも など は が を に で の へ や も から まで より"),
        _words("にわか はじめ はっきり もっと もう とても やがて かなり のち でき できる がん をさ もの ものの"),
    ),
}
#: Of the bound words of Chinese and Japanese, those that take up what was said even after a comma.
TAKES_UP = _words("と って という との")

_SCRIPTS = {
    "thai": r"\p{Thai}", "lao": r"\p{Lao}", "khmer": r"\p{Khmer}", "burmese": r"\p{Myanmar}",
    "kana": r"\p{Hiragana}\p{Katakana}ー", "han": r"\p{Han}々〆",
}
_LETTER = "[" + "".join(_SCRIPTS.values()) + "]"
_HAS = regex.compile(_LETTER)
_GAP = regex.compile(rf"(?<={_LETTER}[”\"')\]」』）]?)\s+(?=[“\"'(「『（]?{_LETTER})")
#: A run of text without spaces and punctuation, forwards and backwards.
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}々ーๆฯໆៗ]+")
_RUN_BEFORE = regex.compile(r"(?r)([\p{L}\p{M}\p{N}々ーๆฯໆៗ]+)[”\"')\]」』）]*")
_RUN_AFTER = regex.compile(r"[“\"'(「『（]*([\p{L}\p{M}\p{N}々ーๆฯໆៗ]+)")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_FIRST = {name: regex.compile(f"[{chars}]") for name, chars in _SCRIPTS.items()}
#: Leading vowels of Thai and Lao, and vowels and marks that follow what they belong to, beside the combining ones.
_LEADS, _FOLLOWS = frozenset("เแโใไເແໂໃໄ"), frozenset("ะาำๅๆະາຳ")


def _may_cut(a: str, b: str) -> bool:
    """Whether an unknown word may end between two characters."""
    if a in _LEADS or b in _FOLLOWS or unicodedata.category(b)[0] == "M" or (a in "្္"):
        return False
    x, y = _kind(a), _kind(b)
    return x != y or x in ("word", "hiragana")


def _kind(c: str) -> str:
    if "\u30a0" <= c <= "\u30ff" or "\uff66" <= c <= "\uff9f":
        return "katakana"
    if "\u3040" <= c <= "\u309f":
        return "hiragana"
    if "\u3400" <= c <= "\u9fff" or c == "々":
        return "word"
    if c.isdigit():
        return "digit"
    return "letter" if c.isascii() and c.isalpha() else "word"


def lattice(text: str, language: Language) -> list[str]:
    """The cheapest words of ``text``: known ones, and unknown ones that keep to the script between them."""
    n = len(text)
    far = float("inf")
    # the cheapest way to each place with a word's end there, and the cheapest with an unknown word still open
    done, step = [0.0] + [far] * n, [0] * (n + 1)
    open_, since = [far] * (n + 1), [0] * (n + 1)
    for i in range(n):
        if done[i] + UNKNOWN < open_[i]:
            open_[i], since[i] = done[i] + UNKNOWN, i
        if done[i] < far:
            for k in range(1, min(language.longest, n - i) + 1):
                if done[i] + KNOWN < done[i + k] and text[i : i + k] in language.words and (i + k == n or _whole(text, i + k)):
                    done[i + k], step[i + k] = done[i] + KNOWN, i
        if open_[i] + UNKNOWN_CHARACTER < open_[i + 1]:
            open_[i + 1], since[i + 1] = open_[i] + UNKNOWN_CHARACTER, since[i]
        if open_[i + 1] < done[i + 1] and (i + 1 == n or _may_cut(text[i], text[i + 1])):
            done[i + 1], step[i + 1] = open_[i + 1], since[i + 1]
    out = []
    while n:
        out.append(text[step[n] : n])
        n = step[n]
    return out[::-1]


def _whole(text: str, at: int) -> bool:
    """Whether a known word may end before ``at``: no mark that belongs to it follows."""
    return text[at] not in _FOLLOWS and unicodedata.category(text[at])[0] != "M"


def language_of(run: str) -> Language | None:
    """The language of a run by its script; Han with kana beside it is Japanese."""
    for name in ("thai", "lao", "khmer", "burmese"):
        if _FIRST[name].search(run):
            return LANGUAGES[name]
    if _KANA.search(run):
        return LANGUAGES["japanese"]
    return LANGUAGES["chinese"] if _FIRST["han"].search(run) else None


class _Memo(dict):
    """The words of runs; beyond its size it starts anew."""

    def __missing__(self, key: tuple[str, bool]) -> tuple[str, ...]:
        if len(self) > 50_000:
            self.clear()
        run, japanese = key
        language = LANGUAGES["japanese"] if japanese else language_of(run)
        found = tuple(lattice(run, language)) if language else ()
        if len(run) < 400:
            self[key] = found
        return found


_CUT = _Memo()


def ends_at_gap(before: str, after: str) -> bool:
    """Whether white space between two runs ends a sentence.

    Thai and Lao set their sentences apart by spaces: a gap ends one unless an open word stands before it or a bound word alone
    after it.  In the other languages a gap ends one only between a final and an opening word.
    """
    language = language_of(before)
    if language is None or language is not language_of(after) and not {language, language_of(after)} <= {LANGUAGES["japanese"], LANGUAGES["chinese"]}:
        return language is not None and language.spaced_sentences
    japanese = not language.spaced_sentences and LANGUAGES["japanese"] in (language, language_of(after))
    language = LANGUAGES["japanese"] if japanese else language
    left, right = _CUT[before, japanese], _CUT[after, japanese]
    if language.spaced_sentences:
        return not (left[-1] in language.open or (right[0] in language.bound and len(right) == 1))
    return left[-1] in language.final and right[0] in language.opening


def gaps(text: str, start: int, end: int) -> list[tuple[int, int, bool]]:
    """The gaps of spaceless scripts as (first place of the white space, the one after its last, whether it ends a sentence)."""
    if _HAS.search(text, start, end) is None:
        return []
    out = []
    for m in _GAP.finditer(text, start, end):
        before, after = _RUN_BEFORE.match(text, start, m.start()), _RUN_AFTER.match(text, m.end(), end)
        out.append((*m.span(), before is not None and after is not None and ends_at_gap(before.group(1), after.group(1))))
    return out


def run_after(text: str, at: int) -> str:
    """The run of letters that begins at ``at``."""
    m = _RUN.match(text, at)
    return m.group() if m else ""


def goes_on(run: str, after_comma: bool) -> bool:
    """Whether a sentence goes on with ``run`` after a quotation in Chinese or Japanese: its first word is bound to what stands before."""
    if not run:
        return False
    japanese = _KANA.match(run) is not None
    words = _CUT[run, japanese]
    return bool(words) and words[0] in (TAKES_UP if after_comma else LANGUAGES["japanese" if japanese else "chinese"].bound)
