"""Sentence units of texts cut by hand."""

import pytest

from lodestat.llm import sentences as S
from lodestat.llm import words as W

# Each text is written as its units; they are joined by a space, or by nothing where a script has none.
SPACED = [
    ["Dr. Smith met Prof. Dr. Lee at 9 a.m. on Nov. 5.", "They left.", "Why?", "Nobody knew...", "That was it!"],
    ["We saw t(27) = .45, p = .03 (see Fig. 2).", "41 answers were late, e.g. those of row 3.", "p values below .05 are shown."],
    ["He rated it \"very good.\"", "She did not."],
    ["One wrote, \"I felt seen. It was odd.\" and left early.", "Another said: \"It was loud.\"", "The test is done."],
    ["\"Did you see it?\" asked the reader.", "The key result (\"x rises.\") is not shown."],
    ["(The order was random; see p. 30.)", "We kept 5 pairs."],
    ["This matched the estimate.[3]", "Next came R. O. Marin et al. (2003) with App. B of the report."],
    ["The U.S. sample was small, i.e. 12 in the U.K. group.", "It came from Tolvek Inc. and Brindle Ltd. in May."],
    ["Measures were mood, sleep, etc.", "The rest is in codebook_v2.xlsx and v. 3.6.0."],
    ["Der Wert wurde am 3. Mai 2022 erhoben, z. B. mit d = 1,2.", "Im 2. Versuch sank er, d. h. um ca. 5 %.", "„Warum?“, fragte sie.", "Er sagte: „Es war laut.“", "Niemand ging!"],
    ["Quelle surprise !", "Elle a dit : « Je ne sais pas. »", "M. Tarfal et Mme Dra ont codé, cf. p. 8; le Dr Cor a relu.", "Le groupe comptait 3 adultes, c.-à-d. 2 femmes."],
    ["¿Por qué cambió?", "¡No hubo diferencias!", "En EE. UU. se probó a 41 personas; véase la fig. 3, pág. 4.", "La Sra. Ost salió."],
    ["Проф. А. В. Тармин проверил табл. 2 на с. 15.", "В 2003 г. в двух городах было 5 чел., т. е. 3 женщины.", "«Было громко», — сказал один.", "Он ответил: «Не знаю.»", "Почему?"],
    ["Γιατί χάθηκε το αποτέλεσμα;", "Ο δρ. Ταρβίκ έλεγξε το αρχείο, π.χ. 5 άτομα· τίποτα άλλο.", "Κανείς!"],
    ["قال أحد المشاركين: \"كان الصوت عاليا.\"", "استبعد د. طارفيك 5؛ انظر الشكل 2.", "لماذا؟", "نعم!"],
    ["डॉ. तरविक ने 5 लोगों की जाँच की।", "एक ने कहा, \"आवाज़ तेज़ थी।\"", "क्यों?"],
    ["\"소리가 너무 컸다.\"라고 한 참가자가 말했다.", "평균은 1.31였다.", "왜 사라졌을까?"],
    ["ተሳታፊዎቹ ሁሉ መልስ ሰጡ።", "ለምን ጠፋ?"],
    ["กลุ่มทดลองมีคะแนนเฉลี่ยสูงกว่ากลุ่มควบคุม", "คะแนนลดลงหลังการฝึก", "เราเก็บข้อมูลจาก 230 คน"],
    ["Fig. 4. Mean score by group.", "Nobody came."],
]
JOINED = [
    ["为什么效应消失了？", "“你看到提示了吗？”主试问道。", "他先说“可以。然后呢？”才离开房间。", "参与者说：“声音太大了。”", "平均值为7.84，p=.039。"],
    ["なぜ効果は消えたのか？", "「気づきましたか？」と実験者は尋ねた。", "参加者は「音が大きすぎた。」と述べた。", "差は有意ではなかった（p = .188）。"],
]


def cut(text):
    return [text[a:b] for a, b in S.split_units(text)]


@pytest.mark.parametrize("units", SPACED, ids=[u[0][:12] for u in SPACED])
def test_spaced(units):
    assert cut(" ".join(units)) == units
    assert cut("  \n" + "   ".join(units) + " \n") == units


@pytest.mark.parametrize("units", JOINED, ids=["zh", "ja"])
def test_joined(units):
    assert cut("".join(units)) == units


def test_line_breaks_wrap_and_blank_lines_end():
    assert cut("The first sentence is\nwrapped here. The second\none too.\n \nA heading\r\n\r\nText without an end\n\nMore") == ["The first sentence is\nwrapped here.", "The second\none too.", "A heading", "Text without an end", "More"]


def test_lists_and_captions():
    assert cut("1. one item. With two parts.\n2. another\nthat wraps\n3. last") == ["1. one item. With two parts.", "2. another\nthat wraps", "3. last"]
    assert cut("(a) one\n(b) two\n\n- x. y.\n- z") == ["(a) one", "(b) two", "- x. y.", "- z"]
    assert cut("Table 2. Means by group\n\n3.1 Measures\n\nText.") == ["Table 2. Means by group", "3.1 Measures", "Text."]
    assert cut("The slope was reversed\n– a signed one – in 2014. It held.") == ["The slope was reversed\n– a signed one – in 2014.", "It held."]


def test_every_visible_character_is_covered():
    texts = [" ".join(u) for u in SPACED] + ["".join(u) for u in JOINED] + ['odd " quote. Never closed (here. Or [there.', "... !!! ???", "a.b.c. d", "‘x’ y. z", "」。「", "​", "\x00. A"]
    for t in texts:
        units = S.split_units(t)
        left = t
        for a, b in reversed(units):
            assert t[a:b] == t[a:b].strip() and a < b
            left = left[:a] + left[b:]
        assert not left.strip()


def test_nothing_to_cut():
    assert S.split_units(None) == S.split_units("") == S.split_units(" \n\t ") == []


def test_lattice():
    tiny = W.Language(False, frozenset(["ab", "cd"]), frozenset(["abc"]), frozenset(), frozenset())
    assert W.lattice("abcd", tiny) == ["ab", "cd"] and W.lattice("", tiny) == [] and W.lattice("文字ab", tiny) == ["文字", "ab"]
    assert W.lattice("คะแนนสูงกว่า", W.LANGUAGES["thai"])[0] == "คะแนน"  # not the particle คะ
    assert W.lattice("でもよい", W.LANGUAGES["japanese"])[0] == "でも" and W.lattice("と述べた", W.LANGUAGES["japanese"])[0] == "と"
    assert W.lattice("一个被试", W.LANGUAGES["chinese"])[0] == "一个" and W.lattice("一边说", W.LANGUAGES["chinese"])[0] == "一"


GAPS = [
    ("差は有意でした しかし効果は小さい", 2), ("差は 有意でした", 1), ("効果が しかし小さい", 1), ("参加者は答えた また説明を読んだ", 2), ("実験は終わった 参加者は帰った", 1),
    ("效应消失了 但是我们继续观察", 2), ("我们 继续观察", 1), ("效应 消失了", 1), ("因为 我们继续", 1),
    ("ກຸ່ມທົດລອງມີຄະແນນສູງ ຄະແນນຫຼຸດລົງ", 2), ("ກຸ່ມທົດລອງ ແລະ ກຸ່ມຄວບຄຸມ", 2), ("ກຸ່ມທົດລອງແລະ ກຸ່ມຄວບຄຸມ", 1),
    ("ក្រុមពិសោធន៍បានបញ្ចប់ហើយ យើងបានពិនិត្យ", 2), ("ក្រុមពិសោធន៍ និង ក្រុមត្រួតពិនិត្យ", 1),
    ("အဖွဲ့သည် ရမှတ်မြင့်သည် သို့သော် ကျဆင်းသည်", 2), ("အဖွဲ့ နှင့် ရမှတ်", 1),
    ("เราเก็บข้อมูลแล้ว คะแนนลดลง", 2), ("กลุ่มทดลองและ กลุ่มควบคุม", 1), ("ขอบคุณมาก ครับ", 1), ("ผลคือ ไม่มีความแตกต่าง", 1),
]


@pytest.mark.parametrize(("text", "n"), GAPS)
def test_gaps_without_a_stop(text, n):
    assert len(cut(text)) == n, cut(text)


def test_an_opening_word_after_a_quotation_is_no_particle():
    assert cut("彼は「はい。」でも帰った。") == ["彼は「はい。」", "でも帰った。"] and cut("彼は「はい。」で終えた。") == ["彼は「はい。」で終えた。"]
    assert cut("他说“可以。”一个人走了。") == ["他说“可以。”", "一个人走了。"] and cut("他说“可以。”一边走。") == ["他说“可以。”一边走。"]


def test_marks_nest_to_any_depth():
    deep = "He (" + "(" * 200 + "so. It is. " + ")" * 200 + ") left. Then more."
    assert cut(deep)[-1] == "Then more." and len(cut(deep)) == 2
    assert len(S.split_units("(" * 20_000 + "a. b. " * 2000 + ")" * 20_000)) == 1
    assert len(cut("x" * 300 + ", e.g. " + "y" * 90 + " al. (2003) said so")) == 1


def test_documents(spark):
    rows = [(1, "One. Two.", 5), (1, "One. Two.", 5), (2, None, 0), (3, "", 0), (None, "X", 1), (4, "word. " * 20_000, 9)]
    got = S.sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string, start_char bigint")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert sorted(by[1]) == [(0, 4), (0, 4), (5, 9), (5, 9)] and by[None] == [(0, 1)] and 2 not in by and 3 not in by and by[4][-1][1] == 6 * 20_000 - 1
    assert S.sentence_units(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
