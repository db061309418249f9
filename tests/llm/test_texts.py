"""Sentences, quality, splitting and reading levels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import quality, readability, splitting
from docquarry.llm.sentences import language, sentence_rows, spans
from docquarry.llm.words import Words, hashed, member


def said(text):
    return [text[a:b] for a, b in spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["According to Dr. E. Vane it covered approx. 28 p.c. of cases, cf. the log.", "See para. 8.17 and Fig. 10 of vol. 1 for it."],
        ["A witness stated: “It was tested. It was never kept.”", "The visit began at 9 p.m.", "eRecord v1.6 was off."],
        ["It cost £30.3 m against £34.2 m.", "94 of the 151 files were lost.", "“Stop! Wait for me,” said Gran.", "No!"],
        ["Services were led by Harl & Co.", "The contract with Rusk Ltd. was signed on Dec. 2014 vs. the plan."],
        ["Recommendation 3: (see para. 4.1) the board should act.", "It must."],
        ["Das Amt testete die Liste am 12. März z. B. in Bonn.", "Der Hrn. Falk kam nicht.", "„Wir haben gewartet. Niemand kam“, sagte sie."],
        ["Le comité a revu la liste p. ex. chez M. Dravick.", "Pourquoi n'a-t-il pas réagi ?", "« Il a dit non. Rien », dit un proche."],
        ["La dirección perdió la hoja p. ej. con el Sr. Vane.", "¿Quién leyó la hoja?", "El 12 de marzo fue así."],
        ["Komisja zmieniła umowę na prośbę p. Vane przy ul. Wierzbowej zimą 10 r. bez zapowiedzi.", "„Długo. Nikt nie przyszedł” – mówi krewny."],
        ["Ο δήμος έχασε τη λίστα π.χ. στις μονάδες σύμφωνα με το άρθ. 14.", "Γιατί έλειπε το μητρώο;", "Το σχέδιο χάθηκε."],
        ["परिजन ने कहा, “हम रुके। कोई नहीं आया।”", "समिति ने डॉ. दास को देखा।", "क्यों नहीं?"],
        ["اللجنة راجعت الخطة بناء على طلب د. سالم.", "من قرأ البرنامج؟", "قال قريب: «انتظرنا. لم يأت أحد»."],
    ],
)
def test_spaced(parts):
    assert said(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [["家属说：“我们等了很久。没有人来。”", "为什么没有名单？", "约占55.6%的病例。"], ["家族は「長く待った。誰も来なかった。」と述べた。", "なぜ更新しなかったのか？", "病院は見直した。"]],
)
def test_unspaced(parts):
    assert said("".join(parts)) == parts


def test_thai_and_layout():
    parts = ["โรงพยาบาลได้ทบทวนโครงการประมาณ 28.1 เปอร์เซ็นต์ในกรณีนี้", "หน่วยกู้ภัยได้เผยแพร่ทะเบียน"]
    assert said(" ".join(parts)) == parts
    assert said("Scope of it\n\nOne line\nbreaks here. Then.Two were lost.  Three.") == ["Scope of it", "One line\nbreaks here.", "Then.", "Two were lost.", "Three."]
    assert said("THE VISIT BEGAN AT 9 P.M. AND ENDED. IN MAY DR. VANE CAME.") == ["THE VISIT BEGAN AT 9 P.M. AND ENDED.", "IN MAY DR. VANE CAME."]
    assert said("12. The board should act. Now.") == ["12. The board should act.", "Now."]
    assert spans(None) == spans("") == spans(" \n ") == []
    assert language("der Rat und die Stadt nicht mit dem Amt") == "de"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abAB .!?\n\n“”\"()。「」؟। 1,;ก　")), max_size=120))
def test_spans_hold_everything_in_order(text):
    at = 0
    for a, b in spans(text):
        assert at <= a < b and text[at:a].strip() == "" and text[a:b] == text[a:b].strip()
        at = b
    assert text[at:].strip() == ""


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "One. Two.", 9), (2, None, 9), (3, " ", 9)], "doc_id bigint, text string, start_at int")
    assert sorted((r.item_id, r.start_at, r.end_at) for r in sentence_rows(df, "doc_id").collect()) == [(1, 0, 4), (1, 5, 9)]
    assert sentence_rows(df.limit(0), "doc_id").count() == 0


PROSE = "The board met on Monday and read the log. It was found to be late. The board will meet again in the spring."
LIST = "\n".join(f"{i}. The board log" for i in range(1, 30))
TABLE = "Site | Cost | Ref\n" + "\n".join(f"Board | {i}% | 12/03/201{i}" for i in range(9))
JUNK = "Zaq wivo xex pulo kez. Mivo zaz qop wex lulo. Vex poq zul waz kivo."


def test_verdicts(spark):
    rows = [(1, PROSE), (2, LIST), (3, TABLE), (4, JUNK), (5, None), (6, ""), (7, " \n"), (8, PROSE + "\n\n" + "\n".join(f"- the log {i}" for i in range(3))), (1, PROSE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    common = hashed("the board met on monday and read log it was found to be late will meet again in spring".split())
    out = {r.doc_id: r for r in quality.quality(df, common=common).collect()}
    assert [out[k].verdict for k in range(1, 9)] == ["prose", "list", "table", "junk", "empty", "empty", "empty", "prose"]
    assert out[1].words == 23 and out[2].duplicate_line_share == 0 and out[2].bullet_line_share == 1.0
    assert quality.quality(df.limit(0)).count() == 0
    assert quality.quality(df).count() == len(rows)


def test_repeated_rows_make_no_word_common(spark):
    rows = [(k, PROSE) for k in range(1, 4)] + [(9, JUNK)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = hashed(["board", "wivo"])
    board = hashed(["board"])
    for found in (quality.common_words(df), readability.familiar_words(df)):
        assert words[member(words, found)].tolist() == board.tolist()
    assert {r.verdict for r in quality.quality(df).filter("doc_id = 9").collect()} == {"junk"}


def test_repetition_decides(spark):
    page = "The board met on Monday and read the log again."
    df = spark.createDataFrame([(1, "\n\n".join([page] * 9)), (2, "\n\n".join([page, PROSE, "It was read again."]))], "doc_id bigint, text string")
    common = hashed("the board met on monday and read log it was found to be late will meet again in spring".split())
    assert {r.doc_id: r.verdict for r in quality.quality(df, common=common).collect()} == {1: "junk", 2: "prose"}


def test_words():
    texts = ["The Board’s log, d'Été 2.5 l'eau", "", "'tis ΟΔΟΣ x²", "été"]
    own = Words(texts)
    said = ["".join(chr(c) for c in own.point[a:b]) for a, b in zip(own.start, own.end)]
    assert said == ["The", "Board’s", "log", "d'Été", "l'eau", "tis", "ΟΔΟΣ", "x²", "été"] and own.doc.tolist() == [0] * 5 + [2] * 3 + [3]
    assert own.letters.tolist() == [len(w) for w in said] and (own.hash & 255).tolist() == own.letters.tolist()
    again = Words(["board's LOG the"])
    assert again.hash.tolist() == [own.hash[k] for k in (1, 2, 0)] and own.longest().tolist() == [7, 0, 4, 3]


def test_common_words_have_no_cap(spark):
    """60,000 words in as large a share of the texts as is asked for: all are common."""
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(60_000)]
    df = spark.createDataFrame([(k, " ".join(words)) for k in range(3)] + [(3, "only once"), (4, None)], "doc_id bigint, text string")
    assert quality.common_words(df).tolist() == hashed(words).tolist()


def test_ngrams():
    got = quality.top_ngrams(Words(["a b a b c a b", "x", "", "in the end in the end in the end"])).tolist()
    assert got == [[6, 0, 0], [0, 0, 0], [0, 0, 0], [18, 24, 22]]


COMMON = hashed("the board met again and read log was in a room at noon of it".split())


def long_text(n=60):
    return " ".join(f"The board met again and read the log of room {i} at noon." for i in range(n)) + "\n\n" + "The log " + "and the room " * 150 + "was read. The board met."


def test_pieces(spark):
    rows = [(1, long_text()), (2, "short"), (3, None), (4, "x" * 4000), (5, "\n".join(["- the log"] * 300)), (1, long_text())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    found = {}
    for r in splitting.split(df, COMMON).collect():
        found.setdefault(r.doc_id, []).append((r.piece, r.start_at, r.end_at))
    assert set(found) == {1, 4, 5}
    for key, pieces in found.items():
        pieces.sort()
        assert pieces[0][1] == 0 and pieces[-1][2] == len(texts[key])
        for (_, a, b), (_, c, d) in zip(pieces, pieces[1:]):
            assert b - a <= 1500 and b - 150 <= c <= b and d > b and c > a
    assert texts[1][: found[1][0][2]].endswith(".")
    at = {r.doc_id: r.long_at for r in splitting.long_sentences(df, COMMON).collect()}
    assert at == {1: texts[1].index("The log and"), 4: 0, 5: -1}
    assert splitting.split(df.limit(0), COMMON).count() == 0


def test_ranges_give_the_same(spark):
    text = "\n\n".join([long_text(9), "Other board met at noon. " * 30, "\n".join(["log"] * 40), long_text(5)])
    df = spark.createDataFrame([(1, text), (2, "\n".join(["- the log"] * 300))], "doc_id bigint, text string")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(splitting.split(df, COMMON, range_chars=700, halo=60)) == rows(splitting.split(df, COMMON))
    assert rows(splitting.long_sentences(df, COMMON, range_chars=700, halo=60)) == rows(splitting.long_sentences(df, COMMON))


def test_ranges_have_the_same_language_and_gaps(spark):
    mixed = "委员会查看了名单并要求整改。" * 40 + "\n\n" + "A log was kept at No. 5 by the board. " * 80  # zh by less than a quarter of the characters
    wide = ("word" * 20 + "   ") * 60  # runs of white space, no sentence ends
    rows = [(1, mixed), (2, wide), (2, wide + "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = lambda r: sorted(tuple(x) for x in splitting.split(df, COMMON, range_chars=r, halo=60).collect())
    assert language(mixed) == "zh" and whole(700) == whole(1_000_000)
    assert splitting.RANGE < 50_000  # the longest texts go by ranges


def test_giant_texts_go_by_ranges(spark):
    """No blank lines, a sentence longer than a halo, and a repeated row; ranges of the production size."""
    plain = " ".join(f"The board met again and read the log of room {i} at noon." for i in range(1_500))
    longest = "The log " + "and the room " * 900 + "was read."
    text = f"{plain} {longest} {plain}"
    df = spark.createDataFrame([(1, text), (1, text), (2, "The board met. " + text)], "doc_id bigint, text string")
    ranged, whole = ({(r.doc_id, r.piece): (r.start_at, r.end_at) for r in splitting.split(df, COMMON, range_chars=c).collect()} for c in (splitting.RANGE, 10**9))
    assert len(text) > 20 * splitting.RANGE and len(longest) > 2 * splitting.HALO and ranged == whole
    found = {r.doc_id: r.long_at for r in splitting.long_sentences(df, COMMON).collect()}
    assert found == {1: len(plain) + 1, 2: len(plain) + 16}
    sizes = [b - a for k, (a, b) in ranged.items() if k[0] == 1]
    assert max(sizes) <= 1_500


def test_overlap_begins_at_a_word():
    text = "word " * 900
    pieces = splitting.cut(len(text), [], splitting.last_blank(text), splitting.first_word(text))
    assert all(text[c - 1] == " " and text[c] == "w" and 140 < b - c <= 150 for (_, b), (c, _) in zip(pieces, pieces[1:]))
    gaps = [(m.start(), m.end()) for m in splitting.GAP.finditer(text)]
    assert splitting.cut(len(text), [], *splitting.gap_finders(*np.array(gaps).T)) == pieces


def test_files(spark, tmp_path):
    file = tmp_path / "giant.txt"
    file.write_text("\n".join("é" * (i % 700) for i in range(60)), encoding="utf-8")
    data = file.read_bytes()
    out = sorted((r.start_byte, r.end_byte) for r in splitting.split_files(spark, [str(file)], limit=500, range_bytes=1000).collect())
    assert out[0][0] == 0 and out[-1][1] == len(data) and all(b == c for (_, b), (c, _) in zip(out, out[1:]))
    assert all(b - a <= 500 for a, b in out)
    assert "".join(data[a:b].decode() for a, b in out) == data.decode()


def test_files_of_long_lines_end_at_sentences(spark, tmp_path):
    file = tmp_path / "lines.txt"
    paragraph = " ".join(f"The board of Zoë met again and read log {i} at noon." for i in range(80))
    file.write_text("\n\n".join([paragraph] * 4 + ["\n".join([paragraph] * 3)]), encoding="utf-8")
    data = file.read_bytes()
    out = sorted((r.start_byte, r.end_byte) for r in splitting.split_files(spark, [str(file)], limit=500, range_bytes=1000, halo=64, overlap=80).collect())
    assert out[0][0] == 0 and out[-1][1] == len(data)
    assert all(data[a:b].endswith(b".") and b - a <= 500 for a, b in out)
    assert all(c < b and data[c : c + 9] == b"The board" for (_, b), (c, _) in zip(out, out[1:]))


EASY = "The dog ran. Can you see the cat? We will go to the park with you. The man had a hat. " * 6
HARD = (
    "The methodological deficiencies identified by the independent commission necessarily presupposed the administrative configuration, thereby exacerbating the "
    "pre-existing deterioration of the retrospective classification and the organisational accountability architecture of the responsible authorities. "
) * 4


def test_levels(spark):
    familiar = hashed("the dog ran can you see cat we will go to park with man had a hat by and of".split())
    rows = [(1, EASY), (2, HARD), (3, EASY + HARD), (4, EASY.replace(". ", ", and ").replace("? ", ", and ") + "."), (5, None), (6, ""), (7, "Short."), (8, EASY.replace("The", "Die").replace("the", "der und nicht"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r for r in readability.reading_levels(df, familiar=familiar).collect()}
    assert [out[k].band for k in range(1, 8)] == ["easy", "hard", None, None, None, None, None]
    assert out[2].grade > out[1].grade and out[5].words == 0
    assert readability.reading_levels(df).count() == len(rows) and readability.reading_levels(df.limit(0)).count() == 0


def test_cleaned():
    assert readability.cleaned("A cut- word and multi-\nple lines") == "A cut- word and multiple lines"
    assert readability.cleaned("- One line\n- Two lines\nThree") == "One line\n\nTwo lines\n\nThree"
