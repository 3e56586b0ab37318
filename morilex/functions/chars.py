"""Character classes, kana, and tests on words, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kana import vowel_kana

KATAKANA = "".join(chr(c) for c in range(ord("ァ"), ord("ヶ") + 1))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL)
#: Runs of one script: the generic stand-in for an analyser's tokens.
TOKEN = "[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+"
#: Kana that the stem of a vowel verb may end in: of the i and e columns; し is left out on purpose.
IE_COLUMN = vowel_kana("ie").replace("し", "")
#: Kana after which small ゃ, ゅ and ょ may stand.
BEFORE_SMALL = vowel_kana("i").replace("い", "")
# What no word begins or ends with; characters of old spelling and place holders.
BAD_FIRST = "^[っゃゅょぁぃぅぇぉッァィゥェォャュョー〜：・＃○◎●]"
BAD_LAST = "[：・]$"
OBSOLETE = "[　〓ゐゑヰヱヽヾゝゞ]"
#: Content that a phrase begins with.
PHRASE = "[一-鿿々ァ-ヴーA-Za-z0-9０-９]"
NOUN_LIKE = ("普通名詞", "副詞", "ナ形容詞")
#: Other codes of the same languages, and codes that name none.
LANGUAGES = {"jpn": "ja", "eng": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "kor": "ko", "spa": "es", "por": "pt", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "tha": "th"}
NO_LANGUAGE = ("", "und", "xx", "zxx", "mul", "mis", "unk")


def hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def half_width(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def name_type(c: Column) -> Column:
    """'kanji', 'hiragana', 'katakana' (with letters and figures), or 'mixed'."""
    return F.when(c.rlike("^[一-鿿々]+$"), "kanji").when(c.rlike("^[ぁ-ゖ]+$"), "hiragana").when(c.rlike("^[ァ-ヴー・A-Za-z0-9Ａ-Ｚａ-ｚ０-９]+$"), "katakana").otherwise("mixed")


def reading(c: Column) -> tuple[Column, Column]:
    """(reading from the surface, whether it is unsure: something other than kana is left)."""
    kana = hiragana(c)
    return kana, ~kana.rlike("^[ぁ-ゖー]+$")


def repname(surface: Column, yomi: Column) -> Column:
    return F.concat(half_width(surface), F.lit("/"), F.coalesce(yomi, F.lit("")))


def unvoice(midasi: Column, imis: Column) -> Column:
    """Undo the voicing of the first kana of a second element that is marked as voiced."""
    voiced, plain = "がぎぐげござじずぜぞだぢづでどばびぶべぼガギグゲゴザジズゼゾダヂヅデドバビブベボ", "かきくけこさしすせそたちつてとはひふへほカキクケコサシスセソタチツテトハヒフヘホ"
    return F.when(F.coalesce(imis, F.lit("")).contains("濁音化"), F.concat(F.translate(F.left(midasi, F.lit(1)), voiced, plain), F.substring(midasi, F.lit(2), F.length(midasi)))).otherwise(midasi)


def is_undefined(fstring: Column, hinsi: Column) -> Column:
    """Undefined word, or one whose part of speech was changed from undefined."""
    return F.coalesce(fstring.rlike(r"<品詞変更:[^-]+-[^-]+-[^-]+-15-"), F.lit(False)) | (hinsi == "未定義語")


def stem_allowed(stem: Column, pos_s: str) -> Column:
    """Whether a stem can belong to a part of speech."""
    last = F.right(stem, F.lit(1))
    if pos_s == "母音動詞":
        # the last kana must be of the i or e column; the reading of other characters is not known
        return ~last.rlike("[ぁ-ゖァ-ヶー]") | hiragana(last).isin(*IE_COLUMN)
    if pos_s == "サ変動詞":
        return stem.rlike("^[一-鿿]$")
    if pos_s == "イ形容詞":
        return ~last.isin("っ", "ん", "ッ", "ン")
    if pos_s.startswith("子音動詞") and pos_s != "子音動詞サ行":
        return ~last.isin("っ", "ん", "ッ", "ン", "ー")
    return F.lit(True)


def pos_name(hinsi: Column, bunrui: Column, katuyou1: Column) -> Column:
    """Part of speech used for acquisition, or null."""
    verb = F.when(katuyou1.isin("母音動詞", "サ変動詞", "ザ変動詞") | katuyou1.startswith("子音動詞"), katuyou1)
    adjective = F.when(katuyou1.startswith("イ形容詞"), "イ形容詞").when(katuyou1.startswith("ナ"), "ナ形容詞")
    noun = F.when(~F.coalesce(bunrui, F.lit("")).isin("数詞", "形式名詞", "副詞的名詞", "時相名詞"), "普通名詞")
    return F.when(hinsi == "動詞", verb).when(hinsi == "形容詞", adjective).when(hinsi == "名詞", noun).when(hinsi == "副詞", "副詞")


def pos_consistent(h1: Column, b1: Column, k1: Column, h2: Column, b2: Column, k2: Column) -> Column:
    """Two entries agree in part of speech; nouns and na-adjectives count as one, i-adjectives as one."""
    noun1, noun2 = (h1 == "名詞") | F.coalesce(k1.startswith("ナ"), F.lit(False)), (h2 == "名詞") | F.coalesce(k2.startswith("ナ"), F.lit(False))
    i1, i2 = F.coalesce(k1.startswith("イ形容詞"), F.lit(False)), F.coalesce(k2.startswith("イ形容詞"), F.lit(False))
    return (noun1 & noun2) | (i1 & i2) | ((h1 == h2) & b1.eqNullSafe(b2) & k1.eqNullSafe(k2))


def bad_word(stem: Column, pos_s: Column) -> Column:
    noun = pos_s.isin(*NOUN_LIKE)
    return stem.rlike(BAD_FIRST) | stem.rlike(BAD_LAST) | (pos_s.endswith("名詞") & (F.length(stem) == 1)) | (noun & (stem.rlike("^[ぁ-ゖ]ー$") | stem.endswith("っ")))


def unsafe_word(stem: Column, pos_s: Column) -> Column:
    return pos_s.isin(*NOUN_LIKE) & stem.rlike("^[ァ-ヴー]{1,2}$")


def sane_entry(midasi: Column, yomi: Column, imis: Column) -> Column:
    return F.length(midasi).between(1, 129) & F.length(F.coalesce(yomi, F.lit("あ"))).between(1, 129) & (F.length(F.coalesce(imis, F.lit(""))) <= 1024)


def language(label: Column) -> Column:
    """A language label without its spelling ('JA', 'ja-JP' and 'jpn' are 'ja'); null if it names no language."""
    base = F.element_at(F.split(F.lower(F.trim(label)), "[-_]"), 1)
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), base), base)
    return F.when(~base.isin(*NO_LANGUAGE), base)


def japanese_text(c: Column) -> Column:
    return c.rlike("[ぁ-ゖァ-ヴ]")


def noisy_line(c: Column, longest: int = 15) -> Column:
    """Full-width space, obsolete kana or geta, small kana where none can stand, or a phrase that is too long.

    A phrase begins with content after kana or a mark and has at most `longest` characters.
    """
    return c.rlike(OBSOLETE) | c.rlike("%s+[ぁ-ゖ]{%d,}|%s{%d,}" % (PHRASE, longest, PHRASE, longest + 1)) | c.rlike(f"(?:^|[^{BEFORE_SMALL}])[ゃゅょ]") | c.rlike("(?:^|[^ぁ-ゖ])[ぁぃぅぇぉ]|(?:^|[^ァ-ヴ])[ァィゥェォ]")


def suffix_noise(c: Column) -> dict[str, Column]:
    """Reasons for which a sentence is of no use for counting suffixes."""
    return {
        "corrupt": c.rlike(r"\x{FFFD}|\\x[0-9A-Fa-f]{2}"),
        "wide_space": c.contains("\u3000"),
        "small_kana": c.rlike("(?:^|[^ぁ-ゖ])[ぁぃぅぇぉゃゅょっ]"),
        "no_predicate": ~c.rlike("[ぁ-ゖ]"),
        "long_phrase": c.rlike(r"[^、。！？「」（）\s]{16,}"),
    }


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?([^/]+)", 1)


def plain_tweet(c: Column) -> Column:
    """Without mentions, tags, links; entities unescaped; spaces collapsed."""
    c = F.regexp_replace(c, r"https?://[A-Za-z0-9./?=_-]+", "")
    c = F.regexp_replace(c, r"@[A-Za-z0-9_]+", "")
    c = F.regexp_replace(c, r"#\S+", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, "[ 　]+", " "))
