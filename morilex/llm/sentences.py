"""Problem 5: sentence boundaries across languages and scripts.

Method: document-centred disambiguation. Where a full stop may end an abbreviation, the unambiguous occurrences of the same
word elsewhere in the document decide whether it is one (it stands before a small letter, a digit or a comma with its
stop; or it occurs in running text without), and whether the capitalised word that follows is a proper name (capitalised
inside a sentence) or a common word (written small). Whether a figure with a stop is an ordinal is decided by how often the
word after it stands after such figures and how often it starts a sentence elsewhere. Where the document says nothing, the
whole corpus is asked, and only where that is silent as well do the short lists below decide. Scripts without spaces or
stops have their own terminators: ideographic marks for Japanese and Chinese, spaces for Thai.

Plan: ambiguous sites (block, word, follower) are found in one pass. Their words set bits in a map of fixed size, by which
the evidence pass leaves out all other words; evidence is counted by (document, word) with map-side sums, so that no
document is gathered in one place; the verdicts of a block's own sites come back to it as a short list. All passes over a
text take time in proportion to its length. Defined results: a null or blank block has no sentences; the last sentence ends the
block; what stands in quotes or brackets inside a sentence is not split off; a document_id that is null counts only the
corpus; repeated rows give repeated evidence but one result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_OPEN = {"(": ")", "（": "）", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "[": "]", "【": "】", "《": "》", "‹": "›", "〈": "〉", "［": "］", "｢": "｣", "｛": "｝", "{": "}"}
_CLOSE = set(_OPEN.values())
_QUOTES = set("「『“„«《‹\"")
#: What may stand after the final mark and belongs to the sentence: laughter, notes, faces.
_TAIL = r"(?:[♪♫☆★♡♥✨😀-🙏]+|orz|OTL|[（(](?:笑|泣|爆|汗|涙|怒|苦笑|w+|ｗ+)[）)]|笑(?![ぁ-ヿ一-鿿])|泣(?![ぁ-ヿ一-鿿])|[wｗ]{2,}(?![A-Za-z])|ｗ+|[＼\\ヽ]?[（(][^（()）぀-ヿ一-鿿\w]{0,3}[^（()）\s]{0,4}?[\^´｀`∀ω・_;＾°￣▽Д≧≦><][^（()）\s]{0,5}[）)][／/ノ]?[~～]*)"
TAIL = re.compile(_TAIL)
_FACE = re.compile(_TAIL + r"(?=\s|\Z|[「『ぁ-ヿ一-鿿A-Z0-9(（])")
_MARKS = "。｡．！？!?…"
#: What goes on after a closed quotation or a name that ends in a mark.
_GOES_ON = re.compile(r"(?:と(?!ころ|にかく|りあえず|なり|もだ|しょ|り)|って|の(?!は?ら)|を|は(?![いなたこ])|が(?!っこ)|に(?![わち])|も(?![うしりっ])|で(?![もは])|だ(?!が|から|け)|へ(?!や)|や(?![まわ])|から|まで|より|など|[、，,・])")
_NUMBER = re.compile(r"\d|[０-９]")


_KANA, _HAN, _THAI, _HANGUL, _LETTER = re.compile("[ぁ-ヿ]"), re.compile("[一-鿿]"), re.compile("[ก-๛]"), re.compile("[가-힣]"), re.compile(r"[^\W\d_]")
_FILLED = re.compile(r"\S")


def script(text: str) -> str:
    """'ja', 'zh', 'th', 'ko' or 'spaced': by the letters that stand in the text."""
    if text.isascii():
        return "spaced"
    kana = len(_KANA.findall(text))
    if 3 * kana >= len(text):
        return "ja"  # whatever the rest is, it is outweighed
    han, thai, hangul = (len(p.findall(text)) for p in (_HAN, _THAI, _HANGUL))
    others = len(_LETTER.findall(text)) - len(re.findall("[ぁ-ゖゝ-ゟァ-ヺー-ヿ]", text)) - han - len(re.findall("[ก-ะาำเ-ๆ]", text)) - hangul
    n = {k: v for k, v in (("ja", 3 * kana), ("zh", 2 * han), ("th", thai), ("ko", 2 * hangul), ("spaced", others)) if v > 0}
    if n.get("ja") and n["ja"] * 10 >= n.get("zh", 0) and n["ja"] + n.get("zh", 0) >= n.get("spaced", 0):
        return "ja"
    return max(n, key=lambda k: (n[k], k)) if n else "spaced"


def _filled(text: str, a: int, b: int) -> bool:
    """Whether something other than white space stands in text[a:b]."""
    return a < b and _FILLED.search(text, a, b) is not None


def _end(text: str, e: int) -> int:
    """The end of text[:e] without white space behind."""
    while e and text[e - 1].isspace():
        e -= 1
    return e


_BRACKET = re.compile("[" + re.escape("".join(_OPEN) + "".join(_CLOSE)) + '"]')


def _brackets(text: str) -> tuple[list[int], dict[int, int]]:
    """How many brackets or quotes are open at each character, and {end: start} of the outermost ones.

    A bracket that is never closed opens nothing.
    """
    stack: list[tuple[str, int]] = []
    waiting: Counter = Counter()  # closing marks that open ones wait for
    pairs: list[tuple[int, int]] = []
    straight = -1
    for m in _BRACKET.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            if straight >= 0:
                pairs.append((straight, i))
                straight = -1
            else:
                straight = i
        elif c in _CLOSE and waiting[c]:
            while stack:
                s, at = stack.pop()
                waiting[s] -= 1
                if s == c:
                    pairs.append((at, i))
                    break
        elif c in _OPEN:
            stack.append((_OPEN[c], i))
            waiting[_OPEN[c]] += 1
    steps = [0] * (len(text) + 2)
    for a, b in pairs:
        steps[a] += 1
        steps[b + 1] -= 1
    depth = list(accumulate(steps[: len(text) + 1]))
    outer: dict[int, int] = {}
    reach = -1
    for a, b in sorted(pairs):
        if a > reach:
            outer[b] = a
            reach = b
    return depth, outer


def _depths(text: str) -> list[int]:
    return _brackets(text)[0]


def _past_tail(text: str, i: int) -> int:
    """The place after marks and tails that follow from i on, if any (spaces before a tail are taken with it)."""
    while i < len(text):
        if text[i] in _MARKS or text[i] in "~～":
            i += 1
            continue
        m = TAIL.match(text, i)
        if not m:
            j = i
            while j < len(text) and text[j] in " 　":
                j += 1
            m = _FACE.match(text, j) if j > i else None
        if not m:
            return i
        i = m.end()
    return i


#: What may end a sentence, open or close a bracket, or begin a tail.
_NOTABLE = re.compile("[\n" + _MARKS + re.escape("".join(_OPEN) + "".join(_CLOSE)) + '"oO笑泣wｗ＼\\\\ヽ♪♫☆★♡♥✨😀-🙏]')
_NUMBERED = re.compile(r"[(（][\d０-９]+[)）]")


def _wide(text: str, kind: str) -> list[int]:
    """Ends (exclusive) of the sentences of Japanese or Chinese text."""
    ends, n = [], len(text)
    depth, outer = _brackets(text)
    closes, nearest = sorted(outer), 0
    i, start = 0, 0
    while i < n:
        if not depth[i]:  # on to what may end a sentence or open a bracket
            m = _NOTABLE.search(text, i)
            if not m:
                break
            i = m.start()
        if depth[i] and i not in outer:  # on to the end of the outermost bracket
            while closes[nearest] < i:
                nearest += 1
            i = closes[nearest]
        c = text[i]
        if c == "\n":
            if _filled(text, start, i):
                ends.append(i)
            start = i = i + 1
            continue
        if depth[i]:
            if i in outer and i and text[i - 1] in _MARKS and c not in ")）]】":
                # a quotation that ends in a mark: a sentence of its own unless something goes on
                j = _past_tail(text, i + 1)
                heads = not _filled(text, start, outer[i])
                rest = text[j : j + 6].lstrip(" 　")
                if not rest or text[j] == "\n":
                    pass  # the line's end closes it
                elif kind == "zh":
                    if not heads:
                        ends.append(j)
                        start = j
                elif not _GOES_ON.match(rest) and (heads or text[j] in " 　"):
                    ends.append(j)
                    start = j
                i = j
                continue
            i += 1
            continue
        if c in "。｡！？!?" or (c == "．" and not (i and _NUMBER.match(text[i - 1]))) or (c == "…" and (text[i : i + 2] == "……" or (i + 1 < n and text[i + 1] in "。｡！？!?"))):
            if c in "!?" and re.match(r"[A-Za-z0-9=&%/_]", text[i + 1 : i + 2] or " ") and i and re.match(r"[A-Za-z0-9/_]", text[i - 1]):
                i += 1  # inside an address
                continue
            j = _past_tail(text, i + 1)
            while j < n and text[j] in _CLOSE and not depth[j]:
                j += 1
            following = text[j : j + 5]
            # names that end in a mark: an ideograph or katakana before it and a particle right after
            if kind == "ja" and j == i + 1 and c in "。！？!?" and i and not "ぁ" <= text[i - 1] <= "ゖ" and _GOES_ON.match(following):
                i = j
                continue
            if kind == "ja" and c == "…" and re.match("[ぁ-ゖ]", following) and re.match("んだ|んです|のだ|の[。？]|かな|けど|よ[。ね]|ね[。]", following):
                i = j
                continue
            ends.append(j)
            start = i = j
            continue
        if kind == "ja" and i > start:
            m = _FACE.match(text, i)
            if m and not (c in "(（" and _NUMBERED.match(text, i)):
                j = _past_tail(text, m.end())
                ends.append(j)
                start = i = j
                continue
        i += 1
    if _filled(text, start, n):
        ends.append(n)
    return ends


def _thai(text: str) -> list[int]:
    """Thai puts a space between sentences; inside, spaces stand beside figures, other letters and repetition marks."""
    ends, depth = [], _depths(text)
    for m in re.finditer(r"\s+", text):
        a, b = m.span()
        if not a or depth[a] and depth[a - 1]:
            continue
        if "\n" not in m.group() and (re.match(r"[0-9A-Za-z๐-๙ๆฯ]", text[a - 1]) or re.match(r"[0-9A-Za-z๐-๙ๆฯ]", text[b : b + 1] or " ")):
            continue
        ends.append(a)
    return [*ends, len(text)]


# Words before an ordinal that is written with a stop.
_ORDINAL = re.compile(r"\b(?:[Aa]m|[Dd]e[rsmn]|[Vv]om|[Zz]um|[Bb]is|[Ss]eit|[Aa]b)\s+\d{1,2}\Z")
# Titles that stand before names.
TITLES = frozenset("Prof Mme Mlle Sra Srta Dra Ing Rev Gen Capt Hon Fr Hr Frau Herr Mrs".split())
_VOWEL = re.compile(r"[aeiouyàâäéèêëíîïóôöúùûüáñæœаеёиоуыэюя]", re.I)
_CASED = re.compile(r"[A-Za-zÀ-ɏͰ-ӿ]")
_WORD_AFTER = re.compile(r"[^\w]*?([^\W\d_]+)")
_SITE_STOP = re.compile(r"\.(?=\s+\S)")
_EVIDENCE_WORD = re.compile(r"([^\W\d_]+(?:\.[^\W\d_]+)*)(\.?)(?=(\s*)(\S?))")
_SPACED_STOP = re.compile(r"[.!?…。？！]+|\n")


def _word_before(text: str, a: int, first: int = 0) -> str:
    """The word that ends right before a, with stops inside it."""
    k = a
    while k > first and (text[k - 1].isalpha() or (text[k - 1] == "." and k < a and k - 1 > first and text[k - 2].isalpha())):
        k -= 1
    return text[k:a]


def _figure_before(text: str, a: int) -> bool:
    """Whether a figure of one or two digits ends right before a, inside a line."""
    return bool(re.search(r"\S[ \u00a0]\d{1,2}\Z", text[max(0, a - 5) : a]))


def _lines(text: str) -> str:
    """Spaced text whose line feeds only wrap lines gets spaces for them; where each line is a sentence they stay."""
    parts = text.split("\n")
    if len(parts) > 1:
        heads = [re.sub(r"^[\s\W\d_]+", "", p)[:1] for p in parts[1:]]
        ended = sum(bool(re.search(r"[.!?…]\W*\Z", p)) for p in parts[:-1])
        if any(h and h.islower() for h in heads) or ended * 2 < len(parts) - 1:
            return text.replace("\n", " ")
    return text


def sites(text: str) -> list[tuple[str, str]]:
    """(word before the stop, word after or '') wherever a stop may end an abbreviation."""
    out = []
    if script(text) not in ("spaced", "ko"):
        return out
    for m in _SITE_STOP.finditer(text):
        a = _WORD_AFTER.match(text, m.end())
        w = _word_before(text, m.start())
        if w:
            out.append((w, a.group(1) if a else ""))  # a figure may follow as well
        elif a and _figure_before(text, m.start()):
            out.append(("", a.group(1)))
    return out


def evidence(text: str, wanted=None) -> list[tuple[str, str]]:
    """(kind, word): 'abbr' with a stop before a small letter or comma; 'figure' and 'end' with a stop before a figure, or
    before anything else; 'last' with the stop that ends the text; 'word' without a stop; 'small' and 'name': written small,
    or capitalised inside a sentence; 'ordinal' and 'start': capitalised after a short figure, or a word, with a stop.
    wanted(word): whether the word, and its small form as what follows, may be of use."""
    out = []
    if script(text) not in ("spaced", "ko"):
        return out
    flat = text.replace("\n", " ")
    for m in _EVIDENCE_WORD.finditer(flat):
        w = m.group(1)
        own, next_ = wanted(w) if wanted else (True, True)
        if not own and not next_:
            continue
        stop, gap, nxt = m.group(2), m.group(3), m.group(4)
        lower = w.lower()
        if own:
            if stop:
                goes_on = nxt.islower() and gap or nxt and nxt in ",;:"
                out.append(("abbr" if goes_on else "figure" if nxt.isdigit() else "end" if nxt else "last", w))
            else:
                out.append(("word", w))
        if next_:
            if w[0].islower():
                out.append(("small", lower))
            else:
                e = _end(flat, m.start())
                if e and flat[e - 1] not in ".!?…:¿¡«„“”\"'(—–-»":
                    out.append(("name", lower))
                elif e > 1 and flat[e - 1] == "." and e < m.start():
                    if _figure_before(flat, e - 1):
                        out.append(("ordinal", lower))
                    elif flat[e - 2].isalpha():
                        out.append(("start", lower))
    return out


def is_abbreviation(word: str, doc: dict, corpus: dict) -> bool:
    """By the document's unambiguous occurrences first, then by the corpus'."""
    if len(word) == 1 and word.isupper():
        return True
    if "." in word:
        return True
    for seen in (doc, corpus):
        a, w = seen.get(("abbr", word), 0), seen.get(("word", word), 0)
        # a figure may start a sentence: only over the whole corpus does it tell an abbreviation
        figure, end = seen.get(("figure", word), 0) if seen is corpus else 0, seen.get(("end", word), 0) + seen.get(("last", word), 0)
        if (a and a >= w) or (figure > end and figure > w):
            return True
        if w or seen.get(("last", word), 0):
            return False
    # never seen elsewhere: a title, or short letters that make no word
    return word in TITLES or (len(word) <= 3 and word[0].isupper()) or (len(word) <= 4 and not _VOWEL.search(word))


def after_ordinal(word: str, doc: dict, corpus: dict) -> bool | None:
    """Whether a figure with a stop before this word is an ordinal; None if nothing tells."""
    for seen in (doc, corpus):
        ordinal, start = seen.get(("ordinal", word.lower()), 0), seen.get(("start", word.lower()), 0)
        if ordinal >= 2 and ordinal > 2 * start:
            return True
        if start > ordinal:
            return False
    return None


def starts_sentence(word: str, doc: dict, corpus: dict) -> bool:
    """Whether a capitalised word after an abbreviation starts a sentence: it is no proper name."""
    for seen in (doc, corpus):
        small, name = seen.get(("small", word.lower()), 0), seen.get(("name", word.lower()), 0)
        if small or name:
            return small > name
    return False


def _spaced(text: str, kind: str, doc: dict, corpus: dict) -> list[int]:
    flat = _lines(text) if kind != "ko" else text
    ends, depth, n = [], _depths(flat), len(flat)
    start = 0
    for m in _SPACED_STOP.finditer(flat):
        a, b = m.span()
        if a < start:
            continue
        if m.group() == "\n":
            if not depth[a] and _filled(flat, start, a) and (kind != "ko" or flat[_end(flat, a) - 1] in ".!?…”\"」)"):
                ends.append(a)
                start = b
            continue
        if depth[a]:
            continue_at = b
            while continue_at < n and (flat[continue_at] in _CLOSE or flat[continue_at] in "\"'’" or (flat[continue_at] in "   " and flat[continue_at + 1 : continue_at + 2] == "»")):
                continue_at += 1
            if depth[continue_at] or continue_at == b or flat[continue_at - 1] in ")]":
                continue
            b = continue_at
            if kind == "ko" and not re.match(r"\s", flat[b : b + 1] or " "):
                continue
        else:
            while b < n and (flat[b] in _CLOSE or flat[b] in "’'" and not flat[b + 1 : b + 2].isalpha()):
                b += 1
        b = _past_tail(flat, b) if b < n and not flat[b].isspace() else b
        j = b
        while j < n and (TAIL.match(flat, j + 1) if flat[j] == " " else None):
            j = TAIL.match(flat, j + 1).end()
            b = j
        following = _FILLED.search(flat, b)
        if not following:
            break
        if following.start() == b:
            continue  # inside a figure, an address or an abbreviation
        head = re.sub(r"^[\s—–\-]+", "", flat[following.start() : following.start() + 40])
        first = re.sub(r"^[^\w]+", "", head)[:1]
        if first.islower() and not flat[a:b].startswith("…") and not re.match(r"[«„“\"¿¡]", head):
            continue
        if first.islower():
            continue
        if m.group() == ".":
            w = _word_before(flat, a, start)
            if w and _CASED.match(w) and is_abbreviation(w, doc, corpus):
                if first.isdigit():
                    continue
                nxt = _WORD_AFTER.match(flat, b)
                if nxt and not starts_sentence(nxt.group(1), doc, corpus):
                    continue
            if not w and _figure_before(flat, a):
                nxt = _WORD_AFTER.match(flat, b)
                told = after_ordinal(nxt.group(1), doc, corpus) if nxt else None
                if told or (told is None and _ORDINAL.search(flat, max(0, a - 16), a)):
                    continue  # a day of the month, not the end
        # a figure that numbers what follows goes with it
        if m.group() == "." and not _LETTER.search(flat, start, a) and re.search(r"(?:^|\s)\d{1,3}\Z", flat[max(start, a - 4) : a]):
            continue
        ends.append(b)
        start = b
    if _filled(flat, start, n):
        ends.append(n)
    return ends


def split(text: str | None, doc: dict | None = None, corpus: dict | None = None) -> list[int]:
    """Ends of the sentences of a block: code points up to and including each one's last character that is no space."""
    if not text or not text.strip():
        return []
    kind = script(text)
    ends = _wide(text, kind) if kind in ("ja", "zh") else _thai(text) if kind == "th" else _spaced(text, kind, doc or {}, corpus or {})
    out = []
    for e in ends:
        e = _end(text, e)
        if e and (not out or e > out[-1]) and _filled(text, out[-1] if out else 0, e):
            out.append(e)
    last = _end(text, len(text))
    if out and out[-1] != last:
        out[-1] = last
    return out


_SITE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("document_id", T.StringType()), T.StructField("key", T.StringType()), T.StructField("bit", T.IntegerType())])
_OF_WORD, _OF_NEXT = ("abbr", "figure", "end", "last", "word"), ("small", "name", "ordinal", "start")
_KIND = {k: ("=", i) for i, k in enumerate(_OF_WORD)} | {k: ("~", i) for i, k in enumerate(_OF_NEXT)}
#: Evidence for a key ('=' and a word, or '~' and a word in small letters): one count for each kind.
_COUNTS = [f"n{i}" for i in range(len(_OF_WORD))]
_EVIDENCE = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("key", T.StringType()), *[T.StructField(c, T.LongType()) for c in _COUNTS]])
_END = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("sentence", T.StringType())])


#: Bits of the map of words that are asked for: fixes what is collected and broadcast; more words only mean more chance hits.
BITS = 1 << 20


def _bit(key: str) -> int:
    """key: '=' and a word, or '~' and a word in small letters."""
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BITS


def _find_sites(batches):
    for b in batches:
        rows = []
        for i, d, t in zip(*(b.column(c).to_pylist() for c in ("row_id", "document_id", "raw"))):
            keys = {k for w, nxt in sites(t) for k in ("=" + w if w else "", "~" + nxt.lower() if nxt else "") if k}
            rows += [(i, d, k, _bit(k)) for k in keys]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=_SITE.names)


def _find_evidence(bits):
    def run(batches):
        here = bits.value

        @lru_cache(200_000)
        def wanted(w: str) -> tuple[bool, bool]:
            return bool(here[_bit("=" + w)]), bool(here[_bit("~" + w.lower())])

        for b in batches:
            n: dict[tuple, list[int]] = {}
            for d, t in zip(b.column("document_id").to_pylist(), b.column("raw").to_pylist()):
                for k, w in evidence(t, wanted):
                    mark, i = _KIND[k]
                    n.setdefault((d, mark + w), [0] * len(_COUNTS))[i] += 1
            keys, counts = list(zip(*n)) if n else [[]] * 2, list(zip(*n.values())) if n else [[]] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in keys], *[pa.array(c, pa.int64()) for c in counts]], names=_EVIDENCE.names)

    return run


def _split_rows(batches):
    for b in batches:
        rows = []
        for i, t, seen in zip(*(b.column(c).to_pylist() for c in ("row_id", "raw", "seen"))):
            doc, corpus = {}, {}
            for x in seen or []:
                kinds = _OF_WORD if x["key"][0] == "=" else _OF_NEXT
                for told, counts in ((doc, x["in_doc"]), (corpus, x["in_corpus"])):
                    told |= {(k, x["key"][1:]): n for k, n in zip(kinds, counts or []) if n}
            at = 0
            for k, e in enumerate(split(t, doc, corpus)):
                own = t[at:e]
                start = at + len(own) - len(own.lstrip())
                rows.append((i, k, start, e, own.strip()))
                at = e
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=_END.names)


def sentences_of(blocks: DataFrame, corpus: DataFrame) -> DataFrame:
    """blocks, corpus(row_id, document_id, raw) -> (row_id, place, start_char, end_char, sentence)."""
    blocks = blocks.where(F.col("raw").isNotNull()).select("row_id", "document_id", "raw")
    asked = common.written(common.spread(blocks).mapInArrow(_find_sites, _SITE).distinct(), "sites")
    bits = np.zeros(BITS, dtype=bool)
    bits[[r[0] for r in asked.select("bit").distinct().collect()]] = True  # at most BITS rows
    asked = asked.drop("bit")
    spaced = corpus.where(F.col("raw").isNotNull()).select("document_id", "raw")
    counted = common.spread(spaced).mapInArrow(_find_evidence(blocks.sparkSession.sparkContext.broadcast(bits)), _EVIDENCE)
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    wanted = asked.select("key").distinct()
    seen = common.written(counted.groupBy("document_id", "key").agg(*sums).join(wanted, "key", "left_semi"), "evidence")
    everywhere = seen.groupBy("key").agg(*sums).select("key", F.array(*_COUNTS).alias("in_corpus"))
    verdicts = asked.join(seen.where("document_id is not null").select("document_id", "key", F.array(*_COUNTS).alias("in_doc")), ["document_id", "key"], "left").join(everywhere, "key", "left").where("in_doc is not null or in_corpus is not null")
    # as long as the block's own list of sites
    lists = verdicts.groupBy("row_id").agg(F.collect_set(F.struct("key", "in_doc", "in_corpus")).alias("seen"))
    return blocks.join(lists, "row_id", "left").select("row_id", "raw", "seen").mapInArrow(_split_rows, _END)


def p5_sentences(spark, sf_dir: str) -> DataFrame:
    """The sentences of every block with their places."""
    s = common.read(spark, sf_dir, "sentences").select("row_id", "document_id", "unit", "raw")
    return sentences_of(s.where("unit = 'block'"), s)


def p5_found(spark, sf_dir: str) -> DataFrame:
    return p5_sentences(spark, sf_dir).select("row_id", "end_char").distinct()
