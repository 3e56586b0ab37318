"""Problem 6: text that was decoded with the wrong character encoding.

Method. For each decoder that may have been used wrongly, every character of a text is mapped back to the bytes that
this decoder reads as that character. A byte-structure automaton (the regular languages UTF8, EUC and SJIS below) finds
the maximal well-formed multibyte spans in those bytes; only those spans are decoded, everything else stays. Text that
was decoded wrongly several times is restored layer by layer, until no span is left.

Legacy bytes that were read as Latin fit several true encodings. All of LEGACY are held against each other by how much of
the decoded text is what running text in that language is full of; where no one stands out the text is garbled but 'lost'
and stays as it is, unless the caller knows the language. Cyrillic that was read in another Cyrillic encoding is told by
the letters and by capitals inside words.

Plan: one pass, no shuffle. A batch is looked at as one array of characters: for each decoder the bytes come from a table,
and the units of its automata are found by comparing shifted arrays. Only a text with enough units of some chain is looked
at by that chain's automaton; distinct texts of a batch are judged once.

Defined results: a null or empty text is clean. Text with U+FFFD, or with spans that are cut off (bytes were dropped), is
garbled but only partly restorable. Texts of any length are handled in one pass over their characters.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UTF8 = rb"(?:[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})"
UTF8_WIDE = rb"(?:\xE2[\x80-\xBF]{2}|\xE3[\x80-\xBF]{2}|[\xE4-\xEC\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xE0[\xB8-\xB9][\x80-\xBF])"
UTF8_LATIN = rb"(?:\xC3[\x80-\xBF]|\xC5[\x92\x93]|\xE2\x80[\x98-\x9D])"
UTF8_CYRILLIC = rb"(?:[\xD0\xD1][\x80-\xBF])"
EUC = rb"(?:[\xA1-\xA5\xB0-\xF4][\xA1-\xFE])"
SJIS = rb"(?:[\x81-\x83\x88-\x9F\xE0-\xEA][\x40-\x7E\x80-\xFC])"
#: What wrongly decoded text was meant to be: letters, kana, kanji, syllables and marks of running text.
PLAUSIBLE = re.compile(r"[ -~¡-ÿŒœЁА-яёก-๛‐-…※€←-↓■-●★☆　-ヿ一-鿿가-힣！-ﾟ]*\Z")
KANA = re.compile(r"[ぁ-ヾ]")
ESCAPED = re.compile(r"(?:\\x[0-9A-Fa-f]{2}[@-\[\]-~]?){2,}")
#: Shift state of the seven-bit encoding whose escape characters were dropped: both marks must be there.
SHIFTED = re.compile(r"\$[B@]((?:[!-~]{2})+?)\([BJ]")
_WIDE_AFTER = re.compile(r"[぀-ヿ一-鿿가-힣！-ﾟ]")
#: A lead of three bytes that lacks its last byte: bytes were dropped.
CUT = re.compile(rb"[\xE2-\xEF][\x80-\xBF](?![\x80-\xBF])")


@lru_cache(None)
def reader(name: str) -> dict[str, bytes]:
    """character -> the bytes that decoder reads as it. Built by rule from the installed codec."""
    if name == "latin":
        table = {chr(b): bytes([b]) for b in range(0x80, 0x100)}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode("cp1252")] = bytes([b])
            except UnicodeDecodeError:
                pass
        return table
    if name in ("koi8_r", "cp1251", "cp866", "cp437", "mac_roman"):
        table = {}
        for b in range(0x80, 0x100):
            try:
                table[bytes([b]).decode(name)] = bytes([b])
            except UnicodeDecodeError:
                pass
        if name != "cp437":
            table |= {chr(b): bytes([b]) for b in range(0x80, 0xA0) if chr(b) not in table}
        return table
    table = {}
    for a in range(0x80, 0x100):
        try:
            table.setdefault(bytes([a]).decode(name), bytes([a]))
        except UnicodeDecodeError:
            pass
        for b in range(0x40, 0x100):
            try:
                c = bytes([a, b]).decode(name)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                table.setdefault(c, bytes([a, b]))
    if name == "cp932":
        table |= {chr(0x80): b"\x80"}
    return {c: b for c, b in table.items() if len(c) == 1}


#: (wrong decoder, automaton, true encoding, characters a span may hold, least characters of a span)
CHAINS = (
    ("latin", UTF8, "utf-8", 1),
    ("koi8_r", UTF8, "utf-8", 2),
    ("cp1251", UTF8, "utf-8", 2),
    ("cp866", UTF8, "utf-8", 2),
    ("cp437", UTF8, "utf-8", 2),
    ("mac_roman", UTF8, "utf-8", 2),
    ("cp932", UTF8_WIDE, "utf-8", 2),
    ("gbk", UTF8_WIDE, "utf-8", 2),
    ("euc_jp", UTF8_WIDE, "utf-8", 2),
    ("big5", UTF8_WIDE, "utf-8", 2),
    ("euc_kr", UTF8_WIDE, "utf-8", 2),
    *((dec, UTF8_LATIN, "utf-8", 1) for dec in ("cp932", "gbk", "euc_jp", "big5", "euc_kr")),
    *((dec, UTF8_CYRILLIC, "utf-8", 4) for dec in ("cp932", "gbk", "euc_jp", "big5")),
    ("latin", EUC, "euc_jp", 2),
    ("cp932", EUC, "euc_jp", 2),
    ("latin", SJIS, "cp932", 2),
)


@lru_cache(None)
def compiled():
    out = []
    for dec, auto, enc, least in CHAINS:
        table = reader(dec)
        if auto is EUC and dec == "cp932":  # legacy two-byte pairs read as half-width kana and rare kanji
            table = {c: b for c, b in table.items() if b[0] >= 0xA1 and (len(b) == 1 or b[0] >= 0xE0)}
        if auto is SJIS:
            table = table | {chr(b): bytes([b]) for b in range(0x40, 0x7F)}
        cls = "[" + "".join(re.escape(c) for c in table) + "]"
        # a run of characters this decoder can have made; for three-byte text read in pairs, of the lead bytes it needs
        out.append((dec, auto, enc, least, table, re.compile(cls + ("+" if auto is UTF8_LATIN else "{2,}")), re.compile(rb"(?:" + auto + rb")+")))
    return out


def _accept(dec: str, enc: str, auto: bytes, least: int, text: str, source: str) -> bool:
    if text == source:
        return False
    if dec == "latin" and enc == "utf-8" and all(c in reader("latin") or c < "\x80" for c in text):
        return True  # Latin text, or an inner layer of text that was decoded wrongly twice
    if not PLAUSIBLE.match(text):
        return False
    n = len(text)
    if dec == "latin" and enc == "utf-8":
        return True
    if auto is UTF8_LATIN:
        # accented letters inside words of plain ones: what the run holds is all of it
        return True
    if n < least:
        return any("─" <= c <= "▟" for c in source) and dec in ("koi8_r", "cp866", "cp437")
    kana = len(KANA.findall(text))
    if enc == "euc_jp":
        if dec == "cp932":
            if kana >= 2 and kana * 10 >= 3 * n:
                return True
            return n >= 2 and _broken_halfwidth(source) and all("一" <= c <= "鿿" or "、" <= c <= "ヾ" or "！" <= c <= "～" for c in text)
        return n >= 2 and all(c > "　" or "‐" <= c <= "…" for c in text)
    if enc == "cp932":
        return kana >= 1 or n >= 3 or all("＀" < c or c > "一" for c in text)
    # three-byte text read in pairs: rare kanji may fall into place by chance, kana or several characters in a row do not
    return kana >= 1 or (n >= 3 and len(set(text)) >= 2) or dec in ("koi8_r", "cp1251", "cp866", "cp437", "mac_roman")


def _broken_halfwidth(s: str) -> bool:
    """Half-width kana that no one would write: marks without a letter that takes them, or punctuation inside."""
    s = s.strip("､｡･｢｣")
    if re.search(r"[一-鿿\ue000-\uf8ff]", s) and re.search(r"[ｦ-ﾟ]", s):
        return True
    if re.search(r"(?:^|[^ｳｶ-ﾄﾊ-ﾎ])[ﾞﾟ]|[ﾀ-ﾄｶ-ｿ]ﾟ", s):
        return True
    return bool(re.search(r"^[ｧ-ｰﾝ]|[｡-･]|[ｧ-ｯ]{2}|ｰｰ", s))


#: True encodings of legacy bytes read as Latin: (codec, units, language, what its running text is full of). The last are
#: fixed values: kana for Japanese; frequent characters of the other languages.
LEGACY = (
    ("euc_jp", rb"(?:[\xA1-\xA8\xB0-\xF4][\xA1-\xFE])+", "ja", "[ぁ-ゖァ-ヴーＡ-Ｚａ-ｚ０-９]"),
    ("cp932", rb"(?:[\x81-\x83\x88-\x9F\xE0-\xEA][\x40-\x7E\x80-\xFC])+", "ja", "[ぁ-ゖァ-ヴーＡ-Ｚａ-ｚ０-９]"),
    ("gbk", rb"(?:[\xA1-\xA3\xB0-\xF7][\xA1-\xFE])+", "zh", "[的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里]"),
    ("big5", rb"(?:[\xA1-\xC6\xC9-\xF9][\x40-\x7E\xA1-\xFE])+", "zh", "[的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡]"),
    ("euc_kr", rb"(?:[\xA1-\xA3\xB0-\xC8][\xA1-\xFE])+", "ko", "[이다는에을의가고하은지로한사도를기어나서자리시대인아그있었해것]"),
    ("cp1251", rb"[\xA8\xB8\xC0-\xFF]+", "ru", "[оеаинтсрвлОЕАИНТСРВЛ]"),
    ("koi8_r", rb"[\xA3\xB3\xC0-\xFF]+", "ru", "[оеаинтсрвлОЕАИНТСРВЛ]"),
    ("cp874", rb"[\xA1-\xDA\xDF-\xFB]+", "th", "[านรอกเงมยลวดทสตะ่้ี]"),
)
#: Share of such characters in running text, by language; what an encoding reaches of it is its evidence, of which so much is
#: asked for: more where one byte is one character, as almost any bytes are letters there.
_USUAL = {"ja": 0.3, "zh": 0.2, "ko": 0.2, "ru": 0.6, "th": 0.5}
_ENOUGH = {"ja": 0.35, "zh": 0.35, "ko": 0.35, "ru": 0.8, "th": 0.8}
_SCRIPT = {"ja": r"[　-ヿ一-鿿！-ﾟ]", "zh": r"[　-〿一-鿿！-～]", "ko": r"[　-〿가-힣！-～]", "ru": r"[А-Яа-яЁё]", "th": r"[ก-๛]"}
_HIGH_RUN = re.compile("[\u00a1-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u20ac\u201a\u201e\u2026\u2020\u2021\u02c6\u2030\u2039\u2018-\u201d\u2022\u2013\u2014\u02dc\u2122\u203a\x80-\x9f]{4,}")


@lru_cache(None)
def _legacy():
    return [(codec, re.compile(units), lang, re.compile(full), re.compile(_SCRIPT[lang])) for codec, units, lang, full in LEGACY]


def legacy_spans(s: str, language: str | None = None) -> tuple[str | None, list[tuple[int, int, str]]]:
    """(codec, its spans as (start, end, text)) for legacy bytes read as Latin; codec 'lost' if several fit, None if none does.

    Evidence is the share of characters that the language's running text is full of, over what is usual there. If the
    `language` is known, only its encodings are held against each other.
    """
    table = reader("latin")
    data = b"".join(table.get(c) or (c.encode() if c < "\x80" else b"\x00") for c in s)  # one byte for each character
    high = np.frombuffer(data, dtype=np.uint8) >= 0x80
    rated = []
    for codec, units, lang, full, script in _legacy():
        spans, text, covered = [], [], 0
        for m in units.finditer(data):
            try:
                t = m.group().decode(codec)
            except UnicodeDecodeError:
                break
            spans.append((m.start(), m.end(), t))
            text.append(t)
            covered += int(high[m.start() : m.end()].sum())
        else:
            t = "".join(text)
            if t and covered >= 0.95 * high.sum() and len(script.findall(t)) >= 0.95 * len(t):
                n = len(full.findall(t))
                rated.append((n / len(t) / _USUAL[lang] if lang == "ja" or (n > 1 and len(t) > 3) else 0.0, codec, lang, spans, len(t)))
    own = [r for r in rated if r[2] == language]
    rated = sorted(own or rated, key=lambda r: -r[0])
    if not rated:
        return None, []
    best = rated[0]
    rival = max((r[0] for r in rated[1:] if r[3] != best[3]), default=0.0)
    if own or (best[0] >= _ENOUGH[best[2]] and best[4] >= 2 and best[0] >= 1.5 * rival):
        return best[1], best[3]
    return "lost", []


_CYRILLIC = re.compile("[\u0401\u0410-\u044f\u0451]+")
_CAPITALS = re.compile("[\u0401\u0410-\u042f]{5,}|[\u0430-\u044f\u0451][\u0401\u0410-\u042f]{3,}")
_OFTEN = re.compile("[оеаинтсрвл]")


def cyrillic_spans(s: str) -> list[tuple[int, int, str]]:
    """Spans of Cyrillic that were read in another Cyrillic encoding, decoded: small letters were read as capitals there."""
    if not _CAPITALS.search(s):
        return []
    runs = [m for m in _CYRILLIC.finditer(s)]
    text = "".join(m.group() for m in runs)
    share = lambda t: len(_OFTEN.findall(t.lower())) / max(1, len(t))
    if len(text) < 6 or sum(c.isupper() for c in text) * 2 < len(text) or share(text) > 0.4:
        return []
    best: tuple[float, list] = (0.5, [])
    for wrong, true in (("cp1251", "koi8_r"), ("koi8_r", "cp1251")):
        try:
            spans = [(m.start(), m.end(), m.group().encode(wrong).decode(true)) for m in runs]
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        t = "".join(x[2] for x in spans)
        if share(t) > best[0] and sum(c.islower() for c in t) * 2 > len(t):
            best = (share(t), spans)
    return best[1]


def _chain_spans(s: str, chains) -> tuple[list[tuple[int, int, str, int]], dict[int, int], bool]:
    """(spans of the given chains as (start, end, text, chain), characters each chain covers, whether bytes are missing)."""
    found, cut, covered = [], False, {}
    for k in chains:
        dec, auto, enc, least, table, run, spans = compiled()[k]
        for m in run.finditer(s):
            chars = m.group()
            pieces = [table[c] for c in chars]
            data = b"".join(pieces)
            if auto is UTF8_LATIN and not (spans.fullmatch(data) and s[m.start() - 1 : m.start()].isascii() and s[m.start() - 1 : m.start()].islower() and not _WIDE_AFTER.match(s, m.end())):
                continue
            if auto in (UTF8, UTF8_WIDE) and not re.search(rb"[\xC2-\xF4][\x80-\xBF]", data):
                continue
            starts, at = {}, 0
            for i, p in enumerate(pieces):
                starts[at] = i
                at += len(p)
            starts[at] = len(pieces)
            seen = 0
            for x in spans.finditer(data):
                # keep to the longest part whose ends fall between characters
                a, b = x.span()
                while a < b and a not in starts:
                    a += 1
                while b > a and b not in starts:
                    b -= 1
                whole = x.group().decode(enc, "ignore")
                text = data[a:b].decode(enc, "ignore")
                source = chars[starts[a] : starts[b]] if b > a else ""
                if _accept(dec, enc, auto, least, whole, source):
                    seen += 1
                    if b > a and text:
                        found.append((m.start() + starts[a], m.start() + starts[b], text, k))
                        covered[k] = covered.get(k, 0) + starts[b] - starts[a]
                    cut = cut or (b - a) != len(x.group())
            if dec == "latin" and auto is UTF8:
                lost = len(CUT.findall(data))
                if lost and (seen or lost >= 2) and len(chars) >= 3:
                    cut = True
                    seen += 1
    return found, covered, cut


def _layer(s: str, chains=None, language: str | None = None, broken: bool = False) -> tuple[str, int, bool]:
    """One layer: (text with its spans decoded, spans found, whether bytes are missing or their meaning is not clear).

    broken: an earlier layer lacked bytes, so what is left of it is no legacy encoding.
    """
    found, covered, cut = _chain_spans(s, range(len(CHAINS)) if chains is None else chains)
    as_latin = {k for k, c in enumerate(CHAINS) if c[0] == "latin" and c[1] in (EUC, SJIS)}
    legacy, others = [f for f in found if f[3] in as_latin], [f for f in found if f[3] not in as_latin]
    # single characters of legacy bytes may look like UTF-8: that counts only if it explains half of what is no plain letter
    accident = all(f[3] == 0 for f in others) and 2 * covered.get(0, 0) < sum("\x80" <= c < "\u2200" for c in s)
    if not broken and (not others or accident) and (legacy or _HIGH_RUN.search(s)):
        codec, spans = legacy_spans(s, language or ("ja" if KANA.search(s) else None))
        sure = codec not in (None, "lost") and (legacy or sum(len(t) for _, _, t in spans) >= 4 and codec not in ("cp932", "big5"))
        if sure:
            found = [(a, b, t, len(CHAINS)) for a, b, t in spans]
            covered[len(CHAINS)] = sum(b - a for a, b, _ in spans)
            at = np.zeros(len(s), dtype=bool)
            for a, b, _ in spans:
                at[a:b] = True
            cut = any("\x80" <= s[i] < "\u0100" for i in np.flatnonzero(~at).tolist())  # bytes that are in no span
        elif legacy and codec == "lost":
            found, cut = others, True
    if not found:
        found = [(a, b, t, len(CHAINS)) for a, b, t in cyrillic_spans(s)]
        covered[len(CHAINS)] = 1
    # the chain that explains most of the text goes first; well-formed UTF-8 in single bytes is no accident
    found.sort(key=lambda t: (t[3] != 0, -covered[t[3]], t[3], -(t[1] - t[0]), t[0]))
    taken = _apart(found)
    out, at = [], 0
    for a, b, text, _ in taken:
        out += [s[at:a], text]
        at = b
    return "".join([*out, s[at:]]), len(taken), cut


def _apart(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Spans in their order of preference that do not overlap, sorted by place. Taken ones are kept sorted: no pair is compared twice."""
    starts: list[int] = []
    taken: list[tuple[int, int, str, int]] = []
    for f in found:
        i = bisect.bisect_left(starts, f[0])
        if (i == len(taken) or f[1] <= taken[i][0]) and (i == 0 or taken[i - 1][1] <= f[0]):
            starts.insert(i, f[0])
            taken.insert(i, f)
    return taken


def _shifted(m: re.Match) -> str:
    try:
        return ("\x1b$B" + m.group(1) + "\x1b(B").encode("ascii").decode("iso2022_jp")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m.group()


def _escaped(m: re.Match) -> str:
    data = b"".join(bytes([int(x[:2], 16)]) + x[2:].encode() for x in m.group().split("\\x")[1:])
    if sum(b >= 0x80 for b in data) < 2:
        return m.group()
    for enc in ("utf-8", "euc_jp", "cp932"):
        try:
            text = data.decode(enc)
        except UnicodeDecodeError:
            continue
        if PLAUSIBLE.match(text) and len(text) >= 1:
            return text
    return m.group()


def repair(s: str | None, language: str | None = None, chains=None) -> tuple[str | None, str]:
    """(restored text, state): state is 'clean', 'restored', 'partly' or 'lost'.

    language: what the text is written in, if known. chains: those that can apply at the first layer (all if None).
    """
    if not s:
        return s, "clean"
    if s.isascii() and "$" not in s and "\\x" not in s:
        return s, "clean"
    text, missing = SHIFTED.sub(_shifted, s), "\ufffd" in s
    text = ESCAPED.sub(_escaped, text)
    if text != s:
        chains = None
    seen, broken = set(), False
    while text not in seen:  # each layer but a few makes the text shorter; one that comes again ends it
        seen.add(text)
        fixed, n, cut = _layer(text, chains, language, broken)
        missing, broken, chains = missing or cut, broken or cut, None
        if not n:
            break
        text = fixed
    if text == s:
        return s, "lost" if missing else "clean"
    return text, "partly" if missing or "\ufffd" in text else "restored"


@lru_cache(None)
def _byte_tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """decoder -> (first byte, second byte) of every character below U+10000; 0 where there is none."""
    out = {}
    for dec in {c[0] for c in CHAINS}:
        a, b = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
        for c, data in reader(dec).items():
            if ord(c) < 1 << 16:
                a[ord(c)], b[ord(c)] = data[0], data[1] if len(data) > 1 else 0
        out[dec] = (a, b)
    return out


def _in(x: np.ndarray, *ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    for lo, hi in ranges:
        out |= (x >= lo) & (x <= hi)
    return out


def _times(unit: np.ndarray, step: int, times: int) -> np.ndarray:
    """Where a unit of `step` bytes starts that is followed by times - 1 more."""
    out = unit.copy()
    for k in range(1, times):
        out[: max(0, len(unit) - k * step)] &= unit[k * step :]
        out[max(0, len(unit) - k * step) :] = False
    return out


def possible_chains(texts: list[str]) -> list[list[int]]:
    """For each text the chains of which it holds enough units; no other chain can find a span in it."""
    out: list[list[int]] = [[] for _ in texts]
    code = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return out
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    small = np.where(code < 1 << 16, code, 0).astype(np.uint16)
    lower = (code >= 97) & (code <= 122)
    for dec, (first, second) in _byte_tables().items():
        a, b = first[small], second[small]
        known = a > 0
        if not known.any():
            continue
        size = 1 + (b > 0)
        at = np.cumsum(size) - size
        data = np.zeros(int(size.sum()) + 8, dtype=np.uint8)
        data[at] = np.where((code >= 0x40) & (code < 0x7F), code, a)  # plain letters may be second bytes
        data[(at + 1)[b > 0]] = b[b > 0]
        n = len(data) - 8
        x, y, z = data[:n], data[1 : n + 1], data[2 : n + 2]
        rest = (y >= 0x80) & (y <= 0xBF)
        lead2, lead3 = _in(x, (0xC2, 0xDF)) & rest, _in(x, (0xE0, 0xF4)) & rest
        three = lead3 & (z >= 0x80) & (z <= 0xBF)
        hits: dict[int, np.ndarray] = {}
        for k, (own, auto, _, least) in enumerate(CHAINS):
            if own != dec:
                continue
            if auto is UTF8:
                hits[k] = lead2 | lead3  # also what is cut off
            elif auto is UTF8_WIDE:
                kana = (x == 0xE3) & (y >= 0x81) & (y <= 0x83) & three
                # without kana three characters in a row are asked for, two of its own in single bytes
                hits[k] = kana | _times(three, 3, 3)
            elif auto is UTF8_LATIN:
                one = ((x == 0xC3) & rest) | ((x == 0xC5) & ((y == 0x92) | (y == 0x93))) | ((x == 0xE2) & (y == 0x80) & (z >= 0x98) & (z <= 0x9D))
                after = np.zeros(n, dtype=bool)
                after[at[1:][lower[:-1]]] = True
                hits[k] = one & after
            elif auto is UTF8_CYRILLIC:
                hits[k] = _times(_in(x, (0xD0, 0xD1)) & rest, 2, 4)
            elif auto is EUC:
                hits[k] = _times(_in(x, (0xA1, 0xA5), (0xB0, 0xF4)) & (y >= 0xA1), 2, 2)
            else:
                hits[k] = _times(_in(x, (0x81, 0x83), (0x88, 0x9F), (0xE0, 0xEA)) & (y >= 0x40) & (y != 0x7F), 2, 2)
        for k, hit in hits.items():
            where = np.flatnonzero(hit)
            if len(where):
                char = np.searchsorted(at, where, side="right") - 1
                for t in common.distinct(np.searchsorted(starts, char, side="right") - 1).tolist():
                    out[t].append(k)
    return [sorted(x) for x in out]


#: What makes a text worth a look besides the chains' units.
_OTHER_SIGNS = re.compile("\ufffd|\\$[B@]|\\\\x|" + _HIGH_RUN.pattern + "|" + _CAPITALS.pattern)


def repair_all(texts: list[str | None], language: str | None = None) -> list[tuple[str | None, str]]:
    """repair() of every text; distinct texts are judged once, in blocks that bound memory."""
    distinct = [t for t in dict.fromkeys(texts) if t]
    done: dict[str | None, tuple[str | None, str]] = {None: (None, "clean"), "": ("", "clean")}
    at = 0
    while at < len(distinct):
        end, size = at, 0
        while end < len(distinct) and (end == at or size + len(distinct[end]) < 500_000):
            size += len(distinct[end])
            end += 1
        block = distinct[at:end]
        for t, chains in zip(block, possible_chains(block)):
            done[t] = repair(t, language, chains) if chains or _OTHER_SIGNS.search(t) else (t, "clean")
        at = end
    return [done[t] for t in texts]


_RESULT = T.StructType([T.StructField("restored", T.StringType()), T.StructField("state", T.StringType())])


@F.pandas_udf(_RESULT)
def repair_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(repair_all([None if x is None else x for x in s]), columns=["restored", "state"])


@F.pandas_udf(_RESULT)
def repair_japanese_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(repair_all([None if x is None else x for x in s], "ja"), columns=["restored", "state"])


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of df whose text is garbled: (key, text, restored, state). One pass, no shuffle."""
    got = df.select(F.col(key).alias("row_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]|\$[B@]|\\x")).withColumn("r", repair_udf("text"))
    return got.where("r.state <> 'clean'").select("row_id", "text", "r.restored", "r.state")


def fields(spark, sf_dir: str) -> DataFrame:
    """All texts that problem 6 names: (tbl, row_id, field, text)."""
    d = common.read(spark, sf_dir, "dictionary")
    s = common.read(spark, sf_dir, "sentences")
    midasi = d.select(F.lit("dictionary").alias("tbl"), F.col("entry_id").alias("row_id"), F.lit("midasi").alias("field"), F.explode(F.map_keys("midasi")).alias("text"))
    yomi = d.select(F.lit("dictionary").alias("tbl"), F.col("entry_id").alias("row_id"), F.lit("yomi").alias("field"), F.col("yomi").alias("text"))
    raw = s.select(F.lit("sentences").alias("tbl"), F.col("row_id"), F.lit("raw").alias("field"), F.col("raw").alias("text"))
    return midasi.unionByName(yomi).unionByName(raw)


def p6_restored(spark, sf_dir: str) -> DataFrame:
    """Every affected field with its restored text and how far it could be restored. The dictionary is known to be Japanese."""
    t = fields(spark, sf_dir).where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]|\$[B@]|\\x"))
    own = t.where("tbl = 'dictionary'").withColumn("r", repair_japanese_udf("text"))
    got = own.unionByName(t.where("tbl <> 'dictionary'").withColumn("r", repair_udf("text")))
    return got.where("r.state <> 'clean'").select("tbl", "row_id", "field", "text", "r.restored", "r.state")


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("tbl", "row_id", "field").distinct()
