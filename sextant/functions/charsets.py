"""The charset of bytes: validity first, then how well the decoded letters fit a language.

A byte order mark or valid UTF-8 decides at once.  UTF-16 without a mark shows
in where its zero bytes stand, or in decoding to letters of one script.  Every
other charset that can decode the bytes is scored by its text: each letter
beyond ASCII costs its surprise in the language that explains the text best,
and each pair of neighbours that no orthography has (a small letter before a
capital one, two scripts in a word, a symbol within one) costs more.
"""

from __future__ import annotations

import codecs
import math
import unicodedata
from collections import Counter
from functools import cache, lru_cache

# Letters beyond ASCII of each language, the frequent ones first.
LANGUAGES = {
    "de": "üäößÜÄÖ", "fr": "éèàêçâîôûùïëœÉÈÀÇÊ", "es": "óíáéñúüÍÓÁÉÑÚ", "pt": "ãçáéõíóêâúôàÃÇÁÉÓ", "it": "àèùòìéÈÀ", "sv": "äåöÄÅÖé", "da": "åøæØÅÆé", "is": "ðáíöéúóæþýÞÁÍ", "nl": "ëéïèöü",
    "pl": "ąłęóżśćńźŁŻŚĆÓŹ", "cs": "íáéěýřčžšůúťňďóČŘŠŽÚÍ", "hu": "áéőöíóüúűÁÉÖÍÓÜ", "ro": "ăîâşţțșȘÎŞŢ", "hr": "čšžćđŠŽČĆĐ",
    "ru": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъёОЕАИНТСРВЛКМДПУЯЫЬГЗБЧЙХЖШЮЦЩЭФЪЁ", "uk": "оаниівртесклудмпязьбгйчхцїюжшщєфґ’ОАНИІВРТЕСКЛУДМПЯЗБГЙЧХЦЇЮЖШЩЄФҐ",
    "el": "αοιετσνηυρπκμλςωδγχθφβξζψάέήίόύώϊϋΑΟΙΕΤΣΝΗΥΡΠΚΜΛΩΔΓΧΘΦΒΞΖΨΆΈΉΊΌΎΏ",
}
#: Charsets by how often they are met; of equal scores the first wins.
CHARSETS = ("cp1252", "cp932", "gb18030", "cp1251", "koi8_r", "euc_jp", "big5", "euc_kr", "cp1250", "iso8859_2", "cp1253", "iso8859_7", "cp866", "iso8859_5")
#: Bytes that are looked at: the beginning, the middle and the end of longer files.
LOOK = 1 << 16
MULTI = frozenset(("cp932", "gb18030", "euc_jp", "big5", "euc_kr"))

#: Marks of which a text in UTF-16 has one at least.
WIDE_STOPS = frozenset(" \n。，、")

#: Costs, in nats: a letter that a language doesn't have, one of a script it doesn't use, a symbol or control character, a pair of neighbours that doesn't go together, the first of some capital letters.
STRANGE, FOREIGN, SYMBOL, CONTROL, PAIR, CAPITAL = 9.0, 12.0, 11.0, 25.0, 8.0, 1.0


@cache
def _costs(language: str) -> dict[str, float]:
    """Surprise of each letter, small or capital, if its probability falls with its rank."""
    letters = list(dict.fromkeys(LANGUAGES[language].lower()))
    weights = [1 / (k + 2) for k in range(len(letters))]
    small = {c: -math.log(w / sum(weights)) for c, w in zip(letters, weights, strict=True)}
    return {c.upper(): x for c, x in small.items() if len(c.upper()) == 1} | small


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """a: ASCII letter, l, u: small and capital letter, o: other letter, h, k: Chinese and kana, s: symbol, x: control, space: others."""
    if c < "\x80":
        return "a" if c.isalpha() else "x" if c < " " and c not in "\t\n\r\f" else " "
    category = unicodedata.category(c)
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "x"
    if category[0] == "L":
        if "぀" <= c <= "ヿ" or "ｦ" <= c <= "ﾟ":
            return "k"
        if "一" <= c <= "鿿" or "가" <= c <= "힣":
            return "h"
        return {"Ll": "l", "Lu": "u"}.get(category, "o")
    # Typographic marks are as good as spaces, others are symbols.
    return " " if category[0] == "Z" or c in "«»¡¿·" or "\u2010" <= c <= "\u2026" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uff1f" else "s"


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return "LATIN" if c < "\x80" else unicodedata.name(c, "?").split(" ")[0]


@lru_cache(1 << 16)
def _common(c: str, charset: str) -> bool:
    """Whether a Chinese character, or a Korean syllable, is of the part of a national standard that holds the common ones."""
    try:
        lead = c.encode(charset)[0]
    except UnicodeEncodeError:
        return False
    # Lead bytes of the first levels.
    low, high = {"gb18030": (0xB0, 0xD7), "cp932": (0x88, 0x98), "euc_jp": (0xB0, 0xCF), "big5": (0xA4, 0xC6), "euc_kr": (0xB0, 0xC8)}[charset]
    return low <= lead <= high


@lru_cache(1 << 18)
def _pair(last: str, c: str) -> tuple[int, int]:
    """(pairs that don't go together, first capital letters) of a character and the one before it, none at the beginning."""
    if last < "\x80" and c < "\x80":
        return 0, 0
    before, kind = _kind(last) if last else " ", _kind(c)
    capital = int(kind == "u" and before != "u")
    if kind == "u" and (before == "l" or before == "a" and last.islower()):
        return 1, capital
    if kind in "alu" and before in "alu" and _script(c) != _script(last):
        return 1, capital
    return int(before in "luo" and kind == "s" or kind in "luo" and before == "s"), capital


def _letter_cost(far: Counter, charset: str) -> float:
    """Cost of the characters that aren't ASCII by themselves, by the language that fits best."""
    fixed, letters = 0.0, Counter()
    kana = sum(n for c, n in far.items() if _kind(c) == "k")
    for c, n in far.items():
        kind = _kind(c)
        if kind in "luo":
            letters[c] = n
        elif kind == "h":
            # One of some thousand common ones takes two bytes, so it may cost as much as two letters.
            fixed += n * (4.0 if "가" <= c and charset == "euc_kr" and _common(c, charset) else 5.0 if charset in MULTI and _common(c, charset) else 2 * STRANGE if charset in MULTI else FOREIGN)
        elif kind == "k":
            # Kana of half width are hardly ever written; other standards hold kana too.
            fixed += n * (2 * STRANGE if c >= "ｦ" else 3.5 if charset in ("cp932", "euc_jp") else STRANGE)
        else:
            fixed += n * {"x": CONTROL, "s": SYMBOL}.get(kind, 2.0)
    if charset in ("cp932", "euc_jp") and not kana:
        fixed += 3.0 * sum(far.values())  # Japanese isn't written without
    best = 0.0
    if letters:
        rows = [(c, n, _script(c)) for c, n in letters.items()]
        best = min(sum(n * (costs[c] if c in costs else FOREIGN if script != own else STRANGE) for c, n, script in rows) for own, costs in ((_script(LANGUAGES[x][0]), _costs(x)) for x in LANGUAGES))
    return fixed + best


def _pair_cost(text: str) -> float:
    """Cost of the neighbours in a text."""
    pairs = capitals = 0
    for (last, c), n in Counter(zip(text[:-1], text[1:], strict=True)).items():
        if last >= "\x80" or c >= "\x80":
            odd, capital = _pair(last, c)
            pairs, capitals = pairs + n * odd, capitals + n * capital
    odd, capital = _pair("", text[:1])
    return PAIR * (pairs + odd) + CAPITAL * (capitals + capital)


def _sample(data: bytes) -> bytes:
    """Whole lines where there are any, so that no character of several bytes is cut."""
    if len(data) <= LOOK:
        return data
    third, parts = LOOK // 3, []
    for start in (0, len(data) // 2, len(data) - third):
        part = data[start : start + third]
        first = part.find(b"\n") + 1 if start else 0
        parts.append(part[first : part.rfind(b"\n") + 1] or part[first:])
    return b"".join(parts)


def _wide(data: bytes) -> str | None:
    """UTF-16 without a mark, by its zero bytes or by what it decodes to."""
    if len(data) < 4:
        return None
    even, odd = data[0::2].count(0), data[1::2].count(0)
    half = len(data) // 2
    if max(even, odd) > 0.3 * half and min(even, odd) < 0.05 * half:
        return "utf_16_le" if odd > even else "utf_16_be"
    for charset in ("utf_16_le", "utf_16_be"):
        try:
            text = data.decode(charset)
        except UnicodeDecodeError:
            continue
        if not WIDE_STOPS.intersection(text):
            continue
        scripts = Counter("EAST" if _kind(c) in "hk" else _script(c) for c in text if _kind(c) not in " x")
        odd_ones = sum(_kind(c) in "xs" for c in text)
        if scripts and scripts.most_common(1)[0][1] > 0.9 * sum(scripts.values()) and odd_ones < 0.02 * len(text):
            return charset
    return None


def guess(data: bytes) -> tuple[str | None, float]:
    """(charset, confidence between 0 and 1); no charset if there are no bytes or none decodes them."""
    if not data:
        return None, 0.0
    for mark, charset in ((codecs.BOM_UTF8, "utf_8_sig"), (codecs.BOM_UTF16_LE, "utf_16"), (codecs.BOM_UTF16_BE, "utf_16")):
        if data.startswith(mark):
            return charset, 1.0
    some = data[: LOOK + (len(data) & 1)]
    if wide := _wide(some[: len(some) // 2 * 2]):
        return wide, 0.95
    try:
        data.decode("utf_8")
        return "utf_8", 1.0
    except UnicodeDecodeError as e:
        if len(data) - e.start <= 3 and e.end == len(data):
            return "utf_8", 1.0  # cut within its last character
    sample, texts = _sample(data), []
    for rank, charset in enumerate(CHARSETS):
        try:
            text = sample.decode(charset)
        except UnicodeDecodeError as e:
            if charset not in MULTI or len(sample) - e.start > 3:
                continue
            text = sample[: e.start].decode(charset)
        far = Counter({c: n for c, n in Counter(text).items() if c >= "\x80"})
        # A character of two bytes says as much as two of one.
        share = max(1, sum(far.values())) * (2 if charset in MULTI else 1)
        texts.append((_letter_cost(far, charset), share, rank, charset, text))
    costs = []
    # The neighbours only add to a cost, so a charset that is dearer without them than two others with them is out.
    for own, share, rank, charset, text in sorted(texts, key=lambda t: t[0] / t[1]):
        if len(costs) > 1 and own / share > sorted(costs)[1][0]:
            break
        costs.append(((own + _pair_cost(text)) / share, rank, charset))
    if not costs:
        return None, 0.0
    costs.sort()
    return costs[0][2], 1 / (1 + math.exp(costs[0][0] - costs[1][0])) if len(costs) > 1 else 1.0


def decode(data: bytes, fallback: str = "cp1252") -> str | None:
    """The text of bytes of any charset; an unsure guess gives way to ``fallback``."""
    charset, sure = guess(data)
    if charset is None:
        return data.decode(fallback, "replace") if data else None
    return data.decode(charset if sure >= 0.5 else fallback, "replace")
