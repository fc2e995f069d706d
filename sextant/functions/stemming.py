"""Word stems by language: the published suffix rules of English, German, French and Spanish.

Words are in lower case and may have lost their marks already.  A language
that isn't known here is treated as English, as search engines of desktops do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant behind a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes: Iterable[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


# English.

# Irregular words, suffixes and what takes their place.
EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
EN_VOWELS = "aeiouy"


def _short_end(word: str) -> bool:
    """Ends in a short syllable: consonant, vowel, consonant other than w, x, Y; or vowel, consonant alone."""
    if len(word) == 2:
        return word[0] in EN_VOWELS and word[1] not in EN_VOWELS
    return len(word) > 2 and word[-1] not in EN_VOWELS + "wxY" and word[-2] in EN_VOWELS and word[-3] not in EN_VOWELS


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in EN_WORDS:
        return EN_WORDS[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = start if start is not None else _region(w, EN_VOWELS)
    r2 = _region(w, EN_VOWELS, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in EN_KEPT:
        return w
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EN_VOWELS:
        w = w[:-1] + "i"
    s = _longest(w, EN_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[-4] == "l") and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + EN_2[s]
    s = _longest(w, EN_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + EN_3[s]
    s = _longest(w, EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


# German.

DE_VOWELS = "aeiouyäöü"


def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = re.sub(rf"(?<=[{DE_VOWELS}])u(?=[{DE_VOWELS}])", "U", w)
    w = re.sub(rf"(?<=[{DE_VOWELS}])y(?=[{DE_VOWELS}])", "Y", w)
    first = _region(w, DE_VOWELS)
    r1, r2 = max(first, 3), _region(w, DE_VOWELS, first)
    s = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or re.search("[bdfghklmnrt]s$", w)):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or (len(w) >= 6 and re.search("[bdfghklmnt]st$", w))):
        w = w[: -len(s)]
    s = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        rest = w[: -len(s)]
        if s in ("end", "ung"):
            w = rest[:-2] if rest.endswith("ig") and not rest.endswith("eig") and len(rest) - 2 >= r2 else rest
        elif s in ("ig", "ik", "isch"):
            w = w if rest.endswith("e") else rest
        elif s in ("lich", "heit"):
            w = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= r1 else rest
        else:
            t = _longest(rest, ("lich", "ig"))
            w = rest[: -len(t)] if t and len(rest) - len(t) >= r2 else rest
    return w.lower().translate(str.maketrans("äöü", "aou"))


# Spanish.

ES_VOWELS = "aeiouáéíóúü"
ACUTE = str.maketrans("áéíóú", "aeiou")
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron "
    "ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
ES_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
ES_INTO = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_MORE = "amente mente idad idades iva ivo ivas ivos".split()


def spanish(word: str) -> str:
    w = word
    if len(w) < 2 or (w[1] not in ES_VOWELS):
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in ES_VOWELS), len(w))
    elif w[0] in ES_VOWELS:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in ES_VOWELS), len(w))
    else:
        rv = min(3, len(w))
    r1 = _region(w, ES_VOWELS)
    r2 = _region(w, ES_VOWELS, r1)
    cut = lambda s, r: len(w) - len(s) >= r
    s = _longest(w, ES_PRONOUNS)
    if s:
        rest = w[: -len(s)]
        t = _longest(rest, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if t and len(rest) - len(t) >= rv and (t != "yendo" or rest.endswith("uyendo")):
            w = rest[: -len(t)] + t.translate(ACUTE)
    before = w
    s = _longest(w, [*ES_PLAIN, *ES_IC, *ES_INTO, *ES_MORE])
    if s and cut(s, r1 if s == "amente" else r2):
        w = w[: -len(s)] + ES_INTO.get(s, "")
        strip: tuple[str, ...] = ()
        if s in ES_IC:
            strip = ("ic",)
        elif s == "amente":
            strip = ("iv", "os", "ic", "ad")
        elif s == "mente":
            strip = ("ante", "able", "ible")
        elif s in ("idad", "idades"):
            strip = ("abil", "ic", "iv")
        elif s in ("iva", "ivo", "ivas", "ivos"):
            strip = ("at",)
        t = _longest(w, strip)
        if t and cut(t, r2):
            w = w[: -len(t)]
            if s == "amente" and t == "iv" and w.endswith("at") and cut("at", r2):
                w = w[:-2]
    if w == before:
        s = _longest(w, ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos"))
        if s and cut(s, rv) and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            # The longest within the region counts.
            s = _longest(w[rv:], [*ES_VERBS, "en", "es", "éis", "emos"])
            if s:
                w = w[: -len(s)]
                if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    s = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(ACUTE)


# French.

FR_VOWELS = "aeiouyâàëéêèïîôûù"
FR_I = "îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_ATE = "atrice ateur ation atrices ateurs ations".split()
FR_INTO = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_REST = "ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()


def french(word: str) -> str:
    w = re.sub(r"qu", "qU", word)
    w = re.sub(rf"(?<=[{FR_VOWELS}])u(?=[{FR_VOWELS}])", "U", w)
    w = re.sub(rf"(?<=[{FR_VOWELS}])i(?=[{FR_VOWELS}])", "I", w)
    w = re.sub(rf"(?<=[{FR_VOWELS}])y|y(?=[{FR_VOWELS}])", "Y", w)
    if w.startswith(("par", "col", "tap")) or (len(w) > 2 and w[0] in FR_VOWELS and w[1] in FR_VOWELS):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in FR_VOWELS), len(w))
    r1 = _region(w, FR_VOWELS)
    r2 = _region(w, FR_VOWELS, r1)
    start, verbs = w, True

    def ends(s: str, r: int) -> bool:
        return w.endswith(s) and len(w) - len(s) >= r

    def change(s: str, new: str = "") -> None:
        nonlocal w
        w = w[: -len(s)] + new

    s = _longest(w, [*FR_PLAIN, *FR_ATE, *FR_INTO, *FR_REST])
    if s in FR_PLAIN and ends(s, r2):
        change(s)
    elif s in FR_ATE and ends(s, r2):
        change(s)
        if w.endswith("ic"):
            change("ic", "" if ends("ic", r2) else "iqU")
    elif s in FR_INTO and ends(s, r2):
        change(s, FR_INTO[s])
    elif s in ("ement", "ements") and ends(s, rv):
        change(s)
        if w.endswith("iv"):
            if ends("iv", r2):
                change("iv")
                if ends("at", r2):
                    change("at")
        elif w.endswith("eus"):
            if ends("eus", r2):
                change("eus")
            elif ends("eus", r1):
                change("eus", "eux")
        elif w.endswith(("abl", "iqU")):
            if ends(w[-3:], r2):
                change(w[-3:])
        elif w.endswith(("ièr", "Ièr")) and ends(w[-3:], rv):
            change(w[-3:], "i")
    elif s in ("ité", "ités") and ends(s, r2):
        change(s)
        if w.endswith("abil"):
            change("abil", "" if ends("abil", r2) else "abl")
        elif w.endswith("ic"):
            change("ic", "" if ends("ic", r2) else "iqU")
        elif ends("iv", r2):
            change("iv")
    elif s in ("if", "ive", "ifs", "ives") and ends(s, r2):
        change(s)
        if ends("at", r2):
            change("at")
            if w.endswith("ic"):
                change("ic", "" if ends("ic", r2) else "iqU")
    elif s == "eaux":
        change(s, "eau")
    elif s == "aux" and ends(s, r1):
        change(s, "al")
    elif s in ("euse", "euses"):
        if ends(s, r2):
            change(s)
        elif ends(s, r1):
            change(s, "eux")
    elif s in ("issement", "issements") and ends(s, r1) and w[-len(s) - 1 : -len(s)] not in FR_VOWELS:
        change(s)
    elif s in ("amment", "emment") and ends(s, rv):
        change(s, s[0] + "nt" if s[0] == "a" else "ent")
    elif s in ("ment", "ments") and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] in FR_VOWELS:
        change(s)
    if w != start and s not in ("amment", "emment", "ment", "ments"):
        verbs = False
    if verbs:
        s = _longest(w[rv:], FR_I)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in FR_VOWELS:
            change(s)
        else:
            s = _longest(w[rv:], ["ions", *FR_E, *FR_A])
            if s == "ions":
                if ends(s, r2):
                    change(s)
            elif s:
                change(s)
                if s in FR_A and ends("e", rv):
                    change("e")
    if w != start:
        w = w[:-1] + {"Y": "i", "ç": "c"}.get(w[-1:], w[-1:])
    else:
        if re.search(r"[^aiouès]s$", w):
            w = w[:-1]
        s = _longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if s == "ion":
            if ends(s, r2) and len(w) - 4 >= rv and w[-4] in "st":
                change(s)
        elif s:
            change(s, "" if s == "e" else "i")
    w = re.sub(r"(enn|onn|ett|ell|eill)$", lambda m: m[0][:-1], w)
    w = re.sub(rf"[éè]([^{FR_VOWELS}]+)$", r"e\1", w)
    return w.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "de": german, "fr": french, "es": spanish}


@lru_cache(1 << 17)
def stem(word: str, language: str | None = "en") -> str:
    """The stem of a word in lower case; a language without rules here is treated as English."""
    return STEMMERS.get(language or "en", english)(word)


def is_number(word: str) -> bool:
    return word.isdecimal()


def stems_of(words: Column, language: Column, ignore_numbers: bool = False) -> Column:
    """The stems of an array of words; each worker remembers the words it has seen."""
    @F.pandas_udf("array<string>")
    def each(lists: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if ws is None else [stem(w, lang) for w in ws if not (ignore_numbers and is_number(w))] for ws, lang in zip(lists, languages, strict=True)])

    return each(words, language)
