"""Stems by removing suffixes inside regions of a word: English, French, German, Spanish.

A region starts at a mark: r1 behind the first consonant that follows a vowel, r2 the same
inside r1, rv by a rule of the language. A suffix goes only where it lies in its region.
Words are in lower case. In between, vowels that count as consonants are upper case.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Raised whenever a stem changes: an index of other stems is not searched.
VERSION = 2


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _map(text: str) -> dict[str, str]:
    """suffix=replacement pairs; several suffixes of one replacement are parted by |."""
    out = {}
    for pair in text.split():
        suffixes, new = pair.split("=")
        out |= dict.fromkeys(suffixes.split("|"), new)
    return out


def _mark(word: str, vowels: str, start: int = 0) -> int:
    """Behind the first consonant that follows a vowel, from start on."""
    for i in range(start + 1, len(word)):
        if word[i - 1] in vowels and word[i] not in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes, floor: int = 0) -> str | None:
    """The longest of the suffixes that the word has behind floor."""
    for i in range(floor, len(word)):
        if word[i:] in suffixes:
            return word[i:]
    return None


def _cut(word: str, suffix: str, region: int, new: str = "") -> str | None:
    """The word with the suffix replaced if it has it inside the region, else None."""
    at = len(word) - len(suffix)
    return word[:at] + new if at >= region and word.endswith(suffix) else None


def _any_cut(word: str, region: int, *suffixes: str) -> str:
    """The word without the first of the suffixes that it has, if that lies in the region."""
    for s in suffixes:
        if word.endswith(s):
            return word[: -len(s)] if len(word) - len(s) >= region else word
    return word


# The letter classes, exceptions and suffixes of the English algorithm.
_EN_VOWELS = "aeiouy"
_EN_DOUBLES = _set("bb dd ff gg mm nn pp rr tt")
_EN_LI = "cdeghkmnrt"
_EN_R1 = ("gener", "commun", "arsen")
_EN_WORDS = _map("skis=ski skies=sky dying=die lying=lie tying=tie idly=idl gently=gentl ugly=ugli early=earli only=onli singly=singl sky=sky news=news howe=howe atlas=atlas cosmos=cosmos bias=bias andes=andes")
_EN_KEPT = _set("inning outing canning herring earring proceed exceed succeed")
_EN_2 = _map(
    "tional=tion enci=ence anci=ance abli=able entli=ent izer|ization=ize ational|ation|ator=ate alism|aliti|alli=al "
    "fulness|fulli=ful ousli|ousness=ous iveness|iviti=ive biliti|bli=ble ogi=og lessli=less li="
)
_EN_3 = _map("tional=tion ational=ate alize=al icate|iciti|ical=ic ful|ness|ative=")
_EN_4 = _set("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    v = _EN_VOWELS
    if len(w) == 2:
        return w[0] in v and w[1] not in v
    return len(w) > 2 and w[-1] not in v + "wxY" and w[-2] in v and w[-3] not in v


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EN_WORDS:
        return _EN_WORDS[word]
    v = _EN_VOWELS
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    begin = next((p for p in _EN_R1 if w.startswith(p)), "")
    r1 = len(begin) or _mark(w, v)
    r2 = _mark(w, v, r1)
    vowel = lambda s: any(c in v for c in s)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w
    s = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if s in ("eed", "eedly"):
        w = _cut(w, s, r1, "ee") or w
    elif s and vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in _EN_DOUBLES:
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    s = _longest(w, _EN_2)
    before = w[: -len(s)] if s else ""
    if s and len(before) >= r1 and (s != "ogi" or before.endswith("l")) and (s != "li" or before[-1:] in tuple(_EN_LI)):
        w = before + _EN_2[s]
    s = _longest(w, _EN_3)
    if s:
        w = _cut(w, s, r2 if s == "ative" else r1, _EN_3[s]) or w
    s = _longest(w, _EN_4)
    if s and (s != "ion" or w[:-3].endswith(("s", "t"))):
        w = _cut(w, s, r2) or w
    if w.endswith("e"):
        if len(w) > r2 or (len(w) > r1 and not _short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


# The vowels and suffixes of the French algorithm.
_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_PLAIN = _set("ance iqUe isme able iste eux ances iqUes ismes ables istes")
_FR_AGENT = _set("atrice ateur ation atrices ateurs ations")
_FR_OTHER = _set(
    "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux "
    "euse euses issement issements amment emment ment ments"
)
_FR_1 = _FR_PLAIN | _FR_AGENT | _FR_OTHER
_FR_I_VERBS = _set(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais "
    "issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_E_VERBS = _set("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
_FR_A_VERBS = _set("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_VERBS = _FR_E_VERBS | _FR_A_VERBS | {"ions"}
_FR_LAST = _set("ion ier ière Ier Ière e ë")


def _fr_marked(word: str) -> str:
    """u, i and y between vowels, y beside one and u behind q as consonants."""
    w, v = list(word), _FR_VOWELS
    for p in range(len(w)):
        here = w[p] in v
        after = p + 1 < len(w) and w[p + 1] in v
        if here and p + 1 < len(w):
            if w[p + 1] in "ui" and p + 2 < len(w) and w[p + 2] in v:
                w[p + 1] = w[p + 1].upper()
            elif w[p + 1] == "y":
                w[p + 1] = "Y"
        after = p + 1 < len(w) and w[p + 1] in v
        if w[p] == "y" and after:
            w[p] = "Y"
        elif w[p] == "q" and p + 1 < len(w) and w[p + 1] == "u":
            w[p + 1] = "U"
    return "".join(w)


def _fr_standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word without a standard suffix, and whether that ends the search for one."""
    s = _longest(w, _FR_1)
    if s is None:
        return w, False
    cut = lambda region, new="": _cut(w, s, region, new)
    out: str | None
    if s in _FR_PLAIN:
        out = cut(r2)
    elif s in _FR_AGENT:
        out = cut(r2)
        if out and out.endswith("ic"):
            out = _cut(out, "ic", r2) or out[:-2] + "iqU"
    elif s.startswith("logie"):
        out = cut(r2, "log")
    elif s.startswith(("usion", "ution")):
        out = cut(r2, "u")
    elif s.startswith("ence"):
        out = cut(r2, "ent")
    elif s.startswith("ement"):
        out = cut(rv)
        if out and out.endswith("iv"):
            short = _cut(out, "iv", r2)
            out = _any_cut(short, r2, "at") if short else out
        elif out and out.endswith("eus"):
            out = _cut(out, "eus", r2) or _cut(out, "eus", r1, "eux") or out
        elif out and out.endswith(("abl", "iqU")):
            out = _cut(out, out[-3:], r2) or out
        elif out and out.endswith(("ièr", "Ièr")):
            out = _cut(out, out[-3:], rv, "i") or out
    elif s.startswith("ité"):
        out = cut(r2)
        if out and out.endswith("abil"):
            out = _cut(out, "abil", r2) or out[:-4] + "abl"
        elif out and out.endswith("ic"):
            out = _cut(out, "ic", r2) or out[:-2] + "iqU"
        elif out:
            out = _any_cut(out, r2, "iv")
    elif s in ("if", "ive", "ifs", "ives"):
        out = cut(r2)
        if out and out.endswith("at") and len(out) - 2 >= r2:
            out = out[:-2]
            if out.endswith("ic"):
                out = _cut(out, "ic", r2) or out[:-2] + "iqU"
    elif s == "eaux":
        out = w[:-1]
    elif s == "aux":
        out = cut(r1, "al")
    elif s.startswith("euse"):
        out = cut(r2) if cut(r2) is not None else cut(r1, "eux")
    elif s.startswith("issement"):
        out = cut(r1)
        out = out if out and out[-1] not in _FR_VOWELS else None
    else:  # amment, emment, ment: the verb endings come next
        if s in ("amment", "emment"):
            out = cut(rv, s[0] + "nt")
        else:
            out = cut(rv + 1)
            out = out if out and out[-1] in _FR_VOWELS else None
        return out or w, False
    return (w, False) if out is None else (out, True)


def french(word: str) -> str:
    v = _FR_VOWELS
    w = _fr_marked(word)
    if w[:1] and w[0] in v and w[1:2] and w[1] in v:
        rv = min(3, len(w))
    elif w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))
    r1 = _mark(w, v)
    r2 = _mark(w, v, r1)
    w, done = _fr_standard(w, rv, r1, r2)
    if not done:
        s = _longest(w, _FR_I_VERBS, rv)
        at = len(w) - len(s or "")
        if s and at > rv and w[at - 1] not in v:
            w, done = w[:at], True
    if not done:
        s = _longest(w, _FR_VERBS, rv)
        if s and (s != "ions" or len(w) - 4 >= r2):
            w, done = w[: -len(s)], True
            if s in _FR_A_VERBS:
                w = _any_cut(w, rv, "e")
    if done:
        w = w[:-1] + {"Y": "i", "ç": "c"}[w[-1]] if w[-1:] in ("Y", "ç") else w
    else:
        if len(w) > 1 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        s = _longest(w, _FR_LAST, rv)
        if s == "ion":
            if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                w = w[:-3]
        elif s == "ë":
            w = w[:-1] if w[:-1].endswith("gu") and len(w) - 3 >= rv else w
        elif s:
            w = w[: -len(s)] + ("" if s == "e" else "i")
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    w = re.sub(f"[éè](?=[^{v}]+$)", "e", w)
    return w.lower()


# The letter classes and suffixes of the German algorithm.
_DE_VOWELS = "aeiouyäöü"
_DE_S, _DE_ST = "bdfghklmnrt", "bdfghklmnt"
_DE_1 = _set("em ern er e en es s")
_DE_2 = _set("en er est st")
_DE_3 = _set("end ung ig ik isch lich heit keit")
_DE_UMLAUTS = str.maketrans("äöü", "aou")


def german(word: str) -> str:
    v = _DE_VOWELS
    w = list(word.replace("ß", "ss"))
    for i in range(1, len(w) - 1):
        if w[i] in "uy" and w[i - 1] in v and w[i + 1] in v:
            w[i] = w[i].upper()
    w = "".join(w)
    r1 = r2 = len(w)
    if len(w) >= 3:
        first = _mark(w, v)
        r1, r2 = max(3, first), _mark(w, v, first)
    s = _longest(w, _DE_1)
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2] in _DE_S):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = _longest(w, _DE_2)
    if s and len(w) - len(s) >= r1 and (s != "st" or (len(w) > 5 and w[-3] in _DE_ST)):
        w = w[: -len(s)]
    s = _longest(w, _DE_3)
    short = _cut(w, s, r2) if s else None
    if short is not None:
        if s in ("end", "ung"):
            w = short[:-2] if short.endswith("ig") and not short.endswith("eig") and len(short) - 2 >= r2 else short
        elif s in ("ig", "ik", "isch"):
            w = w if short.endswith("e") else short
        elif s in ("lich", "heit"):
            w = _any_cut(short, r1, "er", "en")
        else:
            w = _any_cut(short, r2, "lich", "ig")
    return w.lower().translate(_DE_UMLAUTS)


# The vowels and suffixes of the Spanish algorithm.
_ES_VOWELS = "aeiouáéíóúü"
_ES_ACUTES = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = _set("me se sela selo selas selos la le lo las les los nos")
_ES_ACCENTED = _set("iéndo ándo ár ér ír")
_ES_BEFORE = _ES_ACCENTED | _set("ando iendo ar er ir yendo")
_ES_PLAIN = _set(
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas "
    "amiento amientos imiento imientos"
)
_ES_AGENT = _set("adora ador ación adoras adores aciones ante antes ancia ancias")
_ES_1 = _ES_PLAIN | _ES_AGENT | _set("logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
_ES_Y_VERBS = _set("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_E_VERBS = _set("en es éis emos")
_ES_VERBS = _ES_E_VERBS | _set(
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré "
    "erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió "
    "ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis "
    "ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)


def _es_rv(w: str) -> int:
    v = _ES_VOWELS
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if w[0] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3


def _es_standard(w: str, r1: int, r2: int) -> str | None:
    s = _longest(w, _ES_1)
    if s is None:
        return None
    if s.startswith("logía"):
        return _cut(w, s, r2, "log")
    if s in ("ución", "uciones"):
        return _cut(w, s, r2, "u")
    if s.startswith("encia"):
        return _cut(w, s, r2, "ente")
    out = _cut(w, s, r1 if s == "amente" else r2)
    if out is None or s in _ES_PLAIN:
        return out
    if s in _ES_AGENT:
        return _any_cut(out, r2, "ic")
    if s == "amente":
        short = _cut(out, "iv", r2)
        return _any_cut(short, r2, "at") if short is not None else _any_cut(out, r2, "os", "ic", "ad")
    if s == "mente":
        return _any_cut(out, r2, "ante", "able", "ible")
    if s.startswith("idad"):
        return _any_cut(out, r2, "abil", "ic", "iv")
    return _any_cut(out, r2, "at")


def spanish(word: str) -> str:
    w = word
    rv, r1 = _es_rv(w), _mark(w, _ES_VOWELS)
    r2 = _mark(w, _ES_VOWELS, r1)
    s = _longest(w, _ES_PRONOUNS)
    if s:
        stem = w[: -len(s)]
        verb = _longest(stem, _ES_BEFORE)
        if verb and len(stem) - len(verb) >= rv and (verb != "yendo" or stem[:-5].endswith("u")):
            w = stem[: -len(verb)] + verb.translate(_ES_ACUTES) if verb in _ES_ACCENTED else stem
    out = _es_standard(w, r1, r2)
    if out is None:
        s = _longest(w, _ES_Y_VERBS, rv)
        if s and w[: -len(s)].endswith("u"):
            out = w[: -len(s)]
    if out is None:
        s = _longest(w, _ES_VERBS, rv)
        if s:
            out = w[: -len(s)]
            if s in _ES_E_VERBS and out.endswith("gu"):
                out = out[:-1]
    w = w if out is None else out
    s = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s and len(w) - len(s) >= rv:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_ACUTES)


STEMMERS = {"english": english, "french": french, "german": german, "spanish": spanish}
#: Stems held by a worker.
HELD = 1 << 16


@lru_cache(HELD)
def stem(word: str, config: str) -> str:
    """The stem of a word in lower case; the word itself where the language has no stemmer."""
    return STEMMERS[config](word) if config in STEMMERS else word


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series, configs: pd.Series) -> pd.Series:
    """Stems of words by language; each distinct pair of a batch is stemmed once."""
    pairs = pd.MultiIndex.from_arrays([words, configs])
    codes, distinct = pairs.factorize()
    return pd.Series([None if pd.isna(w) else stem(w, c) for w, c in distinct], dtype=object).take(codes).reset_index(drop=True)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_all(words: pd.Series, configs: pd.Series) -> pd.Series:
    """Stems of arrays of words by language."""
    return pd.Series([None if ws is None else [stem(w, c) for w in ws] for ws, c in zip(words, configs)], dtype=object)


#: Declared so that filters above it stay above: copied into them, its input would grow with the words of a query.
stemmed_once = stemmed_all.asNondeterministic()


# Letters that a stemmer may write in another way, and what they are compared as.
_FOLDED = ("äöüáéíóúâàëêèïîôûùç", "aouaeiouaaeeeiiouuc")


def folded(word: str) -> str:
    return word.translate(str.maketrans(*_FOLDED)).replace("ß", "ss")


def fold(token: Column) -> Column:
    return F.replace(F.translate(token, *_FOLDED), F.lit("ß"), F.lit("ss"))


def may_stem_to(plain: Column, stems: list[str]) -> Column:
    """Whether a folded token can have one of the stems: all but the stem's last two letters begin it."""
    out = F.lit(False)
    for s in sorted({folded(s)[: max(1, len(folded(s)) - 2)] for s in stems}):
        out = out | plain.startswith(s)
    return out
