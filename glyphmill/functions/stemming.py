"""Stemmers, written from the published Snowball descriptions.

A stem is a function of the word alone, so a column of term arrays is stemmed in
Arrow batches that look up each distinct word of the batch once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouy"


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, twice."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in vowels and word[i - 1] in vowels:
                return i + 1
        return len(word)

    r1 = after(0)
    return r1, after(r1)


#: Fixed values of the English stemmer: words with a stem of their own.
_EN_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of steps 2, 3 and 4, longest first.
_EN_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_EN_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_EN_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _en_short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def english(word: str) -> str:
    w = word.replace("\u2019", "'").lstrip("'") if word.startswith(("'", "\u2019")) else word.replace("\u2019", "'")
    if len(word) <= 2:
        return word
    if w in _EN_EXCEPTIONS:
        return _EN_EXCEPTIONS[w]
    # A y at the start or after a vowel is a consonant, written Y.
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            r2 = r1 + _regions("b" + w[r1:], _V)[0] - 1 if r1 < len(w) else len(w)
            r2 = next((i + 1 for i in range(r1 + 1, len(w)) if w[i] not in _V and w[i - 1] in _V), len(w))
            break
    else:
        r1, r2 = _regions(w, _V)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT_AFTER_1A:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _V for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                        w = w[:-1]
                    elif len(w) <= r1 and _en_short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _EN_STEP2:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and not (end == "ogi" and not stem.endswith("l")) and not (end == "li" and not stem.endswith(tuple("cdeghkmnrt"))):
                w = stem + to
            break
    for end, to in _EN_STEP3:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= (r2 if end == "ative" else r1):
                w = stem + to
            break
    for end in _EN_STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r2 and not (end == "ion" and not stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def german(word: str) -> str:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])([uy])(?=[{v}])", lambda m: m[1].upper(), w)
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "s" or stem.endswith(tuple("bdfghklmnrt"))):
                w = stem
                if end in ("en", "es", "e") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "st" or (len(stem) >= 4 and stem.endswith(tuple("bdfghklmnt")))):
                w = stem
            break
    for end in ("keit", "heit", "lich", "isch", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) < r2:
                break
            if end in ("end", "ung"):
                w = stem
                if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                    w = w[:-2]
            elif end in ("ig", "ik", "isch"):
                if not stem.endswith("e"):
                    w = stem
            elif end in ("lich", "heit"):
                w = stem
                if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                    w = w[:-2]
            else:
                w = stem
                for more in ("lich", "ig"):
                    if w.endswith(more) and len(w) - len(more) >= r2:
                        w = w[: -len(more)]
                        break
            break
    return w.replace("U", "u").replace("Y", "y").translate(str.maketrans("äöü", "aou"))


def _nordic(word: str, vowels: str, first: tuple[str, ...], s_after: str) -> tuple[str, int]:
    r1 = max(_regions(word, vowels)[0], min(3, len(word)))
    for end in sorted(first, key=len, reverse=True):
        if word.endswith(end) and len(word) - len(end) >= r1:
            return word[: -len(end)], r1
    if word.endswith("s") and len(word) - 1 >= r1 and len(word) > 1 and word[-2] in s_after:
        word = word[:-1]
    return word, r1


#: Noun and verb endings of the Swedish stemmer's first step.
_SV = tuple("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split())


def swedish(word: str) -> str:
    w, r1 = _nordic(word, "aeiouyäåö", _SV, "bcdfghjklmnoprtvy")
    if w.endswith(("dd", "gd", "nn", "dt", "gt", "kt", "tt")) and len(w) - 2 >= r1:
        w = w[:-1]
    for end in ("fullt", "löst", "lig", "els", "ig"):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[:-1] if end in ("fullt", "löst") else w[: -len(end)]
    return w


#: Endings of the first step of the Danish and Norwegian stemmers.
_DA = tuple("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split())
_NO = tuple("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split())


def _undouble(word: str, r1: int, pairs: tuple[str, ...]) -> str:
    return word[:-1] if word.endswith(pairs) and len(word) - 2 >= r1 else word


def danish(word: str) -> str:
    v, pairs = "aeiouyæåø", ("gd", "dt", "gt", "kt")
    w, r1 = _nordic(word, v, _DA, "abcdfghjklmnoprtvyzå")
    w = _undouble(w, r1, pairs)
    if w.endswith("igst"):
        w = w[:-2]
    for end in ("elig", "løst", "lig", "els", "ig"):
        if w.endswith(end) and len(w) - len(end) >= r1:
            w = w[:-1] if end == "løst" else _undouble(w[: -len(end)], r1, pairs)
            break
    if len(w) > r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in v:
        w = w[:-1]
    return w


def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    r1 = max(_regions(word, v)[0], min(3, len(word)))
    w = word
    for end in sorted((*_NO, "erte", "ert"), key=len, reverse=True):
        if w.endswith(end) and len(w) - len(end) >= r1:
            w = w[: -len(end)] + ("er" if end in ("erte", "ert") else "")
            break
    else:
        if w.endswith("s") and len(w) - 1 >= r1 and len(w) > 1 and (w[-2] in "bcdfghjlmnoprtvyz" or (w[-2] == "k" and len(w) > 2 and w[-3] not in v)):
            w = w[:-1]
    w = _undouble(w, r1, ("dt", "vt"))
    for end in ("hetslov", "eleg", "elig", "elov", "slov", "leg", "eig", "lig", "els", "lov", "ig"):
        if w.endswith(end) and len(w) - len(end) >= r1:
            return w[: -len(end)]
    return w


#: Pronouns that Spanish verbs take on, and endings of verbs.
_ES_PRONOUNS = tuple("selas selos sela selo las les los nos me se la le lo".split())
_ES_VERBS = tuple(
    (
        "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
        "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
        "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
        "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
    ).split()
)
#: Noun and adjective endings, those that may follow "ic", and endings replaced.
_ES_PLAIN = tuple("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split())
_ES_AFTER_IC = tuple("adora ador ación adoras adores aciones ante antes ancia ancias".split())
_ES_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}


def _longest(word: str, ends) -> str:
    return max((e for e in ends if word.endswith(e)), key=len, default="")


def spanish(word: str) -> str:
    v = "aeiouáéíóúü"
    w = word
    r1, r2 = _regions(w, v)
    if len(w) < 3:
        rv = len(w)
    elif w[1] not in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    elif w[0] in v:
        rv = next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    else:
        rv = 3
    plain = str.maketrans("áéíóú", "aeiou")

    def cut(end: str, region: int) -> bool:
        return bool(end) and w.endswith(end) and len(w) - len(end) >= region

    pronoun = _longest(w, _ES_PRONOUNS)
    if pronoun and len(w) - len(pronoun) >= rv:
        base = w[: -len(pronoun)]
        accented = _longest(base, ("iéndo", "ándo", "ár", "ér", "ír"))
        bare = _longest(base, ("ando", "iendo", "ar", "er", "ir"))
        if accented and len(base) - len(accented) >= rv:
            w = base[: -len(accented)] + accented.translate(plain)
        elif (bare and len(base) - len(bare) >= rv) or (base.endswith("uyendo") and len(base) - 5 >= rv):
            w = base
    before = w
    end = _longest(w, (*_ES_PLAIN, *_ES_AFTER_IC, *_ES_REPLACED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"))
    if end == "amente":
        if cut(end, r1):
            w = w[: -len(end)]
            if cut("iv", r2):
                w = w[:-2]
                w = w[:-2] if cut("at", r2) else w
            else:
                more = _longest(w, ("os", "ic", "ad"))
                w = w[: -len(more)] if cut(more, r2) else w
    elif cut(end, r2):
        w = w[: -len(end)] + _ES_REPLACED.get(end, "")
        follow = ("ic",) if end in _ES_AFTER_IC else ("ante", "able", "ible") if end == "mente" else ("abil", "ic", "iv") if end.startswith("idad") else ("at",) if end.startswith("iv") else ()
        more = _longest(w, follow)
        w = w[: -len(more)] if cut(more, r2) else w
    if w == before:
        end = _longest(w, tuple("yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()))
        if cut(end, rv) and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end = _longest(w, (*_ES_VERBS, "en", "es", "éis", "emos"))
            if cut(end, rv):
                w = w[: -len(end)]
                if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    end = _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if cut(end, rv):
        w = w[: -len(end)]
        if end in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


#: Fixed values of the French stemmer: plain endings, those after "ic", and verb endings.
_FR_PLAIN = tuple("ance iqUe isme able iste eux ances iqUes ismes ables istes".split())
_FR_AFTER_IC = tuple("atrice ateur ation atrices ateurs ations".split())
_FR_REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_I_VERBS = tuple(
    (
        "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
        "issant issante issantes issants isse issent isses issez issiez issions issons it"
    ).split()
)
_FR_VERBS = tuple("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split())
_FR_A_VERBS = tuple("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())
_FR_OTHERS = tuple("ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split())


class _French:
    """One word on its way to its stem: ``w`` shrinks, the regions stay."""

    VOWELS = "aeiouyâàëéêèïîôûù"

    def __init__(self, word: str):
        v, w = self.VOWELS, [*word]
        # A vowel letter that acts as a consonant is written in upper case.
        for i, c in enumerate(word):
            left, right = i > 0 and w[i - 1] in v, i + 1 < len(word) and word[i + 1] in v
            if (c in "ui" and left and right) or (c == "y" and (left or right)) or (c == "u" and i > 0 and word[i - 1] == "q"):
                w[i] = c.upper()
        self.w = "".join(w)
        self.r1, self.r2 = _regions(self.w, v)
        if self.w[:3] in ("par", "col", "tap") or (len(w) > 2 and w[0] in v and w[1] in v):
            self.rv = min(3, len(w))
        else:
            self.rv = next((i + 1 for i in range(1, len(w)) if w[i] in v), len(w))

    def at(self, end: str, region: int) -> bool:
        return bool(end) and self.w.endswith(end) and len(self.w) - len(end) >= region

    def swap(self, end: str, by: str = "") -> None:
        self.w = self.w[: len(self.w) - len(end)] + by

    def swap_if(self, end: str, region: int, by: str = "") -> bool:
        if self.at(end, region):
            self.swap(end, by)
            return True
        return False

    def either(self, end: str, by: str) -> None:
        """Take an ending away in the second region, replace it before that."""
        if self.w.endswith(end):
            self.swap(end, "" if self.at(end, self.r2) else by)

    def noun_ending(self) -> bool:
        """Standard endings; whether the word is done with verbs."""
        end = _longest(self.w, (*_FR_PLAIN, *_FR_AFTER_IC, *_FR_REPLACED, *_FR_OTHERS))
        if end in _FR_REPLACED or end in _FR_PLAIN:
            return self.swap_if(end, self.r2, _FR_REPLACED.get(end, ""))
        if end in _FR_AFTER_IC:
            if not self.swap_if(end, self.r2):
                return False
            self.either("ic", "iqU")
            return True
        if end in ("issement", "issements"):
            before = self.w[: -len(end)][-1:]
            return bool(before) and before not in self.VOWELS and self.swap_if(end, self.r1)
        if end in ("ement", "ements"):
            if not self.swap_if(end, self.rv):
                return False
            if self.w.endswith("iv"):
                if self.swap_if("iv", self.r2):
                    self.swap_if("at", self.r2)
            elif self.w.endswith("eus"):
                self.swap_if("eus", self.r2) or self.swap_if("eus", self.r1, "eux")
            elif self.w.endswith(("abl", "iqU")):
                self.swap_if(self.w[-3:], self.r2)
            elif self.w.endswith(("ièr", "Ièr")):
                self.swap_if(self.w[-3:], self.rv, "i")
            return True
        if end in ("ité", "ités"):
            if not self.swap_if(end, self.r2):
                return False
            if self.w.endswith("abil"):
                self.either("abil", "abl")
            elif self.w.endswith("ic"):
                self.either("ic", "iqU")
            else:
                self.swap_if("iv", self.r2)
            return True
        if end in ("if", "ive", "ifs", "ives"):
            if not self.swap_if(end, self.r2):
                return False
            if self.swap_if("at", self.r2):
                self.either("ic", "iqU")
            return True
        if end == "eaux":
            self.swap(end, "eau")
            return True
        if end == "aux":
            return self.swap_if(end, self.r1, "al")
        if end in ("euse", "euses"):
            return self.swap_if(end, self.r2) or self.swap_if(end, self.r1, "eux")
        # Adverbs leave a word that may still end like a verb.
        if end in ("amment", "emment"):
            self.swap_if(end, self.rv, "ant" if end == "amment" else "ent")
        elif end in ("ment", "ments"):
            place = len(self.w) - len(end) - 1
            if place >= self.rv and self.w[place] in self.VOWELS:
                self.swap(end)
        return False

    def verb_ending(self) -> bool:
        inside = self.w[self.rv :]
        end = _longest(inside, _FR_I_VERBS)
        place = len(self.w) - len(end) - 1
        if end and place >= self.rv and self.w[place] not in self.VOWELS:
            self.swap(end)
            return True
        end = _longest(inside, (*_FR_VERBS, *_FR_A_VERBS, "ions"))
        if not end or (end == "ions" and not self.at(end, self.r2)):
            return False
        self.swap(end)
        if end in _FR_A_VERBS:
            self.swap_if("e", self.rv)
        return True

    def rest(self) -> None:
        """Endings of words that are neither."""
        if self.w.endswith("s") and len(self.w) > 1 and self.w[-2] not in "aiouès":
            self.swap("s")
        end = _longest(self.w[self.rv :], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if end == "ion":
            if self.at(end, self.r2) and self.w[-4:-3] in ("s", "t") and len(self.w) - 4 >= self.rv:
                self.swap(end)
        elif end == "ë":
            if self.at("guë", self.rv):
                self.swap(end)
        elif end:
            self.swap(end, "" if end == "e" else "i")

    def stem(self) -> str:
        if self.noun_ending() or self.verb_ending():
            if self.w.endswith(("Y", "ç")):
                self.w = self.w[:-1] + ("i" if self.w[-1] == "Y" else "c")
        else:
            self.rest()
        if self.w.endswith(("enn", "onn", "ett", "ell", "eill")):
            self.w = self.w[:-1]
        tail = len(self.w)
        while tail and self.w[tail - 1] not in self.VOWELS:
            tail -= 1
        if 0 < tail < len(self.w) and self.w[tail - 1] in "éè":
            self.w = f"{self.w[: tail - 1]}e{self.w[tail:]}"
        return self.w.lower()


def french(word: str) -> str:
    return _French(word).stem()


#: Fixed values of the Portuguese stemmer (nasal vowels spelled with a tilde after them).
_PT_PLAIN = tuple("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split())
_PT_REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
#: Ending → what goes with it where it stands before it.
_PT_WITH = {
    **dict.fromkeys(("mente",), ("ante", "avel", "ível")),
    **dict.fromkeys(("idade", "idades"), ("abil", "ic", "iv")),
    **dict.fromkeys(("iva", "ivo", "ivas", "ivos"), ("at",)),
}
_PT_VERBS = tuple(
    (
        "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam "
        "em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás "
        "avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis "
        "ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos "
        "êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
    ).split()
)


def _verb_region(w: str, v: str) -> int:
    """Where verb endings may begin: by the shape of a word's first letters."""
    if len(w) < 3:
        return len(w)
    if w[1] not in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] in v), len(w))
    if w[0] in v:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in v), len(w))
    return 3


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, v)
    rv = _verb_region(w, v)

    def without(ends, region: int) -> str | None:
        """The word less the longest of the endings; None if that begins before the region."""
        end = _longest(w, ends)
        return w[: -len(end)] if end and len(w) - len(end) >= region else None

    end = _longest(w, (*_PT_PLAIN, *_PT_REPLACED, *_PT_WITH, "amente", "ira", "iras"))
    before = w
    if end == "amente":
        if without((end,), r1) is not None:
            w = w[: -len(end)]
            if w.endswith("iv"):
                w = without(("iv",), r2) or w
                w = (without(("at",), r2) or w) if not w.endswith("iv") else w
            else:
                w = without(("os", "ic", "ad"), r2) or w
    elif end in ("ira", "iras"):
        if without((end,), rv) is not None and w[: -len(end)].endswith("e"):
            w = w[: -len(end)] + "ir"
    elif end and without((end,), r2) is not None:
        w = w[: -len(end)] + _PT_REPLACED.get(end, "")
        w = without(_PT_WITH.get(end, ()), r2) or w
    if w == before:
        inside = _longest(w[rv:], _PT_VERBS)
        w = w[: len(w) - len(inside)]
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        w = w[: len(w) - len(_longest(w[rv:], ("os", "a", "i", "o", "á", "í", "ó")))]
    if w.endswith("ç"):
        w = w[:-1] + "c"
    elif w[-1:] in ("e", "é", "ê") and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w.replace("a~", "ã").replace("o~", "õ")


#: Fixed values of the Italian stemmer: attached pronouns, plain and replaced endings, verb endings.
_IT_PRONOUNS = tuple("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
_IT_PLAIN = tuple("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split())
_IT_AFTER_IC = tuple("azione azioni atore atori".split())
_IT_REPLACED = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_IT_VERBS = tuple(
    (
        "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe "
        "erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe "
        "irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo "
        "ono uta ute uti uto ar ir"
    ).split()
)


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    letters = [*w]
    for i in range(1, len(w) - 1):
        if w[i] in "ui" and letters[i - 1] in v and w[i + 1] in v:
            letters[i] = w[i].upper()
    w = "".join(letters)
    r1, r2 = _regions(w, v)
    rv = _verb_region(w, v)

    def less(end: str, region: int) -> str:
        """The word without an ending that begins in the region, else as it is."""
        return w[: -len(end)] if end and w.endswith(end) and len(w) - len(end) >= region else w

    pronoun = _longest(w, _IT_PRONOUNS)
    if pronoun:
        base = w[: -len(pronoun)]
        host = _longest(base, ("ando", "endo", "ar", "er", "ir"))
        if host and len(base) - len(host) >= rv:
            w = base + ("e" if len(host) == 2 else "")
    before = w
    end = _longest(w, (*_IT_PLAIN, *_IT_AFTER_IC, *_IT_REPLACED, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"))
    region = r1 if end == "amente" else rv if end in ("amento", "amenti", "imento", "imenti") else r2
    w = less(end, region)
    if w != before:
        w += _IT_REPLACED.get(end, "")
        if end in _IT_AFTER_IC:
            w = less("ic", r2)
        elif end == "amente":
            if w.endswith("iv"):
                shorter = less("iv", r2)
                w = shorter if shorter == w else (shorter[:-2] if shorter.endswith("at") and len(shorter) - 2 >= r2 else shorter)
            else:
                w = less(_longest(w, ("os", "ic", "abil")), r2)
        elif end == "ità":
            w = less(_longest(w, ("abil", "ic", "iv")), r2)
        elif end in ("ivo", "ivi", "iva", "ive"):
            shorter = less("at", r2)
            w = shorter[:-2] if shorter != w and shorter.endswith("ic") and len(shorter) - 2 >= r2 else shorter
    else:
        inside = _longest(w[rv:], _IT_VERBS)
        w = w[: len(w) - len(inside)]
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        w = less("i", rv)
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


#: Fixed values of the Dutch stemmer: accents that it drops.
_NL_ACCENTS = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def dutch(word: str) -> str:
    v = "aeiouyè"
    letters = [*word.translate(_NL_ACCENTS)]
    if letters[:1] == ["y"]:
        letters[0] = "Y"
    for i in range(1, len(letters)):
        if letters[i - 1] in v and (letters[i] == "y" or (letters[i] == "i" and i + 1 < len(letters) and letters[i + 1] in v)):
            letters[i] = letters[i].upper()
    w = "".join(letters)
    r1, r2 = _regions(w, v)
    r1 = max(r1, min(3, len(w)))

    def single(stem: str) -> str:
        return stem[:-1] if stem.endswith(("kk", "dd", "tt")) else stem

    def without_en(w: str, end: str) -> str:
        stem = w[: -len(end)]
        return single(stem) if len(stem) >= r1 and stem and stem[-1] not in v and not stem.endswith("gem") else w

    def without_e(w: str) -> tuple[str, bool]:
        fits = w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in v
        return (single(w[:-1]), True) if fits else (w, False)

    def without_ig(w: str) -> str:
        return w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig") else w

    end = _longest(w, ("heden", "ene", "en", "se", "s"))
    if end == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif end in ("en", "ene"):
        w = without_en(w, end)
    elif end and len(w) - len(end) >= r1 and len(w) > len(end) and w[-len(end) - 1] not in v + "j":
        w = w[: -len(end)]
    w, had_e = without_e(w)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = without_en(w, "en")
    end = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if end and len(w) - len(end) >= r2:
        if end in ("end", "ing"):
            w = w[:-3]
            shorter = without_ig(w)
            w = shorter if shorter != w else single(w)
        elif end == "ig":
            w = without_ig(w)
        elif end == "lijk":
            w, _ = without_e(w[:-4])
        elif end == "baar" or had_e:
            w = w[: -len(end)]
    if len(w) > 3 and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-4] not in v and w[-1] not in v + "I":
        w = w[:-2] + w[-1]
    return w.lower()


#: Endings of the Russian stemmer; those of the first of two groups follow а or я.
_RU_GERUND = (tuple("в вши вшись".split()), tuple("ив ивши ившись ыв ывши ывшись".split()))
_RU_ADJECTIVE = tuple("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_RU_PARTICIPLE = (tuple("ем нн вш ющ щ".split()), tuple("ивш ывш ующ".split()))
_RU_VERB = (
    tuple("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()),
    tuple("ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()),
)
_RU_NOUN = tuple("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in v), len(w))
    head, tail = w[:rv], w[rv:]
    r2 = max(_regions(w, v)[1] - rv, 0)

    def less(t: str, ends) -> str:
        end = _longest(t, ends)
        return t[: -len(end)] if end else t

    def less_grouped(t: str, groups) -> str:
        end = _longest(t, (*groups[0], *groups[1]))
        stem = t[: -len(end)] if end else t
        return t if end in groups[0] and not stem.endswith(("а", "я")) else stem

    shorter = less_grouped(tail, _RU_GERUND)
    if shorter == tail:
        tail = less(tail, ("ся", "сь"))
        shorter = less(tail, _RU_ADJECTIVE)
        if shorter != tail:
            shorter = less_grouped(shorter, _RU_PARTICIPLE)
        else:
            shorter = less_grouped(tail, _RU_VERB)
            if shorter == tail:
                shorter = less(tail, _RU_NOUN)
    tail = less(shorter, ("и",))
    end = _longest(tail, ("ост", "ость"))
    if end and len(tail) - len(end) >= r2:
        tail = tail[: -len(end)]
    end = _longest(tail, ("ейше", "ейш", "нн", "ь"))
    if end == "нн":
        tail = tail[:-1]
    elif end:
        tail = tail[: -len(end)]
        if end != "ь" and tail.endswith("нн"):
            tail = tail[:-1]
    return head + tail


#: Fixed values of the Finnish stemmer: long vowels, particles, cases and what stands before them.
_FI_LONG = ("aa", "ee", "ii", "oo", "uu", "ää", "öö")
_FI_PARTICLES = tuple("kin kaan kään ko kö han hän pa pä".split())
_FI_BEFORE_POSSESSIVE = {"an": tuple("ta ssa sta lla lta na".split()), "än": tuple("tä ssä stä llä ltä nä".split()), "en": ("lle", "ine")}
_FI_CASES = tuple("ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine".split())
_FI_COMPARED = tuple("mpi mpa mpä mmi mma mmä".split())
_FI_DERIVED = tuple("impi impa impä immi imma immä eja ejä".split())


def finnish(word: str) -> str:
    v, consonants = "aeiouyäö", "bcdfghjklmnpqrstvwxz"
    r1, r2 = _regions(word, v)
    w = word

    def found(*ends: str, region: int = 0) -> str:
        """The longest of the endings that begin in a region."""
        return _longest(w[max(r1, region) :], ends)

    end = found(*_FI_PARTICLES, "sti")
    stem = w[: len(w) - len(end)]
    if end == "sti" and len(stem) >= r2 or end in _FI_PARTICLES and stem[-1:] and stem[-1] in v + "nt":
        w = stem

    end = found("si", "ni", "nsa", "nsä", "mme", "nne", "an", "än", "en")
    stem = w[: len(w) - len(end)]
    if end == "ni":
        w = stem[:-1] + "i" if stem.endswith("kse") else stem
    elif end == "si":
        w = w if stem.endswith("k") else stem
    elif end and stem.endswith(_FI_BEFORE_POSSESSIVE.get(end, "")):
        w = stem

    # Four endings hold only after certain vowels; elsewhere a shorter ending is looked for.
    after_i = w.endswith(tuple(x + "i" + e for x in "aeiouäö" for e in ("siin", "den", "tten")))
    after_long = w.endswith(tuple(x + "seen" for x in _FI_LONG))
    end = found(*_FI_CASES, "han", "hen", "hin", "hon", "hän", "hön", "a", "ä", "tta", "ttä", "n", *("siin", "den", "tten") * after_i, *("seen",) * after_long)
    stem = w[: len(w) - len(end)]
    if end in ("a", "ä"):
        fits = len(stem) > 1 and stem[-1] in v and stem[-2] in consonants
    elif end in ("tta", "ttä"):
        fits = stem.endswith("e")
    else:
        fits = not end.startswith("h") or stem.endswith(end[1])
    case = bool(end) and fits
    if case:
        w = stem[:-1] if end == "n" and stem.endswith((*_FI_LONG, "ie")) else stem

    end = found(*_FI_COMPARED, *_FI_DERIVED, region=r2)
    stem = w[: len(w) - len(end)]
    if end and not (end in _FI_COMPARED and stem.endswith("po")):
        w = stem

    if case:
        w = w[: len(w) - len(found("i", "j"))]
    elif found(*(x + "t" for x in v)):
        w = w[:-1]
        end = found("mma", "imma", region=r2)
        stem = w[: len(w) - len(end)]
        if not (end == "mma" and stem.endswith("po")):
            w = stem

    if found(*_FI_LONG):
        w = w[:-1]
    if len(w) - 2 >= r1 and len(w) > 1 and w[-1] in "aäei" and w[-2] in consonants:
        w = w[:-1]
    if found("oj", "uj"):
        w = w[:-1]
    if found("jo"):
        w = w[:-1]
    last = next((i for i in range(len(w) - 1, 0, -1) if w[i] not in v), 0)
    if last and w[last] == w[last - 1] and w[last] in consonants:
        w = w[:last] + w[last + 1 :]
    return w


#: Fixed values of the Hungarian stemmer: double consonants, then for each step the
#: endings that go and those that leave a short vowel.
_HU_DOUBLE = tuple("bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split())
_HU_CASES = tuple(
    "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé "
    "onként enként anként ként en on an ön n t".split()
)
_HU_STEPS = (
    ((), ("án", "ánként"), ("én",)),
    (("astul", "estül", "stul", "stül"), ("ástul",), ("éstül",)),
    None,
    (("oké", "öké", "aké", "eké", "ké", "é", "éi"), ("áké", "áéi"), ("éké", "ééi", "éé")),
    (
        tuple("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o".split()),
        tuple("ánk ájuk ám ád á".split()),
        tuple("énk éjük ém éd é".split()),
    ),
    (
        tuple("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink aink eink ink jaitok jeitek aitok eitek itek jaik jeik aik eik ik".split()),
        tuple("áim áid ái áink áitok áik".split()),
        tuple("éim éid éi éink éitek éik".split()),
    ),
    (("ök", "ok", "ek", "ak", "k"), ("ák",), ("ék",)),
)


def hungarian(word: str) -> str:
    v = "aáeéiíoóöőuúüű"
    if word[:1] and word[0] in v:
        first = next((i for i, c in enumerate(word) if c not in v), len(word))
        sound = next((x for x in ("dzs", "cs", "gy", "ly", "ny", "sz", "ty", "zs") if word.startswith(x, first)), word[first : first + 1])
        r1 = first + len(sound)
    else:
        r1 = next((i + 1 for i, c in enumerate(word) if c in v), len(word))
    w = word

    def single(end: str) -> str:
        """The word without an ending after a double consonant, of which one letter goes too."""
        stem = w[: -len(end)]
        return stem[:-2] + stem[-1] if stem.endswith(_HU_DOUBLE) else w

    def found(*ends: str) -> str:
        """The longest of the endings, if it begins in R1."""
        end = _longest(w, ends)
        return end if len(w) - len(end) >= r1 else ""

    end = found("al", "el")
    if end:
        w = single(end)
    end = found(*_HU_CASES)
    if end:
        w = w[: -len(end)]
        if found("á", "é"):
            w = w[:-1] + {"á": "a", "é": "e"}[w[-1]]
    for step in _HU_STEPS:
        if step is None:
            end = found("á", "é")
            if end:
                w = single(end)
            continue
        gone, to_a, to_e = step
        end = found(*gone, *to_a, *to_e)
        if end:
            w = w[: -len(end)] + ("a" if end in to_a else "e" if end in to_e else "")
    return w


STEMMERS = {"en": english, "de": german, "es": spanish, "fr": french, "it": italian, "pt": portuguese, "sv": swedish, "da": danish, "no": norwegian, "nl": dutch, "ru": russian, "fi": finnish, "hu": hungarian}


@lru_cache(1 << 17)
def stem_word(word: str, language: str) -> str:
    return STEMMERS[language](word)


def stem_column(terms: Column, language: str | Column) -> Column:
    """Stems of a column of term arrays; null where a language column is null or names no stemmer."""
    if isinstance(language, str):
        language = F.lit(language)

    @F.pandas_udf("array<string>")
    def stem(batch: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([None if words is None or code not in STEMMERS else [stem_word(w, code) for w in words] for words, code in zip(batch, languages, strict=True)], dtype=object)

    return stem(terms, language)
