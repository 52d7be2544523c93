"""Stemming kernels: Porter's 1980 algorithm and the Snowball stemmers of six languages.

Each language is a set of suffix rules over regions of the word; `Word` finds the longest
suffix and tests regions. Words are lower-cased, and composed (NFC) but for English.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache


class Word:
    """A word under stemming, with the starts of its regions."""

    def __init__(self, text: str, vowels: str):
        self.w, self.vowels = text, vowels
        self.r1 = self.r2 = self.rv = len(text)

    def after_vc(self, start: int) -> int:
        """The place after the first non-vowel that follows a vowel."""
        for i in range(start + 1, len(self.w)):
            if self.w[i] not in self.vowels and self.w[i - 1] in self.vowels:
                return i + 1
        return len(self.w)

    def regions(self) -> None:
        self.r1 = self.after_vc(0)
        self.r2 = self.after_vc(self.r1)

    def romance_rv(self) -> None:
        w, v = self.w, self.vowels
        self.rv = len(w)
        if len(w) < 2:
            return
        if w[1] not in v:
            wanted = (i + 1 for i in range(2, len(w)) if w[i] in v)
        elif w[0] in v:
            wanted = (i + 1 for i in range(2, len(w)) if w[i] not in v)
        else:
            wanted = iter([3])
        self.rv = next(wanted, len(w))

    def longest(self, suffixes, start: int = 0) -> str:
        """The longest suffix that ends the word at or after start, or ''."""
        room = len(self.w) - start
        return max((s for s in suffixes if len(s) <= room and self.w.endswith(s)), key=len, default="")

    def at(self, start: int, suffix: str) -> bool:
        return len(self.w) - len(suffix) >= start and self.w.endswith(suffix)

    def cut(self, suffix: str, new: str = "") -> None:
        self.w = self.w[: len(self.w) - len(suffix)] + new

    def drop(self, start: int, *suffixes: str) -> str:
        """Deletes the first of the suffixes that the word ends in, if it lies in the region."""
        for s in suffixes:
            if self.w.endswith(s):
                if self.at(start, s):
                    self.cut(s)
                    return s
                return ""
        return ""

    def before(self, suffix: str) -> str:
        i = len(self.w) - len(suffix) - 1
        return self.w[i] if i >= 0 else ""


def _words(text: str) -> list[str]:
    return text.split()


def _mark_between_vowels(w: str, letters: str, vowels: str) -> str:
    out = list(w)
    for i in range(1, len(w) - 1):
        if out[i] in letters and out[i - 1] in vowels and out[i + 1] in vowels:
            out[i] = out[i].upper()
    return "".join(out)


# ---------------------------------------------------------------- Porter, 1980


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _rule(w: str, rules: list[tuple[str, str]], least: int) -> str:
    """Applies the rule of the longest suffix, if the stem measures more than least."""
    for s, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(s):
            stem = w[: len(w) - len(s)]
            return stem + new if _measure(stem) > least else w
    return w


# The suffixes of the published algorithm.
PORTER_2 = [x.split(":") for x in _words("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")]
PORTER_3 = [x.split(":") for x in _words("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:")]
PORTER_4 = _words("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize")


def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    for s, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: len(w) - len(s)] + new
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                stem = w[: len(w) - len(s)]
                if "v" in _shape(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _rule(w, PORTER_2, 0)
    w = _rule(w, PORTER_3, 0)
    for s in sorted(PORTER_4, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: len(w) - len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


# ---------------------------------------------------------------- English

# Exceptions and suffixes of the published algorithm.
EN_WHOLE = dict(x.split(":") for x in _words("skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"))
EN_AFTER_1A = set(_words("inning outing canning herring earring proceed exceed succeed"))
EN_2 = [x.split(":") for x in _words("tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:")]
EN_3 = [x.split(":") for x in _words("tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:")]
EN_4 = _words("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
EN_V = "aeiouy"


def _short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in EN_V and w[1] not in EN_V
    return len(w) > 2 and w[-1] not in EN_V + "wxY" and w[-2] in EN_V and w[-3] not in EN_V


def english(word: str) -> str:
    w = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(w) <= 2:
        return w
    if w in EN_WHOLE:
        return EN_WHOLE[w]
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    x = Word(w, EN_V)
    head = re.match("gener|commun|arsen", w)
    x.r1 = head.end() if head else x.after_vc(0)
    x.r2 = x.after_vc(x.r1)

    x.cut(x.longest(["'", "'s", "'s'"]))
    s = x.longest(["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        x.cut("es")
    elif s in ("ied", "ies"):
        x.cut(s, "i" if len(x.w) > 4 else "ie")
    elif s == "s" and any(c in EN_V for c in x.w[:-2]):
        x.cut("s")
    if x.w in EN_AFTER_1A:
        return x.w

    s = x.longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s in ("eed", "eedly"):
        if x.at(x.r1, s):
            x.cut(s, "ee")
    elif s and any(c in EN_V for c in x.w[: len(x.w) - len(s)]):
        x.cut(s)
        if x.w.endswith(("at", "bl", "iz")):
            x.w += "e"
        elif x.w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            x.w = x.w[:-1]
        elif x.r1 >= len(x.w) and _short_end(x.w):
            x.w += "e"
    if len(x.w) > 2 and x.w[-1] in "yY" and x.w[-2] not in EN_V:
        x.w = x.w[:-1] + "i"

    s = x.longest([a for a, _ in EN_2])
    if s and x.at(x.r1, s):
        if s == "ogi":
            if x.before(s) == "l":
                x.cut(s, "og")
        elif s == "li":
            if x.before(s) in tuple("cdeghkmnrt"):
                x.cut(s)
        else:
            x.cut(s, dict(EN_2)[s])
    s = x.longest([a for a, _ in EN_3])
    if s and x.at(x.r1, s) and (s != "ative" or x.at(x.r2, s)):
        x.cut(s, dict(EN_3)[s])
    s = x.longest(EN_4)
    if s and x.at(x.r2, s) and (s != "ion" or x.before(s) in ("s", "t")):
        x.cut(s)
    if x.w.endswith("e"):
        if x.at(x.r2, "e") or x.at(x.r1, "e") and not _short_end(x.w[:-1]):
            x.cut("e")
    elif x.w.endswith("ll") and x.at(x.r2, "l"):
        x.cut("l")
    return x.w.replace("Y", "y")


# ---------------------------------------------------------------- French

FR_V = "aeiouyâàëéêèïîôûù"
# Suffixes of the published algorithm.
FR_PLAIN = _words("ance iqUe isme able iste eux ances iqUes ismes ables istes")
FR_ATION = _words("atrice ateur ation atrices ateurs ations")
FR_OTHER = _words("logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
FR_I = _words("îmes ît îtes i ie Ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
FR_E = _words("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez")
FR_A = _words("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")


def french(word: str) -> str:
    w = unicodedata.normalize("NFC", word.lower())
    out = list(w)
    for i, c in enumerate(out):
        left, right = out[i - 1] if i else "", out[i + 1] if i + 1 < len(out) else ""
        vl, vr = left != "" and left in FR_V, right != "" and right in FR_V
        if c == "u" and (left == "q" or vl and vr) or c == "i" and vl and vr or c == "y" and (vl or vr):
            out[i] = c.upper()
    x = Word("".join(out), FR_V)
    w = x.w
    x.regions()
    if len(w) > 1 and w[0] in FR_V and w[1] in FR_V or w[:3] in ("par", "col", "tap"):
        x.rv = min(3, len(w))
    else:
        x.rv = next((i + 1 for i in range(1, len(w)) if w[i] in FR_V), len(w))
    changed, verbs = _french_1(x)
    if not changed or verbs:
        step_2 = False
        s = x.longest(FR_I, x.rv)
        if s and len(x.w) - len(s) > x.rv and x.before(s) not in FR_V:
            x.cut(s)
            step_2 = True
        else:
            step_2 = _french_2b(x)
        changed = changed or step_2
    if changed:
        if x.w.endswith("Y"):
            x.cut("Y", "i")
        elif x.w.endswith("ç"):
            x.cut("ç", "c")
    else:
        if x.w.endswith("s") and len(x.w) > 1 and x.w[-2] not in "aiouès":
            x.cut("s")
        s = x.longest(["ion", "ier", "ière", "Ier", "Ière", "e", "ë"], x.rv)
        if s == "ion":
            if x.at(x.r2, s) and len(x.w) - 4 >= x.rv and x.before(s) in ("s", "t"):
                x.cut(s)
        elif s in ("ier", "ière", "Ier", "Ière"):
            x.cut(s, "i")
        elif s == "e" or s == "ë" and x.w.endswith("guë"):
            x.cut(s)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    x.w = re.sub(f"[éè](?=[^{FR_V}]+$)", "e", x.w)
    return x.w.replace("U", "u").replace("I", "i").replace("Y", "y")


def _french_1(x: Word) -> tuple[bool, bool]:
    """(whether the word changed, whether verb endings are looked for all the same)."""
    s = x.longest(FR_PLAIN + FR_ATION + FR_OTHER)
    before = x.w
    if s in FR_PLAIN:
        x.drop(x.r2, s)
    elif s in FR_ATION:
        if x.drop(x.r2, s) and x.w.endswith("ic") and not x.drop(x.r2, "ic"):
            x.cut("ic", "iqU")
    elif s in ("logie", "logies"):
        if x.at(x.r2, s):
            x.cut(s, "log")
    elif s in ("usion", "ution", "usions", "utions"):
        if x.at(x.r2, s):
            x.cut(s, "u")
    elif s in ("ence", "ences"):
        if x.at(x.r2, s):
            x.cut(s, "ent")
    elif s in ("ement", "ements"):
        if x.drop(x.rv, s):
            if x.w.endswith("iv"):
                if x.drop(x.r2, "iv"):
                    x.drop(x.r2, "at")
            elif x.w.endswith("eus"):
                if not x.drop(x.r2, "eus") and x.at(x.r1, "eus"):
                    x.cut("eus", "eux")
            elif x.w.endswith(("abl", "iqU")):
                x.drop(x.r2, "abl", "iqU")
            elif x.w.endswith(("ièr", "Ièr")) and len(x.w) - 3 >= x.rv:
                x.cut("ièr", "i")
    elif s in ("ité", "ités"):
        if x.drop(x.r2, s):
            if x.w.endswith("abil"):
                if not x.drop(x.r2, "abil"):
                    x.cut("abil", "abl")
            elif x.w.endswith("ic"):
                if not x.drop(x.r2, "ic"):
                    x.cut("ic", "iqU")
            else:
                x.drop(x.r2, "iv")
    elif s in ("if", "ive", "ifs", "ives"):
        if x.drop(x.r2, s) and x.drop(x.r2, "at") and x.w.endswith("ic") and not x.drop(x.r2, "ic"):
            x.cut("ic", "iqU")
    elif s == "eaux":
        x.cut("eaux", "eau")
    elif s == "aux":
        if x.at(x.r1, s):
            x.cut(s, "al")
    elif s in ("euse", "euses"):
        if not x.drop(x.r2, s) and x.at(x.r1, s):
            x.cut(s, "eux")
    elif s in ("issement", "issements"):
        if x.at(x.r1, s) and x.before(s) not in FR_V:
            x.cut(s)
    elif s in ("amment", "emment"):
        if x.at(x.rv, s):
            x.cut(s, "ant" if s[0] == "a" else "ent")
    elif s in ("ment", "ments"):
        if len(x.w) - len(s) - 1 >= x.rv and x.before(s) in FR_V:
            x.cut(s)
    return x.w != before, s in ("amment", "emment", "ment", "ments")


def _french_2b(x: Word) -> bool:
    s = x.longest(["ions", *FR_E, *FR_A], x.rv)
    if s == "ions":
        return bool(x.drop(x.r2, s))
    if s:
        x.cut(s)
        if s in FR_A:
            x.drop(x.rv, "e")
    return bool(s)


# ---------------------------------------------------------------- German

DE_V = "aeiouyäöü"


def german(word: str) -> str:
    w = unicodedata.normalize("NFC", word.lower()).replace("ß", "ss")
    x = Word(_mark_between_vowels(w, "uy", DE_V), DE_V)
    x.regions()
    x.r1 = max(x.r1, min(3, len(x.w)))

    s = x.longest(["em", "ern", "er", "e", "en", "es", "s"])
    if s and x.at(x.r1, s):
        if s == "s":
            if x.before(s) in tuple("bdfghklmnrt"):
                x.cut(s)
        else:
            x.cut(s)
            if s in ("e", "en", "es") and x.w.endswith("niss"):
                x.cut("s")
    s = x.longest(["en", "er", "est", "st"])
    if s and x.at(x.r1, s) and (s != "st" or x.before(s) in tuple("bdfghklmnt") and len(x.w) >= 6):
        x.cut(s)
    s = x.longest(["end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"])
    if s and x.at(x.r2, s):
        if s in ("end", "ung"):
            x.cut(s)
            if x.at(x.r2, "ig") and x.before("ig") != "e":
                x.cut("ig")
        elif s in ("ig", "ik", "isch"):
            if x.before(s) != "e":
                x.cut(s)
        elif s in ("lich", "heit"):
            x.cut(s)
            x.drop(x.r1, "er", "en")
        else:
            x.cut(s)
            x.drop(x.r2, "lich", "ig")
    return x.w.translate(str.maketrans("UYäöü", "uyaou"))


# ---------------------------------------------------------------- Italian

IT_V = "aeiouàèìòù"
# Suffixes of the published algorithm.
IT_PRONOUN = _words("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
IT_PLAIN = _words("anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti")
IT_ATION = _words("azione azioni atore atori")
IT_OTHER = _words("logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive")
IT_VERB = _words("ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir")


def italian(word: str) -> str:
    w = unicodedata.normalize("NFC", word.lower()).translate(str.maketrans("áéíóú", "àèìòù"))
    w = w.replace("qu", "qU")
    x = Word(_mark_between_vowels(w, "ui", IT_V), IT_V)
    x.regions()
    x.romance_rv()
    s = x.longest(IT_PRONOUN)
    if s and x.at(x.rv, s):
        rest = x.w[: len(x.w) - len(s)]
        if rest.endswith(("ando", "endo")) and len(rest) - 4 >= x.rv:
            x.cut(s)
        elif rest.endswith(("ar", "er", "ir")) and len(rest) - 2 >= x.rv:
            x.cut(s, "e")
    before = x.w
    _italian_1(x)
    if x.w == before:
        s = x.longest(IT_VERB, x.rv)
        x.cut(s)
    if x.w[-1:] and x.w[-1] in "aeioàèìò" and x.at(x.rv, x.w[-1]):
        x.w = x.w[:-1]
        x.drop(x.rv, "i")
    if x.at(x.rv, "ch") or x.at(x.rv, "gh"):
        x.w = x.w[:-1]
    return x.w.replace("U", "u").replace("I", "i")


def _italian_1(x: Word) -> None:
    s = x.longest(IT_PLAIN + IT_ATION + IT_OTHER)
    if s == "amente":
        if x.drop(x.r1, s):
            if x.w.endswith("iv"):
                if x.drop(x.r2, "iv"):
                    x.drop(x.r2, "at")
            else:
                x.drop(x.r2, "abil", "os", "ic")
    elif s in ("amento", "amenti", "imento", "imenti"):
        x.drop(x.rv, s)
    elif not s or not x.at(x.r2, s):
        return
    elif s in IT_ATION:
        x.cut(s)
        x.drop(x.r2, "ic")
    elif s in ("logia", "logie"):
        x.cut(s, "log")
    elif s in ("uzione", "uzioni", "usione", "usioni"):
        x.cut(s, "u")
    elif s in ("enza", "enze"):
        x.cut(s, "te")  # as the library that results are held against has it
    elif s == "ità":
        x.cut(s)
        x.drop(x.r2, "abil", "ic", "iv")
    elif s in ("ivo", "ivi", "iva", "ive"):
        x.cut(s)
        if x.drop(x.r2, "at"):
            x.drop(x.r2, "ic")
    else:
        x.cut(s)


# ---------------------------------------------------------------- Portuguese

PT_V = "aeiouáéíóúâêô"
# Suffixes of the published algorithm.
PT_PLAIN = _words("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância ança anças")
PT_OTHER = _words("logia logias logía logías uça~o uço~es ución uciones ência ências amente mente idade idades iva ivo ivas ivos ira iras")
PT_VERB = _words("ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras")


def portuguese(word: str) -> str:
    w = unicodedata.normalize("NFC", word.lower()).replace("ã", "a~").replace("õ", "o~")
    x = Word(w, PT_V)
    x.regions()
    x.romance_rv()
    before = x.w
    _portuguese_1(x)
    changed = x.w != before
    if not changed:
        s = x.longest(PT_VERB, x.rv)
        x.cut(s)
        changed = bool(s)
    if changed:
        if x.at(x.rv, "i") and x.before("i") == "c":
            x.cut("i")
    else:
        x.cut(x.longest(["os", "a", "i", "o", "á", "í", "ó"], x.rv))
    if x.w[-1:] in ("e", "é", "ê") and x.at(x.rv, x.w[-1]):
        x.w = x.w[:-1]
        if x.w.endswith("gu") and x.at(x.rv, "u") or x.w.endswith("ci") and x.at(x.rv, "i"):
            x.w = x.w[:-1]
    elif x.w.endswith("ç"):
        x.cut("ç", "c")
    return x.w.replace("a~", "ã").replace("o~", "õ")


def _portuguese_1(x: Word) -> None:
    s = x.longest(PT_PLAIN + PT_OTHER)
    if s == "amente":
        if x.drop(x.r1, s):
            if x.w.endswith("iv"):
                if x.drop(x.r2, "iv"):
                    x.drop(x.r2, "at")
            else:
                x.drop(x.r2, "os", "ic", "ad")
    elif s in ("ira", "iras"):
        if x.at(x.rv, s) and x.before(s) == "e":
            x.cut(s, "ir")
    elif not s or not x.at(x.r2, s):
        return
    elif s[:3] == "log":
        x.cut(s, "log")
    elif s in ("uça~o", "uço~es", "ución", "uciones"):
        x.cut(s, "u")
    elif s in ("ência", "ências"):
        x.cut(s, "ente")
    elif s == "mente":
        x.cut(s)
        x.drop(x.r2, "ante", "avel", "ível")
    elif s in ("idade", "idades"):
        x.cut(s)
        x.drop(x.r2, "abil", "ic", "iv")
    elif s in ("iva", "ivo", "ivas", "ivos"):
        x.cut(s)
        x.drop(x.r2, "at")
    else:
        x.cut(s)


# ---------------------------------------------------------------- Spanish

ES_V = "aeiouáéíóúü"
# Suffixes of the published algorithm.
ES_PRONOUN = _words("me se sela selo selas selos la le lo las les los nos")
ES_PLAIN = _words("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos")
ES_ATION = _words("adora ador ación adoras adores aciones ante antes ancia ancias")
ES_OTHER = _words("logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos")
ES_Y = _words("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
ES_E = _words("en es éis emos")
ES_VERB = _words("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")
_ACUTE = str.maketrans("áéíóú", "aeiou")


def spanish(word: str) -> str:
    w = unicodedata.normalize("NFC", word.lower())
    x = Word(w, ES_V)
    x.regions()
    x.romance_rv()
    s = x.longest(ES_PRONOUN)
    if s and x.at(x.rv, s):
        rest = Word(x.w[: len(x.w) - len(s)], ES_V)
        verb = rest.longest(_words("iéndo ándo ár ér ír ando iendo ar er ir yendo"), x.rv)
        if verb and (verb != "yendo" or rest.before(verb) == "u"):
            x.cut(s)
            x.cut(verb, verb.translate(_ACUTE))
    before = x.w
    _spanish_1(x)
    if x.w == before:
        s = x.longest(ES_Y, x.rv)
        if s and x.before(s) == "u":
            x.cut(s)
        else:
            s = x.longest(ES_E + ES_VERB, x.rv)
            x.cut(s)
            if s in ES_E and x.w.endswith("gu"):
                x.cut("u")
    s = x.longest(["os", "a", "o", "á", "í", "ó", "e", "é"], x.rv)
    x.cut(s)
    if s in ("e", "é") and x.w.endswith("gu") and x.at(x.rv, "u"):
        x.cut("u")
    return x.w.translate(_ACUTE)


def _spanish_1(x: Word) -> None:
    s = x.longest(ES_PLAIN + ES_ATION + ES_OTHER)
    if s == "amente":
        if x.drop(x.r1, s):
            if x.w.endswith("iv"):
                if x.drop(x.r2, "iv"):
                    x.drop(x.r2, "at")
            else:
                x.drop(x.r2, "os", "ic", "ad")
    elif not s or not x.at(x.r2, s):
        return
    elif s in ES_ATION:
        x.cut(s)
        x.drop(x.r2, "ic")
    elif s in ("logía", "logías"):
        x.cut(s, "log")
    elif s in ("ución", "uciones"):
        x.cut(s, "u")
    elif s in ("encia", "encias"):
        x.cut(s, "ente")
    elif s == "mente":
        x.cut(s)
        x.drop(x.r2, "ante", "able", "ible")
    elif s in ("idad", "idades"):
        x.cut(s)
        x.drop(x.r2, "abil", "ic", "iv")
    elif s in ("iva", "ivo", "ivas", "ivos"):
        x.cut(s)
        x.drop(x.r2, "at")
    else:
        x.cut(s)


STEMMERS = {"porter": porter, "en": english, "fr": french, "de": german, "it": italian, "pt": portuguese, "es": spanish}


@lru_cache(maxsize=200_000)
def stem(language: str, word: str) -> str:
    return STEMMERS[language](word)
