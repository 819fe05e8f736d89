"""Stems of words by the published suffix rules of eleven languages.

A language is a list of tables. A table's line names endings, the region they
must lie in, a condition, and what stands instead of the ending. Of all endings
of a table the longest that the word has is taken, found by one lookup for each
length; its line then applies or not. Regions: R1 begins after the first other
letter behind a vowel, R2 is R1 of R1, RV goes by the language.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

KEPT = 200_000


@dataclass
class Word:
    """A word while it is cut: its letters, where its regions begin, and whether anything was changed."""

    s: str
    r1: int = 0
    r2: int = 0
    rv: int = 0
    marks: set[str] = field(default_factory=set)

    def put(self, ending: str, instead: str) -> None:
        self.s = self.s[: len(self.s) - len(ending)] + instead


Condition = Callable[[Word, str], bool]


@dataclass(frozen=True)
class Line:
    region: str
    condition: str
    instead: str


class Table:
    """Endings of one step: ``endings | region | condition | instead`` in each line, endings over several lines at will.

    ``within`` is a region to which the search itself is limited. A condition
    whose name begins with ``=`` changes the word itself.
    """

    def __init__(self, text: str, within: str = "", **conditions: Condition) -> None:
        self.within, self.conditions, self.lines = within, conditions, {}
        more = ""
        for row in text.splitlines():
            endings, *rest = (p.strip() for p in row.split("|"))
            more += " " + endings
            if rest:
                region, condition, instead = rest
                self.lines |= dict.fromkeys(more.split(), Line(region, condition, instead))
                more = ""
        self.longest = max(map(len, self.lines))

    def find(self, word: Word) -> str | None:
        room = len(word.s) - (getattr(word, self.within) if self.within else 0)
        for n in range(min(self.longest, room), 0, -1):
            if word.s[-n:] in self.lines:
                return word.s[-n:]
        return None

    def run(self, word: Word) -> bool:
        """Whether an ending's line applied."""
        ending = self.find(word)
        if ending is None:
            return False
        line = self.lines[ending]
        if line.region and len(word.s) - len(ending) < getattr(word, line.region):
            return False
        if line.condition and not self.conditions[line.condition](word, word.s[: len(word.s) - len(ending)]):
            return False
        if not line.condition.startswith("="):
            word.put(ending, line.instead)
        return True


def regions(s: str, vowels: str, least: int = 0) -> tuple[int, int]:
    """Where R1 and R2 begin; R1 has ``least`` letters before it, R2 goes by R1 before that."""

    def after(start: int) -> int:
        for i in range(start + 1, len(s)):
            if s[i] not in vowels and s[i - 1] in vowels:
                return i + 1
        return len(s)

    r1 = after(0)
    r2 = after(r1)
    return max(r1, least), r2


def _ends(*endings: str) -> Condition:
    return lambda _, rest: rest.endswith(endings)


def _undouble(word: Word, pairs: tuple[str, ...]) -> None:
    if word.s.endswith(pairs):
        word.s = word.s[:-1]


# --- Swedish, Norwegian, Danish. Their endings.

_SV = "aeiouyäåö"
_SV_TABLES = (
    Table("""a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast | | |
             s | | s |""", "r1", s=_ends(*"bcdfghjklmnoprtvy")),
    Table("dd gd nn dt gt kt tt | | =last |", "r1", **{"=last": lambda w, rest: w.put(w.s[-1], "") or True}),
    Table("lig ig els | | |\nlöst | | | lös\nfullt | | | full", "r1"),
)


def swedish(s: str) -> str:
    word = Word(s, regions(s, _SV, 3)[0])
    for table in _SV_TABLES:
        table.run(word)
    return word.s


_NO = "aeiouyæåø"
_NO_TABLES = (
    Table("""a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast | | |
             s | | s |
             erte ert | | | er""", "r1", s=lambda _, rest: rest.endswith(tuple("bcdfghjlmnoprtvyz")) or (rest[-1:] == "k" and rest[-2:-1] not in set(_NO) and len(rest) > 1)),
    Table("dt vt | | =last |", "r1", **{"=last": lambda w, rest: w.put(w.s[-1], "") or True}),
    Table("leg eleg ig eig lig elig els lov elov slov hetslov | | |", "r1"),
)


def norwegian(s: str) -> str:
    word = Word(s, regions(s, _NO, 3)[0])
    for table in _NO_TABLES:
        table.run(word)
    return word.s


_DA = "aeiouyæåø"
_DA_1 = Table("""hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret | | |
                 s | | s |""", "r1", s=_ends(*"abcdfghjklmnoprtvyzå"))  # fmt: skip
_DA_2 = Table("gd dt gt kt | | =last |", "r1", **{"=last": lambda w, rest: w.put(w.s[-1], "") or True})
_DA_3 = Table("ig lig elig els | | |\nløst | | | løs", "r1")


def danish(s: str) -> str:
    word = Word(s, regions(s, _DA, 3)[0])
    _DA_1.run(word)
    _DA_2.run(word)
    if word.s.endswith("igst"):
        word.s = word.s[:-2]
    ending = _DA_3.find(word)
    if _DA_3.run(word) and ending != "løst":
        _DA_2.run(word)
    if len(word.s) > max(word.r1, 1) and word.s[-1] == word.s[-2] and word.s[-1] not in _DA:
        word.s = word.s[:-1]
    return word.s


# --- English. Its endings and the words that go their own way.

_EN = "aeiouy"
_EN_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_has_vowel: Condition = lambda _, rest: any(c in _EN for c in rest)
_EN_1A = Table("""sses | | | ss
                  us ss | | =no |
                  s | | early |""", early=lambda _, rest: any(c in _EN for c in rest[:-1]), **{"=no": lambda *_: False})  # fmt: skip
_EN_1B = Table("eed eedly | r1 | | ee\ned edly ing ingly | | vowel |", vowel=_has_vowel)
_EN_2 = Table("""tional | r1 | | tion
                 enci | r1 | | ence
                 anci | r1 | | ance
                 abli | r1 | | able
                 entli | r1 | | ent
                 izer ization | r1 | | ize
                 ational ation ator | r1 | | ate
                 alism aliti alli | r1 | | al
                 fulness fulli | r1 | | ful
                 ousli ousness | r1 | | ous
                 iveness iviti | r1 | | ive
                 biliti bli | r1 | | ble
                 ogi | r1 | l | og
                 lessli | r1 | | less
                 li | r1 | li |""", l=_ends("l"), li=_ends(*"cdeghkmnrt"))  # fmt: skip
_EN_3 = Table("""tional | r1 | | tion
                 ational | r1 | | ate
                 alize | r1 | | al
                 icate iciti ical | r1 | | ic
                 ful ness | r1 | |
                 ative | r2 | |""")  # fmt: skip
_EN_4 = Table("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize | r2 | |\nion | r2 | st |", st=_ends("s", "t"))


def _short_syllable(s: str) -> bool:
    if len(s) == 2:
        return s[0] in _EN and s[1] not in _EN
    return len(s) > 2 and s[-1] not in _EN + "wxY" and s[-2] in _EN and s[-3] not in _EN


def english(s: str) -> str:
    if len(s) < 3:
        return s
    if s in _EN_WHOLE:
        return _EN_WHOLE[s]
    s = s.removeprefix("'")
    s = re.sub(f"(?:^|(?<=[{_EN}]))y", "Y", s)
    r1, r2 = regions(s, _EN)
    for start in ("gener", "commun", "arsen"):
        if s.startswith(start):
            r1 = len(start)
            r2 = next((i + 1 for i in range(r1 + 1, len(s)) if s[i] not in _EN and s[i - 1] in _EN), len(s))
    word = Word(s, r1, r2)
    for end in ("'s'", "'s", "'"):
        if word.s.endswith(end):
            word.put(end, "")
            break
    if word.s.endswith(("ied", "ies")):
        word.put("ies", "i" if len(word.s) > 4 else "ie")
    else:
        _EN_1A.run(word)
    if word.s.lower() in _EN_KEPT:
        return word.s.lower()
    ending = _EN_1B.find(word)
    if _EN_1B.run(word) and ending in ("ed", "edly", "ing", "ingly"):
        if word.s.endswith(("at", "bl", "iz")):
            word.s += "e"
        elif word.s.endswith(_EN_DOUBLES):
            word.s = word.s[:-1]
        elif word.r1 >= len(word.s) and _short_syllable(word.s):
            word.s += "e"
    if len(word.s) > 2 and word.s[-1] in "yY" and word.s[-2] not in _EN:
        word.put("y", "i")
    for table in (_EN_2, _EN_3, _EN_4):
        table.run(word)
    if word.s.endswith("e"):
        at = len(word.s) - 1
        if at >= word.r2 or (at >= word.r1 and not _short_syllable(word.s[:-1])):
            word.s = word.s[:-1]
    elif word.s.endswith("ll") and len(word.s) - 1 >= word.r2:
        word.s = word.s[:-1]
    return word.s.lower()


# --- German. Its endings.

_DE = "aeiouyäöü"
_DE_1 = Table("""ern em er | r1 | |
                 e en es | r1 | |
                 s | r1 | s |""", s=_ends(*"bdfghklmnrt"))  # fmt: skip
_DE_2 = Table("en er est | r1 | |\nst | r1 | st |", st=lambda _, rest: len(rest) > 3 and rest[-1] in "bdfghklmnt")
_no_e: Condition = lambda _, rest: not rest.endswith("e")
_DE_3 = Table("""end ung | r2 | |
                 ig ik isch | r2 | e |
                 lich heit | r2 | |
                 keit | r2 | |""", e=_no_e)  # fmt: skip


def german(s: str) -> str:
    s = s.replace("ß", "ss")
    s = re.sub(f"(?<=[{_DE}])([uy])(?=[{_DE}])", lambda m: m[1].upper(), s)
    word = Word(s, *regions(s, _DE, 3))
    ending = _DE_1.find(word)
    if _DE_1.run(word) and ending in ("e", "en", "es") and word.s.endswith("niss"):
        word.s = word.s[:-1]
    _DE_2.run(word)
    ending = _DE_3.find(word)
    if _DE_3.run(word):
        again = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(ending, ())
        more = next((e for e in again if word.s.endswith(e)), None)
        region = word.r1 if ending in ("lich", "heit") else word.r2
        if more and len(word.s) - len(more) >= region and not (ending in ("end", "ung") and word.s[: -len(more)].endswith("e")):
            word.put(more, "")
    return word.s.lower().translate(str.maketrans("äöü", "aou"))


# --- Dutch. Its endings.

_NL = "aeiouyè"
_NL_DOUBLES = ("kk", "dd", "tt")
_nl_en: Condition = lambda _, rest: rest[-1:] not in ("", *_NL) and not rest.endswith("gem")
_NL_1 = Table("heden | r1 | | heid\nene en | r1 | en |\nse s | r1 | s |", en=_nl_en, s=lambda _, rest: rest[-1:] not in ("", "j", *_NL))
_NL_3A = Table("heid | r2 | c |", c=lambda _, rest: not rest.endswith("c"))
_NL_3B = Table("end ing | r2 | |\nig | r2 | e |\nlijk baar | r2 | |\nbar | r2 | cut |", e=_no_e, cut=lambda w, _: "e" in w.marks)


def _dutch_e(word: Word) -> None:
    if word.s.endswith("e") and len(word.s) - 1 >= word.r1 and word.s[-2:-1] not in ("", *_NL):
        word.s = word.s[:-1]
        word.marks.add("e")
        _undouble(word, _NL_DOUBLES)


def dutch(s: str) -> str:
    s = s.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    s = re.sub(f"(?:^|(?<=[{_NL}]))y|(?<=[{_NL}])i(?=[{_NL}])", lambda m: m[0].upper(), s)
    word = Word(s, *regions(s, _NL, 3))
    ending = _NL_1.find(word)
    if _NL_1.run(word) and ending in ("en", "ene"):
        _undouble(word, _NL_DOUBLES)
    _dutch_e(word)
    if _NL_3A.run(word) and word.s.endswith("en") and len(word.s) - 2 >= word.r1 and _nl_en(word, word.s[:-2]):
        word.s = word.s[:-2]
        _undouble(word, _NL_DOUBLES)
    ending = _NL_3B.find(word)
    if _NL_3B.run(word):
        if ending in ("end", "ing"):
            if word.s.endswith("ig") and len(word.s) - 2 >= word.r2 and word.s[-3:-2] != "e":
                word.s = word.s[:-2]
            else:
                _undouble(word, _NL_DOUBLES)
        elif ending == "lijk":
            _dutch_e(word)
    if len(word.s) > 3 and word.s[-1] not in _NL + "I" and word.s[-3:-1] in ("aa", "ee", "oo", "uu") and word.s[-4] not in _NL:
        word.s = word.s[:-2] + word.s[-1]
    return word.s.lower()


# --- Russian. Its endings.

_RU = "аеиоуыэюя"
_after_a: Condition = lambda w, rest: rest.endswith(("а", "я")) and len(rest) - 1 >= w.rv
_RU_GERUND = Table("в вши вшись | | a |\nив ивши ившись ыв ывши ывшись | | |", "rv", a=_after_a)
_RU_REFLEXIVE = Table("ся сь | | |", "rv")
_RU_ADJECTIVE = Table("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею | | |", "rv")
_RU_PARTICIPLE = Table("ем нн вш ющ щ | | a |\nивш ывш ующ | | |", "rv", a=_after_a)
_RU_VERB = Table("""ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно | | a |
                    ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю | | |""", "rv", a=_after_a)  # fmt: skip
_RU_NOUN = Table("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я | | |", "rv")
_RU_DERIVED = Table("ост ость | r2 | |", "rv")


def russian(s: str) -> str:
    s = s.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(s) if c in _RU), len(s))
    word = Word(s, *regions(s, _RU), rv)
    if not _RU_GERUND.run(word):
        _RU_REFLEXIVE.run(word)
        if _RU_ADJECTIVE.run(word):
            _RU_PARTICIPLE.run(word)
        elif not _RU_VERB.run(word):
            _RU_NOUN.run(word)
    if word.s.endswith("и") and len(word.s) - 1 >= word.rv:
        word.s = word.s[:-1]
    _RU_DERIVED.run(word)
    for end, instead in (("ейше", ""), ("ейш", "")):
        if word.s.endswith(end) and len(word.s) - len(end) >= word.rv:
            word.put(end, instead)
            if word.s.endswith("нн"):
                word.s = word.s[:-1]
            return word.s
    if len(word.s) - 2 >= word.rv and word.s.endswith("нн"):
        word.s = word.s[:-1]
    elif word.s.endswith("ь") and len(word.s) - 1 >= word.rv:
        word.s = word.s[:-1]
    return word.s


# --- Romance languages: RV by the second letter.


def _rv(s: str, vowels: str) -> int:
    if len(s) < 2:
        return len(s)
    if s[1] not in vowels:
        return next((i + 1 for i in range(2, len(s)) if s[i] in vowels), len(s))
    if s[0] in vowels:
        return next((i + 1 for i in range(2, len(s)) if s[i] not in vowels), len(s))
    return min(3, len(s))


# The endings of Spanish.
_ES = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUN = Table("me se sela selo selas selos la le lo las les los nos | | |", "rv")
_ES_1 = Table("""anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos | r2 | |
                 adora ador ación adoras adores aciones ante antes ancia ancias | r2 | |
                 logía logías | r2 | | log
                 ución uciones | r2 | | u
                 encia encias | r2 | | ente
                 amente | r1 | |
                 mente | r2 | |
                 idad idades | r2 | |
                 iva ivo ivas ivos | r2 | |""")  # fmt: skip
_ES_AFTER = {
    "amente": (("iv", "at"), ("os",), ("ic",), ("ad",)), "mente": (("ante",), ("able",), ("ible",)),
    "idad": (("abil",), ("ic",), ("iv",)), "iv": (("at",),), "ad": (("ic",),),
}
_ES_Y = Table("ya ye yan yen yeron yendo yo yó yas yes yais yamos | | u |", "rv", u=_ends("u"))
_ES_VERB = Table("""en es éis emos | | |
    arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
    aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
    aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos | | |""", "rv")  # fmt: skip
_ES_LAST = Table("os a o á í ó e é | rv | |")


def spanish(s: str) -> str:
    word = Word(s, *regions(s, _ES), _rv(s, _ES))
    pronoun = _ES_PRONOUN.find(word)
    if pronoun:
        rest = word.s[: -len(pronoun)]
        strong = next((e for e in ("iéndo", "ándo", "ár", "ér", "ír") if rest.endswith(e)), None)
        weak = next((e for e in ("iendo", "ando", "ar", "er", "ir") if rest.endswith(e)), None)
        if strong and len(rest) - len(strong) >= word.rv:
            word.s = rest[: -len(strong)] + strong.translate(_ES_PLAIN)
        elif (weak and len(rest) - len(weak) >= word.rv) or (rest.endswith("uyendo") and len(rest) - 5 >= word.rv):
            word.s = rest
    ending = _ES_1.find(word)
    if _ES_1.run(word):
        kind = "ad" if ending in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias") else "iv" if ending in ("iva", "ivo", "ivas", "ivos") else "idad" if ending == "idades" else ending
        for first, *then in _ES_AFTER.get(kind, ()):
            if word.s.endswith(first) and len(word.s) - len(first) >= word.r2:
                word.put(first, "")
                for more in then:
                    if word.s.endswith(more) and len(word.s) - len(more) >= word.r2:
                        word.put(more, "")
                break
    elif not _ES_Y.run(word):
        ending = _ES_VERB.find(word)
        if _ES_VERB.run(word) and ending in ("en", "es", "éis", "emos") and word.s.endswith("gu"):
            word.s = word.s[:-1]
    ending = _ES_LAST.find(word)
    if _ES_LAST.run(word) and ending in ("e", "é") and word.s.endswith("gu") and len(word.s) - 1 >= word.rv:
        word.s = word.s[:-1]
    return word.s.translate(_ES_PLAIN)


# The endings of Portuguese.
_PT = "aeiouáéíóúâêô"
_PT_1 = Table("""eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância | r2 | |
                 logia logias | r2 | | log
                 uça~o uço~es | r2 | | u
                 ência ências | r2 | | ente
                 amente | r1 | |
                 mente | r2 | |
                 idade idades | r2 | |
                 iva ivo ivas ivos | r2 | |
                 ira iras | rv | e | ir""", e=_ends("e"))  # fmt: skip
_PT_AFTER = {"amente": (("iv", "at"), ("os",), ("ic",), ("ad",)), "mente": (("ante",), ("avel",), ("ível",)), "idade": (("abil",), ("ic",), ("iv",)), "iv": (("at",),)}
_PT_VERB = Table("""ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem
    ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis
    aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos
    imos armos ermos irmos eu iu ou ira iras | | |""", "rv")  # fmt: skip
_PT_LAST = Table("os a i o á í ó | rv | |")


def portuguese(s: str) -> str:
    s = s.replace("ã", "a~").replace("õ", "o~")
    word = Word(s, *regions(s, _PT), _rv(s, _PT))
    before = word.s
    ending = _PT_1.find(word)
    if _PT_1.run(word):
        kind = "iv" if ending in ("iva", "ivo", "ivas", "ivos") else "idade" if ending == "idades" else ending
        for first, *then in _PT_AFTER.get(kind, ()):
            if word.s.endswith(first) and len(word.s) - len(first) >= word.r2:
                word.put(first, "")
                for more in then:
                    if word.s.endswith(more) and len(word.s) - len(more) >= word.r2:
                        word.put(more, "")
                break
    else:
        _PT_VERB.run(word)
    if word.s != before:
        if word.s.endswith("ci") and len(word.s) - 1 >= word.rv:
            word.s = word.s[:-1]
    else:
        _PT_LAST.run(word)
    if word.s.endswith(("e", "é", "ê")) and len(word.s) - 1 >= word.rv:
        word.s = word.s[:-1]
        if word.s.endswith(("gu", "ci")) and len(word.s) - 1 >= word.rv:
            word.s = word.s[:-1]
    elif word.s.endswith("ç"):
        word.s = word.s[:-1] + "c"
    return word.s.replace("a~", "ã").replace("o~", "õ")


# The endings of Italian.
_IT = "aeiouàèìòù"
_IT_PRONOUN = Table("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene | | |", "rv")
_IT_1 = Table("""anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti | r2 | |
                 azione azioni atore atori | r2 | |
                 logia logie | r2 | | log
                 uzione uzioni usione usioni | r2 | | u
                 enza enze | r2 | | ente
                 amento amenti imento imenti | rv | |
                 amente | r1 | |
                 ità | r2 | |
                 ivo ivi iva ive | r2 | |""")  # fmt: skip
_IT_AFTER = {"azione": (("ic",),), "amente": (("iv", "at"), ("os",), ("ic",), ("abil",)), "ità": (("abil",), ("ic",), ("iv",)), "ivo": (("at", "ic"),)}
_IT_VERB = Table("""ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero
    ete eva evamo evano evate evi evo iamo iate ii immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo
    ono uta ute uti uto ar ir | | |""", "rv")  # fmt: skip


def italian(s: str) -> str:
    s = s.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    s = re.sub(f"(?<=[{_IT}])([ui])(?=[{_IT}])", lambda m: m[1].upper(), s)
    word = Word(s, *regions(s, _IT), _rv(s, _IT))
    pronoun = _IT_PRONOUN.find(word)
    if pronoun:
        rest = word.s[: -len(pronoun)]
        if rest.endswith(("ando", "endo")) and len(rest) - 4 >= word.rv:
            word.s = rest
        elif rest.endswith(("ar", "er", "ir")) and len(rest) - 2 >= word.rv:
            word.s = rest + "e"
    ending = _IT_1.find(word)
    if _IT_1.run(word):
        kind = "azione" if ending in ("azione", "azioni", "atore", "atori") else "ivo" if ending in ("ivo", "ivi", "iva", "ive") else ending
        for first, *then in _IT_AFTER.get(kind, ()):
            if word.s.endswith(first) and len(word.s) - len(first) >= word.r2:
                word.put(first, "")
                for more in then:
                    if word.s.endswith(more) and len(word.s) - len(more) >= word.r2:
                        word.put(more, "")
                break
    else:
        _IT_VERB.run(word)
    if word.s[-1:] in tuple("aeioàèìò") and len(word.s) - 1 >= word.rv:
        word.s = word.s[:-1]
        if word.s.endswith("i") and len(word.s) - 1 >= word.rv:
            word.s = word.s[:-1]
    if word.s.endswith(("ch", "gh")) and len(word.s) - 2 >= word.rv:
        word.s = word.s[:-1]
    return word.s.lower()


# The endings of French.
_FR = "aeiouyâàëéêèïîôûù"
_FR_1 = Table("""ance iqUe isme able iste eux ances iqUes ismes ables istes | r2 | |
                 atrice ateur ation atrices ateurs ations | r2 | |
                 logie logies | r2 | | log
                 usion ution usions utions | r2 | | u
                 ence ences | r2 | | ent
                 ement ements | rv | |
                 ité ités | r2 | |
                 if ive ifs ives | r2 | |
                 eaux | | | eau
                 aux | r1 | | al
                 euse euses | r1 | | eux
                 issement issements | r1 | c |
                 amment | rv | | ant
                 emment | rv | | ent
                 ment ments | | v |""", c=lambda _, rest: rest[-1:] not in ("", *_FR), v=lambda w, rest: rest[-1:] in tuple(_FR) and len(rest) - 1 >= w.rv)  # fmt: skip
_FR_I = Table("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it | | c |", "rv", c=lambda w, rest: rest[-1:] not in ("", "H", *_FR) and len(rest) - 1 >= w.rv)
_FR_VERB = Table("""ions | r2 | |
    é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez | | |
    âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions | | |""", "rv")  # fmt: skip
_FR_A = ("â", "a")


def french(s: str) -> str:
    s = re.sub(f"(?<=[{_FR}])([ui])(?=[{_FR}])", lambda m: m[1].upper(), s)
    s = re.sub(f"(?<=[{_FR}])y|y(?=[{_FR}])", "Y", s).replace("qu", "qU")
    s = s.replace("ë", "He").replace("ï", "Hi")
    r1, r2 = regions(s, _FR)
    if s.startswith(("par", "col", "tap")):
        rv = 3
    elif len(s) > 1 and s[0] in _FR and s[1] in _FR:
        rv = min(3, len(s))
    else:
        rv = next((i + 1 for i in range(1, len(s)) if s[i] in _FR), len(s))
    word = Word(s, r1, r2, rv)
    inside = lambda end, at: word.s.endswith(end) and len(word.s) - len(end) >= at
    ending, done = _FR_1.find(word), _FR_1.run(word)
    verb_next = not done
    if done:
        if ending in ("amment", "emment", "ment", "ments"):
            verb_next = True
        elif ending in ("euse", "euses") and inside("eux", word.r2):
            word.put("eux", "")
        elif ending.startswith(("atrice", "ateur", "ation")):
            if word.s.endswith("ic"):
                word.put("ic", "" if inside("ic", word.r2) else "iqU")
        elif ending.startswith("ement"):
            if inside("iv", word.r2):
                word.put("iv", "")
                if inside("at", word.r2):
                    word.put("at", "")
            elif word.s.endswith("eus"):
                if inside("eus", word.r2):
                    word.put("eus", "")
                elif inside("eus", word.r1):
                    word.put("eus", "eux")
            elif inside("abl", word.r2) or inside("iqU", word.r2):
                word.s = word.s[:-3]
            elif inside("ièr", word.rv) or inside("Ièr", word.rv):
                word.s = word.s[:-3] + "i"
        elif ending.startswith("ité"):
            if word.s.endswith("abil"):
                word.put("abil", "" if inside("abil", word.r2) else "abl")
            elif word.s.endswith("ic"):
                word.put("ic", "" if inside("ic", word.r2) else "iqU")
            elif inside("iv", word.r2):
                word.put("iv", "")
        elif ending in ("if", "ive", "ifs", "ives") and inside("at", word.r2):
            word.put("at", "")
            if word.s.endswith("ic"):
                word.put("ic", "" if inside("ic", word.r2) else "iqU")
    if verb_next:
        before = word.s
        if not _FR_I.run(word):
            ending = _FR_VERB.find(word)
            if _FR_VERB.run(word):
                done = True
                if ending.startswith(_FR_A) and inside("e", word.rv):
                    word.s = word.s[:-1]
        done = done or word.s != before
    if done:
        if word.s.endswith("Y"):
            word.s = word.s[:-1] + "i"
        elif word.s.endswith("ç"):
            word.s = word.s[:-1] + "c"
    else:
        if len(word.s) > 1 and word.s.endswith("s") and (word.s.endswith("His") or word.s[-2:-1] not in tuple("aiouès")):
            word.s = word.s[:-1]
        if inside("ion", word.r2) and word.s[-4:-3] in ("s", "t") and len(word.s) - 4 >= word.rv:
            word.s = word.s[:-3]
        elif next((e for e in ("Ière", "ière", "Ier", "ier") if inside(e, word.rv)), None):
            end = next(e for e in ("Ière", "ière", "Ier", "ier") if inside(e, word.rv))
            word.put(end, "i")
        elif inside("e", word.rv):
            word.s = word.s[:-1]
    if word.s.endswith(("enn", "onn", "ett", "ell", "eill")):
        word.s = word.s[:-1]
    word.s = re.sub(f"[éè](?=[^{_FR}]+$)", "e", word.s)
    return word.s.replace("He", "ë").replace("Hi", "ï").lower()


STEMMERS: dict[str, Callable[[str], str]] = {
    "en": english, "de": german, "nl": dutch, "fr": french, "es": spanish, "pt": portuguese, "it": italian, "ru": russian, "sv": swedish, "no": norwegian, "da": danish,
}


class Stems:
    """Stems of distinct words: each is cut once and kept, the oldest half forgotten when there are ``KEPT``."""

    def __init__(self) -> None:
        self.known: dict[tuple[str | None, str], str] = {}

    def of(self, code: str | None, word: str) -> str:
        found = self.known.get((code, word))
        if found is None:
            if len(self.known) >= KEPT:
                for old in list(self.known)[: KEPT // 2]:
                    del self.known[old]
            found = self.known[code, word] = STEMMERS[code](word) if code in STEMMERS else word
        return found


_stems = Stems()


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series, codes: pd.Series) -> pd.Series:
    """The stem of every word of an array, by the language's rules; words of other languages stay as they are."""
    return pd.Series([None if w is None else [_stems.of(c, x) for x in w] for w, c in zip(words, codes, strict=True)])
