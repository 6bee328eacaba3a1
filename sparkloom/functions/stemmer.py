"""The Spanish stemmer of the Snowball family, from its published description."""

from __future__ import annotations

VOWELS = set("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")

# The endings of the published algorithm.
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
AFTER_ACCENT = ("iéndo", "ándo", "ár", "ér", "ír")
AFTER_PLAIN = ("iendo", "ando", "ar", "er", "ir")
DROPPED = tuple("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split())
AFTER_IC = tuple("adora ador ación adoras adores aciones ante antes ancia ancias".split())
LOGIA, UCION, ENCIA = ("logía", "logías"), ("ución", "uciones"), ("encia", "encias")
STANDARD = (*DROPPED, *AFTER_IC, *LOGIA, *UCION, *ENCIA, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos")
Y_VERBS = tuple("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
E_VERBS = ("en", "es", "éis", "emos")
VERBS = tuple((
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré"
    " irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran"
    " ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais"
    " aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()) + E_VERBS


def _after(word: str, start: int) -> int:
    """Where the region after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _longest(word: str, endings: tuple[str, ...], start: int) -> str:
    """The longest ending that lies in the region from `start`."""
    if not word.endswith(endings):  # most words have none
        return ""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default="")


def _cut(word: str, endings: tuple[str, ...], start: int) -> str:
    found = _longest(word, endings, start)
    return word[: len(word) - len(found)] if found else word


def _pronoun(word: str, rv: int) -> str:
    found = _longest(word, PRONOUNS, 0)
    if not found or len(word) - len(found) < rv:
        return word
    rest = word[: len(word) - len(found)]
    if _longest(rest, AFTER_ACCENT, rv):
        ending = _longest(rest, AFTER_ACCENT, rv)
        return rest[: len(rest) - len(ending)] + ending.translate(_PLAIN)
    if _longest(rest, AFTER_PLAIN, rv) or (rest.endswith("yendo") and len(rest) - 5 >= rv and rest[-6:-5] == "u"):
        return rest
    return word


def _standard(word: str, r1: int, r2: int) -> str:
    found = _longest(word, STANDARD, 0)
    if not found:
        return word
    at = len(word) - len(found)
    rest = word[:at]
    if found == "amente":
        if at < r1:
            return word
        if rest.endswith("iv") and at - 2 >= r2:
            return _cut(rest[:-2], ("at",), r2)
        return _cut(rest, ("os", "ic", "ad"), r2)
    if at < r2:
        return word
    if found in AFTER_IC:
        return _cut(rest, ("ic",), r2)
    if found in LOGIA:
        return rest + "log"
    if found in UCION:
        return rest + "u"
    if found in ENCIA:
        return rest + "ente"
    if found == "mente":
        return _cut(rest, ("ante", "able", "ible"), r2)
    if found in ("idad", "idades"):
        return _cut(rest, ("abil", "ic", "iv"), r2)
    if found in ("iva", "ivo", "ivas", "ivos"):
        return _cut(rest, ("at",), r2)
    return rest


def _verb(word: str, rv: int) -> str:
    found = _longest(word, Y_VERBS, rv)
    if found and word[: len(word) - len(found)].endswith("u"):
        return word[: len(word) - len(found)]
    found = _longest(word, VERBS, rv)
    if not found:
        return word
    rest = word[: len(word) - len(found)]
    return rest[:-1] if found in E_VERBS and rest.endswith("gu") else rest


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    rv, r1 = _rv(word), _after(word, 0)
    r2 = _after(word, r1) if r1 < len(word) else len(word)
    word = _pronoun(word, rv)
    shorter = _standard(word, r1, r2)
    word = shorter if shorter != word else _verb(word, rv)
    found = _longest(word, ("os", "a", "o", "á", "í", "ó"), rv)
    if found:
        word = word[: len(word) - len(found)]
    elif _longest(word, ("e", "é"), rv):
        word = word[:-1]
        if word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_PLAIN)
