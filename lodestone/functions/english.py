"""English analysis: a stop list and the Porter2 stemmer as published."""

from __future__ import annotations

import re

# Words that carry no meaning of their own in a search.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s t
can will just don should now
""".split()
_STOP = frozenset(STOP_WORDS)

# Words with stems of their own, and words left alone once a plural is gone.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Suffixes of steps 2, 3 and 4 with what replaces them.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful",
    "lessli": "less", "ogi": "og", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_V = "[aeiouy]"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again after that."""
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if r1 is None:
        m = _REGION.search(word)
        r1 = m.end() if m else len(word)
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(_SHORT_END.search(word))


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    if not end or not re.search(_V, w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(_DOUBLES):
        return w[:-1]
    return w + "e" if _short(w, r1) else w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = _plural(re.sub(r"'(?:s'?)?$", "", w))
    if w in KEPT:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        rest = w[: -len(end)]
        if end == "ogi":
            w = rest + "og" if rest.endswith("l") else w
        elif end == "li":
            w = rest if rest[-1:] in tuple("cdeghkmnrt") else w
        else:
            w = rest + STEP2[end]

    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]

    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]

    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_TOKEN = re.compile(r"[a-z0-9]+")


def analyse(text: str, memory: dict[str, str] | None = None) -> list[str]:
    """Stems of a text's words, stop words left out."""
    memory = {} if memory is None else memory
    out = []
    for t in _TOKEN.findall(text.lower()):
        if t in _STOP:
            continue
        s = memory.get(t)
        if s is None:
            s = memory[t] = stem(t)
        out.append(s)
    return out
