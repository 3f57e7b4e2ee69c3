"""The stemmer word by word, after the published Snowball "English" (Porter 2) description: what tests compare with."""

from __future__ import annotations

# Fixed values of the published algorithm: letters, suffix rules and exceptions.
_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_BEFORE = frozenset("cdeghkmnrt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_PLURAL = frozenset((
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
))
_LONG_PREFIXES = ("gener", "commun", "arsen")
_STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
    ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""),
)
_STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion", "al", "er", "ic",
)


def _region(word: str, start: int) -> int:
    """Index just past the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return (
        len(word) > 2
        and word[-1] not in _VOWELS and word[-1] not in "wxY"
        and word[-2] in _VOWELS and word[-3] not in _VOWELS
    )


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if _has_vowel(word[:-2]) else word


def _past(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if not _has_vowel(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(_DOUBLES):
                return stem[:-1]
            return stem + "e" if r1 >= len(stem) and _ends_short(stem) else stem
    return word


def _derived(word: str, r1: int, r2: int) -> str:
    for suffix, new in _STEP_2:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = {"ogi": stem.endswith("l"), "li": stem[-1:] in _LI_BEFORE}.get(suffix, True)
            if len(stem) >= r1 and allowed:
                word = stem + new
            break
    for suffix, new in _STEP_3:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                word = word[:at] + new
            break
    for suffix in _STEP_4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if len(stem) >= r2 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    # A consonantal y is written Y, so that it counts as a consonant.
    word = "".join(
        "Y" if c == "y" and (i == 0 or word[i - 1] in _VOWELS and word[i - 1] != "y") else c
        for i, c in enumerate(word)
    )
    prefix = next((p for p in _LONG_PREFIXES if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)
    word = _plural(word)
    if word.lower() in _KEPT_AFTER_PLURAL:
        return word.lower()
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _ends_short(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
