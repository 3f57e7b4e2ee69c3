"""English stems after the published Snowball "English" (Porter 2) description, as column expressions.

Each step of the description is a projection of its own over a table of words, so a step reads what
the one before made and nothing is worked out twice. Meant for a dictionary of distinct words, which
is written: a filter on stems would otherwise be taken down through the steps, and grow with each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.sources.storage import materialize

# Fixed values of the published algorithm: suffix rules and exceptions.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
LONG_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic",
    "ness": "", "ful": "",
}
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion",
    "al", "er", "ic",
)
# A consonant after a vowel, from the start; a short syllable at the end; letters before -li.
REGION = "^.*?[aeiouy][^aeiouy]"
SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
LI_BEFORE = "[cdeghkmnrt]$"


# Every rule above and below is for a word with one of these endings, and so is every exception.
CHANGING = ("s", "ed", "ing", "y", "i", "e", "al", "ful", "ll", "ion", "ism", "er", "or", "ant", "ent", "ic")


def may_change(word: Column) -> Column:
    """Whether a lower-case word has an ending that some step looks for; a word without one is its own stem."""
    return reduce(lambda a, b: a | b, [word.endswith(ending) for ending in CHANGING])


def _without(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _region(word: Column) -> Column:
    """How many letters precede the region after the first consonant that follows a vowel."""
    found = F.length(F.regexp_extract(word, REGION, 0))
    return F.when(found > 0, found).otherwise(F.length(word))


def _suffix(word: Column, suffixes) -> Column:
    """The longest of the suffixes that the word ends with; '' where there is none."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _chosen(value: Column, choices: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, new in choices.items():
        out = F.when(value == key, new).otherwise(out)
    return out


def with_stems(words: DataFrame, column: str = "term", name: str = "stem") -> DataFrame:
    """``words`` with the stem of the lower-case word in ``column`` as ``name``, in place of a column so named."""
    kept = [F.col(f"`{c}`") for c in words.columns if c != name]
    term, w, r1, r2, s, stem = F.col(f"`{column}`"), F.col("__w"), F.col("__r1"), F.col("__r2"), F.col("__s"), F.col("__stem")
    regions, final = [r1, r2], F.col("__final")
    # A y that begins the word or follows a vowel is a consonant, written Y.
    marked = F.regexp_replace(F.regexp_replace(term, "^y", "Y"), "([aeiou])y", "$1Y")
    df = words.select(*kept, F.when(F.length(term) < 3, term).otherwise(_chosen(term, WHOLE)).alias("__final"), marked.alias("__w"))
    first = _region(w)
    for prefix in LONG_PREFIXES:
        first = F.when(w.startswith(prefix), len(prefix)).otherwise(first)
    df = df.select(*kept, final, w, first.alias("__r1"))
    df = df.select(*kept, final, w, r1, (r1 + _region(F.substr(w, r1 + 1))).alias("__r2"))
    # Plurals.
    plural = (
        F.when(w.endswith("sses"), _without(w, 2))
        .when(w.rlike("(ied|ies)$"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
        .when(w.rlike("[us]s$") | ~w.endswith("s") | ~_without(w, 2).rlike("[aeiouy]"), w)
        .otherwise(_without(w, 1))
    )
    df = df.select(*kept, final, plural.alias("__w"), *regions)
    df = df.select(*kept, F.coalesce(final, F.when(F.lower(w).isin(*KEPT_AFTER_PLURAL), F.lower(w))).alias("__final"), w, *regions)
    # -ed and -ing.
    df = df.select(*kept, final, w, *regions, F.coalesce(F.nullif(_suffix(w, ("eedly", "eed")), F.lit("")), _suffix(w, ("ingly", "edly", "ing", "ed"))).alias("__s"))
    df = df.select(*kept, final, w, *regions, s, _without(w, F.length(s)).alias("__stem"))
    past = (
        F.when(s == "", w)
        .when(s.startswith("eed"), F.when(F.length(stem) >= r1, F.concat(stem, F.lit("ee"))).otherwise(w))
        .when(~stem.rlike("[aeiouy]"), w)
        .when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE), _without(stem, 1))
        .when((r1 >= F.length(stem)) & stem.rlike(SHORT), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )
    df = df.select(*kept, final, past.alias("__w"), *regions)
    df = df.select(*kept, final, F.regexp_replace(w, "^(.+[^aeiouy])[yY]$", "$1i").alias("__w"), *regions)
    # Derivations.
    for rules in (STEP_2, STEP_3, dict.fromkeys(STEP_4, "")):
        df = df.select(*kept, final, w, *regions, _suffix(w, rules).alias("__s"))
        df = df.select(*kept, final, w, *regions, s, _without(w, F.length(s)).alias("__stem"))
        inside = F.length(stem) >= (r1 if rules in (STEP_2, STEP_3) else r2)
        if rules is STEP_2:
            inside = inside & ((s != "ogi") | stem.endswith("l")) & ((s != "li") | stem.rlike(LI_BEFORE))
        elif rules is STEP_3:
            inside = inside & ((s != "ative") | (F.length(stem) >= r2))
        else:
            inside = inside & ((s != "ion") | stem.rlike("[st]$"))
        df = df.select(*kept, final, F.when((s != "") & inside, F.concat(stem, _chosen(s, rules))).otherwise(w).alias("__w"), *regions)
    # A last e or l.
    short = _without(w, 1)
    ended = (
        F.when(w.endswith("e") & ((F.length(short) >= r2) | ((F.length(short) >= r1) & ~short.rlike(SHORT))), short)
        .when(w.endswith("ll") & (F.length(short) >= r2), short)
        .otherwise(w)
    )
    return materialize(df.select(*kept, F.coalesce(final, F.lower(ended)).alias(name)), "stems")
