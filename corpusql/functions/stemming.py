"""English stems as column expressions: stop words, and the suffix rules of the second Porter algorithm.

``stemmed`` is one expression without a Python worker. Each step is bound to a lambda's variable, so that no step's
expression is written out (and run) more than once. Stem the distinct words of a corpus, not each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of full-text search.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now""".split()

# Fixed values of the algorithm: whole words, words that stay after the plural step, beginnings with a region of their own.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
BEGIN = ["gener", "commun", "arsen"]
#: Suffix and what it becomes in the first region; {x} before a suffix is what must stand before it.
SECOND = [
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"),
    ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
]
THIRD = [("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
BEFORE = {"ogi": "l", "li": "[cdeghkmnrt]", "ion": "[st]"}

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT_END = f"(^{_VOWEL}{_OTHER}$)|({_OTHER}{_VOWEL}[^aeiouywxY]$)"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then).getItem(0)


def _without(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _region(w: Column, begin: str = "") -> Column:
    """Characters up to the end of the first vowel and non-vowel that follow each other; all of them where there are none."""
    found = F.regexp_extract(w, f"^({begin}.*?{_VOWEL}{_OTHER})", 1)
    return F.when(found == "", F.length(w)).otherwise(F.length(found))


def _rules(w: Column, start: Column | Callable[[str], Column], rules: list[tuple[str, str]]) -> Column:
    """The longest suffix that fits is replaced if it lies behind ``start`` and what must stand before it does."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        behind = F.length(w) - len(suffix) >= (start(suffix) if callable(start) else start)
        if suffix in BEFORE:
            behind &= w.rlike(f"{BEFORE[suffix]}{suffix}$")
        value = F.when(behind, F.concat(_without(w, len(suffix)), F.lit(new))).otherwise(w)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(w)


def _plural(w: Column) -> Column:
    return (
        F.when(w.endswith("sses"), _without(w, 2))
        .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _without(w, 2)).otherwise(_without(w, 1)))
        .when(w.rlike("[us]s$"), w)
        .when(w.rlike(f"{_VOWEL}.+s$"), _without(w, 1))
        .otherwise(w)
    )


def _past(w: Column, one: Column) -> Column:
    """Ends of verbs: eed, ed, ing and their adverbs."""

    def mended(base: Column) -> Column:
        short = (F.length(base) <= one) & base.rlike(_SHORT_END)
        return F.when(base.rlike("(at|bl|iz)$"), F.concat(base, F.lit("e"))).when(base.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(base, 1)).when(short, F.concat(base, F.lit("e"))).otherwise(base)

    cut = lambda n: F.when(_without(w, n).rlike(_VOWEL), _let(_without(w, n), mended)).otherwise(w)
    behind = lambda n: F.length(w) - n >= one
    return (
        F.when(w.endswith("eedly"), F.when(behind(5), _without(w, 3)).otherwise(w))
        .when(w.endswith("eed"), F.when(behind(3), _without(w, 1)).otherwise(w))
        .when(w.endswith("ingly"), cut(5))
        .when(w.endswith("edly"), cut(4))
        .when(w.endswith("ing"), cut(3))
        .when(w.endswith("ed"), cut(2))
        .otherwise(w)
    )


def _last(w: Column, one: Column, two: Column) -> Column:
    n = F.length(w) - 1
    e = (n >= two) | ((n >= one) & ~_without(w, 1).rlike(_SHORT_END))
    return F.when(w.endswith("e"), F.when(e, _without(w, 1)).otherwise(w)).when(w.endswith("ll") & (n >= two), _without(w, 1)).otherwise(w)


def _steps(w: Column) -> Column:
    begin = F.regexp_extract(w, f"^({'|'.join(BEGIN)})", 1)
    one = F.when(begin != "", F.length(begin)).otherwise(_region(w))

    def regions(p1: Column) -> Column:
        p2 = p1 + _region(F.substring(w, p1 + 1, F.lit(1 << 20)))
        return _let(p2, lambda two: rest(p1, two))

    def rest(p1: Column, p2: Column) -> Column:
        def after_plural(v: Column) -> Column:
            y = lambda x: F.when(x.rlike(f".{_OTHER}[yY]$"), F.concat(_without(x, 1), F.lit("i"))).otherwise(x)
            third = lambda x: _rules(x, lambda s: p2 if s == "ative" else p1, THIRD)
            fourth = lambda x: _rules(x, p2, [(s, "") for s in FOURTH])
            more = _let(_past(v, p1), lambda a: _let(y(a), lambda b: _let(_rules(b, p1, SECOND), lambda c: _let(third(c), lambda d: _let(fourth(d), lambda e: _last(e, p1, p2))))))
            return F.when(v.isin(*STAY), v).otherwise(more)

        return _let(_plural(w), after_plural)

    return F.lower(_let(one, regions))


def stemmed(word: Column) -> Column:
    """The stem of a lower-case English word; null of null."""

    def of(w: Column) -> Column:
        whole = F.create_map(*(F.lit(x) for pair in WHOLE.items() for x in pair))
        marked = F.regexp_replace(w, f"(^|{_VOWEL})y", "$1Y")  # a y at the beginning or after a vowel is none itself
        return F.when(F.length(w) <= 2, w).otherwise(F.coalesce(F.try_element_at(whole, w), _let(marked, _steps)))

    return _let(word, of)


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)
