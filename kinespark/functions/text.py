"""Names, tokens, similarities and formatted sentences as column expressions; Python only where matching needs it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_name(name: Column) -> Column:
    """Lower case, other than a-z, 0-9 and white space to spaces, collapsed and trimmed; null as empty."""
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9\\s]", " ")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


#: Music symbols of subtitles; fixed values.
MUSIC = "♪♫♬♩♭♮♯"


def clean_text(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), MUSIC, "")
    out = F.regexp_replace(out, "(?U)[^\\w\\s.,!?:;\\-'\"()\\[\\]]", "")
    out = F.trim(F.regexp_replace(out, "(?U)\\s+", " "))
    return F.btrim(out, F.lit(".,;:"))


def normal_text(text: Column) -> Column:
    return F.trim(F.lower(F.coalesce(text, F.lit(""))))


def first_number(text: Column) -> Column:
    """The first signed decimal of a text; null without one."""
    return F.regexp_extract(text, "-?\\d+(?:\\.\\d+)?", 0).try_cast("double")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?U)\\w+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' token sets; 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    n, m, both = F.size(x), F.size(y), F.size(F.array_intersect(x, y))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (both == 0), 0.0).otherwise(2.0 * both / (n + m))


def closeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; both empty 1, one empty 0."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(n, m))


def simple_accuracy(pred: Column, gold: Column) -> Column:
    """1 for equal texts, numbers within 1e-6, or token sets alike by 0.6; else 0."""
    p, g = normal_text(pred), normal_text(gold)
    x, y = first_number(p), first_number(g)
    words = lambda t: F.array_distinct(F.filter(F.split(t, "\\s+"), lambda w: w != ""))
    number = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 1e-6).otherwise(F.lit(False))
    return F.when(p == g, 1.0).when(number, 1.0).when(jaccard(words(p), words(g)) >= 0.6, 1.0).otherwise(0.0)


def motion_tag(name: Column, d: dict[str, Column], extended: bool = True) -> Column:
    """A self-closing tag; shape and phase only if they say something."""
    part = lambda k: F.concat(F.lit(f' {k}="'), d[k], F.lit('"'))
    out = [F.lit('<motion obj="'), name, F.lit('"'), part("dir"), part("speed"), part("scale")]
    if extended:
        out += [F.when(d["shape"].isin("linear", "stationary"), "").otherwise(part("shape")), F.when(d["phase"] == "constant", "").otherwise(part("phase"))]
    return F.concat(*out, F.lit("/>"))


def insert_after_last_mention(text: Column, name: Column, tag: Column) -> Column:
    """text with tag put after the last mention of an object that has a time; unchanged without one."""
    pattern = F.concat(F.lit("(?s)^(.*<obj>\\Q"), name, F.lit("\\E</obj>.*?<t>[\\d.]+</t>s)"))
    head = F.regexp_extract(text, pattern, 1) if isinstance(pattern, str) else F.call_function("regexp_extract", text, pattern, F.lit(1))
    return F.when(head != "", F.concat(head, tag, F.call_function("substr", text, F.length(head) + 1))).otherwise(text)


def clock_seconds(text: Column) -> Column:
    """H:M:S or M:S as seconds."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def safe_name(text: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), 1, most)


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


_VOWELS = "aeiou"
#: Suffixes and what replaces them where a vowel and consonant go before; Porter's published steps 2 and 3, fixed values.
_STEP_2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "logi": "log",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where two such groups go before; step 4, fixed values.
_STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in _VOWELS or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix of the rules replaced, if what stays has a measure above `least`."""
    end = max((e for e in rules if word.endswith(e)), key=len, default=None)
    if end is None:
        return word
    rest = word[: -len(end)]
    return rest + rules[end] if _measure(rest) > least and (end != "ion" or rest[-1:] in ("s", "t")) else word


def stem(word: str) -> str:
    """A word's stem by Porter's published algorithm, with its author's later `bli` and `logi`; up to three letters stay."""
    if len(word) <= 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(_swap(word, _STEP_2, 0), _STEP_3, 0), _STEP_4, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def rouge(pred: str, gold: str) -> float:
    """The mean of the F-measures of shared words, shared word pairs and the longest common subsequence, stemmed."""
    import re
    from collections import Counter

    p, g = ([stem(w) for w in re.findall("[a-z0-9]+", t.lower())] for t in (pred or "", gold or ""))
    f = lambda both, n, m: 2.0 * both / (n + m) if both else 0.0
    out = []
    for k in (1, 2):
        a, b = (Counter(zip(*[x[i:] for i in range(k)])) for x in (p, g))
        out.append(f(sum((a & b).values()), sum(a.values()), sum(b.values())))
    return (sum(out) + f(_lcs(p, g), len(p), len(g))) / 3


@F.pandas_udf(T.DoubleType())
def rouge_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pred, gold in batches:
        yield pd.Series([rouge(p, g) for p, g in zip(pred, gold)])


@F.pandas_udf(T.StringType())
def rescale_boxes_udf(text: pd.Series, factor: pd.Series) -> pd.Series:
    """Each <box>[..]</box> of a text with its numbers scaled; malformed ones stay."""
    import json
    import re

    def one(t: str, f: float) -> str:
        def new(m):
            try:
                return "<box>" + json.dumps([round(float(v) * f, 2) for v in json.loads(m[1])]) + "</box>"
            except (ValueError, TypeError):
                return m[0]

        return re.sub(r"<box>(\[.*?\])</box>", new, t or "")

    return pd.Series([one(t, f) for t, f in zip(text, factor)])
