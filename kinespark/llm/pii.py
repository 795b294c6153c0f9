"""Personal data: fixed patterns and a semi-Markov conditional random field.

Base kinds: email, ip, card, phone. The field scores whole segments of up to LONGEST units (runs of letters, runs of
digits, single other characters; a spelled-out address is one segment of any length) as one of the kinds by features of
the whole span: number of digits and groups, group lengths, separators, Luhn's sum, parts of an address, brackets, cue
words before it, and the kind of the segment before. Bounded-entity dynamic programming finds boundaries and kinds
together, segments and the units outside any segment; units far from runs of digits and from addresses score 0 outside,
so that the whole text's best path is that of its islands. The weights maximise the conditional likelihood (forward and
backward sums over all segmentations, with a Gaussian prior) of sentences made here from a fixed seed. What the field
finds is added where it overlaps no base span.

Defined results: a null or empty text has no span; numbers and texts of any length are read whole; repeated rows each get
their result; base spans of different kinds may overlap and all stay; of equal paths the one with fewer segments is
taken (ties); an empty table gives an empty result; columns beyond doc_id and text, of whatever names, are ignored.

Scale: one pass in Arrow batches, no shuffle; patterns are laid out so that long runs cost linear time; the field's
weights, a few hundred numbers, are what is sent to executors.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LONGEST, SENTENCES, ROUNDS, SEED, PRIOR, STEP = 13, 700, 5, 7, 0.02, 0.3

# A match of these patterns never starts within a run of digits, so they look behind: long runs cost linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _small(number: str) -> bool:
    """Whether a number of any length is at most 255."""
    number = number.lstrip("0")
    return len(number) < 3 or len(number) == 3 and number <= "255"


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(_small(x) for x in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


_UNIT = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|\s+|[^A-Za-zÀ-ɏ0-9\s]")
_NUMBER = re.compile("[0-9]{2,}")
_AT = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\bat\s(?=[A-Za-z0-9-]+\s(?:dot|\(dot\)|\[dot\])\s)", re.I)
_TAIL = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
#: Words that announce a kind; fixed values.
CUES = {"phone": 3, "tel": 3, "telephone": 3, "call": 3, "mobile": 3, "cell": 3, "fax": 3, "card": 2, "visa": 2, "mastercard": 2, "amex": 2, "credit": 2, "email": 0, "mail": 0, "contact": 0, "ip": 1, "server": 1, "host": 1, "address": 1, "order": 9, "invoice": 9, "version": 9, "id": 9, "isbn": 9, "date": 9, "page": 9}


def features(span: str, before: str, after: str, cue: int | None, mail: bool = False) -> list[str]:
    """The features of a whole span, given the characters beside it and the kind that a word before it announces."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    n = len(digits)
    seps = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span))))
    out = ["bias", f"digits={min(n, 20)}", f"groups={min(len(groups), 7)}", f"seps={seps if len(seps) < 5 else 'many'}", f"first={span[0] if not span[0].isalnum() else ('9' if span[0].isdigit() else 'a')}", f"cue={cue}"]
    out.append("lengths=" + ",".join(str(len(g)) for g in groups[:6]))
    if 13 <= n <= 19 and not re.search("[A-Za-z@]", span):
        out.append("luhn" if luhn(digits) else "not-luhn")
    if re.fullmatch(r"\d+\s?\.\s?\d+\s?\.\s?\d+\s?\.\s?\d+", span):
        out.append("parts" if all(int(g) < 256 for g in groups if len(g) < 9) else "parts-large")
    if re.search("[A-Za-z]", span):
        out.append("spelled" if mail else "letters")
    if re.fullmatch(r"(?:1[5-9]|20)\d\d([-/.])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2\d{2,4}", span):
        out.append("date")
    out.append("closed" if span.count("(") == span.count(")") else "open")
    if before.isalnum() or after.isalnum() or before in "$€£#.:/_-=+" and before or after in "%_=" and after:
        out.append("tied")
    return out


def _mails(text: str) -> list[tuple[int, int]]:
    """Addresses, plain or spelled out: what stands before and after an `@` or an `at`, of any length."""
    out, last = [], 0
    for m in _AT.finditer(text):
        if m.start() >= last and (tail := _TAIL.match(text, m.end())):
            start = m.start() - (m.start() > last and text[m.start() - 1].isspace())
            end = start
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < end:
                last = tail.end()
                out.append((start, last))
    return out


def _islands(text: str, mails: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int]]:
    """The stretches of text near runs of digits and addresses; all segments lie in them. Each has its own window, those
    that meet are one, and none ends within a run of letters or digits."""
    near = [(max(0, m.start() - 4), min(len(text), m.start() + 30)) for m in _NUMBER.finditer(text)]
    near += _mails(text) if mails is None else mails
    start = end = -1
    for a, b in sorted(near):
        while a > max(end, 0) and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while 0 < end < a and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = max(end, b)
    while 0 < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    if end >= 0:
        yield start, end


def _segments(text: str, start: int, end: int, mails: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """The units of an island and its segments (first unit, unit after, features)."""
    units = [m.span() for m in _UNIT.finditer(text, start, end)]
    # Units at the island's edge may be cut; whole words and numbers only.
    while units and units[0][0] == start and start and text[start - 1].isalnum() and text[start].isalnum():
        units.pop(0)
    while units and units[-1][1] == end and end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
        units.pop()
    kinds = ["9" if "0" <= text[a] <= "9" else "a" if text[a].isalpha() else " " if text[a].isspace() else text[a] for a, _ in units]
    out = []
    mails = [x for x in (_mails(text) if mails is None else mails) if start <= x[0] and x[1] <= end]
    for i, (a, _) in enumerate(units):
        if kinds[i] not in "9+(":
            continue
        before = text[a - 1] if a else ""
        if before.isalnum() or before == "@":
            continue
        cue = None
        n = 0
        for j in range(i, min(len(units), i + LONGEST)):
            k = kinds[j]
            if k not in "9 ()+.-" or text[units[j][0] : units[j][1]].count("\n") or k == " " and units[j][1] - units[j][0] > 1:
                break
            if k != "9":
                continue
            b = units[j][1]
            n += b - units[j][0]
            after = text[b] if b < len(text) else ""
            if n > 19:
                break
            if n < 7 and text.count(".", a, b) < 3 or after.isalpha():
                continue
            if cue is None:
                words = re.findall("[A-Za-z]+", text[max(0, a - 32) : a].lower())[-3:]
                cue = next((CUES[w] for w in reversed(words) if w in CUES), -1)
            out.append((i, j + 1, features(text[a:b], before, after, cue)))
    if mails:
        firsts, lasts = {a: i for i, (a, _) in enumerate(units)}, {b: i for i, (_, b) in enumerate(units)}
        for a, b in mails:
            if a in firsts and b in lasts:
                words = re.findall("[A-Za-z]+", text[max(0, a - 32) : a].lower())[-3:]
                cue = next((CUES[w] for w in reversed(words) if w in CUES), -1)
                out.append((firsts[a], lasts[b] + 1, features(text[a:b], text[a - 1] if a else "", text[b] if b < len(text) else "", cue, True)))
    return units, sorted(out, key=lambda s: (s[1], s[0]))


NONE = len(KINDS)  # the state before an island's first segment
_STATES = range(NONE + 1)


def _scores(segments: list, weights: dict) -> list[list[float]]:
    """For each segment and kind the sum of its features' weights."""
    return [[sum([weights.get((k, f), 0.0) for f in fs]) for k in range(NONE)] for _, _, fs in segments]


def _steps(weights: dict) -> list[list[float]]:
    """For each kind and that of the segment before, the weight of the pair."""
    return [[weights.get((k, f"after={l}"), 0.0) for l in _STATES] for k in range(NONE)]


def _best(units: list, segments: list, weights: dict) -> list[tuple[int, int, int, list[str]]]:
    """The best segments and kinds of an island: (kind, first unit, unit after, features)."""
    scores, steps = _scores(segments, weights), _steps(weights)
    low = float("-inf")
    value = [[low] * NONE + [0.0]]
    back: list[list] = [[None] * (NONE + 1)]
    at = 0
    for j in range(1, len(units) + 1):
        now, how = list(value[j - 1]), [None] * (NONE + 1)
        while at < len(segments) and segments[at][1] == j:
            before = value[segments[at][0]]
            for k in range(NONE):
                score, state = max([(before[l] + steps[k][l], -l) for l in _STATES])
                if score + scores[at][k] > now[k]:
                    now[k], how[k] = score + scores[at][k], (at, -state)
            at += 1
        value.append(now)
        back.append(how)
    out, j = [], len(units)
    state = max(_STATES, key=lambda l: (value[j][l], l))
    while j > 0:
        if back[j][state] is None:
            j -= 1
        else:
            n, before = back[j][state]
            i, _, fs = segments[n]
            out.append((state, i, j, fs))
            j, state = i, before
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values])) if top > float("-inf") else top


def _expected(units: list, segments: list, weights: dict) -> tuple[float, dict]:
    """(log of the sum over all segmentations, the probability of each (segment, kind, kind before))."""
    scores, steps = _scores(segments, weights), _steps(weights)
    n, low = len(units), float("-inf")
    ahead, behind = [[low] * NONE + [0.0]], [[0.0] * (NONE + 1) for _ in range(n + 1)]
    at = 0
    for j in range(1, n + 1):
        terms = [[x] for x in ahead[j - 1]]
        while at < len(segments) and segments[at][1] == j:
            before = ahead[segments[at][0]]
            for k in range(NONE):
                terms[k].append(scores[at][k] + _log_sum([before[l] + steps[k][l] for l in _STATES]))
            at += 1
        ahead.append([_log_sum(t) for t in terms])
    by = defaultdict(list)
    for m, (i, _, _) in enumerate(segments):
        by[i].append(m)
    for i in range(n - 1, -1, -1):
        behind[i] = [_log_sum([behind[i + 1][l], *[steps[k][l] + scores[m][k] + behind[segments[m][1]][k] for m in by[i] for k in range(NONE)]]) for l in _STATES]
    whole = behind[0][NONE]
    found = {}
    for m, (i, j, _) in enumerate(segments):
        for k in range(NONE):
            for l in _STATES:
                p = math.exp(min(0.0, ahead[i][l] + steps[k][l] + scores[m][k] + behind[j][k] - whole))
                if p > 1e-6:
                    found[m, k, l] = p
    return whole, found


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence with labelled spans, and with numbers that are nobody's."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "an", "on", "re", "ti", "el", "ou", "is", "ma", "ko", "vi")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        x = rng.choice("3456") + d(rng.choice((14, 14, 13, 12)))
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = rng.choice(("", " ", "-"))
        return sep.join(x[k : k + 4] for k in range(0, len(x), 4)) if sep else x

    phone = lambda: rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{rng.choice('1234')} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"{d(3)} {d(3)} {d(4)}"))
    mail = lambda: rng.choice((f"{word()}.{word()} at {word()} dot {rng.choice(('com', 'org'))}", f"{word()}{d(2)} [at] {word()}.{rng.choice(('com', 'net'))}", f"{word()} (at) {word()} (dot) com", f"{word()}@{word()}.org", f"{word()} @ {word()}.com"))
    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    other = lambda: rng.choice((f"{rng.randint(1900, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1900, 2030)}", d(rng.randint(2, 20)), f"{d(1)}.{d(rng.randint(1, 12))}", f"${d(3)},{d(3)}.{d(2)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(4)}", f"{d(8)}-{d(4)}", f"{d(3)} {d(2)} {d(4)} {d(3)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40))), f"{d(5)} {d(6)}", f"{d(4)} {d(4)} {d(4)}", f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", d(16)))
    text, spans = "", []
    for _ in range(rng.randint(3, 6)):
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        kind = rng.choice((0, 1, 2, 3, 3, 9, 9, 9, 9))
        if rng.random() < 0.3:
            text += rng.choice([w for w, k in CUES.items() if k == kind]) + rng.choice((" ", ": "))
        made = (mail, ip, card, phone)[kind]() if kind < 4 else other()
        if kind < 4:
            spans.append((kind, len(text), len(text) + len(made)))
        text += made + rng.choice((" ", ". ", ", ", "\n"))
    return text, spans


_fitted: dict = {}


def fit(sentences: int = SENTENCES, rounds: int = ROUNDS, seed: int = SEED) -> dict[tuple[int, str], float]:
    """The weights of the field, by stochastic gradients of the penalised likelihood of sentences made from the seed."""
    if (sentences, rounds, seed) in _fitted:
        return _fitted[sentences, rounds, seed]
    rng = random.Random(seed)
    islands = []
    for text, spans in [_made(rng) for _ in range(sentences)]:
        for a, b in _islands(text):
            units, segments = _segments(text, a, b)
            gold, last, reach = [], NONE, 0
            for m, (i, j, _) in enumerate(segments):
                for k, x, y in spans:
                    if (units[i][0], units[j - 1][1]) == (x, y) and i >= reach:
                        gold.append((m, k, last))
                        last, reach = k, j
            if segments:
                islands.append((units, segments, gold))
    weights, squares = {}, defaultdict(lambda: 1e-3)
    for _ in range(rounds):
        rng.shuffle(islands)
        for units, segments, gold in islands:
            slope = defaultdict(float)
            for m, k, l in gold:
                for f in (*segments[m][2], f"after={l}"):
                    slope[k, f] += 1.0
            for (m, k, l), p in _expected(units, segments, weights)[1].items():
                for f in (*segments[m][2], f"after={l}"):
                    slope[k, f] -= p
            for key, g in slope.items():
                g -= PRIOR * weights.get(key, 0.0)
                squares[key] += g * g
                weights[key] = weights.get(key, 0.0) + STEP * g / math.sqrt(squares[key])
    out = {key: round(w, 4) for key, w in weights.items()}
    _fitted[sentences, rounds, seed] = out
    return out


def find(text: str | None, weights: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and those with what the field adds; by kind, then start."""
    if not text:
        return [], []
    fixed = base(text)
    # Spans that are free of one another in order of their starts, so that a look at the nearest ones will do.
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in fixed):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    more, mails, at = [], _mails(text), 0
    for a, b in _islands(text, mails):
        held = at
        while held < len(mails) and mails[held][1] <= b:
            held += 1
        units, segments = _segments(text, a, b, mails[at:held])
        at = held
        if segments:
            for k, i, j, _ in _best(units, segments, weights):
                x, y = units[i][0], units[j - 1][1]
                n = bisect_left(starts, y) - 1
                if n < 0 or taken[n][1] <= x:
                    more.append((k, x, y))
    return fixed, sorted(set(fixed + more))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def _batches(weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, weights) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in fixed) for fixed, _ in found], pa.int64()) for k in range(len(KINDS))]
            added = [pa.array([sum(s[0] == k for s in every) for _, every in found], pa.int64()) for k in range(len(KINDS))]
            added = [pc.subtract(a, c) for a, c in zip(added, counts)]
            sums = pa.array([hashlib.sha256(_written(fixed).encode()).hexdigest() for fixed, _ in found], pa.string())
            spans = pa.array([_written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sums, spans, *added], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", *[f"added_{k}" for k in KINDS]])

    return run


def scan(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (of the base spans), base_sha256, all spans, and added_email
    to added_phone (how many of them the field adds)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers, added = [", ".join(f"{c}_{k} long" for k in KINDS) for c in ("n", "added")]
    return docs.select("doc_id", "text").mapInArrow(_batches(fit() if weights is None else weights), f"doc_id {kind}, {numbers}, base_sha256 string, spans string, {added}")
