"""Secret scans: the battery, the step-up rule and parts of tokens against brute force."""

import math
import random

from pyspark.sql import functions as F

from kinespark.llm import secrets


def tail(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def deviate(token):
    t = token.rstrip("=")
    has = [any(c in abc for c in t) for abc in (secrets._DIGITS, secrets._LOWER, secrets._UPPER)]
    kinds = [("hex", (1, 1, 0)), ("HEX", (1, 0, 1)), ("base32", (1, 0, 1)), ("BASE36", (1, 0, 1)), ("base36", (1, 1, 0)), ("base64", (1, 1, 1)), ("base64url", (1, 1, 1))]
    kind = next((k for k, need in kinds if set(t) <= set(secrets.ALPHABETS[k][0]) and all(h or not n for h, n in zip(has, need))), None)
    if kind is None:
        return None
    abc, delta, by_runs, by_serial = secrets.ALPHABETS[kind]
    n, m = len(t), len(abc)
    x = [abc.index(c) + 1 for c in t]
    chi = sum((t.count(c) - n / m) ** 2 / (n / m) for c in abc)
    high = [2 * v > m for v in x]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(p != q for p, q in zip(high, high[1:]))
    spread = math.sqrt(max(2 * a * b * (2 * a * b - n) / (n * n * (n - 1)), 1e-9))
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    cov = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:]))
    z = [(chi - (m - 1) - delta * n) / math.sqrt(2 * (m - 1 + 2 * delta * n)), abs(runs - 2 * a * b / n - 1) / spread - by_runs * math.sqrt(n), abs(cov / max(var, 1e-9) + 1 / n) * math.sqrt(n) - by_serial * math.sqrt(n)]
    return sum(w * v for w, v in zip(secrets.BATTERY, z)) / math.sqrt(sum(w * w for w in secrets.BATTERY))


def made(rng):
    pick = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    tokens = [pick(secrets.ALPHABETS[k][0], rng.choice((24, 32, 40, 64, 90))) for k in secrets.ALPHABETS for _ in range(12)]
    tokens += ["thisIsTheNameOfSomethingLong" + str(k) + "AndMore" for k in range(20)] + ["aa" * 15 + str(k) for k in range(20)] + ["0123456789abcdef" * 3, "A" * 30, "abcdefghijklmnopqrstuvwxyz1"]
    return tokens


def test_battery_and_discoveries_are_those_of_the_formulas(spark):
    tokens = made(random.Random(41))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k int, token string")
    got = {r["k"]: r for r in secrets.tested(df).collect()}
    want = {k: z for k, t in enumerate(tokens) if (z := deviate(t)) is not None}
    assert set(got) == set(want)
    for k, z in want.items():
        assert abs(math.log(got[k]["p"]) - math.log(max(tail(z), 1e-300))) < 0.35, (tokens[k], z)
    # The step-up rule on the engine's own p, by order; bins of a twentieth of a decade may leave out the last few.
    n = len(got)
    mean = sum(r["weight"] for r in got.values()) / n
    ranked = sorted((r["p"] * mean / r["weight"], k) for k, r in got.items())
    last = max((i for i, (q, _) in enumerate(ranked, 1) if q <= secrets.RATE * i / n), default=0)
    exact = {k for _, k in ranked[:last]}
    found = {r["k"] for r in secrets.discoveries(df).collect()}
    assert found <= exact and len(exact - found) <= max(2, len(exact) // 20)
    random_, structured = set(range(7 * 12)), set(range(7 * 12, len(tokens)))
    long = {k for k in random_ if len(tokens[k]) >= 64}
    assert not found & structured and len(found & long) >= 0.75 * len(long)


def test_tokens_with_separators_and_prefixes(spark):
    rng = random.Random(43)
    pick = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    b62 = secrets._UPPER + secrets._LOWER + secrets._DIGITS
    keys = [pick(b62, 60) for _ in range(6)] + [pick(secrets.ALPHABETS["base64url"][0][:-1] + "_", 86) for _ in range(6)]
    rows = [(k, f"see ghp_{t} and" if k < 6 else f"jwt {t} end") for k, t in enumerate(keys)]
    rows += [(20, "a_name_of_many_words_in_lower_case_2024 and one-more-name-with-hyphens-7"), (21, None), (22, ""), (23, "word " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert sum(got[k]["n_random"] >= 1 for k in range(12)) >= 10
    assert all(got[k]["n_random"] <= 2 for k in range(12)) and all(got[k]["n_random"] == 0 for k in range(20, 24))
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[23]["text"] == rows[-1][1] and clean[21]["text"] is None and clean[20]["text"] == rows[12][1]
    assert sum("[SECRET]" in clean[k]["text"] for k in range(12)) >= 10
