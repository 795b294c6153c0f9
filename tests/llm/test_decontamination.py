"""Decontamination: short items, edges of pieces, characters above the basic plane, very long texts."""

import random

from kinespark.llm import decontaminate


def edits(a, b):
    """Fewest edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def flat(text):
    return "".join(map(chr, decontaminate.normal(text)[0].tolist())).strip()


def test_short_items_stand_as_whole_words():
    items = [(0, "2 + 2 = 4"), (1, "tiny"), (2, "E=mc2"), (3, "a"), (4, "?!"), (5, "x y")]
    index = decontaminate.Index(items)
    find = lambda t: sorted(decontaminate.find(index, t))
    assert find("So 2+2 = 4.") == [0] and find("12 + 2 = 4") == [] and find("2 + 2 = 43") == []
    assert find("TINY") == [1] and find("tinyest destiny") == [] and find("(e = MC2)") == [2] and find("(e, mc 2)") == [] and find("(E=MC2)") == [2]
    assert find("e-mc2") == [2] and find("a") == [3] and find("b a") == [3] and find("ab") == [] and find("?!") == [] and find("x  Y") == [5]
    assert decontaminate.find(index, "tiny and tiny")[1] == (0, 0, 4, 2)


def test_items_of_every_length_within_their_whole_budget():
    rng = random.Random(31)
    letters = "abcdefghij "
    for _ in range(150):
        m = rng.randint(10, 90)
        item = flat("".join(rng.choice(letters) for _ in range(m)))
        if len(item) < 10:
            continue
        changed = list(item)
        for _ in range(rng.randint(0, len(item) // 8)):
            p = rng.randrange(len(changed))
            changed[p : p + 1] = rng.choice(("", "q", "zz"))
        text = "".join(rng.choice(letters) for _ in range(60)) + "".join(changed) + "".join(rng.choice(letters) for _ in range(60))
        index = decontaminate.Index([(1, item)])
        least = edits(item, flat(text))
        got = decontaminate.find(index, text)
        assert (1 in got) == (least <= len(item) // 10) and (not got or got[1][0] == least)


def test_characters_above_the_basic_plane():
    index = decontaminate.Index([(1, "\U00010400\U00010401 letters of a script that has cases, and some more words after")])
    assert 1 in decontaminate.find(index, "\U00010428\U00010429\U0001f600LETTERS of a script that has cases and some more words after")


def test_very_long_texts_and_edges_of_pieces(monkeypatch):
    rng = random.Random(33)
    item = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30))
    index = decontaminate.Index([(1, item), (2, "tiny")])
    monkeypatch.setattr(decontaminate, "PIECE", 1000)
    for at in range(700, 1400, 23):
        text = "".join(rng.choice("uvwxyz ") for _ in range(at)) + " " + item + " " + "".join(rng.choice("uvwxyz ") for _ in range(3000)) + " tiny " + "u" * at
        found = decontaminate.find(index, text)
        assert found[1][:3] == (0, at + 1, at + 1 + len(item)) and found[2][3] == 1
    monkeypatch.undo()
    text = "uvw " * 600_000 + item
    assert decontaminate.find(index, text)[1][1] == 2_400_000
