from __future__ import annotations

import random

import pytest

from millrace.llm import licenses

T = licenses.TEMPLATES


def test_every_template_is_found_whole_in_prose():
    for name, text in T.items():
        got = licenses.found(f"some prose before it. {text} and some prose after it")
        assert got[0][:2] == (name, 1.0), name


def test_openings_are_not_whole_licenses():
    assert licenses.found(T["MIT-text"].split("subject to")[0]) == []
    rest = licenses.found("subject to" + T["MIT-text"].split("subject to")[1])
    assert [r[0] for r in rest] == ["MIT-text"] and 0.6 <= rest[0][1] < 0.7
    assert licenses.found(T["BSD-3-Clause"].split("2. ")[0]) == []


@pytest.mark.parametrize(("name", "other"), [("BSD-2-Clause", "BSD-3-Clause"), ("BSD-3-Clause", "BSD-2-Clause")])
def test_bsd_texts_are_told_apart(name, other):
    got = licenses.found(T[name])
    assert got[0][:2] == (name, 1.0)
    assert all(r[1] < 1 for r in got if r[0] == other) or name == "BSD-3-Clause"


@pytest.mark.parametrize("n", [3, 20, 200])
@pytest.mark.parametrize("name", sorted(T))
def test_n_copies_in_a_row_are_n_regions(name, n):
    got = [r for r in licenses.found("Intro " + (T[name] + " ") * n) if r[0] == name]
    assert [r[1] for r in got] == [1.0] * n
    assert [r[2] for r in got] == [6 + k * (len(T[name]) + 1) for k in range(n)]


def common_words(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_found_by_brute_force(seed):
    rng = random.Random(seed)
    prose = lambda k: [f"zz{rng.randrange(999)}" for _ in range(k)]
    whole = [x for x in sorted(T) if len(licenses.words(T[x])) > 30]
    text, planted = prose(9), []
    for _ in range(12):
        name = rng.choice(whole)
        copy = licenses.words(T[name])
        for _ in range(rng.choice((0, 0, len(copy) // 20, len(copy) // 8))):
            i = rng.randrange(1, len(copy) - 1)
            copy[i : i + rng.randrange(2)] = prose(rng.randrange(3))
        planted.append((name, len(text), len(text) + len(copy), common_words(copy, licenses.words(T[name])) / len(licenses.words(T[name]))))
        text += copy + prose(rng.choice((0, 0, 1, 40)))
    joined = " ".join(text)
    at = [m.start() for m in licenses.WORD.finditer(joined)]
    got = licenses.found(joined)
    for name, a, z, best in planted:
        own = [r for r in got if r[0] == name and r[2] < (at[z] if z < len(at) else len(joined)) and r[3] > at[a]]
        assert len(own) == 1, (name, a, z, own)
        assert best - 0.06 <= own[0][1] <= best + 1e-9 and own[0][2] == at[a]


@pytest.mark.parametrize("name", sorted(T))
def test_copies_side_by_side_are_two_regions(name):
    text = f"five other words here now {T[name]} {T[name]}"
    got = [r for r in licenses.found(text) if r[0] == name]
    assert [r[1] for r in got] == [1.0, 1.0]
    assert got[0][2] == 26 and got[0][3] < got[1][2] == 27 + len(T[name])


def test_a_doubled_word_is_not_a_second_copy():
    words = T["MIT-text"].split()
    at = words.index("MERCHANTABILITY,")
    got = [r for r in licenses.found(" ".join([*words[: at + 1], *words[at:]])) if r[0] == "MIT-text"]
    assert len(got) == 1 and got[0][1] == 1.0


def test_copies_without_any_telling_word_are_found():
    """What tells is left out of the copy, which still covers more than the threshold."""
    for name in ("MIT-text", "BSD-3-Clause", "Zlib-text"):
        template = licenses.Template.of(name, licenses.TEMPLATES[name])
        left = " ".join(w for w in template.words if w not in template.place)
        share = len(left.split()) / len(template.words)
        got = {r[0]: r[1] for r in licenses.found("some prose before it " + left + " and some behind")}
        assert share > licenses.THRESHOLD and got[name] >= licenses.THRESHOLD
    # A template whose words all repeat, so that no single word can tell.
    own = (("twice", "red green blue green red blue blue red green red blue green"),)
    assert [r[0] for r in licenses.found("x " + own[0][1] + " y", own)] == ["twice"]
