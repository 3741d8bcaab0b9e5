"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spellings

SCHEMA = "doc_id bigint, text string, word string, n int, gram string, place int"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_pairs(counts: dict[str, int]) -> set:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def counted(rows) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "abababab", "ababababa", "x" * 40]
    words = [*stems, *(w[:i] + rng.choice(["", "z", w[i:i + 1] * 2]) + w[i + 1:] for w in stems for i in [rng.randrange(len(w))])]
    words += [w.upper() for w in stems[:20]] + ["Éa" + stems[0], "ab×cdé", "漢abcdef漢"]
    texts = [" ".join(rng.choices(words, weights=[1 / (1 + k % 17) for k in range(len(words))], k=rng.choice([5, 80, 400]))) for _ in range(120)]
    texts += [None, "", " 1 2 ", "-".join(["Houses"] * 4000), "x" * 3_000_000 + " houses houses"]
    found = [(i, t, "own", 1, "g", 2) for i, t in enumerate(texts)]
    return [*found, (None, texts[0], "own", 1, "g", 2), found[1], found[1]]


@pytest.mark.parametrize("frequent", [0, 3, 64, 10**9])
def test_pairs_by_any_dictionary(spark, rows, frequent):
    counts = counted(rows)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    found = {tuple(r) for r in spellings.group(words, frequent).collect()}
    assert found == by_pairs(counts)


def test_equals_all_pairs(spark, rows):
    found = spellings.variants(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    wanted = by_pairs(counted(rows))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert any(r["form"] is not None and r["root"] != r["form"] for r in found)
    assert any(r["n_near"] == 0 for r in found)


def test_words_pass_on_in_parts(spark, rows, monkeypatch):
    text = b"Abc d\xc3\xa9f-" * 1000 + b"ghi"
    assert "".join(spellings.pieces(text, 100)) == text.decode().lower() and len(list(spellings.pieces(text, 100))) > 50
    assert list(spellings.pieces(b"", 100)) == []


def test_bounds_are_exact(spark):
    words = ["houses", "aaaaa", "banana", "mississippi"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    grams = spellings.decomposed(table, spellings.gram_dictionary(table, 1))
    for r in spellings.bounded(grams).collect():
        marked, at = f"^{r['word']}$", 0
        covered = [0] * len(marked)
        for at, g in enumerate(r["grams"]):
            assert marked[at:at + len(g)] == g and 2 <= len(g) <= 5
            for i in range(at, at + len(g)):
                covered[i] += 1
        assert r["affected"] == max(covered[1:-1]) < len(r["grams"]) and len(r["prefix"]) == r["affected"] + 1


def test_empty_table(spark):
    assert spellings.variants(spark.createDataFrame([], SCHEMA)).count() == 0
