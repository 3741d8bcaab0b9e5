"""Fill-in-middle against a version that works on whole strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import middles

SCHEMA = "doc_id bigint, text string, lang string, n int, form string, output binary"


def by_strings(doc_id, text):
    text, name = text or "", "" if doc_id is None else str(doc_id)
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out, cuts = "plain", text, (None, None)
    elif h4 % 100 < 20:
        form, out, cuts = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}", (a, b - a)
    else:
        form, out, cuts = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", (a, b - a)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return (doc_id, n, form, *cuts, *sha)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    alphabet = "ab cdé漢😀\n<>PSM"
    texts = ["".join(rng.choices(alphabet, k=rng.choice([1, 5, 50, 3000]))) for _ in range(300)]
    shared = "".join(rng.choices("abcdefgh ", k=5000))
    texts += [None, "", "x", "a<P>b", "<S>", "<M", "é" * 40_000, "漢字" * 9000 + "<M>", shared, shared + "x", "😀" + shared, shared * 3]
    found = [(i, t, "en", 7, "x", b"y") for i, t in enumerate(texts)]
    return [*found, (None, "a text without an id", "en", 7, "x", b"y"), found[3], found[3]]


def test_equals_whole_strings(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = middles.report(docs).collect()
    key = str
    assert sorted((tuple(r) for r in found), key=key) == sorted((by_strings(r[0], r[1]) for r in rows), key=key)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert all(r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r in found for d, t in [next(x[:2] for x in rows if x[0] == r["doc_id"])])


def test_empty_table(spark):
    assert middles.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sentinels_across_chunks_and_cut_positions():
    text = ("é漢a" * 50 + "<P>" + "b😀" * 50).encode()
    for size in (1, 2, 3, 4, 5, 7, 64):
        parts = [(i, min(i + size, len(text))) for i in range(0, len(text), size)]
        whole = middles.Text(text, parts, middles.Cache())
        assert whole.sentinel and whole.units == len(text.decode())
        for unit in (0, 1, 2, 77, 151, 200, whole.units):
            assert whole.byte(unit) == len(text.decode()[:unit].encode())
    clean = text.replace(b"<P>", b"<P<S")
    assert not middles.Text(clean, [(i, i + 1) for i in range(len(clean))], middles.Cache()).sentinel


def test_chunks_follow_content_and_cover_the_text():
    rng = np.random.default_rng(2)
    shared = rng.integers(32, 127, 60_000, dtype=np.uint8)
    data = np.concatenate([rng.integers(32, 127, 777, dtype=np.uint8), shared])
    one, two = middles.candidates(shared), middles.candidates(data)
    assert set((one[one > 100] + 777).tolist()) <= set(two.tolist()) and len(one) > 20
    cut = list(middles.chunks(two, 10, 50_000, 3000))
    assert cut[0][0] == 10 and cut[-1][1] == 50_000 and all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and max(b - a for a, b in cut) <= 3000
    # one block or many: the same places
    before = middles.BLOCK
    try:
        middles.BLOCK = 1000
        assert middles.candidates(data).tolist() == two.tolist()
    finally:
        middles.BLOCK = before


def test_cache_verifies_content_and_stays_bounded():
    cache = middles.Cache(max_bytes=100, digest=lambda chunk: 1)  # all chunks collide
    assert cache.summary(b"abc").units == 3 and cache.summary("éé".encode()).units == 2
    assert cache.summary(b"abc").units == 3 and cache.hits == 1
    cache = middles.Cache(max_bytes=100)
    for i in range(100):
        cache.summary(b"%03d" % i * 10)
    assert cache.size <= 100 and len(cache.known) <= 4
