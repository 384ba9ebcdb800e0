"""Exact and proximity matches against brute force, with one chunk and several, on repeated rows and odd items."""

import random
import re
from collections import Counter

import pytest

from sievelake.llm.decontaminate import _within, build_index, decontaminate, search_index


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window, slop):
    out = []
    for doc_id, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for item_id, item in items:
            v = words(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        exact.add(item_id)
                for j in range(max(1, len(w) - len(part) - slop + 1)):
                    if not Counter(part) - Counter(w[j : j + len(part) + slop]):
                        near.add(item_id)
        order = lambda s: sorted(s - {None}) + [None] * (None in s)
        out.append((doc_id, len(w), len(hit), order(exact), order(near)))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r["items"], r.near) for r in rows), key=str)


@pytest.mark.parametrize("chunk_bytes", [400, 16 << 20])
def test_exact_and_near_against_brute_force(spark, chunk_bytes):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(7)] + ["É", "ß"]
    docs = [(rnd.choice([None, *range(30)]), " ".join(rnd.choice(vocabulary).upper() for _ in range(rnd.randrange(0, 25)))) for _ in range(120)]
    docs += docs[:10] + [(1, None), (2, ""), (3, "?!")]
    items = [(i % 9 or None, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 8)))) for i in range(24)] + [(50, None), (51, "")]
    want = brute(docs, items, 4, 2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = found(search_index(build_index(d.repartition(3)), b, 4, chunk_bytes, unnamed=True, slop=2).collect())
    assert got == want
    assert sum(len(x[4]) for x in want) > sum(len(x[3]) for x in want) > 0


def test_moved_and_inserted_words_are_near(spark):
    item = "the quick brown fox jumps over the lazy sleeping dog"
    moved = "so quick the brown fox jumps really over a lazy sleeping the dog indeed"
    far = "the quick brown fox jumps over lazy sleeping dog and much later on again came what was the"
    once = "quick brown fox jumps over the lazy sleeping dog"  # one 'the' too few
    rows = [(1, item), (2, moved), (3, far), (4, once), (5, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near, r.contaminated) for r in decontaminate(d, b, slop=5).collect()}
    assert got == {1: (1, 1, True), 2: (0, 1, False), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, False)}
    assert "n_near" not in decontaminate(d, b).columns
    assert {r.n_hit for r in decontaminate(d, b.limit(0), slop=5).collect()} == {0} and decontaminate(d.limit(0), b, slop=5).count() == 0


def test_within():
    assert _within([1, 9, 1], [1, 1], 3) and not _within([1, 9, 9, 1], [1, 1], 3) and not _within([1], [1, 1], 5) and _within([5, 1, 2], [2, 1], 2)
