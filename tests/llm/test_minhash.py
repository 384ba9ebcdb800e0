"""Near-duplicates: blocks, recall on planted pairs, the circulant signature, hot groups."""

import random

import numpy as np
import pytest

from sievelake.llm import minhash
from sievelake.llm.minhash import Bands, near_duplicates, rank_table, signature
from sievelake.llm.symbols import U, mix64


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, percent=75):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def chains(seed, n):
    """Texts that differ from one another by a few words, so that links are near the bound and components are chains."""
    rnd = random.Random(seed)
    rows, base = [], []
    for i in range(n):
        if i % 12 == 0:
            base = [f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(4, 120))]
        else:
            base = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 24)):
                base[rnd.randrange(len(base))] = f"v{rnd.randrange(2000)}"
        rows.append((i, " ".join(base)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("members", [1024, 3])
def test_components_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(minhash, "_COMPARED", members)
    # Bands of one row bring dissimilar texts together, so buckets hold several components and blocks are compared.
    rows = chains(6, 240)
    want = components(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shape=Bands(40, 1, 40) if members == 3 else None).collect()
    assert {r.doc_id: r.component_id for r in got} == want and 20 < len(set(want.values())) < 200
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signature_is_a_minimum_over_shifted_ranks():
    s = mix64(np.arange(300, dtype=U))
    table = rank_table(30)
    ring = table.shape[0]
    place = (mix64(s ^ U(0xA0761D6478BD642F)) >> U(44)).astype(int)
    flat = table[:, 0]
    assert sorted(flat.tolist()) == list(range(ring))
    assert signature(s, 30).tolist() == [min(int(flat[(p + k) % ring]) for p in place) for k in range(30)]


def test_agreement_estimates_similarity():
    rnd = np.random.default_rng(1)
    for overlap in (0.3, 0.75, 0.9):
        n = 2000
        both = int(n * 2 * overlap / (1 + overlap))
        a = rnd.integers(0, 1 << 63, n).astype(U)
        b = np.r_[a[:both], rnd.integers(0, 1 << 63, n - both).astype(U)]
        agree = (signature(a, 336) == signature(b, 336)).mean()
        assert abs(agree - overlap) < 0.12


def test_odd_rows_and_a_hot_group(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(i, text) for i in range(300)] + [(300 + i, text.replace("t29", f"z{i}")) for i in range(100)] + [(None, text), (None, None), (900, None), (901, " "), (902, "One two"), (903, "one TWO"), (0, text)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS component", "3 AS bands")
    got = near_duplicates(d).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 400} == {0} and [r.kept for r in got if r.doc_id is None] == [True, True]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if (r.doc_id or 0) >= 900} == {900: (0, 900), 901: (0, 901), 902: (1, 902), 903: (1, 902)}
    assert near_duplicates(d.limit(0)).count() == 0
