"""Substring dedup: the dealt structures decide, hot minimizers give the same rows, words are told apart."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import entries, passages, substring_dedup, suffix_dedup
from sievelake.llm.substring_dedup import SuffixAutomaton, remove_repeated_passages
from sievelake.llm.suffix_dedup import longest_previous_factor, remove_repeated_bytes, suffix_order
from sievelake.llm.symbols import NOT_SPACE, text_buffer, word_hashes

DATA = "/root/testdata/sf0.001"
KINDS = {"word": (substring_dedup, remove_repeated_passages, "op1_substring_dedup"), "byte": (suffix_dedup, remove_repeated_bytes, "op4_suffix_array_dedup")}


def with_scheme(monkeypatch, module, **changes):
    make = module.Scheme
    monkeypatch.setattr(module, "Scheme", lambda unit, length, gram, resolve: make(unit, length, gram, changes.get("resolve", resolve), changes.get("hot", 1024)))


@pytest.mark.parametrize("kind", KINDS)
def test_hot_minimizers_as_in_sql(spark, monkeypatch, kind):
    module, remove, name = KINDS[kind]
    with_scheme(monkeypatch, module, hot=1)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    r = con.execute(entries.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    got = remove(spark.read.parquet(f"{DATA}/documents.parquet"), 50).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(r.fetchall())


@pytest.mark.parametrize("kind", KINDS)
def test_only_whole_copies_go_without_the_structure(spark, monkeypatch, kind):
    module, remove, _ = KINDS[kind]
    with_scheme(monkeypatch, module, resolve=lambda content, begin, windows, by, again, length: (np.zeros(len(begin), np.uint64),) * 2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r.text, r.doc_id)
    texts = dict(map(tuple, docs.collect()))
    for r in remove(docs, 50).collect():
        assert not r.n_removed or first[texts[r.doc_id]] < r.doc_id


def brute(rows, window, symbols):
    out = {}
    seen = {}
    for doc_id, text in rows:
        s = symbols(text)
        for i in range(len(s) - window + 1):
            seen[tuple(s[i : i + window])] = min(seen.get(tuple(s[i : i + window]), doc_id), doc_id)
    for doc_id, text in rows:
        s, gone = symbols(text), set()
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] < doc_id:
                gone |= set(range(i, i + window))
        out[doc_id] = [x for i, x in enumerate(s) if i not in gone]
    return out


@pytest.mark.parametrize("hot", [1, 1024])
def test_kept_text_and_bytes_against_brute_force(spark, monkeypatch, hot):
    rnd = random.Random(5)
    common = [" ".join(rnd.choice("ab c d".split(" ")) + str(rnd.randrange(3)) for _ in range(rnd.randrange(6, 40))) for _ in range(6)]
    rows = [(i, " ".join(rnd.choice(common) if rnd.random() < 0.6 else f"w{rnd.randrange(50)} é" for _ in range(rnd.randrange(0, 7)))) for i in range(-5, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (substring_dedup, suffix_dedup):
        with_scheme(monkeypatch, module, hot=hot)
    want = brute(rows, 8, lambda t: t.split())
    got = {r.doc_id: r.kept_text for r in remove_repeated_passages(d, 8, with_text=True).collect()}
    assert got == {k: " ".join(v) for k, v in want.items()} and sum(map(len, want.values())) < sum(len(t.split()) for _, t in rows)
    want = brute(rows, 20, lambda t: t.encode())
    got = {r.doc_id: bytes(r.kept_bytes) for r in remove_repeated_bytes(d, 20, with_bytes=True).collect()}
    assert got == {k: bytes(v) for k, v in want.items()}


def test_long_words_that_a_polynomial_takes_for_equal():
    word = ["ab"[bin(i).count("1") % 2] for i in range(2048)]
    texts = ["".join(word), "".join("ba"[w == "b"] for w in word)]
    hashes, before = word_hashes(*text_buffer(__import__("pyarrow").array(texts)), NOT_SPACE)
    assert hashes[0] != hashes[1] and before.tolist() == [0, 1, 2]


def test_structures_against_brute_force():
    rnd = random.Random(3)
    for _ in range(30):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        automaton = SuffixAutomaton()
        automaton.add(a)
        held = {tuple(a[i:j]) for i in range(len(a)) for j in range(i, len(a) + 1)}
        assert automaton.statistics(b) == [max(m for m in range(i + 2) if tuple(b[i + 1 - m : i + 1]) in held) for i in range(len(b))]
        text = np.array([rnd.randrange(2) for _ in range(60)], np.uint8)
        docs = np.array(sorted(rnd.randrange(5) for _ in range(50)))
        order, lcp = suffix_order(text, np.arange(50), 8)
        lpf = np.empty(50, int)
        lpf[order] = longest_previous_factor(docs[order], lcp)
        for i in range(50):
            common = [next((k for k in range(8) if text[i + k] != text[j + k]), 8) for j in range(50) if docs[j] < docs[i]]
            assert lpf[i] == max(common, default=0)
    assert passages._SEVERAL > passages._RUN


def test_contexts_travel_in_few_bytes():
    rnd = random.Random(9)
    syllables = "the in er on re an at nd st en ti es or ha ed th".split()
    texts = [" ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(3000)) for _ in range(8)]
    docs = pa.table({"g": pa.array([0] * 8, pa.int32()), "doc_id": range(8), "text": texts, "mark": pa.array(range(8), pa.int64())})
    scheme = passages.Scheme("byte", 50, 25, suffix_dedup.resolve_with_lpf)
    sent = passages._minimizers(scheme, 1)(docs, passages._table([], [], []))
    # Another group holds the same, so that all minimizers are told to be found in several documents.
    told = passages._repeated(1024)(passages._table([0, 1], ["h", "h"], sent["payload"].to_pylist() * 2, [0, 0]).drop_columns("bucket"))
    routed = [p for k, p in zip(*(passages._contexts(scheme, 1)(docs, told.filter(pa.compute.equal(told["g"], 0)))[c].to_pylist() for c in ("kind", "payload")), strict=True) if k == "c"]
    windows = sum(len(t) - 49 for t in texts)
    # A context has some 14 windows and 63 symbols. Both used to take 8 bytes a minimizer, and 33 besides the symbols a context.
    assert sum(map(len, sent["payload"].to_pylist())) < 5 * windows / 13 and sum(map(len, routed)) < 45 * windows / 13


def test_packed_entries_come_back():
    for h in ([], [0], [(1 << 48) - 1], [0, 1, 1 << 24, (1 << 40) + 5, (1 << 48) - 1]):
        assert passages._unpack48(passages._pack48(np.array(h, np.uint64))).tolist() == h
    for x, kind in (([], np.int64), ([-5, 0, 1 << 62], np.int64), ([0, 255], np.uint8), ([(1 << 64) - 1, 3], np.uint64)):
        assert passages._from_planes(passages._planes(np.array(x, kind)), kind).tolist() == x
    assert passages._split(passages._join(b"", b"ab", b"")) == [b"", b"ab", b""]
