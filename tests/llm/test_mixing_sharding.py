"""Mixing and sharding: SQL on many shards, odd columns, large rates, the ways beyond broadcasts."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from sievelake.llm import entries, mixing, sharding
from sievelake.llm.mixing import mix_sources
from sievelake.llm.sharding import assign_shards, write_shards

DATA = "/root/testdata/sf0.001"
CLASH = ("rate double, distribution int, steps int, first int, _source string, source_ string, h int, at int, places int, place int, shard_prefix string, _h int, _prefix int, "
         "shard_id string, COPY int, count int, block int, salt int, u int")


def clashing(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, kind in (c.strip().split(" ") for c in CLASH.split(",")):
        d = d.selectExpr("*", f"cast('7' AS {kind}) AS `{name}`")
    return d


ROWS = [(i, f"text {i} " * (i % 7), "ab"[i % 2]) for i in range(40)] + [(None, "no id", None), (None, None, None), (3, "again", "a")]


@pytest.mark.parametrize("most", [sharding.BROADCAST_SHARDS, 0])
def test_sharding_keeps_columns_and_fits(spark, most):
    d = clashing(spark, ROWS)
    got = assign_shards(d, 100, broadcast_shards=most).collect()
    assert len(got) == len(ROWS)
    names = [c for c in d.columns if c != "shard_id"]
    assert all(str(r[c]) in ("7", "7.0") for r in got for c in names[3:])
    size, keys, rows = Counter(), {}, Counter()
    for r in got:
        bits = f"{int(hashlib.md5(('null' if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16):060b}"
        assert bits.startswith(r.shard_id) and len(r.shard_id) == r.shard_depth
        size[r.shard_id] += len((r.text or "").encode())
        rows[r.shard_id] += 1
        keys.setdefault(r.shard_id, set()).add(r.doc_id)
    assert all(r.shard_bytes == size[r.shard_id] and r.shard_rows == rows[r.shard_id] for r in got)
    assert all(size[s] <= 100 or len(keys[s]) == 1 for s in size) and len(size) > 4
    # Only an oversized bucket splits: what a shard and all shards beside it hold exceeds the limit.
    for s in size:
        assert not s or sum(n for t, n in size.items() if t.startswith(s[:-1])) > 100


@pytest.mark.parametrize("limit, most", [(4096, sharding.BROADCAST_SHARDS), (4096, 0), (300, sharding.BROADCAST_SHARDS)])
def test_sharding_on_many_shards_as_in_sql(spark, limit, most):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    sql = entries.oracle_sql()["op9_extendible_sharding"].replace("1048576", str(limit))
    want = con.execute(f"SELECT doc_id, shard_id, shard_depth, shard_bytes, shard_rows FROM ({sql})").fetchall()
    got = assign_shards(spark.read.parquet(f"{DATA}/documents.parquet"), limit, most).select("doc_id", "shard_id", "shard_depth", "shard_bytes", "shard_rows")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[1] for w in want}) > 50


def test_deeper_levels_of_one_heavy_key(spark):
    rows = [(1, "x" * 50, "a")] * 200 + [(i, "y" * 10, "a") for i in range(2, 300)]
    got = assign_shards(clashing(spark, rows), 60).collect()
    assert len(got) == len(rows)
    ids = {}
    for r in got:
        ids.setdefault(r.shard_id, []).append(r.doc_id)
    assert all(len(x) <= 6 or set(x) == {1} for x in ids.values()) and sum(x.count(1) for x in ids.values()) == 200


def test_no_text_is_shuffled(spark):
    plan = assign_shards(spark.read.parquet(f"{DATA}/documents.parquet"), 4096)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_shards_are_written_whole(spark, tmp_path):
    sharded = assign_shards(spark.createDataFrame(ROWS, "doc_id long, text string, source string"), 200)
    write_shards(sharded, f"{tmp_path}/out")
    back = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, sharded.select("doc_id", "text").collect()))


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while u >= total:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("most", [mixing.BROADCAST_STEPS, 0])
def test_mixing_by_weights_against_inversion(spark, most):
    d = clashing(spark, ROWS)
    got = mix_sources(d, {"a": 3.0, "b": 1.0, "absent": 2.0}, epochs=4.0, broadcast_steps=most).collect()
    n = Counter(r[2] for r in ROWS)
    want = Counter()
    for doc_id, text, source in ROWS:
        if source:
            rate = {"a": 3.0, "b": 1.0}[source] / 4 * len(ROWS) * 4 / n[source]
            u = int(hashlib.md5(f"mix-1|{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
            for k in range(1, poisson(u, rate) + 1):
                want[doc_id, text, k] += 1
    assert Counter((r.doc_id, r.text, r.copy) for r in got) == want
    assert all(str(r["rate"]) == "7.0" and r["steps"] == 7 and r["_source"] == "7" for r in got)
    assert not mix_sources(d, {}).count() and not mix_sources(d.limit(0), {"a": 1.0}).count()


def test_mixing_large_rates(spark):
    rows = [(1, "rare", "tiny")] + [(i, "x", "big") for i in range(2, 2000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"tiny": 1.0, "big": 1.0}, epochs=20.0)
    rate = 1999 * 20 / 2
    copies = got.where("source = 'tiny'").agg({"copy": "max", "*": "count"}).first()
    assert copies[0] == copies[1] and abs(copies[0] - rate) < 6 * rate**0.5
    with pytest.raises(ValueError):
        mix_sources(got, {"tiny": -1.0})
