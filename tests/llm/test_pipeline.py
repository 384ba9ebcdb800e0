"""The pipeline's stages on odd rows, and end to end against its statement on planted tables."""

import duckdb
import pytest

import corpus_pipeline
from sievelake.llm import store

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"p{i}" for i in range(20))


def words(start, n):
    return " ".join(f"w{start}x{i}" for i in range(n))


def tables(spark, at):
    rows = [(i, words(i // 2 if i < 20 else i, 40), "en" if i % 3 else "de", "ab"[i % 2], 9) for i in range(60)]
    rows += [(100, PASSAGE + " " + words(100, 30), "en", "a", 9), (101, words(101, 5), "en", "a", 9), (102, "again and again he said " * 20, "en", "b", 9)]
    rows += [(103, words(103, 30), None, None, None), (104, words(104, 1500), "en", "b", 9)]
    labels = [(i, i % 2, 0) for i in range(0, 60, 3)]
    items = [(1, PASSAGE), (None, words(30, 12)), (3, None)]
    for name, data, kinds in (("documents", rows, KINDS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, kinds).coalesce(2).write.parquet(f"{at}/{name}.parquet")
    return rows


def test_end_to_end_as_in_sql(spark, tmp_path):
    rows = tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    r = con.execute(corpus_pipeline.ORACLE_SQL)
    cols = [c[0] for c in r.description]
    begin = store.written()
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, got.select(cols).collect()))) == sorted(map(str, r.fetchall()))
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {100, 101, 102, 30} and not kept & {i for i in range(1, 20, 2)} and len(kept) < len(rows)
    # What stages wrote for themselves is gone; the last stage's input and directory are there.
    names = [path.rsplit("/", 1)[1] for _, path in store._written[begin:]]
    assert [n for n in names if n.startswith("stage-")] == [n for n in names if n.startswith("stage-mix")] and not [n for n in names if n.startswith("signed")]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    tables(spark, tmp_path)
    odd = [(None, None, None, None, None), (None, words(7, 20), "en", None, 1), (1, "", "en", "a", 0), (2, words(2, 30), "en", "a", 1), (2, words(2, 30), "en", "a", 1), (3, " \n ", "??", "b", 3),
           (4, words(9, 20_000), "fr", "c", 1), (5, "é 𝒳 " * 30, "fr", "c", 1)]
    docs = spark.createDataFrame(odd, KINDS).selectExpr("*", "1 AS kept", "2 AS copy", "'x' AS shard_id", "3 AS _row", "4 AS rate", "5 AS h", "6 AS _m")
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    got = out.collect()
    if stage != "shard":
        assert out.columns == corpus_pipeline.COLUMNS
    assert {str(r[:5]) for r in got} <= {str(r) for r in odd}
    want = {"quality": {"2", "4", "None"}, "near_dedup": {"None", "1", "2", "3", "4", "5"}, "decontaminate": {"None", "1", "2", "3", "4", "5"}, "shard": {"None", "1", "2", "3", "4", "5"}}
    if stage in want:
        assert {str(r.doc_id) for r in got} == want[stage]
        assert sum(r.doc_id == 2 for r in got) == 2
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert run(spark, docs.drop("n_chars"), str(tmp_path)).where("n_chars is not null").count() == 0
