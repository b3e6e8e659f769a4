"""The registered queries against their SQL twins, and the pipeline stage by stage."""

import math
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from emberline.llm import pseudonyms, queries

SF = "/root/testdata/sf0.001"


def canon(rows):
    return sorted((tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
                         for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert canon(map(tuple, df.select(*columns).collect())) == canon(cursor.fetchall())


def test_every_number_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_pipeline_stages(spark):
    from test_duplicates import passages_plain
    from test_similar import similar_plain
    from test_texts import check_packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    was = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "private_data", "packing"]
    judged = {r.doc_id for r in queries.op5_repetition(spark, SF).where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == judged

    single = stages["near_duplicates"](spark, kept, SF)
    groups = similar_plain({i: was[i].text for i in judged})
    assert single.columns == columns
    assert Counter(r.doc_id for r in single.collect()) == Counter(min(g) for g in groups)

    cut = stages["repeated_passages"](spark, single, SF)
    before = sorted(single.collect())
    plain = passages_plain([r.text.encode() for r in before], 50, 400)
    want = {r.doc_id: t for r, t in zip(before, plain, strict=True)}
    after = cut.collect()
    assert cut.columns == columns and {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    masked = stages["private_data"](spark, cut, SF)
    mask = pseudonyms.Pseudonyms(queries.TEST_KEY.encode())
    assert masked.columns == columns and {r.doc_id: r.text for r in masked.collect()} == {i: mask(t)[0] for i, t in want.items()}

    check_packing(stages["packing"](spark, masked, SF).collect(), masked.collect())
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["packing"](spark, masked, SF).collect())
