"""SQL oracles over whole tables, and the pipeline against its stages."""

import pytest
from conftest_paths import SF0001
from check_oracle import compare, duck
from fairaudit.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, msg, *_ = compare(spark, con, name, QUERIES[name], ORACLES[name], SF0001)
    assert ok, msg


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_pipeline_rows(spark):
    """The packed pieces are the tokens of what a plain version of the stages keeps."""
    import zlib
    import numpy as np
    import corpus_pipeline as cp
    from fairaudit.llm import near_dedup, quality
    from fairaudit.llm.tokens import tokenizer, vocabulary_path
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality.with_quality(docs).collect() if r["kept"]}
    a = cp.quality_stage(spark, docs, SF0001)
    assert {r["doc_id"]: r["text"] for r in a.collect()} == kept
    ids = sorted(kept)
    grams = {i: near_dedup.kmers([kept[i].lower().split()])[0] for i in ids}
    group = {i: i for i in ids}
    for x in ids:
        for y in ids:
            if x < y and near_dedup.similarity(grams[x], grams[y]) >= 0.8:
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if v == old else v for k, v in group.items()}
    b = cp.dedup_stage(spark, a, SF0001)
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(set(group.values()))
    c = cp.pii_stage(spark, b, SF0001)
    d = cp.mix_stage(spark, c, SF0001).collect()
    assert c.columns == docs.columns == list(d[0].asDict())
    tok = tokenizer(vocabulary_path())
    want = []
    for r in d:
        t = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want += [(r["doc_id"], s, zlib.crc32(np.asarray(t[s:s + 4096], "<u4").tobytes())) for s in range(0, len(t), 4096)]
    got = [(r["doc_id"], r["start"], r["ids_crc32"]) for r in cp.run(spark, SF0001).collect()]
    assert sorted(got) == sorted(want)
