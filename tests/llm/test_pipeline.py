import os

import pytest

import corpus_pipeline
from palisade.llm import queries as Q
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    assert same(Q.queries()[name](spark, DATA), Q.oracle_sql()[name], DATA) > 0


#: The pipeline's stages all have something to do on the larger table.
MORE = DATA.replace("sf0.001", "sf0.01")


def test_stages(spark, tmp_path):
    """Each stage against plain loops or SQL over what its predecessor kept; what toxicity decides is checked with its operator."""
    import duckdb
    import numpy as np

    from palisade.llm import packing
    from palisade.llm.source_mixing import OP3_SQL
    from palisade.llm.toxicity import score_toxicity, train
    from tests.llm import test_exact, test_models, test_near

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]

    def written(stage, given):
        path = str(tmp_path / f"stage{stage}")
        corpus_pipeline.STAGES[stage][1](spark, given, MORE).write.parquet(path)
        out = spark.read.parquet(path)
        return out, [tuple(r) for r in out.collect()]

    clean, rows = written(0, docs)
    judged = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, train(docs, spark.read.parquet(f"{MORE}/labels.parquet"))).collect()}
    given = [tuple(r) for r in docs.collect()]
    assert sorted(rows) == sorted(r for r in given if not judged[r[0]]) and 0 < len(rows) < len(given)
    single, after = written(1, clean)
    kept = {i for i, r in test_exact.brute(rows).items() if r[2]}
    assert sorted(after) == sorted(r for r in rows if r[0] in kept) and len(after) < len(rows)
    apart, rows = written(2, single)
    kept = {i for i, (_, c) in test_near.brute({r[0]: r[1] for r in after}).items() if i == c}
    assert sorted(rows) == sorted(r for r in after if r[0] in kept) and len(rows) < len(after)
    mixed, after = written(3, apart)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/stage2/*.parquet'")
    assert sorted(after) == sorted(con.execute(f"SELECT {', '.join(docs.columns)} FROM ({OP3_SQL})").fetchall())
    packed, _ = written(4, mixed)
    out = packed.collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == test_models.pieces([(r[0], r[1]) for r in after])
    assert test_models.check_packed(out) <= packing.lower_bound(np.array([r["length"] for r in out]), 2048) + 1
    assert corpus_pipeline.run(spark, MORE).count() == len(out)
