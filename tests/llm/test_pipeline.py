"""The pipeline against its stages in SQL and plain Python, and on awkward tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import pieces
from tidemark.llm.oracles import ORACLES

from test_llm import SCHEMA, _components, awkward


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def _expected(sf: str) -> dict[int, str]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    docs = con.execute(f"SELECT * FROM '{sf}/documents.parquet'").df()

    def ask(query: str):
        con.register("documents", docs)
        return con.execute(ORACLES[query]).df()

    kept = ask("op5_quality_rules")
    docs = docs[docs["doc_id"].isin(kept[kept["kept"]]["doc_id"])]
    lines = ask("op3_line_dedup").set_index("doc_id")
    docs = docs.assign(text=docs["doc_id"].map(lines["text"]))
    docs = docs[[bool(t.strip()) or lines["n_removed"][i] == 0 for i, t in zip(docs["doc_id"], docs["text"], strict=True)]]
    groups = _components(list(zip(docs["doc_id"], docs["text"], strict=True)))
    docs = docs[[groups[i][1] == i for i in docs["doc_id"]]]
    docs = docs[~docs["doc_id"].isin(ask("op2_spaced_seeds")["doc_id"])]
    return dict(zip(docs["doc_id"], docs["text"], strict=True))


def test_pipeline_against_brute_force(spark, sf, model_path):
    out = corpus_pipeline.run(spark, sf)
    got = pieces.decoded(out, model_path, [F.col("doc_id")])
    want = _expected(sf)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and len(want) > 50


def test_stages_keep_columns_of_awkward_tables(spark, sf):
    for docs in (awkward(spark), spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == awkward(spark).columns
