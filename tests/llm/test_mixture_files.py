"""The files of the pipeline's mixture."""

import glob

import pyarrow.parquet as pq

import corpus_pipeline
from tracelake.llm import pfair_mix


def test_files_hold_the_mixture_whole_and_in_order(spark, tmp_path):
    """Every row of the stage's input is in its files, with all columns, in the order that the tokens stage tells."""
    rows = [(i if i % 50 else None, f"text {i}", "en", ("a", "b", None)[(i % 7) % 3], 9) for i in range(1, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    corpus_pipeline.mixture(spark, docs, "").write.parquet(f"{tmp_path}/out")
    files = [r for f in sorted(glob.glob(f"{tmp_path}/out/*.parquet")) for r in pq.read_table(f).to_pylist()]
    assert sorted(map(repr, (tuple(r.values()) for r in files))) == sorted(map(repr, rows))
    place = {(r.doc_id, r.source): r.mix_order for r in pfair_mix.mixed(docs).collect()}
    places = [place[r["doc_id"], r["source"]] for r in files]
    assert places == sorted(places)
    told = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/out"), "").collect()
    assert sorted(r.mix_order for r in told) == places
