import corpus_pipeline
from marginalia.llm import bpe, jaccard, lines, mixing, quality
from tests.conftest import SF
from tests.llm.test_edges import ROWS, labels


def test_stages_equal_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    step = [quality.keep_good(docs, labels)]
    step.append(lines.dedupe_lines(step[-1]).cache())
    step.append(jaccard.keep_one_per_group(step[-1]).cache())
    step.append(mixing.mixed(step[-1], corpus_pipeline.MIXTURE, floor=1.0))
    assert all(s.columns == docs.columns for s in step)
    want = sorted((r.doc_id, r.n_tokens) for r in bpe.encode(step[-1]).collect())
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and got
    assert {i for i, _ in got} == {r.doc_id for r in step[2].collect()}  # mixing drops no document


def test_stages_take_odd_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for table, least in ((rows, len(ROWS)), (rows.where("false"), 0)):
        docs = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.count() >= least and (i == 4 or docs.columns == table.columns)
