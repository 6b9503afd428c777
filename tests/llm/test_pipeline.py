import os
import subprocess
import sys

import corpus_pipeline
from skyloom.llm.scratch import materialize

from .test_benchmark_leaks import brute as leaks
from .test_near_dup import brute as duplicates
from .test_quality import base, corpus

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "byte_bpe":
            assert all(r.n_tokens == len(r.ids) for r in after.values()) and set(after) == set(before)
            continue
        assert docs.columns == columns
        if name == "quality_rules":
            assert not any(base(r.text)[-1] for r in after.values())
        if name == "near_dup":
            assert set(after) == {i for i, (_, c) in duplicates([(i, r.text) for i, r in before.items()]).items() if i == c}
        if name == "benchmark_leaks":
            assert all(leaks(r.text, items)[1] == 0 for r in after.values())
            assert all(r.text == before[i].text for i, r in after.items() if leaks(before[i].text, items)[1] == 0)


def test_clean_documents_stay(spark):
    docs = corpus(spark, 0).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 300


def test_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, SF), name)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_library_does_not_need_this_subpackage():
    code = "import sys; sys.modules['skyloom.llm'] = None; import __spark_entry__ as e; assert 'gnd' in e.queries() and not any(k.startswith('op') for k in e.queries()) and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
