"""The pipeline against a brute-force version of its decisions."""
import re

from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import toxicity_kn
from larder.llm.common import words_of
from tests.llm.test_dedup_and_joins import brute_components, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity_kn.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    kept = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id not in toxic}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    kept = {i: kept[i] for i, _, c in brute_components(list(kept.items())) if i == c}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i, t in kept.items() if not any(q and 100 * len(q & shingles(t)) >= 80 * len(q) for q in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == kept
    assert sum(r.piece == 0 for r in got) == len(kept)


def test_stages_keep_columns_and_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a  b c d e f", None, None, None), (3, None, None, None, None),
            (4, "", "en", "s", 0), (None, "lost", None, None, None), (5, "word " * 30_000, "en", "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        out = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
        ids = sorted((r.doc_id for r in out.collect()), key=str)
        assert ids == ([1, 3, 5, None] if table is docs else [])
        assert words_of(None) == []


def test_exact_dedup_stage_keeps_clashing_columns(spark):
    rows = [(1, "a b", "x", 1), (1, "a  b", "x", 1), (2, "c", "y", 2), (3, "a b", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _Text string, _text_ int")
    left = corpus_pipeline.drop_copies(spark, docs, SF)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["_Text"], r["_text_"]) for r in left.collect()) == [(1, "x", 1), (2, "y", 2)]


def test_decisions_are_taken_per_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity_kn.score_toxicity(docs, labels).collect()}
    texts = sorted((r for r in docs.collect() if r.text and len(r.text.split()) > 40), key=lambda r: score[r.doc_id])
    bad, calm = texts[-1].text, []
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    for r in texts:  # clean texts that share nothing
        if len(calm) < 4 and not any(shingles(r.text) & shingles(t) for t in calm + items):
            calm.append(r.text)
    copied, alone, near, third = calm
    item = max(items, key=len)
    few = near.rsplit(None, 1)[0]
    big = 10 ** 9
    rows = [(big, bad), (big, copied), (None, bad), (None, alone),       # an id's toxic text goes alone
            (big + 1, copied), (None, copied), (None, copied),           # of copies the smallest id stays, rows without one last
            (-7, near), (None, few), (-7, third),                        # negative ids come first
            (big + 2, f"x {item}"), (None, f"{item} y")]                 # the benchmark item
    out = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_KEY", F.lit(1))
    learned = docs.withColumn("_KEY", F.lit(0))
    plain = spark.createDataFrame([(2 * big + i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    toxic = {rows[r.doc_id - 2 * big][1] for r in toxicity_kn.score_toxicity(learned.drop("_KEY").unionByName(plain), labels)
             .filter(f"doc_id >= {2 * big} and predicted = 1").collect()}
    assert bad in toxic and not toxic & set(calm)
    out = corpus_pipeline.drop_toxic(spark, learned.unionByName(out), SF).filter("_KEY = 1")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((r for r in rows if r[1] not in toxic), key=str)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, SF)
        assert out.columns == ["doc_id", "text", "_KEY"], name
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([(big, copied), (None, alone), (-7, near), (-7, third)], key=str)
