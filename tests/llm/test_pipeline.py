import tiktoken  # noqa: F401
from plain import components, contamination, text_counts
from pyspark.sql import functions as F

import corpus_pipeline
from crawlgauge.llm import bpe, decision_list, pii_crf
from crawlgauge.llm.common import table


def test_pipeline_equals_plain_stages(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rules = decision_list.learn_from(docs, labels)
    judged = {r.doc_id: r.kept for r in decision_list.judge(docs, rules).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = []
    for i, t in rows:
        c = text_counts(t)
        if judged[i]:
            assert c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]
            kept.append((i, t))
    first = components([t for _, t in kept], corpus_pipeline.NUM, corpus_pipeline.DEN, corpus_pipeline.SHINGLE)
    kept = [kept[c] for c in sorted(set(first))]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    clean = []
    for i, t in kept:
        n, hit, _ = contamination(t, items)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    model, enc = pii_crf.default_model(), bpe.encoding()
    want = {}
    for i, t in clean:
        text = pii_crf.redact_text(t, pii_crf.all_spans([t], model)[0])
        want[i] = enc.encode_ordinary(text)
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "byte_bpe"


def test_stages_keep_columns_with_names_of_their_own(spark, small):
    given = table(spark, small, "documents").limit(30)
    long = " ".join(f"word{i}" for i in range(40_000))
    odd = [(None, None), (None, ""), (7_000_001, long), (7_000_002, long), (7_000_002, long), (None, long)]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    docs = given.unionByName(odd, allowMissingColumns=True).unionByName(given.limit(3))
    names = ["n_words", "kept", "copies", "contaminated", "items", "_k1", "_id", "cls"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        found = out.select("doc_id", "text", *names).collect()
        assert all(r[c] == f"own {c}" for r in found for c in names)
        if name == "ngram_jaccard_join":
            # Texts without words all stay; of the long ones the smallest id.
            assert [r.doc_id for r in found if r.text == long] == [7_000_001]
            assert len([r for r in found if not r.text]) == 2
        elif name in ("benchmark_decontamination", "pii"):
            assert len([r for r in found if r.text == long]) == 4
            assert name != "pii" or len(found) == rows
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == rows
