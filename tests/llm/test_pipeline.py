"""The pipeline against the brute-force versions of its stages."""

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    a = stages["toxicity"](spark, docs, SMALL).cache()
    assert a.columns == docs.columns and 0 < docs.count() - a.count() < 0.2 * docs.count()
    b = stages["line_dedup"](spark, a, SMALL).cache()
    got, want = pairs(b), brute.line_dedup(pairs(a))
    assert b.columns == docs.columns and Counter((i, brute.sha(t)) for i, t in got) == Counter((r[0], r[3]) for r in want)
    c = stages["ngram_jaccard"](spark, b, SMALL).cache()
    assert pairs(c) == [(i, t) for (i, t), r in zip(got, brute.jaccard(got, 5, 80, 100), strict=True) if r[0] == r[2]]
    d = stages["decontamination"](spark, c, SMALL).cache()
    kept = pairs(c)
    assert pairs(d) == [x for x, r in zip(kept, brute.decontaminate(kept, bench), strict=True) if not r[2]]
    e = stages["packing"](spark, d, SMALL).collect()
    assert {r.doc_id for r in e} == {i for i, _ in pairs(d)}
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in e)


def test_one_document_of_each_group(spark):
    """Ids that repeat or are null: rows are told apart by their texts, and one of each group stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, d), (None, d), (8, d + " more"), (None, b + " more"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_documents(spark, docs, SMALL)
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns
    assert got == Counter([(3, a), (5, b), (7, c), (8, d + " more"), (9, ""), (9, ""), (None, None)])
    e = spark.createDataFrame([(None, d), (None, d), (None, d + " more")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    assert corpus_pipeline.dedup_documents(spark, e, SMALL).count() == 1


def test_long_documents_with_a_passage_go(spark):
    """A benchmark window is a twentieth of a long document's words at most, but the document goes; clean, null and empty ones stay."""
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text.split()
    filler = " ".join(f"filler{i}" for i in range(3000))
    rows = [(1, f"{filler} {' '.join(bench[:13])} {filler}"), (2, f"{filler} {' '.join(bench[:12])}"), (3, None), (4, ""), (None, filler), (5, filler), (5, filler), (6, " ".join(bench).upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_contaminated(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(x for x in rows if x[0] not in (1, 6))


def test_other_stages_on_nulls_and_repeats(spark):
    """Null and empty texts, repeated rows and an empty table pass every stage."""
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "more words here")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert Counter((r.doc_id, r.text) for r in stages["toxicity"](spark, docs, SMALL).collect()) == Counter(rows)
    assert Counter((r.doc_id, r.text) for r in stages["line_dedup"](spark, docs, SMALL).collect()) == Counter((i, t or "") for i, t in rows)
    assert stages["packing"](spark, docs, SMALL).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
