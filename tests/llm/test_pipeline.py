import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strandweave.llm import decontaminate, piece_bpe
from tests.llm.cases import BASE, NEAR, awkward_documents, empty_documents
from tests.llm.test_minhash import brute_force
from tests.llm.test_native import _drop

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = pipeline.keep_good(spark, docs, SF).select(COLUMNS).collect()
    ids = {r.doc_id for r in kept}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert len(ids & clean) >= 0.95 * len(clean) and len(ids & {i for i, r in labels.items() if r.quality == 0}) <= 2

    frame = spark.createDataFrame(kept, docs.schema)
    lines = sorted(pipeline.drop_lines(spark, frame, SF).collect(), key=lambda r: r.doc_id)
    before = sorted(kept, key=lambda r: r.doc_id)
    want, _ = _drop([r.text for r in before], 10, False)
    assert [r.text for r in lines] == want and all(r.n_chars == len(r.text) for r, old in zip(lines, before) if r.text != old.text)

    frame = spark.createDataFrame(lines, docs.schema)
    single = pipeline.drop_near_copies(spark, frame, SF).collect()
    truth = brute_force([(r.doc_id, r.text) for r in lines], 5, 80)
    assert {r.doc_id for r in single} == {i for i, (_, _, first) in truth.items() if first}

    frame = spark.createDataFrame(single, docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contaminated(frame, bench).collect()}
    free = pipeline.drop_leaks(spark, frame, SF).collect()
    assert {r.doc_id for r in free} == {r.doc_id for r in single} - leaks
    texts = [r.text for r in bench.collect()]
    assert not any(t in r.text for t in texts for r in free)

    sp = piece_bpe.encoder(public_tokenizers.path("piece_bpe_32k.model")).library
    out = {r.doc_id: r for r in pipeline.to_pieces(spark, spark.createDataFrame(free, docs.schema), SF).collect()}
    assert all(out[r.doc_id].ids == sp.encode(r.text, add_bos=True, add_eos=True) for r in free) and len(out) == len(free)
    assert {r.doc_id for r in pipeline.run(spark, SF).collect()} == set(out)


def test_stages_awkward(spark):
    docs = awkward_documents(spark).select(*COLUMNS, F.col("kept").alias("_matches"))
    for name, stage in pipeline.STAGES:
        for frame in (docs, empty_documents(spark).select(*COLUMNS)):
            rows = stage(spark, frame, SF)
            if name != "pieces":
                assert rows.columns == [c for c in frame.columns if c in rows.columns] and set(COLUMNS) <= set(rows.columns)
            assert rows.count() <= frame.count()
            if name not in ("pieces",):
                assert {r["_matches"] for r in rows.collect()} <= {r["_matches"] for r in frame.collect()}


def test_near_copies_with_shared_and_missing_ids(spark):
    far = " ".join(f"far{k}" for k in range(60))
    rows = [(1, BASE), (2, NEAR), (2, "a unique text under an id that a near copy has too"), (None, NEAR + " more"), (None, far), (None, far.replace("far30 ", "x ")),
            (None, "an unrelated text without an id"), (None, "an unrelated text without an id"), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    fixed = [rows[0], rows[2], rows[6], (None, ""), (None, "")]
    assert sorted(map(str, left)) in [sorted(map(str, [*fixed, one])) for one in rows[4:6]]
