import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.saved(stage(spark, now, SF), name)
        if name != "mixing":
            assert now.columns == docs.columns
        seen.append(now.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert now.filter("copies < 1 or copies > 3").count() == 0


def test_near_copies_leave_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(50))
    own = " ".join(f"v{k}" for k in range(50))
    rows = [(5, text), (2, text), (2, text), (9, text + " more"), (7, "other text of its own here"), (None, text), (3, None), (None, own), (None, own), (None, own + " x"), (7, text + " again"), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("en"))
    kept = corpus_pipeline.near_copy_stage(spark, docs, SF).collect()
    ids = sorted((r["doc_id"] or 0) for r in kept)
    assert ids == [0, 2, 3, 7, 8, 8] and [r["text"] for r in kept if r["doc_id"] == 7] == ["other text of its own here"]
    assert [r["text"] in (own, own + " x") for r in kept if r["doc_id"] is None] == [True]


def test_decontamination_judges_each_row_by_its_text(spark, tmp_path):
    item = " ".join(f"q{k}" for k in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "before " + item), (4, "clean text"), (4, item + " after"), (5, None), (None, "clean"), (6, item), (6, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    kept = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "clean"), (4, "clean text"), (5, "")]


def test_every_stage_takes_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, SF).collect()
        assert len(out) <= odd_docs.count()
        assert stage(spark, no_docs, SF).count() == 0, name
        texts = [r["text"] for r in out]
        if name == "language":
            assert None not in texts and "" not in texts
        if name == "decontamination":
            assert len(out) == odd_docs.count()


def shingled(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({("only", *w)} if w else set())


def test_last_three_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept, result = docs, []
    for name, stage in corpus_pipeline.STAGES[2:]:
        kept = corpus_pipeline.saved(stage(spark, kept, SF), name)
        result.append(kept)

    sets = {k: shingled(r["text"], 5) for k, r in rows.items()}
    smallest = {}
    for k in sorted(rows):
        links = [j for j in rows if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j])]
        group = {k}.union(*[smallest[j] for j in links if j in smallest])
        for j in group:
            smallest[j] = group
    alone = {k for k in rows if k == min(smallest[k])}
    assert {r["doc_id"] for r in result[0].collect()} == alone

    items = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        items.setdefault(r["item_id"], set()).update(shingled(r["text"], 5))
    clean = {k for k in alone if not any(i and len(i & sets[k]) >= 0.8 * len(i) for i in items.values())}
    assert {r["doc_id"] for r in result[1].collect()} == clean

    sizes = {k: len((rows[k]["text"] or "").encode().split()) for k in clean}
    sources = sorted({rows[k]["source"] for k in clean}, key=lambda s: (s is None, s))
    total = {s: sum(n for k, n in sizes.items() if rows[k]["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and level * weight[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * total[s] if s in full else level * weight[s] for s in sources}
    mixed = result[2].collect()
    assert {r["doc_id"] for r in mixed} <= clean
    for s in sources:
        own = [r for r in mixed if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 * target[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(sizes.values())


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    sizes = lambda docs: [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    try:
        spark.conf.unset(key)
        docs = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("long text "), 200).alias("text"))
        corpus_pipeline.mixing_stage(spark, docs.select(F.lit(1).cast("long").alias("doc_id"), "text", F.lit("a").alias("source")), SF)
        assert max(sizes(docs)) < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(key, "1000000")  # a session's own size stays
        corpus_pipeline.language_stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), SF)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)
        if own is not None:
            spark.conf.set(key, own)
