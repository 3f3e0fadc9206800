import corpus_pipeline
from test_line_runs import brute

from foretell.llm import decontaminate, mixing, robust_rules, simhash


def test_every_stage_works_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        texts = {r.doc_id: r.text for r in before.collect()}
        assert kept[name].keys() <= texts.keys()
        if name == "quality_rules":
            assert kept[name].keys() == {r.doc_id for r in robust_rules.judge(before).collect() if r.kept}
        if name == "near_dedup":
            prints = {d: simhash.fingerprint(t) & (1 << 64) - 1 for d, t in texts.items()}
            sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [t.lower().split()]}
            near = lambda d, e: (prints[d] ^ prints[e]).bit_count() <= 2 or len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])
            root = {d: d for d in texts}

            def find(d):
                while root[d] != d:
                    d = root[d]
                return d

            for d in texts:
                for e in texts:
                    if e < d and near(d, e):
                        a, b = sorted((find(d), find(e)))
                        root[b] = a
            assert kept[name].keys() == {find(d) for d in texts}
        if name == "line_dedup":
            want = brute(list(texts.items()))
            assert kept[name] == {d: want[d, t] for d, t in texts.items() if want[d, t].strip() or want[d, t] == t}
        if name == "decontamination":
            found = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert kept[name].keys() == texts.keys() - found
    direct = sorted((r.doc_id, r.epoch, r.taken_tokens) for r in mixing.mix(docs).collect())
    assert sorted((r.doc_id, r.epoch, r.taken_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect()) == direct
    assert direct


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    good = " ".join(f"word{(k * k) % 997}" for k in range(80))
    rows = [(i, good + f" {i} end", "en", "src1", 1, "a", 2) for i in range(30)] + [(1, good + " 1 end", "en", "src1", 1, "a", 2), (None, "other " + good[::-1], None, None, 1, "a", 2), (40, None, "en", "src1", 0, "a", 2), (41, "", None, "src2", 0, "a", 2), (1, "and " + " ".join(f"new{k}" for k in range(70)), "en", "src1", 1, "a", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, rest int")
    for name, docs in (("some", table), ("none", table.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "a benchmark item that no text holds")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in out} <= {*range(30), None} and out
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
