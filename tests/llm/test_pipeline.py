import random

import corpus_pipeline
from mendwork.llm import decontaminate, simhash_sets


def test_stages_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in got}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "decontamination", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept and kept < set(texts) and len({texts[i] for i in kept}) == len(kept)
    hits = decontaminate.with_hits(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("size(hit_items) > 0")
    assert not kept & {r.doc_id for r in hits.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name


def test_dedup_stage_finds_similar_five_word_sets(spark):
    rng = random.Random(9)
    rows, word = [], lambda: f"w{rng.randint(0, 3000)}"
    for i in range(60):
        base = [word() for _ in range(rng.choice([60, 150, 300]))]
        rows.append(" ".join(base))
        for _ in range(i % 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice([30, 50, 90]))):
                copy[at] = word()
            rows.append(" ".join(copy))
    rows += ["", " ", "same words", "Same words"]
    ids = [*range(len(rows)), 7, None, None, None]
    rows += ["a text of its own under an id that another text has", "no id here", "no id here", rows[0]]
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    want = sorted(min((ids[k] is None, ids[k] or 0, rows[k]) for k in own) for own in groups.values())
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, rows)], "doc_id long, text string, lang string")
    for crowd in (8, 1):  # with 1, sets that are alike and not linked go the way of crowded ones
        simhash_sets.CROWD = crowd
        got = corpus_pipeline.one_of_each_group(spark, docs, "")
        assert got.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()) == want
