import random
import re

import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"thing{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(60)) for i in range(30)]
    item = text(20)
    rows += [(30, rows[0][1] + " more"), (31, rows[1][1]), (32, text(30) + " . " + item + " " + text(10)), (33, None), (34, "12 34"), (35, "the shared line of text\n" + text(40)), (36, "The SHARED line of text \n" + text(40)), (37, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    given = dict(rows)
    assert seen[0] == {i: t for i, t in given.items() if t and re.search("[a-z]", t)}
    assert seen[1].keys() == seen[0].keys() - {31} and seen[1][36] == given[36].split("\n")[1] and seen[1][35] == given[35]
    assert seen[2].keys() == seen[1].keys() - {30}
    assert seen[3].keys() == seen[2].keys() - {32}
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert last.keys() == seen[3].keys() and all(r["round_trip"] and r["decoded"] == seen[3][i] and len(r["ids"]) == r["n_tokens"] for i, r in last.items())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "sentencepiece"]
