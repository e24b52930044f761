"""The pipeline, stage by stage, against brute force on a small table."""

import numpy as np

import corpus_pipeline
from wordloom.llm.queries import tokenizer_file


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage, leak = text(120), text(60), text(12)
    rows = [
        (0, base),
        (1, base),
        (2, base + " extra"),
        (3, text(40) + " " + passage),
        (4, text(45) + " " + passage + " " + text(5)),
        (5, text(20) + " " + leak + " " + text(9)),
        (6, text(80)),
        (7, None),
        (8, "123 %%"),
        (9, text(3)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {3: rows[3][1], 4: " ".join(w for w in rows[4][1].split()[:45] + rows[4][1].split()[105:]), 0: base, 6: rows[6][1], 9: rows[9][1]}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == docs.columns
        kept.append({r.doc_id for r in now.collect()})
    assert kept == [{0, 1, 2, 3, 4, 5, 6, 9}, {0, 3, 4, 5, 6, 9}, {0, 3, 4, 5, 6, 9}, {0, 3, 4, 6, 9}]
    assert {r.doc_id: r.text for r in now.collect()} == left and all(r.n_chars == len(r.text) for r in now.collect())
    tokenizer = Tokenizer.from_file(tokenizer_file())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
