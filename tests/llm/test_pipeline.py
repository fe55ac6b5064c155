"""The pipeline's stages against brute force on a small corpus, each on what the one before kept."""

import random

import corpus_pipeline
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    good = lambda: " ".join(f"{rng.choice('abcd')}{rng.randrange(10**6)}" for _ in range(rng.randint(20, 60)))
    texts = [good() for _ in range(300)]
    texts += [" ".join(w + "%%%" for w in good().split()) for _ in range(100)]
    texts += [texts[i] for i in range(20)] + [texts[i].replace(" ", "  ", 1) for i in range(20, 30)]
    texts += [" ".join(texts[i].split()[:-1] + ["changed"]) for i in range(30, 50)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [sorted(r["doc_id"] for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == COLUMNS
        kept.append([r["doc_id"] for r in docs.collect()])
    clean = range(300)
    assert set(clean) <= set(kept[1]) and sum(300 <= i < 400 for i in kept[1]) < 10
    # copies of 0 to 29 go, near copies of 30 to 49 go
    assert not set(range(400, 430)) & set(kept[2]) and set(clean) <= set(kept[2]) and len(kept[2]) == len(set(kept[2]))
    assert not set(range(430, 450)) & set(kept[3]) and set(clean) <= set(kept[3])
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {p["doc_id"] for p in pieces} == set(kept[4])


def test_run_and_columns(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(0 <= r["offset"] < 4096 for r in got)
    assert len(corpus_pipeline.STAGES) == 5
