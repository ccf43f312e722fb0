"""The pipeline against its stages' plain counterparts on a small table."""

from collections import Counter

import corpus_pipeline
from plantstate.llm import mixing, omh, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = [(0, None, "en", "a", 0), (1, "", "en", None, 0), (2, "too short", "en", "a", 9)]
    for i in range(3, 60):
        base = [word() for _ in range(60)]
        text = " ".join(base) if i % 5 else " ".join(base) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
    rows += [(100 + r[0], r[1], r[2], r[3], r[4]) for r in rows[10:20]]
    rows += [(200 + r[0], r[1] + " extra", r[2], r[3], r[4] + 6) for r in rows[10:15]]
    return spark.createDataFrame(rows, SCHEMA)


def test_run_is_its_stages(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.key for r in quality.judged(d).collect() if r.kept}
    assert {0, 1, 2}.isdisjoint(kept)
    good = d.where(d.doc_id.isin(sorted(kept)))
    first = {}
    for r in omh.classes(good).collect():
        first[r.class_id] = min(first.get(r.class_id, r.key), r.key)
    single = good.where(good.doc_id.isin(sorted(first.values())))
    assert len(first) == 57
    clean = secrets.redacted(single)
    assert not [r for r in clean.collect() if "24be64439e" in r.text]
    copies = {r.key: r.copies for r in mixing.mix(clean).collect()}
    assert Counter(r.doc_id for r in got) == Counter({k: n for k, n in copies.items() if n})
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in got:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == [1, *sp.encode(texts[r.doc_id]), 2] and r.n_tokens == len(ids)


def test_stages_keep_columns(spark):
    d = docs(spark).withColumn("Extra", corpus_pipeline.F.lit(1))
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, d, "").columns == d.columns, name
        assert step(spark, d.limit(0), "").count() == 0
