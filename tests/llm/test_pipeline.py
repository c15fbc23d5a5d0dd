import collections
import re

import corpus_pipeline
from tidepanel.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_runs_and_stages_hold(spark, tmp_path):
    from .test_llm import labelled

    rs = [(i, t + (f" mail me{i}@host.example.com" if i % 5 == 0 else ""), lang, src, len(t)) for i, t, lang, src, _ in labelled(200)]
    rs += [(10_000 + i, rs[i][1], "en", "copy", len(rs[i][1])) for i in range(20)] + [(20_000, None, None, None, None), (20_001, "", "en", None, 0)]
    spark.createDataFrame(rs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rs if r[0] % 2 and r[0] < 400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            kept.append(docs.collect())
        else:
            packed = out.collect()
    good = {r.doc_id for r in kept[0]}
    assert len([i for i in range(200) if i in good]) >= 196 and len([i for i in range(200, 400) if i in good]) <= 4
    assert not any(10_000 <= r.doc_id < 10_020 for r in kept[1]) and {i for i in range(200) if i in good} <= {r.doc_id for r in kept[1]}
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]} and not any("@host" in (r.text or "") for r in kept[2])
    words = collections.Counter()
    for r in kept[3]:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.n_words
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in words.items() if v}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_near_duplicates_of_the_pipeline_share_five_word_shingles(spark):
    words = [f"w{i}" for i in range(43)]
    other = [*words[:20], "other", *words[21:]]  # 36 of 44 four-word shingles, but 34 of 44 five-word ones
    near = [*words, *(f"x{i}" for i in range(40))]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(near)), (4, " ".join([*near[:30], "other", *near[31:]])), (5, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2, 3, 5, 6]
