"""The pipeline against its stages done one after another on plain rows."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from jobtide.llm import gam, linededup, queries

SF = "/root/testdata/sf0.001"


def test_all_stages(spark):
    from tests.llm.test_operators import brute_hits, library, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = gam.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    score = model.score(np.array([gam.figures(t) for _, t in rows]))
    rows = sorted((r for r, s in zip(rows, score, strict=True) if s >= gam.THRESHOLD))
    seen, kept = [], []
    for d, t in rows:
        lines = []
        for line in (t or "").split("\n"):
            w = line.encode().split()
            if len(w) < linededup.MIN_WORDS:
                lines.append(line)
                continue
            if not any(linededup.within_one(w, x) for x in seen):
                lines.append(line)
            seen.append(w)
        kept.append((d, "\n".join(lines)))
    fps = [plain_fingerprint(t) for _, t in kept]
    root = list(range(len(fps)))
    for _ in range(6):
        root = [min(root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for d, t in kept:
        n, hit, _, _ = brute_hits(t, items)
        if hit == 0 or 20 * hit < n:
            clean.append((d, t))
    lib = library()
    ids = {d: np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for d, t in clean}
    want = {(d, len(ids[d]) // 4, hashlib.sha256(ids[d]).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in clean}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_each_query_has_its_number():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


ODD = [
    (None, "no id here, but some words", "en"), (None, None, "en"), (1, None, "en"), (2, "", "en"), (3, " \n\t ", "de"), (4, "one two three four five six seven\n" * 3000, "en"),
    (5, "same text of seven words for two", "en"), (5, "same text of seven words for two", "en"), (5, "another text of the same id entirely", "en"), (6, "same text of seven words for two", "fr"),
]


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.selectExpr("*", "1 AS tie", "2 AS gone", "3 AS Slot", "'x' AS fingerprint", "4 AS key", "5 AS score", "6 AS line")
    extra.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", "four five six"), ("i2", None), (None, "x")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return extra


def test_stages_over_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows and clashing columns go through every stage; nothing is invented."""
    docs = odd_tables(spark, str(tmp_path), ODD)
    texts = {t for _, t, _ in ODD}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept = out.select("doc_id", "text").collect()
        assert len(kept) <= len(ODD) and {r.doc_id for r in kept} <= {d for d, _, _ in ODD}
        if name != "line_dedup":
            assert {r.text for r in kept} <= texts, name
        else:
            assert len(kept) == len(ODD) and sum(r.text is None for r in kept) == 2
        if name == "near_dedup":
            # equal texts once, whatever their ids; the text of a reused id is its own
            assert sorted(r.text for r in kept if r.text and "same" in r.text) == ["another text of the same id entirely", "same text of seven words for two"]
        if name == "decontamination":
            assert not any(r.text and "four five six" in r.text for r in kept) and len(kept) == len(ODD) - 1
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents_give_no_rows(spark, tmp_path):
    odd_tables(spark, str(tmp_path), ODD[:0] or [(1, "x", "en")])
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
