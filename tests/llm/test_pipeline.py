"""The pipeline's stages, each on what the one before kept, against plain Python."""

import os
import re
import zlib

import pytest

import corpus_pipeline
from tests.llm.test_operators import base_spans, brute_components, check_packing

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before and after each stage."""
    from tidemark.llm import storage

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(200)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "a token=abcdefgh1234 here", "en", "s", 25)], docs.schema)
    docs = storage.keep(docs.unionByName(extra), "test")
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = storage.keep(stage(spark, docs, DIR), "test")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == COLUMNS
        found.append(docs.collect())
    return found


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_quality_keeps_good_documents(spark, steps):
    before, after = ({r.doc_id: r for r in steps[k]} for k in (0, 1))
    assert set(after) <= set(before) and all(after[d] == before[d] for d in after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.95 * len(good)


def test_near_duplicates(steps):
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    component = brute_components([r.text for r in rows], 5, 80)
    kept = {rows[i].doc_id for i, (n, c) in component.items() if c == i}
    assert {r.doc_id for r in steps[2]} == kept


def test_decontamination(spark, steps):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())
    items = [grams(words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in steps[2] if not any(len(i & grams(words(r.text))) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in steps[3]} == clean


def test_secrets(steps):
    before, after = ({r.doc_id: r for r in steps[k]} for k in (3, 4))
    assert set(before) == set(after)
    for d, r in before.items():
        text = r.text
        for start, _, span, _ in sorted(base_spans(text), reverse=True):
            inner = [x for x in base_spans(text) if x[0] < start < int(x[2].split(":")[2])]
            if not inner:
                end = max(int(x[2].split(":")[2]) for x in base_spans(text) if x[0] == start)
                text = text[:start] + "[SECRET]" + text[end:]
        assert after[d].text == text and not base_spans(after[d].text)
        assert after[d].n_chars == (len(text) if text != r.text else r.n_chars)


def test_packing(steps):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in steps[4]}
    check_packing(steps[5], {d: len(x) for d, x in ids.items()}, 2048)
    for r in steps[5]:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_other_columns_and_repeated_rows(spark, tmp_path):
    """Columns of any name stay; of repeated rows the join keeps one, the other stages each."""
    from .test_operators import BASE, TEXTS, documents, shingle_set

    folder = f"file://{tmp_path}"
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(BASE.split()[:40]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = documents(spark, TEXTS)
    kept = {name: stage(spark, docs, folder) for name, stage in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in kept.values())
    ids = {name: sorted(r.doc_id for r in df.collect()) for name, df in kept.items()}
    assert ids["secret scans"] == sorted(r.doc_id for r in docs.collect())
    # Rows that hold four fifths of the item go, repeated ones too; of equal or near texts, the first stays, once.
    item = shingle_set(" ".join(BASE.split()[:40]), 5)
    clean = {i for i, t in enumerate(TEXTS) if len(item & shingle_set(t, 5)) < 0.8 * len(item)}
    assert set(ids["benchmark decontamination"]) == clean and 7 not in clean and 11 not in clean
    assert len(ids["n-gram Jaccard join"]) == len(set(ids["n-gram Jaccard join"])) and set(ids["n-gram Jaccard join"]) & {7, 8, 9, 10} == {7}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == len(TEXTS)
