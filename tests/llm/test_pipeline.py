"""The corpus pipeline against brute force, stage by stage and as a whole."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lynceus.llm import decontaminate, frames, language, packing, quality, simhash, tokens


@pytest.fixture(scope="module")
def written(spark, sf_dir, tmp_path_factory):
    """What each stage was given and returned, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = frames.read(spark, sf_dir, "documents"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def _rows(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_stages_are_the_asked_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_all_but_the_last_keep_the_columns(written):
    for _, before, after in written[:-1]:
        assert after.schema == before.schema
        assert not _rows(after) - _rows(before)  # rows are kept or go, and none is changed
        assert 0.5 * before.count() < after.count() < before.count() or after.count() == before.count()


def test_quality_by_single_rows(spark, sf_dir, written):
    _, before, after = written[0]
    model = quality.train(before, frames.read(spark, sf_dir, "labels"))
    want = {r.doc_id for r in before.collect() if model.predict(quality.features(pa.array([r.text])))[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == want


def test_language_by_explicit_cosines(written):
    _, before, after = written[1]
    profiles = language.train(before)
    space = language.Space()
    want = set()
    for r in before.collect():
        vectors, trigrams = space.counted(pa.array([r.text]))
        v = vectors[0].astype(float)
        if not v.any():
            continue
        cosine = {n: float(v @ p) / np.linalg.norm(v) / np.linalg.norm(p) for n, p in zip(profiles.names, profiles.prototypes.astype(float))}
        best = max(cosine.values())
        if best >= profiles.floors[sum(int(trigrams[0]) >= x for x in language.LENGTHS)] and best - cosine.get(r.lang, best) <= language.MARGIN:
            want.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == want


def test_near_copies_by_all_pairs(written):
    _, before, after = written[2]
    rows = before.select("doc_id", "text").collect()
    prints, present = simhash.fingerprints(pa.array([r.text for r in rows]))
    ids = [r.doc_id for r in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if present[i] and present[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= simhash.RADIUS:
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in after.collect()} == {i for i in ids if root(i) == i}


def test_passages_by_plain_search(spark, sf_dir, written):
    _, before, after = written[3]
    clean = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()) + " "
    pieces = set()
    for item in frames.read(spark, sf_dir, "benchmark").collect():
        words = clean(item.text).split()
        pieces |= {" " + " ".join(words[k : k + decontaminate.WINDOW]) + " " for k in range(max(1, len(words) - decontaminate.WINDOW + 1)) if words}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not any(p in clean(r.text) for p in pieces)}


def test_packing_holds_everything(written):
    _, before, after = written[4]
    lengths = {r.doc_id: r.n_tokens for r in tokens.counts(before).collect()}
    used, total = {}, Counter()
    for r in after.collect():
        total[r.doc_id] += r.n_tokens
        used.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.n_tokens))
    assert total == Counter(lengths)
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(used) <= 1.05 * sum(lengths.values()) / packing.CAPACITY + 1


def test_run_is_all_stages(spark, sf_dir, written):
    assert _rows(corpus_pipeline.run(spark, sf_dir)) == _rows(written[-1][2])


def test_clean_documents_are_kept(spark, sf_dir, written):
    """Of the documents labelled good, the two filters keep nearly all."""
    labels = frames.read(spark, sf_dir, "labels").where("quality = 1")
    good = written[0][1].join(labels, "doc_id", "left_semi").count()
    assert written[1][2].join(labels, "doc_id", "left_semi").count() >= 0.97 * good


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_none(stage, spark, odd, none, sf_dir):
    assert stage(spark, none, sf_dir).collect() == []
    found = stage(spark, odd, sf_dir)
    assert found.collect() and (found.columns == odd.columns or stage is corpus_pipeline.STAGES[-1][1])
