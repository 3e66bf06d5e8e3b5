"""Each operator against brute force or a round trip, and on odd tables."""

from __future__ import annotations

import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lynceus.llm import decontaminate, frames, language, licenses, licensetable, ogg, packing, quality, queries, rangecoder, simhash, textkernel, tokens, toxicity

BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (2, "short item"), (3, None), (4, ""), (2, "short item")]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return frames.read(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return frames.read(spark, sf_dir, "labels")


@pytest.fixture(scope="module")
def automaton():
    return tokens.Automaton.of(tokens.read_vocabulary())


# -- kernels --


def test_words_are_those_of_a_regular_expression():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZ9 .,é中\n-") for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "a" * 3000]
    for row, raw, offsets in textkernel.slices(pa.array(texts), size=200):
        starts, ends, hashes, first = textkernel.words(raw, offsets)
        for k in range(len(offsets) - 1):
            want = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (texts[row + k] or "").lower().encode())
            have = [raw[a:b].tobytes() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
            assert have == want
            assert hashes[first[k] : first[k + 1]].tolist() == textkernel.hash_words([w.decode("utf-8", "surrogateescape") for w in want]).tolist() if all(_whole(w) for w in want) else True


def _whole(word: bytes) -> bool:
    try:
        word.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_sliced_and_wide_arrays_read_alike():
    texts = pa.array(["skip", "one two", None, "three"])
    narrow = [raw.tobytes() for _, raw, _ in textkernel.slices(texts.slice(1))]
    wide = [raw.tobytes() for _, raw, _ in textkernel.slices(texts.cast(pa.large_string()).slice(1))]
    assert narrow == wide == [b"one twothree"]


# -- 1 toxicity --


@pytest.mark.parametrize(
    "text,score",
    [
        ("You are an idiot.", 1.5),
        ("She is an idiot.", 1.2),
        ("You are not an idiot.", 0.0),
        ("He said you are an idiot", 0.0),
        ("I will kill you", 2.0),
        ("He wants to kill them.", 2.0),
        ("I will not kill you", 0.0),
        ("We kill the process", 0.0),
        ("He said hello, but I will kill you", 2.0),
        ("She says " + "one word and " * 30 + "I will kill you", 2.0),
        ("take out the trash", 0.4),
        ("Their trash was collected", 0.6),
        ("You are trash", 1.0),
        ("a worthless thing", 0.6),
        ("idiot", 0.6),
        ("idiot! moron!", 1.0),
        ("stupid, worthless words", 1.2),
        ("idiots like you", 1.2),
        ("Not here. An idiot", 0.6),
        ("The rat is a pig.", 0.8),
        ("They called him an idiot. " * 6, 0.0),
        ("pigs. " + "Fine words here. " * 2000 + "rat.", 0.4),
        ("idiot " + "fine words " * 2000 + "moron", 0.6),
        ("Some words and a moron here. Fine words. " * 5, 1.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_grammar(text, score):
    assert toxicity.Scorer().scores(pa.array([text], pa.string()))[0][0] == pytest.approx(score)


def test_clauses_by_a_reading_of_their_own():
    """Scores against one that walks word by word through the parts."""
    rng = random.Random(8)
    words = [w.split()[0] for w in toxicity.LEXICON.values()] + ["fine"] * 12
    symbol = {w: s for s, ws in toxicity.LEXICON.items() for w in ws.split()}
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", ". ", "\n"]) for _ in range(rng.randrange(1, 200)))
        scores, count, total_words = [], 0, len(text.replace(".", " ").split())
        for sentence in re.split(r"[.\n]", text):
            read = [symbol.get(w, 0) for w in sentence.split()]
            for k in range(0, len(read), toxicity.CLAUSE):
                count += 1
                states, total = [p.start for p in toxicity.PARTS], 0.0
                for x in read[k : k + toxicity.CLAUSE]:
                    for n, part in enumerate(toxicity.PARTS):
                        states[n], x, weight = part.step(states[n], x)
                        total += weight
                if total:
                    scores.append(total)
        want = max([0.0, *scores, min(toxicity.THRESHOLD, sum(scores) / min(count, -(-total_words // toxicity.SHORT)) / toxicity.DENSITY) if len(scores) > 1 else 0.0])
        assert toxicity.Scorer().scores(pa.array([text]))[0][0] == pytest.approx(want)


def test_composition_equals_running_the_parts_in_turn():
    rng = random.Random(3)
    grammar = toxicity.Grammar()
    for _ in range(2000):
        clause = [rng.randrange(10) for _ in range(rng.randrange(1, 12))]
        states, total = [p.start for p in toxicity.PARTS], 0.0
        for symbol in clause:
            for k, part in enumerate(toxicity.PARTS):
                states[k], symbol, weight = part.step(states[k], symbol)
                total += weight
        assert grammar.score(bytes(clause)) == pytest.approx(total)


def test_toxic_documents_are_caught_and_clean_ones_left_alone(spark, docs, labels):
    found = {r.doc_id for r in toxicity.scores(docs, toxicity.learn(docs, labels), only_toxic=True).collect()}
    truth = {r.doc_id: r.toxic for r in labels.join(docs, "doc_id").where("lang = 'en'").select("doc_id", "toxic").collect()}
    insult = {r.doc_id for r in docs.where("text rlike '(?i)\\\\b(idiot|moron|loser|pathetic|scum)\\\\b'").select("doc_id").collect()}
    toxic, clean = {d for d, t in truth.items() if t and d in insult}, {d for d, t in truth.items() if not t}
    assert len(toxic) >= 3 and len(toxic & found) >= 0.9 * len(toxic)
    assert not clean & found


def test_words_are_learned_from_contexts_and_not_from_copies(spark):
    rows = [(k, f"a{k} grumph b{k} and then c{k}", 1) for k in range(20)] + [(100 + k, "copies say blorp again and again", 1) for k in range(30)] + [(200 + k, f"clean words and d{k} then", 0) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.learn(frame, frame)
    known = set(learned)
    assert int(textkernel.hash_words(["grumph"])[0]) in known
    assert int(textkernel.hash_words(["blorp"])[0]) not in known and int(textkernel.hash_words(["and"])[0]) not in known


def test_a_chance_occurrence_in_a_clean_text_costs_no_word(spark):
    for size in (1, 4):
        rows = [(k, f"a{k} grumph b{k} then", 1) for k in range(30 * size)] + [(1000 + k, f"fine d{k} then", 0) for k in range(300 * size)] + [(3000 + k, f"odd e{k} grumph", 0) for k in range(size)]
        frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        assert toxicity.learn(frame, frame) == textkernel.hash_words(["grumph"]).tolist()


def test_toxic_documents_of_every_language_are_caught(spark, sf_dir):
    found = {}
    for size in ("sf0.01", "sf0.1"):
        docs, labels = (frames.read(spark, sf_dir.replace("sf0.001", size), t) for t in ("documents", "labels"))
        rows = toxicity.scores(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("toxic is not null").collect()
        for lang in ("en", "de", "fr", "es"):
            for toxic in (1, 0):
                own = [r.is_toxic for r in rows if r.lang == lang and r.toxic == toxic]
                found[size, lang, toxic] = sum(own) / len(own)
    assert found["sf0.01", "en", 1] >= 0.9  # 51 toxic documents are too few to learn foreign words from
    assert min(found["sf0.1", x, 1] for x in ("en", "de", "fr")) >= 0.9 and found["sf0.1", "es", 1] >= 0.75
    assert max(v for (_, _, toxic), v in found.items() if not toxic) <= 0.04


# -- 2 language --


def test_bundle_is_the_sum_of_bound_trigrams():
    space, text = language.Space(64), "abc ab, é"
    symbols = [0, 1, 2, 3, 0, 1, 2, 0, 27 + ord("é") % 37, 0]
    want = np.zeros(64)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        if b:
            want += np.roll(space.letters[a], 2) * np.roll(space.letters[b], 1) * space.letters[c]
    assert (space.bundle(pa.array([text]))[0] == want).all()


def test_languages_of_held_out_documents(spark, docs):
    profiles = language.train(docs.where("doc_id % 2 = 0"))
    rows = language.identify(docs.where("doc_id % 2 = 1 and n_chars > 200"), profiles).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.95 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.95 * len(rows)


def test_a_language_that_was_not_learned_is_rejected(spark, sf_dir):
    docs = frames.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    for out in ("de", "fr"):
        profiles = language.train(docs.where(f"lang <> '{out}'"))
        found = language.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").groupBy((F.col("lang") == out).alias("foreign")).agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()
        share = {r.foreign: r.share for r in found}
        assert share[True] <= 0.1 and share[False] >= 0.97


def test_every_language_has_its_share_of_the_sample(spark):
    rows = [(k, f"uno dos tres palabra{k % 50} cuatro", "es") for k in range(60)] + [(100 + k, f"one two three word{k % 50} four", "en") for k in range(3000)] + [(100, "other text with the same id", "en")] * 500
    profiles = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=80)
    names, _, _ = profiles.judge(pa.array(["uno palabra cuatro", "two word four"]), [None, None])
    assert profiles.names == ["en", "es"] and names == ["es", "en"]


def test_every_labelled_document_is_fitted_on(spark):
    rng = random.Random(3)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(rng.choice([5, 20, 60])))

    rows = [(k if k % 7 else None, text("abcdefgh"), "aa") for k in range(4500)] + [(k // 2, text("efghijkl"), "bb") for k in range(1500)] + [(1, text("mnop"), "cc"), (3, None, "aa"), (4, text("mnop"), None)]
    profiles = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert profiles.names == ["aa", "bb", "cc"]
    fit = [r for r in rows if r[1] and r[2]]
    vectors, trigrams = language.Space().counted(pa.array([t for _, t, _ in fit]))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    claim = np.array([profiles.names.index(n) for _, _, n in fit])
    sums = np.stack([units[claim == k].sum(axis=0, dtype=float) for k in range(3)])
    assert np.allclose(profiles.prototypes, sums / np.linalg.norm(sums, axis=1, keepdims=True), atol=2e-6)
    # in floors, 4,500 documents weigh as much as ALIKE
    cosines = (units @ profiles.prototypes.T).round(4)
    each, at = np.arange(len(fit)), np.array([language.ALIKE / 4500, 1, 1])[claim]
    own = cosines[each, claim]
    cosines[each, claim] = -np.inf
    for k, (low, high) in enumerate(zip((0, *language.LENGTHS), (*language.LENGTHS, 10**9))):
        here, bounds = (trigrams >= low) & (trigrams < high), []
        for x, share in ((own, language.OWN), (cosines.max(axis=1), language.FOREIGN)):
            order = np.argsort(x[here])
            place = np.searchsorted(np.cumsum(at[here][order]), share * at[here].sum())
            bounds.append(x[here][order][[place - 1, place + 1]])
        below, above = np.maximum(np.min(bounds, axis=0), language.LEAST_COSINE)
        assert below - 1e-4 <= profiles.floors[k] <= above + 1e-4


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(4)
    texts = {f"l{k:03}": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)) for k in range(300)}
    profiles = language.train(spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(texts.items())] + [(300, "!", "none")], "doc_id long, text string, lang string"))
    assert profiles.names == list(texts)  # of the last one there are no letters
    whole = profiles.judge(pa.array(list(texts.values())), list(texts))
    assert whole[0] == list(texts) and whole[2].all()
    monkeypatch.setattr(language, "_CELLS", 1000)  # cosines in runs of three rows
    assert profiles.judge(pa.array(list(texts.values())), list(texts))[0] == whole[0]
    monkeypatch.setattr(language, "_SUMS", 7)
    parts = list(language._sum(iter([pa.RecordBatch.from_arrays([pa.array(list(texts.values())), pa.array(list(texts))], names=["text", "lang"])])))
    assert len(parts) > 40 and sum(b.num_rows for b in parts) == 300
    merged = pa.Table.from_batches(language._merge(iter([pa.Table.from_batches([*parts, *parts]).sort_by("lang").combine_chunks().to_batches()[0]])))
    assert merged.column("lang").to_pylist() == list(texts) and set(merged.column("documents").to_pylist()) == {2}


def test_floors_lie_between_foreign_and_own():
    rng = np.random.default_rng(0)
    own, foreign, n = rng.uniform(0.5, 0.9, 1000), rng.uniform(0.1, 0.3, 1000), np.full(1000, 500)
    assert language.floors(own, foreign, n)[:2] == (language.LEAST_COSINE,) * 2 and 0.29 < language.floors(own, foreign, n)[2] < 0.3
    assert language.floors(own - 0.4, foreign, n)[2] == pytest.approx(max(language.LEAST_COSINE, np.quantile(own - 0.4, language.OWN)))
    assert language.floors(own, np.full(1000, -np.inf), n) == (language.LEAST_COSINE,) * 3  # a single language


def test_quantiles_of_counted_values():
    rng = np.random.default_rng(1)
    values, number = rng.uniform(0, 1, 40), rng.integers(0, 5, 40)
    for share in (0, 0.005, 0.3, 0.99, 1):
        assert language._quantile(values, number, number * 7, share) == pytest.approx(np.quantile(np.repeat(values, number), share))


def test_texts_without_a_language_are_rejected(spark, odd, docs):
    rows = {(r.doc_id, r.language is None): r.accepted for r in language.identify(odd, language.train(docs)).collect()}
    assert rows[(2, True)] is rows[(3, True)] is rows[(5, True)] is False
    assert not any(r.accepted for r in language.identify(odd, language.train(odd.limit(0))).collect())


# -- 3 decontamination --


def test_search_finds_what_find_finds():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = "ab " if rng.random() < 0.5 else "abcdefgh "
        patterns = list({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 40))})
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 2000))).encode() + patterns[0]
        begin, which = decontaminate.WuManber(patterns).search(np.frombuffer(text, np.uint8))
        want = {(i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)}
        assert set(zip(begin.tolist(), which.tolist())) == want and len(begin) == len(want)


def test_passes_don_t_change_what_is_found():
    items = [(k, f"{k} quick brown foxes jump over {k} lazy dogs while {k + 1} cats sleep on the warm roof") for k in range(50)]
    texts = pa.array([t for _, t in items] + ["nothing of this"])
    assert list(decontaminate.Detector(items).scan(texts)) == list(decontaminate.Detector(items, per_pass=7).scan(texts))


def test_part_of_an_item_is_a_match_and_less_is_not(spark, bench):
    words = BENCH[0][1].split()
    rows = [(1, "x " + " ".join(words[2:15]) + " y"), (2, " ".join(words[:12])), (3, "One, TWO; three\nfour five six seven eight nine ten eleven twelve thirteen!"), (4, "a short item here"), (5, "a shorter item"), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for per_pass in (decontaminate.PATTERNS_PER_PASS, 5):
        found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, bench, least_words=2, per_pass=per_pass).collect()}
        assert found == {(1, 1), (3, 1), (4, 2)}
        kept = {r.doc_id for r in decontaminate.remove(frame, bench, least_words=2, per_pass=per_pass).collect()}
        assert kept == {2, 5, 6}


def test_items_of_a_word_or_two_convict_nobody(spark):
    bench = spark.createDataFrame([(1, "Paris"), (2, "The capital of France"), (3, "what is the capital of france")], "item_id smallint, text string")
    rows = spark.createDataFrame([(1, "We went to Paris."), (2, "Paris is the capital of France."), (3, "So: what is the capital of France?")], "doc_id long, text string")
    found = decontaminate.matches(rows, bench)
    assert [tuple(r) for r in found.collect()] == [(3, 3, 1)] and dict(found.dtypes)["item_id"] == "smallint"
    assert {r.doc_id for r in decontaminate.remove(rows, bench).collect()} == {1, 2}


# -- 4 quality --


def test_flat_forest_walks_like_nested_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.prior
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node - forest.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.predict(x, block=64), [walk(r) for r in x])
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.95


def test_features_by_plain_counting():
    text = "One two two\nTWO! 33 #\nOne two two"
    names = dict(zip(quality.FEATURES, quality.features(pa.array(["pad", text, None]))[1]))
    words = re.findall(r"[0-9A-Za-z]+", text)
    assert names["log_words"] == pytest.approx(np.log1p(len(words)))
    assert names["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert names["adjacent_repeats"] == pytest.approx(2 / len(words))
    assert names["commonest_word"] == pytest.approx(4 / len(words))
    assert names["repeated_lines"] == pytest.approx(1 / 3)
    assert names["upper"] == pytest.approx(5 / len(text)) and names["digits"] == pytest.approx(2 / len(text))


def test_held_out_accuracy(spark, sf_dir, labels):
    docs = frames.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    marks = frames.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    model = quality.train(docs, marks.where("doc_id % 3 <> 0"))
    rows = quality.scores(docs, model).join(marks.where("doc_id % 3 = 0"), "doc_id").collect()
    assert sum(r.accepted == (r.quality == 1) for r in rows) >= 0.93 * len(rows)


def test_one_class_or_no_labels(spark, odd, docs):
    for marks, want in (([], True), ([(1, 1)], True), ([(1, 0)], False), ([(1, None), (None, 1)], True)):
        model = quality.train(odd, spark.createDataFrame(marks, "doc_id long, quality int"))
        assert {r.accepted for r in quality.scores(odd, model).collect()} == {want}


# -- 5 licenses --


def test_equal_texts_are_found_however_they_are_written(spark):
    mit = dict((n, t) for n, t in licenses.KNOWN if len(t) > 500 and n == "MIT")["MIT"].split("\n", 1)[1]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + mit.upper()),
        (2, "/* " + mit.replace(". ", ".\n * ").replace("sublicense", "sub-licence") + " */"),
        (3, mit + " And more."),
        (4, "Some text.\nReleased under the MIT Licence.\nMore text."),
        (5, "I like the MIT License."),
        (6, None),
        (7, "All rights reserved."),
    ]
    found = {(r.doc_id, r.scope, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "document", "MIT"), (2, "document", "MIT"), (4, "line", "MIT")} <= found
    assert not {x[0] for x in found} & {3, 5, 6}


def test_dropped_lines_are_notices_too(spark):
    rows = [(1, "All rights reserved."), (2, "Words.\n # ALL RIGHTS RESERVED\nMore words."), (3, "Copyright (c) 2020 Some Body\nAll rights reserved.\nWords."), (4, "Copyright (c) 2020 Some Body"), (5, "We have all rights reserved."), (6, "!!")]
    found = {(r.doc_id, r.scope, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, "document", "proprietary"), *((k, "line", "proprietary") for k in (1, 2, 3))}


def test_whole_licenses_and_usual_notices_are_found(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    texts = {(name, part): (folder / name).read_text() for _, name, part, _ in licensetable.DIGESTS if (folder / name).exists()}
    texts = {(name, part): t if part == "whole" else t[: t.index("END OF TERMS AND CONDITIONS") + 27].upper() for (name, part), t in texts.items()}
    notices = {"GPL-2.0": "Licensed under the GNU General Public License, version 2.", "LGPL-2.1-or-later": "SPDX-License-Identifier: LGPL-2.1-or-later", "MPL-2.0": "# This file is licensed under the Mozilla Public License, Version 2.0", "GPL-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later", "BSD-3-Clause": "Released under the BSD 3-Clause License", "AGPL-3.0": "Licensed under the GNU Affero General Public Licence, Version 3"}
    rows = [("|".join(k), t) for k, t in texts.items()] + [(k, f"Words.\n{t}\nMore words.") for k, t in notices.items()] + [("none", "Mozilla Public License")]
    found = {(r.doc_id, r.scope, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).where("license_id <> 'proprietary'").collect()}
    assert found == {(f"{name}|{part}", "document", x) for x, name, part, _ in licensetable.DIGESTS if (name, part) in texts} | {(k, "line", k) for k in notices}


def test_notices_name_one_license_each(spark):
    assert licenses.shipped(spark).groupBy("digest").count().where("count > 1").count() == 0


def test_large_license_table_is_joined_by_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 1)
    assert {r.license_id for r in licenses.scan(rows).collect()} == {"MIT"}


# -- 6 range coder --


def test_round_trip_of_blocks():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 2, 5, 100, 700)] + [np.zeros(900, int), np.full(600, 65535), np.tile(rng.integers(0, 50000, 50), 20), rng.zipf(1.3, 800) % 50000, *[np.array([k]) for k in (0, 1, 255, 65535)]]
    coded = rangecoder.encode(blocks)
    for block, back in zip(blocks, rangecoder.decode(coded)):
        assert (block == back).all() and len(block) == len(back)
    assert rangecoder.encode([blocks[5]]) == [coded[5]]  # a block doesn't depend on its neighbours
    assert len(coded[8]) < 0.3 * 2 * len(blocks[8])  # repetition is learned


def test_damaged_blocks_are_noticed():
    coded = rangecoder.encode([np.arange(500)])[0]
    for broken in (coded[:-3], coded[:60] + bytes([coded[60] ^ 4]) + coded[61:], b"no" + coded[2:]):
        with pytest.raises(rangecoder.CorruptBlock):
            rangecoder.decode([broken])
    for wrong in (np.array([rangecoder.MAX_IDS]), np.array([-1]), np.zeros(rangecoder.BLOCK + 1, int)):
        with pytest.raises(ValueError):
            rangecoder.encode([wrong])


def test_no_damage_gives_other_ids():
    rng = random.Random(2)
    ids = np.array([rng.choice([3, 500, 70_000, rng.randrange(1 << 24)]) for _ in range(300)])
    coded = rangecoder.encode([ids])[0]
    for at in [*range(40), *rng.sample(range(40, len(coded)), 60)]:
        for bit in (0, 3, 7):
            broken = coded[:at] + bytes([coded[at] ^ 1 << bit]) + coded[at + 1 :]
            try:
                assert rangecoder.decode([broken])[0].tolist() == ids.tolist()  # bits that round the last digits up
            except rangecoder.CorruptBlock:
                continue
            assert at >= len(coded) - 8 or at == 16  # or more bits for the prior than were needed, for which the ids agree
    with pytest.raises(rangecoder.CorruptBlock):
        rangecoder.decode([coded[:4] + (1 << 31).to_bytes(4, "little") + coded[8:]])


@pytest.mark.parametrize("n", [64, 128, 192])
def test_earlier_smaller_ranks_by_counting(n):
    rng = np.random.default_rng(n)
    rank = np.stack([rng.permutation(n) for _ in range(5)])
    assert rangecoder._below(rank).tolist() == [[int((r[:i] < r[i]).sum()) for i in range(n)] for r in rank]


def test_ids_of_large_vocabularies():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 1 << b, 200) for b in range(1, 25)] + [np.array([(1 << 24) - 1]), np.arange(200) + (1 << 23)]
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(rangecoder.encode(blocks))))


def test_documents_come_back_from_shuffled_files(spark, odd, docs, automaton, tmp_path):
    for k, table in enumerate((odd, docs)):
        rangecoder.write(table.repartition(3)).repartition(5).write.parquet(f"{tmp_path}/{k}")
        back = Counter((r.doc_id, tuple(r.ids)) for r in rangecoder.read(spark.read.parquet(f"{tmp_path}/{k}")).collect())
        rows = frames.pick(table, doc_id="doc_id", text="text").collect()
        flat, at = automaton.encode_texts(pa.array([r.text for r in rows], pa.string()))
        assert back == Counter((r.doc_id, tuple(flat[at[n] : at[n + 1]].tolist())) for n, r in enumerate(rows))


def test_documents_come_back_from_their_blocks(spark, odd, docs, automaton):
    for table in (odd, docs.repartition(3)):
        rows = rangecoder.write(table).collect()
        ids = rangecoder.decode([bytes(r.block) for r in rows])
        parts: dict = {}
        for row, block in zip(rows, ids):
            at = 0
            for doc, n in zip(row.doc_ids, row.doc_tokens):
                parts.setdefault(doc, []).append(block[at : at + n])
                at += n
            assert at == row.n_tokens == len(block)
        vocabulary = tokens.read_vocabulary()
        vocabulary += [bytes([b]) for b in range(256)]
        texts = frames.pick(table, doc_id="doc_id", text="text")
        want = Counter()
        for r in texts.collect():
            want[r.doc_id] += len((r.text or "").encode())
        assert {d: sum(len(vocabulary[i]) for p in ps for i in p.tolist()) for d, ps in parts.items()} == dict(want)


def test_columns_of_ids(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, None), (3, []), (4, [9] * 9000)], "doc_id long, ids array<int>").coalesce(1)
    found = rangecoder.write_ids(rows).collect()
    assert [r.n_tokens for r in found] == [4096, 4096, 811]
    assert np.concatenate(rangecoder.decode([bytes(r.block) for r in found])).tolist() == [5, 6, 7] + [9] * 9000
    assert [list(zip(r.doc_ids, r.doc_tokens)) for r in found][0] == [(1, 3), (2, 0), (3, 0), (4, 4093)]
    assert [(r.part, r.block_number, r.first_document, r.doc_offsets) for r in found] == [(0, 0, 0, [0, 0, 0, 0]), (0, 1, 3, [4093]), (0, 2, 3, [8189])]


def test_nulls_among_ids_are_left_out(spark):
    rows = spark.createDataFrame([(1, [None, 5, None]), (2, None), (3, [None]), (4, [6])], "doc_id int, ids array<long>").coalesce(1)
    assert {(r.doc_id, tuple(r.ids)) for r in rangecoder.read(rangecoder.write_ids(rows)).collect()} == {(1, (5,)), (2, ()), (3, ()), (4, (6,))}


# -- 7 tokens --

_UNITS = re.compile(rb" ?[0-9A-Za-z\x80-\xff]+| ?[^ \t\n\r\x0b\x0c0-9A-Za-z\x80-\xff]+|[ \t\n\r\x0b\x0c]+(?= [^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")


def _greedy(text: str, entries: set[bytes], longest: int) -> list[bytes]:
    out = []
    for unit in _UNITS.findall(text.encode()):
        at = 0
        while at < len(unit):
            size = next(n for n in range(min(longest, len(unit) - at), 0, -1) if n == 1 or unit[at : at + n] in entries)
            out.append(unit[at : at + size])
            at += size
    return out


def test_counts_and_pieces_are_those_of_greedy_matching(automaton):
    vocabulary = tokens.read_vocabulary()
    entries, longest = set(vocabulary), max(map(len, vocabulary))
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "the", "ing", " ", "  ", "\n", ".", ",", "é", "中", "x1", "tion"]) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", "x" * 4000, "the" * 2000]
    want = [_greedy(t, entries, longest) for t in texts]
    assert automaton.count_texts(pa.array(texts)).tolist() == [len(w) for w in want]
    ids, at = automaton.encode_texts(pa.array(texts))
    assert [[vocabulary[i] for i in ids[at[k] : at[k + 1]].tolist()] for k in range(len(texts))] == want


def _thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 63, 64, 65, 1024, 2048])
def test_units_that_hash_alike_are_told_apart(automaton, n):
    one = _thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    texts = pa.array([one, two, f"{two} {one} {two}"])
    ids, at = automaton.encode_texts(texts)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(3)] == [automaton.encode_texts(texts.slice(k, 1))[0].tolist() for k in range(3)]
    assert automaton.count_texts(texts).tolist() == np.diff(at).tolist()


def test_distinct_spans_are_those_of_their_bytes(monkeypatch):
    rng = random.Random(3)
    for worst in (False, True):
        if worst:  # a hash that tells nothing
            monkeypatch.setattr(textkernel, "mix", np.zeros_like)
        for _ in range(20):
            spans = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 30, 64, 65, 90]))) for _ in range(60)]
            spans += rng.choices(spans, k=60)
            raw = np.frombuffer(b"".join(spans), np.uint8)
            ends = np.cumsum([len(x) for x in spans])
            first, which = textkernel.distinct(raw, ends - [len(x) for x in spans], ends)
            assert [spans[k] for k in first[which]] == spans
            assert worst or len(first) == len({x for x in spans if len(x) <= 64}) + sum(len(x) > 64 for x in spans)


def test_small_vocabularies_fall_back_to_bytes():
    a = tokens.Automaton.of([b"ab", b"abcd", b"bc"])
    assert a.count_texts(pa.array(["abc", "abcd", "abcab", "zz", None])).tolist() == [2, 1, 3, 2, 0]


# -- 8 ogg --


def _slow_crc(data: bytes) -> int:
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c >> 31 else (c << 1) & 0xFFFFFFFF
    return c


def test_checksum_bit_by_bit():
    rng = random.Random(0)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == _slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 400, 655, 5000, 70_000, 200_000])
def test_media_round_trip(n):
    data = random.Random(n).randbytes(n)
    assert ogg.unwrap(ogg.mux(data)) == data


def test_a_damaged_page_costs_its_own_packets_only():
    payload = random.Random(1).randbytes(40_000)
    good = ogg.mux(payload)
    whole, _ = ogg.demultiplex(good)
    broken = bytearray(good)
    broken[20_000] ^= 1
    found, skipped = ogg.demultiplex(bytes(broken))
    assert skipped > 0 and sum(s.lost_pages for s in found) == 1
    for a, b in zip(whole, found):
        kept = Counter(b.packets)
        assert not kept - Counter(a.packets) and len(b.packets) >= len(a.packets) - 30
    found, skipped = ogg.demultiplex(b"junk" + good + b"Ogg")
    assert skipped == 7 and [s.packets for s in found] == [s.packets for s in whole]


def test_times_come_from_granules():
    opus, vorbis = ogg.describe(ogg.mux(bytes(3000)))
    assert (opus[1], opus[3], vorbis[1], vorbis[3]) == ("opus", 48000, "vorbis", 44100)
    packets = opus[6]
    assert opus[11] == pytest.approx(packets * 960 / 48000)
    assert vorbis[11] == pytest.approx(vorbis[6] * 1024 / 44100)


def _one_page(packet, granule=0):
    writer = ogg.Writer(7)
    return b"".join(writer.packet(packet, granule)) + writer.page(ogg.LAST)


def test_headers_of_any_value_are_taken(spark):
    vorbis = b"\x01vorbis" + (0).to_bytes(4, "little") + b"\xff" + (0xFFFFFFFF).to_bytes(4, "little") + bytes(14)
    speex = b"Speex   " + bytes(28) + (0xFFFFFFFF).to_bytes(4, "little") + bytes(8) + (0xFFFFFFFF).to_bytes(4, "little") + bytes(28)
    rows = [(1, vorbis), (2, speex), (3, b"\x7fFLAC" + b"\xff" * 25), (4, b"\x7fFLAC" + b"\xff" * 26), (5, b"OpusHead")]
    found = {r.doc_id: r for r in ogg.streams(spark.createDataFrame([(k, _one_page(x, 1 << 62)) for k, x in rows], "doc_id long, media binary")).collect()}
    assert (found[1].rate, found[1].channels) == (0xFFFFFFFF, 255)
    assert (found[2].rate, found[2].channels) == (0xFFFFFFFF, 0xFFFFFFFF)
    assert [found[k].codec for k in (3, 4, 5)] == ["unknown", "flac", "unknown"] and found[4].rate == 0xFFFFF


def test_values_that_hold_no_media(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"not media"))], "doc_id long, media binary")
    assert sorted((r.doc_id, r.serial, r.skipped_bytes) for r in ogg.streams(rows).collect()) == [(2, None, 0), (3, None, 9)]


# -- 9 packing --


def _fewest(items: list[int], capacity: int) -> int:
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_fixed_sets_never_cost_a_bin():
    rng = random.Random(1)
    fixed_bins = 0
    for _ in range(700):
        capacity = rng.choice([10, 20, 30, 50])
        low = rng.choice([1, capacity // 6 + 1, capacity // 5 + 1, capacity // 4])
        items = [rng.randrange(low, capacity + 1 if rng.random() < 0.7 else max(low + 1, capacity // 2)) for _ in range(rng.randrange(1, 10))]
        reduction = packing.Reduction(Counter(items), capacity)
        fixed = reduction.run()
        rest = [int(k) for k in np.flatnonzero(reduction.count) for _ in range(int(reduction.count[k]))]
        bins = sum(n for n, _ in fixed)
        fixed_bins += bins
        assert bins + _fewest(rest, capacity) == _fewest(items, capacity)
        total = Counter()
        for times, inside in packing.solve(Counter(items), capacity):
            assert sum(a * b for a, b in inside) <= capacity
            for a, b in inside:
                total[a] += times * b
        assert total == Counter(items)
    assert fixed_bins > 1000


def _check_packing(rows, capacity, lengths):
    used: dict = {}
    for r in rows:
        if r.n_tokens:
            used.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.n_tokens))
        else:
            assert r.bin_id is None
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    assert total == lengths
    return len(used)


def test_every_piece_has_a_place_of_its_own(spark, docs):
    lengths = tokens.counts(docs)
    for capacity in (64, 2048):
        rows = packing.pack_lengths(lengths, capacity).collect()
        want = Counter()
        for r in lengths.collect():
            want[r.doc_id] += r.n_tokens or 0
        bins = _check_packing(rows, capacity, want)
        assert bins <= 1.05 * sum(want.values()) / capacity + 1


def test_packing_in_many_salts_and_full_pieces(spark):
    lengths = {k: (k * 37) % 90 if k % 3 else 50 for k in range(600)} | {600: 320, 601: 64, 602: 128, 603: 0}
    rows = packing.pack_lengths(spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long").repartition(5), 64, salt_rows=7).collect()
    bins = _check_packing(rows, 64, Counter(lengths))
    assert bins == len({r.bin_id for r in rows} - {None}) == 1 + max(r.bin_id or 0 for r in rows)


def test_packing_of_repeats_nulls_and_nothing(spark, odd, none):
    rows = packing.pack(odd).collect()
    want = Counter()
    for r in tokens.counts(odd).collect():
        want[r.doc_id] += r.n_tokens or 0
    _check_packing(rows, packing.CAPACITY, want)
    assert packing.pack(none).collect() == []


# -- 10 near copies --


def test_trees_find_the_pairs_of_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, (150, 2), dtype=np.uint64)
    near = base[rng.integers(0, 150, 450)].copy()
    for _ in range(12):
        near[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 450).astype(np.uint64)
    prints = np.concatenate([base, near])
    shard = np.sort(rng.integers(0, 5, 600))
    for radius in (0, 3, 12, 22):
        found = {(int(a), int(b)) for u, v in simhash.Forest(shard, prints).pairs(radius, block=128) for a, b in zip(u, v)}
        want = {(i, j) for i in range(600) for j in range(i) if shard[i] == shard[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius}
        assert found == want
        links = [np.concatenate(x) for x in zip(*simhash.Forest(shard, prints).links(radius, block=128))] or [np.zeros(0, np.int64)] * 2
        assert {*zip(*(x.tolist() for x in links))} <= want
        sides = [np.array([p[k] for p in sorted(want)], np.int64) for k in (0, 1)]
        assert simhash.components(600, *links).tolist() == simhash.components(600, *sides).tolist()


def test_clusters_of_close_copies_cost_a_comparison_each():
    rng = np.random.default_rng(4)
    prints = np.repeat(rng.integers(0, 1 << 63, (1, 2), dtype=np.uint64), 3000, axis=0)
    prints[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    prints[:, 1] ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    found = list(simhash.Forest(np.zeros(3000, np.int64), prints).links(simhash.RADIUS))
    assert sum(len(a) for a, _ in found) == 2999


def test_components_by_pointer_jumping():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    label = simhash.components(300, a, b)
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    assert label.tolist() == [root(x) for x in range(300)]


def test_connected_tables(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_recall_against_brute_force(spark, sf_dir):
    docs = frames.read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    found = {r.doc_id: r.group_id for r in simhash.groups(docs, shard_rows=8).collect()}  # small shards: many tables
    texts = docs.select("doc_id", "text").collect()
    prints, present = simhash.fingerprints(pa.array([r.text for r in texts]))
    prints = prints[present]
    group = np.array([found[r.doc_id] for r, some in zip(texts, present) if some])
    apart = simhash.distance(np.repeat(prints, len(prints), axis=0), np.tile(prints, (len(prints), 1))).reshape(len(prints), -1)
    a, b = np.nonzero(np.triu(apart <= simhash.RADIUS, 1))
    assert len(a) > 50 and (group[a] == group[b]).mean() >= 0.9


def test_one_of_each_group_stays(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [[word() for _ in range(120)] for _ in range(12)]
    rows, families = [], {}
    for k, words in enumerate(base):
        for copy in range(4):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(120)] = word()
            rows.append((k * 10 + copy, " ".join(changed), "en"))
            families[k * 10 + copy] = k * 10
    frame = spark.createDataFrame(rows + [(500, None, "en"), (501, None, "en"), (None, rows[0][1], "en"), (0, rows[0][1], "en")], "doc_id long, text string, group_id string")
    found = {r.doc_id: r.group_id for r in simhash.groups(frame).where("doc_id < 500").collect()}
    assert found == families
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, k * 10) for k in range(12)] + [(False, 500), (False, 501), (True, 0)])


def _by_brute_force(rows):
    """Rows that stay: one of each component of texts within the radius, the least id first."""
    prints, present = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    distinct = sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: (r[0], r[1] or ""))
    at = {r: rows.index(r) for r in distinct}
    group = {r: n for n, r in enumerate(distinct)}
    for _ in distinct:
        for r in distinct:
            for q in distinct:
                if present[at[r]] and present[at[q]] and int(np.bitwise_count(prints[at[r]] ^ prints[at[q]]).sum()) <= simhash.RADIUS:
                    group[r] = group[q] = min(group[r], group[q])
    least = {}
    for r in distinct:
        least.setdefault(group[r], r[0])
    return sorted(least.values()), len(set(group.values())) + sum(i is None for i, _ in rows), {r: least[group[r]] for r in distinct}


@pytest.mark.parametrize("turn", [False, True])
def test_one_id_with_different_texts_loses_none(spark, turn):
    one, two = " ".join(f"one{k}" for k in range(60)), " ".join(f"two{k}" for k in range(60))
    if turn:
        one, two = two, one
    cases = [
        [(1, one), (2, one), (2, two), (3, two)],
        [(1, one), (1, two), (1, one)],
        [(5, one), (5, two), (4, two), (4, one + " more"), (None, one), (6, ""), (6, ""), (6, None), (7, "!!"), (8, two)],
    ]
    for rows in cases:
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        ids, number, group = _by_brute_force(rows)
        kept = [tuple(r) for r in simhash.deduplicate(frame).collect()]
        assert len(kept) == number and sorted(i for i, _ in kept if i is not None) == ids
        assert {group[r] for r in kept if r[0] is not None} == set(ids)
        assert {t for _, t in kept if t} >= ({one, two} & {t for _, t in rows})
        judged = simhash.groups(frame)
        assert judged.columns == ["doc_id", "group_id", "is_kept"] and judged.count() == len(rows)
        assert judged.where("is_kept").count() == number
        assert {(r.doc_id, r.group_id) for r in judged.where("doc_id is not null").collect()} == {(r[0], g) for r, g in group.items()}


# -- odd tables --


def _everything(table, docs, labels, bench):
    return {
        "toxicity": toxicity.scores(table, toxicity.learn(table, labels)),
        "language": language.identify(table, language.train(docs)),
        "language filter": language.accepted(table, language.train(docs)),
        "decontamination": decontaminate.matches(table, bench),
        "decontamination filter": decontaminate.remove(table, bench),
        "quality": quality.scores(table, quality.train(docs, labels)),
        "quality filter": quality.accepted(table, quality.train(docs, labels)),
        "licenses": licenses.scan(table),
        "blocks": rangecoder.write(table),
        "tokens": tokens.counts(table),
        "media": ogg.streams(ogg.wrap(table)),
        "packing": packing.pack(table),
        "groups": simhash.groups(table),
        "groups filter": simhash.deduplicate(table),
    }


def test_odd_rows(odd, docs, labels, bench):
    n = odd.count()
    for name, found in _everything(odd, docs, labels, bench).items():
        rows = found.collect()
        if name in ("toxicity", "language", "quality", "tokens", "groups"):
            assert len(rows) == n, name
        if name.endswith("filter"):
            # in none of these texts is there enough of a language of the tables
            assert found.columns == odd.columns and (not rows if name == "language filter" else 0 < len(rows) <= n), name


def test_empty_tables(none, docs, labels, bench):
    for name, found in _everything(none, docs, labels, bench).items():
        assert found.collect() == [], name


def test_missing_column_is_named(odd):
    with pytest.raises(ValueError, match="nope"):
        frames.pick(odd, x="nope")


def test_checkpoints_go_to_the_shared_folder(spark):
    frames.ensure_checkpoints(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_the_whole_table(name, spark, sf_dir):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert rows
    if name in ("op2_language", "op4_quality", "op7_token_counts", "op10_simhash_dedup"):
        assert len(rows) == frames.read(spark, sf_dir, "documents").count()
