"""Texts that meet a table by their words, a block at a time: the same rows, and no wide value once per word of a text."""

import numpy as np
import pyarrow as pa
import pytest

from checks.spark_queries import QUERIES
from pairlens.functions import text as T
from pairlens.operators import blocks, corpus, nouns, vectors
from pairlens.staging import stage

WORDS = ["x" + a + b for a in "abcdefgh" for b in "klmnopqr"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.RandomState(7)
    return {w: rng.normal(size=5).round(3).tolist() for w in WORDS[:50]}


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.RandomState(8)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, text(i % 9), text(40) if i % 4 else text(3)) for i in range(40)]
    rows += [(100, None, ""), (101, "zz", rows[5][2]), (5, rows[6][1], rows[6][2]), (6, rows[6][1], rows[6][2]), (None, "xak", "xbk")]
    return stage(spark.createDataFrame(rows, "id long, question1 string, question2 string").repartition(3), "block-pairs")


@pytest.fixture(scope="module")
def word_vectors(spark, table):
    # A word that comes twice counts twice; words that the corpus lacks do not matter.
    return spark.createDataFrame([*table.items(), ("xak", [1.0] * 5), ("unheard", [9.0] * 5)], "word string, vec array<double>")


def known(table, text):
    return [v for w in (text or "").split() if w in table for v in ([table[w], [1.0] * 5] if w == "xak" else [table[w]])]


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000, 1])
def test_text_vectors_by_blocks(spark, texts, table, word_vectors, block_bytes, monkeypatch):
    monkeypatch.setattr(vectors, "TOKENS_AT_A_TIME", 7)
    counts = corpus.token_counts(corpus.question_cells(texts), T.plain_words)
    sent = vectors.sentence_vectors(texts, word_vectors, counts, block_bytes=block_bytes)
    assert "Summarizer" not in sent._jdf.queryExecution().toString()
    made = sorted(((r.id is None, r.id, r.vec1, r.vec2) for r in sent.collect()), key=str)
    unit = lambda t: np.round(s / np.linalg.norm(s), 9).tolist() if (s := np.sum(known(table, t) or [[0.0] * 5], axis=0)).any() else [0.0] * 5
    rows = texts.collect()
    want = sorted(((r.id is None, r.id, unit(r.question1), unit(r.question2)) for r in rows), key=str)
    assert [m[:2] for m in made] == [w[:2] for w in want]
    for m, w in zip(made, want):
        assert m[2] == pytest.approx(w[2], abs=1e-8) and m[3] == pytest.approx(w[3], abs=1e-8)
    wcd = vectors.word_centroid_distance(texts, word_vectors, counts, block_bytes=block_bytes).collect()
    mean = lambda t: np.mean(known(table, t), axis=0)
    want = sorted(round(float(np.linalg.norm(mean(r.question1) - mean(r.question2))), 6) if known(table, r.question1) and known(table, r.question2) else -1.0 for r in rows)
    assert sorted(-1.0 if r.wcd is None else round(r.wcd, 6) for r in wcd) == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000, 1])
def test_moves_by_blocks(texts, table, word_vectors, block_bytes):
    counts = corpus.token_counts(corpus.question_cells(texts), T.plain_words)
    found = vectors.relaxed_wmd(texts, word_vectors, counts, block_bytes=block_bytes)
    # Vectors reach a block of pairs in a task, not a row of each word of each pair.
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = texts.collect()

    def score(i):
        a, b = ([v for r in rows if r.id == i for v in known(table, r[c])] for c in ("question1", "question2"))
        if i is None or not a or not b:
            return None
        gaps = np.linalg.norm(np.array(a)[:, None] - np.array(b)[None], axis=2)
        return max(gaps.min(1).mean(), gaps.min(0).mean())

    made = found.collect()
    assert sorted(str(r.id) for r in made) == sorted(str(r.id) for r in rows)
    for r in made:
        assert r.wmd == (None if score(r.id) is None else pytest.approx(score(r.id), abs=1e-6)), r


@pytest.mark.parametrize("block_bytes", [16 << 20, 1000, 1])
def test_sequences_and_mapped_tokens_by_blocks(spark, texts, block_bytes):
    number = {w: n for n, w in enumerate(WORDS[:40], 1)}
    vocabulary = spark.createDataFrame([(w, 2, n) for w, n in number.items()] + [("xbk", 2, 3)], "word string, cnt long, idx long")
    rows = texts.collect()
    numbers = lambda t: [n for w in (t or "").split() if w in number for n in (sorted((number[w], 3)) if w == "xbk" else [number[w]])]
    made = corpus.texts_to_sequences(texts, vocabulary, block_bytes=block_bytes)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r.id), r.seq1, r.seq2) for r in made.collect()) == sorted((str(r.id), numbers(r.question1), numbers(r.question2)) for r in rows)

    norm = {w: f"{w}!" for w in WORDS[::3]}
    dictionary = spark.createDataFrame([*norm.items(), ("xak", "an\nother"), ("xan", None)], "word string, norm string")
    given = [(1, ["xak", "xal", "xak"], ["xan", "q\n", None, ""]), (2, [], None), (3, WORDS * 3, ["xak", "xal", "xak"]), (3, ["a"], [""])]
    tokens = spark.createDataFrame(given, "id long, words1 array<string>, words2 array<string>")
    counts = spark.createDataFrame([(w, 1) for w in WORDS], "word string, cnt long")
    of = lambda ws: [x for w in ws or [] for x in {"xak": ["an\nother", "xak!"], "xan": ["xan", "xan!"] if "xan" in norm else ["xan"]}.get(w, [norm.get(w, w)])]
    mapped = nouns.map_tokens(tokens, dictionary, counts, hot_keys=2, block_bytes=block_bytes)
    assert "collect_list" not in mapped._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(str((r.id, r.words1, r.words2)) for r in mapped.collect()) == sorted(str((i, of(a), of(b))) for i, a, b in given)


def test_assembled_features_clean_texts_once(spark, tmp_path):
    docs = [(i, f"Text {i % 3} of the cat and dogs, what's {i}") for i in range(1, 12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    found = QUERIES["assemble_features"](spark, str(tmp_path))
    assert "split(lower(question" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 10 + 4


def test_vectors_of_a_block_must_be_as_wide():
    made = lambda rows: blocks.matrix(pa.chunked_array([pa.array(rows, pa.list_(pa.float64()))]), np.arange(len(rows))[::-1])
    assert made([[1.0, 2.0], [3.0, 4.0]]).tolist() == [[3.0, 4.0], [1.0, 2.0]] and made([]).shape == (0, 0)
    for rows in ([[1.0, 2.0], None], [[1.0, 2.0, 3.0], [4.0]]):
        with pytest.raises(ValueError):
            made(rows)
