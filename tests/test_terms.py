"""TF-IDF by blocks of texts and shares of terms: the weights of the definition, and no term moved once per text."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from pairlens.operators import corpus, terms
from pairlens.staging import stage

STOPS = ["the"]
WORDS = [a + b for a in "abcdef" for b in "klmé"] + ["the"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [(i, text(i % 7), text(30) if i % 3 else text(2)) for i in range(40)]
    rows += [(100, None, ""), (101, "the a", rows[7][2]), (5, rows[6][1], rows[6][2]), (6, rows[6][1], rows[6][2]), (None, "ak bk", "bk")]
    return stage(spark.createDataFrame(rows, "id long, question1 string, question2 string").repartition(3), "term-pairs")


def _terms(text):
    words = [w for w in (text or " ").split() if len(w) > 1 and w not in STOPS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("block_bytes, share_bytes", [(16 << 20, 4 << 20), (300, 100)])
def test_frequencies_and_weights_are_those_of_the_definition(texts, block_bytes, share_bytes):
    cells = [t or " " for r in texts.collect() for t in (r.question1, r.question2)]
    df = Counter(x for t in cells for x in set(_terms(t)))
    distinct = corpus.distinct_texts(texts)
    fit = corpus.tfidf_fit(corpus.question_cells(texts), STOPS, block_bytes, share_bytes)
    assert fit.dtypes == [("term", "string"), ("df", "bigint")]
    assert sorted(map(tuple, fit.collect())) == sorted(df.items())
    # Terms that are missing drop out, one that comes twice counts twice.
    known = stage(fit.filter("term NOT LIKE 'a%'").union(fit.filter("term = 'bk'")), "term-known")
    times = Counter(r.term for r in known.collect())
    weights = corpus.tfidf_weights(distinct, known, len(cells), STOPS, block_bytes=block_bytes, share_bytes=share_bytes)
    key = {r.text: r.key for r in distinct.collect()}
    want = {}
    for t in set(cells):
        held = Counter(_terms(t))
        w = [(x, n * (math.log((1 + len(cells)) / (1 + df[x])) + 1)) for x, n in held.items() for _ in range(times[x])]
        norm = math.sqrt(sum(v * v for _, v in w))
        want |= {(key[t], x, i): v / norm for i, (x, v) in enumerate(sorted(w))}
    made = sorted(map(tuple, corpus.tfidf_transform(weights).collect()))
    assert [m[:2] for m in made] == sorted((k, x) for k, x, _ in want)
    assert [m[2] for m in made] == pytest.approx([want[k] for k in sorted(want, key=lambda k: k[:2])])


def test_no_term_moves_once_per_text(spark):
    """Texts of the same few words: what is asked for is the words and their neighbours, not what each text holds."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS[:8], k=200)), "x") for i in range(300)]
    pairs = stage(spark.createDataFrame(rows, "id long, question1 string, question2 string"), "term-moves")
    weights = corpus.tfidf_weights(corpus.distinct_texts(pairs), corpus.tfidf_fit(corpus.question_cells(pairs)), 600)
    assert "Generate" not in weights._jdf.queryExecution().optimizedPlan().toString()
    held = [len(r.terms) for r in weights.collect()]
    assert len(held) == 300 and max(held) <= 8 + 64


def test_the_share_of_a_term_is_one_for_a_table_and_a_block():
    block = terms.Terms.of(pa.chunked_array([["ak\nbé\nak\nak", "bé"], ["zz"]]))
    assert sorted(block.strings().to_pylist()) == ["ak", "ak ak", "ak bé", "bé", "bé ak", "zz"]
    for n in (1, 3, 1000):
        assert terms.shares_of_strings(block.strings(), n).tolist() == block.shares(n).tolist()
