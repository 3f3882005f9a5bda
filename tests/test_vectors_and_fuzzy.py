import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairlens.functions import text as T
from pairlens.operators import corpus, fuzzy, vectors
from tests.conftest import by_id

WORDS = ["red", "blue", "fish", "bird", "tree", "stone"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.RandomState(3)
    return {w: rng.normal(size=6).round(3).tolist() for w in WORDS}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "red fish", "blue fish fish"), (2, "tree", "tree"), (3, "nothing known", "red"), (4, "red blue stone", "bird tree"),
            (5, "red blue", "blue red")]
    return spark.createDataFrame(rows, "id long, question1 string, question2 string")


@pytest.fixture(scope="module")
def word_vectors(spark, table):
    return spark.createDataFrame(list(table.items()), "word string, vec array<double>")


def counts(texts, tokens):
    return corpus.token_counts(corpus.question_cells(texts), tokens)


@pytest.mark.parametrize("hot_keys", [10_000, 2])
def test_sentence_vectors_and_distances(texts, word_vectors, table, hot_keys):
    sent = vectors.sentence_vectors(texts, word_vectors, counts(texts, T.alpha_words), hot_keys=hot_keys)
    got = by_id(sent)
    x = np.sum([table["red"], table["fish"]], axis=0)
    y = np.sum([table["blue"], table["fish"], table["fish"]], axis=0)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    assert got[1]["vec1"] == pytest.approx(x, abs=1e-8) and got[1]["vec2"] == pytest.approx(y, abs=1e-8)
    assert got[3]["vec1"] == [0.0] * 6
    d = by_id(vectors.vector_distances(sent))
    gap = np.abs(x - y)
    want = {"cosine_distance": 1 - x @ y, "cityblock_distance": gap.sum(), "euclidean_distance": math.sqrt((gap ** 2).sum()),
            "minkowski_distance": (gap ** 3).sum() ** (1 / 3), "canberra_distance": (gap / (np.abs(x) + np.abs(y))).sum(),
            "braycurtis_distance": gap.sum() / np.abs(x + y).sum(), "jaccard_distance": 1.0}
    c = x - x.mean()
    want |= {"skew_q1vec": (c ** 3).mean() / (c ** 2).mean() ** 1.5, "kur_q1vec": (c ** 4).mean() / (c ** 2).mean() ** 2 - 3}
    for name, value in want.items():
        assert d[1][name] == pytest.approx(value, abs=1e-6), name
    # equal texts, equal bags of words and zero vectors
    for i in (2, 5):
        assert d[i]["cityblock_distance"] == 0 and d[i]["jaccard_distance"] == 0
    assert d[3]["cosine_distance"] is None and d[3]["skew_q1vec"] == 0.0 and d[3]["kur_q1vec"] == -3.0


@pytest.mark.parametrize("hot_keys", [10_000, 2])
def test_relaxed_moves_against_brute_force(texts, word_vectors, table, hot_keys):
    plain = counts(texts, T.plain_words)
    got = by_id(vectors.relaxed_wmd(texts, word_vectors, plain, hot_keys=hot_keys))
    centroid = by_id(vectors.word_centroid_distance(texts, word_vectors, plain, hot_keys=hot_keys))
    for row in texts.collect():
        a, b = ([w for w in t.split() if w in table] for t in (row.question1, row.question2))
        if not a or not b:
            assert got[row.id]["wmd"] is None and centroid[row.id]["wcd"] is None
            continue
        for name, scale in (("wmd", lambda v: np.array(v)), ("norm_wmd", lambda v: np.array(v) / np.linalg.norm(v))):
            gap = lambda u, v: np.linalg.norm(scale(table[u]) - scale(table[v]))
            one = np.mean([min(gap(u, v) for v in b) for u in a])
            two = np.mean([min(gap(u, v) for u in a) for v in b])
            assert got[row.id][name] == pytest.approx(max(one, two), abs=1e-6)
        mean = lambda ws: np.mean([table[w] for w in ws], axis=0)
        assert centroid[row.id]["wcd"] == pytest.approx(np.linalg.norm(mean(a) - mean(b)))


def test_unit_vectors_and_embedding_noise(spark, texts, word_vectors):
    for row in vectors.unit_vectors(word_vectors).collect():
        assert np.linalg.norm(row.vec) == pytest.approx(1.0)
    vocabulary = spark.createDataFrame([(f"w{i}", 1, i) for i in range(1, 2001)] + [("red", 5, 2001)],
                                       "word string, cnt long, idx long")
    table = vectors.embedding_table(vocabulary, word_vectors, seed=1)
    rows = {r.word: r for r in table.collect()}
    again = {r.word: r.vec for r in vectors.embedding_table(vocabulary.repartition(7), word_vectors, seed=1).collect()}
    assert {w: r.vec for w, r in rows.items()} == again and not rows["red"].is_oov
    noise = np.array([r.vec for r in rows.values() if r.is_oov])
    assert noise.shape == (2000, 6) and abs(noise.mean()) < 0.03 and noise.std() == pytest.approx(0.6, abs=0.03)
    report = vectors.embedding_coverage(table).first()
    assert (report.words, report.oov_words, report.tokens, report.oov_tokens, report.zero_vectors) == (2001, 2000, 2005, 2000, 0)


def slow_lcs(s, t):
    row = [0] * (len(t) + 1)
    for c in s:
        last = 0
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def slow_edits(s, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def samples(n, longest, seed=5):
    rng = random.Random(seed)
    for _ in range(n):
        yield tuple("".join(rng.choices("ab c", k=rng.randrange(1, longest))) for _ in range(2))


def test_lcs_and_edits_against_brute_force():
    for s, t in [("", "abc"), ("abc", "")] + list(samples(200, 90)):
        assert fuzzy.lcs_length(s, t) == slow_lcs(s, t)
        assert fuzzy.edit_distance(s, t) == slow_edits(s, t)


def test_best_window_and_its_floor():
    for s, t in samples(150, 40, seed=9):
        short, long = sorted((s, t), key=len)
        every = max(slow_lcs(short, long[i:i + len(short)]) for i in range(len(long) - len(short) + 1))
        assert fuzzy.best_window(s, t) == every
        for floor in (every - 1, every):
            assert fuzzy.best_window(s, t, max(0, floor)) == every
        score = fuzzy._percent(every / len(short))
        for beat in (0, score - 0.5, score + 0.5):
            assert fuzzy.partial_ratio(s, t, beat) == score or (score <= beat and fuzzy.partial_ratio(s, t, beat) <= score)


def slow_weighted(s, t):
    """The weighted ratio from its definition: every form scored in full."""
    ratio = lambda a, b: 0 if not a or not b else round(200 * slow_lcs(a, b) / (len(a) + len(b)))
    def partial(a, b):
        if not a or not b:
            return 0
        short, long = sorted((a, b), key=len)
        return round(100 * max(slow_lcs(short, long[i:i + len(short)]) for i in range(len(long) - len(short) + 1)) / len(short))
    a, b = set(s.split()), set(t.split())
    text = lambda ws: " ".join(sorted(ws))
    sets = [text(a & b), f"{text(a & b)} {text(a - b)}".strip(), f"{text(a & b)} {text(b - a)}".strip()]
    by_sort = (" ".join(sorted(s.split())), " ".join(sorted(t.split())))
    by_set = lambda f: max(f(sets[0], sets[1]), f(sets[0], sets[2]), f(sets[1], sets[2]))
    gap = max(len(s), len(t)) / min(len(s), len(t))
    if gap < 1.5:
        return round(max(ratio(s, t), ratio(*by_sort) * .95, by_set(ratio) * .95))
    w = .6 if gap > 8 else .9
    return round(max(ratio(s, t), partial(s, t) * w, partial(*by_sort) * .95 * w, by_set(partial) * .95 * w))


def test_fuzz_ratios_against_the_definition(spark):
    rows = [(i, s.strip(), t.strip()) for i, (s, t) in enumerate(list(samples(120, 30, seed=1)) + list(samples(60, 12, seed=2)))]
    rows += [(1000, "a b c", "a b c"), (1001, "", "abc"), (1002, "!!", "??"), (1003, "ab", "x" * 9 + " ab " + "y" * 20)]
    df = spark.createDataFrame(rows * 2, "id long, question1 string, question2 string").dropDuplicates(["id"])
    got = by_id(fuzzy.fuzz_ratios(df))
    assert len(got) == len(rows)
    for i, s, t in rows:
        s, t = s.strip("!?"), t.strip("!?")
        want = (0, 0) if not s or not t else (round(200 * slow_lcs(s, t) / (len(s) + len(t))), slow_weighted(s, t))
        assert (got[i]["fuzz_qratio"], got[i]["fuzz_WRatio"]) == want, (s, t)


def test_normalise_drops_latin1_accents(spark):
    row = spark.createDataFrame([("Über, ÉCOLE_1!",)], "t string").select(fuzzy.normalise(F.col("t")).alias("n")).first()
    assert row.n == "ber  cole_1"


def test_levenshtein_both_ways(pairs):
    lev = by_id(fuzzy.levenshtein_ratio(pairs))
    assert lev == by_id(fuzzy.levenshtein_ratio(pairs, long_from=1)) and lev[2]["ratio"] == 1.0 and lev[3]["ratio"] == 0.0
    for row in pairs.collect():
        a, b = (r["n"] for r in pairs.sparkSession.createDataFrame([(row.question1,), (row.question2,)], "t string").select(
            fuzzy.normalise(F.col("t")).alias("n")).collect())
        want = 1 - slow_edits(a, b) / max(len(a), len(b)) if a or b else 0.0
        assert lev[row.id]["ratio"] == pytest.approx(want)


def test_moves_between_long_texts_are_tiled():
    rng = np.random.RandomState(4)
    x, y = rng.normal(size=(10_000, 4)), rng.normal(size=(9_000, 4))
    ones = lambda v: np.ones(len(v))
    score = lambda: vectors._relaxed_moves.func(*[pd.Series([v]) for v in (ones(x), x.ravel(), ones(y), y.ravel())]).iloc[0]
    tiled = score()
    gap = np.array([np.sqrt(((y - v) ** 2).sum(1).min()) for v in x]).mean(), np.array([np.sqrt(((x - v) ** 2).sum(1).min()) for v in y]).mean()
    assert tiled.wmd == pytest.approx(max(gap))
