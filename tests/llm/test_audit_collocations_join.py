import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from pairlens.llm import collocations, filter_audit, ngram_join
from tests.llm.conftest import EDGE, LONG, random_texts
from tests.llm.test_near_and_suffix import brute_components, near_texts, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(rows, labels):
    """Rows `(doc_id, text, part)` and labels `(doc_id, quality, toxic)`, document by document and order by order."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    fails = []
    for i, text, part in rows:
        text, words = text or "", WORD.findall(text or "")
        capitals = sum("A" <= c <= "Z" for c in text)
        behind = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails.append((i, part or "", {f for f, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text),
            any(c in "#$%&*|" for c in text), behind)) if bad}))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[1] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[2]]
                here = [f for f in fails if f[1] == part and letter in f[2]]
                left = [f for f in left if letter not in f[2]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(here) - len(gone), sum(f[2] == {letter} for f in here),
                                          sum(f[0] in good for f in gone), sum(f[0] in toxic for f in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in filter_audit.audit_filters(docs, labels).collect()}


def test_audit_holds_against_every_order(spark):
    rng = random.Random(3)
    texts = random_texts(4, 40, words=250, vocabulary=400) + [" ".join("Ab" for _ in range(120)), "ÄÖ " * 110, "A $ b"] * 3
    texts += [" ".join(f"w{i}" for i in range(rng.randint(90, 110))) + rng.choice(["", " |", " AAAA" * 20]) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    labels = [(rng.randrange(-5, 110), rng.randint(0, 1), rng.choice([0, 1, None])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = audited(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(got) == 3 * 600 and got == brute_audit(rows, labels)


def test_audit_edge_rows(spark, edge, nothing):
    labels = [(3, 1, None), (3, 0, 1), (3, 1, 1), (None, 1, 1), (8, None, None), (7, 0, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*r, "k") for r in labels], "doc_id long, quality int, toxic int, digest string")
    got = audited(edge, table)
    assert got == brute_audit(EDGE, labels)
    # Equal texts under ids 3 (twice), 5 and none: only that of 5 is behind one; 8 and 9 are behind the null text of 7.
    assert got["en", "EABCD", 1][1] == 2 and got["", "EABCD", 1][1] == 1
    assert audited(nothing, table) == {} and audited(edge, table.limit(0)) == brute_audit(EDGE, [])


def brute_collocations(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i:i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    covered = {(lang, w[i:i + k]) for (lang, w), f in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)
               if 100 * f >= 80 * candidates[lang, w[i:i + k]]}
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        if (lang, w) not in covered:
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, rank): (p.decode(), -a, l, r, totals[lang], -score) for lang, found in out.items()
            for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def mined(docs, **parameters):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(docs, **parameters).collect()}


@pytest.mark.parametrize("hot,buffer,top", [(10_000, 1 << 20, 2000), (4, 50, 7), (25, 300, 40)])
def test_collocations_hold_against_counting(spark, hot, buffer, top):
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice(["a", "b", "New", "york", "Über", "x y", "the", f"r{rng.randrange(60)}"])
                        + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]))
            for i in range(120)]
    rows += [(200 + i, "one two three four five six", "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = brute_collocations(rows, 5, top)
    assert len(want) > 10 and mined(docs, least=5, top=top, hot=hot, buffer=buffer) == want


def test_collocations_edge_rows(spark, edge, nothing):
    assert mined(nothing) == {} and mined(edge, least=1000) == {}
    want = brute_collocations(EDGE, 2, 2000)
    assert len(want) == 2000 + len([k for k in want if k[0] != "en"]) and mined(edge, least=2) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", 1, ["a"], "a", big + 1), ("en", 1, ["b"], "b", big), ("en", 2, ["a", "b"], "a b", big - 1)],
                                    "lang string, size int, words array<string>, phrase string, f long")
    row = collocations.scored(phrases).first()
    assert (row.l, row.r, row.score) == (big + 1, big, 2_000_000 * (big - 1) // (2 * big + 1)) and row.score == 999_999


@pytest.mark.parametrize("frequent,group_classes,words", [(64, 1024, 5), (2, 3, 5), (1, 1, 2), (5, 8, 3)])
def test_join_holds_against_all_pairs(spark, frequent, group_classes, words):
    texts = near_texts(frequent + 20) + [f"{i} common passage of many words that all documents of this kind share {i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(
        docs, words, frequent=frequent, group_classes=group_classes).collect()}
    want = brute_components(texts, words)
    assert len(set(want)) < len(texts) - 20
    assert [got[i] for i in range(len(texts))] == [(len(shingles(t, words)), c) for t, c in zip(texts, want)]


def test_join_at_the_limit_and_other_similarities(spark):
    # 4 of 5 words in common is 80 %; 7 of 9 is less.
    texts = ["a b c d", "a b c d e", "p q r s t u v w", "p q r s t u v x", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    heads = lambda percent: [r.component_id for r in ngram_join.join_documents(docs, 1, percent).orderBy("doc_id").collect()]
    assert heads(80) == [0, 0, 2, 3, 4] and heads(77) == [0, 0, 2, 2, 4] and heads(81) == [0, 1, 2, 3, 4]
    for percent in (0, 101):
        with pytest.raises(ValueError):
            ngram_join.join_documents(docs, 1, percent)


def test_fragment_sums_are_the_overlaps():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(30)] + [np.unique(pool)]
    left, right = np.arange(0, 31, 2), np.arange(1, 31, 2)
    for percent in (1, 30):
        rows, cols, sums = ngram_join.fragment_sums(sets, left, right, percent)
        at = {(left[x], right[y]): sums[i, j] for i, x in enumerate(rows) for j, y in enumerate(cols)}
        for x in left:
            for y in right:
                common = len(np.intersect1d(sets[x], sets[y]))
                similar = 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common)
                assert not similar or at[x, y] == common
    frequent = np.sort(pool[:40])
    prefixes = [ngram_join.prefix_of(s, frequent, 30) for s in sets]
    marks = np.stack([p[[-(-k * len(p) // ngram_join.MARKS) - 1 for k in range(1, ngram_join.MARKS + 1)]] for p in prefixes])
    alive = ngram_join.prefix_survivors(prefixes, marks, np.array([len(s) for s in sets]), left, right, 30)
    assert not alive.all()
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            common = len(np.intersect1d(sets[x], sets[y]))
            assert alive[i, j] or 100 * common < 30 * (len(sets[x]) + len(sets[y]) - common)
    assert ngram_join.prefix_length(0, 80) == 0 and ngram_join.prefix_length(1, 80) == 1 and ngram_join.prefix_length(100, 80) == 21


def test_prefixes_are_redrawn_from_their_spare_grams():
    rng, told = np.random.default_rng(8), 0
    for _ in range(300):
        grams = np.unique(rng.integers(0, 200, rng.integers(1, 80))).astype(np.uint64)
        frequent = np.unique(rng.integers(0, 200, rng.integers(0, 60))).astype(np.uint64)
        plain = ngram_join.prefix_of(grams, np.empty(0, np.uint64), 70)
        spare = grams[len(plain):len(plain) + rng.integers(0, 20)]
        made = ngram_join.redrawn_prefix(plain, spare, frequent)
        want = ngram_join.prefix_of(grams, frequent, 70)
        told += made is not None
        assert made is None or np.array_equal(made, want)
        # Only where the spare n-grams do not do is the text looked at again.
        if made is None:
            assert (~np.isin(np.concatenate([plain, spare]), frequent)).sum() < len(plain)
    assert told > 100


@pytest.mark.parametrize("spare", [0, 1, 10])
def test_join_does_not_depend_on_the_spare_grams(spark, monkeypatch, spare):
    monkeypatch.setattr(ngram_join, "SPARE", 0.0)
    monkeypatch.setattr(ngram_join, "LEAST_SPARE", spare)
    texts = near_texts(4) + [f"{i} common passage of many words that all documents of this kind share {i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(docs, 3, frequent=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 3)


def test_join_edge_rows(edge, nothing):
    got = ngram_join.join_documents(edge).collect()
    assert len(got) == len(EDGE) and ngram_join.join_documents(nothing).count() == 0
    heads = defaultdict(set)
    for r in got:
        heads[r.doc_id].add((r.n_shingles, r.component_id))
    assert heads[5] == {(1, 3)} and heads[None] == {(1, 3), (0, None)} and heads[3] == {(1, 3), (2, 3)}
    size = len(shingles(LONG, 5))
    assert heads[10] == heads[11] == {(size, 10)} and heads[12] == {(size + 1, 10)}
    assert [heads[i] for i in (7, 8, 9, 13)] == [{(0, i)} for i in (7, 8, 9, 13)]


def test_words_in_either_case_are_hot_together(spark):
    texts = spark.createDataFrame([("x", "The the THE cat.the"), ("y", "Dog\tthe dog\x0bDOG É é cat")], "lang string, text string")
    assert collocations.hot_words(texts, hot=5) == {b"the": 3, b"dog": 2}  # 5 and 3 of 12 words, the bound being 2.4
