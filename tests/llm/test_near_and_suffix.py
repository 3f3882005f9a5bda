import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairlens.llm import minhash, suffix
from pairlens.llm.groups import components
from tests.llm.conftest import EDGE, LONG, random_texts


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, percent=80):
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def near_texts(seed, n=150):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(8, 60))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        out.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return out


@pytest.mark.parametrize("words,group_classes", [(2, 4096), (5, 3)])
def test_components_hold_against_all_pairs(spark, words, group_classes):
    texts = near_texts(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in minhash.near_groups(docs, words, group_classes=group_classes).collect()}
    want = brute_components(texts, words)
    assert len(set(want)) < len(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t, words)) for t in texts]


@pytest.mark.parametrize("percent", [50, 40])
def test_pairs_at_a_low_limit_are_found(spark, percent):
    share = {50: (20, 10), 40: (20, 15)}[percent]  # words in common, and words that only one of the two has
    texts = []
    for i in range(40):
        common = [f"c{i}x{k}" for k in range(share[0])]
        texts += [" ".join(common + [f"{side}{i}y{k}" for k in range(share[1])]) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(docs, 1, percent).collect()}
    assert [got[i] for i in range(80)] == brute_components(texts, 1, percent) == [i - i % 2 for i in range(80)]


def test_plan_keeps_the_chance_of_a_miss():
    assert minhash.plan(80) == (minhash.COORDINATES, minhash.MATCHES)
    for percent in (13, 30, 50, 60, 70, 90, 100):
        coordinates, matches = minhash.plan(percent)
        assert matches >= 1 and minhash.miss_chance(percent, coordinates, matches) < minhash.MISS
    for percent in (0, 5, 101):
        with pytest.raises(ValueError):
            minhash.plan(percent)


def test_near_edge_rows(edge, nothing):
    got = minhash.near_groups(edge, words=2).collect()
    assert len(got) == len(EDGE) and minhash.near_groups(nothing).count() == 0
    heads = defaultdict(set)
    for r in got:
        heads[r.doc_id].add((r.n_shingles, r.component_id))
    assert heads[5] == {(3, 3)} and heads[12] == {(next(iter(heads[10]))[0] + 1, 10)} and heads[11] == heads[10]
    assert heads[7] == {(0, 7)} and heads[8] == {(0, 8)} and heads[13] == {(0, 13)}
    kept = minhash.drop_near(edge, words=2)
    assert kept.columns == edge.columns and minhash.drop_near(nothing).count() == 0
    texts = Counter(r.text for r in kept.collect())
    assert texts["one two three four"] == 1 and texts[LONG] == 1 and LONG + " tail" not in texts
    assert texts[None] + texts[""] == 4


def test_group_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(25)]
        links = list(minhash.group_links(sets, np.zeros((25, 4)), 1, 60))
        alike = {(i, j) for i in range(25) for j in range(i)
                 if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
        label = list(range(25))

        def join(pairs):
            label = list(range(25))
            for a, b in list(pairs) * 25:
                label[a] = label[b] = min(label[a], label[b])
            return label

        assert join(links) == join(alike) and len(links) <= 24


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert got[200] == 200 and got[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_cut(rows, span):
    first = {}
    for i, t in rows:
        for p in range(len(t) - span + 1):
            first[t[p:p + span]] = min(first.get(t[p:p + span], i), i)
    out = Counter()
    for i, t in rows:
        hit = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if first[t[p:p + span]] < i:
                hit[p:p + span] = b"\1" * span
        runs = sum(1 for a, b in zip(b"\0" + hit, hit) if b and not a)
        out[i, len(t), bytes(c for c, z in zip(t, hit) if not z), runs] += 1
    return out


def cut(docs, **kw):
    return Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffix.cut_repeats(docs, **kw).collect())


@pytest.mark.parametrize("group_rows", [200_000, 1])
def test_cuts_hold_against_all_windows(spark, group_rows):
    rng = random.Random(group_rows)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(8)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["a" * 500, "a" * 90, "ab" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert cut(docs, span=16, gram=5, group_rows=group_rows) == brute_cut([(i, t.encode()) for i, t in enumerate(texts)], 16)


def test_suffixes_are_sorted_and_runs_confirmed_on_bytes():
    rng = random.Random(3)
    stretches = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 12))).encode() for _ in range(40)]
    zero = np.zeros(40, np.int64)
    one = suffix.Suffixes(stretches, zero, zero + 20, 6)
    text = lambda i: stretches[one.item[i]][one.offset[i]:one.offset[i] + 6]
    want, _ = one._by_bytes()
    order, new = one.runs()
    assert [(one.bucket[i], text(i)) for i in order] == [(one.bucket[i], text(i)) for i in want]
    assert [bool(n) for n in new[1:]] == [(one.bucket[a], text(a)) != (one.bucket[b], text(b)) for a, b in zip(order, order[1:])]
    one.whole = np.zeros_like(one.whole)  # all strings share a hash: the bytes still tell them apart
    assert [(one.bucket[i], text(i)) for i in one.runs()[0]] == [(one.bucket[i], text(i)) for i in want]


def test_cut_edge_rows(edge, nothing):
    rows = [(suffix.NO_ID if i is None else i, (t or "").encode()) for i, t, _ in EDGE]
    want = Counter({(None if i == suffix.NO_ID else i, *rest): n for (i, *rest), n in brute_cut(rows, 50).items()})
    assert cut(edge) == want and suffix.cut_repeats(nothing).count() == 0


def test_random_words_with_short_spans(spark):
    texts = random_texts(9, 80, words=20, vocabulary=3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert cut(docs, span=9, gram=4) == brute_cut([(i, t.encode()) for i, t in enumerate(texts)], 9)


@pytest.mark.parametrize("span, gram", [(50, 20), (8, 3), (5, 5), (1, 1)])
def test_runs_of_windows_against_each_window(span, gram):
    rng = np.random.default_rng(7)
    for size in (0, 4, 60, 300):
        ends = np.cumsum(rng.integers(0, size + 1, 6))
        data = rng.integers(97, 99, ends[-1]).astype(np.uint8)
        hashes = (suffix._mixed(suffix.Hashes(data).each(gram)) >> np.uint64(16)).astype(np.int64).tolist() if len(data) >= gram else []
        runs, last = [], None
        for i in range(max(0, len(data) - span + 1)):
            text = int(np.searchsorted(ends, i, "right"))
            if i + span > ends[text]:
                last = None
                continue
            window = hashes[i:i + span - gram + 1]
            anchor = (text, i + window.index(min(window)))
            if anchor == last:
                runs[-1][3] = i
            else:
                runs.append([min(window), text, i, i])
            last = anchor
        assert [list(r) for r in zip(*[x.tolist() for x in suffix.window_runs(data, ends, span, gram)])] == runs
