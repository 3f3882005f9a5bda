"""Steps that whole texts pass through: the same rows, and no text moved or written once per pair."""

import random
import urllib.parse
from itertools import product
from pathlib import Path

import pytest

from pairlens.operators import words as W
from pairlens.sources import derived as D


def _documents(seed: int, n: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=9))
    return [(i, " ".join(word() for _ in range(size))) for i in range(n)]


def _expected(docs):
    """Pairs of FIXTURES.md, once for every two rows that hold their ids, and again for ids of first documents that repeat."""
    known = [(i, " " if t is None else t) for i, t in docs if i is not None]
    held = {i for i, _ in known}
    ids = {(i, i + s) for i in held for s in D.STEPS if i + s in held}
    groups = {}
    for i, t in known:
        for key in {("text", t), *[("line", x.strip(" ")) for x in t.split("\n") if len(x.strip(" ")) >= D.LINE_LENGTH]}:
            groups.setdefault(key, set()).add(i)
    for group in groups.values():
        ids |= {(min(group), i) for i in group if i > min(group)}
    out = []
    for a, b in ids:
        for (_, t), (_, u) in product([d for d in known if d[0] == a] * sum(d[0] == a for d in known), [d for d in known if d[0] == b]):
            x, y = set(t.lower().split()), set(u.lower().split())
            out.append((a * D.ID_BASE + b, a, b, t, u, int(bool(x | y) and 2 * len(x & y) >= len(x | y))))
    return sorted(out)


@pytest.mark.parametrize("block_bits, bytes_of_a_task", [(8, 4 << 20), (2, 200), (0, 50)])
def test_pairs_by_blocks_are_those_of_the_definition(spark, block_bits, bytes_of_a_task):
    line = "a line of forty characters and more that is shared"
    docs = _documents(1, 30, 4)
    docs += [(i, f"own {i}\n{line}") for i in range(40, 80, 3)] + [(3, "the same id again"), (None, "no id"), (60, None), (61, None)]
    docs += [(900, docs[0][1]), (901, docs[0][1]), (902, f" {line} \n"), (903, ""), (904, "x y"), (905, "x y z Z")]
    made = D.build_pairs(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, ' ') AS text"),
                         block_bits=block_bits, bytes_of_a_task=bytes_of_a_task)
    columns = ["id", "id1", "id2", "question1", "question2", "is_duplicate"]
    assert sorted(tuple(r[c] for c in columns) for r in made.collect()) == _expected(docs)


def test_pairs_do_not_store_a_text_once_per_pair(spark, tmp_path):
    docs = _documents(2, 40, 10_000)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = D.pairs(spark, str(tmp_path))
    assert pairs.count() == 39 + 33
    stored = sum(Path(urllib.parse.unquote(urllib.parse.urlparse(f).path)).stat().st_size for f in pairs.inputFiles())
    # Nearly every text is in two pairs on either side; random letters shrink to three quarters.
    assert stored < 2.5 * sum(len(t) for _, t in docs)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot_keys", [10_000, 3])
def test_word_match_share_moves_no_list_of_words_by_pair(spark, hot_keys):
    rows = [(1, ["a", "b", "b", "the"], ["b", "c"]), (2, ["a"], ["a", "a"]), (3, [], ["a"]), (4, ["the"], ["the"]), (5, None, ["a"]),
            (6, ["x", "y"], ["z"]), (7, ["rare"], ["rare"]), (8, ["a", "b"], ["c"]), (8, ["a"], ["a", "c"]), (9, ['q"\\', "b"], ['q"\\'])]
    weight = {"a": .5, "b": .25, "c": .125, "the": 1.0, "x": .75, "y": .375, "z": .0625, "rare": 0.0, 'q"\\': 2.0}
    tokens = spark.createDataFrame(rows, "id long, words1 array<string>, words2 array<string>")
    weights = spark.createDataFrame([(w, n + 2, x) for n, (w, x) in enumerate(weight.items())], "word string, cnt long, weight double")
    found = W.word_match_share(tokens, weights, ["the"], hot_keys=hot_keys)
    assert "words1" not in _plan(found)

    def share(i, stops):
        both = [(set(a) - stops, set(b) - stops) for j, a, b in rows if j == i and a is not None and b is not None]
        whole = sum(weight[w] for a, b in both for s in (a, b) for w in s)
        return sum(2 * weight[w] for a, b in both for w in a & b) / whole if whole else None

    made = sorted((r.id, r.tfidf_wm, r.tfidf_wm_stops) for r in found.collect() if r.id not in (5, 7))
    assert made == sorted((i, 0.0 if not a or not b else share(i, set()), 0.0 if {*a} <= {"the"} or {*b} <= {"the"} else share(i, {"the"}))
                          for i, a, b in rows if i not in (5, 7))
    assert {(r.id, r.tfidf_wm) for r in found.collect() if r.id in (5, 7)} == {(5, None), (7, None)}
