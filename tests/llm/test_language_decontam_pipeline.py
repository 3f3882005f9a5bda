import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.llm import decontam, language
from tests.llm.conftest import EDGE, random_texts

WORDS = {"xx": ["aba", "baa", "aab", "abba"], "yy": ["cdc", "dcc", "ccd", "dccd"]}


def labelled(n=80):
    rng = np.random.default_rng(0)
    return [(i, " ".join(rng.choice(WORDS[lang], 20)), lang) for i in range(n) for lang in [("xx", "yy")[i % 2]]]


def test_language_of_held_out_documents(spark):
    rows = labelled() + [(900, None, "xx"), (901, "12 34 !", "yy"), (None, "cdc dcc", "xx"), (902, "", None), (903, "aba " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in got if i is not None) and got[None].held_out
    assert all(got[i].lang_pred == lang for i, _, lang in labelled())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == 0


def test_predictions_see_the_text_only(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    network = language.fit(language.training_sample(docs), rounds=20)
    plain = language.identify(docs, network).select("doc_id", "score")
    changed = language.identify(docs.withColumn("lang", F.lit("yy")), network).select("doc_id", "score")
    assert sorted(plain.collect()) == sorted(changed.collect())


def test_gradients_of_the_recurrent_layers():
    rng = np.random.default_rng(1)
    data, up = rng.integers(97, 101, (7, 3)).astype(np.uint8), rng.normal(0, 1, (7, 3, 4)).astype(np.float32)
    layer = language.Layer(rng, 4)
    layer.weights = {k: v.astype(np.float64) for k, v in layer.weights.items()}
    states, kept = layer.forward(data, keep=True)
    grads = layer.backward(kept, up)
    for k, at in (("u", (1, 2)), ("u", (0, 9)), ("c", (3,)), ("w", (98, 5)), ("w", (99, 10))):
        loss = []
        for step in (1e-3, -1e-3):
            layer.weights[k][at] += step
            loss.append(float((layer.forward(data)[0].astype(np.float64) * up).sum()))
            layer.weights[k][at] -= step
        assert grads[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=5e-3)


def test_long_texts_are_pooled_whole():
    network = language.Network.new(["a", "b"])
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (1, 47, 48, 49, 1000, 48 * 2048 + 5, 0)]
    got = network.document_probabilities(texts)
    for text, p in zip(texts, got):
        if not text:
            assert not p.any()
            continue
        parts = [text[i:i + language.STEPS] for i in range(0, len(text), language.STEPS)]
        total = np.zeros(2)
        for part in parts[-3:] if len(parts) > 500 else parts:
            data = np.frombuffer(part.ljust(language.STEPS, b"\0"), np.uint8)[:, None]
            total += np.array(list(network.position_probabilities(data)))[:len(part), 0].sum(axis=0)
        if len(parts) <= 500:
            assert p == pytest.approx(total / len(text), rel=1e-4)
        assert p.sum() == pytest.approx(1, rel=1e-4)


def test_language_edge_rows(edge, nothing):
    got = language.identify(edge).collect()
    assert len(got) == len(EDGE) and language.identify(nothing).count() == 0
    kept = language.drop_unidentified(edge)
    assert kept.columns == edge.columns and Counter(r.text for r in kept.collect()) == Counter(
        t for _, t, _ in EDGE if t and any(c.isalpha() for c in t))


def test_without_labels_to_learn_from_every_text_with_a_letter_stays(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    texts = [(i, t) for i, t in zip(held, ["A clean line.", "Straße", "漢字", "12 34 !", "", None])]
    for lang, min_score in ((None, 0.0), ("en", 0.0), (None, 0.5)):  # no labels; labels on held-out rows alone
        docs = spark.createDataFrame([(i, t, lang) for i, t in texts], "doc_id long, text string, lang string")
        kept = language.drop_unidentified(docs, min_score=min_score)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == held[:3]


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(span, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(i)
    out = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[s:s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    found |= ids
        out[i, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))] += 1
    return out


def report(docs, items):
    return Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontam.decontamination_report(docs, items).collect())


def test_contamination_holds_against_all_windows(spark, edge, nothing):
    texts = random_texts(4, 60, words=40, vocabulary=3) + ["Ä-b C_d", None, ""]
    items = [(i, t) for i, t in enumerate(random_texts(4, 70, words=40, vocabulary=3)[50:])] + [
        (90, "ä b c"), (91, "A!b c d E f g h i j k"), (92, None), (93, "..."), (94, "ä b c"), (None, "b c d")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(enumerate(texts), items)
    assert report(docs, bench) == want and any(n for _, _, n, _ in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(n == 0 for _, _, n, _ in report(docs, none))
    assert report(edge, bench) == brute_hits([(i, t) for i, t, _ in EDGE], items)
    assert decontam.decontamination_report(nothing, bench).count() == 0
    kept = decontam.drop_contaminated(edge, spark.createDataFrame([(1, "two three four")], "item_id long, text string"))
    assert kept.columns == edge.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t, _ in EDGE if "two three four" not in " ".join(words(t)))


def test_fingerprints_that_are_not_broadcast_give_the_same(spark, edge, nothing):
    texts = random_texts(4, 60, words=40, vocabulary=3) + ["Ä-b C_d", None, ""]
    items = [(i, t) for i, t in enumerate(random_texts(4, 70, words=40, vocabulary=3)[50:])] + [(90, "ä b c"), (None, "b c d"), (91, None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    thin = lambda d: Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in
                             decontam.decontamination_report(d, bench, broadcast_rows=0).collect())
    assert thin(docs) == brute_hits(enumerate(texts), items)
    assert thin(edge) == brute_hits([(i, t) for i, t, _ in EDGE], items)
    assert not thin(nothing)


def test_a_prompt_of_many_items_is_one_hit_a_document(spark):
    prompt = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, f"a{i} {prompt} z{i}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"q{i} {prompt} r{i}") for i in range(30)], "item_id long, text string")
    counts, hits, names = decontam.contamination(docs, items)
    assert counts.count() == 20 and hits.count() == 20
    want = (12, 10, ",".join(sorted(map(str, range(30)))))
    assert report(docs, items) == Counter({(i, *want): 1 for i in range(20)})


def test_nothing_to_hold_against_keeps_every_row(spark, edge, nothing):
    for items in ([], [(1, None), (2, ""), (3, "...")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        kept = decontam.drop_contaminated(edge, bench)
        assert kept.columns == edge.columns and Counter(r.text for r in kept.collect()) == Counter(t for _, t, _ in EDGE)
        assert decontam.drop_contaminated(nothing, bench).count() == 0


def test_shared_spans_of_ten_words_are_found_wherever_they_lie(spark):
    filler = random_texts(5, 40, words=60, vocabulary=40)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, f"{t[:i * 3]} | {passage} | {t[i * 3:]}") for i, t in enumerate(filler)]
    items = [(1, f"x y z {passage} q r s")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    assert all(n >= 10 for _, _, n, _ in report(frame(docs, "doc_id"), frame(items, "item_id")))


def test_pipeline_against_its_stages_in_python(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_near_and_suffix import brute_components

    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    leak = "the benchmark asks what the capital of the far country might be today"
    texts = [base, base.replace(" ", "  "), base + "end", "Some other words entirely, in a sentence.", "12345 67890", None, "", leak + " and more",
             "A clean line of text.", base.replace("seven", "sept", 1)] + random_texts(6, 20, words=30, vocabulary=30)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    seen, unique = set(), []
    for i, t in kept:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            unique.append((i, t))
    heads = brute_components([t for _, t in unique], 5)
    alone = [row for k, row in enumerate(unique) if heads[k] == k]
    hits = {i: n for (i, _, n, _) in brute_hits(alone, [(1, leak)])}
    want = {i for i, _ in alone if not hits[i]}
    assert {r.doc_id for r in got} == want and len(got) == len(want) and {1, 4, 5, 6, 7}.isdisjoint(want)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
