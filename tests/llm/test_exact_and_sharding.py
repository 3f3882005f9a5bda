import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pairlens.llm import exact, sharding
from tests.llm.conftest import EDGE, random_texts


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_hold_against_python(spark):
    texts = random_texts(1, 120, words=4, vocabulary=2)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    # Blocks of three bytes make many levels and odd ends.
    got = {r.doc_id: r for r in exact.exact_groups(docs, block_bytes=3).collect()}
    for i, t in enumerate(texts):
        mine = groups[norm(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (mine[0], len(mine), i == mine[0])
        assert got[i].text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_texts_that_share_blocks_stay_apart(spark):
    texts = ["abcabc", "abc", "abcabcabc", "abcabcabcabc", "abcabd", "", "abcabcab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.group_size == 1 for r in exact.exact_groups(docs, block_bytes=3).collect())


def test_exact_edge_rows(edge, nothing):
    got = exact.exact_groups(edge).collect()
    assert len(got) == len(EDGE) and exact.exact_groups(nothing).count() == 0
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert all(sum(r.kept for r in rows) == 1 for rows in by_text.values())
    four = by_text[hashlib.sha256(b"one two three four").hexdigest()]
    assert len(four) == 4 and {r.keep_id for r in four} == {3}
    empty = by_text[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and {r.keep_id for r in empty} == {7}


def test_drop_exact_keeps_one_row_of_each_text(edge, nothing):
    got = exact.drop_exact(edge)
    assert got.columns == edge.columns and exact.drop_exact(nothing).count() == 0
    assert sorted(Counter(norm(r.text) for r in got.collect()).values()) == [1] * len({norm(t) for _, t, _ in EDGE})


def test_permutation_is_one_to_one_and_computable(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, key=5).alias("p"))
        back = rows.select("id", "p", sharding.permuted(F.col("p"), n, key=5, inverse=True).alias("b")).collect()
        assert sorted(r.p for r in back) == list(range(n)) and all(r.b == r.id for r in back)


def test_shards_are_even_gapless_and_reproducible(spark, edge, nothing):
    got = sharding.shard_rows(edge, shards=4, key=2)
    rows = got.collect()
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert len(rows) == len(EDGE) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in EDGE)
    place = lambda df: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in df.collect())
    assert place(sharding.shard_rows(edge.repartition(7), shards=4, key=2)) == place(got)
    found = got.select("row_number", sharding.row_at(F.col("shard"), F.col("slot"), len(EDGE), 4, 2).alias("at")).collect()
    assert all(r.row_number == r.at for r in found)
    assert sharding.shard_rows(nothing).count() == 0
