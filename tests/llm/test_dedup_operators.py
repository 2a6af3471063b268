"""Exact and near duplicates against brute force, chats against a round trip, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
import pytest
from odd_rows import ODD, empty, odd  # noqa: F401
from test_text_operators import words_of

import corpus_pipeline
from sparkward.llm import chat_format, common, embedding_dedup, exact_dedup, minhash_dedup
from sparkward.llm.components import components


def closure(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def shingles(text, words):
    w = words_of(text)
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def near_truth(rows, words):
    """By brute force: (id, size of the set, smallest id reachable) of each row."""
    sets = [shingles(t, words) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    label = closure(len(rows), links)
    least = {}
    for (i, _), own in zip(rows, label, strict=True):
        if i is not None:
            least[own] = min(i, least.get(own, i))
    return Counter((i, len(s), least.get(own) if s else i) for (i, _), s, own in zip(rows, sets, label, strict=True))


def families(seed, count=12, size=25):
    """Texts changed a little again and again: many similarities lie about the threshold."""
    drawn = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(count):
        base = drawn.choices(vocabulary, k=drawn.randint(20, 150))
        for _ in range(size):
            changed = [drawn.choice(vocabulary) if drawn.random() < drawn.choice([0.0, 0.02, 0.05]) else w for w in base]
            texts.append(" ".join(changed))
    drawn.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_near_copies(spark, seed, words):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = minhash_dedup.link_documents(docs, words=words, rows_per_unit=40, rows_per_block=8).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_truth(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_copies_of_odd_rows(odd, empty):
    found = minhash_dedup.link_documents(odd, words=2).collect()
    rows = [(i, t) for i, t, *_ in ODD]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_truth(rows, 2)
    assert minhash_dedup.link_documents(empty).count() == 0


def test_registers_merge_and_tell_similarity():
    drawn = np.random.default_rng(3)
    pool = np.unique(drawn.integers(0, 2**64, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[500:2500]
    left, right, union = minhash_dedup.sketches([a, b, np.union1d(a, b)])
    assert (minhash_dedup.merged(left, right) == union).all()
    sizes = np.array([2000.0])
    assert not minhash_dedup.likely(left[None], right[None], sizes, sizes, 0.95)[0]
    assert minhash_dedup.likely(left[None], right[None], sizes, sizes, 0.6)[0]


def test_exact_copies(odd, empty, spark):
    repeated = spark.createDataFrame(
        [(i, "same  text" if i % 3 == 0 else f"text {i % 50}") for i in range(300)], "doc_id bigint, text string"
    )
    for docs, slices in ((odd, {}), (repeated, {}), (repeated, {"smallest_slice": 7, "most_slices": 40})):
        plain = [(r.doc_id, re.sub("[ \t\n\x0b\x0c\r]+", " ", r.text or "")) for r in docs.collect()]
        found = exact_dedup.mark_copies(docs, **slices).collect()
        ids, size = {}, Counter(t for _, t in plain)
        for i, t in plain:
            if i is not None:
                ids[t] = min(i, ids.get(t, i))
        digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in size}
        expected = Counter((i, ids.get(t), size[t], digest[t]) for i, t in plain)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
        kept = [r for r in found if r.kept]
        assert Counter(r.text_sha256 for r in kept) == Counter(digest.values())
        assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.mark_copies(odd).columns[:4] == ["doc_id", "text", "lang", "source"]
    assert exact_dedup.mark_copies(odd).columns.count("kept") == 1
    assert exact_dedup.mark_copies(empty).count() == 0
    named = repeated.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    for slices in ({}, {"smallest_slice": 7, "most_slices": 40}):
        found = exact_dedup.mark_copies(named, **slices).where("kept").collect()
        assert all(r.doc_id == r.keep_id and (r.doc_id is None or r.doc_id[0] == "d") for r in found)
        assert len(found) == exact_dedup.mark_copies(repeated, **slices).where("kept").count()


def test_sorted_content_is_shuffled_once(spark):
    from conftest import plan  # of the folder above

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    text = plan(exact_dedup.mark_copies(docs))
    assert text.count("rangepartitioning") >= 1 and "hashpartitioning" not in text
    assert "Python" not in text and "Arrow" not in text


def test_vectors(spark):
    drawn = np.random.default_rng(5)
    base = drawn.standard_normal((30, 16))
    rows = [v + drawn.standard_normal(16) * 0.25 for v in base for _ in range(8)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [rows[0]] * 3 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v) for i, v in enumerate(rows)]
    vectors = spark.createDataFrame(table, "vec_id bigint, embedding array<float>").repartition(3)
    sound = [v for v in table if v[1] and None not in v[1] and np.isfinite(v[1]).all() and np.any(v[1])]
    links = set()
    for i, a in sound:
        for j, b in sound:
            if i != j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links.add((i, j))
    count = Counter(i for i, _ in links)
    for blocks in (2_000, 5):
        found = embedding_dedup.link_vectors(vectors, missed=1e-9, rows_per_unit=50, rows_per_block=blocks).collect()
        assert {r.vec_id: r.n_links for r in found} == {i: count[i] for i, _ in table}
        assert [r.component_id for r in sorted(found)] == closure(len(table), links)
        assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    # At the parameters in use, nearly all links of any strength are found.
    found = sum(r.n_links for r in embedding_dedup.link_vectors(vectors).collect())
    assert 0.97 * len(links) <= found <= len(links)
    assert embedding_dedup.link_vectors(vectors.where("false")).count() == 0


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7)] + [(300, 400 + i) for i in range(50)]
    found = components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()
    assert {r.id: r.component for r in found} == {
        **{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300, **{400 + i: 300 for i in range(50)},
    }
    assert len(found) == 61 + 2 + 51


CHATS = [
    (1, 0, "system", "be <|end|> brief"), (1, 1, "user", "a <| b <\\| c <\\\\| \\"), (1, 2, "user", "again <"),
    (1, 3, "assistant", "| <|sep|> \\|"), (1, 4, "assistant", "<"), (1, 5, "assistant", "\\|é\U0001f600\n"),
    (2, 1, "assistant", None), (2, 0, None, "no role"), (2, None, "user", "no number"), (2, 0, "a<|b", ""),
    (None, 0, "user", "no conversation"), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"),
    (4, 0, "user", "x" * 100_000), (4, 1, "assistant", "y" * 100_000),
]


def test_chats_are_read_back(spark):
    turns = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_chats(turns)
    found = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    key = lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or "")
    for conv in {c for c, *_ in CHATS}:
        own = [(r or "", t or "") for _, _, r, t in sorted((t for t in CHATS if t[0] == conv), key=key)]
        assert [(t.role, t.text) for t in found[conv].turns] == own
        assert found[conv].loss_texts == [t for r, t in own if r == "assistant"]
    by_id = {r.conv_id: r for r in formatted.collect()}
    assert by_id[3].formatted == "<|role|>assistant<|text|>twice<|sep|>twice<|end|>\n"
    assert all(sum(e.skip + e.take for e in r.loss_mask) == len(r.formatted) for r in by_id.values())
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_the_pipeline_keeps_columns_and_drops_copies(spark, odd, empty, tmp_path):
    folder = tmp_path / "in"
    drawn = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    plain = []
    for i in range(200):
        words = drawn.choices(vocabulary, k=60)
        if i % 10 == 0:
            words[5:5] = ["idiot", "moron", "scum"]
        plain.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    near = [(200 + i, plain[i][1] + " more", "en", "s1", 0) for i in range(1, 10)]
    exact = [(300 + i, plain[i][1].replace(" ", "\n"), "en", "s2", 0) for i in range(11, 20)]
    docs = spark.createDataFrame(plain + near + exact, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "minhash_dedup", "mixing", "packing"]
    clean = {i for i in range(200) if i % 10}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    first = stages["toxicity"](spark, docs, str(folder))
    assert ids(first) == clean | {i for i, *_ in near + exact}
    second = stages["exact_dedup"](spark, first, str(folder))
    assert ids(second) == clean | {i for i, *_ in near}
    third = stages["minhash_dedup"](spark, second, str(folder))
    assert ids(third) == clean
    fourth = stages["mixing"](spark, third, str(folder))
    assert 1.4 < fourth.count() / len(clean) < 1.6
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(folder))
    assert ids(packed) <= clean and packed.agg({"length": "sum"}).first()[0] > 0
    for stage in list(stages.values())[:4]:
        assert stage(spark, odd, str(folder)).columns == odd.columns
        stage(spark, odd, str(folder)).collect()
        assert stage(spark, empty, str(folder)).count() == 0


def test_the_pipeline_keeps_one_row_of_each_near_copy(spark, odd):
    copy = "A cat sat on the mat and looked out"
    more = [(None, copy, "en", "a", "x", "row", "size", "id"), (11, None, "en", "a", "x", "row", "size", "id")]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    kept = dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, "")
    expected = [(i, t) for i, t, *_ in ODD if t is None or not re.match("(?i)a +cat", t)] + [(1, copy), (11, None)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(expected)


def test_only_hopeless_sketches_are_ruled_out():
    left = np.full((2, minhash_dedup.REGISTERS), 100)
    right = left.copy()
    for row, differing in enumerate((35, 40)):  # about e^-11.5 and e^-18 times less likely at 0.8
        right[row, :differing] += np.where(np.arange(differing) % 2, 1, -1)
    sizes = np.array([2000.0, 2000.0])
    assert minhash_dedup.likely(left, right, sizes, sizes, 0.8).tolist() == [True, False]


def test_a_frequent_key_is_dealt_over_tasks(spark):
    rows = spark.range(9_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k").repartition(3)
    table = spark.range(8_000).selectExpr("id AS k", "id * 2 AS v")
    rows, plain = common.stored(rows, "rows"), rows.join(table, "k")
    spread = common.spread_join(rows, table, "k")
    assert Counter(map(tuple, spread.select("id", "k", "v").collect())) == Counter(map(tuple, plain.select("id", "k", "v").collect()))
    assert common.spread_join(common.stored(rows.where("false"), "none"), table, "k").count() == 0


def test_rows_keep_their_numbers(spark, folder):
    spark.range(1_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text").repartition(7).write.parquet(folder)
    docs = spark.read.parquet(folder)
    first, again = ({r.doc_id: r.number for r in common.numbered(docs).select("number", "row.doc_id").collect()} for _ in range(2))
    assert first == again and len(set(first.values())) == 1_000
    doubled = common.numbered(docs.unionByName(docs)).select("number")
    assert doubled.distinct().count() == 2_000


def test_texts_of_one_identifier_are_fetched_once(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CONCAT('a b c d e f g h i j k l m n o p q r s ', id % 200) AS text")
    rows = minhash_dedup.link_documents(docs).collect()
    assert len(rows) == 400 and {r.component_id for r in rows} == {None} and all(r.kept for r in rows)
