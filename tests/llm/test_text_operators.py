"""Sharding, packing, scoring, language, mixing and toxicity, on odd rows and against plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from odd_rows import ODD, empty, odd  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkward.llm import language, mixing, packing, sharding, suffix_tree, toxicity
from sparkward.llm.common import remainder

DATA = "/root/testdata/sf0.01"


def docs_of(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet")


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    return [w for w in lowered.split(" ") if w]


def test_shards_hold_all_rows_with_gapless_slots(odd, empty):
    rows = sharding.assign_shards(odd, shards=3, parts_of_a_shard=8).collect()
    assert len(rows) == len(ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert sizes == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ODD}
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_even_and_keep_small_groups_whole(spark):
    docs = docs_of(spark)
    for slices, most in ((20_000, 1.02), (200, 1.1)):  # slices of 200 hold texts of a third of their shard
        rows = sharding.assign_shards(docs, groups_per_slice=slices).join(docs.select("doc_id", "text"), "doc_id")
        total = [r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
        assert len(total) == 24 and max(total) < most * min(total)
    limit = sum(total) // (24 * 64)
    groups = rows.groupBy("text").agg(F.sum("size").alias("bytes"), F.countDistinct("shard").alias("shards"))
    assert groups.where(f"shards > 1 and bytes <= {limit}").count() == 0


def test_a_hot_group_is_cut(spark):
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")
    )
    count = [r["count"] for r in sharding.assign_shards(docs, shards=6).groupBy("shard").count().collect()]
    assert len(count) == 6 and max(count) - min(count) < 20


def test_ids_are_those_of_the_tokenizers_file(spark):
    plain = Tokenizer.from_file(packing.TOKENIZER)
    texts = [r.text for r in docs_of(spark).limit(200).collect()] + [t or "" for _, t, *_ in ODD]
    texts += ["".join(random.Random(i).choices("aé ß\n\t'sЖ中\u0661 1!<|endoftext|>", k=300)) for i in range(50)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "<|endoftext|", "<<|endoftext|>>\n"]
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [packing.ids_by(packing.TOKENIZER)(t) for t in texts] == expected


def check_pieces(rows, ids_of, capacity):
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    for (doc, n), parts in by_doc.items():
        assert sum(length for _, length, _ in parts) % n == 0
        for start, length, crc in parts:
            found = [np.array(i[start : start + length], "<u4").tobytes() for i in ids_of[doc] if len(i) == n]
            assert crc in {zlib.crc32(f) for f in found}
    return len(sequences)


def test_pieces_fill_sequences(spark):
    docs = docs_of(spark)
    plain = Tokenizer.from_file(packing.TOKENIZER)
    ids_of = {r.doc_id: [[*plain.encode(r.text, add_special_tokens=False).ids, 0]] for r in docs.collect()}
    rows = packing.pack(docs, pieces_per_run=500).collect()
    used = check_pieces(rows, ids_of, 1024)
    tokens = sum(len(i[0]) for i in ids_of.values())
    assert sum(r.length for r in rows) == tokens
    assert used <= tokens / 1024 * 1.01 + 2


def test_packing_of_odd_rows(odd, empty):
    plain = Tokenizer.from_file(packing.TOKENIZER)
    ids_of = defaultdict(list)
    for i, t, *_ in ODD:
        ids_of[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    rows = packing.pack(odd, capacity=64, smallest=8, with_ids=True).collect()
    check_pieces(rows, ids_of, 64)
    assert sum(r.length for r in rows) == sum(len(i) for many in ids_of.values() for i in many)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(empty).count() == 0


def base_scores(docs):
    training = Counter()
    for i, text in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            training.update([*words_of(text), "\n"])
    n, v = sum(training.values()), len(training)
    result = []
    for i, text in docs:
        tokens = [*words_of(text), "\n"]
        score = sum(math.log10((training[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        result.append((i, len(tokens), sum(training[t] > 0 for t in tokens), n, round(score, 4)))
    return sorted(result, key=repr)


def test_unigram_scores(spark, odd, empty):
    for docs, plain in ((docs_of(spark), None), (odd, ODD)):
        rows = suffix_tree.score_documents(docs, remainder("doc_id", 5) != 1, frequent_share=1e-3).collect()
        plain = [(r.doc_id, r.text) for r in docs.collect()] if plain is None else [(i, t) for i, t, *_ in ODD]
        found = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows]
        assert sorted(found, key=repr) == base_scores(plain)
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert suffix_tree.score_documents(empty, F.lit(True)).count() == 0
    untrained = suffix_tree.score_documents(odd, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_the_tree_is_a_distribution_and_learns(spark):
    text = "the cat sat on the mat. the dog sat on the cat. " * 40
    docs = spark.createDataFrame([(1, text), (2, "the cat sat on the dog."), (3, "zq xw vk jj qz wx kv qq zz")], "doc_id bigint, text string")
    counted = suffix_tree.count_training(docs.where("doc_id = 1"), 6).where("not word").select("key", "n")
    tree = suffix_tree.grow(counted, 6, 1e-5, 2, 1e-7, 4.0)
    unseen = 256 - (tree.log10.shape[1] - 1)
    probability = 10.0 ** tree.log10
    assert np.allclose(probability[:, :-1].sum(axis=1) + unseen * probability[:, -1], 1, atol=1e-4)
    # Lanes give what reading byte by byte gives.
    data = np.frombuffer((text * 3).encode(), np.uint8)
    state, slow = 0, []
    for symbol in np.concatenate([np.full(6, 10, np.uint8), data]):
        slow.append(tree.log10[state, tree.symbols[symbol]])
        state = tree.following[state, tree.symbols[symbol]]
    assert np.allclose(tree.scores(data), slow[6:])
    rows = {r.doc_id: r.score / r.n_tokens for r in suffix_tree.score_documents(docs, F.col("doc_id") == 1, fewest=2).collect()}
    assert rows[2] > rows[3] + 2


def test_rare_contexts_are_learnt_in_a_large_corpus(spark):
    rare = "quixotic zephyrs vex bold jumpy wharf kings"
    rows = [(i, "the cat sat on the mat and looked out " * 2_000) for i in range(40)]  # over 3 million positions
    rows += [(100 + i, rare) for i in range(13)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r.score for r in suffix_tree.score_documents(docs, F.col("doc_id") != 112).collect()}
    assert found[112] / len(rare) > -0.55
    assert math.isclose(found[112], found[100], rel_tol=1e-6)


def test_scores_are_those_of_the_whole_tree(spark):
    docs = docs_of(spark)
    training, gain = remainder("doc_id", 5) != 1, 3.0
    counted = suffix_tree.count_training(docs.where(training), 6).where("not word").select("key", "n")
    total = counted.agg(F.sum("n")).first()[0]
    tree = suffix_tree.grow(counted, 6, 0.0, 10, gain / total, 32.0)
    expected = {}
    for r in docs.collect():
        data, predicted, *_ = suffix_tree._laid_out([r.text.encode()], 6)
        expected[r.doc_id] = float(tree.scores(data)[predicted].astype(float).sum())
    # Some by the broadcast, many by the join.
    rows = suffix_tree.score_documents(docs, training, gain=gain, frequent_grams=1e-5).collect()
    assert len(rows) == len(expected)
    assert all(math.isclose(r.score, expected[r.doc_id], rel_tol=1e-4) for r in rows)


def test_rare_keys_and_counts_travel_as_lists(spark):
    docs = docs_of(spark)
    training = remainder("doc_id", 5) != 1
    marked = docs.select("text", training.alias("training"))
    rows = suffix_tree.score_documents(docs, training, frequent_grams=1e-5)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    newest = max(shared.glob("scored-*"), key=lambda folder: folder.stat().st_mtime)
    groups = 2 * 1021 * docs.rdd.getNumPartitions()  # words and contexts
    assert spark.read.parquet(str(newest)).count() <= docs.count() + 2 * groups  # over a million pairs, in two blocks
    assert suffix_tree._dealt(marked, 6).count() <= groups < suffix_tree.count_all(marked, 6).count() / 10
    assert rows.count() == docs.count()


def test_scores_of_many_small_blocks(spark, odd, monkeypatch):
    def scores(docs):
        rows = suffix_tree.score_documents(docs, remainder("doc_id", 5) != 1, frequent_grams=1e-4).collect()
        return sorted(map(tuple, rows), key=repr)

    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd):
        whole = scores(docs)
        with monkeypatch.context() as small:
            for name, value in (("_POOL", 20_000), ("_MOST", 50_000), ("_PAIRS", 20_000), ("_FRAME", 100), ("_LISTS", 7)):
                small.setattr(suffix_tree, name, value)
            cut = scores(docs)
        assert [r[:5] for r in cut] == [r[:5] for r in whole]
        assert all(math.isclose(a, b, rel_tol=1e-9) for c, w in zip(cut, whole, strict=True) for a, b in zip(c[5:], w[5:], strict=True))


def test_languages(spark, odd, empty):
    docs = docs_of(spark)
    model = language.fit(docs, remainder("doc_id", 4) != 2, rows_per_language=100)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 4) == 2)
    assert rows.where("lang = lang_pred").count() >= 0.97 * rows.count()
    found = Counter((r.doc_id, r.lang_pred == "und") for r in language.predict(odd, model).collect())
    assert found == Counter((i, i in (3, 4, 5, 7)) for i, *_ in ODD)
    assert all(0 <= r.score <= 1 for r in language.predict(odd, model).collect())
    assert language.predict(empty, model).count() == 0
    nothing = language.predict(odd, language.fit(empty, F.lit(True))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd, rows_per_cell=2).collect()
    assert len(rows) == len(ODD)
    assert sorted(r.size for r in rows) == sorted(len(words_of(t)) for _, t, *_ in ODD)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert rows and sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd, rows_per_cell=2).collect()))
    assert mixing.mix(empty).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 300), (None, 50)], "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    level = {"a": 3, "b": 1, "c": 2, None: 3}
    target, stopped = {}, set()
    while True:  # as the rule is written
        left = 1.5 * 1360 - sum(2.0 * s for k, s in {"a": 10, "b": 1000, "c": 300, None: 50}.items() if k in stopped)
        weight = sum(w for k, w in level.items() if k not in stopped)
        target = {k: 2.0 * s if k in stopped else left * level[k] / weight for k, s in {"a": 10, "b": 1000, "c": 300, None: 50}.items()}
        above = {k for k, s in {"a": 10, "b": 1000, "c": 300, None: 50}.items() if target[k] > 2 * s}
        if not above:
            break
        stopped |= above
    assert all(math.isclose(found[k], target[k]) for k in target)


def test_toxicity(spark, odd, empty):
    docs = docs_of(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    rows = toxicity.predict(docs, model).join(labels, "doc_id").where(remainder("doc_id", 4) == 2)
    counted = {(r.toxic, r.predicted): r["count"] for r in rows.groupBy("toxic", "predicted").count().collect()}
    assert counted[1, 1] >= 0.9 * (counted[1, 1] + counted.get((1, 0), 0))
    assert counted.get((0, 1), 0) <= 0.02 * counted[0, 0]
    found = toxicity.predict(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in found if r.predicted} <= {8}
    assert toxicity.predict(empty, model).count() == 0
    clean = labels.where("toxic = 0")
    nothing = toxicity.fit(docs, clean, F.lit(True))
    assert {r.predicted for r in toxicity.predict(odd, nothing).collect()} == {0}
    small = docs.where("length(text) < 2000")
    odd_labels = labels.withColumn("toxic", F.when(F.col("doc_id") % 7 == 0, 2).when(F.col("doc_id") % 7 == 1, -1).otherwise(F.col("toxic")))
    known = labels.where("doc_id % 7 > 1")
    assert toxicity.predict(odd, toxicity.fit(small, odd_labels, F.lit(True))).collect() == toxicity.predict(
        odd, toxicity.fit(small, known, F.lit(True))).collect()


def test_the_label_model_corrects_given_labels():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.9, truth, ~truth) for _ in range(3)]
    copied = [rng.random(4000) < 0.5] * 4
    gold = np.where(rng.random(4000) < 0.85, truth, ~truth).astype(int)
    posterior = toxicity.label_model(np.column_stack(good + copied).astype(np.int8), gold, np.ones(4000))
    # Voters only vote for toxic or abstain; a useless one, given four times, does not mislead.
    assert ((posterior > 0.5) == truth).mean() > (gold == truth).mean() + 0.02


def test_a_mix_is_a_prefix_by_key_and_place(spark, folder):
    rows = [(7, "the same text", "a")] * 400 + [(None, f"nameless {i} " + "x " * (i % 5), "a") for i in range(100)]
    rows += [(i, "12 34 " * (i % 7) + "56", "b") for i in range(100, 900)] + [(i, "w " * (i % 9), None) for i in range(900, 1100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4).write.parquet(str(folder))
    docs = spark.read.parquet(str(folder))
    keyed = mixing.keyed(docs).select("number", "row.doc_id", "source", "size", "key").collect()
    for per_cell in (20_000, 30):
        mixed = mixing.mix(docs, rows_per_cell=per_cell).collect()
        target = {r.source: (r.target, r.source_size) for r in mixed}
        taken = Counter()
        for source, (wanted, size) in target.items():
            full, at = int(wanted // size), 0
            for r in sorted((r for r in keyed if r.source == source), key=lambda r: (r.key, r.number)):
                drawn = r.size > 0 and at + r.size / 2 <= wanted - full * size
                taken[r.doc_id, source, r.size, full + drawn] += 1
                at += r.size
        assert Counter((r.doc_id, r.source, r.size, r.epochs) for r in mixed) == taken
    whole = mixing.taken_rows(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.epochs for r in mixed)
