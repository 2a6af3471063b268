"""Vector codes, periodic runs and fewest sequences against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import ODD, empty, odd  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkward.llm import genetic_packing, packing, periodic_runs, queries, vector_codes

DATA = "/root/testdata/sf0.001"

# Vector codes.


def codes_by_hand(vectors, parts, entries, rounds, scale):
    """Codebooks and per vector (codes, error), in Python's integers; ``vectors`` are in order."""
    width = -(-max(map(len, vectors), default=0) // parts)
    rows = [[math.floor(x) * scale if abs(x) > 1e18 else math.floor(x * scale) for x in v] for v in vectors]
    rows = [r + [0] * (width * parts - len(r)) for r in rows]
    cut = [[r[p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        members = defaultdict(list)
        for r in cut:
            for p in range(parts):
                members[p, near(r[p], books[p])[1]].append(r[p])
        for (p, i), own in members.items():
            books[p][i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(r[p], books[p]) for p in range(parts)] for r in cut]
    return books, [(tuple(i for _, i in f), sum(d for d, _ in f)) for f in found]


def test_coefficients_keep_distances_and_go_by_sequency():
    rows = np.random.default_rng(1).integers(-1000, 1000, (20, 13))
    coefficients = vector_codes.transform(rows)
    assert coefficients.shape == (20, 16)
    whole = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    assert (((coefficients[:, None] - coefficients[None]) ** 2).sum(axis=2) == 16 * whole).all()
    signs = vector_codes.transform(np.eye(16, dtype=np.int64)).T
    assert [int((np.diff(s) != 0).sum()) for s in signs] == list(range(16))


@pytest.mark.parametrize("size", [10, 10**15])
def test_nearest_is_exact_and_prefers_the_lower_index(size):
    drawn = np.random.default_rng(2)
    entries = drawn.integers(-size, size, (40, 5))
    entries[7] = entries[30] = entries[3]
    rows = np.concatenate([drawn.integers(-size, size, (60, 5)), entries])
    index, distance = vector_codes.nearest(rows, entries)
    for row, i, d in zip(rows.tolist(), index.tolist(), distance.tolist(), strict=True):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(entries.tolist()))


def test_codes_of_random_vectors(spark):
    drawn = np.random.default_rng(3)
    vectors = drawn.normal(size=(300, 16)).tolist()
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    vectors = [np.float32(v).astype(float).tolist() for v in vectors]
    books, found = codes_by_hand(vectors, 4, 32, 3, 1024)
    result = vector_codes.compress(table, entries=32, rounds=3).collect()
    assert {r.vec_id: (tuple(r.codes), r.error) for r in result} == dict(enumerate(found))
    sums = Counter()
    for i, (_, error) in enumerate(found):
        sums[i % 3 or None] += error
    assert all(r.label_error == sums[r.label] for r in result)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in result} == {hashlib.sha256(text.encode()).hexdigest()}


def test_codes_of_odd_vectors(spark):
    odd_vectors = [
        (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "x"),
        (1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "x"),
        (2, None, 1, "x"),
        (3, [1.0, None, 3.0], 2, "x"),
        (4, [1.0, float("nan")], 2, None),
        (5, [float("inf")], None, "x"),
        (None, [0.0, 0.0, 0.0, 0.0, -0.0001], None, "x"),
        (6, [], None, "x"),
        (7, [1e200, -1e300, 0.5], 2, "x"),
        (8, [-7.5, 0.25], 2, "x"),
    ]
    schema = "vec_id bigint, embedding array<double>, label int, codes string"
    table = spark.createDataFrame(odd_vectors, schema).repartition(3)
    kept = [r for r in odd_vectors if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    _, found = codes_by_hand([r[1] for r in kept], 4, 3, 2, 1024)
    result = vector_codes.compress(table, entries=3, rounds=2).collect()
    expected = Counter((r[0], c, min(e, 2**63 - 1)) for r, (c, e) in zip(kept, found, strict=True))
    assert Counter((r.vec_id, tuple(r.codes), r.error) for r in result) == expected
    assert vector_codes.compress(table.where("false")).count() == 0


def test_a_hot_label_is_not_joined_by_shuffle(spark):
    table = spark.range(600).select(
        F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(0.0)).alias("embedding"),
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).cast("int").alias("label"),
    )
    result = vector_codes.compress(table, entries=8, rounds=1, most_hot=10).collect()
    sums = Counter()
    for r in result:
        sums[r.label] += r.error
    assert len(result) == 600 and all(r.label_error == sums[r.label] for r in result)


def test_vectors_come_back_from_codes(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    books = vector_codes.fit(table)
    coded = vector_codes.encode(table, books, ("vec_id", "embedding"))
    far = vector_codes.decode(coded, books).select(
        F.aggregate(F.zip_with("embedding", "approximate", lambda a, b: F.pow(F.floor(a * 1024) / 1024 - b, F.lit(2))), F.lit(0.0), lambda s, x: s + x).alias("far"),
        (F.col("error") / 1024**2).alias("error"),
    )
    assert all(r.far == pytest.approx(r.error) for r in far.collect())


# Periodic runs.


def runs_by_hand(words, exponent, least):
    """All runs by trying every period at every place."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted((s, length, q) for s, length, q in found)


def collapsed_by_hand(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def repetitive(seed, n):
    """Words with runs inside runs, small alphabets and cut-off repetitions."""
    drawn = random.Random(seed)
    words = []
    while len(words) < n:
        unit = [drawn.choice("ab" if seed % 2 else "abcdef") for _ in range(drawn.randint(1, 9))]
        if drawn.random() < 0.3:
            unit = unit * drawn.randint(2, 5) + [drawn.choice("xyz")]
        words += unit * drawn.randint(1, 7) + unit[: drawn.randint(0, len(unit))]
    return words[:n]


@pytest.mark.parametrize("seed", range(40))
def test_catchers_find_all_runs(seed):
    words = repetitive(seed, random.Random(seed).randint(1, 300))
    numbers = np.array([ord(w) for w in words])
    whole, online, pieces = (periodic_runs.Catchers() for _ in range(3))
    whole.append(numbers)
    for number in numbers:
        online.append(np.array([number]))
    drawn, at = random.Random(seed), 0
    while at < len(numbers):
        step = drawn.randint(1, 60)
        pieces.append(numbers[at : at + step])
        at += step
    for exponent, least in ((2, 1), (4, 6)):
        expected = runs_by_hand(words, exponent, least)
        for catchers in (whole, online, pieces):
            assert [tuple(r) for r in catchers.runs(exponent, least).tolist()] == expected


def test_a_hash_that_errs_costs_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_spread", lambda x: (x % 2).astype(np.uint64))
    for seed in range(6):
        words = repetitive(seed, 120)
        numbers = np.array([ord(w) for w in words])
        catchers = periodic_runs.Catchers()
        catchers.append(numbers)
        expected = set(runs_by_hand(words, 4, 6))
        assert set(map(tuple, catchers.runs(4, 6).tolist())) >= expected


def test_a_long_run_and_a_long_period():
    unit = np.arange(5_000)
    words = np.concatenate([np.zeros(40_000, dtype=np.int64), np.tile(unit, 5), [9, 9]])
    catchers = periodic_runs.Catchers()
    catchers.append(words)
    assert catchers.runs(4, 6).tolist() == [[0, 40_001, 1], [40_000, 25_000, 5_000]]


def planted_by_hand(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_the_query_of_runs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    expected = {}
    for r in docs:
        words = planted_by_hand(r.doc_id, [w.decode() for w in (r.text or "").encode().split()])
        if len(words) > 1_500:
            continue
        runs = runs_by_hand(words, 4, 6)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        expected[r.doc_id] = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed_by_hand(words, runs)),
        )
    result = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(result) == len(docs) and sum(r[0] > 0 for r in result.values()) >= len(docs) // 20
    assert {k: result[k] for k in expected} == expected


def test_runs_of_odd_rows(odd, empty):
    result = periodic_runs.find_runs(odd).collect()
    assert len(result) == len(ODD)
    found = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in result}
    for doc_id, text, *_ in ODD:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = [(0, 3, 1)] * 0 + [(3, 60_000, 1)] if doc_id == 8 else runs_by_hand(words, 4, 6)
        assert (doc_id, len(words), tuple(runs), collapsed_by_hand(words, runs)) in found
    assert periodic_runs.find_runs(empty).count() == 0


def test_periods_are_planted_into_odd_rows(odd):
    planted = queries.with_planted_periods(odd).collect()
    expected = Counter()
    for doc_id, text, *_ in ODD:
        words = [w.decode() for w in (text or "").encode().split()]
        h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        expected[doc_id, text if h % 10 or not words else " ".join(planted_by_hand(doc_id, words))] += 1
    assert Counter((r.doc_id, r.text) for r in planted) == expected


# Fewest sequences.


def check_packing(rows, docs, capacity, crc=True):
    """Every id once, sequences gapless and within capacity, only long documents cut; the number of sequences."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = defaultdict(list)
    for doc_id, ids in docs:
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[doc_id].append((piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in wanted.items()}
    return len(sequences)


def ids_of(texts):
    plain = Tokenizer.from_file(packing.TOKENIZER)
    return [[*e.ids, 0] for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fewest_sequences_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids = ids_of([r.text for r in docs])
    table = spark.createDataFrame(docs)
    for per_slice in (20_000, 150):
        rows = genetic_packing.pack_fewest(table, pieces_per_slice=per_slice).collect()
        used = check_packing(rows, [(r.doc_id, i) for r, i in zip(docs, ids, strict=True)], 2048)
        assert used <= -(-sum(map(len, ids)) // 2048) * 1.005 + 1


def test_fewest_sequences_of_odd_rows(odd, empty):
    ids = ids_of([t for _, t, *_ in ODD])
    rows = genetic_packing.pack_fewest(odd, capacity=64, with_ids=True).collect()
    check_packing(rows, [(r[0], i) for r, i in zip(ODD, ids, strict=True)], 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert genetic_packing.pack_fewest(empty).count() == 0


def test_one_text_in_a_third_of_all_rows(spark):
    table = spark.range(900).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words").otherwise(F.repeat(F.lit("x y "), (F.col("id") % 50).cast("int"))).alias("text")
    )
    rows = genetic_packing.pack_fewest(table, capacity=256, pieces_per_slice=300).collect()
    docs = [(r.doc_id, r.text) for r in table.collect()]
    used = check_packing(rows, [(d, i) for (d, _), i in zip(docs, ids_of([t for _, t in docs]), strict=True)], 256)
    assert used <= -(-sum(r.length for r in rows) // 256) + 2


def test_no_packing_beats_the_bound_and_small_ones_reach_the_best():
    drawn = random.Random(4)

    def fewest(sizes, capacity):
        best, rooms = len(sizes), []

        def place(i):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(sizes):
                best = len(rooms)
                return
            for room in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
                rooms[room] -= sizes[i]
                place(i + 1)
                rooms[room] += sizes[i]
            rooms.append(capacity - sizes[i])
            place(i + 1)
            rooms.pop()

        sizes = sorted(sizes, reverse=True)
        place(0)
        return best

    reached = 0
    for _ in range(60):
        sizes = [drawn.randint(10, 60) for _ in range(drawn.randint(1, 11))]
        stock = [sizes.count(s) for s in range(101)]
        true = fewest(sizes, 100)
        assert genetic_packing.fewest_bins(stock, 100) <= true
        best = genetic_packing.evolve(stock, [], 100, random.Random(5), 30, 6)[0]
        assert sorted(s for b in best for s in b) == sorted(sizes) and all(sum(b) <= 100 for b in best)
        reached += len(best) == true
    assert reached >= 58


def test_crossing_keeps_all_pieces_and_beats_best_fit():
    drawn = random.Random(6)
    sizes = [s for _ in range(200) for s in (lambda a, b: (a, b, 1000 - a - b))(drawn.randint(260, 400), drawn.randint(260, 340))]
    stock = [sizes.count(s) for s in range(1001)]
    falling = sorted(sizes, reverse=True)
    plain = genetic_packing.best_fit([], falling, 1000)
    islands = [genetic_packing.evolve(stock, [], 1000, random.Random(i), 40, 6) for i in range(2)]
    for _ in range(4):  # elites go from each island to the other
        islands = [
            genetic_packing.evolve(stock, islands[i] + islands[1 - i], 1000, random.Random(10 + i), 40, 6) for i in range(2)
        ]
    best = islands[0][0]
    assert Counter(s for b in best for s in b) == Counter(sizes)
    assert len(best) < len(plain)
