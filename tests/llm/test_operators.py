"""Percentiles, history, survivors, encoding and packing against brute force, with nulls, ties, repeats and empty tables."""

import random
import subprocess
import sys
import unicodedata
from math import ceil
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumatable.llm import history, packing, percentiles, survivors, tokens


ROOT = Path(__file__).resolve().parent.parent.parent


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# percentiles


def test_percentiles_of_combined_parts(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", None, "b"]), rng.choice([None, float("nan"), float("inf"), -1.0, 0.0, -0.0, 5.0, round(rng.lognormvariate(3, 2), 1)])) for _ in range(3_000)]
    df = spark.createDataFrame(data, "k string, v double").withColumn("part", F.lit(9)).withColumn("upto", F.lit("x"))
    days = [percentiles.value_counts(df.where(F.pmod(F.hash("v"), F.lit(3)) == i), ["k"], "v") for i in range(3)]
    whole = percentiles.combine(days[0].unionByName(days[1]).unionByName(days[2]), ["k"])
    got = {r.k: r.asDict() for r in percentiles.percentiles(whole, ["k"], ranges=8).collect()}
    for k in ("a", "b", None):
        v = sorted(abs(x) for key, x in data if key == k and x is not None and 0 <= x < float("inf"))
        assert got[k]["n_values"] == len(v)
        for p in percentiles.PERCENTS:
            assert got[k][f"p{p:02d}"] == v[ceil(p * len(v) / 100) - 1]


def test_percentiles_of_nothing_and_one(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert percentiles.percentiles(percentiles.value_counts(empty, ["k"], "v"), ["k"]).count() == 0
    one = percentiles.percentiles(percentiles.value_counts(spark.createDataFrame([("x", 2.5)], "k string, v double"), ["k"], "v"), ["k"]).first()
    assert (one.n_values, one.p01, one.p99) == (1, 2.5, 2.5)


# survivors


def test_survivors_field_by_field(spark):
    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "hot", "x", "y", None]), rng.choice([None, 1, 2]), rng.choice([1, 1, 2, None]), rng.choice([None, 1, 2, 3]), rng.choice([None, -1, 1])) for i in range(400)]
    data += data[:50] + [(None, "x", 9, 9, 9, 9)]
    df = spark.createDataFrame(data, "id bigint, g string, a bigint, b bigint, r int, f int").withColumn("__part", F.lit(1)).withColumn("n", F.lit(1))
    got = {r.g: (r.n_members, r.r, r.f) for r in survivors.survivors(df, "g", "id", [F.col("a"), F.col("b")], {"r": F.col("r"), "f": F.col("f")}, parts=4).collect()}
    low = lambda x: (x is not None, x or 0)
    for g in ("hot", "x", "y"):
        m = sorted({d for d in data if d[1] == g and d[0] is not None}, key=lambda d: (low(d[2]), low(d[3]), d[0]), reverse=True)
        first = lambda k: next((d[k] for d in m if d[k] is not None), None)  # noqa: B023, E731
        assert got[g] == (len(m), first(4), first(5))
    assert None not in got


def test_survivors_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, g string, a bigint, r int")
    assert survivors.survivors(df, "g", "id", [F.col("a")], {"r": F.col("r")}).count() == 0


# history


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("IMG_1.JPG", "img_1 (1).jpeg", True), ("IMG_1.JPG", "IMG_1_2.jpg", True), ("IMG_1.JPG", "IMG_1 - Copy.jpg", True), ("IMG_1.JPG", "IMG_1 - Kopie (3).jpg", True), ("IMG_1.JPG", "IMG_1 copy 2.jpg", True),
        ("IMG_1.JPG", "IMG_1 (copie).jpg", True), ("IMG_1.JPG", "IMG_1~3.jpg", True), ("a1.tiff", "A1.TIF", True), (unicodedata.normalize("NFD", "Übung 1.jpg"), "übung 1.JPG", True), ("a1-edit.jpg", "a1-edit_1.jpg", True),
        ("IMG_1.JPG", "IMG_1_edit.jpg", False), ("IMG_0001.jpg", "IMG_0002.jpg", False), ("IMG_1.jpg", "IMG_1.nef", False), ("IMG_1.JPG", "IMG_1 (1) (1).jpg", False), ("Übung 1.jpg", "Übung 2.jpg", False), ("copy.jpg", "x.jpg", False), ("_1.jpg", "_2.jpg", False),
    ],
)
def test_clean_names(a, b, same):
    assert (history.clean_name(a) == history.clean_name(b)) is same


def test_blank_names():
    assert history.clean_name(None) is history.clean_name("  ") is None and history.clean_name("noext") == "noext." and history.clean_name("x" * 100_000 + ".jpg")


def test_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    T0 = 1_400_000_000
    make = lambda i: (i, rng.choice([None, "", "AB", f"h{rng.randint(0, 150)}", f"H{rng.randint(0, 150)}"]), rng.choice([None, "hot1.jpg", "HOT1 (1).JPG", f"f{rng.randint(0, 30)}.jpg"]), rng.choice([None, 1_000, 1_005, 1_020, 5_000]), rng.choice([None, 0, T0 + rng.randint(0, 6), (T0 + rng.randint(0, 6)) * 1_000]))
    every = [make(i) for i in range(500)]
    schema = "id bigint, h string, name string, size bigint, t bigint"
    recs = lambda part: history.records(spark.createDataFrame(part, schema), "id", "h", F.col("name"), "size", "t")
    store = history.SortedRuns(spark, str(tmp_path / "runs"), file_rows=60)
    got = set()
    for a, b in ((0, 250), (250, 300), (300, 310), (310, 400), (400, 450), (450, 500)):
        part = recs(every[a:b] + every[a : a + 5]).distinct()
        store.merge(part)
        if a:
            got |= set(rows(store.check(part, window_rows=1_000_000 if a < 400 else 1)))
        store = history.SortedRuns.open(spark, str(tmp_path / "runs"), file_rows=60)
    sizes = {r: sum(f.n for f in files) for r, files in store.runs.items()}
    assert len(sizes) < 6 and all(len(files) > 1 for r, files in store.runs.items() if sizes[r] > 120)
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == sorted([*sizes, f"manifest-{store.version:08d}"])
    second = lambda t: None if not t else t // (1_000 if t > 10**12 else 1)
    want = set()
    for x in every[250:]:
        same = [
            y[0] for y in every[: x[0]]
            if (x[1] and y[1] and x[1].lower() == y[1].lower())
            or (None not in (second(x[4]), second(y[4]), x[3], y[3], x[2], y[2]) and abs(second(x[4]) - second(y[4])) <= 2 and 100 * abs(x[3] - y[3]) <= max(x[3], y[3]) and history.clean_name(x[2]) == history.clean_name(y[2]))
        ]
        if same:
            want.add((min(same), x[0]))
    assert got == want


def test_steps_of_any_size_find_the_same(spark, tmp_path):
    """Null batches, and ids that rise over interleaved batches or fall with them: each repeat names the smallest equal id."""
    T0 = 1_400_000_000
    cand = [(100 + i, (None, 3, 1, 2)[i % 4], f"c{i}.jpg", 1_000 + i, T0 + 60 * i, f"h{i % 7}") for i in range(30)] + [(130, 0, "i.jpg", 9, T0, "H0"), (131, None, "x.jpg", 1, T0, None), (None, 1, "c1.jpg", 1_001, T0 + 60, "h1")]
    spark.createDataFrame([(1, "h0", None, "i0.jpg", 5, T0 - 900)], "id bigint, hash string, original_filename string, filename string, size_bytes bigint, created_at bigint").write.parquet(f"{tmp_path}/images.parquet")
    spark.createDataFrame(cand, "candidate_id bigint, batch_id bigint, filename string, size_bytes bigint, created_at bigint, hash string").write.parquet(f"{tmp_path}/import_candidates.parquet")
    want = sorted([(100 + i % 7 if i % 7 else 1, 100 + i) for i in range(30) if i >= 7 or i == 0] + [(1, 130)])
    for step_rows in (8, 40_000):
        assert sorted(map(tuple, history.found(spark, str(tmp_path), step_rows).collect())) == want


def test_a_batch_costs_files_for_its_own_records(spark, tmp_path):
    """A history ten times as long makes a batch read no more rows, and merging rewrites a record a few times only."""
    T0, read = 1_400_000_000, []
    schema = "id bigint, h string, name string, size bigint, t bigint"
    recs = lambda part: history.records(spark.createDataFrame(part, schema), "id", "h", F.col("name"), "size", "t")
    for n in (4_000, 40_000):
        store = history.SortedRuns(spark, str(tmp_path / f"h{n}"), file_rows=500)
        store.merge(recs([(i, f"{i * 7_919 % 1_000_003:06d}", f"a{i}.jpg", 1_000 + i, T0 + 60 * i) for i in range(n)]))
        batch = recs([(n + k, f"{k * 3_000 * 7_919 % 1_000_003:06d}" if k < 2 else f"new{k}", f"a{k}.jpg", 1_000 + k, T0 + 60 * k) for k in range(5)])
        store.merge(batch)
        store.rows_read = 0
        assert rows(store.check(batch)) == [(0, n), (1, n + 1), (2, n + 2), (3, n + 3), (4, n + 4)] if n == 4_000 else True
        read.append(store.rows_read)
    assert read[1] <= 1.2 * read[0] < 4_000
    store = history.SortedRuns(spark, str(tmp_path / "many"), file_rows=50)
    for b in range(12):
        store.merge(recs([(b * 20 + k, f"x{b}-{k}", None, None, None) for k in range(20)]))
    assert len(store.runs) <= history.MOST_RUNS and store.rows_written <= 3 * 12 * 20


TWO_APPLICATIONS = """
import sys
from pyspark.sql import SparkSession, functions as F
from lumatable.llm.history import SortedRuns, records
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.host", "127.0.0.1").getOrCreate()
folder, first, last = sys.argv[1], int(sys.argv[2]), int(sys.argv[3])
rows = [(i, f"h{i % 6}") for i in range(first, last)]
batch = records(spark.createDataFrame(rows, "id bigint, h string").withColumns({"name": F.lit(None).cast("string"), "size": F.lit(1), "t": F.lit(None).cast("bigint")}), "id", "h", F.col("name"), "size", "t")
store = SortedRuns.open(spark, folder) if first else SortedRuns(spark, folder)
store.merge(batch)
print("FOUND", sorted(map(tuple, store.check(batch).collect())))
"""


def test_a_second_application_continues_the_history(tmp_path):
    run = lambda a, b: subprocess.run([sys.executable, "-c", TWO_APPLICATIONS, str(tmp_path / "kept"), str(a), str(b)], cwd=ROOT, check=True, capture_output=True, text=True, timeout=300).stdout
    assert "FOUND []" in run(0, 5)
    assert "FOUND [(0, 6), (1, 7)]" in run(5, 8)


def test_steps():
    assert history.steps_of([(1, 5), (2, 5), (3, 9), (4, 1)], 10) == [(1, 2), (3, 4)] and history.steps_of([], 10) == []


# encoding

ENC = tokens._encoding(open(tokens.default_ranks(), "rb").read())
BITS = ["a", "b", "'", "re", "ll", " ", "  ", "\n", "\r\n", "\t", "1", "23", "!", "é", "日本", "語", " ", "’", "don't", "🏔️", "ไทย", "a" * 30, "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40), st.lists(st.integers(0, 200), max_size=10))
def test_any_cuts_are_repaired(bits, places):
    text = "".join(bits)
    ends = sorted({p for p in places if 0 < p < len(text)}) + [len(text)]
    chunks, sure, last = [], [], 0
    for p in ends:
        chunks.append(text[last:p])
        sure.append(p == len(text) or (text[p] in " \n\r\t" and text[p - 1] not in " \n\r\t"))
        last = p
    got = tokens.repair(chunks, [np.array(ENC.encode_ordinary(c)) for c in chunks], sure, lambda p: tuple(ENC.encode_ordinary(p)))
    assert list(map(int, got)) == ENC.encode_ordinary(text)


RARE = ["\u00a0", " \u00a0", "\u00a0 ", "\u3000", "\u2009", "\u2028", "\x85", "\x0b"]


def joined(text, cuts):
    """Ids of a text cut at (place, sure), repaired."""
    starts = [0, *(p for p, _ in cuts[:-1])]
    chunks = [text[a:b] for a, (b, _) in zip(starts, cuts, strict=True)]
    return list(map(int, tokens.repair(chunks, [np.array(ENC.encode_ordinary(c)) for c in chunks], [s for _, s in cuts], lambda p: tuple(ENC.encode_ordinary(p)))))


def test_cuts_beside_rare_white_space(monkeypatch):
    monkeypatch.setattr(tokens, "BORDER_EVERY", 1)
    for end in ("end", " ", ""):
        text = "abcdefghijklmnopqrst \u00a0 \u00a0 \u00a0 " + end
        assert joined(text, tokens.cuts(text)) == ENC.encode_ordinary(text)
    assert set(map(chr, tokens._WHITE)) == {chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and tokens._pattern().fullmatch(chr(i)) and chr(i).isspace() and not 0x1C <= i <= 0x1F}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS + RARE * 2), max_size=40), st.lists(st.integers(0, 200), max_size=10))
def test_any_cuts_beside_rare_white_space_are_repaired(bits, places):
    text = "".join(bits)
    sure = tokens._borders(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    ends = sorted({p for p in places if 0 < p < len(text)})
    assert joined(text, [*((p, bool(sure[p])) for p in ends), (len(text), True)]) == ENC.encode_ordinary(text)


def test_corpus_is_encoded_as_a_whole(spark):
    long = "The same long sentence about light comes again. " * 400
    texts = [None, "", " ", "hello world", long, "x" + long, "日本語" * 5_000, "a" * 20_000, "<|endoftext|>", "é" * 3, long]
    docs = spark.createDataFrame([(i, t, "doc") for i, t in enumerate(texts)] + [(3, "hello world", "doc")], "doc_id bigint, text string, h string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(docs).collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0
    assert dict(rows(tokens.count_tokens(docs))) == {i: len(v) for i, v in got.items()}


def test_equal_to_the_other_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.ids for r in tokens.encode_corpus(docs).collect()} == want


def test_equal_stretches_give_equal_chunks():
    rng = random.Random(2)
    body = " ".join(str(rng.random()) for _ in range(800))
    pieces = lambda t: {t[a:b] for a, b in zip([0] + [c for c, _ in tokens.cuts(t)], [c for c, _ in tokens.cuts(t)], strict=False)}
    a, b = pieces("One start. " + body), pieces("Quite another beginning of it. " + body)
    assert len(a & b) / len(a) > 0.9


# packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit(spark, rule):
    rng = random.Random(9)
    sizes = [(i, rng.choice([None, 0, 1, 7, 60, 300, 900, 2_048, 2_049, 9_000, rng.randint(1, 2_000)])) for i in range(3_000)]
    limits = packing.Limits(documents=40, attention=2_048.0**2 * 0.6, rule=rule) if rule == "dot" else packing.Limits(documents=40)
    sizes = [s for s in sizes if rule == "norm" or s[1] is None or s[1] ** 2 <= limits.attention or s[1] >= 2_048]
    sizes = [(i, None if rule == "dot" and n and n % 2_048 and (n % 2_048) ** 2 > limits.attention else n) for i, n in sizes]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), limits, group_items=500).toPandas()
    by_doc = got.groupby("doc_id").n_tokens.sum().to_dict()
    assert by_doc == {i: n for i, n in sizes if n is not None}
    used = got[got.container_id.notna()]
    bins = used.groupby("container_id").n_tokens
    assert bins.sum().max() <= 2_048 and bins.count().max() <= 40
    assert (got[got.n_tokens == 0].container_id.isna()).all() and used.groupby("doc_id").size().max() == 5
    if rule == "dot":
        free = used[used.n_tokens < 2_048]
        assert (free.n_tokens.astype(float) ** 2).groupby(free.container_id).sum().max() <= limits.attention
    for _, c in used.sort_values("first_token").groupby("container_id"):
        assert (c.first_token.to_numpy() == np.concatenate([[0], c.n_tokens.cumsum().to_numpy()[:-1]])).all()
    whole = got[(got.piece == 0) & got.doc_id.isin([i for i, n in sizes if n and n <= 2_048])]
    assert whole.doc_id.is_unique and len(whole) == sum(1 for _, n in sizes if n and n <= 2_048)


def test_each_constraint_closes_containers(spark):
    """Long items meet the attention capacity, tiny ones the documents, others the tokens; a too costly item is whole and alone."""
    rng = random.Random(5)
    sizes = [(i, rng.randint(1_500, 2_047)) for i in range(300)] + [(1_000 + i, rng.randint(1, 9)) for i in range(20_000)] + [(50_000 + i, rng.randint(200, 700)) for i in range(2_000)]
    limits = packing.Limits()
    packed = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), limits).toPandas()
    free = packed[packed.n_tokens < limits.tokens]
    cost = (free.n_tokens.astype(float) ** 2).groupby(free.container_id).sum()
    n = free.groupby("container_id").n_tokens.agg(["count", "sum"])
    assert set(cost[cost > limits.attention].index) == set(free[free.n_tokens.astype(float) ** 2 > limits.attention].container_id) and (n[cost > limits.attention]["count"] == 1).all()
    assert n["count"].max() == limits.documents and n["sum"].max() <= limits.tokens
    got = {r.constraint: r for r in packing.tightness(spark.createDataFrame(packed), limits).collect()}
    assert set(got) == {"tokens", "documents", "attention"} and got["tokens"].fill > 0.98


def test_packing_leaves_little_space(spark):
    rng = random.Random(3)
    sizes = [(i, rng.randint(1, 700)) for i in range(4_000)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), group_items=1_000)
    n = got.select("container_id").distinct().count()
    assert sum(s for _, s in sizes) / (n * 2_048) > 0.98
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0
