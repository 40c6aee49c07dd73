"""Fill-in-middle, the filtering Lloyd quantiser and the n-gram join against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import brute, near_rows, prose

from veilsight.llm import filtering_lloyd, fim, near_dedup, ngram_join

CLASHING = ("digest", "record", "n", "form", "cut", "output", "row", "part", "h1", "key", "cid", "vector", "code", "error")


def clash(df):
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING if c not in df.columns])


# ---- fill in middle


def test_elias_fano_lists():
    rnd = random.Random(1)
    for _ in range(1500):
        t = "".join(rnd.choice("abZ é9\n<日𝄞") for _ in range(rnd.randint(0, 60)))
        want = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)]
        assert fim.boundaries(t).tolist() == want
        listed = fim.encode(np.array(want, np.int64))
        assert [fim.select(listed, i) for i in range(len(want) + 1)] == [0, *want]
    far = np.cumsum(np.random.default_rng(0).integers(1, 5000, 2000))
    listed = fim.encode(far)
    assert [fim.select(listed, i + 1) for i in range(2000)] == far.tolist() and len(listed) < 2000 * (2 + math.log2(far[-1] / 2000)) / 8 + 32


def plain_cut(i, t):
    t = t or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, t
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    return (len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("copies", [1000, 3])
def test_fill_in_middle(spark, copies):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randint(0, 20)) + rnd.choice(["", "<P", "<M>", "é\n日", "<", ">"])) for i in range(120)]
    rows += [(i, "one text that many have\n") for i in range(200, 240)] + [(None, "of no id"), (None, None), (300, None), (301, ""), (302, "x" * 100_000 + " 日" * 20_000)] + rows[:3] * 2
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = fim.fill_in_middle(df, copies=copies)
    assert got.select("record.*").columns == [c for c in df.columns if c != "text"]
    found = [(r["record"]["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]), r["restored"]) for r in got.collect()]
    assert Counter(found) == Counter((i, plain_cut(i, t), t or "") for i, t in rows)
    assert {f[1][1] for f in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_a_text_of_many_copies_is_dealt_to_several_tasks(spark):
    keys = spark.range(50).select(F.struct("id").alias("record"), F.lit("a").alias("digest"))
    met = fim._meet(near_dedup.checkpoint(keys), spark.createDataFrame([("a", "t")] * 3, "digest string, text string"), 10)
    assert met.count() == 50 and "part" in met._jdf.queryExecution().optimizedPlan().toString()


# ---- quantiser


def plain_quantise(rows, parts, entries, rounds):
    """rows: key, vector of whole numbers.  Codes and errors by row, and the codebooks."""
    start = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    cut = np.cumsum([len(x) for x in np.array_split(np.arange(len(rows[0][1])), parts)])[:-1]
    books = [np.array([np.split(np.array(v), cut)[p] for _, v in start]) for p in range(parts)]
    x = [np.array([np.split(np.array(v), cut)[p] for _, v in rows]) for p in range(parts)]
    far = lambda p: ((x[p][:, None] - books[p][None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            own = np.argmin(far(p), axis=1)
            books[p] = np.array([x[p][own == e].sum(axis=0) // max(1, (own == e).sum()) if (own == e).any() else books[p][e] for e in range(len(books[p]))])
    codes = [np.argmin(far(p), axis=1) for p in range(parts)]
    return ["".join(f"{codes[p][i]:02x}" for p in range(parts)) for i in range(len(rows))], sum(far(p).min(axis=1) for p in range(parts)), ",".join(str(v) for b in books for v in b.ravel())


def test_the_filter_assigns_as_comparing_all():
    g = np.random.default_rng(3)
    for turn in range(80):
        n, d, k = int(g.integers(1, 900)), int(g.integers(1, 5)), int(g.integers(1, 65))
        x = g.integers(-6, 7, (n, d)) if turn % 2 else g.normal(0, 40, (n, d)).astype(np.int64)
        z = np.concatenate([x[g.integers(0, n, k)], x[:1] * 0 + 5])
        tree = filtering_lloyd.build(x)
        code, sums, counts = filtering_lloyd.assign(tree, z, block=int(g.integers(1, 50)))
        own = np.empty(n, np.int64)
        own[tree.order] = code
        want = np.argmin(((x[:, None] - z[None]) ** 2).sum(2), axis=1)
        total = np.zeros_like(z)
        np.add.at(total, want, x)
        assert (own == want).all() and (sums == total).all() and (counts == np.bincount(want, minlength=len(z))).all()


@pytest.mark.parametrize(("width", "n"), [(32, 400), (18, 90), (16, 7)])
def test_quantise(spark, width, n):
    g, rnd = np.random.default_rng(width), random.Random(width)
    rows = [(i, (g.normal(0, 0.2, width).round(3) if rnd.random() < 0.6 else g.integers(-2, 3, width) / 128.0).tolist(), rnd.choice([1, 1, 2, None])) for i in range(n)]
    rows += [rows[2]] * 4 + [(None, rows[3][1], None), (5, rows[1][1], 2)] + [(n + i, rows[0][1], 1) for i in range(60)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, rows[0][1][:-1] + [None], 1), (1003, rows[0][1][:-1] + [float("nan")], 1), (-5, rows[0][1][:-1] + [float("inf")], 1), (1005, rows[0][1][:-1], None)]
    df = clash(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").repartition(4))
    out, model = filtering_lloyd.quantise(df)
    whole = [(i, [math.floor(256 * v) for v in x]) for i, x, _ in rows]
    codes, errors, books = plain_quantise(whole, 16, 64, 2)
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        by[label] += int(e)
    want = Counter((i, label, c, int(e), by[label]) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
    assert Counter((r["record"]["vec_id"], r["record"]["label"], r["code"], r["error"], r["group_error"]) for r in out.collect()) == want
    assert model.codebook_text() == books
    assert all(r["record"]["code"] == "mine" for r in out.limit(3).collect())


def test_quantise_nothing(spark):
    out, model = filtering_lloyd.quantise(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert model is None and out.count() == 0


def test_huge_components_are_held(spark):
    rows = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1)]
    out, _ = filtering_lloyd.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(r["code"] for r in out.collect()) == ["00" * 16, "01" * 16]


# ---- n-gram join


@pytest.mark.parametrize("options", [{}, {"hub": 2}, {"hub": 3, "orders": 1}, {"orders": 2, "hub": 5, "local_docs": 2}])
def test_ngram_components(spark, options):
    rows = near_rows(7, 12, 12)
    want, sizes = brute(rows, 4, 85)
    got = ngram_join.ngram_components(clash(spark.createDataFrame(rows, "doc_id long, text string")), plan=ngram_join.Orders(share=85, words=4, **options)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], want[i]) for i in want}


def threshold_rows(n_pairs, share, n=100):
    """Pairs of sets of n single words that overlap just enough or just not, and lone ones between."""
    rows, want = [], {}
    most = n * (100 - share) // (100 + share)  # words that may differ
    for p in range(n_pairs):
        differ = most + p % 2
        own = [f"w{p}x{j}" for j in range(n)]
        other = own[differ:] + [f"v{p}x{j}" for j in range(differ)]
        random.Random(p).shuffle(other)
        rows += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(other))]
        want[2 * p], want[2 * p + 1] = 2 * p, 2 * p + (p % 2)
    return rows, want


def test_no_pair_at_the_threshold_is_lost(spark):
    rows, want = threshold_rows(600, 85)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), plan=ngram_join.Orders(share=85, words=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_large_groups_of_near_copies(spark):
    rnd, made = random.Random(8), []
    for b in range(2):
        base = [f"w{b}y{i}" for i in range(90)]
        for i in range(400):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(90)] = f"e{rnd.random()}"
            made.append((len(made), " ".join(w)))
    want, _ = brute(made, 4, 85)
    got = ngram_join.ngram_components(spark.createDataFrame(made, "doc_id long, text string"), plan=ngram_join.Orders(share=85, words=4, local_docs=100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.fixture
def uncoalesced(spark):
    """Partitions as they are on data too large to be put into one, for few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_components_meet_in_one_task_after_a_join_that_turns_into_a_broadcast(uncoalesced):
    spark = uncoalesced
    sets = [(c, 2 * c + i, np.arange(100 * c + 5 * i, 100 * c + 60 + 5 * i, dtype=np.uint64).tobytes()) for i in range(2) for c in range(40)]
    rows = near_dedup.checkpoint(spark.createDataFrame(spark.sparkContext.parallelize(sets, 8), "comp long, cid long, tokens binary"))  # of unknown size
    held = near_dedup.checkpoint(rows.groupBy("comp").agg(F.count("*").alias("docs")))
    small = rows.join(held.where("docs < 5").select("comp"), "comp")
    want = sorted((2 * c, 2 * c + 1) for c in range(40))
    assert sorted((min(r), max(r)) for r in near_dedup.link_whole(small, 80).collect()) == want
    giants = near_dedup._link_giants(rows, near_dedup.Plan(share=80))
    assert sorted((min(r), max(r)) for r in giants.collect()) == want


def test_documents_that_share_a_passage_alone_are_no_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(100)] + passage)) for i in range(40)]
    twin = rows[0][1].split()
    twin[5] = "other"
    rows.append((40, " ".join(twin)))
    rnd.shuffle(rows)
    kept, whole = [], ngram_join._intersect
    monkeypatch.setattr(ngram_join, "_intersect", lambda *a: kept.append(near_dedup.checkpoint(whole(*a))) or kept[-1])
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), plan=ngram_join.Orders(share=85, words=4))
    assert {r["doc_id"] for r in got.where("component_id <> doc_id").collect()} == {40}
    assert kept[0].count() == 1


def test_ngram_components_of_awkward_rows(spark):
    rnd = random.Random(2)
    text = prose(rnd, 60)
    near = text + " more"
    rows = [(None, text), (None, near), (None, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "ONE"), (7, "one two"), (8, near), (8, near), (9, "the river " * 30_000), (10, "the river " * 29_000)]
    got = Counter(tuple(r) for r in ngram_join.ngram_components(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    n = lambda t: len(set(zip(*[t.split()[i:] for i in range(5)], strict=False)))
    assert got == Counter({(None, n(text), 8): 1, (None, n(near), 8): 1, (None, 0, None): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 1, 5): 1, (6, 1, 5): 1, (7, 1, 7): 1, (8, n(near), 8): 2, (9, 2, 9): 1, (10, 2, 9): 1})
    assert ngram_join.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- components, and near duplicates of null keys


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_components_either_way(spark, most):
    rnd = random.Random(5)
    links = [(rnd.randint(-300, 300), rnd.randint(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    of = {x: x for e in links for x in e}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    got = {r["cid"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long"), most).collect()}
    assert got == {x: find(x) for x in of}


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_take_no_more_pairs_than_others(spark, key):
    """Candidates are looked up by key and text, so no join makes more rows than there are texts."""
    rnd, rows = random.Random(6), []
    for _ in range(150):
        w = [f"w{rnd.random()}" for _ in range(40)]
        rows += [(key, " ".join(w)), (key, " ".join([*w[:-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select(df["doc_id"].alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    looked_up = texts.alias("a").join(texts.alias("b"), F.expr("a.key <=> b.key AND a.text_hash = b.text_hash"))
    assert looked_up.count() == 300
    out = near_dedup.near_components(df)
    assert out.count() == 300 and out.where("NOT component_id <=> doc_id").count() == 0
