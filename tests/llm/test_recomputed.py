"""op1's scores and op6's buckets, orders and shards computed anew by plainer means."""

import math
import os
import random
import struct
from collections import defaultdict

import duckdb
import pytest
import xxhash
from conftest import SF

from veilsight.llm import queries, sharding, toxicity

here = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


# ---- toxicity


@pytest.fixture(scope="module")
def chars(spark):
    texts = ["the idiots of the river are stupid and very naïve", "été straße schön", "a hollow book of little letters, all too well", "buffoon moron dummy loser"] * 3
    return toxicity.character_model(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_letters_apart_are_read_as_by_the_whole_lattice(chars):
    rnd = random.Random(3)
    letters = "aabbcdeeefghiiklllmnoopprssttuuvy" + "éàöñßаеіо"
    told = 0
    for _ in range(6000):
        w = "".join(rnd.choice(letters) * rnd.choice([1, 1, 1, 1, 2]) for _ in range(rnd.randint(1, 12))).lower()
        found = toxicity.restore_apart(w, chars)
        if found is not None:
            told += 1
            assert found == toxicity.restore(w, chars), w
    assert told > 1000


def _viterbi(seen, model):
    """The likeliest path through the lattice, state by state."""
    states = {(0, 0): (0.0, "")}
    for choices in toxicity.lattice(seen):
        reached = {}
        for (a, b), (score, out) in states.items():
            for text, cost in choices:
                if not text or (text == " " and b == 0):
                    key, s, to = (a, b), score + cost, out
                else:
                    c = 0 if text == " " else toxicity.symbol(text)
                    key, s, to = (b, c), score + cost + model(a, b, c), out + text
                if key not in reached or s > reached[key][0]:
                    reached[key] = (s, to)
        states = reached
    return max(((s + (model(a, b, 0) if b else 0.0), out) for (a, b), (s, out) in states.items()), key=lambda x: x[0])[1].strip()


def test_words_are_told_and_restored_once(chars, monkeypatch):
    rnd = random.Random(9)
    letters = "aabcdeeillmnoorrsstt" + "éàöïßаеі" + "013457@$!|+(#*._- /'"
    words = ["".join(rnd.choice(letters) * rnd.choice([1, 1, 1, 2]) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    for w in words:
        assert toxicity.restore(w, chars) == _viterbi(w, chars), w
    told, tell = [], toxicity.disguised
    monkeypatch.setattr(toxicity, "disguised", lambda w: told.append(w) or tell(w))
    read, texts = toxicity.Restorer(chars), [" ".join(rnd.choices(words, k=60)) for _ in range(40)]
    first = [read.words(t) for t in texts]
    assert len(told) == len(set(told)) > 100
    assert [read.words(t) for t in texts] == first == [toxicity.Restorer(chars).words(t) for t in texts]


def test_memory_of_words_turns_over(chars, monkeypatch):
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("aabbeelloо   ") for _ in range(80)) for _ in range(60)]
    want = [toxicity.Restorer(chars).words(t) for t in texts]
    monkeypatch.setattr(toxicity.Restorer, "REMEMBERED", 30)
    read = toxicity.Restorer(chars)
    assert [read.words(t) for t in texts] == want
    assert len(read.met) < 100


@here
def test_scores_follow_from_the_model(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, toxicity.labelled_texts(docs, labels))
    got = {r["doc_id"]: (r["score"], r["n_restored"]) for r in toxicity.score_texts(docs, model).select("record.doc_id", "score", "n_restored").collect()}
    # every suspect by the whole lattice, and the sum of the model's terms
    monkeypatch.setattr(toxicity, "restore_apart", lambda word, model: None)
    read = toxicity.Restorer(model.chars)
    for r in docs.select("doc_id", "text").limit(60).collect():
        plain, restored = read.words(r["text"])
        found = defaultdict(int)
        for w in plain | restored:
            for stem in [w[:k] for k in range(3, min(7, len(w)) + 1)] + [w + "$"]:
                if stem in model.stems:
                    found[model.stems[stem]] += 1
        x = model.bias + sum(model.weights[i] * math.log(1 + n) for i, n in found.items())
        want = 1 / (1 + math.exp(-x)) if x > -30 else 0.0
        assert got[r["doc_id"]] == (pytest.approx(want, abs=1e-9), len(restored))


# ---- sharding


def hashed(*values):
    """Spark's xxhash64 of ints, longs (as a pair of their kind and value) and strings; nulls leave it as it is."""
    h = 42
    for v in values:
        raw = None if v is None else v.encode() if isinstance(v, str) else struct.pack("<i" if v[0] == "int" else "<q", v[1])
        h = h if raw is None else xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >= 1 << 63 else h


def shard(key, n, seed=17):
    return max([k for k in range(1, n) if hashed(("int", seed), ("int", k), None if key is None else ("long", key)) % (k + 1) == 0], default=0)


def fisher_yates(n, seed):
    """Places after an inside-out Fisher-Yates shuffle by a Mersenne twister, seeded by the words of a 64-bit number, the high one first."""
    twister, out = random.Random(seed << 32), []

    def below(m):
        while True:
            bits = twister.getrandbits(32) >> 1
            if m & -m == m:
                return m * bits >> 31
            if bits - bits % m + m - 1 < 1 << 31:
                return bits % m

    for i in range(n):
        j = below(i + 1)
        out.append(i)
        out[i], out[j] = out[j], i
    return out


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 4000])
@here
def test_op6_buckets_orders_and_shards(spark, bucket_bytes):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = duckdb.sql(f"select {', '.join(columns)} from '{SF}/documents.parquet'").fetchall()
    kinds = dict(spark.read.parquet(f"{SF}/documents.parquet").dtypes)
    value = lambda c, v: v if v is None or isinstance(v, str) else ("long" if kinds[c] == "bigint" else "int", v)
    sizes, placed = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[shard(r[0], 40)] += len((r[1] or "").encode()) + 16
    n_buckets = max(1, math.ceil(max(sizes.values()) / bucket_bytes))
    order = spark.read.parquet(f"{SF}/documents.parquet").columns
    for r in rows:
        named = dict(zip(columns, r, strict=True))
        h1, h2 = (hashed(("int", s), *[value(c, named[c]) for c in order]) for s in (18, 19))
        draw = hashed(("long", h1), ("long", h2), ("long", 1))
        own = shard(r[0], 40)
        placed[own * n_buckets + draw % n_buckets].append((draw, h1, h2, r[0]))
    want, start = {}, defaultdict(int)
    for place in sorted(placed):
        held = sorted(placed[place])
        dealt = fisher_yates(len(held), 17 + place)
        own = place // n_buckets
        for pos in range(len(held)):
            want[held[dealt[pos]][3]] = (own, start[own] + pos, shard(held[dealt[pos]][3], 41))
        start[own] += len(held)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = sharding.external_shuffle(docs, 40, bucket_bytes=bucket_bytes).select("record.doc_id", "shard", "slot", "grown_shard").collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in made} == want
    if bucket_bytes == 64 << 20:
        assert {r["doc_id"]: (r["shard"], r["slot"], r["grown_shard"]) for r in queries.op6_sharding(spark, SF).collect()} == want
