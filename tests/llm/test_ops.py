"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsight.llm import licenses, line_dedup, mixing, near_dedup, packing, sharding, spotsigs, tiff, toxicity, url_filter

WORDS = "the of and to in a river stone light garden winter copper violet meadow lantern harbor maple falcon ember quartz".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, rows, extra=True):
    """documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("size", F.lit("mine")).withColumn("shard", F.lit("mine")).withColumn("key", F.lit("mine")).withColumn("n", F.lit(-1)) if extra else df


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randint(1, 60)), f"s{i % 3}") for i in range(120)]
    rows += [(200, None, None), (201, "", "s0"), (202, "   \n\t ", "s1"), (203, "x" * 300_000, "s1"), (204, "word " * 40_000, None)]
    rows += [(300 + i, rows[7][1], "s2") for i in range(30)]
    rows += [(400, "Übung MACHT\nden Meister É", "s0"), (401, rows[9][1] + " tail", "s0")]
    return rows + [rows[5], rows[5]]


# ---- sharding


def test_sharding(spark, docs):
    got = [r.asDict(True) for r in sharding.external_shuffle(table(spark, docs), 5, bucket_bytes=2000).collect()]
    assert Counter(r["record"]["doc_id"] for r in got) == Counter(d[0] for d in docs)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
        assert r["size"] == len((r["record"]["text"] or "").encode()) + 16
        assert r["record"]["shard"] == "mine"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["record"]["doc_id"], r["shard"]) for r in got}) == len({d[0] for d in docs})
    assert sharding.external_shuffle(table(spark, docs[:0]), 5).count() == 0


def test_shards_are_even_and_grow_into_the_new_one(spark):
    n = spark.range(20000).select(sharding.shard_of(F.col("id"), 40).alias("a"), sharding.shard_of(F.col("id"), 41).alias("b"))
    sizes = [r["count"] for r in n.groupBy("a").count().collect()]
    assert len(sizes) == 40 and min(sizes) > 380 and max(sizes) < 620
    moved = n.where("a <> b")
    assert moved.where("b <> 40").count() == 0 and 380 < moved.count() < 620


# ---- mixing


def fill(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    """Targets by rounds of resharing."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        if not free:
            return stopped
        left = total - sum(stopped.values())
        give = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if give[s] > cap * sizes[s]]
        if not over:
            return {**stopped, **give}
        stopped |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs):
    got = [r.asDict(True) for r in mixing.mix(table(spark, docs)).collect()]
    assert len(got) == len(docs)
    sizes, taken = Counter(), Counter()
    for d in docs:
        sizes[d[2]] += len((d[1] or "").encode().split())
    want = fill(dict(sizes))
    largest = Counter()
    for r in got:
        s = r["record"]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["copies"] <= 2
        taken[s] += r["copies"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = [(r["record"]["doc_id"], r["copies"]) for r in mixing.mix(table(spark, docs)).collect()]
    assert Counter(again) == Counter((r["record"]["doc_id"], r["copies"]) for r in got)
    assert mixing.mix(table(spark, docs[:0])).count() == 0


def test_mixing_favours_weight(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 2).cast("string").alias("source"), F.when(F.col("id") % 4 < 2, 3.0).otherwise(1.0).alias("w"))
    mean = {r[0]: r[1] for r in mixing.mix(rows, share=0.5, weight_col="w").groupBy("record.w").agg(F.avg("copies")).collect()}
    assert 2.5 < mean[3.0] / mean[1.0] < 3.5


# ---- line dedup


def test_line_dedup(spark):
    rnd = random.Random(1)
    lines = ["short", "A line that repeats", "  a LINE that repeats\t", "Ünique Zeile nummer", "ÜNIQUE zeile nummer", "another shared line", ""]
    rows = [(i, "\n".join(rnd.choice([*lines, f"own line number {i} {rnd.random()}"]) for _ in range(rnd.randint(0, 8))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "x\n" * 5000 + "another shared line", "s"), rows[4]]
    up = {i: i + 32 for i in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(up)
    found = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            found[key(x)].add(i)
    want = []
    for i, t, _ in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not (len(key(x)) >= 10 and len(found[key(x)]) >= 2 and min(found[key(x)]) != i)]
        want.append((i, len(all_lines), len(all_lines) - len(keep), "\n".join(keep)))
    got = [(r["record"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_shared_lines(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    for others, gone in ((), 0), (((72, "x\nAnother shared line", "s"),), 1):
        three = line_dedup.drop_shared_lines(table(spark, [(70, "another shared line", "s"), (71, "another shared line", "s"), (71, "another shared line\n", "s"), *others]), min_docs=3)
        assert [r["n_dropped"] for r in three.orderBy("record.doc_id").collect()] == [0, gone, gone, gone][: 3 + len(others)]
    assert line_dedup.drop_shared_lines(table(spark, rows[:0])).count() == 0


# ---- near duplicates


def brute(rows, words, share=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            k = min(words, len(w))
            sets[i] = frozenset((k, *w[j : j + k]) for j in range(len(w) - k + 1))
    ids = sorted(sets)
    of = {i: i for i, _ in rows}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= share * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}, {i: len(sets.get(i, ())) for i, _ in rows}


def near_rows(seed=5, base=14, copies=12):
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(base):
        words = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(30, 90))]
        for _ in range(rnd.randint(1, copies)):
            w = list(words)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 9999)}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize("options", [{}, {"node": 3, "levels": 2}, {"node": 2, "levels": 1, "local_docs": 2}])
def test_near_dedup(spark, options):
    rows = near_rows()
    want, sizes = brute(rows, 2)
    got = near_dedup.near_components(table(spark, [(i, t, "s") for i, t in rows]), plan=near_dedup.Plan(words=2, **options)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.near_components(table(spark, []), plan=near_dedup.Plan(words=2)).count() == 0
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, "a b c d e f", "s")]
    got = near_dedup.near_components(table(spark, rows), plan=near_dedup.Plan(words=5)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", 1, False)]


def test_link_sets_is_exact():
    rnd = random.Random(2)
    for _ in range(30):
        core = rnd.sample(range(1000), 40)
        sets = [np.unique(np.array([x if rnd.random() > 0.12 else rnd.randint(1000, 1100) for x in core], np.uint64)) for _ in range(25)]
        joined, plain = near_dedup.link_sets(sets, 80), near_dedup.Union(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                    plain.join(i, j)
        assert [joined.find(i) for i in range(25)] == [plain.find(i) for i in range(25)]


# ---- spot signatures


def test_spotsigs(spark, docs):
    rows = docs
    got = {r["key"]: r for r in spotsigs.neighbours(table(spark, rows)).collect()}
    assert spotsigs.neighbours(table(spark, rows)).count() == len(rows)
    texts = {d[0]: d[1] or "" for d in rows}
    ids = sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        after = texts[ids[(i + 1) % len(ids)]]
        assert got[k]["next_head"] == after[: len(texts[k]) // 3]
        assert got[k]["sigs"] == spot(texts[k])
        assert got[k]["next_sigs"] == spot(after)
    assert spotsigs.neighbours(table(spark, [])).count() == 0


def spot(t):
    import regex

    common = {"", *spotsigs.ANCHORS}
    w = ["", *[x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).split(" ") if x]]
    if len(w) == 1:
        return []
    out = set()
    listed = any(x in common for x in w[1:])
    for i, x in enumerate(w):
        if x in common if listed else i == 0 or hashlib.md5(x.encode()).hexdigest()[0] in "08":
            chain = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in common][: spotsigs.CHAIN]
            out.add(hashlib.md5(" ".join([x, *chain]).encode()).hexdigest()[:8])
    return sorted(out)


def test_spotsigs_similar_against_all_pairs(spark):
    rows = near_rows(8, 10, 6)
    rows = [(i, None if t is None else " ".join(f"the {w}" if n % 2 else w for n, w in enumerate(t.split()))) for i, t in rows]
    pairs, members = spotsigs.similar(table(spark, [(i, t, "s") for i, t in rows]), 0.5)
    sigs = {i: tuple(spot(t or "")) for i, t in rows}
    first = {}
    for i, s in sorted(sigs.items()):
        if s:
            first.setdefault(s, i)
    want = {(a, b) for s, a in first.items() for u, b in first.items() if a < b and len(set(s) & set(u)) >= 0.5 * len(set(s) | set(u))}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    assert {(r["key"], r["class"]) for r in members.collect()} == {(i, first[s]) for i, s in sigs.items() if s}


# ---- licences


def test_licenses(spark, docs):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = docs + [(500, f"intro {notice} end", "s"), (501, "MIT License, mit-license MIT. Licensed", "s"), (502, "the Apache License and GNU General Public License and again general public license", "s"), (503, "Licensed under CC BY-NC 4.0.", "s"), (504, "permission is granted", "s"), (505, "mit license" + " x" * 50_000 + " mit license", "s")]
    got = {r["record"]["doc_id"]: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    import re

    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        want = sorted((n, label) for p, label in licenses.BASE_PHRASES.items() for n in range(len(w)) if w[n : n + len(p.split())] == p.split())
        assert got[i]["n_words"] == len(w)
        assert sorted((p["start"], p["label"]) for p in got[i]["places"] if p["base"]) == want, i
    labels = lambda i: {p["label"] for p in got[i]["places"]}
    assert labels(500) == {"mit"} and labels(503) == {"cc by nc"} and not labels(504) and labels(502) == {"apache", "gpl"}
    assert licenses.scan_licenses(table(spark, [])).count() == 0


# ---- urls


def test_url_filter(spark):
    rnd = random.Random(4)
    hosts = ["example.com", "a.example.com", "xexample.com", "b.net", "c.org", "com", "EXAMPLE.com"]
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['/en/7', '/en/', '/de/8', '', '/', '/en', '?/en/', '#x', '/en/7?q#f'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://", "http://com/en/" + "p" * 50_000]
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("a.example.com/", "block"), ("nohost", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("mine"))
    got = {r["record"]["page_id"]: r for r in url_filter.judge(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        import re

        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = host.lower()
        fits = [(len(r), len(r.split("/", 1)[0]), r, v) for r, v in rules if "/" in r and (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[2], best[3]), u
    by_join = url_filter.judge(df, spark.createDataFrame(rules, "rule string, verdict string"), max_bytes=8)
    assert {r["record"]["page_id"]: (r["rule"], r["verdict"]) for r in by_join.collect()} == {i: (r["rule"], r["verdict"]) for i, r in got.items()}
    assert url_filter.judge(df.limit(0), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.crc32(F.col("key").cast("binary")) % 10 == 0)
    c = url_filter.build_cascade(listed, keys)
    assert len(c.levels) > 1
    wrong = keys.where(c.contains(F.col("key")) != (F.crc32(F.col("key").cast("binary")) % 10 == 0))
    assert wrong.count() == 0
    assert url_filter.build_cascade(listed.limit(0), keys).levels == ()


# ---- packing


def test_packing(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = table(spark, docs).select("doc_id", "text", F.lit("mine").alias("length_of"))
    got = packing.pack(packing.tokenize(df, P.path("word_bpe_49k.json"), capacity=64, with_ids=True), capacity=64).collect()
    ids, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 64 * r["piece"]
        ids[r["doc_id"]][r["piece"]] = r["ids"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, _ in docs:
        want = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(ids[i][k] for k in sorted(ids[i])) == want
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack(packing.tokenize(df.limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_solver_covers_every_piece():
    rnd = random.Random(9)
    for _ in range(200):
        cap, counts = rnd.choice([1, 2, 7, 64, 100]), Counter()
        for _ in range(rnd.choice([0, 1, 5, 80])):
            counts[rnd.randint(1, cap)] += rnd.choice([1, 1, 30])
        places, n = packing.solve(dict(counts), cap)
        used, ranks = defaultdict(list), defaultdict(list)
        for p in places:
            ranks[p.length] += range(p.lo, p.hi)
            for k in range(p.hi - p.lo):
                used[p.bin + k // p.per_bin].append((p.offset + k % p.per_bin * p.length, p.length))
        assert all(sorted(ranks[x]) == list(range(c)) for x, c in counts.items()) and len(used) == n
        for b in used.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= cap


# ---- TIFF


def test_tiff_round_trip(spark, docs):
    pages = tiff.tiff_pages(tiff.store_texts(table(spark, docs).select("doc_id", "text", F.lit("mine").alias("page")))).collect()
    assert len(pages) == len(docs)
    for r, (_, t, _) in zip(sorted(pages, key=lambda r: r["doc_id"]), sorted(docs, key=lambda d: d[0]), strict=True):
        assert r["error"] is None and r["pixels"] == tiff.payload_of(t) and r["n_bytes"] == len((t or "").encode())


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_tiff_codecs(kind, predictor, tiled):
    rnd = random.Random(kind + predictor)
    for rows in (1, 3, 70, 200):
        data = bytes(rnd.choice(b"abcde   ") if rnd.random() < 0.9 else rnd.randrange(256) for _ in range(64 * rows))
        (page,) = tiff.read_pages(tiff.write_page(data, kind=kind, predictor=predictor, rows=32, tiled=tiled))
        assert page["pixels"] == data and page["height"] == rows


def test_broken_tiffs_are_rows_with_reasons(spark):
    good = tiff.store("hello")
    files = [None, b"", b"II*\0", b"II*\0\xff\xff\xff\xff", good[:-30], b"MM\0*" + b"\0" * 4, good]
    got = tiff.tiff_pages(spark.createDataFrame(list(enumerate(files)), "i int, media binary")).collect()
    errors = {r["i"]: r["error"] for r in got}
    assert errors[6] is None and all(errors[i] for i in (0, 1, 2, 3, 4))
    rnd = random.Random(1)
    for _ in range(300):  # never anything but pages or a reason
        bad = bytearray(good)
        for _ in range(rnd.randint(1, 6)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        list(tiff.read_pages(bytes(bad)))


# ---- toxicity


def test_restoring():
    text = " ".join(["idiot stupid moron loser worthless the and of river stone"] * 50)
    counts = np.bincount(toxicity.count_trigrams(text), minlength=toxicity.SYMBOLS**3)
    model = toxicity.CharModel(counts)
    for seen, word in {"1d10t": "idiot", "stuuupid": "stupid", "m0r0n!!": "moron", "l-o-s-e-r": "loser", "w o r t h l e s s": "worthless", "$tup1d": "stupid", "st*pid": "stupid", "lоsеr": "loser"}.items():
        assert word in toxicity.Restorer(model).words(f"of the {seen} river")[1] | {toxicity.restore(seen, model)}, seen
    assert toxicity.Restorer(model).words(None) == (set(), set())
    assert toxicity.Restorer(model).words("the river, stone.") == ({"the", "river", "stone"}, set())


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(6)
    hide = lambda w: rnd.choice([w, w, w.replace("i", "1").replace("o", "0"), " ".join(w), w[0] + w[1] * 4 + w[2:]])
    rows = []
    for i in range(1200):
        words = prose(rnd, rnd.randint(5, 40)).split()
        if i % 4 == 0:
            words.insert(rnd.randrange(len(words)), hide(rnd.choice(["idiot", "stupid", "moron"])) if i % 3 else rnd.choice(["idiot", "stupid", "moron"]))
        rows.append((i, " ".join(words), "s"))
    rows += [(2000, None, "s"), (2001, "", "s")]
    df = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200) if i % 3 == 0] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, toxicity.labelled_texts(df, labels))
    got = {r["record"]["doc_id"]: r["score"] for r in toxicity.score_texts(df, model).collect()}
    held = [i for i in range(1200) if i % 3]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[2000] == got[2001] < 0.5
    assert sum(got[i] >= 0.7 for i in held if i % 4) == 0
    assert sum(got[i] >= 0.7 for i in held if i % 4 == 0) >= 0.95 * sum(i % 4 == 0 for i in held)
    none = toxicity.fit(df, toxicity.labelled_texts(df, labels.limit(0)))
    assert none.score({"idiot"}) == 0.0
