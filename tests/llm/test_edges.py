"""Awkward tables for every operator and stage, and registered queries recomputed in plain Python."""

import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_ops import brute, fill, prose

import corpus_pipeline
from veilsight.llm import licenses, line_dedup, mixing, near_dedup, packing, queries, sharding, spotsigs, stages, tiff, toxicity, url_filter

here = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
CLASHING = ("toxic", "_key", "_gone", "_hash", "_s", "record", "score", "h1", "h2", "copy", "place", "drop", "sigs", "gone_id", "like", "u", "length_of")


def awkward(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("mine").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    made = [(i, prose(rnd, rnd.randint(1, 50)), rnd.choice(["a", "b", None])) for i in range(40)]
    made += [(None, None, None), (None, "", "a"), (None, made[3][1], "b"), (None, "a text of a null id\nwith a shared line here", None), (50, "one more\nwith a shared line here", "a")]
    made += [(60, "the river of stone and light " * 70_000, "b"), (61, "\n" * 2000, "a")]
    return made + [made[5]] * 3 + [(70, made[5][1], "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, rows):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_on_awkward_tables(spark, rows, folder):
    pytest.importorskip("public_tokenizers")
    df = awkward(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept, name
        if name != "packing":
            assert out.columns == df.columns and out.select(*CLASHING).distinct().collect() == [("mine",) * len(CLASHING)], name
        assert stage(spark, df.limit(0), folder).count() == 0, name


def test_operators_on_awkward_tables(spark, rows, folder):
    df, n = awkward(spark, rows), len(rows)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(df, toxicity.labelled_texts(df, labels))
    outs = {
        "toxicity": toxicity.score_texts(df, model),
        "spotsigs": spotsigs.neighbours(df),
        "licenses": licenses.scan_licenses(df),
        "urls": url_filter.judge(df.withColumn("url", F.col("text")), spark.createDataFrame(list(queries.URL_RULES), "rule string, verdict string")),
        "sharding": sharding.external_shuffle(df, 3),
        "near": near_dedup.near_components(df),
        "lines": line_dedup.drop_shared_lines(df),
        "tiff": tiff.tiff_pages(tiff.store_texts(df.drop("score"))),
        "mixing": mixing.mix(df),
    }
    for name, out in outs.items():
        assert len(out.drop("record", "pixels", "media", "text", "kept").collect()) == n, name


# ---- near duplicates


def test_near_stage_against_brute_force(spark, folder):
    from test_ops import near_rows

    made = [(i, t, "s") for i, t in near_rows(21, 12, 10)]
    made += [(500, made[4][1], "s"), (501, made[4][1] + "", "t"), (None, made[4][1], "s"), made[9]]
    want, _ = brute([r[:2] for r in made if r[0] is not None], 5)
    left = Counter((r["doc_id"], r["text"]) for r in stages.near_dedup(spark, awkward(spark, made), folder).select("doc_id", "text").collect())
    assert left == Counter((i, t) for i, t, _ in made if i is not None and want[i] == i)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity of exactly 0.80 at a threshold of 80, among sets that share nothing; all lie in small nodes."""
    rnd, made = random.Random(4), []
    for p in range(400):
        words = [f"w{p}x{j}" for j in range(91)]
        other = words[:81] + [f"v{p}x{j}" for j in range(10)]
        made += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    sets = lambda t: set(zip(t.split(), t.split()[1:], strict=False))
    a, b = sets(made[0][1]), sets(made[1][1])
    assert len(a & b) / len(a | b) == 0.8
    rnd.shuffle(made)
    got = near_dedup.near_components(spark.createDataFrame(made, "doc_id long, text string"), plan=near_dedup.Plan(share=80, words=2)).where("kept").count()
    assert got - 400 <= 2


def test_large_groups_about_the_threshold(spark):
    rnd = random.Random(8)
    base, made = [f"w{i}" for i in range(120)], []
    for i in range(1500):
        w = list(base)
        for _ in range(rnd.randint(4, 30)):
            w[rnd.randrange(120)] = f"e{rnd.random()}"
        made.append((i, " ".join(w)))
    plan = near_dedup.Plan(words=2, node=64, local_docs=300)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(spark.createDataFrame(made, "doc_id long, text string"), plan=plan).collect()}
    want, _ = brute(made, 2)
    assert sum(got[i] != want[i] for i in want) <= 3


# ---- sharding and mixing


def test_slots_are_the_same_in_every_run(spark, rows):
    df = awkward(spark, rows + [(80, "alike in all", "a")] * 300)
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("4", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            out = sharding.external_shuffle(df.repartition(int(partitions)), 3, bucket_bytes=2000)
            seen.append(Counter((r["doc_id"], r["h"], r["shard"], r["slot"]) for r in out.select("record.doc_id", F.xxhash64("record.text").alias("h"), "shard", "slot").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    (shard,) = {s for i, _, s, _ in seen[0] if i == 80}
    slots = sorted(n for i, _, s, n in seen[0] if i == 80)
    of = max(n for _, _, s, n in seen[0] if s == shard)
    assert len(slots) == 300 and len(set(slots)) == 300 and slots[0] < of / 4 and slots[-1] > of / 2


@here
def test_op6_against_plain_python(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in queries.op6_sharding(spark, SF).collect()}
    moved = {r["doc_id"]: (r["a"], r["b"]) for r in spark.createDataFrame([(d[0],) for d in docs], "doc_id long").select("doc_id", sharding.shard_of(F.col("doc_id"), 40).alias("a"), sharding.shard_of(F.col("doc_id"), 41).alias("b")).collect()}
    slots = defaultdict(list)
    for i, t in docs:
        r, raw = got[i], (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "key", *moved[i])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(docs)


def test_repeated_rows_are_mixed_one_by_one(spark):
    alike = [(1, "a b c d e f g h", "a")] * 1000
    out = mixing.mix(awkward(spark, alike), share=0.75)
    assert out.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 6000
    same_key = [(1, f"a b c d e f g {i}", "a") for i in range(1000)]
    out = mixing.mix(awkward(spark, same_key), share=0.75)
    assert out.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 6000


def test_mixing_favours_longer_documents_up_to_the_cap(spark):
    rnd = random.Random(2)
    made = [(i, " ".join(["w"] * rnd.choice([20, 100, 600])), "a") for i in range(3000)]
    for share in (0.5, 1.9, 2.0):
        out = mixing.mix(awkward(spark, made), share=share).groupBy("size").agg(F.avg("copies").alias("c"), F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("copies").alias("m"))
        by = {r["size"]: r for r in out.collect()}
        total = sum(len(t.split()) for _, t, _ in made)
        assert abs(sum(r["t"] for r in by.values()) - share * total) <= 600 and max(r["m"] for r in by.values()) <= 2
        if share == 0.5:
            assert 1.3 < by[100]["c"] / by[20]["c"] < 1.7 and 1.8 < by[600]["c"] / by[20]["c"] < 2.2


def test_mixing_stage_meets_its_targets(spark, folder, rows):
    kept = stages.mixing(spark, awkward(spark, rows), folder).select("text", "source").collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        largest[s] = max(largest[s], len((t or "").split()))
    for r in kept:
        taken[r["source"]] += len((r["text"] or "").split())
    want = fill(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)


# ---- lines


def test_line_stage_against_brute_force(spark, folder, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  (ASCII only here)
    found = defaultdict(set)
    order = lambda i: math.inf if i is None else i
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            found[key(x)].add(order(i))
    want = Counter()
    for i, t, _ in rows:
        keep = [x for x in (t or "").split("\n") if not (len(key(x)) >= 10 and len(found[key(x)]) > 1 and min(found[key(x)]) != order(i))]
        want[i, t if t is None else "\n".join(keep)] += 1
    assert Counter((r[0], r[1]) for r in stages.line_dedup(spark, awkward(spark, rows), folder).select("doc_id", "text").collect()) == want


def test_long_text_of_shared_lines_takes_time_in_proportion(spark):
    text = "\n".join(f"line number {i} of the text" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nown line of two"), (3, "")], "doc_id long, text string")
    got = {r["record"]["doc_id"]: (r["n_dropped"], r["kept"]) for r in line_dedup.drop_shared_lines(df).collect()}
    assert got[1] == (0, text) and got[2] == (60_000, "own line of two")


# ---- licences


def naive_places(index, words):
    """All starts, one by one."""
    found = set()
    for t, x in enumerate(index.templates):
        n = len(x.words)
        if x.base:
            found |= {(x.label, True, s, s + n, 1.0) for s in range(len(words)) if tuple(words[s : s + n]) == x.words}
            continue
        rare = {w for w, where in index.postings.items() if any(u == t for u, _ in where)}
        last = None
        for s in range(-n, len(words)):
            hits = {i - s: {w} for i, w in enumerate(words) if w in rare for u, p in index.postings[w] if u == t and i - p == s}
            if not hits or last is not None and s - last <= index.slack:
                continue
            near = {w for i, w in enumerate(words) if w in rare for u, p in index.postings[w] if u == t and 0 <= i - p - s <= index.slack}
            part = words[max(0, s - index.slack) : max(0, s) + n + 2 * index.slack]
            if len(near) >= index.needed[t] and all(" ".join(p) in f" {' '.join(part)} " and any(part[i : i + len(p)] == list(p) for i in range(len(part))) for p in x.phrases):
                last = s
                found.add((x.label, False, max(0, s), min(len(words), s + n), round(sum((Counter(part) & Counter(x.words)).values()) / n, 6)))
    return sorted(found, key=lambda f: (f[2], f[3], f[0], f[1]))


def test_scan_equals_the_naive_scan():
    rnd = random.Random(5)
    known = licenses.templates()
    vocabulary = sorted({w for t in known for w in t.words})
    index = licenses.Index(known, {w: rnd.random() for w in vocabulary})
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choices(vocabulary, k=rnd.randint(0, 12)) + list(rnd.choice(known).words)
            if words and rnd.random() < 0.4:
                words.insert(rnd.randrange(len(words)), "x")
            if words and rnd.random() < 0.3:
                del words[rnd.randrange(len(words))]
        assert index.scan(words) == naive_places(index, words)


def test_scan_takes_time_in_proportion():
    index = licenses.Index(licenses.templates(), {})
    spent = []
    for n in (2000, 16000):
        words = "software is provided as is without any x y z q r".split() * n
        start = time.process_time()
        index.scan(words)
        spent.append(time.process_time() - start)
    assert spent[1] < 16 * spent[0] + 0.5


@here
def test_op3_against_the_naive_scan(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    index = licenses.build_index(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op3_licenses(spark, SF).collect()}
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = naive_places(index, words) if len(words) < 2000 else index.scan(words)
        base, r = [p for p in places if p[1]], got[i]
        starts = [p[2] for p in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({p[0] for p in base})) and r["labels"] == ",".join(sorted({p[0] for p in places}))
        assert r["score"] == max((p[4] for p in places), default=0.0)


# ---- urls


def test_rules_without_a_verdict_count_the_same_in_both_ways(spark):
    urls = spark.createDataFrame([("http://example.com/en/1",), ("http://b.net/de/",), (None,)], "url string")
    rules = spark.createDataFrame([("com/en/", None), ("net/de/", "block"), ("com/", "perhaps"), (None, "block")], "rule string, verdict string")
    ways = [sorted(map(str, url_filter.judge(urls, rules, max_bytes=b).select("host", "rule", "verdict").collect())) for b in (16 << 20, 8)]
    assert ways[0] == ways[1] and "com/en/" not in str(ways[0]) and "net/de/" in str(ways[0])


# ---- packing


def test_ids_are_the_tokenizers_own():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    at = P.path("word_bpe_49k.json")
    model, ids = Tokenizer.from_file(at), packing.Ids(at)
    for t in ("a<|startoftext|>b", "<|endoftext|>", "x <|endoftext|> y <|startoftext|>", "<|END|> it's 10 Übung", "<|EndOfText|>", ""):
        assert np.frombuffer(ids.of(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, t


@here
def test_op5_covers_every_id(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for i, t in docs.items():
        raw = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        cut = [raw[a : a + 8192] for a in range(0, len(raw), 8192)]
        got = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, 2048 * k, len(c) // 4, zlib.crc32(c)) for k, c in enumerate(cut)]
    for b in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(b)))
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048


# ---- TIFF


@here
def test_op9_against_plain_python(spark):
    import hashlib
    import struct

    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    kinds = defaultdict(set)
    for r in queries.op9_tiff(spark, SF).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = tiff.store(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        at = struct.unpack_from("<I", media, 4)[0]
        tags = {t: v for t, _, _, v in struct.iter_unpack("<HHII", media[at + 2 : at + 2 + 12 * struct.unpack_from("<H", media, at)[0]])}
        seen = np.frombuffer(payload, np.uint8)
        shape, mean, spread = re.fullmatch(r"(.*) m(.*) s(.*)", r["feature"]).groups()
        assert shape == f"64x{len(payload) // 64} c{tags[259]} p{tags[317]}" and abs(float(mean) - seen.mean()) < 1e-4 and abs(float(spread) - seen.std()) < 1e-4
        kinds[len(payload) > 4096].add(tags[259])
    assert kinds[True] == kinds[False] == {tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE}


# ---- toxicity


def test_restoring_finds_the_likeliest_of_all_readings():
    words = "idiot stupid moron loser the and of river stone need"
    model = toxicity.CharModel(np.bincount(toxicity.count_trigrams(" ".join([words] * 40)), minlength=toxicity.SYMBOLS**3))

    def price(reading):
        a = b = toxicity.BOUNDARY
        total, text = 0.0, ""
        for piece, cost in reading:
            total += cost
            if not piece or piece == " " and b == toxicity.BOUNDARY:
                continue
            c = toxicity.BOUNDARY if piece == " " else toxicity.symbol(piece)
            total += model(a, b, c)
            a, b, text = b, c, text + piece
        return total + (model(a, b, toxicity.BOUNDARY) if b else 0.0), text.strip()

    rnd = random.Random(7)
    for _ in range(150):
        seen = "".join(rnd.choice("idotsumrnle10!$@35*.- +4oo") for _ in range(rnd.randint(1, 7)))
        best = max(price(r)[0] for r in itertools.product(*toxicity.lattice(seen)))
        mine = toxicity.restore(seen, model)
        assert any(abs(p - best) < 1e-6 and t == mine for p, t in map(price, itertools.product(*toxicity.lattice(seen)))), seen


@here
def test_op1_rows(spark):
    docs = duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()
    got = queries.op1_toxicity(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


# ---- spot signatures


def test_texts_without_anchors_change_their_fingerprint(spark):
    text = " ".join(f"слово{i}" for i in range(200))
    a, b = spark.createDataFrame([(text,), (text[:1000] + " конец других слов" * 30,)], "t string").select(spotsigs.signatures(F.col("t")).alias("s")).collect()
    assert len(a["s"]) > 10 and a["s"] != b["s"]


def test_words_in_use_stay_remembered(monkeypatch):
    import public_tokenizers

    from veilsight.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 20)
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    encoded, whole = [], ids.whole
    ids.whole = lambda t: encoded.extend(t.split()) or whole(t)
    texts = [f"always here {' '.join(f'{a}{b}' for b in 'abcdefgh')} don't" for a in "klmnopqrst"]
    got = [ids.of(t) for t in texts]
    assert encoded.count("always") == encoded.count("here") == 1
    assert got == [whole(t) for t in texts]


def test_a_stage_drops_what_others_remember(monkeypatch):
    from veilsight.llm import common, packing, toxicity

    monkeypatch.setitem(packing._IDS, "some", "words")
    toxicity.disguised("letter")
    common.give_back("packing")
    assert "some" in packing._IDS and toxicity.disguised.cache_info().currsize == 0
    common.give_back("toxicity")
    assert not packing._IDS


def test_a_task_returns_what_it_leaves_when_it_ends(monkeypatch):
    from veilsight.llm import common, near_dedup

    told = []
    monkeypatch.setattr(common, "trim", lambda: told.append("end"))
    task = common.returning(first=False)(lambda batches: (told.append(b) or b for b in batches))
    assert list(task(iter([1, 2]))) == [1, 2] and told == [1, 2, "end"]
    list(near_dedup._link_components(80)(iter([])))
    assert told == [1, 2, "end", "end"]


def test_urls_with_cut_characters_keep_their_hosts(spark):
    raw = [b"http\xc3://example.com/en/7", b"http\xf0://a.com/en/9", b"\xe2\x82://\xffb.example.net/de/8\xf0?\xc3#", b"http://c.org\xc3/es/", b"http://\xf0.org/es/\xc3", b"\xf0\x9f\x98"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "page_id long, raw binary").select("page_id", F.col("raw").cast("string").alias("url"))
    rules = spark.createDataFrame(list(queries.URL_RULES), "rule string, verdict string")
    for most in (16 << 20, 8):
        got = url_filter.judge(df, rules, max_bytes=most).orderBy("record.page_id").select("rule", "verdict").collect()
        want = [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"), (None, "allow")]
        assert [tuple(r) for r in got] == want


def test_known_chunks_and_new_words_cost_no_encoding_of_texts(monkeypatch):
    import random

    import public_tokenizers

    from veilsight.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, rnd = packing.Ids(path), random.Random(7)
    model = ids.model
    text = "Überall stand: don't read, it's naïve... 12³ œuvres, d'accord!"
    want = np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ids.of("' 't 's , ! : ... 1 2 ³")
    monkeypatch.setattr(ids, "model", None)  # words are merged one by one
    assert ids.of(text) == want
    monkeypatch.setattr(ids, "PARTS", None)  # and chunks cut into words once
    assert ids.of(text.upper()) == ids.of(text) == want
    ids = packing.Ids(path)
    signs = "abcdestvmlrABSZ''''.,;-!?0123 \n\t²¼ªµßàéÿĀįĲſÖÜ×¬\x1c\x85\xa0\x00\x7fİ’ŉк中"
    for _ in range(3000):
        t = "".join(rnd.choice(signs[: rnd.choice([30, 99])]) for _ in range(rnd.randint(0, 30)))
        assert np.frombuffer(ids.of(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)
