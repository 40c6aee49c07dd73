"""Mechanisms that keep work in proportion: postings, automata, projections, grouped orders, keyed state, runs, heaps."""

import json
import random
import re
from collections import Counter
from itertools import combinations, groupby

import pytest
from conftest import SF
from pyspark.sql import functions as F

from veilsight.functions import stats, text
from veilsight.operators import cooccurrence, diagnostics, itemsets, phrases, ranking, tokens
from veilsight.plans import bindings, commands, registry
from veilsight.sources import runs
from veilsight.streaming import resume

# ---- phrases


def plain_tag(w):
    if w in text.DETERMINERS:
        return "D"
    if w in text.PREPOSITION_TAGS:
        return "I"
    if w in text.STOPWORDS:
        return "O"
    return "J" if len(w) > 4 and w.endswith(text.ADJECTIVE_ENDS) else "N"


def plain_lemma(w):
    if re.search("[^aeiou]ies$", w) and len(w) > 4:
        return w[:-3] + "y"
    if re.search("(ss|x|z|ch|sh)es$", w):
        return w[:-2]
    return w[:-1] if re.search("[^su]s$", w) and len(w) > 3 else w


def plain_matches(clause, vocabulary, grammar):
    words = re.findall("[a-z]+", clause.lower())
    tagged = "".join(f"{plain_tag(w)}:{w} " for w in words)
    nps = [re.sub("[DIJN]:", "", p).strip() for p in re.findall(text.GRAMMARS[grammar], tagged)]
    for w in dict.fromkeys(words):
        if w in vocabulary:
            has = [p for p in nps if w in p.split()]
            best = max(has, key=len) if has else w
            phrase = " ".join(plain_lemma(x) for x in best.split() if x not in text.DETERMINERS)
            if phrase:
                yield w, phrase


@pytest.mark.parametrize("grammar", ["base", "pp1", "chain"])
def test_phrases_are_the_longest_about_a_word(spark, grammar):
    rnd = random.Random(4)
    words = ["the", "a", "senior", "nurse", "nurses", "of", "hospital", "parties", "boxes", "classes", "dies", "useful", "musical", "and", "is", "Very", "bus", "éclair", "axes", "table", "tables", "in", "with", "x", "s"]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", ",", ".", "'s"]) for _ in range(rnd.randint(0, 14)))) for i in range(300)] + [(300, ""), (301, " , ")]
    vocabulary = ["nurse", "nurses", "of", "the", "useful", "table", "parties", "is", "clair", "dies", "absent"]
    got = phrases.matches(spark.createDataFrame(rows, "uuid long, clause string"), spark.createDataFrame([(w,) for w in vocabulary], "token string"), grammar)
    assert got.columns == ["token", "uuid", "clause", "phrase"]
    want = Counter((i, w, p) for i, c in rows for w, p in plain_matches(c, set(vocabulary), grammar))
    assert Counter((r["uuid"], r["token"], r["phrase"]) for r in got.collect()) == want


def test_a_tagger_may_be_given_to_phrases(spark):
    rows = spark.createDataFrame([(1, "Alice met Bob Stone")], "uuid long, clause string")
    tagger = text.PartnerMorphemes(lambda t: [(w, "NN" if w[0].isupper() else "VB") for w in t.split()])
    got = phrases.matches(rows, spark.createDataFrame([("stone",), ("met",)], "token string"), tagger=tagger).collect()
    assert {(r["token"], r["phrase"]) for r in got} == {("stone", "bob stone"), ("met", "met")}


def test_no_text_moves_for_phrases(spark):
    rows = spark.createDataFrame([(1, "the senior nurse")], "uuid long, clause string")
    plan = phrases.matches(rows, spark.createDataFrame([("nurse",)], "token string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and " Exchange " not in plan and "Python" not in plan and "Arrow" not in plan


def test_containment_of_many_tokens(spark):
    rnd = random.Random(9)
    letters = "abcdé "
    clauses = [(i, "".join(rnd.choice(letters + "ABÉ") for _ in range(rnd.randint(0, 60)))) for i in range(400)] + [(500, None)]
    vocabulary = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(3000)})
    found = phrases.substring_matches(spark.createDataFrame(clauses, "uuid long, clause string"), spark.createDataFrame([(t,) for t in vocabulary], "token string"))
    assert Counter(map(tuple, found.select("uuid", "token").collect())) == Counter((i, t) for i, c in clauses if c is not None for t in vocabulary if t in c.lower())
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


# ---- orders by group


@pytest.mark.parametrize("most", [200_000, 10])
def test_running_orders_by_group(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", most)
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "d"]), i, rnd.randint(1, 9)) for i in range(500)]
    got = ranking.running(spark.createDataFrame(rows, "g string, i long, v long"), [F.col("i").desc()], {"s": F.col("v")}, {"m": F.col("v")}, by=["g"])
    want, kept = set(), {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        kept.setdefault(g, []).append(v)
        want.add((g, i, v, sum(kept[g]), min(kept[g])))
    assert {(r["g"], r["i"], r["v"], r["s"], r["m"]) for r in got.collect()} == want


def plain_bh(p):
    order, best, q = sorted(range(len(p)), key=lambda i: -p[i]), 1.0, [0.0] * len(p)
    for rank, i in enumerate(order):
        n = sum(x <= p[i] for x in p)
        best = min(best, p[i] * len(p) / n)
        q[i] = best
    return q


@pytest.mark.parametrize("most", [200_000, 10])
def test_false_discovery_rates_by_group(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", most)
    rnd = random.Random(5)
    rows = [(f"u{i % 7}", i, round(rnd.random() ** 3, 2)) for i in range(300)]
    got = {r["i"]: r["q"] for r in ranking.bh(spark.createDataFrame(rows, "unit string, i long, p double"), "p", "q", by=["unit"]).collect()}
    for u in range(7):
        own = [r for r in rows if r[0] == f"u{u}"]
        for (_, i, _), q in zip(own, plain_bh([r[2] for r in own]), strict=True):
            assert got[i] == pytest.approx(q)


def test_pairs_of_whatever_units_there_are(spark):
    rnd = random.Random(1)
    rows = [(i % 40, "f", i, f"t{i % 3}", sorted({rnd.choice("abcdef") for _ in range(4)})) for i in range(200)]
    detail = spark.createDataFrame(rows, "uuid long, field string, clause_pos int, text string, matched_terms array<string>")
    both = cooccurrence.unit_sets(detail, ("clause", "text"))
    got = cooccurrence.significant_pairs(cooccurrence.pair_counts(both, 2), 0).collect()
    assert Counter(r["unit"] for r in got) == {"clause": 15, "text": 15}
    alone = cooccurrence.significant_pairs(cooccurrence.pair_counts(cooccurrence.unit_sets(detail, ("text",)), 2), 0).collect()
    assert {tuple(r) for r in got if r["unit"] == "text"} == {tuple(r) for r in alone}
    made = commands.export(detail, units=("text",), pair_q=0)
    assert made.pairs.count() == 15 and {r["unit"] for r in made.sets.select("unit").distinct().collect()} == {"text"}


def test_tails_of_pairs(spark):
    rows = [(0.0,), (3.841458820694124,), (100.0,)]
    got = [r["p"] for r in spark.createDataFrame(rows, "g double").select(stats.chi2_tail("g").alias("p")).collect()]
    assert got == [pytest.approx(1.0), pytest.approx(0.05), pytest.approx(1.5e-23, rel=0.1)]


# ---- itemsets


@pytest.mark.parametrize(("least", "size"), [(1, 0), (3, 0), (3, 2), (40, 0), (10_000, 0)])
def test_itemsets(spark, monkeypatch, least, size):
    if least == 3:
        monkeypatch.setattr(itemsets, "BROADCAST_COMBOS", 2)
    rnd = random.Random(2)
    sets = Counter(tuple(sorted({rnd.choice("abcdefgh") if rnd.random() < 0.9 else "z" for _ in range(rnd.randint(1, 6))})) for _ in range(60))
    want = Counter()
    for s, n in sets.items():
        for k in range(1, (size or len(s)) + 1):
            for c in combinations(s, k):
                want[c] += n
    df = spark.createDataFrame([(list(s), n) for s, n in sets.items()], "terms array<string>, cnt long")
    got = itemsets.frequent_itemsets(df, least, size)
    assert {tuple(r["combo"]): (r["size"], r["support_count"]) for r in got.collect()} == {c: (len(c), n) for c, n in want.items() if n >= least}


def test_a_term_in_every_set_makes_no_long_lists(spark):
    """The most frequent term has the shortest prefixes: 2,000 sets that share it give it one row."""
    df = spark.createDataFrame([(["all", f"t{i % 50}", f"s{i % 7}"], 1) for i in range(2000)], "terms array<string>, cnt long")
    got = {tuple(r["combo"]): r["support_count"] for r in itemsets.frequent_itemsets(df, 30).collect()}
    assert got[("all",)] == 2000 and got[("all", "s0")] == sum(i % 7 == 0 for i in range(2000))


# ---- runs of equal keys


@pytest.mark.parametrize("block", ["128m", "300b"])
def test_runs_in_file_order(spark, tmp_path, block):
    rnd = random.Random(6)
    keys = [k for k in (rnd.choice(["u1", "u2", "u3", None]) for _ in range(60)) for _ in range(rnd.randint(1, 9))]
    lines = [json.dumps({"uuid": k, "clause": f"c{i}"}) for i, k in enumerate(keys)]
    cuts = [0, 50, 51, 51, 120, len(lines)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"part-{n}.json").write_text("".join(x + "\n" for x in lines[a:b]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = spark.read.schema("uuid string, clause string").json(str(tmp_path))
        got = runs.runs_of(rows, "uuid").collect()
        grouped = runs.grouped_runs(rows, "uuid", ["clause"]).orderBy("run").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, at = {}, 0
    for n, (k, own) in enumerate(groupby(keys)):
        for _ in own:
            want[f"c{at}"] = (k, n)
            at += 1
    assert {r["clause"]: (r["uuid"], r["run"]) for r in got} == want and len(got) == len(keys)
    if block != "128m":
        assert len({(r["_file"], r["_block"]) for r in got}) > 20
    assert [x["clause"] for g in grouped for x in g["items"]] == [f"c{i}" for i in range(len(keys))]
    assert [g["uuid"] for g in grouped] == [k for k, _ in groupby(keys)]


def test_runs_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "uuid string").write.parquet(str(tmp_path / "none"))
    assert runs.runs_of(spark.read.parquet(str(tmp_path / "none")), "uuid").count() == 0


# ---- frequency grid


def test_frequency_grid_reads_phrases_once(spark):
    rnd = random.Random(7)
    rows = [(f"p{i}", rnd.randint(1, 60)) for i in range(2000)]
    df = spark.createDataFrame(rows, "phrase string, freq long").repartition(6)
    grid = (50, 30, 10, 100)
    table = diagnostics.frequency_grid(df, grid)
    for r in table.collect():
        over = sorted(sorted([x for x in rows if x[1] > r["k"]], reverse=True), key=lambda x: x[1])
        assert (r["dropped"], r["percent"]) == (len(over), pytest.approx(len(over) / 20))
        assert r["nearest"] == ", ".join(f"{p}({f})" for p, f in sorted(over[:6], key=lambda x: (x[1], x[0]), reverse=True))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


# ---- resumable labelling


def label_all(spark, tmp_path, name, progress=None, files=1):
    step = lambda df: df.withColumn("label", F.upper("clause"))
    resume.label_stream(spark, str(tmp_path / "src"), "id long, clause string", ["id"], step, str(tmp_path / "out"), str(tmp_path / name), files, progress).awaitTermination()


def write_rows(spark, tmp_path, ids):
    spark.createDataFrame([(i, f"c{i}") for i in ids], "id long, clause string").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))


def test_batches_label_what_none_before_has(spark, tmp_path):
    for ids in (range(10), range(5, 15), range(12, 20)):
        write_rows(spark, tmp_path, ids)
    progress = resume.Progress()
    label_all(spark, tmp_path, "ck", progress)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["id"], r["label"]) for r in out.collect()) == [(i, f"C{i}") for i in range(20)]
    assert out.select("batch").distinct().count() == 3
    # another start goes on where this one ended
    write_rows(spark, tmp_path, range(18, 22))
    label_all(spark, tmp_path, "ck", progress)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(22))
    # a run without that checkpoint takes what lies there as done
    write_rows(spark, tmp_path, [21, 22])
    label_all(spark, tmp_path, "other")
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(23))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(progress)
    rows = [(r["batch"], r["rows_read"], r["rows_fresh"], r["state_rows"]) for r in progress.table(spark).orderBy("batch").collect()]
    assert [r[0] for r in rows] == [0, 1, 2, 3] and sum(r[1] for r in rows) == 32 and sum(r[2] for r in rows) == 22
    assert rows[-1][3] == 22


def test_a_batch_does_not_read_what_others_wrote(spark, tmp_path):
    """Keys that are done are state; the folder of labelled rows is read by no batch of the run that writes it."""
    for n in range(3):
        write_rows(spark, tmp_path, range(n * 5, n * 5 + 5))
    assert resume.earlier(spark, str(tmp_path / "out"), "run") is None
    label_all(spark, tmp_path, "ck")
    assert resume.earlier(spark, str(tmp_path / "out"), resume.run_name(str(tmp_path / "ck"))) is None
    assert resume.earlier(spark, str(tmp_path / "out"), "another").count() == 15


# ---- clauses


def plain_clauses(t):
    norm = lambda x: re.sub(r"\s+", " ", re.sub(r"[\s,;:.\-]+$", "", re.sub(r"^[\s,;:.\-]+", "", x)))
    out = []
    for s in filter(None, map(norm, re.split(r"(?:\r?\n)+|[.!?;]+", t))):
        parts = [s]
        if len(s.split()) > 18:
            found = [x for x in map(norm, re.split(rf"(?i)\s*(?:,\s*)?(?:{text.CONJUNCTIONS})\s+", s)) if x]
            parts = found if len(found) > 1 else [s]
        out += parts
    seen, kept = set(), []
    for p in out:
        if p.casefold() not in seen:
            seen.add(p.casefold())
            kept.append(p)
    return kept


def test_clauses(spark):
    rnd = random.Random(12)
    words = ["and", "But", "band", "since", "I", "WHEN", "played", "the", "Straße", "STRASSE", "x", "of", "because", "a-b"]
    marks = [" ", " ", " ", " ", " ", ", ", ". ", " - ", "\n", "\r\n", "! ", "; ", " , ", ": ", "...", "\t", " -; "]
    texts = ["".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randint(0, 90))) for _ in range(400)] + ["", " ;.", "and and", "\n" * 30_000 + "x y" + " " * 30_000 + "z" + "-" * 30_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.rule_clauses(F.col("t")).alias("c")).collect()
    for r in got:
        assert r["c"] == plain_clauses(texts[r["i"]]), texts[r["i"]][:200]


def test_case_is_folded_as_in_full(spark):
    letters = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and not 0xFDD0 <= i < 0xFDF0 and chr(i).casefold() != chr(i)]
    rows = [(c, c.casefold()) for c in letters] + [("ı", "ı"), ("ΟΔΟΣ", "οδοσ"), ("οδος", "οδοσ"), ("ﬁ", "fi"), ("Straße", "strasse"), ("ẞ", "ss"), ("Iı", "iı")]
    df = spark.createDataFrame(rows, "c string, folded string")
    # two texts are equal when folded just where full folding says so
    bad = df.select("c", text.fold(F.col("c")).alias("a"), text.fold(F.col("folded")).alias("b")).where("a <> b").collect()
    assert not bad, bad
    assert spark.createDataFrame([("I", "ı")], "a string, b string").where(text.fold(F.col("a")) == text.fold(F.col("b"))).count() == 0


def test_clauses_are_folded_as_columns_are(spark):
    rnd = random.Random(8)
    letters = ["ß", "SS", "ﬁ", "FI", "İ", "i̇", "ı", "I", "Ω", "Ω", "ς", "σ", "K", "k", "Å", "å", "ẞ", "ϴ", "θ", "a", "A", "é", "É", "\x1c", "\x85"]
    rows = [(["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 3))) for _ in range(12)],) for _ in range(300)]
    got = spark.createDataFrame(rows, "w array<string>").select("w", text.rule_clauses(F.array_join("w", ".")).alias("c"), text.dedupe(F.col("w")).alias("d")).collect()
    assert [r["c"] for r in got] == [r["d"] for r in got]


def test_a_clause_is_split_in_one_pass(spark):
    plan = spark.range(1).select(text.RuleSplitter().split(F.lit("a b c")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_a_segment_is_made_a_phrase_once(spark):
    rows = spark.createDataFrame([(1, "the senior nurse the")], "uuid long, clause string")
    found = phrases.matches(rows, spark.createDataFrame([("nurse",), ("the",)], "token string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the patterns of segments and of phrases stand once in the plan
    assert plan.count("ies(?=") == 1 and plan.count("(?<![^ \x1f])[DIJNO]:") == 1
    assert sorted((r["token"], r["phrase"]) for r in found.collect()) == [("nurse", "senior nurse"), ("the", "senior nurse")]


# ---- orders and their lines


def test_orders_are_gathered_as_their_lines_are(spark, tmp_path):
    d = str(tmp_path)
    lines = [(o, p, f) for o in range(1, 40) for p, f in ((o % 7, "R"), (o % 5, "N"), (o % 5, "A"), (99, "R"), (None, "R"))] + [(None, 1, "A"), (777, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    # an order listed twice alike, one under two customers, one without customer, one without lines
    orders = [(o, o % 6, "12"[o % 2]) for o in range(1, 38)] + [(3, 3, "2"), (4, 5, "1"), (38, None, None), (None, 1, "1"), (500, 1, "1"), (777, 2, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    parts = [(p, None if p == 2 else f"b{p % 3}") for p in range(7)] + [(1, "b9")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{d}/part.parquet")
    rows = bindings.basket(spark, d).groupBy("uuid", "field", "clause_pos").agg(F.array_sort(F.collect_set("term")).alias("matched_terms"), F.max("label").alias("label"))
    assert sorted(map(repr, bindings.basket_orders(spark, d).collect())) == sorted(map(repr, rows.collect()))


@pytest.mark.parametrize("name", ["y_bits", "rebalance_caps", "training_spans", "samples_through_parquet", "risk_term_records", "target_dataset"])
def test_lines_are_read_once(spark, monkeypatch, name):
    read, own = Counter(), bindings.table
    monkeypatch.setattr(bindings, "table", lambda s, d, t: read.update([t]) or own(s, d, t))
    scans = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")
    assert read["lineitem"] == 1 and scans == 0


@pytest.mark.parametrize("name", ["token_contingency_odds", "token_fisher_p", "or_ci_threshold_scan", "morpheme_gtest", "dictionary_run"])
def test_clauses_are_split_once(spark, name):
    scans = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("documents.parquet")
    assert scans == 0  # what is left reads the counts that one pass over the clauses wrote


def test_default_tags_are_put_to_rows(spark):
    rows = spark.createDataFrame([("PROFILE", "A careful Walker of the hills, and the walkers' useful maps"), ("NONE", ""), ("PII", "name"), ("NONE", None)], "label string, clause string")
    made = tokens.clause_tokens(rows, text.morphemes)
    given = tokens.clause_tokens(rows, lambda c: text.morphemes(c))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, given.collect())) and made.count() > 3
    assert "lambdafunction" not in made._jdf.queryExecution().optimizedPlan().toString()
