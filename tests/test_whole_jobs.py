"""Queries do the whole job: nothing is bounded by a fixed count."""

import os
from collections import Counter
from itertools import combinations

import pytest
from conftest import SF, compare

from veilsight.plans import bindings, registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")

LARGER = "/root/testdata/sf0.01"


def test_spans_grow_with_the_orders(spark):
    orders = bindings.basket_detail(spark, LARGER).count()
    spans = registry.QUERIES["span_dedupe"](spark, LARGER).collect()
    assert orders > 5000 and sum(r["freq"] for r in spans) == orders and len(spans) > 0.7 * orders
    assert any(r["freq"] > 1 for r in spans) and sum(r["label"] == "NONE" for r in spans) > 100


def test_training_spans_keep_all_spans(spark):
    spans = {r["text"] for r in registry.QUERIES["span_dedupe"](spark, LARGER).select("text").collect()}
    made = [r["text"] for r in registry.QUERIES["training_spans"](spark, LARGER).select("text").collect()]
    assert len(made) == len(spans) and set(made) == spans


def test_bin_equal_sample_draws_from_all_spans(spark):
    names = {r["text"] for r in registry.QUERIES["bin_equal_sample"](spark, LARGER).select("text").collect()}
    assert any(int(n.split()[1]) >= 5000 for n in names if n.startswith("order "))


@pytest.mark.parametrize("name", ["y_combined", "md5_group_split", "lds_weights", "provenance_shares", "itemsets_apriori", "itemset_support_pct"])
def test_whole_query_equals_its_sql_on_more_rows(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name], LARGER)


def test_itemsets_of_every_size(spark):
    sets = bindings.basket_detail(spark, LARGER, "p_type").collect()
    whole = {}
    for r in sets:
        whole.setdefault((r["uuid"], r["field"]), set()).update(r["matched_terms"])
    n = Counter("|".join(c) for t in whole.values() for k in range(1, len(t) + 1) for c in combinations(sorted(t), k))
    want = {c: k for c, k in n.items() if k >= 5}
    got = {r["combo"]: (r["size"], r["support_count"]) for r in registry.QUERIES["itemsets_apriori"](spark, LARGER).collect()}
    assert got == {c: (c.count("|") + 1, k) for c, k in want.items()} and max(s for s, _ in got.values()) > 3
    shares = {r["combo"]: r["support_count"] for r in registry.QUERIES["itemset_support_pct"](spark, LARGER).collect()}
    assert shares == {c: k for c, k in want.items() if c.count("|") >= 2}


def test_no_query_is_registered_twice():
    assert len({f.__code__ for f in registry.QUERIES.values()}) == len(registry.QUERIES)
    assert not [n for n, q in registry.ORACLES.items() if "BETWEEN 3 AND 40" in q]
