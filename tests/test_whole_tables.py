"""Registered queries work on whole texts and tables, by brute force."""

from __future__ import annotations

import re

from tidemark import catalog


def test_regex_cleanup_reads_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = catalog.queries()["regex_cleanup"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    assert max(len(r.plain) for r in found) > 200
    for r in found:
        assert r.plain == re.sub("[^A-Za-z0-9 ]+", "", texts[r.doc_id])
        assert r.swapped == re.sub("([a-z]+) ([a-z]+)", r"\2 \1", texts[r.doc_id], count=1)
        assert r.digits == f"{r.doc_id}123 x-4-"


def test_business_keys_lists_all_customers(spark, sf_dir, tmp_path):
    customers = [(k, f"Customer#{k}", k % 25) for k in range(1, 1201)]
    orders = [(k, (k * 7) % 1200 + 1) for k in range(1, 1301)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    names = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    found = {r.o_orderkey: (r.nations, r.nations_missing) for r in catalog.queries()["business_keys"](spark, str(tmp_path)).collect()}
    lists = {k: {n, (n + 1) % 30} for k, _, n in customers}
    assert found == {k: (",".join(sorted(names[i] for i in lists[k] if i in names)), sum(i not in names for i in lists[k])) if k in lists else (None, None) for k, _ in orders}


def test_components_cross_every_eighth_part(spark, tmp_path):
    types = ["a"] * 20 + ["b", "c", "c", "d", "e", "f", "f", "f"] + ["g", "g"] + ["h"]
    parts = [(i, f"part {i % 3}", t, i % 5) for i, t in enumerate(types, 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    q = {n: f(spark, str(tmp_path)).collect() for n, f in catalog.queries().items() if n in ("merge_components", "survivors", "effective_accounting")}
    first = {}
    for i, _, t, _ in parts:
        first.setdefault(t, i)
    several = {t for t in types if types.count(t) > 1}
    assert {(r.node, r.component) for r in q["merge_components"]} == {(i, first[t]) for i, _, t, _ in parts if t in several}
    assert {(r.component, r.n_members) for r in q["survivors"] if r.field == "p_type"} == {(first[t], types.count(t)) for t in several}
    assert {(r.p_partkey, r.accounting) for r in q["effective_accounting"]} == {(i, "CONTRIBUTED_TO_SURVIVOR" if t in several else "KEPT_DISTINCT") for i, _, t, _ in parts}
