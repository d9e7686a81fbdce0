import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskiln.llm import mixing as M
from corpuskiln.llm import packing as K
from corpuskiln.llm import tokens


def naive_first_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        i = next((i for i, b in enumerate(bins) if b + s <= capacity), None)
        if i is None:
            bins.append(0)
            i = len(bins) - 1
        bins[i] += s
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 100) for _ in range(r.randint(1, 300))), reverse=True)
    assert K.first_fit(sizes, 100) == naive_first_fit(sizes, 100)
    assert K.first_fit([], 5) == []


def docs(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["boat", "garden", "rope", "mill"]) for _ in range(r.choice([1, 5, 40, 300]))), r.choice(["A", " a", "b", None, "c"])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "rope " * 5000, "b"), (903, rows[0][1], "b"), (904, rows[0][1], "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_containers(spark):
    d = docs(spark)
    sizes = spark.createDataFrame([("s", 64), ("l", 1000), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    packed = K.containers(d, sizes, group_items=100).collect()
    n = {r.doc_id: r.tokens for r in tokens.with_tokens(d.select("doc_id", "text")).collect()}
    for kind, cap in (("s", 64), ("l", 1000)):
        mine = [r for r in packed if r.container_kind == kind]
        per = {}
        for r in mine:
            per.setdefault((r.grp, r.container_no), []).append(r.tokens)
        assert max(map(sum, per.values())) <= cap
        total = {}
        for r in mine:
            total.setdefault(r.doc_id, []).append(r.tokens)
        assert {k: sum(v) for k, v in total.items()} == {k: v for k, v in n.items() if v}
        assert all(len(v) == (1 if n[k] <= cap else -(-n[k] // cap)) for k, v in total.items())
        assert sum(n[k] for k in total) / (len(per) * cap) > 0.9
    assert {r.container_kind for r in packed} == {"s", "l"}
    assert K.containers(d.limit(0), sizes).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_knapsack_is_best(seed):
    r = random.Random(seed)
    lengths = sorted(r.sample(range(3, 60), 5))
    counts = [r.randint(1, 4) for _ in lengths]
    budget = r.randint(10, 300)
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    take = M.knapsack(lengths, counts, budget)
    assert sum(n * k for n, k in take.items()) == max(s for s in sums if s <= budget)
    assert all(k <= counts[lengths.index(n)] for n, k in take.items())


def test_fit_budget():
    lengths, counts = np.array([3, 50, 1000]), np.array([1000, 800, 90])
    total = int((lengths * counts).sum())
    for budget in (0, 1, 2, 17, 5000, 60000, total - 1, total, total + 4321, 9 * total):
        passes, take = M.fit_budget(lengths, counts, budget, 3)
        got = passes * total + int((take * lengths).sum())
        assert passes <= 3 and (take <= counts).all() and (take == 0).all() if passes == 3 else (take <= counts).all()
        assert got <= budget and (budget - got <= 2 or budget > 3 * total)


def test_mixture(spark):
    d = docs(spark)
    t = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(d, t)
    rows = mixed.collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.times <= cap[r.source] for r in rows)
    text = {r.doc_id: r.text for r in d.collect()}
    assert len({text[r.doc_id] for r in rows}) == len(rows)  # copies are one text
    report = {r.source: r for r in M.shares(mixed, t).collect()}
    total = sum(r.tokens for r in report.values())
    assert report["gone"].tokens == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s].tokens / total - share / 1.0) < 0.02
    small = M.shares(M.mixture(d, t, total=1000), t).agg(F.sum("tokens")).collect()[0][0]
    assert 950 <= small <= 1000
    assert M.mixture(d.limit(0), t).count() == 0


def test_many_kinds_and_groups_by_pieces(spark):
    docs = spark.createDataFrame([(i, "word " * (5 + i % 7)) for i in range(40)] + [(99, "word " * 400)], "doc_id long, text string")
    sizes = spark.createDataFrame([(f"k{i}", 16 + i) for i in range(1001)], "container_kind string, capacity_tokens int")
    got = K.containers(docs, sizes)
    assert got.select("container_kind").distinct().count() == 1001
    few = K.containers(docs, sizes.filter("container_kind = 'k0'"), group_items=10).toPandas()
    n = len(few)
    assert few["grp"].nunique() > n / 20 and few.groupby(["grp", "container_no"])["tokens"].sum().max() <= 16
    assert few.groupby("doc_id")["tokens"].sum().sum() == K.containers(docs, spark.createDataFrame([("x", 10**6)], "container_kind string, capacity_tokens int")).toPandas()["tokens"].sum()
    assert K.containers(docs, sizes.limit(0)).count() == 0
