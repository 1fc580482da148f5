"""The n-gram Jaccard join and connected components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ngram_join
from factloom.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))) if words else frozenset()


def brute(rows):
    """(doc_id, size, least id of the component) of all rows, all pairs compared that share anything."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k] = root[root[k]]
        return k

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for o, both in Counter(o for g in s for o in where[g]).items():
            if 100 * both >= 90 * (len(s) + len(sets[o]) - both):
                root[find(k)] = find(o)
        for g in s:
            where[g].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=repr)


def made(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def made_texts(seed, n=700):
    """Copies with few edits of texts of all lengths, two of them hot, with passages that many share."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2500)]
    bases = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 12, 30, 60, 120, 500]))] for _ in range(40)]
    passage = [r.choice(words) for _ in range(25)]
    rows = []
    for i in range(n):
        text = list(r.choice(bases) if r.random() > 0.4 else bases[i % 2])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.3:
            text += passage
        rows.append((i * 3 - 7, " ".join(text)))
    return rows


def test_join_on_the_odd_table(spark, odd, odd_texts):
    assert made(ngram_join.join(odd)) == brute(odd_texts)


@pytest.mark.parametrize("seed, leaf, common", [(1, 256, 96), (2, 8, 5)])
def test_join_is_exact(spark, seed, leaf, common):
    """With small leaves and low limits of common shingles, every way through the recursion is taken."""
    rows = made_texts(seed)
    assert made(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), leaf, common)) == brute(rows)


def test_join_at_the_limit(spark):
    """Pairs at exactly 0.9 link, those just under don't; a chain is one component."""
    nine = " ".join(f"a{i}" for i in range(11))  # nine shingles; with one more word 9 of 10 are shared
    rows = [(5, nine), (4, nine + " x"), (3, nine + " x y"), (2, " ".join(f"a{i}" for i in range(10)) + " z"), (1, "A B"), (0, "a\tb"), (9, "a b c"), (8, "a b"), (7, "É è"), (6, "é è")]
    got = made(ngram_join.join(spark.createDataFrame(rows, "doc_id int, text string")))
    assert got == brute(rows) and (3, 11, 3) in got and (5, 9, 3) in got and (2, 9, 2) in got and (1, 1, 0) in got and (7, 1, 7) in got


def test_join_of_no_rows(none):
    assert ngram_join.join(none).collect() == []


def test_rows_of_a_hot_group_grow_in_proportion(spark):
    """Twice the copies with an edit each make twice the members of leaves, not four times."""
    base = [f"w{i}" for i in range(150)]
    sizes = []
    for n in (150, 300):
        rows = [(i, " ".join(base[: i % 140] + [f"e{i}"] + base[i % 140 + 1 :])) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        held = ngram_join.sets(docs).select("digest", F.col("doc_id").alias("first_id"))
        sets_ = ngram_join.coded(held, docs)
        near, _ = ngram_join.opened(sets_, components(ngram_join.pivot_links(sets_)))
        sizes.append(near.count() + ngram_join._units(ngram_join.regions_of(near)[0]).count())
        assert len({r["component_id"] for r in ngram_join.join(docs).collect()}) == 1
    assert sizes[1] <= 2.5 * sizes[0] + 20


def test_common_counts():
    r = np.random.default_rng(1)
    sets_ = [np.unique(r.integers(0, 400, k)).astype(np.uint64) for k in (1, 5, 90, 90, 300, 300)]
    both = ngram_join.common_counts(sets_, columns=64)
    for i in range(6):
        for j in range(6):
            if i != j:
                assert both[i, j] == len(np.intersect1d(sets_[i], sets_[j])) == ngram_join.shared(sets_[i], sets_[j])


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [("hub", f"n{i:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("self", "self"), (None, "x")]
    edges += [(f"r{r.randrange(80):02d}", f"r{r.randrange(80):02d}") for _ in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = {x: find(x) for x in root}
    got = components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {x["digest"]: x["label"] for x in got} == want and len(got) == len(want)
