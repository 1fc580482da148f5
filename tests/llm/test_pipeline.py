"""The pipeline's stages against plain Python, each on its own input, and the recall of near-dedup on the given documents."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import near_dedup, secrets, toxicity
from factloom.llm import queries as llm

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, odd_texts, tmp_path_factory):
    """documents and labels: the odd texts, and texts of which half hold words that are labelled toxic."""
    path = str(tmp_path_factory.mktemp("tables"))
    told = [(1000 + i, f"{'vile nasty awful' if i % 3 == 0 else 'kind gentle lovely'} words{i} about thing{i % 7} number {i}", int(i % 3 == 0)) for i in range(60)]
    rows = [(i, t, None if i is None else "en", None, None if t is None else len(t)) for i, t in [*odd_texts, *((i, t) for i, t, _ in told)]]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, g, 1) for i, _, g in told[:45]] + [(7, None, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def kept_of_equal(rows):
    """The row of the greatest id of each text, equal but for A-Z."""
    best = {}
    for r in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    return best


def near_classes(rows):
    """Number of classes of near duplicates, all pairs of word sequences aligned."""
    codes = [near_dedup.kmers(near_dedup.words_of(r[1] or "")) for r in rows]
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.aligned(codes[i], codes[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def test_stages_do_what_plain_python_does(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, outs = rows_of(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        outs[name] = rows_of(docs)
        if name != "packing":
            assert docs.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ")
    model = llm.toxicity_model(spark, folder)
    assert Counter(outs["toxicity"]) == Counter(r for r in before if 1 - model.probabilities(sum(model.weights[w] for w in model.weights.keys() & toxicity.words_of(r[1] or "")))[0] < llm.TOXIC_FROM)
    assert len(before) - len(outs["toxicity"]) == 20
    best = kept_of_equal(outs["toxicity"])
    assert len(outs["exact_dedup"]) == len(best) and {(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in outs["exact_dedup"]} == {(r[0], k) for k, r in best.items()}
    classes = near_classes(outs["exact_dedup"])
    least = {}
    for c, r in zip(classes, outs["exact_dedup"]):
        least[c] = min(least.get(c, (True, 0)), (r[0] is not None, r[0] or 0)) if c in least else (r[0] is not None, r[0] or 0)
    assert Counter((r[0] is not None, r[0] or 0) for r in outs["near_dedup"]) == Counter(least.values())
    assert Counter(outs["secrets"]) == Counter((r[0], r[1] and secrets.redacted(r[1], "[SECRET]"), *r[2:4], len(secrets.redacted(r[1] or "", "[SECRET]"))) for r in outs["near_dedup"])
    assert {r[0] for r in outs["packing"]} == {r[0] for r in outs["secrets"]}


def test_run_gives_packed_pieces(spark, folder):
    made = corpus_pipeline.run(spark, folder)
    total = made.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert total and all(r["n"] == r["end"] <= 4096 for r in total)


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        assert made.count() == 0
        docs = made if name != "packing" else docs


def test_near_dedup_finds_the_links_of_given_documents(spark, sf_dir):
    """Of the links that comparing all pairs finds among documents, at least nine in ten are within a class."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    codes = [near_dedup.kmers(near_dedup.words_of(r["text"] or "")) for r in rows]
    where = {}
    for k, x in enumerate(codes):
        for h in x.tolist():
            where.setdefault(h, []).append(k)
    shared = Counter()
    for some in where.values():
        if len(some) > 1:
            shared.update((a, b) for i, a in enumerate(some) for b in some[i + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 / 1.8 * (len(codes[a]) + len(codes[b])) - 1e-9 and near_dedup.aligned(codes[a], codes[b]) >= 0.8]
    class_of = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    found = [class_of[rows[a]["doc_id"]] == class_of[rows[b]["doc_id"]] for a, b in links]
    assert len(links) > 50 and np.mean(found) >= 0.9
