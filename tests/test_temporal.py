"""Intervals, rules over paths with instants, and traces of candidates, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts, temporal
from factloom.operators.temporal import Rule, Step

from .test_operators import log


def test_intervals_of_one_and_of_many(spark):
    some = log(spark, ("assert", 1, "p", "a", 10), ("assert", 1, "p", "b", 20), ("close", 1, "p", None, 30), ("assert", 1, "p", "c", 40, 45, None), ("assert", 1, "p", "d", 40, 60, None))
    got = sorted((r["object"], r["began"], r["until"]) for r in temporal.histories(some).collect())
    assert got == [("a", 10, 20), ("b", 20, 30), ("d", 40, 60)]  # c was replaced at its own instant
    many = log(spark, ("assert", 1, "p", "a", 10), ("assert", 1, "p", "b", 20), ("close", 1, "p", "a", 30), ("assert", 1, "p", "a", 40))
    got = sorted((r["object"], r["began"], r["until"]) for r in temporal.histories(many, many=True).collect())
    assert got == [("a", 10, 30), ("a", 40, None), ("b", 20, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reads_at_many_instants_are_those_of_one_by_one(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["assert", "assert", "close"]), r.randrange(3), "p", r.choice("abc"), r.randrange(100), r.choice([None, None, r.randrange(120)]), None) for _ in range(60)]
    some = log(spark, *rows)
    asks = [(r.randrange(4), r.randrange(-5, 130)) for _ in range(40)]
    for many in (False, True):
        for width in (7, 1000):
            got = {tuple(x) for x in temporal.at_instants(temporal.histories(some, many), spark.createDataFrame(asks, "subject long, at long"), width).collect()}
            want = {(s, t, x["object"]) for s, t in set(asks) for x in facts.as_of(some.where(F.col("subject") == s), t, facts.ELEMENT if many else facts.KEYS).collect()} if width == 7 else want  # noqa: F821
            assert got == want


RULE = Rule("r", (Step("in"), Step("led", "at")), "by", ("state", "on"), ("waived", "yes"))


def rule_log(spark):
    """Project 1 is led by 50, then by 51 from 100 on, by nobody from 200 on."""
    rows = [("assert", 1, "led", "50", 10), ("assert", 1, "led", "51", 100), ("close", 1, "led", None, 200)]

    def subject(k, at=None, by=None, state="on", project="1", waived=None):
        said = {"in": project, "at": at and str(at), "by": by and str(by), "state": state, "waived": waived}
        return [("assert", k, p, v, 1) for p, v in said.items() if v is not None]

    cases = {
        10: (subject(10, 50, 50), ("OK", None, 50, 50)), 11: (subject(11, 150, 50), ("MISMATCH", "stale", 51, 50)), 12: (subject(12, 50, 51), ("MISMATCH", "wrong", 50, 51)),
        13: (subject(13, 150, 77), ("MISMATCH", "wrong", 51, 77)), 14: (subject(14, 150, waived="yes"), ("ABSENT", None, 51, None)), 15: (subject(15, 150), ("NOT_APPLICABLE", None, 51, None)),
        16: (subject(16, 150, 51, state="off"), ("NOT_APPLICABLE", None, None, 51)), 17: (subject(17, 250, 51), ("NOT_APPLICABLE", None, None, 51)), 18: (subject(18, None, 51), ("NOT_APPLICABLE", None, None, 51)),
        19: (subject(19, 150, 51, project=None), ("NOT_APPLICABLE", None, None, 51)), 20: (subject(20, 100, 51), ("OK", None, 51, 51)), 21: (subject(21, 99, 50) + [("close", 21, "by", None, 5)], ("NOT_APPLICABLE", None, 50, None)),
    }
    return log(spark, *rows, *(r for said, _ in cases.values() for r in said)), {k: want for k, (_, want) in cases.items()}


def test_rules_read_each_hop_at_its_own_instant(spark):
    some, want = rule_log(spark)
    got = temporal.conformance(some, RULE, spark.createDataFrame([(k,) for k in want], "id long")).collect()
    assert {r["id"]: (r["verdict"], r["why"], r["required"], r["actual"]) for r in got} == want
    assert {r["id"]: r["as_of"] for r in got}[11] == 150 and {r["id"]: r["as_of"] for r in got}[16] is None


def test_rules_over_many_and_without_instants(spark):
    some, want = rule_log(spark)
    more = some.unionByName(log(spark, ("assert", 1, "deputy", "60", 10), ("assert", 1, "deputy", "61", 20), ("close", 1, "deputy", "60", 90), ("assert", 30, "in", "1", 1), ("assert", 30, "by", "61", 1), ("assert", 31, "in", "1", 1), ("assert", 31, "by", "60", 1)))
    ids = spark.createDataFrame([(30,), (31,), (99,)], "id long")
    now = {r["id"]: (r["verdict"], r["why"], r["required"]) for r in temporal.conformance(more, Rule("m", (Step("in"), Step("deputy", many=True)), "by"), ids).collect()}
    assert now == {30: ("OK", None, 61), 31: ("MISMATCH", "stale", 61), 99: ("NOT_APPLICABLE", None, None)}
    led = temporal.conformance(some, Rule("h", (Step("in"), Step("led")), "by"), ids)
    assert {r["verdict"] for r in led.collect()} == {"NOT_APPLICABLE"}  # nobody leads it now


def month(k):
    return k * 100


def test_traces(spark):
    """Five events of one group; months without any target count as not measured, and what ended early doesn't vote."""
    writes = [("assert", i, "assigned-to", "5", month(1)) for i in range(1, 5)] + [("assert", 5, "assigned-to", "6", month(1)), ("assert", 4, "assigned-to", "6", month(2)), ("assert", 3, "assigned-to", "4", month(2)), ("close", 2, "assigned-to", None, month(2))]
    writes += [("close", i, "assigned-to", None, month(3)) for i in range(1, 6)]
    events = spark.createDataFrame([("issue-assignee", 7, i) for i in range(1, 7)] + [("doc-access", 9, 20)], "template string, group long, id long")
    candidates = spark.createDataFrame([("p", "issue-assignee", 7, "assigned-to", 5, None), ("w", "doc-access-scope", 8, "can-access", 8, None)], "pattern_id string, template string, group long, predicate string, first long, second long")
    months = spark.createDataFrame([("p", [month(k) for k in range(5)]), ("w", [month(1)])], "pattern_id string, months array<long>")
    more = log(spark, *writes, ("assert", 20, "can-access", "8", month(1)), ("assert", 20, "can-access", "9", month(1)))
    got = {(r["pattern_id"], r["at"]): r for r in temporal.traces(more, events, candidates, months).collect()}
    told = {k: (r["population"], r["covered"], r["held"], r["top"]) for k, r in got.items()}
    assert told == {("p", 0): (0, 0, False, None), ("p", 100): (5, 4, True, None), ("p", 200): (4, 1, False, 6), ("p", 300): (0, 0, False, None), ("p", 400): (0, 0, False, None), ("w", 100): (1, 1, True, None)}
    assert {(r["measured"], r["months_held"]) for k, r in got.items() if k[0] == "p"} == {(2, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_of_many_months_are_those_of_month_by_month(spark, seed):
    """130 months, which are three words of bits; events without targets, closes, ends, ties of targets."""
    r = random.Random(seed)
    some = [month(k) for k in range(130)]
    end = lambda at: r.choice([None, None, at + r.randrange(6000)])
    writes = [(r.choice(["assert", "assert", "close"]), i, "can-access", r.choice("5678"), at := r.randrange(13000), end(at), None) for i in range(10, 14) for _ in range(7)]
    writes += [(op := r.choice(["assert", "assert", "close"]), i, "assigned-to", r.choice("567") if op == "assert" else None, at := r.randrange(13000), end(at), None) for i in range(20, 26) for _ in range(5)]
    events = [("doc-access", 1 + i % 2, i) for i in range(10, 15)] + [("issue-assignee", 7, i) for i in range(20, 27)]
    candidates = [("d", "doc-access", 1, "can-access", 5, 6), ("w", "doc-access-scope", 8, "can-access", 7, None), ("i", "issue-assignee", 7, "assigned-to", 6, None), ("n", "issue-assignee", 9, "assigned-to", 6, None)]
    said = log(spark, *writes)
    spans = {(x["subject"], x["predicate"], x["object"], x["began"], x["until"]) for p, many in (("can-access", True), ("assigned-to", False)) for x in temporal.histories(said.where(F.col("predicate") == p), many).collect()}
    want = {}
    for p, template, group, predicate, *targets in candidates:
        ids = {i for t, g, i in events if (template == "doc-access-scope" and t == "doc-access") or (t, g) == (template, group)}
        rows = []
        for at in some:
            held = {(i, int(o)) for i, q, o, began, until in spans if i in ids and q == predicate and began <= at and (until is None or until > at)}
            population, covered = len({i for i, _ in held}), len({i for i, o in held if o in targets})
            ok = population > 0 and covered / population >= 0.8
            votes = [o for _, o in held]
            rows.append((at, population, covered, ok, None if ok or not votes else min(votes, key=lambda o: (-votes.count(o), o))))
        counts = sum(x[1] > 0 for x in rows), sum(x[3] for x in rows)
        want |= {(p, x[0]): (*x[1:], *counts) for x in rows}
    months = spark.createDataFrame([(x[0], some) for x in candidates], "pattern_id string, months array<long>")
    made = temporal.traces(said, spark.createDataFrame(events, "template string, group long, id long"), spark.createDataFrame(candidates, "pattern_id string, template string, group long, predicate string, first long, second long"), months)
    assert {(x["pattern_id"], x["at"]): (x["population"], x["covered"], x["held"], x["top"], x["measured"], x["months_held"]) for x in made.collect()} == want
    assert any(x[3] for x in want.values()) and any(x[2] for x in want.values())


def test_an_interval_is_one_row_however_many_months_it_holds_at(spark):
    """A row for each interval and month is what took the time of an_stability."""
    intervals = spark.createDataFrame([(k, "p", 5, 0, None) for k in range(40)], "subject long, predicate string, object long, began long, until long")
    of = spark.createDataFrame([(k, "c") for k in range(40)], "id long, pattern_id string")
    own = spark.createDataFrame([("c", "p", [month(k) for k in range(36)], [5])], "pattern_id string, predicate string, months array<long>, targets array<long>")
    rows = temporal._spans(intervals, of, own).collect()
    assert len(rows) == 40 and {(x["low"], x["high"], x["hit"]) for x in rows} == {(0, 36, True)}
