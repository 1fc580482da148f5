"""Payloads, files and answers to items of the log, and from there to scans."""

import itertools
import json
import random

import pytest

from factloom.operators import facts, review
from factloom.sources import claims, ingest

ISSUE, PERSON, PROJECT, COMMENT = 3 * 10**12 + 7, 10**12, 2 * 10**12 + 9, 4 * 10**12


def payload(kind, created, author=3, **content):
    who = {"id": author, "name": f"N{author}", "mailAddress": ""}
    return json.dumps({"type": kind, "project": {"id": 9, "projectKey": "K", "name": "Pr"}, "content": {"id": 7, "key_id": 5, **content}, "createdUser": who, "created": created})


def made(spark, *payloads, users=(("Al", 4, "al@x"), ("Al", 8, None), ("Cy", 6, None))):
    raw = spark.createDataFrame(list(enumerate(payloads)), "event long, value string")
    statuses = spark.createDataFrame([(2, "In Progress")], "id long, name string")
    return ingest.issue_items(ingest.events(raw), statuses, spark.createDataFrame(list(users), "name string, id long, mailAddress string"))


def change(field, old, new):
    return {"field": field, "old_value": old, "new_value": new}


def test_issue_history(spark):
    log = made(
        spark,
        payload(1, "2026-07-01T09:15:00Z", summary="S", status={"id": 1, "name": "Open"}, assignee={"id": 4, "name": "Al"}),
        payload(2, "2026-07-02T14:30:00Z", changes=[change("status", "1", "2")]),
        payload(2, "2026-07-03T10:00:00Z", author=5, changes=[change("assigner", "Al", "")]),
        "{}", payload(9, "2026-07-03T10:00:00Z"), "no json",
    )
    at = {r["predicate"]: r["object"] for r in facts.as_of(log, 1782907200).where(f"subject = {ISSUE}").collect()}
    assert at == {"issue-key": "K-5", "summary": "S", "status": "Open", "in-project": str(PROJECT), "assigned-to": str(PERSON + 4), "created-by": str(PERSON + 3)}
    head = {r["predicate"]: r["object"] for r in facts.current(facts.guarded_head(log)).where(f"subject = {ISSUE}").collect()}
    assert head["status"] == "In Progress" and "assigned-to" not in head and head["created-by"] == str(PERSON + 3)
    nodes = {(r["id"], r["type"]) for r in ingest.issue_nodes(log).collect()}
    assert nodes == {(ISSUE, "Issue"), (PROJECT, "Project"), (PERSON + 3, "Person"), (PERSON + 4, "Person"), (PERSON + 5, "Person")}


def test_changes_fill_in_what_the_snapshot_lacks(spark):
    log = made(spark, payload(2, "2026-07-02T00:00:00Z", status={"id": 1, "name": "Open"}, changes=[change("status", "", "2"), change("assignee", "", "Al"), change("assigner", "", "Nobody"), change("summary", "a", " "), change("summary", None, "new"), change("milestone", "a", ""), change("status", " ", "")]))
    rows = [(r["seq"]["place"], r["op"], r["predicate"], r["object"]) for r in log.where(f"subject = {ISSUE}").collect()]
    assert {x[1:] for x in rows} == {("assert", "issue-key", "K-5"), ("assert", "status", "Open"), ("assert", "in-project", str(PROJECT)), ("assert", "assigned-to", str(PERSON + 4)), ("assert", "summary", "new"), ("close", "summary", None)}
    assert {r["predicate"]: r["object"] for r in log.where(f"subject = {PERSON + 4}").collect()} == {"name": "Al", "email": "al@x"}
    assert "summary" not in {r["predicate"] for r in facts.current(facts.guarded_head(log)).where(f"subject = {ISSUE}").collect()}  # closes are written last


def test_a_close_and_a_value_of_one_instant_go_by_the_order_of_events(spark):
    gone, back = payload(2, "2026-07-02T00:00:00Z", changes=[change("status", "1", "")]), payload(2, "2026-07-02T00:00:00Z", changes=[change("status", "", "2")])
    status = lambda log: [r["object"] for r in facts.current(facts.guarded_head(log)).where("predicate = 'status'").collect()]
    assert status(made(spark, gone, back)) == ["In Progress"] and status(made(spark, back, gone)) == []


def test_from_payloads_to_scans(spark):
    """What is ingested is what the scans read."""
    talk = payload(3, "2026-07-04T00:00:00Z", author=6, comment={"id": 11, "content": "LGTM"})
    log = made(spark, payload(1, "2026-07-01T00:00:00Z", summary="S", assignee={"id": 4, "name": "Al"}), talk)
    got = {(r["template"], r["group"], r["id"], tuple(r["targets"])) for r in review.event_groups(log).collect()}
    assert got == {("issue-assignee", PROJECT, ISSUE, (PERSON + 4,)), ("comment-author", PROJECT, COMMENT + 11, (PERSON + 6,))}
    none = spark.createDataFrame([], "comment long, issue long")
    (r,) = review.approval_candidates(log, none).collect()
    assert (r["comment"], r["issue"], r["approver"], r["approver_name"], r["summary"]) == (COMMENT + 11, ISSUE, PERSON + 6, "N6", "S")


def grant(id_, kind="user", role="reader", deleted=None, email=None):
    return (id_, kind, role, email, None if deleted else f"P{id_}", deleted)


def files(spark, *rows):
    return spark.createDataFrame([(i, r[0], r[0].upper(), r[1], None, f"2026-01-{i + 1:02d}T00:00:00Z", ["d", "x"], [("o", None, "Own")], r[2]) for i, r in enumerate(rows)], ingest.FILE)


def test_folders_documents_and_shortcuts(spark):
    made_ = ingest.file_items(files(spark, ("f", ingest.FOLDER_KIND, [grant("a")]), ("s", ingest.SHORTCUT_KIND, [grant("a")]), ("t", "text/plain", [grant("a"), grant("b", deleted=True), grant("g", "group"), grant(None), grant(None, email="e@x")])))
    said = {}
    for r in made_.collect():
        said.setdefault(r["predicate"], []).append((r["object"], r["valid_from"]))
    assert {k: len(v) for k, v in said.items()} == {"folder-name": 1, "parent-folder": 1, "doc-name": 1, "mime-type": 1, "in-folder": 1, "owned-by": 1, "can-access": 3, "name": 4, "account-deleted": 1, "email": 1}
    assert {x for x, _ in said["name"]} == {"Own", "Pa", "(deleted account)", "PNone"} and {at for _, at in said["name"] + said["email"]} == {0} and said["doc-name"][0][1] == 1767398400
    nodes = ingest.file_nodes(files(spark, ("f", ingest.FOLDER_KIND, None), ("t", "text/plain", [grant("a"), grant("b")]), ("t", "text/plain", [grant("a", "anyone")])))
    assert {(r["type"], r["label"]) for r in nodes.collect()} == {("Document", 1), ("Folder", 3), ("Folder", None), ("Person", None)}


def test_access_tiers(spark):
    rows = [("a", None), ("b", [grant("x", role="owner")]), ("c", [grant("x", "anyone")]), ("d", [grant("x", "group")]), ("e", [grant("x"), grant("y")]), ("f", [grant("x", "anyone", deleted=True)]), ("g", [grant("x"), grant(None), grant(None)])]
    df = spark.createDataFrame(rows, f"id string, permissions array<{ingest.GRANT}>")
    assert {r["id"]: r["t"] for r in df.select("id", ingest.access_tier(df["permissions"]).alias("t")).collect()} == {"a": 3, "b": 3, "c": 1, "d": 2, "e": 2, "f": 3, "g": 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_grants_as_of_any_instant_are_those_of_a_replay(spark, seed):
    r = random.Random(seed)
    seen = [(r.choice("tu"), "text/plain", None if r.random() < 0.25 else [grant(p) for p in "abcd" if r.random() < 0.5]) for _ in range(24)]
    df = files(spark, *seen)
    log = ingest.file_items(df).where("predicate = 'can-access'")
    person = {p: x["person"] for p in "abcd" for x in ingest.granted(files(spark, ("z", "text/plain", [grant(p)]))).collect()}
    node = {x["id"]: x["node"] for x in ingest._files(df).collect()}
    has, start = {"t": set(), "u": set()}, 1767225600
    for i, (name, _, grants) in enumerate(seen):
        if grants is not None:
            has[name] = {g[0] for g in grants}
        if i % 5 == 4:
            got = {(x["subject"], int(x["object"])) for x in facts.as_of(log, start + i * 86400, facts.ELEMENT).collect()}
            assert got == {(node[n], person[p]) for n in has for p in has[n]}


FORM = [("leads", "Person", "Project", "edge"), ("grade", "Person", None, "value"), ("project-name", "Project", None, "value")]


def form(spark):
    return spark.createDataFrame(FORM, "name string, `from` string, `to` string, kind string")


def parsed(spark, *answers):
    return [r.asDict() for r in claims.parsed_claims(spark.createDataFrame(list(enumerate(answers)), "doc long, answer string"), form(spark)).orderBy("doc", "nth").collect()]


def fact(**x):
    return {"subject": "Ann", "predicate": "leads", "object": "X", **x}


def test_answers_are_read_claim_by_claim(spark):
    told = json.dumps({"facts": [fact(subject=" Ann　", passage=" " + "p" * 2000, confidence="sure"), fact(predicate="unknown"), 7, None, fact(object=""), fact(object=5), fact(subjectType="", objectType="", confidence="implied", effectiveFrom=" "), fact(predicate="grade", objectType="Project", confidence="explicit")]})
    got = parsed(spark, "Sure {thing}:\n```json\n" + told + "\n``` bye }", "none", "{broken", '{"facts": 3}', '{"claims": []}', "x " + json.dumps({"facts": [fact()]}) + " y", None)
    assert [(g["doc"], g["nth"], g["predicate"]) for g in got] == [(0, 0, "leads"), (0, 6, "leads"), (0, 7, "grade"), (5, 0, "leads")]
    assert (got[0]["subject"], got[0]["subject_type"], got[0]["object_type"], got[0]["confidence"], len(got[0]["passage"])) == ("Ann", "Person", "Project", None, 1000)
    assert (got[1]["subject_type"], got[1]["object_type"], got[1]["confidence"], got[1]["effective_from"]) == ("Person", "Project", "implied", None)
    assert (got[2]["object_type"], got[2]["confidence"]) == (None, "explicit")


def minted(spark, *told, tier=1):
    rows = claims.parsed_claims(spark.createDataFrame([(k, json.dumps({"facts": [f]})) for k, f in enumerate(told)], "doc long, answer string"), form(spark))
    docs = spark.createDataFrame([(k, "family", tier, 100 + k) for k in range(len(told))], "doc long, key string, tier int, at long")
    types = spark.createDataFrame([("Person",), ("Project",)], "type string")
    return claims.minted(rows, docs, types, spark.createDataFrame([("leads", 3), ("leads", 2)], "predicate string, floor int"))


def test_what_claims_mint(spark):
    rows = minted(spark, fact(), fact(objectType="Planet", subject="Bo"), fact(subjectType="Dog"), fact(predicate="grade", object="7", effectiveFrom="1970-01-01T00:10:00Z"), fact(predicate="project-name", subject="X", object="The X"))
    nodes = {(r["type"], r["label"]) for r in claims.claim_nodes(rows).collect()}
    assert nodes == {("Person", 3), ("Project", 3)} and claims.claim_nodes(rows).count() == 3  # Bo stays, the planet and the dog don't come to be
    items = claims.claim_items(rows, form(spark)).collect()
    assert sorted((r["predicate"], r["object"] if r["predicate"] != "leads" else "", r["valid_from"], r["source"]) for r in items) == sorted([
        ("leads", "", 100, "drive:0"), ("grade", "7", 600, "drive:3"), ("project-name", "The X", 104, "drive:4"),
        ("person-name", "Ann", 100, "drive:0"), ("person-name", "Bo", 101, "drive:1"), ("person-name", "Ann", 103, "drive:3"),
    ])  # a declared name predicate is the pattern's own
    assert [(r["doc"], r["floor"]) for r in claims.document_floors(rows).collect()] == [(0, 3)]
    known = claims.family_keys(rows, rows.sparkSession.createDataFrame([], "family long, entity string"))
    assert {r["entity"] for r in known.collect()} == {"Person|Ann", "Person|Bo", "Project|X"}
    again = claims.family_keys(rows, known.where("entity != 'Person|Bo'"))
    assert [r["entity"] for r in again.collect()] == ["Person|Bo"]


def test_labels_rise_whatever_the_order(spark):
    told = [fact(), fact(predicate="grade", object="1"), fact(subject="Bo", predicate="grade", object="2")]
    for some in itertools.permutations(told):
        labels = {r["label"] for r in claims.claim_nodes(minted(spark, *some, tier=1)).collect()}
        assert labels == {3, 1}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], ingest.FILE)
    assert ingest.file_items(none).count() == 0 and ingest.file_nodes(none).count() == 0
    raw = spark.createDataFrame([], "event long, value string")
    assert ingest.issue_items(ingest.events(raw), spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "name string, id long, mailAddress string")).count() == 0
