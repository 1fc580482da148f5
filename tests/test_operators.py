"""Operators on literal rows: boundaries, orders of writes, files and streams."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom import functions as fn
from factloom.operators import catalog, facts, graph, patterns, people, review
from factloom.sources import events, listings, office, schemas
from factloom.streaming import heads

LOG = "seq long, op string, subject long, predicate string, object string, valid_from long, valid_to long, source string"


def log(spark, *rows):
    return spark.createDataFrame([(i, *r, None, None) if len(r) == 5 else (i, *r) for i, r in enumerate(rows)], LOG)


def test_heads_differ_after_a_late_arrival(spark):
    some = log(spark, ("assert", 1, "p", "new", 200), ("assert", 1, "p", "old", 100))
    assert facts.raw_head(some).first()["object"] == "old" and facts.guarded_head(some).first()["object"] == "new"


def test_closes_and_half_open_ends(spark):
    some = log(spark, ("assert", 1, "p", "a", 100), ("close", 1, "p", None, 300), ("assert", 2, "p", "b", 100, 200, None))
    at = lambda t: {r["subject"]: r["object"] for r in facts.as_of(some, t).collect()}
    assert at(99) == {} and at(100) == {1: "a", 2: "b"} and at(200) == {1: "a"} and at(300) == {}
    assert facts.point(some).where("subject = 1").first()["closed_from"] == 300


def test_equal_instants_go_by_the_later_write_and_order_of_writes_does_not_matter(spark):
    rows = [("assert", 1, "p", x, at) for x, at in (("a", 5), ("b", 9), ("c", 7))]
    assert {facts.as_of(log(spark, *some), 8).first()["object"] for some in (rows, rows[::-1])} == {"c"}
    assert facts.as_of(log(spark, ("assert", 1, "p", "x", 5), ("assert", 1, "p", "y", 5)), 5).first()["object"] == "y"


def test_retract_removes_an_elements_history(spark):
    some = log(spark, ("assert", 1, "p", "a", 5), ("assert", 1, "p", "b", 6), ("retract", 1, "p", "a", None), ("assert", 1, "p", "a", 9))
    assert sorted((r["seq"], r["object"]) for r in facts.live(some).collect()) == [(1, "b"), (3, "a")]


def test_writing_again_is_suppressed(spark):
    some = log(spark, ("assert", 1, "p", "a", 5), ("assert", 1, "p", "b", 6))
    new, same = facts.suppressed(some, some)
    assert new.count() == 0 and same.count() == 2


def test_hash_of_units(spark):
    def plain(text):
        h, raw = 172505283306277, text.encode("utf-16-be")
        for i in range(0, min(len(raw), 8192), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2])) * (2**40 + 435) % 2**48
        return h

    texts = ["", "abc", "日本語", "a😀b", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fn.hash48(F.col("t"))).collect()] == [plain(t) for t in texts]


def pattern(spark, targets, coverage=0.8):
    rows = [(1, i, t, 100 + i) for i, t in enumerate(targets)]
    return patterns.mine(spark.createDataFrame(rows, "group long, id long, targets array<long>, at long"), coverage).collect()


def test_mining_thresholds(spark):
    (r,) = pattern(spark, [[7]] * 8 + [[1]] * 2)
    assert (r["first"], r["second"], r["support"], r["exceptions"]) == (7, None, 8, "8,9")
    assert pattern(spark, [[7]] * 9) == []
    (r,) = pattern(spark, [[7]] * 5 + [[3]] * 5)
    assert (r["first"], r["second"], r["support"]) == (3, 7, 10)
    assert pattern(spark, [[7]] * 5 + [[3]] * 2 + [[i] for i in (11, 12, 13)]) == []
    (r,) = pattern(spark, [[7]] * 100 + [[]] * 25)
    assert r["omitted"] == 5 and len(r["exceptions"].split(",")) == 20


def test_months(spark):
    df = spark.createDataFrame([(1577836800, 1583020800), (1577836801, 1577836900), (0, 5), (1262304000, 1583020800)], "a long, b long")
    got = [r[0] for r in df.select(patterns.month_starts(F.col("a"), F.col("b"))).collect()]
    assert got[0] == [1577836800, 1580515200, 1583020800] and got[1] == [] and got[2] == [] and len(got[3]) == 36


def test_identities(spark):
    rows = [(1, "Ann Lee", " A@x.org ", "hr"), (2, "Other", "a@X.org", "drive"), (3, "lee　ann", None, "issues"), (4, "Ann", None, "drive"), (5, "ann", None, "hr"), (6, "(deleted account)", None, "hr"), (7, "(deleted account)", None, "drive"), (8, "Ann Lee", None, None)]
    got = people.identity_pairs(spark.createDataFrame(rows, "id long, name string, email string, band string")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "email"), (1, 3, "name")]


APPROVING = [
        ("承認します", "formal"), ("LGTM!", "formal"), ("承認しますか", None), ("承認しますから", "formal"), ("not approved", None), ("not approved. Now approved", "formal"), ("進めてください, approved", "formal"), ("disapproved", None), ("未承認", None),
        ("修正いただければ承認します", None), ("Is this approved by finance?", None), ("If the tests pass this is approved", None), ("I never approved it", None), ("don't think this is approved", None), ("承認いただけますか", None),
        ("大丈夫です", "euphemism"), ("OKです", "euphemism"), ("異議ありません", "euphemism"), ("大丈夫ですか？はい、大丈夫です。", "euphemism"), ("looks good", None),
    ("大丈夫ですか。了解、承認しました？いいえ。OKです", "euphemism"), ("unless approved. lgtm", "formal"), ("approved if tests pass", "formal"), ("", None), (None, None), ("Approve? approve.", "formal"),
]


def test_approvals(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(APPROVING)], "id int, text string")
    got = {r["id"]: r["tier"] for r in people.approvals(rows).collect()}
    assert {APPROVING[k][0]: got.get(k) for k in range(len(APPROVING))} == dict(APPROVING)


def test_approvals_name_the_listed_phrase(spark):
    (r,) = people.approvals(spark.createDataFrame([(1, "x" * 60 + " lgtm " + "y" * 60)], "id long, text string")).collect()
    assert (r["tier"], r["phrase"], r["snippet"]) == ("formal", "LGTM", "x" * 39 + " lgtm " + "y" * 39)


def test_inference_tiers(spark):
    grants = spark.createDataFrame([(1, p) for p in (10, 11, 12)] + [(2, p) for p in (10, 11, 13)] + [(3, 10)], "doc long, person long")
    activity = spark.createDataFrame([(10, 5), (11, 5), (20, 5), (13, 6)], "person long, project long")
    roots = spark.createDataFrame([(12, 20), (20, 12)], "id long, other long")
    got = sorted(map(tuple, people.document_projects(grants, activity, roots).collect()))
    assert got == [(1, 5, 3, 3, "high"), (2, 5, 2, 3, "ambiguous")]
    both = spark.createDataFrame([(p, q) for p in (10, 11, 12) for q in (5, 6)], "person long, project long")
    two = people.document_projects(grants.where("doc = 1"), both, roots.limit(0))
    assert sorted(map(tuple, two.collect())) == [(1, 5, 3, 3, "high"), (1, 6, 3, 3, "high")]  # unanimous on each
    via = {(r["doc"], r["project"], r["person"]): r["via"] for r in people.supporters(grants, activity, roots).collect()}
    assert via[1, 5, 10] is None and via[1, 5, 12] == 20


def test_paths():
    known = {"p": ("A", "B"), "q": ("C", "B")}
    assert graph.path_errors(known, [graph.Hop("p"), graph.Hop("q", True)], "A", "C") == []
    assert graph.path_errors(known, [], "A", "C") and graph.path_errors(known, [graph.Hop("x")], "A", "C") and graph.path_errors(known, [graph.Hop("p"), graph.Hop("q")], "A", "B")


def test_definitions():
    link = schemas.parse_tables("CREATE TABLE x (a INT REFERENCES a(id), b INT REFERENCES b(id), level INT, CHECK (level in (1, 2)));")[0]
    assert link.is_link and [c.name for c in link.columns] == ["a", "b", "level"]
    linked = lambda sql: schemas.parse_tables(sql)[0].is_link
    assert linked("CREATE TABLE x (a INT REFERENCES t(id), b INT REFERENCES t(id), note TEXT, PRIMARY KEY (a, b))")
    assert not linked("CREATE TABLE x (a INT PRIMARY KEY REFERENCES a(id), b INT REFERENCES b(id))")
    own = schemas.parse_tables("create table if not exists e (id INT primary key, boss INT references e(id), d NUMERIC(1, 2) references d);")[0]
    assert not own.is_link and own.columns[0].pk and [c.ref for c in own.columns] == [None, "e.id", None] and own.columns[2].type == "NUMERIC"
    assert schemas.scope_of("folder:x") == ("folder", "x") and schemas.scope_of("my-drive") == ("my-drive", None)
    with pytest.raises(ValueError, match="not a scope"):
        schemas.scope_of("drive:")


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    doc = zipped(word__document_xml='<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>A &amp; &#66;</w:t><w:tab/><w:t xml:space="preserve"> c</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = zipped(xl__workbook_xml=f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {ns}><si><t>s</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c><c r="D1"/></row><row><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "a.docx").write_bytes(doc)
    (tmp_path / "b.xlsx").write_bytes(book)
    (tmp_path / "c.docx").write_bytes(b"broken")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"][-6:]: r["text"] for r in office.texts(files.where("path like '%.docx'")).collect()}
    assert got == {"a.docx": "A & B\t c\n\nEnd", "c.docx": None}
    sheets = office.rows(files.where("path like '%.xlsx'"))
    assert [(r["sheet"], r["cells"]) for r in sheets.orderBy("row").collect()] == [("One", ["s", "", "4.5"]), ("One", ["in"])]
    assert office.sheets_text(sheets).first()["text"] == "# One\ns\t\t4.5\nin"


def test_stream_keeps_the_guarded_head(spark, tmp_path):
    rows = [("assert", i % 3, "p", str(i), (i * 37) % 50) for i in range(60)]
    log(spark, *rows).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = heads.head_stream(stream).writeStream.format("memory").queryName("heads").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    want = {(r["subject"], r["object"]) for r in facts.guarded_head(log(spark, *rows)).collect()}
    assert {(r["subject"], r["object"]) for r in spark.table("heads").collect()} == want
    heads.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 60


def test_identity_groups_hold_every_pair(spark, sf_dir):
    from factloom.plans import queries as plans

    rows = [(i, "Ann  Bee" if i % 3 else "bee.ann", "A@x " if i % 4 == 0 else None, "hr" if i % 2 else "drive") for i in range(40)]
    rows += [(50, "Solo", "s@x", "hr"), (51, "Solo", None, "drive"), (52, "Cy Dee", "S@X", "other"), (53, "Cy Dee", None, "other")]
    small = spark.createDataFrame(rows, "id long, name string, email string, band string")
    for df in (small, plans.persons(spark, sf_dir)):
        groups = {}
        for r in people.identity_groups(df).collect():
            groups.setdefault((r["tier"], tuple(r["key"])), []).append(r)
        pairs = {}
        for (tier, _), members in sorted(groups.items(), reverse=True):  # names first, e-mails over them
            assert {r["first"] for r in members} == {min(r["id"] for r in members)}
            assert all(r["band_first"] == min(x["id"] for x in members if x["band"] == r["band"]) for r in members)
            pairs |= {(a["id"], b["id"]): tier for a in members for b in members if a["id"] == a["band_first"] < b["id"] == b["band_first"] and a["band"] != b["band"]}
        assert pairs == {(r["a"], r["b"]): r["tier"] for r in people.identity_pairs(df).collect()}
    ids = {r["id"] for r in plans.id_groups(spark, sf_dir).collect()}
    assert any(i % 5 >= 2 for i in ids)


def test_reviews_of_one_instant_are_apart(spark):
    rows = [("s", "k" * 300, "ok", "p", "", "ann", "n" * 600, 7), ("s", "k" * 300, "ok", "p", "", "bo", None, 7), ("s", "k" * 300, "no", "p", "e", "ann", "", 7)]
    made = catalog.review_records(spark.createDataFrame(rows, "surface string, key string, decision string, proposal string, evidence string, reviewer string, note string, at long")).collect()
    assert made[0]["id"] == made[2]["id"] != made[1]["id"] and len(made[0]["note"]) == 500


def test_undeclared_bindings_fail(spark):
    layer, bound = spark.createDataFrame([("a", 1)], "name string, x int"), spark.createDataFrame([("a", "s"), ("b", "t")], "name string, source string")
    assert catalog.composed(layer, bound.where("name = 'a'")).count() == 1
    with pytest.raises(Exception, match="undeclared: b"):
        catalog.composed(layer, bound).collect()


def test_approval_candidates(spark):
    rows = [("assert", 1, "content", "LGTM", 10), ("assert", 1, "on-issue", "100", 10), ("assert", 1, "commented-by", "7", 10), ("assert", 2, "content", "approved", 20), ("assert", 2, "on-issue", "100", 20), ("assert", 3, "content", "LGTM", 30), ("assert", 3, "on-issue", "101", 30), ("assert", 3, "commented-by", "8", 30)]
    rows += [("assert", 4, "content", "OKです", 40), ("assert", 4, "on-issue", "102", 40), ("assert", 4, "commented-by", "8", 40), ("assert", 100, "approved-by", "7", 11), ("assert", 8, "name", "Bo", 0)]
    gone = spark.createDataFrame([(4, 102)], "comment long, issue long")
    got = {r["comment"]: r for r in review.approval_candidates(log(spark, *rows), gone).collect()}
    assert set(got) == {1, 3, 4}  # 2 has no author
    assert (got[1]["confirmed"], got[1]["rank"], got[3]["rank"], got[4]["rank"], got[3]["approver_name"], got[4]["tier"]) == (True, 2, 0, 5, "Bo", "euphemism")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_scopes_list_no_trash(spark):
    files = spark.createDataFrame([("a", ["x", "y"], "d", None), ("b", ["y"], "d", True), ("c", None, None, False), ("e", ["xx"], "d", False)], "id string, parents array<string>, drive string, trashed boolean")
    assert ids(listings.listed(files, "folder", "x")) == ["a"] and ids(listings.listed(files, "drive", "d")) == ["a", "e"]
    assert ids(listings.listed(files, "my-drive")) == ["a", "c", "e"] and listings.listed(files.limit(0), "my-drive").count() == 0
    with pytest.raises(ValueError):
        listings.listed(files, "label")


def test_change_feed_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "token long, id string, removed boolean, trashed boolean, parents array<string>"
    feed, log, at = (str(tmp_path / n) for n in ("feed", "log", "at"))
    pages = [[(1, "a", None, None, ["f"]), (2, "b", True, None, None), (3, "c", False, True, ["f"])], [(4, "d", False, False, ["g"]), (5, "a", False, False, ["f", "g"])]]
    for page, seen in zip(pages, ([1], [1, 5])):
        spark.createDataFrame(page, schema).coalesce(1).write.mode("append").json(feed)
        stream = spark.readStream.schema(schema).json(feed)
        heads.append_log(listings.changed(stream, "f"), log, at).awaitTermination(120)
        assert ids(spark.read.parquet(log), "token") == seen
    assert ids(listings.changed(spark.read.schema(schema).json(feed)), "token") == [1, 4, 5]
    with pytest.raises(ValueError):
        heads.reset_log(spark, log, False)
    heads.reset_log(spark, log, True)
    assert spark.read.parquet(log).count() == 0 and "token" in spark.read.parquet(log).columns
    heads.append_log(spark.readStream.schema(schema).json(feed), log, str(tmp_path / "again")).awaitTermination(120)
    assert ids(spark.read.parquet(log), "token") == [1, 2, 3, 4, 5]


def test_shortcuts_give_way_and_grants_fill_in(spark):
    kind, schema = listings.SHORTCUT, "id string, mime string, target string, permissions array<string>, name string"
    known = spark.createDataFrame([("t", "text", None, None, "T"), ("u", kind, "t", ["own"], "U")], schema)
    files = spark.createDataFrame([("s1", kind, "t", ["shortcut"], "1"), ("s2", kind, "gone", None, "2"), ("s3", kind, None, None, "3"), ("s4", kind, "u", None, "4"), ("f", "text", "t", None, "5"), ("g", "text", None, [], "6"), (None, None, None, None, None)], schema)
    grants = spark.createDataFrame([(n, ["granted"]) for n in ("t", "s2", "s3", "g")], "id string, permissions array<string>")
    by = {(r["name"]): (r["id"], r["permissions"]) for r in listings.hydrated(files, known, grants).collect()}
    assert by == {"T": ("t", ["granted"]), "2": ("s2", None), "3": ("s3", ["granted"]), "U": ("u", ["own"]), "5": ("f", None), "6": ("g", []), None: (None, None)}


def test_a_cycle_of_polling_is_bounded(spark):
    some = spark.createDataFrame([("a", i, 1 + i % 4, "x") for i in range(300)] + [("b", 7, 1, "x"), ("c", 1, 1, "x")], "scope string, id long, type int, cursor_ string")
    cursors = spark.createDataFrame([("a", 10), ("b", 7), ("d", 3)], "scope string, cursor long")
    made = listings.polled(some, cursors)
    assert ids(made) == [i for i in range(11, 300) if i % 4 < 3][:100] and made.columns == some.columns
    assert {tuple(r) for r in listings.next_cursors(made, cursors).collect()} == {("a", ids(made)[-1]), ("b", 7), ("d", 3)}
    assert ids(listings.polled(some, listings.next_cursors(made, cursors)))[0] == next(i for i in range(ids(made)[-1] + 1, 300) if i % 4 < 3)


def test_root_of_a_drive_has_a_name(spark):
    made = listings.drive_roots(spark.createDataFrame([("d1", "Sales", 5)], "drive string, name string, at long")).first()
    want = spark.range(1).select((fn.hash48(F.lit("d1")) + fn.BANDS["folder"]).alias("id")).first()["id"]
    assert (made["subject"], made["predicate"], made["object"], made["valid_from"]) == (want, "folder-name", "Sales", 5)


def test_extracted_names_meet_across_documents(spark):
    fact = lambda s, p, o, t=None, st=None: {"subject": s, "predicate": p, "object": o, "objectType": t, "subjectType": st}
    said = [(1, "Here: " + json.dumps({"facts": [fact("Ann Lee", "on", "Apollo", "Project"), fact("Ann Lee", "", "x"), fact("", "on", "x")]})), (2, json.dumps({"facts": [fact(" ANN lee ", "age", "41", "Number"), fact("Apollo", "owner", "Ann Lee", None, "Project")]})), (3, "nothing"), (4, None), (5, "{broken}")]
    nodes, made = events.extracted_facts(spark.createDataFrame(said, "doc long, answer string"), spark.createDataFrame([("age",)], "predicate string"))
    named = {(r["type"], r["name"]): r["id"] for r in nodes.collect()}
    assert set(named) == {("Person", "Ann Lee"), ("Project", "Apollo")}
    ann, apollo = named["Person", "Ann Lee"], named["Project", "Apollo"]
    assert {tuple(r) for r in made.collect()} == {(ann, "on", str(apollo), True, "doc:1"), (ann, "age", "41", True, "doc:2"), (apollo, "owner", "Ann Lee", True, "doc:2")}


def test_proposed_relations_fit_their_types(spark):
    declared = spark.createDataFrame([("in", "A", "B"), ("of", "B", "C")], "name string, from string, to string")
    hop = lambda *names: [(n.strip("~"), "reverse" if n[0] == "~" else "forward") for n in names]
    rows = [
        (1, "fits", "A", "C", "many", hop("in", "of")),
        (2, "back", "C", "A", "one", hop("~of", "~in")),
        (3, "wrong", "A", "B", "many", hop("in", "of")),
        (4, "wrong", "A", "C", "many", hop("in", "of")),  # the first of a name decides, though it doesn't fit
        (5, "empty", "A", "A", "many", []),
        (6, "unknown", "A", "C", "many", hop("in", "no")),
        (7, "shape", "A", "C", "few", hop("in", "of")),
        (8, "way", "A", "C", "one", [("in", "forward"), ("of", None)]),
        (9, "shape", "A", "C", "one", hop("in", "of")),
        (10, None, "A", "C", "one", hop("in", "of")),
        (11, "nopath", "A", "A", "one", None),
    ]
    some = spark.createDataFrame(rows, "ord int, name string, from string, to string, cardinality string, path array<struct<predicate: string, direction: string>>")
    assert ids(graph.proposed_relations(some, declared), "ord") == [1, 2, 9]
    assert graph.proposed_relations(some.limit(0), declared).count() == 0


def test_roles_of_a_mapping_without_predicates_or_types(spark):
    types = spark.createDataFrame([(1, t, t[0]) for t in ("employees", "projects", "skills")], "mapping int, table string, type string")
    predicates = spark.createDataFrame([(2, 1, "p", "e", "s", "one", None, None)], "mapping int, ord int, name string, from string, to string, cardinality string, properties array<string>, valid_end string")
    by = {r["mapping"]: (r["has"], r["assigned"], r["error"]) for r in graph.role_plan(predicates, types).collect()}
    assert by == {1: (None, [], "no predicate from person to skill"), 2: (None, [], "skills aren't entities")}


def test_supporters_are_the_first_by_breadth(spark):
    """Chains, stars and rings: what a plain walk from each person finds first."""
    import random

    for seed in range(3):
        r = random.Random(seed)
        edges = [(i, i + 1) for i in range(1, 8)] + [(20, 20 + k) for k in range(1, 6)] + [(30 + k, 30 + (k + 1) % 6) for k in range(6)] + [(r.randrange(40, 60), r.randrange(40, 60)) for _ in range(25)]
        active = {(p, r.randrange(3)) for p in r.sample(range(1, 60), 12)}
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        want = {}
        for start in range(1, 60):
            order, steps = [start], {start: 0}
            for x in order:
                for y in sorted(near.get(x, ())):
                    if y not in steps:
                        steps[y] = steps[x] + 1
                        order.append(y)
            for x in order:
                for p, q in sorted(active):
                    if p == x and (start, q) not in want:
                        want[start, q] = (x, steps[x])
        links = spark.createDataFrame([e for a, b in edges for e in ((a, b), (b, a))], "id long, other long")
        got = people.nearest_accounts(spark.createDataFrame(sorted(active), "person long, project long"), links)
        assert {(x["person"], x["project"]): (x["via"], x["steps"]) for x in got.collect()} == want


def test_identities_against_what_is_stored(spark):
    rows = [(1, "Ann Lee", None, "hr"), (2, "lee ann", "a@x", "issues"), (3, "Ann", "A@X", "drive"), (4, "Bo Ek", None, "hr"), (5, "Bo Ek", None, "hr"), (6, "Cy Or", None, "hr"), (7, "Cy Or", None, "drive")]
    groups = people.evidence_groups(spark.createDataFrame(rows, "id long, name string, email string, band string"))
    assert {tuple(x) for x in groups.collect()} == {(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)}
    pair = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    state = lambda stored, gone: {tuple(x) for x in people.identity_state(groups, stored, gone).collect()}
    assert state(pair((3, 2), (4, 5), (3, 2)), pair((7, 6))) == {(2, 3, "confirmed"), (4, 5, "unfounded"), (1, 2, "open"), (6, 7, "dismissed")}
    assert state(pair((1, 3), (2, 3), (6, 7)), pair()) == {(1, 3, "confirmed"), (2, 3, "confirmed"), (6, 7, "confirmed")}


def estimated(df, capsys):
    """What Spark takes a table's size for, as text."""
    capsys.readouterr()
    df.explain("cost")
    return re.search(r"sizeInBytes=([^,)]*)", capsys.readouterr().out)[1]


def test_closure_of_a_long_path_with_hot_labels_keeps_estimates_small(spark, capsys):
    """A size that doubles its digits each round takes the driver's memory at some twenty rounds."""
    roots = graph.closure(spark.range(1500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert estimated(roots, capsys).endswith("KiB")
    assert sorted(map(tuple, roots.collect())) == [(k, 0) for k in range(1501)]
