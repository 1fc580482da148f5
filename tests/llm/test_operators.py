"""Each operator against plain Python on a small table with every odd case, and on an empty one."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import exact_dedup, fingerprints, licenses, merge_dropout, near_dedup, packing, queries, secrets, token_files, toxicity, warc

from .conftest import LONG, SCHEMA


def tokens(name, text):
    t = Tokenizer.from_file(queries.vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1 token files


def test_token_files(spark, odd, odd_texts, tmp_path):
    made = token_files.write_tokens(odd, str(tmp_path / "t"), queries.vocabulary("byte_bpe_50k.json"), 2, sequence_length=64, batch_rows=4)
    got = sorted(token_files.read_documents(spark, made).collect(), key=lambda r: r["start"])
    want = Counter((i, crc(tokens("byte_bpe_50k.json", t) + [2])) for i, t in odd_texts)
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in odd_texts), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]


def test_token_files_random_access(spark, odd, tmp_path):
    made = token_files.write_tokens(odd, str(tmp_path / "t"), queries.vocabulary("byte_bpe_50k.json"), 2, sequence_length=64, batch_rows=4).collect()
    docs = {r["shard"]: r for r in made}
    for m in docs.values():
        shard = token_files.Shard(f"{m['path']}.tokens.arrows")
        flat = np.concatenate(list(shard.batches()))
        for i in (0, m["n_sequences"] // 2, m["n_sequences"] - 1):
            assert (shard.sequence(i) == flat[i * 64 : i * 64 + 64]).all()
            assert shard.mask(i).sum() == min(64, m["n_tokens"] - 64 * i)
        with pytest.raises(IndexError):
            shard.sequence(m["n_sequences"])


def test_token_files_empty(spark, none, tmp_path):
    assert token_files.read_documents(spark, token_files.write_tokens(none, str(tmp_path / "e"), queries.vocabulary("byte_bpe_50k.json"), 2)).count() == 0


# 2 exact dedup


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_exact_dedup(odd, odd_texts, share):
    groups = defaultdict(list)
    for i, t in odd_texts:
        groups[lowered(t)].append(i)
    top = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    got = exact_dedup.dedup_report(odd, share).collect()
    want = sorted(((i, top[lowered(t)], len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in odd_texts), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_with_few_ids_in_history(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 10)
    asked = []
    monkeypatch.setattr(exact_dedup, "_probes", lambda n, shards, of=exact_dedup._probes: asked.append((n, shards, of(n, shards))) or asked[-1][2])
    rows = [(0, "text 3")] + [(10**9 + i, f"text {i % 80}") for i in range(100)]  # one small id, the rest far above
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string"), 0.0).collect()}
    assert asked == [(80, 1, 8)]
    last = {t: i for i, t in rows}
    assert got == {i: last[t] for i, t in rows}


def test_exact_dedup_keeps_one_row_each(odd, none):
    out = exact_dedup.winners_only(odd)
    assert out.columns == odd.columns
    texts = [lowered(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {lowered(r["text"]) for r in odd.collect()}
    assert exact_dedup.winners_only(none).count() == 0 and exact_dedup.dedup_report(none).count() == 0


def test_perfect_hash_has_every_slot_once():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    shard = exact_dedup.build_shard(digests, np.arange(5000), np.ones(5000, np.int64))
    assert sorted(exact_dedup.find(shard, digests).tolist()) == list(range(5000))
    assert (exact_dedup.find(shard, [hashlib.sha256(f"x{i}".encode()).digest() for i in range(5000)]) == -1).all()


# 3 packing


def test_packing(odd, odd_texts, none):
    some = queries.written(queries.with_crc(packing.pieces(odd, queries.vocabulary("word_bpe_49k.json"), 1)), "p")
    got = packing.pack(some).collect()
    want = Counter()
    for i, t in odd_texts:
        ids = tokens("word_bpe_49k.json", t) + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(i, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_gapless(got, 4096)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= total // 4096 + 2
    assert packing.pack(queries.written(queries.with_crc(packing.pieces(none, queries.vocabulary("word_bpe_49k.json"), 1)), "p")).count() == 0


def check_gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_sequences_hold_the_ids(spark, odd):
    made = packing.pack(queries.written(packing.pieces(odd, queries.vocabulary("word_bpe_49k.json"), 1), "p")).cache()
    seqs = packing.sequences(made).collect()
    pieces = made.collect()
    assert sum(len(s["ids"]) for s in seqs) == sum(len(p["ids"]) for p in pieces)
    by = {s["sequence_id"]: bytes(s["ids"]) for s in seqs}
    assert all(by[p["sequence_id"]][4 * p["offset"] : 4 * (p["offset"] + p["length"])] == p["ids"] for p in pieces)


def test_pack_passes_other_columns_on(spark):
    rows = [(i, 0, 0, 1 + i % 7, "n", i, 5.0, "a", 3, 9) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, n string, first long, sequence double, __bucket string, offset long, sequence_id int")
    made = packing.pack(queries.written(df, "p"), 10)
    assert made.columns == ["doc_id", "piece", "start", "length", "n", "first", "sequence", "__bucket", "sequence_id", "offset"]
    got = made.collect()
    assert sorted((r["doc_id"], r["n"], r["first"], r["__bucket"]) for r in got) == [(i, "n", i, "a") for i in range(300)]
    check_gapless(got, 10)


def test_plan_uses_all_and_fills_well():
    r = random.Random(3)
    lengths = Counter(r.choice([r.randint(1, 300), r.randint(1, 4096), 4096]) for _ in range(5000))
    plan = packing.plan(dict(lengths))
    used = Counter()
    for some, n in plan:
        assert sum(some) <= 4096
        for x in some:
            used[x] += n
    assert used == lengths
    assert sum(n for _, n in plan) <= -(-sum(k * v for k, v in lengths.items()) // 4096) * 1.02 + 1


# 4 secrets


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, odd, odd_texts, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (odd, docs):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in queries.secret_digests(secrets.scan(df)).collect():
            if r["doc_id"] in (None, 10, 12):
                continue
            want = base_spans(texts[r["doc_id"]] or "")
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    assert secrets.scan(odd).count() == len(odd_texts) and secrets.scan(none).count() == 0


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('key = "Zk81kdPq02mmXa91"\ndb_password = key', "Zk81kdPq02mmXa91"),
        ('{"client_secret": "9fK2mmQp81XzLw"}', "9fK2mmQp81XzLw"),
        ("cfg['private_key'] = 'Qp81XzLw9fK2mm'", "Qp81XzLw9fK2mm"),
        ("ACCESS_KEY=Qp81XzLw9fK2mm", "Qp81XzLw9fK2mm"),
        ('a = "Qp81Xz" + "Lw9fK2mmZZ"\nauth_token = a', "Lw9fK2mmZZ"),
        ('db_password = key\nkey = part\npart = "Zk81kdPq02mmXa91"', "Zk81kdPq02mmXa91"),
        ('a = b\nb = a\nb = a + "Zk81kdPq02mmXa91"\nsecret_key = b', "Zk81kdPq02mmXa91"),
    ],
)
def test_assignments_reach_sensitive_names(text, value):
    assert value in {text[a:b] for a, b, s in secrets.literals(text) if s >= secrets.THRESHOLD}
    assert value not in secrets.redacted(text, "[SECRET]")


@pytest.mark.parametrize("text", ['colour = "Zk81kdPq02mmXa91"', 'password = "changeme"', "token_count = 123456789", "the secret of the house", 'password_hint: "first pet name"'])
def test_harmless_assignments(text):
    assert [x for x in secrets.literals(text) if x[2] >= secrets.THRESHOLD] == []


def test_every_literal_of_a_name_reaches_its_target():
    values = [hashlib.sha256(str(i).encode()).hexdigest()[:20].upper() for i in range(40)]
    text = f'pem = "{values[0]}"\n' + "".join(f'pem = pem + "{v}"\n' for v in values[1:]) + "private_key = pem\n"
    assert {text[a:b] for a, b, s in secrets.literals(text) if s >= secrets.THRESHOLD} == set(values)
    assert not any(v in secrets.redacted(text, "[SECRET]") for v in values)
    doubled = 'a = "Zk81kdPq02mmXa91"\n' + "a = a + a\n" * 2000 + "password = a\n" * 2000
    assert [doubled[a:b] for a, b, s in secrets.literals(doubled) if s >= secrets.THRESHOLD] == ["Zk81kdPq02mmXa91"]


def test_redact_keeps_rows_and_columns(odd, none):
    out = secrets.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and secrets.redact(none).count() == 0
    text = out.where("doc_id = 30").first()["text"]
    assert "Zk81kdPq02mmXa91" not in text and "AKIA" not in text and "password = x" in text and text.count("[SECRET]") == 3


SECRET_A, SECRET_B = "Zk81kdPq02mmXa91", "Qw91mdPz73kkLb20"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f'password: str = "{SECRET_A}"\napi_token: str = "{SECRET_B}"', [SECRET_A, SECRET_B]),
        (f'let client_secret: Option<String> = "{SECRET_A}";\nconst token: string | null = "{SECRET_B}"', [SECRET_A, SECRET_B]),
        (f'val apiKey: String? = "{SECRET_A}"', [SECRET_A]),
        (f'apiKey = cfg.get("{SECRET_A}", other("x"))', [SECRET_A]),
        ('token = os.environ.get("API_TOKEN")', []),
        (f'password = \'\'\'{SECRET_A}\'\'\'', [SECRET_A]),
        (f"a:\n  password: |\n    {SECRET_A}\n\n    {SECRET_B}\n  other: {SECRET_B}", [SECRET_A, SECRET_B]),
        (f"<user>x</user><password>{SECRET_A}</password>", [SECRET_A]),
        (f'db.pass = "{SECRET_A}"', [SECRET_A]),
        (f'if (token == "{SECRET_A}") pass', []),
        (f'def f(password: str = "{SECRET_A}", n: int = 3): pass', [SECRET_A]),
    ],
)
def test_syntaxes_of_assignments(text, found):
    assert [text[a:b] for a, b, s in secrets.literals(text) if s >= secrets.THRESHOLD] == found


def test_code_is_not_masked():
    assert secrets.redacted(f'apiKey = cfg.get("{SECRET_A}")', "*") == 'apiKey = cfg.get("*")'
    assert secrets.redacted(f'let client_secret: Option<String> = "{SECRET_A}"', "*") == 'let client_secret: Option<String> = "*"'
    assert secrets.redacted('token = os.environ.get("API_TOKEN")', "*") == 'token = os.environ.get("API_TOKEN")'


# 5 revisits


def test_revisits(spark):
    head = lambda **kw: [(k.replace("_", "-"), v) for k, v in sorted(kw.items())]
    at = "2020-01-01 00:00:{:02d}"
    rows = [
        ("a", "response", "http://Host.example/x#f", at.format(1), head(etag='"1"', content_type="t", cache_control="old"), "first"),
        ("b", "response", "https://www.host.example:443/x", at.format(5), head(etag='"2"'), "second"),
        ("c", "revisit", "http://host.example/x?utm_source=q", at.format(5), head(etag='W/"1"', cache_control="new", content_length="0"), None),
        ("d", "revisit", "http://host.example/x", at.format(6), head(etag='"1"'), None),
        ("e", "revisit", "http://host.example/x", at.format(7), head(etag='"2"'), None),
        ("e", "revisit", "http://host.example/x", at.format(7), head(etag='"2"'), None),
        ("f", "revisit", "http://host.example/x", at.format(0), head(etag='"1"'), None),
        ("g", "revisit", "http://host.example/x", at.format(8), [], None),
        ("h", "revisit", None, at.format(8), head(etag='"1"'), None),
        (None, "revisit", "http://host.example/x", None, None, None),
    ]
    schema = "record_id string, kind string, url string, date string, headers array<struct<name: string, value: string>>, payload string, status string, key int, http_status int, profile string"
    df = spark.createDataFrame([(*r, "clash", 1, None, None) for r in rows], schema).withColumn("date", F.to_timestamp("date")).withColumn("payload", F.encode("payload", "UTF-8"))
    got = warc.resolve(df).collect()
    assert Counter((r["record_id"], r["status"], r["refers_to"], r["payload"]) for r in got) == Counter(
        [("c", "resolved", "a", b"first"), ("d", "mismatch", None, None), ("e", "resolved", "b", b"second"), ("e", "resolved", "b", b"second"), ("f", "no_earlier", None, None), ("g", "no_validator", None, None), ("h", "no_earlier", None, None), (None, "no_earlier", None, None)]
    )
    merged = next(r for r in got if r["record_id"] == "c")["headers"]
    assert {(h["name"], h["value"]) for h in merged} == {("cache-control", "new"), ("content-type", "t"), ("etag", 'W/"1"')}
    assert warc.resolve(df.limit(0)).count() == 0


def test_hot_url_is_cut_into_chunks(spark):
    """One URL holds most rows; the answer is that of a plain scan."""
    r = random.Random(5)
    rows = [(f"{'r' if full else 'v'}{i:04d}", "response" if full else "revisit", "http://h.example/hot" if r.random() < 0.7 else f"http://h.example/{i % 50}", i + 1, [("etag", '"e"')], "p" if full else None) for i in range(1500) for full in [r.random() < 0.1]]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, t long, headers array<struct<name: string, value: string>>, payload string").withColumn("date", F.timestamp_seconds("t")).withColumn("payload", F.encode("payload", "UTF-8")).withColumn("http_status", F.lit(200)).withColumn("profile", F.lit(None).cast("string"))
    last, want = {}, {}
    for record, kind, url, _, _, _ in rows:
        if kind == "response":
            last[url] = record
        else:
            want[record] = last.get(url)
    assert {x["record_id"]: x["refers_to"] for x in warc.resolve(df).collect()} == want


def test_warc_file(spark, tmp_path):
    import gzip

    def record(kind, id_, date, http, body=b""):
        block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{id_}>\r\nWARC-Target-URI: http://h.example/\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    parts = [record("warcinfo", "i", "2020-01-01T00:00:00Z", b"x: y"), record("response", "r", "2020-01-01T00:00:00Z", b'ETag: "1"', b"hello\r\n\r\nworld"), record("revisit", "v", "2020-01-02T00:00:00Z", b'ETag: "1"')]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts))
    for name in ("a.warc.gz", "b.warc"):
        got = warc.resolve(warc.read_warc(spark, str(tmp_path / name))).collect()
        assert [(r["record_id"], r["status"], r["payload"]) for r in got] == [("<v>", "resolved", b"hello\r\n\r\nworld")]


def test_only_full_responses_are_a_base(spark):
    """A 404, a 206 and a redirect are no base, an identical-digest revisit isn't a not-modified one."""
    one = lambda id_, kind, s, status, profile, payload=None: (id_, kind, "http://h.example/x?ref=main", s, status, profile, [("etag", '"1"')], payload)
    rows = [one("full", "response", 1, 200, None, b"\xff\x00"), one("gone", "response", 2, 404, None, b"e"), one("part", "response", 3, 206, None, b"p"), one("moved", "response", 4, 301, None, b""), one("v", "revisit", 5, 304, "http://netpreserve.org/warc/1.1/revisit/server-not-modified"), one("w", "revisit", 6, 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("o", "revisit", "http://h.example/x?ref=dev", 7, 304, None, [("etag", '"1"')], None)]
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, t long, http_status int, profile string, headers array<struct<name: string, value: string>>, payload binary").withColumn("date", F.timestamp_seconds("t"))
    assert {(r["record_id"], r["status"], r["refers_to"], bytes(r["payload"] or b"")) for r in warc.resolve(df).collect()} == {("v", "resolved", "full", b"\xff\x00"), ("w", "other_profile", None, b""), ("o", "no_earlier", None, b"")}


def test_odd_warc_files():
    """Repeated fields stay apart, bytes are kept, bad dates are null, bad lengths and cut files end without an error."""
    import gzip
    import io

    def record(kind="response", http=b"HTTP/1.1 404 Gone\r\nLink: a\r\nlink: b\r\nX: \xe9", body=b"\xff\x00", date="2020-01-01T00:00:00Z", length=None):
        block = http + b"\r\n\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Profile: p\r\nWARC-Date: {date}\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"

    read = lambda data: list(warc.parse_records(io.BytesIO(data)))
    (r,) = read(record())
    assert (r["http_status"], r["profile"], r["payload"], r["url"], [(h["name"], h["value"]) for h in r["headers"]]) == (404, "p", b"\xff\x00", None, [("link", "a"), ("link", "b"), ("x", "é")])
    assert read(record(date="some day"))[0]["date"] is None and len(read(b"junk\r\n" + record() + record())) == 2
    assert len(read(record() + record(length="many") + record())) == 1 and len(read(record() + record()[:-30])) == 1
    packed = gzip.compress(record() * 3)
    assert len(list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(packed[:-40]))))) <= 3 and list(warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(b"no gzip")))) == []


# 6 merge-dropout


def test_without_dropout_it_is_the_librarys(odd_texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    own = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 1, 0.0, 1)
    texts = [t for _, t in odd_texts if t and "▁" not in t] + ["  two  spaces ", "a" * 300, "f(x)=_y²;\n\tif (z) {"]
    assert [array("H", own.encode(t)).tolist() for t in texts] == [sp.encode(t) for t in texts]


def test_dropout_varies_and_decodes(odd, none, odd_texts):
    path = queries.vocabulary("piece_bpe_32k.model")
    plain = merge_dropout.encode(odd, path, dropout=0.0)
    for seed in (1, 2):
        some = merge_dropout.encode(odd, path, seed=seed).cache()
        assert Counter((r["doc_id"], r["text"]) for r in merge_dropout.decode(some, path).collect()) == Counter((i, t or "") for i, t in odd_texts)
        assert some.agg(F.sum("n_tokens")).first()[0] > plain.agg(F.sum("n_tokens")).first()[0]
    one, two = (rows_of(merge_dropout.encode(odd, path, seed=s), "doc_id", "ids") for s in (1, 1))
    assert one == two != rows_of(merge_dropout.encode(odd, path, seed=2), "doc_id", "ids")
    assert merge_dropout.encode(none, path).count() == 0


def test_dropout_draws_for_each_chunk_of_each_text():
    own = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 1, 0.1, 2)
    word, texts = "▁international", [own.encode(" ".join(["international"] * 40), turn) for turn in range(50)]
    assert len(set(texts)) == 50  # not two for all documents
    made = Counter(own._again(word, int(gap), key) if gap < own._made(word, ())[0] else own._made(word, ())[1] for key, gap in enumerate(own._gaps(0, 20000)[0]))
    plain = Counter(own.segment(word, (lambda r: lambda: r.random() < own.below / 2**16)(random.Random(i))) for i in range(20000))
    assert len(made) > 10
    for i, gap in enumerate(own._gaps(0, 200)[0].tolist()):  # long chunks take the same draws in one pass
        key = merge_dropout._mixed(i)
        assert own.segment(word, own._in_turn(gap, key).__next__) == (own._again(word, gap, key) if gap < own._made(word, ())[0] else own._made(word, ())[1])
    for ids in set(made) | set(plain):
        assert abs(made[ids] - plain[ids]) < 5 * (2 * max(made[ids], plain[ids], 1)) ** 0.5 + 5


def agenda(pieces, chunk, skipped):
    """Merges in plain Python: of all neighbours that make a piece, the best, leftmost one that isn't skipped yet."""
    at, gone, n = list(chunk), set(), 0
    ends = list(range(1, len(chunk) + 1))
    while True:
        some = [(pieces.rank[a + b], i) for i, (a, b) in enumerate(zip(at, at[1:])) if a + b in pieces.rank and (ends[i], a, b) not in gone]
        if not some:
            return at
        _, i = min(some)
        if skipped(n):
            gone.add((ends[i], at[i], at[i + 1]))
        else:
            at[i : i + 2], ends[i : i + 2] = [at[i] + at[i + 1]], [ends[i + 1]]
        n += 1


def test_agendas_follow_the_plain_one():
    own = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 4, 0.3)
    named = lambda at: [own.pieces.piece[r] for r in at]
    for chunk in ("▁international", "▁aaaaabaaaaab", "unbelievably", "x", "▁", "▁mississippississippi"):
        for seed in range(40):
            skips = tuple(k for k in range(60) if random.Random(seed * 100 + k).random() < 0.3)
            count = iter(range(1000))
            want = agenda(own.pieces, chunk, lambda n: n in skips)
            assert named(own._short(chunk, skips)[1]) == want == named(own._long(chunk, lambda: next(count) in skips))


def test_texts_take_the_draws_of_their_chunks(odd_texts):
    """A whole encoding from the keyed hash and the plain agenda."""
    own = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 3, 0.4)
    mark = merge_dropout.MARK
    for turn, (_, text) in enumerate((i, t) for i, t in odd_texts if t and len(t) < 2000 and mark not in t):
        key, ids = merge_dropout._mixed((turn + 3 * 0x9E3779B97F4A7C15) & merge_dropout.MASK), []
        for i, chunk in enumerate(own.pieces.chunks(mark + text.replace(" ", mark))):
            x, place, skips = merge_dropout._mixed((key + i) & merge_dropout.MASK), -1, set()
            while place < 3000:
                place += 1 + int(-np.log(((x >> 11) + 0.5) * 2.0**-53) * own.scale)
                skips.add(place)
                x = merge_dropout._mixed((x + 0x9E3779B97F4A7C15) & merge_dropout.MASK)
            for p in agenda(own.pieces, chunk, skips.__contains__):
                ids += [own.pieces.id[p]] if p in own.pieces.id else [own.pieces.byte[b] for b in p.encode()]
        assert array("H", own.encode(text, turn)).tolist() == ids


# 7 toxicity


def test_toxicity_holds_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 != 0"))
    held = labels.where("doc_id % 3 = 0").join(toxicity.score(docs.select("doc_id", "text"), model), "doc_id").collect()
    right = [(r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in held]
    assert sum(right) / len(right) > 0.95
    assert np.mean([r["expected_severity"] for r in held if r["toxic"]]) > 3 * np.mean([r["expected_severity"] for r in held if not r["toxic"]])


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(0)
    x = (r.random((600, 5)) < 0.4).astype(float)
    grades = np.clip((x @ np.array([1.5, 1.5, 1, 0, -1]) + r.normal(0, 0.4, 600)).round().astype(int), 0, 3)
    weights, thetas = toxicity.fit(np.nonzero(x), x.shape, grades, 4)
    assert (np.diff(thetas) > 0).all() and weights[0] > weights[2] > weights[4]


def test_toxicity_edge_cases(odd, none):
    model = toxicity.Model({"idiot": 3.0}, (1.0, 2.0))
    out = toxicity.clean(odd, model, 0.5)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert toxicity.clean(odd.withColumn("text", F.concat(F.col("text"), F.lit(" IDIOT"))), model, 0.5).where("text is not null").count() == 0
    assert toxicity.clean(none, model, 0.5).count() == 0 and toxicity.score(none, model).count() == 0
    empty = toxicity.train(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.clean(odd, empty, 0.5).count() == odd.count()


def labelled(n):
    """Toxic texts hold most of six words, clean ones of six others; all share some more."""
    r = random.Random(n)
    words = lambda stem: [f"{stem}{k}" for k in range(6) if r.random() < 0.9]
    return [(i, " ".join(words("bad" if i % 2 else "good") + [f"any{r.randrange(30)}" for _ in range(5)]), i % 2) for i in range(n)]


@pytest.mark.parametrize("n", [10, 36, 44, 2000])
def test_features_do_not_depend_on_the_size_of_the_sample(spark, n):
    df = spark.createDataFrame(labelled(n), "doc_id int, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), rate=0.05)
    assert len(model.weights) >= 6 and sum(w[:3] == "any" for w in model.weights) <= 3 and len(model.thetas) == 1
    told = toxicity.score(df.select("doc_id", "text", F.lit("x").alias("Grade")), model).join(df.drop("text"), "doc_id").collect()
    assert all((r["p_toxic"] >= 0.5) == (r["toxic"] == 1) and abs(r["expected_severity"] - r["p_toxic"]) < 1e-12 for r in told)


def test_discoveries_are_those_of_the_plain_rule():
    r = np.random.default_rng(2)
    p, times = np.concatenate([r.random(300), r.random(30) * 1e-4]), r.integers(1, 5, 330)
    each = np.sort(np.repeat(p, times))
    under = [x for k, x in enumerate(each, 1) if x * len(each) <= 0.05 * k]
    assert (toxicity.discoveries(p, times, 0.05) == (p <= max(under))).all()
    assert not toxicity.discoveries(np.ones(3), np.ones(3, int), 0.05).any()
    assert abs(toxicity.tails(np.array([5]), np.array([5]), 5, 10)[0] - 2 / 252) < 1e-12 and toxicity.tails(np.array([4]), np.array([2]), 5, 10)[0] == 1.0


def test_training_on_odd_labels(spark):
    """Repeated ids and labels are one example each, null labels none; few rows give a model or none, never an error."""
    rows = labelled(40)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 3 + [(1, "other text of a repeated id"), (None, "x")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] * 2 + [(3, None), (999, 1), (None, 1)], "doc_id int, toxic int")
    model = toxicity.train(docs, labels, rate=0.05)
    assert sum(w[:3] != "any" for w in model.weights) >= 6
    for n in (0, 1, 2, 3):
        assert toxicity.train(docs, labels.limit(n)).weights == {}


def test_three_given_grades_against_a_reference_fit(spark):
    """The likelihood is that of a plain search over all parameters, the grades are those of the labels."""
    r = random.Random(4)
    rows = []
    for i in range(300):
        a, b = r.random() < 0.5, r.random() < 0.4
        rows.append((i, " ".join(["w"] * 1 + ["alpha"] * a + ["beta"] * b), min(2, max(0, round(1.2 * a + 0.9 * b + r.gauss(-0.3, 0.5)))) * 10))
    df = spark.createDataFrame(rows, "doc_id int, text string, level int")
    model = toxicity.train(df, df, "level", rate=0.05)
    assert set(model.weights) == {"alpha", "beta"} and len(model.thetas) == 2
    x, y = np.array([["alpha" in t, "beta" in t] for _, t, _ in rows], float), np.array([g // 10 for _, _, g in rows])

    def loss(v):
        cum = np.column_stack([np.zeros(300), *(1 / (1 + np.exp(-(t - x @ v[:2]))) for t in (v[2], v[2] + np.exp(v[3]))), np.ones(300)])
        return -np.log(cum[np.arange(300), y + 1] - cum[np.arange(300), y]).sum() + 0.05 * (v[:2] ** 2).sum()

    best, step = np.zeros(4), 1.0
    while step > 1e-5:  # a pattern search
        moves = [best + step * s * np.eye(4)[k] for k in range(4) for s in (1, -1)]
        lead = min(moves, key=loss)
        best, step = (lead, step) if loss(lead) < loss(best) else (best, step / 2)
    own = np.array([model.weights["alpha"], model.weights["beta"], model.thetas[0], np.log(model.thetas[1] - model.thetas[0])])
    assert loss(own) <= loss(best) + 0.02
    told = toxicity.score(df.select("doc_id", "text"), model).collect()
    assert {r["grade"] for r in told} <= {0, 1, 2} and len({round(r["expected_severity"], 6) for r in told}) == 4


# 8 licenses


def test_licenses(spark, odd, none, odd_texts, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mit, apache, gpl = (licenses.TEMPLATES[n] for n in ("MIT-text", "Apache-2.0-header", "GPL-3.0-header"))
    wrapped = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    paragraphs = apache.replace(" Unless required", "\n\nUnless required").replace(" You may obtain", "\n\nYou may obtain")
    texts = [
        "code\n\n" + wrapped(mit, 12) + "\n\nmore", mit.replace("sublicense", "grant"), mit[: len(mit) // 2], "x = 1\n" + paragraphs + "\ny = 2\n" * 3, wrapped(gpl, 7).replace("\n", "\n * "),
        "before\nThis work is licensed under the GNU\nGeneral Public License, version 3.\nafter", "Released under the\nMIT License.\nReleased under the MIT License.\n\nthe MIT license", "under the under the under the MIT License\n" * 4,
    ]
    extra = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, row int")
    for df in (docs, odd, extra):
        want = Counter((r["doc_id"], *x) for r in df.collect() for x in brute_runs(r["text"] or ""))
        assert Counter(tuple(r) for r in licenses.scan(df).collect()) == want
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(extra).collect()}
    assert {(0, "MIT-text"), (1, "MIT-text"), (3, "Apache-2.0-header"), (4, "GPL-3.0-header"), (5, "GPL-3.0"), (6, "MIT")} <= found and not any(i == 2 for i, _ in found)
    assert licenses.scan(none).count() == 0
    assert {r["license"] for r in licenses.scan(odd).collect()} == {"Apache-2.0", "MIT"}


def test_long_texts_are_searched_in_parts(spark, monkeypatch):
    """Notices that lie across parts, lines longer than a part, and many notices: what a whole search finds, in a time that
    grows with the text."""
    mit, apache, gpl = (licenses.TEMPLATES[n] for n in ("MIT-text", "Apache-2.0-header", "GPL-3.0-header"))
    wrapped = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    filler = lambda k, n: "\n".join(" ".join(f"w{(k * 37 + i * 11 + j) % 400}" for j in range(7)) for i in range(n))
    texts = ["\n\n".join(x for k in range(3) for x in (filler(k, 23 + k), wrapped((mit, apache, gpl)[k % 3], 9 + k))), " ".join(filler(k, 90).replace("\n", " ") for k in range(4)) + "\n" + wrapped(mit, 10) + "\n" + filler(9, 60), "\n".join([wrapped(apache, 30)] * 7), filler(1, 90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = Counter((i, *x) for i, t in enumerate(texts) for x in brute_runs(t))
    assert len(want) >= 10
    monkeypatch.setattr(licenses, "LETTERS", 1)
    for part in (1, licenses.PART):
        assert Counter(tuple(r) for r in licenses.scan(df, part=part).collect()) == want
    many = spark.createDataFrame([(1, "\n\n".join([wrapped(mit, 8)] * 60))], "doc_id int, text string")
    assert licenses.scan(many).where("license = 'MIT-text'").count() == 60


def brute_runs(text):
    """All runs of lines against all templates, without bounds."""
    lines = [licenses.template_words(x) for x in text.split("\n")]
    at = [(w, i) for i, x in enumerate(lines) for w in x]
    pairs = [(f"{a[0]} {b[0]}", a[1], b[1]) for a, b in zip(at, at[1:])]
    found = []
    for name, template in licenses.TEMPLATES.items():
        known = licenses.template_bigrams(template)
        for first in {a for g, a, _ in pairs if g in known}:
            for last in {b for g, _, b in pairs if g in known and b >= first}:
                own = Counter(g for g, a, b in pairs if a >= first and b <= last)
                dice = 2.0 * (own & known).total() / (own.total() + known.total())
                if dice >= licenses.THRESHOLD:
                    found.append((first, last, name, dice))
    better = lambda x, y: (-x[3], *x[:3]) < (-y[3], *y[:3])
    return [y for y in found if not any(x[0] <= y[1] and x[1] >= y[0] and better(x, y) for x in found)]


# 9 near-dedup


def similar(a, b):
    """By a plain dynamic programme over occurrence-labelled k-mers."""

    def grams(text):
        words, seen, out = near_dedup.words_of(text), Counter(), []
        some = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)]
        for g in some:
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    x, y = grams(a), grams(b)
    row = [0] * (len(y) + 1)
    for g in x:
        last = row[:]
        for j, h in enumerate(y):
            row[j + 1] = last[j] + 1 if g == h else max(last[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1] or "", rows[j][1] or ""
            n, k = len(near_dedup.words_of(a)), len(near_dedup.words_of(b))
            if find(i) != find(j) and min(n, k) >= 0.5 * max(n, k) and similar(a, b) >= 0.8:
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r[0])
    return sorted((sorted(x, key=repr) for x in out.values()), key=repr)


def made_classes(df):
    out = defaultdict(list)
    for r in near_dedup.classes(df).collect():
        out[r["class_id"]].append(r)
    for rows in out.values():
        assert sum(r["kept"] for r in rows) == 1 and all(r["class_size"] == len(rows) for r in rows)
    return sorted((sorted((r["doc_id"] for r in rows), key=repr) for rows in out.values()), key=repr)


def test_near_dedup(spark):
    r = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    rows, common = [], " ".join(r.choices(words, k=60))
    for g in range(25):
        base = r.choices(words, k=r.choice([5, 8, 9, 12, 40, 90, 150]))
        for _ in range(r.choice([1, 2, 6])):
            new = base[:]
            for _ in range(max(1, len(new) // 90)):
                new[r.randrange(len(new))] = r.choice(words)
            rows.append((len(rows), " ".join(new) + (f" {common}" if g % 3 == 0 else "")))
    chain = r.choices(words, k=200)
    for i in range(12):  # each is near the next, but not all of them each other
        chain = chain[:]
        chain[15 * i + 3] = f"c{i}"
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  ", "one two", "One, two!", "one two three"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert made_classes(df) == brute_classes(rows)


def test_near_dedup_in_large_buckets(spark, monkeypatch):
    base = " ".join(f"b{i}" for i in range(8))
    rows = [(i, f"{base} w{i}") for i in range(90)] + [(90, base)]  # all are near the base, none near another
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert made_classes(df) == [sorted(range(91), key=repr)]
    monkeypatch.setattr(near_dedup, "BLOCK", 7)  # the bucket is dealt to many blocks
    assert made_classes(df) == [sorted(range(91), key=repr)]
    r = random.Random(5)
    start, some = [f"q{i}" for i in range(60)], []
    for i in range(80):
        new = start[:]
        for at in r.sample(range(60), r.choice([1, 1, 2])):
            new[at] = f"z{i}"
        some.append((i, " ".join(new)))
    assert made_classes(spark.createDataFrame(some, "doc_id long, text string")) == brute_classes(some)


def test_near_dedup_odd_rows(odd, none, odd_texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(odd.where("doc_id is not null")).collect()}
    assert got[20] == got[21] == got[22] == 20 and got[23] == 23 and got[4] == got[6] == got[8] == 4 and got[2] == got[9] == got[11] == 2
    assert near_dedup.classes(odd).count() == len(odd_texts) and near_dedup.classes(none).count() == 0
    out = near_dedup.one_of_each(odd)
    assert out.columns == odd.columns and near_dedup.one_of_each(none).count() == 0
    texts = Counter(" ".join(near_dedup.words_of(r["text"] or "")) for r in out.collect())
    assert max(texts.values()) == 1


def test_alignment_follows_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.aligned(a, a) == 1.0 and near_dedup.aligned(a, np.delete(a, 50)) == 0.99
    assert near_dedup.aligned(a, np.concatenate([a[50:], a[:50]])) < 0.8


# 10 fingerprints


def lanes(text):
    """A fingerprint in plain Python."""
    hashed = lambda k, s: xxhash.xxh64_intdigest(s.encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42))
    out = [sum(hashed(k, p) & fingerprints.WIDE_MASK for p in text.split("\n")) & fingerprints.WIDE_MASK for k in range(4)]
    sentences = [s for s in re.split(fingerprints.SENTENCES, text) if s]
    out.append(len(sentences))
    fields = []
    for seed in (11, 12):
        hashes = [hashed(seed, s) for s in sentences]
        fields += [[sum(h >> (s + 21 * k) & 1 for h in hashes) % 2**20 for k in range(3)] for s in range(21)]
    return out + [sum(v << (21 * k) for k, v in enumerate(f)) for f in fields], fields


def likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    signed = lambda x: np.array([2 * v - x[0][4] for f in x[1] for v in f], float)
    x, y = signed(a), signed(b)
    both = (x @ x) + (y @ y)
    return max(0.0, 1 - ((x - y) @ (x - y)) / both) if both else 0.0


def hexed(a):
    return "".join(f"{v:016x}" for v in a[0])


def test_fingerprints(spark, odd, odd_texts, none, monkeypatch):
    far = odd.unionByName(spark.createDataFrame([(10**15 + i, f"far {i}. off\nx") for i in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    every = odd_texts + [(10**15 + i, f"far {i}. off\nx") for i in range(40)]
    rows = fingerprints.edited_report(far).collect()
    some = {i: [t or "" for j, t in every if j == i] for i, _ in every}
    ids = sorted(some, key=lambda i: (i is not None, i or 0), reverse=True)
    after = {i: max(some[ids[(k + 1) % len(ids)]], key=lambda t: t.encode()) for k, i in enumerate(ids)}
    want = Counter()
    for i, t in ((i, t or "") for i, t in every):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[i][:k]
        own, other, following = lanes(t), lanes(edited), lanes(after[i])
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(other), round(likeness(own, other), 9), round(likeness(own, following), 9))] += 1
    assert Counter((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["fingerprint"] == by[6]["fingerprint"] != by[8]["fingerprint"] and by[7]["fingerprint"] != by[3]["fingerprint"]
    assert abs(by[4]["near_edited"] - 2 / 3) < 0.2 and by[20]["near_next"] < 0.5
    assert fingerprints.edited_report(none).count() == 0


def test_one_document_is_its_own_next(spark):
    r = fingerprints.edited_report(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0


def test_fingerprints_add_and_remove(spark):
    texts = ["First one. And more!\nSecond one.\n\nThird", "Second one.\nThird\nFirst one. And more!\n", "Second one.\n\nThird", "First one. And more!"]
    a, b, rest, part = spark.createDataFrame([texts], "a string, b string, c string, d string").select(*[fingerprints.fingerprint(F.col(c)) for c in "abcd"]).first()
    assert a == b  # any order of paragraphs
    df = spark.createDataFrame([(a, rest, part)], "a array<long>, r array<long>, p array<long>")
    got = df.select(fingerprints.combine(F.col("r"), F.col("p")), fingerprints.remove(F.col("a"), F.col("p")), fingerprints.likeness(F.col("a"), F.col("a")), fingerprints.likeness(F.col("a"), F.col("r"))).first()
    assert got[0] == a and got[1] == rest and got[2] == 1.0 and 0.4 < got[3] < 1


# the queries


def test_queries_cover_the_ten(spark, sf_dir):
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    made = queries.op6_merge_dropout(spark, sf_dir)
    assert made.where("not lossless").count() == 0
    assert SCHEMA and LONG


def test_license_anchors_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "Thunder codes versions and freely licenses"), (2, "Released UNDER the MIT License."), (3, "a_license-b"), (4, "élicense")], "doc_id long, text string")
    assert sorted(r.doc_id for r in licenses.parts(docs, licenses.TEMPLATES, licenses.THRESHOLD).collect()) == [2, 3]


def test_chunks_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(merge_dropout, "KEPT_CHUNKS", 3)
    own, plain = (merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 1, 0.0) for _ in range(2))
    own.encode("some words that are known")
    monkeypatch.setattr(own, "_short", None)  # nothing is made again
    assert own.encode("words that are known") == plain.encode("words that are known")


def test_chunks_with_skips_are_taken_together(monkeypatch):
    """Many chunks at once, and chunks that the library cuts, become what each becomes by itself; no step of either goes chunk by chunk."""
    own = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 1, 0.3)
    r = random.Random(5)
    chunks = ["".join(r.choices("▁▁eeettaaoinrshldüß日é😀7.\0", k=r.randrange(1, 30))) for _ in range(3000)] + ["▁" + "".join(r.choices("etaoinsrhld", k=9)) for _ in range(1000)]
    assert [own._whole(c) for c in chunks] == [own._made(c, ()) for c in chunks]
    x, first = own._draw(np.arange(len(chunks), dtype=np.uint64))
    keys = [merge_dropout._mixed(i) for i in range(len(chunks))]
    plain = [own._short(c, (k for some in ([n], own._later(n, key)) for k in some)) for c, n, key in zip(chunks, first.tolist(), keys)]
    assert list(zip(*own._together(chunks, first, x))) == [(n, own._ids(at), skips) for n, at, skips in plain]
    texts = [" ".join(r.choices(["wonderful", "settlement", "unbelievable", "forestry", "nightingale"], k=60)) for _ in range(300)]
    one_by_one = [own.encode(t, i) for i, t in enumerate(texts)]
    fresh = merge_dropout.Segmenter(queries.vocabulary("piece_bpe_32k.model"), 1, 0.3)
    monkeypatch.setattr(fresh, "_short", None)
    assert fresh.encode_all([None, "", *texts], [7, 8, *range(300)]) == [b"", b"", *one_by_one]
