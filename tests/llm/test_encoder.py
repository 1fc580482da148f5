"""The chunk encoder gives what the tokenizer gives for whole texts."""

import random

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from factloom.llm import common, near_dedup, packing, queries, token_files
from factloom.llm.common import BYTE_CHUNKS, WORD_CHUNKS, ChunkEncoder

CASES = ["don't stop", "áb ć, é,", "x'll,", "İstanbul", "foo<s>bar </s> <unk>", "a.̸b", "hello\tworld, foo", "  two  spaces, \n\nnl ", "foo×bar", "ñandú-él", "ß. SS", "naïve!!!", "wordи mix", "a1b2 c3,", "", "\n", " ", "foo‍bar, x", "ﬁx, a b", "A.B.C,", "ЁЖ ёж, Ωσς", "x_y_z __a", "(a) [b] {c} ~d~ ^e^ `f`", "word'", "it's'd,"]


@pytest.mark.parametrize(("name", "chunks"), [("word_bpe_49k.json", WORD_CHUNKS), ("byte_bpe_50k.json", BYTE_CHUNKS)])
def test_chunks_give_the_ids_of_whole_texts(name, chunks, monkeypatch):
    monkeypatch.setattr(common, "CACHE_ENTRIES", 50)  # generations change often
    r = random.Random(3)
    alphabet = [*"abcXYZéßñÀ", *"  \n", *"'.,-_!$0 9", "́", "̸", "и", "中", " ", "‍", "ll", "'s"]
    texts = CASES + ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(3000)]
    encoder, plain = ChunkEncoder(queries.vocabulary(name), chunks, "I"), ChunkEncoder(queries.vocabulary(name), None, "I")
    assert encoder.one_word("word") and not encoder.one_word("it's")
    assert [t for t in texts if encoder.encode(t) != plain.encode(t)] == []


def test_unknown_steps_take_the_long_way(tmp_path):
    from tokenizers import Tokenizer, normalizers

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    tokenizer.normalizer = normalizers.Replace("a", "b")
    tokenizer.save(path := str(tmp_path / "t.json"))
    encoder = ChunkEncoder(path, BYTE_CHUNKS, "I")
    assert encoder.one_word is None and encoder.encode("banana, a") == encoder.whole(["banana, a"])[0]


def test_masks_are_views_of_the_mapped_file(tmp_path):
    writer = token_files.ShardWriter(str(tmp_path / "s"), 12, 2, "uint16")
    writer.add([1, 2], [bytes(2 * 20), bytes(2 * 45)])
    writer.close()
    before = pa.total_allocated_bytes()
    shard = token_files.Shard(str(tmp_path / "s.tokens.arrows"))
    assert [shard.mask_bits(i).true_count for i in range(6)] == [12, 12, 12, 12, 12, 5] == [shard.mask(i).sum() for i in range(6)]
    held = [shard.mask_bits(i) for i in range(6)]
    assert len(held) == 6 and pa.total_allocated_bytes() - before < 64 and shard.mask(5).tolist() == [True] * 5 + [False] * 7


def test_only_new_chunks_are_learnt(monkeypatch):
    encoder, plain = (ChunkEncoder(queries.vocabulary("byte_bpe_50k.json"), c, "I") for c in (BYTE_CHUNKS, None))
    encoder.encode("alpha beta")
    learn, seen = encoder._learn, []
    monkeypatch.setattr(encoder, "_learn", lambda chunks: (seen.extend(chunks), learn(chunks)))
    assert encoder.encode("alpha beta gamma beta") == plain.encode("alpha beta gamma beta") and seen == [" gamma"]


def test_workers_give_back_what_earlier_steps_hold(spark):
    """As Spark sends them, functions empty the worker's own tables, not copies: encoders of earlier steps, and words."""
    sent = []

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, function, schema: sent.append(cloudpickle.loads(cloudpickle.dumps(function)))

    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "some words of a text"}])
    packing.pieces(Docs(), queries.vocabulary("word_bpe_49k.json"), 1)
    near_dedup.sketched(Docs())
    assert sum(b.num_rows for b in sent[0](iter([batch]))) == 1 and common._ENCODERS
    near_dedup.kmers(["known", "word"])
    assert sum(b.num_rows for b in sent[1](iter([batch]))) == 1 and not common._ENCODERS and not near_dedup._known
