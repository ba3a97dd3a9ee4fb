"""Token ids, binary records and packing against the plain tokenizer."""

import random
import zlib

import numpy as np
import pytest

from veridoc.llm import packing, records
from veridoc.llm.tokens import Encoder, default_tokenizer

ODD = ["", " ", "  ", "a  b", "a   b \n\n c", "\n word", "\n\n x", "end ", "end \n", "tab\t x", "x  y", "x  y", "a\n  b", "don't  it's",
       "<|endoftext|> a", "a<|endoftext|>", "a <|endoftext|>  b", "日本語 テスト  　 x", "é é ü", "1 2  34 5,6", "a\x1c b\x1f  c", " lead", "   lead",
       "x" * 5000, "\r\n \r\n", "emoji 😀 😀😀  😀", "a" + " " * 40 + "b", "trail" + " " * 9]


def plain(texts):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(default_tokenizer())
    return [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library():
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "\n", "\t", ",", ".", "'s", "é", "9", "日", " ", " ", "<|endoftext|>", "-", "\x1c", "\u0085"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None]
    tool = Encoder(default_tokenizer(), cache_pieces=500)
    for _ in range(2):
        got = [np.frombuffer(x, tool.dtype).tolist() for x in tool.encode(texts)]
        assert got == plain(texts)


def test_frames_round_trip_and_show_damage():
    data = b"".join(records.frame(records.payload(1, i, np.arange(i, dtype="<u2").tobytes(), 2)) + b"\n" for i in range(20))
    assert [(k, i, x.tolist()) for _, k, i, _, x in records.frames(data)] == [(1, i, list(range(i))) for i in range(20)]
    for at in range(0, len(data), 7):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(records.CorruptRecord):
            list(records.frames(bytes(broken)))


ROWS = [(5, "five words are in here"), (None, "no id"), (3, None), (3, ""), (3, "again"), (3, "again"), (-1, "minus  one"), (9, "long " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in ROWS] + [(100 + i, x, "y", 2) for i, x in enumerate(ODD)],
                                 "doc_id long, text string, shard string, start int").repartition(3)


def test_records_against_plain_order(spark, docs, tmp_path):
    folder = str(tmp_path / "r")
    records.write_records(docs, folder + "/s", default_tokenizer(), 2, shards=3)
    index = records.with_starts(records.build_index(spark, folder + "/s", folder + "/i"))
    got = sorted(index.collect(), key=lambda r: r["start"])
    rows = docs.select("doc_id", "text").collect()
    ids = {i: x + [2] for i, x in enumerate(plain([r["text"] for r in rows]))}
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    want = sorted((str(r["doc_id"]), len(ids[i]), zlib.crc32(np.array(ids[i], dtype="<u4").tobytes())) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    some = records.read_records(spark, folder + "/s", index.filter("doc_id in (5, 9)")).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in some} == {r["doc_id"]: ids[i] for i, r in enumerate(rows) if r["doc_id"] in (5, 9)}


def test_records_of_an_empty_table(spark, docs):
    assert records.token_records(docs.limit(0)).count() == 0


def check_packing(pieces, texts):
    """Every id lies in exactly one piece, sequences are gapless and their lengths powers of two."""
    ids = {k: x + [1] for k, x in zip(texts, plain(texts.values()))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for k, some in by_doc.items():
        some.sort(key=lambda p: p["start"])
        got = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in some]).tolist()
        assert got == ids[k] and all(p["doc_tokens"] == len(got) for p in some)
        assert [p["start"] for p in some] == [0, *np.cumsum([p["length"] for p in some])[:-1].tolist()]
    for some in by_sequence.values():
        some.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in some] == [0, *np.cumsum([p["length"] for p in some])[:-1].tolist()]
        total = sum(p["length"] for p in some)
        assert total == some[0]["window"] and total & (total - 1) == 0 and total <= 2048
    return by_sequence


def test_packing_keeps_every_id(spark):
    rng = random.Random(1)
    texts = {i: "word " * int(rng.paretovariate(0.7) * 30 % 9000) for i in range(300)} | {1000 + i: t for i, t in enumerate(ODD)} | {2000: None}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, length int").repartition(2)
    got = packing.pack(docs).collect()
    sequences = check_packing(got, texts)
    short = [s for s in sequences.values() if s[0]["window"] < 256]
    assert len(short) <= 2 * 8
    steps = {}
    for s in sequences.values():
        steps[s[0]["step_group"]] = steps.get(s[0]["step_group"], 0) + s[0]["window"]
    assert max(steps.values()) <= 16 * 2048 and sum(v == 16 * 2048 for v in steps.values()) >= len(steps) - 8
    assert packing.pack(docs.limit(0)).count() == 0


def test_packer_backlog_is_bounded():
    for sizes in ([1500], [3], [1025, 2047], [100, 1100, 700, 300]):
        packer, given, got = packing.Packer(), 0, 0
        for i in range(2000):
            n = sizes[i % len(sizes)]
            packer.add(i, np.zeros(n, dtype="<u2"))
            given += n
            got += sum(w for _, w in packer.emit())
            assert given - got <= 2048 * 80
        packer.finish()
        assert given == got + sum(w for _, w in packer.emit())
