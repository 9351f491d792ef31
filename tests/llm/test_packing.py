import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anchorline.llm import packing, queries

TEXT = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
RULES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
HARD = [
    None, "", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "  \n\t  \r\n x", "I'll 'S 's", "日本語 🙂🙂", "é" * 50, "a\x00b\x1cc",
    " " * 5000, "word " * 9000, "z" * 40_000, "\n" * 3000 + "x",
]


def ids_of(text):
    return RULES.encode(text or "", add_special_tokens=False).ids + [1]


def rows_of(seed, n=120):
    draw = random.Random(seed)
    letters = ["a", "b", " ", "  ", "\n", "é", "7", "!", "'s", "the ", " und", "ñ"]
    texts = HARD + ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 400))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a"), (None, "no id")]


def checked(pieces, rows, length):
    """Every id lies in one piece, sequences leave no gap, and only the rest is cut shorter than a full window."""
    documents, sequences = {}, {}
    for r in pieces:
        assert r["length"] == len(r["ids"]) // 4 > 0
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(ids_of(t))
    assert set(documents) == set(by_id)
    for i, own in by_id.items():
        found = sorted(documents[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in found) == sum(map(len, own))
        assert {r["doc_tokens"] for r in found} == set(map(len, own))
        for r in found:
            assert any(bytes(r["ids"]) == array("I", o[r["start"] : r["start"] + r["length"]]).tobytes() for o in own)
    ends = []
    for n, parts in sequences.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        ends.append((n, at))
    ends.sort()
    assert [n for n, _ in ends] == list(range(len(ends)))
    total = sum(map(len, sum(by_id.values(), [])))
    assert sum(n for _, n in ends) == total
    assert all(n == length for _, n in ends[: total // length])
    assert all(n & (n - 1) == 0 for _, n in ends[total // length :])


@pytest.mark.parametrize("length", [2048, 64, 7])
def test_pieces_equal_brute_force(docs, length):
    rows = rows_of(length)
    layout = packing.laid_out(docs(rows).repartition(5), TEXT, length)
    found = packing.pieces(layout).collect()
    checked(found, rows, length)
    assert layout.total == sum(len(ids_of(t)) for _, t in rows)
    # Sequences joined from boundary records hold the pieces in order.
    want = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(layout).collect()} == want


def test_windows_inside_a_partition_need_no_boundary_record(docs):
    layout = packing.laid_out(docs([(1, "a b c d e f g h")]).coalesce(1), TEXT, 4)
    run, schema = packing._cut(layout, "bigint", whole=True)
    assert not layout.ids.mapInArrow(run, schema).filter("boundary").count()


def test_the_fast_encoder_equals_the_library_on_every_letter():
    encoder = packing.ByteEncoder(TEXT)
    assert encoder.fast is not None
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(letters), 4000):
        text = "".join(f"a{c}1 {c}b" for c in letters[start : start + 4000])
        assert encoder.ids_of(text).tolist() == RULES.encode(text, add_special_tokens=False).ids


def test_other_descriptions_are_left_to_the_library():
    encoder = packing.ByteEncoder(TEXT.replace('"add_prefix_space": false', '"add_prefix_space": true').replace(
        '"add_prefix_space":false', '"add_prefix_space":true'))
    assert encoder.fast is None
    assert len(encoder.ids_of("hello world")) == 2


def test_empty_tables_and_other_columns(spark, docs):
    assert packing.pack(docs([]), TEXT).count() == 0
    layout = packing.laid_out(docs([]), TEXT)
    assert layout.total == 0 and packing.sequences(layout).count() == 0
    clash = spark.createDataFrame([(1, "a b", 9, "x", b"y")], "doc_id INT, text STRING, part INT, ids STRING, n BINARY")
    assert [(r["doc_id"], r["length"], r["sequence_id"]) for r in packing.pack(clash, TEXT).collect()] == [(1, 2, 0), (1, 1, 1)]


def test_op12_gives_the_digests_of_its_pieces(spark, tmp_path, docs):
    rows = rows_of(9, 20)
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_packing"](spark, str(tmp_path)).collect()
    assert set(got[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    own = {}
    for i, t in rows:
        own.setdefault(i, []).append(ids_of(t))
    for r in got:
        crcs = {zlib.crc32(array("I", o[r["start"] : r["start"] + r["length"]]).tobytes()) for o in own[r["doc_id"]]}
        assert r["ids_crc32"] in crcs and r["offset"] + r["length"] <= 2048
