import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from anchorline.llm import bpe
from anchorline.llm.queries import vocabulary


@pytest.fixture(scope="module")
def tools():
    text = vocabulary()
    return bpe.Vocabulary(text), Tokenizer.from_str(text), text


def test_equals_the_library_on_hostile_texts(tools):
    own, library, _ = tools
    draw = random.Random(1)
    letters = "abcdeéß  \n\t'stré ΣAB12!?😀中İK½²ꟋᲉ’\x85 \x1c"
    texts = ["", " ", "ab" * 9000, "é" * 500, "<|endoftext|>", "a<|startoftext|>b", "<|EndOfText|>", "ΑΣ ΟΔΟΣ", "it's we'll 'T"]
    texts += ["".join(draw.choice([*letters, "<|endoftext|>"]) for _ in range(draw.randrange(120))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.tokens_of(text) == want, text
        assert own.text_of(want) == library.decode(want, skip_special_tokens=False)


def test_every_code_point_agrees(tools):
    own, library, _ = tools
    for start in range(0, 0x110000, 97):
        code = start + start % 89
        if not 0xD800 <= code < 0xE000 and code < 0x110000:
            text = f"a{chr(code)}B {chr(code)}"
            assert own.tokens_of(text) == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_speculation_and_exact_merging_both_occur(tools):
    own, _, _ = tools
    words = ["".join(random.Random(n).choices("thereading", k=8)) for n in range(300)]
    spelled = [own.merge(w) == own.propose(w) for w in words]
    assert any(spelled) and not all(spelled)
    assert all(own.encode_words([w])[w] == own.merge(w) for w in words)


def test_documents(spark, docs, tools):
    _, library, text = tools
    rows = [(1, "Hello there, hello THERE"), (2, None), (3, ""), (None, "x"), (1, "Hello there, hello THERE")]
    found = spark.createDataFrame([(*r, 5) for r in rows], "doc_id BIGINT, text STRING, n_tokens INT")
    plain = bpe.encode_documents(found, text).collect()
    hashed = bpe.encode_documents(found, text, digests=True).collect()
    assert len(plain) == len(rows)
    for (_, t), a, b in zip(rows, plain, hashed, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (a["token_ids"], a["n_tokens"], a["decoded"]) == (want, len(want), library.decode(want, skip_special_tokens=False))
        assert b["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert b["decoded_sha256"] == hashlib.sha256(a["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(docs([]), text).count() == 0
