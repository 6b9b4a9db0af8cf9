import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from reposift.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(3)
    texts = ["", " ", "a", "aaaa" * 900, "<|endoftext|> x", "日本語テキスト" * 60, " \n\n\t  x", "ab" * 2000, "é" * 700]
    texts.append("".join(rnd.choice("abcdefgh") for _ in range(6000)))
    for _ in range(200):
        texts.append("".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x2FF), 0x1F600])) for _ in range(rnd.randrange(1, 300))))
    return texts


def test_encoding_is_the_librarys_and_decoding_restores(library):
    codec = bpe.codec(PATH, P.PATTERN)
    texts = odd_texts()
    ids, rows = codec.encode(texts)
    ends = np.cumsum(rows)
    for text, a, b in zip(texts, ends - rows, ends, strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(text)
        assert codec.decode(ids[a:b])[0].tobytes() == text.encode()


def test_frame_keeps_rows_columns_and_nulls(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello, world!", None), (3, "Hello, world!", None), (None, "ab\ncd", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.encode(df, PATH, P.PATTERN, decoded="decoded")
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.text or "", r.ids, bytes(r.decoded)) for r in done.collect()), key=str)
    want = sorted(((a or 0, t or "", library.encode_ordinary(t or ""), (t or "").encode()) for a, t, _ in rows), key=str)
    assert got == want
    back = bpe.decode(done.drop("decoded"), PATH, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query_digests(spark, library):
    df = spark.createDataFrame([(1, None), (2, "the cat 12 sat")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    ids = library.encode_ordinary("the cat 12 sat")
    assert got[2].n_tokens == len(ids)
    assert got[2].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[1].decoded_sha256


def test_a_text_longer_than_a_block(spark, library):
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choices("etaoinshr", k=rnd.randrange(1, 12))) for _ in range(180_000))
    assert len(text) > 1 << 20
    df = spark.createDataFrame([(1, "before"), (2, text), (3, "after")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode(df, PATH, P.PATTERN, decoded="decoded").collect()}
    assert got[2].ids == library.encode_ordinary(text) and bytes(got[2].decoded).decode() == text
    assert got[1].ids == library.encode_ordinary("before") and got[3].ids == library.encode_ordinary("after")
