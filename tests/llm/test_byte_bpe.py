import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken

from mullion.llm import byte_bpe as m


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.vocabulary(None), special_tokens={})


def texts():
    rng = random.Random(1)
    letters = "abcdefghij etaoin\n\t '.,0123456789éèüß😀日本"
    odd = ["", "a" * 3000, "ab" * 300, "\x1c\x1d a  b\n\n c", "日本語テキスト" * 50, "👩‍👩‍👧‍👦 test", "x" * 150 + "y" * 90, " \u3000 hi", "²½Ⅷ٣", "don't I'LL", "<|endoftext|>", "\ufeff\u200b", "#" * 400]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(200)]


@pytest.mark.parametrize("short", [0, m.SHORT_BYTES, 1000])
def test_ids_equal_the_librarys(library, short):
    """By either recursion: at all places of the least pair at once, or one after another."""
    own = m.Codec(short=short)
    rows = [t for t in texts() if short < 1000 or len(t) < 900]
    assert own.encode(rows).to_pylist() == [library.encode_ordinary(t) for t in rows]


def test_long_matches(library):
    rng = random.Random(3)
    run = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    cjk = [chr(c) for c in range(0x4E00, 0x9FFF)]
    rows = [run("ACGT", 10_000), run("abcXYZ", 10_000), run("一二三的是不了在人有我他", 3400), run(cjk, 3400), "=" * 10_001, "ab" * 5000, " " * 20_000 + "x", "\n \t" * 4000, "😀" * 2500, "é" * 5001]
    own = m.Codec()
    assert own.encode(rows).to_pylist() == [library.encode_ordinary(t) for t in rows]
    assert own.decode(own.encode(rows)) == [t.encode() for t in rows]


def test_text_without_spaces_is_no_slower(library):
    """8,000 matches of 60 letters each, none met before: a few seconds of one core for 1.4 MB."""
    rng = random.Random(5)
    rows = ["，".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60)) for _ in range(80)) for _ in range(100)]
    own = m.Codec()
    began = time.process_time()
    got = own.encode(rows)
    assert time.process_time() - began < 5
    assert got.to_pylist() == [library.encode_ordinary(t) for t in rows]


def test_pieces_join_to_the_match_and_are_independent(library):
    own = m.Codec()
    rng = random.Random(6)
    for _ in range(200):
        w = "".join(rng.choice("abcdeé日本語x") for _ in range(rng.randint(25, 90))).encode()
        parts = own.pieces(w)
        assert b"".join(parts) == w
        assert [i for p in parts for i in library._encode_single_piece(p)] == library._encode_single_piece(w)


def test_a_vocabulary_out_of_order_joins_the_leftmost_alone(tmp_path):
    """abc is no product of its own contractions here, so joining all ab at once would be too early."""
    tokens = [*(bytes([b]) for b in range(256)), b"xab", b"abxab", b"zzz", b"ab", b"xy", b"zz", b"abab", b"yxy"]
    with open(tmp_path / "v", "wb") as f:
        f.write(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    ranks = {t: k for k, t in enumerate(tokens)}
    assert m.alone(ranks, m.merge_table(ranks))
    encoding = tiktoken.Encoding("v", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    rows = ["".join(rng.choice("abxyz") for _ in range(rng.randint(1, 120))) for _ in range(200)] + ["abxab" * 20, "z" * 50, "xababab" * 9]
    for short in (0, 1000):
        assert m.Codec(str(tmp_path / "v"), short).encode(rows).to_pylist() == [encoding.encode_ordinary(t) for t in rows]


def test_round_trip():
    own = m.Codec()
    rows = texts()
    assert own.decode(own.encode(rows)) == [t.encode() for t in rows]


def test_every_code_point_parts_alike(library):
    own = m.Codec()
    rows = [f"a{chr(c)}1 {chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert own.encode(rows).to_pylist() == library.encode_ordinary_batch(rows)


def test_cache_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(m, "CACHE_WORDS", 5)
    own = m.Codec()
    for t in texts()[-40:]:
        assert own.encode([t]).to_pylist() == [library.encode_ordinary(t)]


def test_unknown_id_is_an_error():
    import pyarrow as pa

    with pytest.raises(ValueError, match="vocabulary"):
        m.Codec().decode(pa.array([[999_999]], pa.list_(pa.int32())))
    assert m.Codec().decode(pa.array([[], None], pa.list_(pa.int32()))) == [b"", b""]


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in m.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == m.reference_digest(library.encode_ordinary(docs[r.doc_id]), docs[r.doc_id])


def test_tables(small_docs, spark):
    docs, all_texts = small_docs
    out = m.round_trip(docs, with_ids=True)
    assert out.columns == [*docs.columns, "ids1", "n_tokens"]
    assert {r.doc_id: r.text for r in out.collect()} == all_texts
    assert m.encode(docs.where("false")).count() == 0
