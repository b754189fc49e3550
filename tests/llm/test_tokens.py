"""BPE and token files against the public libraries, and exact round trips."""

import codecs
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import bpe, tokenfile

CODEC = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
CHUNKS = tokenfile.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
PIECES = ["a", "B", "'s", "'", "́", "̸", ">", ".", ",", "\x85", "\x1c", "J̌", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|", "|>", "É", " ", "\n", "\t", "1", "²", "İ", "ß", "ａ", "😀", "'LL", "don't", "#", "re", "the ", "日本"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.lists(st.sampled_from([*PIECES, "  ", " a", "\r", "\u3000", "\ufffd"]), max_size=40).map("".join)), max_size=4))
def test_transducer_equals_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, off = CODEC.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [TIK.encode_ordinary(t) for t in texts]
    assert CODEC.decode(ids) == "".join(texts).encode() and CODEC.decode_texts(ids, off).to_pylist() == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*range(300), *(r for w, r in CODEC.ranks.items() if not w.isascii())]), max_size=20), max_size=4))
def test_decoding_replaces_bad_bytes_like_the_library(rows):
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    ids = np.array([i for r in rows for i in r], np.int64)
    assert CODEC.decode_texts(ids, off).to_pylist() == [codecs.decode(TIK.decode_bytes(r), "utf-8", "replace") for r in rows]


def test_long_runs_and_restarts():
    small = bpe.Transducer(CODEC.ranks, most_bytes=15_000)
    rng = random.Random(4)
    for word in (b"a" * 3000, b"!?" * 900, " ñandú".encode() * 200, bytes(range(256)) * 3, bytes(rng.choice(b"abcdefghij") for _ in range(40_000))):
        assert small.encode(word) == TIK.encode_ordinary(word.decode()) if word.isalpha() else small.encode(word) == CODEC.machine.encode(word)
        assert len(small.states) < 60
    for word in (b"abcabcabd", "größere".encode(), b"x" * 200):
        assert small.encode(word) == small.merged(word)


def test_agreement_equals_merging():
    m, rng = bpe.Transducer(CODEC.ranks), random.Random(6)
    tokens = list(m.piece)
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        met = m.merged(m.piece[a] + m.piece[b])
        for x, y in ((a, b), *zip(met, met[1:])):
            assert m._agree(x, y) == (m.merged(m.piece[x] + m.piece[y]) == [x, y])
    # ranks that do not rise: "abc" is merged from "ab" that ranks after it
    odd = bpe.Transducer({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4, b"bc": 5})
    for word in (b"abcabc", b"aabbcc", b"bcab"):
        assert odd.encode(word) == odd.merged(word)


def test_emission_is_bounded_by_the_longest_token():
    m = CODEC.machine
    longest = max(map(len, CODEC.ranks))
    for data in (b"international relationships " * 20, b"ab" * 400):
        stream, out = bpe.TokenStream(m), []
        for i in range(len(data)):
            out += stream.feed(data[i : i + 1])
            assert i + 1 - sum(len(m.piece[t]) for t in out) <= 2 * longest
        assert out + stream.finish() == m.encode(data)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=12))
def test_utf8_stream_equals_codecs(parts):
    ours, theirs = bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace")
    assert "".join(map(ours.feed, parts)) + ours.finish() == "".join(map(theirs.decode, parts)) + theirs.decode(b"", True)


def test_encode_decode_frames(spark, edge_docs, no_docs):
    coded = bpe.encode(edge_docs)
    back = bpe.decode(coded).collect()
    assert len(back) == edge_docs.count()
    for r in back:
        assert r["ids"] == TIK.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() and r["decoded_text"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(no_docs)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id bigint, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(nulls).orderBy("doc_id").collect()] == [b"", b"", b"Hello"]


def test_chunk_encoder_equals_the_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 50))) for _ in range(1500)]
    ids, off = CHUNKS.encode(pa.array(texts), None)
    for i, e in enumerate(WORD.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[off[i] : off[i + 1]].tolist(), texts[i]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "<|", "ENDOFTEXT", "endoftext", "|>", "A", "ñ", "Ÿ"]), max_size=25).map("".join))
def test_special_tokens_are_matched_as_written(text):
    ids, _ = CHUNKS.encode(pa.array([text]), None)
    assert ids.tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_special_token_in_capitals():
    assert WORD.encode("<|ENDOFTEXT|>").ids != WORD.encode("<|endoftext|>").ids
    for text in ("<|ENDOFTEXT|>", "a<|EndOfText|>b", "x<|endoftext|>.", "<|startoftext|>A"):
        assert CHUNKS.encode(pa.array([text]), None)[0].tolist() == WORD.encode(text, add_special_tokens=False).ids


def test_token_files(spark, edge_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/t"
    tokenfile.write_tokens(edge_docs.repartition(3), path, row_group_bytes=1 << 20)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokenfile.with_crc(tokenfile.read_tokens(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    want = {}
    for d, t in rows:
        ids = np.array([*WORD.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]] and r["start"] == at
        at += r["n_tokens"]
    assert tokenfile.read_metadata(spark, path).count() == len(rows)
    assert {r["doc_id"] for r in tokenfile.read_tokens(spark, path, 7, 9).collect()} == {7, 8, 9}
    meta = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    tokenfile.write_tokens(no_docs, f"{path}-none")
    assert tokenfile.read_tokens(spark, f"{path}-none").count() == 0
