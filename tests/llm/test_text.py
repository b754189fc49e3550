"""Word cutting and shingles against plain Python."""

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import text as T
from strata.llm.shared import fold

TEXTS = st.lists(st.text(alphabet=" \n\t\x0b\x1cabÄ日😀A.", max_size=25), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.booleans())
def test_words(texts, lower):
    w = T.words(pa.array(texts, pa.string()), lower=lower)
    names = [x.decode() for x in w.distinct.to_pylist()]
    got = [[names[c] for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:])]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert got == [[x.replace("A", "a") for x in t] if lower else t for t in want]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingles(texts):
    w = T.words(pa.array(texts, pa.string()))
    runs, starts = T.shingle_hashes(w, 3)
    seen = {}
    for i, t in enumerate(texts):
        x = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = [tuple(x[k : k + 3]) for k in range(len(x) - 2)] or ([tuple(x)] if x else [])
        mine = runs[starts[i] : starts[i + 1]].tolist()
        assert len(mine) == len(want)
        for h, r in zip(mine, want):
            assert seen.setdefault(r, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_keep_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) for i in range(50)])], names=["id", "text"])
    parts = list(T.pieces([b.slice(3), b.slice(0, 0)], limit=60))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(3, 50)) and len(parts) > 5
    assert [T.as_array(p.column(1)).to_pylist() for p in parts]


def test_fold_is_crc_of_the_id(spark):
    import zlib

    got = {r["doc_id"]: r["f"] for r in spark.createDataFrame([(1,), (-5,), (10**12,), (None,)], "doc_id bigint").withColumn("f", fold()).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 for i in (1, -5, 10**12, None)}
