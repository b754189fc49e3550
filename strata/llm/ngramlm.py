"""Language-model scoring with a trigram model in Elias-Fano tries that are dealt over shards.

Tokens are lower-cased words between blanks and one end. With c for training counts, N and V for all
and distinct training tokens:

    p1(w)      = (c(w) + 1) / (N + V + 1)
    p2(w|v)    = (c(vw) + a p1(w)) / (c(v) + a)
    p3(w|u,v)  = (c(uvw) + b p2(w|v)) / (c(uv) + b)     where (u, v) was seen
    p3(w|u,v)  = p2(w|v)                                   otherwise

Without ``every_context`` only a frequent v is a context of two words; the query uses every one.

These are proper distributions, and the log of a text's probability is a sum over its n-grams:
log p1(w), a weight log a/(c(v)+a) or log b/(c(uv)+b) for each word or pair as context, and a gain
log(1 + c(vw)/(a p1(w))) or log(1 + c(uvw)/(b p2(w|v))) for each pair or triple seen. So no shard
needs the whole model: a shard holds the n-grams that end in its words, in a trie read from the predicted word back through
its context (word, word before, word before that), and returns a partial sum for each text.

1. All words of the training texts are counted; those with at least N / 65536 occurrences are frequent. Only they, at
   most 65536, are broadcast.
2. Every token goes to a shard with its two words before, packed by batch: others than frequent words by the
   word, frequent words by the word before if that is not frequent, else by the pair, so no shard depends on one word.
3. The third order needs c(v) of the middle word. It is in the broadcast if v is frequent and in the same shard if only w is. For
   the rest each batch asks by word for the shards of its pairs, and the answers (counts over 1) are joined to the shards' tokens.
4. A shard counts, builds its trie with quantised gains and weights in memory-mapped files, looks all its n-grams up and sums by text.
5. Sums come together by batch of texts.

The number of shards follows the number of tokens. Null texts are empty: the end only. Repeated rows are scored each and learned
from each. An empty training set gives c = N = V = 0. Empty tables give no rows. Word hashes have 64 bits, context words 32 within
their word (for c(v) of one that is not frequent, within the shard). Other columns are left out.
"""

from __future__ import annotations

import io
import math
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.eliasfano import TrieLevel
from strata.llm.shared import fold, small_batches, stored
from strata.llm.text import Words, as_array, mix, pieces, ragged, split_sums, tidy, words

FREQUENT = 1 << 16
SHARD_TOKENS = 700_000
#: Weights of the lower order in the two smoothing steps.
A, B = 300.0, 3.0
#: Frequent ids of the end and of the place before a text.
END, START = 0, 1
_FIRST_ID = 2
_NONE = np.uint32(0)
_ROWS = 20_000
_SUM = np.dtype([("doc", "<u4"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


class Frequent:
    """Counts of the frequent words, by id."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, tokens: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.counts = np.concatenate([[texts, texts], counts[order]]).astype(np.float64)
        self.tokens, self.distinct = tokens, distinct

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + _FIRST_ID, -1)

    def log_p1(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """w (hash of a word) and c over the rows with ``train``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=4 << 20):
            w = words(as_array(b.column(1)), lower=True)
            c = np.bincount(w.codes, weights=np.repeat(b.column(2).to_numpy(zero_copy_only=False), np.diff(w.starts)), minlength=len(w.distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.hashes().view(np.int64)[c > 0]), pa.array(c[c > 0])], names=["w", "c"])

    return docs.mapInArrow(work, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, texts: int) -> Frequent:
    tokens, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    tokens = (tokens or 0) + texts
    rows = counts.where(F.col("c") * FREQUENT >= tokens).toPandas()
    return Frequent(rows["w"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), texts, tokens, distinct + (texts > 0))


def short_codes(full: np.ndarray) -> np.ndarray:
    """32 bits of words that are not frequent, independent of their shard."""
    return (mix(mix(full) ^ np.uint64(0x5DEECE66D)) & np.uint64(0x7FFFFFFF)).astype(np.uint32) | np.uint32(1 << 31)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(key) >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def sequences(w: Words, known: Frequent, every_context: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token of all texts: word (hash, or id if frequent), whether frequent, the 32-bit word
    before, the one before that (0 if there is none or the middle one is no context), the text, and the place of the word before (-1: none)."""
    h = w.hashes()
    ids = known.ids(h)
    hot = ids >= 0
    full = np.where(hot, ids.astype(np.uint64), h | np.uint64(1 << 63))
    short = np.where(hot, ids.astype(np.uint32), short_codes(full))
    n = np.diff(w.starts)
    out = w.starts + np.arange(w.n_texts + 1)  # one more token a text
    total = int(out[-1])
    word, is_hot, code = np.full(total, END, np.uint64), np.ones(total, bool), np.full(total, END, np.uint32)
    at = ragged(out[:-1], n)
    word[at], is_hot[at], code[at] = full[w.codes], hot[w.codes], short[w.codes]
    doc = np.repeat(np.arange(w.n_texts), n + 1)
    before, two = np.full(total, START, np.uint32), np.full(total, START, np.uint32)
    place = np.arange(total) - out[doc]
    before[place > 0] = code[np.flatnonzero(place > 0) - 1]
    two[place > 1] = code[np.flatnonzero(place > 1) - 2]
    two = two + np.uint32(1)
    two[(place == 0) | ((before >= FREQUENT + _FIRST_ID) & (not every_context))] = _NONE
    return word, is_hot, before, two, doc, np.where(place > 0, np.arange(total) - 1, -1)


def packed(word: np.ndarray, before: np.ndarray, two: np.ndarray, doc: np.ndarray) -> bytes:
    """Tokens in order of word and word before: each word and each pair is written once."""
    order = np.lexsort((doc, two, before, word))
    word, before, two, doc = word[order], before[order], two[order], doc[order]
    new_word = np.append(True, word[1:] != word[:-1])
    new_pair = new_word | np.append(True, before[1:] != before[:-1])
    at_word, at_pair = np.flatnonzero(new_word), np.flatnonzero(new_pair)
    per_word = np.diff(np.append(np.searchsorted(at_pair, at_word), len(at_pair))).astype(np.uint32)
    per_pair = np.diff(np.append(at_pair, len(word))).astype(np.uint32)
    parts = [word[at_word], per_word, before[at_pair], per_pair, two, doc.astype(np.uint16)]
    head = np.array([len(at_word), len(at_pair), len(word)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(p).tobytes() for p in parts)]))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n_word, n_pair, n = np.frombuffer(data, np.int64, 3).tolist()
    at, out = 24, []
    for dtype, size in ((np.uint64, n_word), (np.uint32, n_word), (np.uint32, n_pair), (np.uint32, n_pair), (np.uint32, n), (np.uint16, n)):
        out.append(np.frombuffer(data, dtype, size, at))
        at += out[-1].nbytes
    word, per_word, before, per_pair, two, doc = out
    return np.repeat(np.repeat(word, per_word), per_pair), np.repeat(before, per_pair), two, doc


def dealt(docs: DataFrame, known, shards: int, every_context: bool = False) -> DataFrame:
    """shard, batch and data: packed tokens for shards from 0, and for shard -1 what texts have without any shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Frequent = known.value
        number = TaskContext.get().partitionId() << 32
        for whole in pieces(batches, limit=4 << 20):
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                train = b.column(2).to_numpy(zero_copy_only=False)
                w = words(as_array(b.column(1)), lower=True)
                word, hot, before, two, doc, prior = sequences(w, own, every_context)
                n = np.diff(w.starts) + 1
                c = own.counts[np.where(hot, word, 0).astype(np.int64)]
                weight = np.log10(A / (c + A))
                bounds = np.concatenate([[0], np.cumsum(n)])
                base = split_sums(np.where(hot, np.log10(c + 1), 0.0), bounds)
                score = split_sums(np.where(hot, own.log_p1(c) + np.where(word == END, 0.0, weight), 0.0), bounds) + math.log10(A / (own.counts[START] + A))
                seen = split_sums((hot & (c > 0)).astype(np.int64), bounds)
                ids = b.column(0).to_pylist()
                info = zstandard.ZstdCompressor(level=1).compress(pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": n, "base": base, "score": score, "known": seen}).to_parquet())
                after_rare = hot & (prior >= 0) & ~hot[prior]
                shard = shard_of(np.where(after_rare, word[prior], np.where(hot, word ^ mix(before.astype(np.uint64) + np.uint64(1)), word)), shards)
                order = np.argsort(shard, kind="stable")
                names, first = np.unique(shard[order], return_index=True)
                first = np.append(first, len(order))
                data = [packed(word[o], before[o], two[o], doc[o]) for o in (order[first[i] : first[i + 1]] for i in range(len(names)))]
                trained = np.packbits(train).tobytes()
                rows = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(names, -1)), pa.array(np.full(rows + 1, number)), pa.array([*data, info], pa.binary()), pa.array([trained] * (rows + 1), pa.binary())], names=["shard", "batch", "data", "trained"])
                number += 1

    return docs.mapInArrow(work, "shard bigint, batch bigint, data binary, trained binary")


def context_requests(docs: DataFrame, known, shards: int) -> DataFrame:
    """bucket and data: words that are not frequent, with the shards of such words after them in the rows with ``train``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Frequent = known.value
        for b in pieces(batches, limit=4 << 20):
            w = words(as_array(b.column(1)), lower=True)
            h = w.hashes()
            rare = own.ids(h) < 0
            to = shard_of(h | np.uint64(1 << 63), shards)
            first = np.ones(len(w.codes) + 1, bool)
            first[w.starts] = True
            learnt = np.repeat(b.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(w.starts))
            at = np.flatnonzero(~first[1:-1] & rare[w.codes[:-1]] & rare[w.codes[1:]] & learnt[1:]) if len(w.codes) else np.zeros(0, np.int64)
            v, target = np.divmod(np.unique(w.codes[at].astype(np.int64) * shards + to[w.codes[at + 1]]), shards)
            bucket = h[v].view(np.int64) % shards
            order = np.argsort(bucket, kind="stable")
            names, start = np.unique(bucket[order], return_index=True)
            data = []
            for o in np.split(order, start[1:]) if len(names) else []:
                each, size = np.unique(v[o], return_counts=True)  # v is in order
                parts = [np.array([len(each)], np.int64), h[each], size.astype(np.uint32), target[o].astype(np.uint32)]
                data.append(zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return docs.mapInArrow(work, "bucket bigint, data binary")


def _answers(asked: pd.DataFrame, counts: pd.DataFrame, shards: int) -> pd.DataFrame:
    """A row for each shard that a word of the bucket with a count over 1 was asked for: 32-bit words and counts."""
    hashes, targets = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for blob in asked["data"]:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        hashes.append(np.repeat(np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n)))
        targets.append(np.frombuffer(data, np.uint32, -1, 8 + 12 * n))
    counts = counts.sort_values("w")
    w, c = counts["w"].to_numpy(np.int64), counts["c"].to_numpy(np.int64)
    h, target = np.concatenate(hashes).view(np.int64), np.concatenate(targets).astype(np.int64)
    at = np.minimum(np.searchsorted(w, h), max(len(w) - 1, 0))
    hit = np.flatnonzero(w[at] == h) if len(w) else np.zeros(0, np.int64)
    target, at = np.divmod(np.unique(target[hit] * max(len(w), 1) + at[hit]), max(len(w), 1))
    code = short_codes(w.view(np.uint64) | np.uint64(1 << 63))
    names, start = np.unique(target, return_index=True)
    out = []
    for a in np.split(at, start[1:]) if len(names) else []:
        a = a[np.argsort(code[a])]
        out.append(zstandard.ZstdCompressor(level=1).compress(code[a].tobytes() + c[a].astype(np.uint64).tobytes()))
    return pd.DataFrame({"shard": names, "batch": np.full(len(names), -1), "data": out, "trained": [b""] * len(names)})


def context_counts(docs: DataFrame, counts: DataFrame, known, shards: int) -> DataFrame:
    """Rows for shards with batch -1: counts over 1 of the words before their words where neither is frequent."""
    tokens = known.value.tokens
    rare = counts.where((F.col("c") > 1) & (F.col("c") * FREQUENT < tokens)).select(F.pmod("w", F.lit(shards)).alias("bucket"), "w", "c")
    asked = context_requests(docs, known, shards).groupBy("bucket")
    return asked.cogroup(rare.groupBy("bucket")).applyInPandas(lambda a, c: _answers(a, c, shards), "shard bigint, batch bigint, data binary, trained binary")


def shard_sums(word: np.ndarray, before: np.ndarray, two: np.ndarray, train: np.ndarray, known: Frequent, folder: Path | None = None, contexts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token what its shard adds to the base sum and the score, and whether its word is known.

    Counts come from the tokens with ``train``. Frequent words add only their pairs and triples here. ``contexts`` has 32-bit
    words and counts of words that are not frequent and not in this shard; others that come before were seen once. None: they are no contexts.
    """
    names, w = np.unique(word, return_inverse=True)
    hot = names < np.uint64(1 << 63)
    count = np.bincount(w, weights=train, minlength=len(names))
    count[hot] = known.counts[names[hot].astype(np.int64)]
    log_p1 = known.log_p1(count)
    pair_key, pair = np.unique((w.astype(np.uint64) << np.uint64(32)) | before.astype(np.uint64), return_inverse=True)
    pair_count = np.bincount(pair, weights=train, minlength=len(pair_key))
    pair_word, pair_before = (pair_key >> np.uint64(32)).astype(np.int64), pair_key & np.uint64(0xFFFFFFFF)
    has = np.flatnonzero(two != _NONE)
    tri_key, tri = np.unique((pair[has].astype(np.uint64) << np.uint64(32)) | two[has].astype(np.uint64), return_inverse=True)
    tri_count = np.bincount(tri, weights=train[has], minlength=len(tri_key))
    tri_pair, tri_two = (tri_key >> np.uint64(32)).astype(np.int64), tri_key & np.uint64(0xFFFFFFFF)

    p1 = 10 ** log_p1
    seen = pair_count > 0
    as_context = np.where((hot[pair_word] | (contexts is not None)) & (names[pair_word] != END), np.log10(B / (pair_count + B)), 0.0)
    gain2 = np.log10(1 + pair_count / (A * p1[pair_word]))
    level2 = TrieLevel.build(pair_word[seen], pair_before[seen], len(names), {"gain": gain2[seen], "weight": as_context[seen]})
    before_count = known.counts[np.minimum(pair_before, len(known.counts) - 1).astype(np.int64)]
    if contexts is not None:
        code, of_code = (np.concatenate(x) for x in zip(contexts, (short_codes(names[~hot]), count[~hot])))
        code, first = np.unique(code, return_index=True)
        far = np.flatnonzero(pair_before >= 1 << 31)
        at = np.minimum(np.searchsorted(code, pair_before[far]), max(len(code) - 1, 0))
        before_count[far] = np.where(code[at] == pair_before[far], of_code[first][at], 1.0) if len(code) else 1.0
    before_count = before_count[tri_pair]
    p2 = (pair_count[tri_pair] + A * p1[pair_word[tri_pair]]) / (before_count + A)
    seen3 = tri_count > 0
    rank = np.cumsum(seen) - 1  # index of each pair among those seen
    level3 = TrieLevel.build(rank[tri_pair[seen3]], tri_two[seen3], int(seen.sum()), {"gain": np.log10(1 + tri_count / (B * p2))[seen3]})
    if folder is not None:
        level2, level3 = level2.mapped(folder, "pairs"), level3.mapped(folder, "triples")

    at2 = level2.find(pair_word, pair_before)
    of_pair = level2.value("gain", at2) + level2.value("weight", at2)
    at3 = np.full(len(tri_key), -1, np.int64)
    inner = np.flatnonzero(at2[tri_pair] >= 0)
    at3[inner] = level3.find(at2[tri_pair[inner]], tri_two[inner])
    score = of_pair[pair]
    score[has] += level3.value("gain", at3)[tri]
    rare = ~hot
    score += np.where(rare, log_p1 + np.log10(A / (count + A)), 0.0)[w]
    return np.where(rare, np.log10(count + 1), 0.0)[w], score, (rare & (count > 0))[w]


def _shard(f: pd.DataFrame, known: Frequent, every_context: bool = False) -> pd.DataFrame:
    """A row for each batch: packed sums by text; rows of shard -1 go through."""
    if f["shard"].iloc[0] < 0:
        return pd.DataFrame({"batch": f["batch"], "info": True, "data": f["data"]})
    contexts = None
    if every_context:
        sent = [zstandard.ZstdDecompressor().decompress(d) for d in f.loc[f["batch"] < 0, "data"]]
        contexts = tuple(np.concatenate([np.zeros(0, t), *(np.frombuffer(d, t, len(d) // 12, at * (len(d) // 12)) for d in sent)]) for t, at in ((np.uint32, 0), (np.uint64, 4)))
    f = f[f["batch"] >= 0].sort_values("batch")
    parts = [unpacked(d) for d in f["data"]]
    sizes = [len(p[0]) for p in parts]
    word, before, two, doc = (np.concatenate(x) for x in zip(*parts))
    del parts
    batch = np.repeat(np.arange(len(sizes)), sizes)
    train = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8))[d] for t, d in zip(f["trained"], np.split(doc, np.cumsum(sizes)[:-1]))])
    with tempfile.TemporaryDirectory() as folder:
        base, score, seen = shard_sums(word, before, two, train, known, Path(folder), contexts)
    place = batch.astype(np.int64) << 16 | doc.astype(np.int64)
    spot, at = np.unique(place, return_inverse=True)
    out = np.zeros(len(spot), _SUM)
    out["doc"], out["base"], out["score"], out["known"] = spot & 0xFFFF, np.bincount(at, weights=base), np.bincount(at, weights=score), np.bincount(at, weights=seen)
    cut = np.searchsorted(spot >> 16, np.arange(len(sizes) + 1))
    tidy()
    return pd.DataFrame({"batch": f["batch"].to_numpy(), "info": False, "data": [out[cut[i] : cut[i + 1]].tobytes() for i in range(len(sizes))]})


def _batch(f: pd.DataFrame, tokens: int, distinct: int) -> pd.DataFrame:
    """A row for each text of a batch."""
    own = pd.read_parquet(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.loc[f["info"], "data"].iloc[0])))
    s = np.frombuffer(b"".join(f.loc[~f["info"], "data"]), _SUM)
    add = {k: np.bincount(s["doc"], weights=s[k], minlength=len(own)) for k in ("base", "score", "known")}
    n = own["n"].to_numpy()
    return pd.DataFrame({"doc_id": own["doc_id"], "n_tokens": n, "n_known": own["known"].to_numpy() + add["known"].astype(np.int64), "train_tokens": tokens, "base_score": own["base"].to_numpy() + add["base"] - n * math.log10(tokens + distinct + 1), "score": own["score"].to_numpy() + add["score"]})


def score(docs: DataFrame, learn: Column, shard_tokens: int = SHARD_TOKENS, every_context: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of each row.

    ``docs`` should be a table: it is read more than once and must give the same rows in the same partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    texts, every, size = rows.agg(F.count_if("train"), F.count("*"), F.sum(F.octet_length("text"))).first()
    counts = stored(word_counts(rows), "counts")
    known = frequent(counts, texts)
    share = max(texts, 1) / max(every, 1)
    shards = max(1, math.ceil((known.tokens / share if texts else (size or 0) / 6) / shard_tokens))
    sent = spark.sparkContext.broadcast(known)
    tokens_of = dealt(rows, sent, shards, every_context)
    if every_context:
        tokens_of = tokens_of.unionByName(context_counts(rows, counts, sent, shards))
    sums = tokens_of.groupBy("shard", F.when(F.col("shard") < 0, F.col("batch")).otherwise(-1).alias("own")).applyInPandas(lambda f: _shard(f, sent.value, every_context), "batch bigint, info boolean, data binary")
    tokens, distinct = known.tokens, known.distinct
    return sums.groupBy("batch").applyInPandas(lambda f: _batch(f, tokens, distinct), "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(parts=7) != 2, every_context=True)
    return out.select("doc_id", (fold(parts=7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
