"""Seed retrieval for many queries at once: BM25, recency, vectors, rank fusion, explicit references, identifier chase.

``search`` and ``dense`` compare a stated query set with all rows in blocks: rows are cut into blocks, every block is held
by one task as an index or a matrix, and the queries stream through it, so that neither rows nor queries are collected or
broadcast; each block gives its best k rows a query.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.runtime import cut, ranked, round6, spread

K1, B = 1.5, 0.75
RRF_K = 60
DIM = 256
MAX_QUERY_TERMS = 100_000  #: (query, term) rows that may be broadcast; more are joined by shuffle
BLOCK_ROWS = 32_768  #: rows of one block, as far as hashing spreads them
PINS_PER_REFERENCE = 8


def bm25(docs: DataFrame, queries: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(query_id, keys, score): documents that share a term with a query; scores rounded to 6 decimals.

    ``queries``: query_id, query. Query terms count with their multiplicity. Null and empty texts have no terms
    but count as documents. Only postings of query terms are shuffled.
    """
    q = queries.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    small = q.count() <= MAX_QUERY_TERMS
    qs = F.broadcast(q) if small else q
    wanted = q.select("term").distinct()
    d = docs.select(*keys, T.terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    n = d.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    post = d.select(*keys, F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    tf, dl = F.col("tf"), F.col("dl")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl"))) * F.col("qtf")
    return post.join(F.broadcast(df) if small else df, "term").join(qs, "term").crossJoin(F.broadcast(n)).groupBy("query_id", *keys).agg(round6(F.sum(part)).alias("score"))  # n is one row


def top(scores: DataFrame, keys: list[str], k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with contiguous ranks from 0; ties by key. Each task keeps k rows a query before the
    shuffle (the bound on the row number is a group limit)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *keys)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def full_ranks(scores: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of each query with their rank, by a range sort; for lists of any length."""
    return ranked(scores.withColumn("_down", -F.col("score")), ["query_id"], ["_down", *keys], "rank").drop("_down").withColumn("rank", F.col("rank").cast("int"))


def last_n(ev: DataFrame, k: int) -> DataFrame:
    """Newest k events of each session, score 1 / (1 + rank)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("ts"), "event_id")
    best = ev.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)  # a group limit: k rows a session and task are sorted
    return best.withColumn("rank", F.col("rank") - 1).withColumn("score", round6(1 / (1 + F.col("rank"))))


def fuse(lists: list[tuple[DataFrame, float]], keys: list[str], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, keys, rank)."""
    parts = [d.select("query_id", *keys, (F.lit(w) / (RRF_K + F.col("rank") + 1)).alias("s")) for d, w in lists if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return top(both.groupBy("query_id", *keys).agg(round6(F.sum("s")).alias("score")), keys, k)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by place; places are in order of the keys."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _blocked(rows: DataFrame, queries: DataFrame, key: str, payload: list[str], search, k: int) -> DataFrame:
    """(query_id, key, score, rank) of the k best rows of every query.

    ``rows``: key and the payload columns; ``queries``: query_id and the same payload columns. ``search(index, q)`` gives
    the scores of a block's rows for a query, ``search(None, rows)`` the index of a block.
    """
    kind, qkind = rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    of = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    a = rows.select(of.alias("block"), F.lit(0).alias("part"), F.col(key).alias("k"), F.lit(None).cast(qkind).alias("q"), *payload)
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("part"), F.lit(None).cast(kind).alias("k"), F.col("query_id").alias("q"), *payload)
    ordered = spread(a.unionByName(b), "block", at_least=min(n, 4096)).sortWithinPartitions("block", "part", "k", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, held, index = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("block", "part", "k", "q", *payload)]
            for blk, part, key_, q, *data in zip(*cols):
                if blk != block:
                    block, keys, held, index = blk, [], [], None
                if part == 0:
                    keys.append(key_)
                    held.append(data)
                    continue
                if index is None:
                    index, held = (search(None, held), held)
                if keys:
                    score = np.round(search(index, data), 6) + 0.0
                    out += [(q, keys[i], float(score[i])) for i in _best(score, k)]
            if out:
                x, y, z = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, _arrow(qkind)), pa.array(y, _arrow(kind)), pa.array(z, pa.float64())], names=["query_id", key, "score"])

    return top(ordered.mapInArrow(run, f"query_id {qkind}, `{key}` {kind}, score double"), [key], k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _bm25_search(index, data):
    if index is None:
        postings: dict[str, list] = {}
        for i, (terms, weights) in enumerate(data):
            for t, w in zip(terms or (), weights or ()):
                p = postings.setdefault(t, [[], []])
                p[0].append(i)
                p[1].append(w)
        return len(data), {t: (np.array(i), np.array(w)) for t, (i, w) in postings.items()}
    score = np.zeros(index[0])
    for t, w in zip(data[0] or (), data[1] or ()):
        p = index[1].get(t)
        if p is not None:
            score[p[0]] += p[1] * w
    return score


def search(docs: DataFrame, queries: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """(query_id, key, score, rank): BM25 over whole texts for a query set of any size.

    Query terms count with their multiplicity; null and empty texts count as documents; documents without a term of
    the query have score 0 and follow by key. Only the query set's terms are weighed.
    """
    d = docs.select(key, T.terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    n = d.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    tf = d.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = tf.crossJoin(F.broadcast(n)).groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list(norm).alias("weights"))  # n is one row
    rows = docs.select(key).join(weighed, key, "left")
    q = queries.select("query_id", F.explode(T.terms(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")
    asked = q.join(df, "term").crossJoin(F.broadcast(n)).groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(idf).alias("weights"))
    return _blocked(rows, queries.select("query_id").join(asked, "query_id", "left"), key, ["terms", "weights"], _bm25_search, k)


def _dense_search(index, data):
    if index is None:
        dim = max((len(v[0]) for v in data if v[0] is not None), default=0)
        m = np.array([v[0] if v[0] is not None and len(v[0]) == dim else [0.0] * dim for v in data], dtype=np.float64).reshape(len(data), dim)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    v = np.array(data[0] if data[0] is not None else [], dtype=np.float64)
    if len(v) != index.shape[1]:
        return np.zeros(len(index))
    return index @ (v / max(np.linalg.norm(v), 1e-300))


def dense(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): cosine top k of each query over all rows. A vector that is null, empty, zero or of
    another length has cosine 0."""
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    return _blocked(vectors.select(key, F.col(vector).cast("array<double>").alias("v")), q, key, ["v"], _dense_search, k)


# --- fusion without full lists ----------------------------------------------------------------------------------------

BLOCK_TERMS = 8_000_000  #: words of the texts of one block, as far as hashing spreads them
LEAST_BLOCK_ROWS = 16_384  #: smaller blocks are not made only to keep all cores busy
DENSE_SHARE, DENSE_TERMS = 0.1, 384  #: words that so many of a block's rows have, and so many of them, are held as a matrix
ASKED_AT_ONCE = 64


def blake_slot(word: str) -> int:
    """The hash of ``hashing_embed``: the lowest bit is the sign, the rest gives the slot."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, key=b"0").digest(), "big")


class _Block:
    """Rows of one block, in order of their keys, as an index for both arms; scores are whole millionths."""

    def __init__(self, slot, dim: int):
        self.slot, self.dim, self.slots, self.keys, self.parts, self.n, self.built = slot, dim, {}, [], [], 0, False  # slots: of words that no row has
        self.ids: dict[str, int] = defaultdict(itertools.count().__next__)

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        id_of, lengths, words = self.ids.__getitem__, np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts.to_pylist()):
            found = _words(text)
            lengths[i] = len(found)
            words.extend(map(id_of, found))
        row = np.repeat(np.arange(self.n, self.n + len(texts), dtype=np.int64), lengths)
        pairs, tf = np.unique((row << 32) + np.array(words, dtype=np.int64), return_counts=True)
        self.parts.append((pairs, tf.astype(np.int32), lengths))
        self.keys += keys.to_pylist()
        self.kind = keys.type
        self.n += len(texts)

    def build(self, avgdl: float) -> None:
        pairs, tf, lengths = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.built, self.key_array = [], True, pa.array(self.keys, self.kind)
        row, term = pairs >> 32, pairs & 0xFFFFFFFF
        at, sign = self.hashed(list(self.ids))
        self.at, self.sign = at.tolist(), sign.tolist()
        v = np.bincount(at[term] * self.n + row, weights=sign[term] * (1.0 + np.log(tf)), minlength=self.dim * self.n).reshape(self.dim, self.n)
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->j", v, v)), 1e-300)
        self.vectors = v
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / avgdl))
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weight[order]
        df = np.bincount(term, minlength=len(self.ids))
        self.ends = np.cumsum(df)
        self.starts, self.ends = (self.ends - df).tolist(), self.ends.tolist()
        often = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        often = often[df[often] >= DENSE_SHARE * self.n]
        self.column = {int(t): i for i, t in enumerate(often)}
        self.often = np.zeros((len(often), self.n))
        for i, t in enumerate(often):
            self.often[i, self.rows[self.starts[t] : self.ends[t]]] = self.weights[self.starts[t] : self.ends[t]]

    def hashed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashes = [self.slot(w) for w in words]
        return np.array([(h >> 1) % self.dim for h in hashes], dtype=np.int64), np.array([1.0 if h & 1 else -1.0 for h in hashes])

    def lexical(self, asked: list[tuple], n: int) -> np.ndarray:
        """``asked``: words, their counts and numbers of documents, of each query."""
        q, rare = np.zeros((len(asked), len(self.often))), []
        id_of, column_of = self.ids.get, self.column.get
        for own, (words, counts, df) in zip(q, asked):
            ids, weights = list(map(id_of, words)), (np.log(1 + (n - df + 0.5) / (df + 0.5)) * counts).tolist()
            columns = list(map(column_of, ids))
            for c, x in zip(columns, weights):
                if c is not None:
                    own[c] = x
            rare.append([(t, x) for t, c, x in zip(ids, columns, weights) if c is None and t is not None])
        score = q @ self.often
        for own, words in zip(score, rare):
            for t, x in words:
                a, b = self.starts[t], self.ends[t]
                own[self.rows[a:b]] += self.weights[a:b] * x
        return _millionths(score)

    def dense(self, asked: list[tuple]) -> np.ndarray:
        q = np.zeros((len(asked), self.dim))
        for own, (words, counts, _) in zip(q, asked):
            ids = list(map(self.ids.get, words))
            for w in (w for w, t in zip(words, ids) if t is None and w not in self.slots):
                self.slots[w] = [x.tolist()[0] for x in self.hashed([w])]
            at = np.array([self.slots[w][0] if t is None else self.at[t] for w, t in zip(words, ids)], dtype=np.int64)
            sign = np.array([self.slots[w][1] if t is None else self.sign[t] for w, t in zip(words, ids)])
            own += np.bincount(at, weights=sign * (1.0 + np.log(counts)), minlength=self.dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        return _millionths(q @ self.vectors)


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays; null as an empty one."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.array(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]


def _millionths(score: np.ndarray) -> np.ndarray:
    np.multiply(score, 1e6, out=score)
    return np.rint(score, out=score)


def _before(score: np.ndarray, keys: list, wanted: list[tuple]) -> list[int]:
    """How many rows stand before each (key, score) in a list by score, ties by key; ``keys`` are in order."""
    if len(wanted) > 16:
        ordered = np.sort(score)
        higher = len(score) - np.searchsorted(ordered, [s for _, s in wanted], "right")
    else:
        higher = [np.count_nonzero(score > s) for _, s in wanted]
    return [int(h) + int(np.count_nonzero(score[: bisect.bisect_left(keys, k)] == s)) for h, (k, s) in zip(higher, wanted)]


def _met(docs: DataFrame, queries: DataFrame, key: str, blocks: int, answer, schema: str, avgdl: float, slot, dim: int) -> DataFrame:
    """Every block of ``docs`` (key, text) meets all ``queries`` (query_id, words and further columns) in one task;
    ``answer(block, rows)`` gives the columns of ``schema`` for some queries' rows."""
    kind, more = docs.schema[key].dataType.simpleString(), [f for f in queries.schema if f.name != "query_id"]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in more]
    a = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("part"), F.col(key).alias("k"), "text", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *empty)
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("part"), F.lit(None).cast(kind).alias("k"), F.lit(None).cast("string").alias("text"), "query_id", *[f.name for f in more])
    ordered = a.unionByName(b).repartitionById(blocks, F.col("block")).sortWithinPartitions("part", "k", "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(slot, dim)
        for batch in batches:
            n = batch.column("part").to_pylist().count(0)  # parts are in order
            if n:
                block.add(batch.column("k").slice(0, n), batch.column("text").slice(0, n))
            if n == batch.num_rows or not block.n:
                continue
            if not block.built:
                block.build(avgdl)
            for at in range(n, batch.num_rows, ASKED_AT_ONCE):
                yield answer(block, batch.slice(at, ASKED_AT_ONCE))

    return ordered.mapInArrow(run, schema)


def hybrid(docs: DataFrame, queries: DataFrame, key: str, k: int, slot=blake_slot, dim: int = DIM, blocks: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query by the fused ranks of ``search`` and ``dense``
    over all documents, as ``fuse`` gives them of both full lists, with hashed words as vectors.

    No full list is made. The k first of one list score above 1 / (60 + k), so what stands behind rank ``far`` in both lists
    cannot be among the k best. Each block gives its ``far`` best of either list with both scores. Merged, they are the
    whole list down to the first block's last row, which is behind rank ``far``, and give least ranks below it. A document
    that these bounds leave in is, where its rank is not known, ranked by counting the rows before it in every block.
    ``docs``: key and text, keys are unique.
    """
    kind, qkind = docs.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    docs = docs.select(key, "text")
    words = T.terms(F.coalesce("text", F.lit("")))
    each = docs.select(words.alias("terms")).select(F.size("terms").alias("dl"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit("")))).alias("word"))
    known = cut(each.groupBy("word").agg(F.count("*").alias("df"), F.sum("dl").alias("total")))
    all_ = known.filter("word = ''").first()  # every text has one such row
    n, total = (all_["df"], all_["total"]) if all_ else (0, 0)
    avgdl = max(total / max(n, 1), 1e-300)
    if blocks is None:
        busy = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_BLOCK_ROWS)
        blocks = max(1, busy, -(-n // BLOCK_ROWS), -(-total // BLOCK_TERMS))
    least = 1 / (RRF_K + k) - 2e-6  # scores are rounded to millionths
    far = min(n, math.ceil(2 / least) - RRF_K) if least > 0 else n

    q = queries.select("query_id", F.explode(T.terms(F.coalesce("query", F.lit("")))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("qtf"))
    lists = q.join(known, "word", "left").groupBy("query_id").agg(F.collect_list(F.struct("word", "qtf", F.coalesce("df", F.lit(0)).alias("df"))).alias("w"))
    asked = cut(queries.select("query_id").join(lists.select("query_id", F.concat_ws(" ", "w.word").alias("words"), F.col("w.qtf").alias("counts"), F.col("w.df").alias("dfs")), "query_id", "left"))

    def of(rows: pa.RecordBatch) -> list[tuple]:
        return [((w or "").split(), c, d) for w, c, d in zip(rows.column("words").to_pylist(), _lists(rows.column("counts")), _lists(rows.column("dfs")))]

    def best(block: _Block, rows: pa.RecordBatch) -> pa.RecordBatch:
        what, places, x, y = of(rows), [], [], []
        for a, b in zip(block.lexical(what, n), block.dense(what)):
            places.append(at := np.union1d(_best(a, far), _best(b, far)))
            x.append(a[at])
            y.append(b[at])
        ends = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
        values = (block.key_array.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(x)), pa.array(np.concatenate(y)))
        return pa.RecordBatch.from_arrays([rows.column("query_id"), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=["query_id", "keys", "lex", "den"])

    def counted(block: _Block, rows: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        what, ids = of(rows), rows.column("query_id").to_pylist()
        for arm, (names, values) in enumerate((("lex_keys", "lex"), ("den_keys", "den"))):
            wanted = [list(zip(ks, ss)) for ks, ss in zip(rows.column(names).to_pylist(), rows.column(values).to_pylist())]
            some = [j for j, w in enumerate(wanted) if w]
            if not some:
                continue
            these = [what[j] for j in some]
            for j, score in zip(some, block.dense(these) if arm else block.lexical(these, n)):
                for (k_, _), c in zip(wanted[j], _before(score, block.keys, wanted[j])):
                    for o, v in zip(out, (ids[j], k_, None if arm else c, c if arm else None)):
                        o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (_arrow(qkind), _arrow(kind), pa.int64(), pa.int64()))], names=["query_id", key, "a", "b"])

    lists_of = _met(docs, asked, key, blocks, best, f"query_id {qkind}, keys array<{kind}>, lex array<double>, den array<double>", avgdl, slot, dim)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left_in(query, parts):
            keys, lex, den = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order, ends = np.unique(keys, return_inverse=True)[1], np.cumsum([len(p[0]) for p in parts]).tolist()
            rank, known = np.empty((2, len(keys)), dtype=np.int64), np.empty((2, len(keys)), dtype=bool)
            for r, sure, s in zip(rank, known, (lex, den)):
                r[np.lexsort((order, -s))] = np.arange(len(keys))
                lasts = [np.partition(r[a:b], far - 1)[far - 1] for a, b in zip([0, *ends], ends) if b - a >= far]  # a block with fewer rows gives all
                np.less_equal(r, min(lasts, default=n), out=sure)
            low, high = ((1 / (RRF_K + 1 + r)).sum(axis=0) for r in (np.where(known, rank, n), rank))
            at = np.flatnonzero(high >= (np.sort(low)[-k] if len(low) >= k else 0) - 2e-6)
            return [(query, x, lex[i], den[i], *(int(r[i]) if sure[i] else None for r, sure in zip(rank, known))) for i, x in zip(at, keys[at].tolist())]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(zip(*out), (_arrow(qkind), _arrow(kind), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], names=["query_id", key, "lex", "den", "a", "b"])

        query, parts, out = None, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                for q_, ks, x, y in zip(some.column("query_id").to_pylist(), *(_lists(some.column(c)) for c in ("keys", "lex", "den"))):
                    if parts and q_ != query:
                        out += left_in(query, parts)
                        parts = []
                    query = q_
                    parts.append((ks, x, y))
                if len(out) > 1000:
                    yield batch_of(out)
                    out = []
        if parts:
            out += left_in(query, parts)
        if out:
            yield batch_of(out)

    left = cut(spread(lists_of, "query_id").sortWithinPartitions("query_id").mapInArrow(merged, f"query_id {qkind}, `{key}` {kind}, lex double, den double, a bigint, b bigint"))
    unknown = lambda rank, score: F.collect_list(F.when(F.col(rank).isNull(), F.struct(F.col(key).alias("k"), F.col(score).alias("s"))))
    placed = left
    open_ = left.filter("a is null or b is null")
    if not open_.isEmpty():
        open_ = open_.groupBy("query_id").agg(unknown("a", "lex").alias("x"), unknown("b", "den").alias("y"))
        open_ = asked.join(open_.select("query_id", F.col("x.k").alias("lex_keys"), F.col("x.s").alias("lex"), F.col("y.k").alias("den_keys"), F.col("y.s").alias("den")), "query_id")
        counts = _met(docs, open_, key, blocks, counted, f"query_id {qkind}, `{key}` {kind}, a bigint, b bigint", avgdl, slot, dim)
        counts = counts.groupBy("query_id", key).agg(F.sum("a").alias("more_a"), F.sum("b").alias("more_b"))
        placed = left.join(counts, ["query_id", key], "left").select("query_id", key, F.coalesce("a", "more_a").alias("a"), F.coalesce("b", "more_b").alias("b"))
    one = lambda rank: F.lit(1.0) / (RRF_K + F.col(rank) + 1)
    return top(placed.select("query_id", key, round6(one("a") + one("b")).alias("score")), [key], k)


# --- vectors from texts -----------------------------------------------------------------------------------------------


def hashing_embed(texts: list[str | None], dim: int = DIM, seed: int = 0) -> list[list[float]]:
    """Signed hashing of words with a keyed BLAKE2b, weight 1 + ln(count), unit length; no words give zeros."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        words, counts = np.unique(np.array([w for w in _words(text)], dtype=object), return_counts=True) if text else ((), ())
        for w, n in zip(words, counts):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8, key=str(seed).encode()[:64]).digest(), "big")
            v[(h >> 1) % dim] += (1.0 if h & 1 else -1.0) * (1.0 + math.log(n))
        length = math.sqrt(float(v @ v))
        out.append((v / length if length else v).tolist())
    return out


def _words(text: str | None) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", (text or "").lower())


def embedded(rows: DataFrame, keys: list[str], embed_fn=hashing_embed, text: str = "text") -> DataFrame:
    """Rows with ``embedding`` by any function from texts to vectors, in Arrow batches.

    Raises where the function gives another number of vectors, vectors of different lengths, or values that are not finite.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        for b in batches:
            texts = b.column(text).to_pylist()
            got = embed_fn(texts)
            if len(got) != len(texts):
                raise ValueError(f"{len(texts)} texts gave {len(got)} vectors")
            for v in got:
                width = len(v) if width is None else width
                if len(v) != width or not all(map(math.isfinite, v)):
                    raise ValueError("vectors of different lengths or values that are not finite")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(got, pa.list_(pa.float64()))], names=[*keys, "embedding"])

    return rows.select(*keys, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", embedding array<double>")


def md5_vectors(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, embedding) as by ``hashing_embed`` but with MD5 and wholly in columns, so that SQL can check it."""
    words = rows.select(key, F.explode(T.terms(F.coalesce(F.col(text), F.lit("")))).alias("w")).groupBy(key, "w").agg(F.count("*").cast("double").alias("n"))
    h = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    x = (1 + F.log("n")) * F.when(h % 2 == 1, 1.0).otherwise(-1.0)
    sums = words.select(key, (F.floor(h / 2) % dim).cast("int").alias("i"), x.alias("x")).groupBy(key, "i").agg(F.sum("x").alias("x"))
    maps = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return rows.select(key).join(maps.select(key, full.alias("embedding")), key, "left")


# --- explicit references ----------------------------------------------------------------------------------------------

# fixed values: how a question names a step, a call or an event
REFERENCES = (
    ("event", r"(?i)\bevent[\s_\-#:]*([A-Za-z0-9][A-Za-z0-9_\-.]*)"), ("step", r"(?i)\bstep[\s_\-#:]*([A-Za-z0-9][A-Za-z0-9_\-.]*)"),
    ("tool_call", r"(?i)\btool[\s_\-]?call[\s_\-#:]*([A-Za-z0-9][A-Za-z0-9_\-.]*)"), ("quoted", "[\"'`]([^\"'`\n]{1,300})[\"'`]"), ("bare", r"([A-Za-z0-9][A-Za-z0-9_\-./]*)"),
)
PREFIXES = {"step": ("", "step"), "tool_call": ("", "toolcall", "tc"), "event": ("", "event", "ev", "e")}


def references(queries: DataFrame) -> DataFrame:
    """(query_id, session_id, ref_kind, raw, at): what a question names, each kind and spelling once, in order.

    Bare words count only if they look like ids or paths: a digit, a mark, or eight letters.
    """
    out = None
    for kind, rx in REFERENCES:
        raw = F.btrim("raw") if kind == "quoted" else F.col("raw")
        d = queries.select("query_id", "session_id", "query", F.explode(F.regexp_extract_all("query", F.lit(rx), F.lit(1))).alias("raw"))
        d = d.select("query_id", "session_id", F.lit(kind).alias("ref_kind"), raw.alias("raw"), F.expr("instr(query, raw)").alias("at"))
        if kind == "bare":
            d = d.filter((F.length("raw") >= 2) & (F.regexp_like("raw", F.lit(r"[0-9_\-./:]")) | (F.length("raw") >= 8)))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("query_id", "session_id", "ref_kind", F.lower("raw").alias("low")).agg(F.min(F.struct("at", "raw")).alias("f")).select("query_id", "session_id", "ref_kind", F.col("f.raw").alias("raw"), F.col("f.at").alias("at"))


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def pins(queries: DataFrame, ev: DataFrame, paths: bool = True) -> DataFrame:
    """(query_id, session_id, event_id, rank): the events that questions name, in order of the naming, at most eight for a
    reference (the earliest). What names no event gives nothing.

    ``queries``: query_id, session_id, query. ``ev``: session_id, event_id, ts, step_id, tool_call_id, native_ref, meta, text.
    Names are compared by letters and digits alone, with the usual prefixes; paths match a native reference or a value of
    meta as a whole or from a slash on, or stand in the text.
    """
    refs = cut(references(queries).withColumn("key", _norm(F.col("raw"))))
    at = ["query_id", "session_id", "ref_kind", "raw", "at"]
    e = ev.select("session_id", "event_id", F.coalesce("ts", F.lit(0)).alias("ts"), "step_id", "tool_call_id", "native_ref", "meta", "text")
    hits = None
    for column, kind in (("step_id", "step"), ("tool_call_id", "tool_call"), ("event_id", "event")):
        ids = e.filter(F.col(column).isNotNull()).select("session_id", "event_id", "ts", _norm(F.col(column)).alias("norm"))
        asked = refs.filter(F.col("ref_kind").isin(kind, "bare", "quoted") & ((F.col("key") != "") | (F.col("ref_kind") == "quoted")))
        asked = asked.withColumn("norm", F.explode(F.array(*[F.concat(F.lit(p), "key") for p in PREFIXES[kind]])))
        got = asked.join(ids, ["session_id", "norm"]).select(*at, "event_id", "ts")
        hits = got if hits is None else hits.unionByName(got)
    if paths:
        named = refs.filter(F.col("ref_kind").isin("bare", "quoted") & (F.contains("raw", F.lit("/")) | F.regexp_like("raw", F.lit(r"\.[A-Za-z0-9]{1,6}$")))).withColumn("needle", F.regexp_replace("raw", r"^\./", "")).filter("needle <> ''")
        whole = lambda c: (c == F.col("raw")) | (c == F.col("needle")) | F.endswith(c, F.concat(F.lit("/"), "needle"))
        same = F.coalesce(whole(F.col("native_ref")), F.lit(False)) | F.coalesce(F.exists(F.map_values("meta"), lambda v: F.coalesce(whole(v), F.lit(False))), F.lit(False)) | F.coalesce(F.contains("text", F.col("needle")), F.lit(False))
        hits = hits.unionByName(named.join(e, "session_id").filter(same).select(*at, "event_id", "ts"))
    w = Window.partitionBy("query_id", "ref_kind", "raw").orderBy("ts", "event_id")
    few = hits.distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PINS_PER_REFERENCE)
    first = few.groupBy("query_id", "session_id", "event_id").agg(F.min(F.struct("at", "ref_kind", "raw", "r")).alias("o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o")) - 1).select("query_id", "session_id", "event_id", "rank")


def pinned(pin: DataFrame, fill: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Pins first, never cut; then the other list (query_id, keys, rank) as far as k goes; ranks anew, ``pinned`` marks."""
    n = pin.groupBy("query_id").agg(F.count("*").alias("pins"))
    rest = fill.join(pin.select("query_id", *keys), ["query_id", *keys], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", *keys)))
    rest = rest.filter(F.col("r") <= k).join(n, "query_id", "left").filter(F.col("r") <= F.greatest(F.lit(0), k - F.coalesce("pins", F.lit(0)))).select("query_id", *keys, F.lit(False).alias("pinned"), "rank")
    both = pin.select("query_id", *keys, F.lit(True).alias("pinned"), "rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("pinned"), "rank", *keys)) - 1)


def given_seeds(gold: DataFrame, ev: DataFrame) -> DataFrame:
    """(query_id, session_id, event_id, rank) of listed ids in their order; ``gold``: query_id, session_id, ids. An id that is no
    event raises when the result is computed."""
    g = gold.select("query_id", "session_id", F.posexplode("ids").alias("rank", "event_id")).join(ev.select("session_id", "event_id", F.lit(True).alias("known")), ["session_id", "event_id"], "left")
    known = F.when(F.col("known"), F.col("event_id")).otherwise(F.raise_error(F.concat(F.lit("no such event: "), "event_id")))
    return g.select("query_id", "session_id", known.alias("event_id"), "rank")


def recent_seeds(ev: DataFrame, n: int = 3) -> DataFrame:
    """(session_id, event_id, rank): the newest n tool results of every session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    best = ev.filter("kind = 'tool_result'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return best.select("session_id", "event_id", (F.col("rank") - 1).alias("rank"))


def identifier_chase(seeds: DataFrame, queries: DataFrame, ev: DataFrame, rounds: int = 4, per_round: int = 8, add: int = 6, most: int = 24, df_most: int = 8) -> DataFrame:
    """(query_id, session_id, event_id, round): seeds (round 0) and events found by chasing identifiers, round by round.

    A round takes the identifiers of what has been found that stand in 2 to ``df_most`` events of the session, those on
    lines that share words with the question first, then the rarer and longer ones, ``per_round`` of them; and adds the events
    with the most of them, earliest first: ``add`` a round, ``most`` in all.
    """
    key = ["query_id", "event_id"]
    lines = ev.select("session_id", "event_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter("line <> ''")
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower))
    on_line = cut(lines.select("session_id", "event_id", words(F.col("line")).alias("words"), F.explode(T.identifiers(F.col("line"))).alias("ident")))
    holds = on_line.select("session_id", "event_id", "ident").distinct()
    df = holds.groupBy("session_id", "ident").agg(F.count("*").alias("df")).filter(F.col("df").between(2, df_most))
    q = queries.select("query_id", words(F.coalesce("query", F.lit(""))).alias("asked"))
    have = cut(seeds.select("query_id", "session_id", "event_id").distinct().withColumn("round", F.lit(0)))
    known = None
    for n in range(1, rounds + 1):
        near = F.size(F.array_intersect("words", "asked"))
        cand = have.join(on_line, ["session_id", "event_id"]).join(q, "query_id").groupBy("query_id", "session_id", "ident").agg(F.max(near).alias("near")).join(df, ["session_id", "ident"])
        if known is not None:
            cand = cand.join(known, ["query_id", "ident"], "left_anti")
        w = Window.partitionBy("query_id").orderBy(F.desc("near"), "df", F.desc(F.length("ident")), "ident")
        picked = cut(cand.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_round).select("query_id", "session_id", "ident"))
        if picked.isEmpty():
            break
        known = picked.select("query_id", "ident") if known is None else known.unionByName(picked.select("query_id", "ident"))
        hits = picked.join(holds, ["session_id", "ident"]).groupBy("query_id", "session_id", "event_id").agg(F.count("*").alias("n")).join(have.select(*key), key, "left_anti").join(ev.select("session_id", "event_id", "pos"), ["session_id", "event_id"])
        so_far = have.filter("round > 0").groupBy("query_id").agg(F.count("*").alias("added"))
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "pos")
        new = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= add).join(so_far, "query_id", "left").filter(F.col("r") + F.coalesce("added", F.lit(0)) <= most)
        new = cut(new.select("query_id", "session_id", "event_id", F.lit(n).alias("round")))
        if new.isEmpty():
            continue
        have = have.unionByName(new)
    return have


# --- named routers ----------------------------------------------------------------------------------------------------
ROUTER_DEFAULTS = {"k": 8, "rrf_k": RRF_K, "dense_dim": DIM, "lexical_weight": 1.0, "dense_weight": 1.0, "pin_first": True}


def router_config(**given) -> dict:
    """Checked settings of a router; unknown names, counts below 1 and negative weights raise."""
    if unknown := set(given) - set(ROUTER_DEFAULTS):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    c = {**ROUTER_DEFAULTS, **given}
    if any(not isinstance(c[n], int) or isinstance(c[n], bool) or c[n] < 1 for n in ("k", "rrf_k", "dense_dim")) or any(c[n] < 0 for n in ("lexical_weight", "dense_weight")) or not c["lexical_weight"] + c["dense_weight"]:
        raise ValueError(f"settings out of range: {c}")
    return c


def make_router(name: str, **given):
    """A function (docs, queries) -> (query_id, key, score, rank) by name: lexical, dense, hybrid.

    docs: the key column ``doc_id`` and text; queries: query_id (of the key's type) and query.
    """
    c = router_config(**given)

    def vectors(d: DataFrame, key: str, text: str) -> DataFrame:
        return embedded(d.select(F.col(key).alias("vec_id"), F.col(text).alias("text")), ["vec_id"], lambda xs: hashing_embed(xs, c["dense_dim"]))

    def lexical(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return search(docs, queries, "doc_id", k)

    def by_vectors(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return dense(vectors(docs, "doc_id", "text"), vectors(queries, "query_id", "query"), k).withColumnRenamed("vec_id", "doc_id")

    def hybrid(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        n = docs.count()
        return fuse([(lexical(docs, queries, n), c["lexical_weight"]), (by_vectors(docs, queries, n), c["dense_weight"])], ["doc_id"], k)

    routers = {"lexical": lexical, "dense": by_vectors, "hybrid": hybrid}
    if name not in routers:
        raise ValueError(f"unknown router {name!r}, want one of {sorted(routers)}")
    return lambda docs, queries: routers[name](docs, queries, c["k"])
