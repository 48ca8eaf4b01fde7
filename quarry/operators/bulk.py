"""BM25 of many long queries: rows of ``lexical.search`` by sums over blocks of postings, not by a join of them.

A join has a row for each posting and each query that asks for its term, which grows with the square
of the documents where those are the queries. Here documents are packed into blocks of postings, queries into
blocks of weights, and each block meets each: frequent terms in matrix products, the others by adding
up. Each task keeps the k best of its queries over all blocks that it sees, so nothing else is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.lexical import FLOOR, K1, B
from quarry.session import send_source

#: Tokens in a block of documents, terms in a block of queries, and queries whose scores are held at once.
TOKENS, ASKED, STEP = 500_000, 1_000_000, 256
#: Groups that the blocks of documents are dealt to, the same for many queries, and the share of a block's documents from which a term is dense.
GROUPS, MANY_GROUPS, DENSE = 12, 2, 0.05
#: Digits of a score: copies tie, in whatever order sums are made.
DIGITS = 9


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists; a null is an empty one."""
    found = batch.column(column)
    return np.array(pc.fill_null(pc.list_value_length(found), 0)), found.flatten()


def _one(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _blocks(docs: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """docs(doc_id, text) in blocks: ids, terms, and for each term its documents and counts; n counts rows without an id too."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]):
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, tokens, held, rows = [], [], [], 0, 0

        def block():
            known, n = np.concatenate(sizes), sum(map(len, sizes))
            coded = pa.concat_arrays(tokens).dictionary_encode()
            key = np.asarray(coded.indices).astype(np.int64) * max(n, 1) + np.repeat(np.arange(n), known)
            key, tf = np.unique(key, return_counts=True)
            at = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * max(n, 1))
            arrays = [(part << 32) + made, rows, _one(pa.concat_arrays(ids), ids[0].type), _one(coded.dictionary, pa.string()), at.astype("<i8").tobytes(), (key % max(n, 1)).astype("<i4").tobytes(), tf.astype("<i4").tobytes()]
            return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array([a]) for a in arrays], names=["block", "n", "ids", "terms", "at", "docs", "tf"])

        for whole in batches:
            start = 0
            while start < whole.num_rows:
                # As many rows as the block has room for, and one at least.
                size = np.cumsum(_lists(whole.slice(start), 1)[0])
                batch = whole.slice(start, max(1, int(np.searchsorted(size, TOKENS - held, "right"))))
                start, rows = start + batch.num_rows, rows + batch.num_rows
                batch = batch.filter(batch.column(0).is_valid())
                lengths, flat = _lists(batch, 1)
                ids.append(batch.column(0))
                sizes.append(lengths)
                tokens.append(flat)
                held += len(flat)
                if held >= TOKENS:
                    yield block()
                    made, ids, sizes, tokens, held, rows = made + 1, [], [], [], 0, 0
        if rows:
            yield block()

    return docs.select("doc_id", tokenizer(F.col("text")).alias("tokens")).mapInArrow(run, f"block long, n long, ids array<{kind}>, terms array<string>, at binary, docs binary, tf binary")


def _tally(held: DataFrame) -> DataFrame:
    """(block, nth, term, df, cf) of each block's terms, and a row without a term whose df is the block's n."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block, n, _, terms, at, _, tf in zip(*batch.columns):
                at, tf = np.frombuffer(at.as_py(), "<i8"), np.frombuffer(tf.as_py(), "<i4").astype(np.int64)
                size = len(at) - 1
                counts = [pa.array(np.append(x, y)) for x, y in ((np.arange(size), -1), (np.diff(at), n.as_py()), (np.add.reduceat(tf, at[:-1]) if size else [], 0))]
                nth, df, cf = (x.cast(pa.int64()) for x in counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size + 1, block.as_py())), nth, pa.concat_arrays([terms.values, pa.nulls(1, pa.string())]), df, cf], names=["block", "nth", "term", "df", "cf"])

    return held.mapInArrow(run, "block long, nth long, term string, df long, cf long")


def _asked(rated: DataFrame, kind: str) -> DataFrame:
    """Queries' rows (query_id, terms of structs term and weight) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        part, made, ids, sizes, terms, weights, held = TaskContext.get().partitionId(), 0, [], [], [], [], 0

        def block():
            coded = pa.concat_arrays(terms).dictionary_encode()
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            arrays = [(part << 32) + made, _one(pa.concat_arrays(ids), ids[0].type), _one(coded.dictionary, pa.string()), at.astype("<i8").tobytes(), np.asarray(coded.indices).astype("<i4").tobytes(), np.concatenate(weights).astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array([a]) for a in arrays], names=["asked", "wanted", "asked_terms", "asked_at", "asked_nth", "asked_weight"])

        for batch in batches:
            lengths, flat = _lists(batch, 1)
            ids.append(batch.column(0))
            sizes.append(lengths)
            terms.append(flat.field(0))
            weights.append(np.asarray(flat.field(1)))
            held += len(flat)
            if held >= ASKED:
                yield block()
                made, ids, sizes, terms, weights, held = made + 1, [], [], [], [], 0
        if ids and sum(map(len, ids)):
            yield block()

    return rated.mapInArrow(run, f"asked long, wanted array<{kind}>, asked_terms array<string>, asked_at binary, asked_nth binary, asked_weight binary")


class Held:
    """A block of documents: for each term its documents and their shares of the score."""

    def __init__(self, row: dict):
        self.key, self.ids, self.terms = row["block"].as_py(), row["ids"].values, row["terms"].values
        at, docs, tf = (np.frombuffer(row[c].as_py(), t) for c, t in (("at", "<i8"), ("docs", "<i4"), ("tf", "<i4")))
        size = np.diff(at)
        kept = np.ones(len(size))
        if row["rare"].is_valid:
            kept[np.asarray(row["rare"].values)] = 0
        n, mean = len(self.ids), row["mean_length"].as_py() or 1.0
        norm = K1 * (1 - B + B * np.bincount(docs, tf * np.repeat(kept, size), n) / mean)
        self.at, self.size, self.docs, self.n = at, size, docs.astype(np.int64), n
        self.value = tf * (K1 + 1) / (tf + norm[self.docs])
        self.dense = size >= max(8, DENSE * n)
        thick = np.flatnonzero(self.dense)
        self.column = np.cumsum(self.dense) - 1
        self.given = np.zeros((len(thick), n))
        for i, t in enumerate(thick):
            own = slice(at[t], at[t + 1])
            self.given[i, self.docs[own]] = self.value[own]


class Asked:
    """A block of queries and their k best so far."""

    def __init__(self, row: dict, k: int):
        self.ids, self.terms, self.k = row["wanted"].values, row["asked_terms"].values, k
        self.at, self.nth, self.weight = (np.frombuffer(row[c].as_py(), t) for c, t in (("asked_at", "<i8"), ("asked_nth", "<i4"), ("asked_weight", "<f8")))
        self.least = np.full(len(self.ids), -np.inf)
        self.docs, self.seen = [], 0
        self.found, self.pending = [], 0

    def sums(self, held: Held, row, term, weight, rows: int, value, given) -> np.ndarray:
        """Scores (rows, documents) of asked terms (row, the block's term, weight)."""
        thick = held.dense[term]
        asked = np.zeros((rows, len(given)))
        asked[row[thick], held.column[term[thick]]] = weight[thick]
        out = asked @ given
        row, term, weight = row[~thick], term[~thick], weight[~thick]
        size = held.size[term]
        end = np.cumsum(size)
        if len(end) and end[-1]:
            place = np.repeat(held.at[term] - end + size, size) + np.arange(end[-1])
            cell = np.repeat(row * held.n, size) + held.docs[place]
            out += np.bincount(cell, np.repeat(weight, size) * value[place], out.size).reshape(out.shape)
        return out

    def meet(self, held: Held) -> None:
        if not held.n or not len(held.terms):
            return
        where = np.array(pc.fill_null(pc.index_in(self.terms, held.terms), -1))
        for start in range(0, len(self.ids), STEP):
            rows = min(STEP, len(self.ids) - start)
            own = slice(self.at[start], self.at[start + rows])
            row, term, weight = np.repeat(np.arange(rows), np.diff(self.at[start : start + rows + 1])), where[self.nth[own]], self.weight[own]
            row, term, weight = (x[term >= 0] for x in (row, term, weight))
            scores = self.sums(held, row, term, weight, rows, held.value, held.given)
            least, positive = self.least[start : start + rows], not len(weight) or weight.min() > 0
            if positive and least.min() > 10.0**-DIGITS:
                # Who has so much shares a term, and a block's own k-th best would leave out few more.
                near = scores >= least[:, None] - 10.0**-DIGITS
            else:
                # Only documents with a term of the query; weights are over 0 but in tables of a few texts.
                shared = scores > 0 if positive else self.sums(held, row, term, np.ones(len(term)), rows, np.ones(len(held.value)), (held.given > 0) * 1.0) > 0
                if held.n > self.k:
                    np.maximum(least, np.partition(np.where(shared, scores, -np.inf), held.n - self.k, axis=1)[:, held.n - self.k], out=least)
                near = shared & (scores >= least[:, None] - 10.0**-DIGITS)
            r, d = np.nonzero(near)
            self.found.append((r + start, np.round(scores[r, d], DIGITS), d + self.seen))
            self.pending += len(r)
        self.docs.append(held.ids)
        self.seen += held.n
        if self.pending > 2 * self.k * len(self.ids):
            self.trim()

    def trim(self) -> None:
        """The k best of each query stay; ties go by document."""
        row, score, doc = (np.concatenate(x) for x in zip(*self.found))
        near = score >= self.least[row] - 10.0**-DIGITS
        row, score, doc = row[near], score[near], doc[near]
        self.docs = [pa.concat_arrays(self.docs)]
        place = np.empty(self.seen, np.int64)
        place[np.asarray(pc.sort_indices(self.docs[0]))] = np.arange(self.seen)
        order = np.lexsort((place[doc], -score, row))
        row, score, doc = row[order], score[order], doc[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        best = nth < self.k
        self.found, self.pending = [(row[best], score[best], doc[best])], 0

    def best(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        self.trim()
        row, score, doc = self.found[0]
        for start in range(0, len(self.ids), 1000):
            a, z = np.searchsorted(row, [start, start + 1000])
            ids = self.ids.slice(start, 1000)
            at = np.searchsorted(row[a:z], np.arange(start, start + len(ids) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(-score[a:z]), self.docs[0].take(pa.array(doc[a:z]))], ["less", "doc_id"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pairs)], names=["query_id", "best"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, min_df: int = 2, tokenizer: Callable[[Column], Column] = X.unicode_tokens, many: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): ``lexical.search`` of queries(query_id, text) over docs(doc_id, text), for many queries. Documents' ids are unique.

    Each group of blocks gives k rows of each query, which are shuffled. many: queries are about as many
    as documents, so groups are few, and queries are dealt to more tasks instead.
    """
    send_source(docs.sparkSession)
    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    # Of as many partitions as joins have, as the join with rare terms would else have an exchange, and blocks, of its own.
    held = _blocks(docs.select("doc_id", "text"), tokenizer).repartition("block")
    tally = _tally(held)
    # cf is read by every use, as an exchange is only shared by plans that take the same columns.
    terms = tally.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("cf > 0")
    total = tally.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    rated = terms.where(F.col("df") >= min_df).crossJoin(F.broadcast(total)).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    means = rated.agg(F.avg("raw").alias("mean_idf"), (F.sum("cf") / F.max("n")).alias("mean_length"))
    idf = rated.crossJoin(F.broadcast(means)).select("term", F.when(F.col("raw") <= 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))

    counts = queries.select("query_id", F.explode(tokenizer(F.col("text"))).alias("term")).where("query_id is not null and term is not null").groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    weighed = counts.join(idf, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("qf") * F.col("idf")).alias("weight"))).alias("asked"))
    parts = max(2, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // (8 if many else 48))
    asked = _asked(weighed.repartition(parts), kinds[0])

    rare = tally.join(terms.where(F.col("df") < min_df).select("term"), "term").groupBy("block").agg(F.collect_list("nth").alias("rare"))
    ready = held.join(rare, "block", "left").crossJoin(F.broadcast(means.select("mean_length"))).repartition(MANY_GROUPS if many else GROUPS)

    def run(batches: Iterator[pa.RecordBatch]):
        here, states = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                if here is None or here.key != row["block"].as_py():
                    here = Held(row)
                if (key := row["asked"].as_py()) not in states:
                    states[key] = Asked(row, k)
                states[key].meet(here)
        for state in states.values():
            yield from state.best()

    found = ready.crossJoin(asked).mapInArrow(run, f"query_id {kinds[0]}, best array<struct<less: double, doc_id: {kinds[1]}>>")
    # A join would ask this of one use of the rows, and the others would not share its exchange.
    merged = found.where("query_id is not null").groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    rows = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", F.col("b.doc_id").alias("doc_id"), (-F.col("b.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))
