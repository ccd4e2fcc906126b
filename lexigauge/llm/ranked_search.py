"""Ranked lexical search: MaxScore over the postings of each shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .arrays import Texts, packed, same_bytes

#: Distinct pairs of a query and a term that are broadcast at once; more queries are taken in blocks.
BLOCK = 500_000
#: Text bytes whose documents form a shard.
SHARD = 4 << 20


class Vocabulary:
    """The terms that queries ask for, by number; a hash finds a term, its bytes confirm it."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.data, self.offsets = packed(terms)
        own = Texts(pa.array([t.decode("utf-8") for t in terms], pa.string()), np.ones(256, bool))
        self.order = np.argsort(own.hash, kind="stable")
        self.hash = own.hash[self.order]

    def numbers(self, texts: Texts) -> np.ndarray:
        """The number of each word's term; -1 if no query asks for it."""
        out = np.full(len(texts.hash), -1, np.int64)
        if not len(self.terms):
            return out
        at = np.searchsorted(self.hash, texts.hash)
        left = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] == texts.hash)
        at = at[left]
        while len(left):  # a second round only where two terms share a hash
            term = self.order[at]
            same = same_bytes(texts.low, texts.start[left], texts.end[left], self.data, self.offsets[term], self.offsets[term + 1])
            out[left[same]] = term[same]
            left, at = left[~same], at[~same] + 1
            again = (at < len(self.hash)) & (self.hash[np.minimum(at, len(self.hash) - 1)] == texts.hash[left])
            left, at = left[again], at[again]
        return out


def terms_of(items: DataFrame) -> DataFrame:
    """(item, term binary) of each distinct term of (item, text)."""

    def split(batches):
        common.worker_state("search terms")
        for batch in common.slices(batches, "text"):
            t = Texts(batch.column("text"), common.IS_WORD)
            if len(t.row):
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(t.row)), pa.array([t.word(i) for i in range(len(t.row))], pa.binary())], names=["item", "term"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(split, f"item {kind}, term binary").distinct()


def build_index(docs: DataFrame, vocabulary) -> DataFrame:
    """Shards of (id, text), one a row: their documents in order of id, and for each term its postings and their frequencies.

    vocabulary: a broadcast list of terms; postings of other terms aren't kept. Documents
    without any term have no place in a shard.
    """
    kind = docs.schema["id"].dataType

    def build(batches):
        terms = common.worker_state(("search", getattr(vocabulary, "_path", None) or id(vocabulary.value)), lambda: Vocabulary(vocabulary.value))
        for batch in common.slices(batches, "text", SHARD):
            texts = Texts(batch.column("text"), common.IS_WORD)
            size = np.bincount(texts.row, minlength=batch.num_rows)
            # rows in order of id, nulls last; those without terms go
            order = pc.sort_indices(batch.column("id"), null_placement="at_end").to_numpy()
            order = order[size[order] > 0]
            place = np.full(batch.num_rows, -1, np.int64)
            place[order] = np.arange(len(order))
            number = terms.numbers(texts)
            known = number >= 0
            pair, tf = np.unique(number[known] * max(1, len(order)) + place[texts.row[known]], return_counts=True)
            own, post = np.divmod(pair, max(1, len(order)))
            found, df = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column("id").take(pa.array(order)).to_pylist()], pa.list_(to_arrow_type(kind))), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((size[order], "<i8"), (post, "<i4"), (tf, "<i8"))), pa.array([found.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64())), pa.array([len(order)], pa.int64()), pa.array([int(size.sum())], pa.int64())],
                names=["ids", "sizes", "posts", "tfs", "terms", "dfs", "n_docs", "n_terms"],
            )

    return docs.mapInArrow(build, f"ids array<{kind.simpleString()}>, sizes binary, posts binary, tfs binary, terms array<int>, dfs array<long>, n_docs long, n_terms long")


class Shard:
    """A shard's postings with what each adds to a score, and the most that each term can add."""

    def __init__(self, row: dict, weight: dict[int, int], n: int, total: int):
        self.ids = row["ids"]
        self.posts = np.frombuffer(row["posts"], "<i4").astype(np.int64)
        tf = np.frombuffer(row["tfs"], "<i8")
        df = np.array(row["dfs"], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(df)])
        m = 10 + (90 * np.frombuffer(row["sizes"], "<i8") * n) // total
        w = np.repeat(np.array([weight[t] for t in row["terms"]], np.int64), df)
        self.adds = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.posts]))
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.bound = np.maximum.reduceat(self.adds, self.ends[:-1]) if len(df) else np.empty(0, np.int64)

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.posts[self.ends[i] : self.ends[i + 1]], self.adds[self.ends[i] : self.ends[i + 1]]

    def best(self, terms: list[int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k documents with the highest scores among those of least or more, at least 1; ties by place.

        Lists by upper bound, the lowest first: as many as can't reach `least` together aren't
        essential. Only documents of the other lists are candidates; the rest are probed, the
        highest bound first, as long as a candidate can still reach `least`.
        """
        own = np.array([self.place[t] for t in terms if t in self.place], np.int64)
        own = own[np.argsort(self.bound[own], kind="stable")]
        upto = np.cumsum(self.bound[own])
        least = max(1, least)
        first = int(np.searchsorted(upto, least))  # lists before it add up to less than `least`
        total = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for i in own[first:].tolist():
            post, adds = self.postings(i)
            total[post] += adds
            seen[post] = True
        place = np.flatnonzero(seen)
        score = total[place]
        for j in range(first - 1, -1, -1):
            alive = score + upto[j] >= least
            place, score = place[alive], score[alive]
            if not len(place):
                break
            post, adds = self.postings(own[j])
            at = np.minimum(np.searchsorted(post, place), len(post) - 1)
            score = score + np.where(post[at] == place, adds[at], 0)
        alive = score >= least
        place, score = place[alive], score[alive]
        order = np.lexsort((place, -score))[:k]
        return place[order], score[order]


def search(index: DataFrame, queries, weights, n: int, total: int, k: int, item_type) -> DataFrame:
    """(item, id, score): the k best documents of each task's shards for each query; the least score that still counts rises from shard to shard."""
    kind = index.schema["ids"].dataType.elementType

    def run(batches):
        asked, weight = queries.value, weights.value
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if not row["terms"]:
                    continue
                shard = Shard(row, weight, n, total)
                for held, (_, terms) in zip(best, asked, strict=True):
                    least = held[-1][0] if len(held) == k else 1
                    place, score = shard.best(terms, k, least)
                    if len(place):
                        held += zip(score.tolist(), (shard.ids[p] for p in place.tolist()), strict=True)
                        held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                        del held[k:]
        rows = [(item, i, s) for held, (item, _) in zip(best, asked, strict=True) for s, i in held]
        item, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, to_arrow_type(item_type)), pa.array(i, to_arrow_type(kind)), pa.array(s, pa.int64())], names=["item", "id", "score"])

    return index.mapInArrow(run, f"item {item_type.simpleString()}, id {kind.simpleString()}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents that score highest for each item's terms, those with a score above 0.

    Terms are runs of letters, digits and bytes from 128 on, A-Z lower-cased. A document's
    score is a sum over an item's distinct terms of a weight by document frequency times a
    saturated term frequency, all in integers. A first pass over the documents leaves shards
    of postings for the terms that are asked for (in the checkpoint folder); frequencies are
    summed from the shards; a second pass runs MaxScore in each shard. Nothing of a document
    is shuffled: each task's k best rows a query are.

    Null texts and texts without a term match nothing. Items with one id count as one item, a
    null id too; an item without terms, or whose terms no document has, gets no row. Equal
    scores go by id, nulls last; repeated rows are documents of their own and can each take a
    rank, in any order among equal ids. Empty tables give no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = common.cut(terms_of(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")))
    item_type = asked.schema["item"].dataType
    blocks = -(-asked.count() // BLOCK)
    found = []
    for b in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        by_item: dict = {}
        for r in own.collect():
            by_item.setdefault(r["item"], []).append(bytes(r["term"]))
        terms = sorted({t for x in by_item.values() for t in x})
        number = {t: i for i, t in enumerate(terms)}
        queries = spark.sparkContext.broadcast([(item, sorted(number[t] for t in x)) for item, x in by_item.items()])
        index = common.cut(build_index(rows, spark.sparkContext.broadcast(terms)))
        n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
        weight = {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in df.collect()}
        found.append(search(index, queries, spark.sparkContext.broadcast(weight), n, total, k, item_type))
    if not found:
        return spark.createDataFrame([], f"item {item_type.simpleString()}, rank int, id {rows.schema['id'].dataType.simpleString()}, score long")
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    by_rank = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("item", "rank", "id", "score")
