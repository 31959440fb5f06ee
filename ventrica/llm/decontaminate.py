"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND.

Terms are 5-word shingles of words with the case of all letters folded. Each training text is cut into passages that
overlap by half; how wide they are depends on the item alone: twice the least power of two
that holds it, at least twice STRIDE words, so that a contiguous copy lies whole in one
passage and other items change nothing. Items of one width share shards. Every passage with a term of the index is a query. A posting's
weight is the item's BM25 weight of the term over the least score that the item can have
when LEAST_PERCENT of its terms are in a passage, so "above threshold" is a score of 1 for
every item and retrieval loses nothing that verification could accept. Retrieved items are
verified: LEAST_PERCENT of all shingles, and half of those of the question (the words up to
two thirds) and of the answer (the rest), occur in the passage.

The index is built in shards of about SHARD_TERMS terms, each by a task of its own. Texts are
read once: a bitmap of all terms, of fixed size, picks the shingles that may be terms, and only
these meet the shards, which are sent to the tasks one at a time.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, numbered, without_rows
from .shingles import ordered_shingles

LEAST_PERCENT = 75
K1, B = 1.2, 0.75
BLOCK = 64
STRIDE = 64
SHARD_TERMS = 1_000_000
FILTER_BITS = 24


def folded(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id and text with the case of all letters folded, also of those above ASCII.

    Upper before lower, so that letters whose capitals are others (ß and SS) agree as well;
    the empty string keeps Spark from reading lower(upper(x)) as lower(x).
    """
    base = df.select(*more, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.withColumn("text", F.lower(F.concat(F.upper("text"), F.lit(""))))


class Index:
    """Postings of one shard of items, in blocks with their largest weight.

    ``items`` has for each item its number and id, its shingles in order, and of each of them the
    number of items that hold it; all have passages of twice ``stride`` words.
    """

    def __init__(self, items: list[tuple[tuple[int, int | None], np.ndarray, np.ndarray]], total: int, average: float, stride: int):
        self.ids, self.stride = [i for i, _, _ in items], stride
        self.sets = [np.unique(s) for _, s, _ in items]
        self.question = [np.unique(s[: max(1, (2 * len(s)) // 3)]) for _, s, _ in items]
        self.answer = [np.unique(s[(2 * len(s)) // 3 :]) for _, s, _ in items]
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (_, s, held_by) in enumerate(items):
            terms, at, counts = np.unique(s, return_index=True, return_counts=True)
            seen = held_by[at].astype(np.float64)
            idf = np.log1p((total - seen + 0.5) / (seen + 0.5))
            weight = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(s) / average))
            need = -(-LEAST_PERCENT * len(terms) // 100)
            weight = weight / np.sort(weight)[:need].sum()
            for t, w in zip(terms.tolist(), weight.tolist(), strict=True):
                postings.setdefault(t, []).append((k, w))
        self.terms = np.array(sorted(postings), np.uint64)
        lists = [postings[t] for t in self.terms.tolist()]
        self.items = [[k for k, _ in p] for p in lists]
        self.weights = [[w for _, w in p] for p in lists]
        self.block_max = [[max(w[a : a + BLOCK]) for a in range(0, len(w), BLOCK)] for w in self.weights]
        self.term_max = [max(b) for b in self.block_max]

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles are terms, and which terms."""
        if not len(self.terms) or not len(shingles):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.terms, shingles), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[found] == shingles)
        return at, found[at]

    def search(self, terms: list[int], threshold: float = 1 - 1e-9) -> list[int]:
        """Items whose score for these distinct terms reaches the threshold."""
        open_ = [[self.items[t][0], 0, t] for t in terms]  # item, place in the posting list, term
        found = []
        while open_:
            open_.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(open_):
                bound += self.term_max[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = open_[pivot][0]
            while pivot + 1 < len(open_) and open_[pivot + 1][0] == item:
                pivot += 1
            if open_[0][0] < item:  # bring the lists before the pivot up to it
                for cursor in open_[: pivot + 1]:
                    self._seek(cursor, item)
            else:
                here = open_[: pivot + 1]
                if sum(self.block_max[t][p // BLOCK] for _, p, t in here) >= threshold:
                    if sum(self.weights[t][p] for _, p, t in here) >= threshold:
                        found.append(item)
                    target = item + 1
                else:  # no item up to the end of the nearest block can reach it
                    ends = [self.items[t][min(p // BLOCK * BLOCK + BLOCK, len(self.items[t])) - 1] + 1 for _, p, t in here]
                    target = min([*ends, *(c[0] for c in open_[pivot + 1 : pivot + 2])])
                    target = max(target, item + 1)
                for cursor in here:
                    self._seek(cursor, target)
            open_ = [c for c in open_ if c[1] >= 0]
        return found

    def _seek(self, cursor: list, target: int) -> None:
        items, place = self.items[cursor[2]], cursor[1]
        while place < len(items) and items[place] < target:
            last = min(place // BLOCK * BLOCK + BLOCK, len(items)) - 1
            place = last + 1 if items[last] < target else place + 1
        cursor[:2] = [items[place], place] if place < len(items) else [1 << 62, -1]

    def leaks(self, at: np.ndarray, shingles: np.ndarray) -> dict[tuple[int, int | None], float]:
        """Verified items by number and id with the largest share of their shingles in one passage, from shingles and their places in a text."""
        which, terms = self.hits(shingles)
        places, stride = at[which], self.stride
        out: dict[tuple[int, int | None], float] = {}
        done = None
        for start in sorted({max(0, p // stride - back) for p in places.tolist() for back in (0, 1)}):
            a, b = np.searchsorted(places, [start * stride, start * stride + 2 * stride - 4])
            if a == b or (a, b) == done:
                continue
            done = (a, b)
            inside = np.unique(terms[a:b])
            here = self.terms[inside]
            for k in self.search(inside.tolist()):
                overlap = lambda s: np.isin(s, here, assume_unique=True).sum() / len(s) if len(s) else 1.0  # noqa: E731, B023
                share = overlap(self.sets[k])
                if 100 * share >= LEAST_PERCENT and overlap(self.question[k]) >= 0.5 and overlap(self.answer[k]) >= 0.5:
                    out[self.ids[k]] = max(out.get(self.ids[k], 0.0), float(share))
        return out


def stride_of(shingles: int) -> int:
    """Half the width of the passages that an item is looked for in: the least power of two of words that holds it, at least STRIDE."""
    return max(STRIDE, 1 << (shingles + 4 - 1).bit_length())


def _terms(batches):
    for batch in batches:
        for n, i, s in zip(batch.column("number").to_pylist(), batch.column("doc_id").to_pylist(), ordered_shingles(batch.column("text")), strict=True):
            if len(s):
                columns = {"number": pa.array([n], pa.int64()), "item_id": pa.array([i], pa.int64()), "stride": pa.array([stride_of(len(s))], pa.int64()), "terms": pa.array([s.view(np.int64)], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(columns)


def _built(total: int, average: float):
    def run(group):
        ids = [None if pd.isna(i) else int(i) for i in group["item_id"]]
        items = [((int(n), i), np.asarray(t, np.int64).view(np.uint64), np.asarray(h, np.int64)) for n, i, t, h in zip(group["number"], ids, group["terms"], group["held_by"], strict=True)]
        items.sort(key=lambda item: item[0][0])
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "index": [pickle.dumps(Index(items, total, average, int(group["stride"].iloc[0])))]})

    return run


def build_index(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> tuple[DataFrame, np.ndarray]:
    """Index shards (shard, index), each built by a task of its own, and a bitmap of all terms.

    Counts of terms are taken over all items. Each row is an item of its own, whatever its id is.
    """
    base = materialize(folded(items, id_col, text_col).withColumn("number", F.monotonically_increasing_id()), "numbered")
    rows = materialize(base.mapInArrow(_terms, "number long, item_id long, stride long, terms array<long>"), "items")
    total, average = rows.agg(F.count("*"), F.avg(F.size("terms"))).first()
    terms = materialize(rows.select("number", F.posexplode("terms").alias("at", "term")), "terms")
    held_by = terms.select("number", "term").distinct().groupBy("term").agg(F.count("*").alias("held_by"))
    whole = terms.join(held_by, "term").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "term", "held_by"))).alias("all"))
    # a width holds as many shards as its terms need; there are as many widths as a length has bits
    shards = rows.groupBy("stride").agg(F.ceil(F.sum(F.size("terms")) / shard_terms).alias("shards"))
    known = rows.select("number", "item_id", "stride").join(F.broadcast(shards), "stride")
    shard = F.concat_ws("-", "stride", F.pmod(F.xxhash64("number"), "shards"))
    dealt = whole.join(known, "number").select(shard.alias("shard"), "stride", "number", "item_id", F.col("all.term").alias("terms"), F.col("all.held_by").alias("held_by"))
    index = materialize(dealt.groupBy("shard").applyInPandas(_built(total, average), "shard string, index binary"), "index")
    slot = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    words = terms.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2^(FILTER_BITS-6) rows
        bitmap[r.word] = np.array(r.bits, np.int64).view(np.uint64)
    return index, bitmap


def _hits(shared):
    """(row, places, terms) of texts with a shingle that is in the bitmap."""

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            rows, ends, places, terms = [], [0], [], []
            for k, s in enumerate(ordered_shingles(batch.column("text"))):
                slot = s >> np.uint64(64 - FILTER_BITS)
                at = np.flatnonzero(bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                if len(at):
                    rows.append(k)
                    ends.append(ends[-1] + len(at))
                    places.append(at)
                    terms.append(s[at].view(np.int64))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), lists(places), lists(terms)], ["row", "places", "terms"])

    return run


def _leaks(shared):
    def run(batches):
        index = pickle.loads(shared.value)
        for batch in batches:
            rows, items, ids, shares = [], [], [], []
            for row, places, terms in zip(*(batch.column(c).to_pylist() for c in ("row", "places", "terms")), strict=True):
                for (item, item_id), share in index.leaks(np.array(places, np.int64), np.array(terms, np.int64).view(np.uint64)).items():
                    rows.append(row)
                    items.append(item)
                    ids.append(item_id)
                    shares.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(shares, pa.float64())], ["row", "item", "item_id", "overlap"])

    return run


LEAKS = "row long, item long, item_id long, overlap double"


def _leaked_rows(rows: DataFrame, items: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """row, item (its number), item_id, overlap for ``rows(row, text)``. The texts are read once; their hits meet one shard after another."""
    spark = rows.sparkSession
    index, bitmap = build_index(items, shard_terms=shard_terms)
    hits = materialize(rows.select("row", "text").mapInArrow(_hits(spark.sparkContext.broadcast(bitmap)), "row long, places array<long>, terms array<long>"), "hits")
    parts = []
    for (shard,) in index.select("shard").orderBy("shard").collect():
        one = spark.sparkContext.broadcast(bytes(index.where(F.col("shard") == shard).first()["index"]))
        parts.append(materialize(hits.mapInArrow(_leaks(one), LEAKS), "leaks"))
        one.destroy()
    discard(hits)
    discard(index)
    # made of a range: rows of the driver would start other Python workers in every executor
    empty = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (field.split() for field in LEAKS.split(", "))])
    return reduce(DataFrame.unionByName, parts, empty)


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> DataFrame:
    """doc_id, item_id, overlap for every document and test item of which it holds a passage.

    Null or empty texts and items leak nothing; an item of under five words is one shingle,
    found only in a text that is equal to it. Case does not count, in any script. Texts of any
    length are searched whole. Null ids of documents and of items are reported as such, and items that
    share an id each have their rows. Repeated rows are reported once each, ties in any order. Other columns are
    not read. Empty input gives no rows.
    """
    rows = numbered(folded(docs, id_col, text_col))
    return rows.select("row", "doc_id").join(few(_leaked_rows(rows, items, shard_terms), "found"), "row").select("doc_id", "item_id", "overlap")


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no passage of a benchmark item, all columns as they were.

    Rows are numbered, so null and repeated ids do no harm. A null or empty text stays.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("data")))
    text = folded(rows.select("row", "data.doc_id", "data.text"), "doc_id", "text", "row")
    leaks = _leaked_rows(text, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without_rows(rows, leaks.select("row").distinct()).select("data.*")
