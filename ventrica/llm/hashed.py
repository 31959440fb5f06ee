"""Counts of hashed n-grams over whole corpora, and score tables made of them.

A task sums the counts of all its rows in one table of fixed size and emits its non-zero
entries once; a grouped sum adds the tasks up. What reaches the driver is the model, whose
size is fixed by the number of buckets and classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix64, text_chunks, word_hashes


def byte_trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram that lies in one text, and where each text's trigrams begin."""
    return _trigrams(data, offsets, bits, None)


def _trigrams(data: np.ndarray, offsets: np.ndarray, bits: int, usable: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(data) - 2, 0)
    low = data.astype(np.uint32)
    low[(low >= 65) & (low <= 90)] += 32
    mixed = low[:n] * np.uint32(0x9E3779B1) + low[1 : n + 1] * np.uint32(0x85EBCA6B) + low[2 : n + 2] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    buckets = (mixed >> np.uint32(32 - bits)).astype(np.int64)
    inside = np.ones(n, bool)
    for back in (1, 2):  # a trigram that crosses into the next text belongs to neither
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    if usable is not None:
        inside &= usable[:n] & usable[1 : n + 1] & usable[2 : n + 2]
    at = np.concatenate([[0], np.cumsum(inside)])
    return buckets[inside], at[np.minimum(offsets, n)]


def word_bigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of pairs of neighbours, interleaved by place, and where each text's begin."""
    hashes, at = word_hashes(data, offsets)
    pair = np.zeros(len(hashes), np.uint64)
    pair[:-1] = mix64(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15))
    ends = at[1:] - 1
    last = ends[ends >= at[:-1]]
    pair[last] = mix64(hashes[last] * np.uint64(3))  # the last word's pair is with the end
    both = np.empty(2 * len(hashes), np.uint64)
    both[0::2], both[1::2] = hashes, pair
    return (both >> np.uint64(64 - bits)).astype(np.int64), 2 * at


def letter_trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As byte_trigrams, without those that hold an ASCII digit: numbers and keys say nothing of the language."""
    digit = (data >= 48) & (data <= 57)
    return _trigrams(data, offsets, bits, ~digit)


#: Bytes of the beginnings of words that stand for all words that share them.
BEGINNINGS = (4, 5, 6, 8)


def _new_words(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of every word, and which words are the first of their text between these two neighbours."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    around = mix64(hashes * np.uint64(3) + rows.astype(np.uint64))
    same = rows[1:] == rows[:-1]
    around[1:][same] += mix64(hashes[:-1][same] + np.uint64(1))
    around[:-1][same] += mix64(hashes[1:][same] + np.uint64(2))
    first = np.zeros(len(hashes), bool)
    first[np.unique(around, return_index=True)[1]] = True
    return rows, first


def _word_buckets(data: np.ndarray, offsets: np.ndarray, bits: int):
    """Rows and novelty as of _new_words, then (which words, their buckets) for words and for each beginning."""
    hashes, at, shorter = word_hashes(data, offsets, BEGINNINGS)
    bucket = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64)
    parts = [(where, bucket(mix64(part + np.uint64(size)))) for size, (where, part) in zip(BEGINNINGS, shorter, strict=True)]
    return (*_new_words(hashes, at), [(np.arange(len(hashes)), bucket(hashes)), *parts])


def word_beginnings(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of beginnings of longer words, and where each text's begin.

    The lower half of the buckets takes each once a text, the upper half each place of it,
    but a place between the same two neighbours once.
    """
    rows, first, parts = _word_buckets(data, offsets, bits - 1)
    places = np.concatenate([(rows[where] << bits)[first[where]] + bucket[first[where]] for where, bucket in parts])
    keys = np.sort(np.concatenate([np.unique(places), places + (1 << (bits - 1))]))
    return keys & ((1 << bits) - 1), np.searchsorted(keys, np.arange(len(offsets)) << bits)


def telling_words(column, bits: int, odds: np.ndarray):
    """For each text its words, those of them that are telling, and the sum of their odds; by chunks.

    A word counts once between the same two neighbours, so repeated lines add nothing. Its
    odds are the largest of itself and its beginnings.
    """
    for _, data, offsets in text_chunks(column):
        rows, first, parts = _word_buckets(data, offsets, bits)
        most = np.zeros(len(rows))
        for where, bucket in parts:
            most[where] = np.maximum(most[where], odds[bucket])
        rows, most, n = rows[first], most[first], len(offsets) - 1
        yield np.bincount(rows, minlength=n), np.bincount(rows[most > 0], minlength=n), np.bincount(rows, most, minlength=n)


def hashed_counts(rows: DataFrame, features, bits: int, classes: int) -> np.ndarray:
    """Counts [class, bucket] over ``rows(text, class)``; a row with a class outside the range is not counted."""

    def run(batches):
        total = np.zeros(classes << bits, np.int64)
        for batch in batches:
            wanted = batch.column("class").fill_null(-1).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column("text")):
                buckets, at = features(data, offsets, bits)
                label = np.repeat(wanted[row : row + len(offsets) - 1], np.diff(at))
                good = (label >= 0) & (label < classes)
                total += np.bincount((label[good].astype(np.int64) << bits) + buckets[good], minlength=classes << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    sums = rows.select("text", F.col("class").cast("long").alias("class")).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes << bits, np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(classes, 1 << bits)


def text_sums(column, features, bits: int, tables: np.ndarray):
    """For each text the number of its features and, for each table, the sum of its entries; by chunks."""
    for _, data, offsets in text_chunks(column):
        buckets, at = features(data, offsets, bits)
        sums = np.zeros((len(tables), len(offsets) - 1))
        for k, table in enumerate(tables):
            running = np.concatenate([[0.0], np.cumsum(table[buckets])])
            sums[k] = running[at[1:]] - running[at[:-1]]
        yield np.diff(at), sums
