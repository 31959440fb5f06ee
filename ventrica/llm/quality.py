"""Quality by importance resampling of hashed n-grams.

Two bag models over hashed words and word pairs: the target model from labelled texts that
are good and not toxic, the raw model from all texts. A text's weight is the sum of the log ratios
of its n-grams, that is the log of its likelihood in the target over that in the raw texts. Texts
are sampled without replacement, in proportion to that ratio, by Gumbel top-k: a standard Gumbel
variate, fixed by the row's id, is added, and the k largest stay; all rows that tie with the k-th
do. k is a parameter, as a share of the rows; by default it is the number of texts whose weight
reaches the cut that best parts held-out labelled texts. The k-th largest is found by narrowing
histograms, so nothing is sorted or collected as a whole.

A few insults among many good words hardly move a mean over n-grams, so toxic texts are found
by the log ratio of another likelihood: words that labelled toxic texts hold significantly more
often than the others, themselves or by their beginnings, add the log ratio of their rates, and
every word takes away the difference of the rates at which any telling word comes, as in a
Poisson process; so one chance hit in a long text says little. Texts over the cut that best
parts held-out rows are not sampled from.

Only the target model, the toxic words and the cuts come from a sample: at most LABELLED
labelled rows, half of them for the models and half for the cuts. The raw model and the
sampling cover every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_and_text, materialize
from .hashed import hashed_counts, telling_words, text_sums, word_beginnings, word_bigrams

BITS = 13
WORD_BITS = 18
SMOOTHING = 1.0
LABELLED = 20_000
CLEAN_COST = 8
BINS = 4096
SEED = 20


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed models, by bucket; the target falls back on the raw model."""
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    strength = SMOOTHING * len(raw)
    p_target = (target + strength * p_raw) / (target.sum() + strength)
    return np.log(p_target / p_raw)


def toxic_odds(counts: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """Log ratio of the rates of words in toxic and other texts, by bucket.

    From counts [toxic or not, texts that hold it or places, bucket]. Zero unless the likelihood
    ratio test of the bucket, by texts, is beyond what chance gives in any.
    """
    ((b, places_b), (a, places_a)), (n0, n1) = counts.astype(float), texts
    share = (a + b) / max(n0 + n1, 1)
    term = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    ratio = 2 * (term(a, n1 * share) + term(b, n0 * share) + term(n1 - a, n1 * (1 - share)) + term(n0 - b, n0 * (1 - share)))
    odds = np.log((places_a + 0.5) / (places_a.sum() + 1)) - np.log((places_b + 0.5) / (places_b.sum() + 1))
    return np.where((odds > 0) & (a * n0 > b * n1) & (ratio > 2 * np.log(len(a))), odds, 0.0)


def best_cut(scores: list[float], good: list[bool]) -> float:
    """The weight at which rejecting what lies below costs least; a good text costs CLEAN_COST bad ones."""
    order = sorted(zip(scores, good, strict=True))
    cost = best = sum(not g for _, g in order)
    cut = -float("inf")
    for k, (score, g) in enumerate(order):
        cost += CLEAN_COST if g else -1
        if cost < best and (k + 1 == len(order) or order[k + 1][0] > score):
            best, cut = cost, (score + order[k + 1][0]) / 2 if k + 1 < len(order) else score
    return cut


def kth_largest(scored: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, by histograms of the interval that holds it."""
    if k <= 0:
        return float("inf")
    low, high, above = *scored.agg(F.min(column), F.max(column)).first(), 0
    while low is not None and low < high:
        width = (high - low) / BINS
        if low + width == low:
            return low
        inside = scored.where(F.col(column).between(low, high))
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("slot")
        bins = inside.groupBy(slot).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).orderBy(F.desc("slot")).collect()
        for row in bins:
            if above + row.n >= k:
                low, high = row.a, row.b
                break
            above += row.n
        else:
            return low
    return low


def quality_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, carry: bool = False) -> DataFrame:
    """doc_id, n_grams, weight, score, toxicity, kept for every row of ``docs``.

    ``share`` is the part of the rows that are not toxic that is sampled; None takes as many as
    reach the cut. Labels are rows (doc_id, quality 0 or 1, toxic 0 or 1); null or other values
    are ignored and not toxic, as are all if there is no such column; of several labels of an id
    the largest counts. Without labels every row is kept. Null or empty texts have weight and
    toxicity 0; texts of any length are taken whole. A null id takes part like an unlabelled
    one. Rows with equal id and text have equal results. Other columns are not read. Empty
    input gives no rows. With ``carry`` each row's columns are carried in ``data`` in place of
    doc_id.
    """
    base = id_and_text(docs, id_col, text_col)
    one_of = lambda c: F.when(c.cast("int").isin(0, 1), c.cast("int"))
    toxic = F.coalesce(one_of(F.col("toxic")), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), one_of(F.col("quality")).alias("quality"), toxic.alias("toxic")).where("doc_id is not null and (quality is not null or toxic = 1)")
    wanted = wanted.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    wanted = materialize(wanted.withColumn("good", good).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)).cast("int")), "labels")
    labelled = base.join(F.broadcast(wanted), "doc_id", "left")  # at most LABELLED short rows
    is_target = F.col("good") & (F.col("fold") == 0)
    counts = hashed_counts(labelled.withColumn("class", F.when(is_target, 1).otherwise(0)), word_bigrams, BITS, 2)
    table = log_ratios(counts.sum(axis=0), counts[1])[None]
    models = base.join(F.broadcast(wanted.where("fold = 0")), "doc_id")
    texts = models.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    held_by = hashed_counts(models.withColumn("class", F.col("toxic")), word_beginnings, WORD_BITS + 1, 2)
    odds = toxic_odds(held_by.reshape(2, 2, -1), texts)

    def weigh(batches):
        for batch in batches:
            text = pc.struct_field(batch.column("data"), text_col) if carry else batch.column("text")
            parts = list(text_sums(text, word_bigrams, BITS, table))
            n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            sums = np.concatenate([p[1][0] for p in parts]) if parts else np.zeros(0)
            told = list(telling_words(text, WORD_BITS, odds))
            places, telling, insults = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0),) * 3
            kept = [c for c in batch.schema.names if c != "text"]
            new = [pa.array(n, pa.int64()), pa.array(sums.round(9)), pa.array(places, pa.int64()), pa.array(telling, pa.int64()), pa.array(insults.round(9))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, "n_grams", "weight", "places", "telling", "insults"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*docs.columns).alias("data")) if carry else base
    kept = StructType([f for f in source.schema if f.name != "text"])
    weights = source.mapInArrow(weigh, kept.add("n_grams", "long").add("weight", "double").add("places", "long").add("telling", "long").add("insults", "double"))
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = materialize(weights.withColumn("score", F.col("weight") - F.log(-F.log(uniform))), "weights")
    rate = scored.join(F.broadcast(wanted.where("fold = 0")), "doc_id").agg(*(F.try_divide(F.sum(F.when(F.col("toxic") == t, F.col("telling"))), F.sum(F.when(F.col("toxic") == t, F.col("places")))) for t in (0, 1))).first()
    excess = max((rate[1] or 0.0) - (rate[0] or 0.0), 0.0)
    scored = scored.withColumn("toxicity", F.round(F.col("insults") - excess * F.col("places"), 9))
    # ids may repeat; one row of each labelled id, in a fixed order, so at most LABELLED rows
    held = scored.join(F.broadcast(wanted.where("fold = 1")), "doc_id").groupBy("doc_id").agg(F.min("weight").alias("weight"), F.max("toxicity").alias("toxicity"), F.max("toxic").alias("toxic"), F.max("good").alias("good")).collect()
    most = max(0.0, -best_cut([-r.toxicity for r in held], [r.toxic == 0 for r in held]))  # 0 is even odds
    left = [r for r in held if r.toxicity <= most]  # a toxic row that stays counts as a bad one
    cut = best_cut([r.weight for r in left], [r.good for r in left])
    mild = scored.where(F.col("toxicity") <= most)
    k = mild.where(F.col("weight") >= cut).count() if share is None else round(share * mild.count())
    threshold = kth_largest(mild, "score", k)
    kept = (F.col("score") >= threshold) & (F.col("toxicity") <= most)
    return scored.select("data" if carry else "doc_id", "n_grams", "weight", "score", "toxicity", kept.alias("kept"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the resampling keeps, all columns as they were.

    Each row is decided by itself and carried along, so null and repeated ids do no harm; rows
    with a null or empty text have weight 0, which the cut may keep.
    """
    sample = quality_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return sample.where("kept").select("data.*")
