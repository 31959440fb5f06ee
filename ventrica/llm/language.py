"""Language identification by Bayesian fusion of text, markup, address and host.

Text likelihoods come from hashed byte trigrams without digits, counted over all documents with
a known language; labels serve for nothing else. The declared markup language and the suffix of
the address (a two-letter top-level domain or path segment) are further evidence, whose
reliability is estimated by grouped counts against the language of the text alone. The prior is
that of the host, smoothed towards its parent domain, and that one towards all rows, again from
grouped counts. The posterior is their product, normed together with an unknown language of
constant likelihood; a row is rejected if it has no letters or no language reaches
LEAST_POSTERIOR.

Declared languages and suffixes are folded into at most 677 codes, so their tables have a proven
bound; priors of hosts are sent to the tasks if they are few, else joined by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import few, materialize
from .hashed import hashed_counts, letter_trigrams, text_sums

LANGUAGES = ("en", "fr", "de", "es")
BITS = 15
SMOOTHING = 0.5
TRIGRAMS_TRUSTED = 200
HOST_STRENGTH = 20.0
EVIDENCE_STRENGTH = 10.0
LEAST_POSTERIOR = 0.5
#: Log likelihood of a trigram in a language that has no model, about one in 200,000, and the share of such texts.
OTHER_TRIGRAM, OTHER_SHARE = -12.3, 0.01


def code_of(value: Column) -> Column:
    """Two-letter primary code of a language tag, else an empty string."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2})(?:[-_].*)?$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))


def suffix_of(url: Column) -> Column:
    """A path segment of two letters at the start, else a two-letter top-level domain, else empty."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    return F.coalesce(F.when(path != "", path).otherwise(F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)), F.lit(""))


def _log_shares(counts: list[Column], parent: list[Column], strength: float) -> list[Column]:
    """Smoothed shares of each language, with ``strength`` rows of the parent's shares."""
    total = sum(counts, F.lit(0.0))
    return [(c + strength * p) / (total + strength) for c, p in zip(counts, parent, strict=True)]


def text_models(rows: DataFrame) -> np.ndarray:
    """Log shares of hashed trigrams by language, from all ``rows(text, known)`` with a known language."""
    counts = hashed_counts(rows.withColumn("class", F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("known")) - 1), letter_trigrams, BITS, len(LANGUAGES))
    return np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]))


def _likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``rows`` with n, the number of trigrams, and ll, the log likelihoods of the languages; of a carried row the text is in ``data``."""
    carried = "data" in rows.columns

    def run(batches):
        for batch in batches:
            text = pc.struct_field(batch.column("data"), "text") if carried else batch.column("text")
            parts = list(text_sums(text, letter_trigrams, BITS, table))
            n = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            sums = np.concatenate([p[1] for p in parts], axis=1).T if parts else np.zeros((0, len(LANGUAGES)))
            trusted = np.minimum(1.0, TRIGRAMS_TRUSTED / np.maximum(n, 1))  # neighbouring trigrams are not independent
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(LANGUAGES)), pa.array((sums * trusted[:, None]).ravel()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64()), lists, pa.array(trusted * n)], [*kept, "n", "ll", "trusted"])

    kept = StructType([f for f in rows.schema if f.name != "text"])
    return rows.mapInArrow(run, kept.add("n", "long").add("ll", ArrayType(DoubleType())).add("trusted", "double"))


def _evidence(scored: DataFrame, column: str) -> DataFrame:
    """log P(value | language) for each of the at most 677 values of a column, smoothed by its share."""
    n = [f"{column}_{k}" for k in range(len(LANGUAGES))]
    counts = scored.groupBy(column).agg(F.count("*").alias("all"), *[F.count(F.when(F.col("best") == k, 1)).alias(c) for k, c in enumerate(n)])
    total = counts.agg(F.sum("all").alias("t"), *[F.sum(c).alias(f"t_{c}") for c in n])
    share = F.col("all") / F.col("t")
    terms = [F.log((F.col(c) + EVIDENCE_STRENGTH * share) / (F.col(f"t_{c}") + EVIDENCE_STRENGTH)) for c in n]
    # an absent declaration says nothing
    said = [F.when(F.col(column) == "", F.lit(0.0)).otherwise(t) for t in terms]
    return counts.join(F.broadcast(total)).select(column, F.array(*said).alias(f"e_{column}"))


def identify_languages(rows: DataFrame, id_col: str, text: Column, table: np.ndarray, declared: Column | None = None, url: Column | None = None, host: Column | None = None, carry: bool = False) -> DataFrame:
    """id, language, posterior, text_language, accepted for every row.

    ``table`` has the text models. ``declared``, ``url`` and ``host`` may be None or null; then
    they say nothing, and the row takes part in the prior of all rows. A text without trigrams
    or letters is "und" and rejected, as is one under LEAST_POSTERIOR or likelier to be of
    another language. Very long texts are taken whole. Ties fall to the first of LANGUAGES.
    A null id is kept as null; repeated rows get equal results. Other columns are not read.
    Empty input gives no rows. With ``carry`` the text must be the column text, and each row's
    columns are carried in ``data`` in place of the id.
    """
    nothing = F.lit(None).cast("string")
    declared, url = declared if declared is not None else nothing, url if url is not None else nothing
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    at = host if host is not None else host_of(url)
    key = F.struct(*rows.columns).alias("data") if carry else F.col(id_col).cast("long").alias("row")
    own = [] if carry else [text.alias("text")]
    base = rows.select(key, *own, letters.alias("letters"), code_of(declared).alias("declared"), suffix_of(url).alias("suffix"), F.coalesce(F.lower(at), F.lit("")).alias("host"))
    many = range(len(LANGUAGES))
    best_of = lambda values: F.array_position(values, F.array_max(values)) - 1
    scored = _likelihoods(base, table).withColumn("n", F.when(F.col("letters"), F.col("n")).otherwise(0))
    scored = scored.withColumn("best", F.when(F.col("n") > 0, best_of(F.col("ll")))).withColumn("parent", F.regexp_extract("host", r"([^.]+\.[^.]+)$|^([^.]+)$", 0))
    scored = materialize(scored, "likelihoods")

    by_host = scored.where("best is not null").groupBy("parent", "host").agg(*[F.count(F.when(F.col("best") == k, 1)).cast("double").alias(f"h{k}") for k in many])
    by_host = materialize(by_host, "hosts")
    by_parent = by_host.groupBy("parent").agg(*[F.sum(f"h{k}").alias(f"p{k}") for k in many])
    overall = by_host.agg(*[F.coalesce(F.sum(f"h{k}"), F.lit(0.0)).alias(f"a{k}") for k in many]).first()
    flat = [(overall[k] + 1) / (sum(overall) + len(LANGUAGES)) for k in many]
    parent_shares = _log_shares([F.col(f"p{k}") for k in many], [F.lit(x) for x in flat], HOST_STRENGTH)
    host_shares = _log_shares([F.col(f"h{k}") for k in many], parent_shares, HOST_STRENGTH)
    priors = by_host.join(by_parent, "parent").select("host", F.array(*[F.log(s) for s in host_shares]).alias("prior"))

    fused = scored.join(few(priors, "priors"), "host", "left")
    for column in ("declared", "suffix"):
        fused = fused.join(F.broadcast(_evidence(scored, column)), column, "left")
    log_flat = [float(np.log(x)) for x in flat]
    logs = F.array(*[F.col("ll")[k] + F.coalesce(F.col("prior")[k], F.lit(log_flat[k])) + F.coalesce(F.col("e_declared")[k], F.lit(0.0)) + F.coalesce(F.col("e_suffix")[k], F.lit(0.0)) for k in many])
    fused = fused.withColumn("logs", logs)
    # another language: every trigram as likely as OTHER_TRIGRAM, whatever the evidence says
    other = F.exp(F.col("trusted") * OTHER_TRIGRAM + float(np.log(OTHER_SHARE)) - F.array_max("logs"))
    posterior = 1.0 / sum((F.exp(F.col("logs")[k] - F.array_max("logs")) for k in many), other)
    names = F.array(*map(F.lit, LANGUAGES))
    sure = F.coalesce((F.col("n") > 0) & (posterior >= LEAST_POSTERIOR), F.lit(False))
    return fused.select(
        F.col("data") if carry else F.col("row").alias(id_col),
        F.when(sure, F.element_at(names, (best_of(F.col("logs")) + 1).cast("int"))).otherwise("und").alias("language"),
        F.when(F.col("n") > 0, posterior).otherwise(0.0).alias("posterior"),
        F.element_at(names, (F.col("best") + 1).cast("int")).alias("text_language"),
        sure.alias("accepted"),
    )


def document_models(docs: DataFrame) -> np.ndarray:
    """Text models from all documents with a label in ``lang``."""
    return text_models(docs.select(F.col("text").cast("string").alias("text"), code_of(F.col("lang")).alias("known")))


def document_languages(docs: DataFrame, table: np.ndarray | None = None, carry: bool = False) -> DataFrame:
    """identify_languages over documents, ``source`` being the host. A row's label is no evidence; it counts in the text models only."""
    table = document_models(docs) if table is None else table
    return identify_languages(docs, "doc_id", F.col("text").cast("string"), table, host=F.col("source"), carry=carry)


def page_languages(pages: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """identify_languages over raw pages: markup language, address suffix and host of every page.

    Scripts, styles and tags are cut from the text. Without ``table`` the declared languages
    are the labels of the text models; with it they are evidence alone.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z_-]+)", 1)
    if table is None:
        table = text_models(pages.select(text.alias("text"), code_of(declared).alias("known")))
    return identify_languages(pages, "page_id", text, table, declared, F.col("url"))


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose language is identified, all columns as they were.

    Each row is decided by itself and carried along, so null and repeated ids do no harm. Rows
    with a null, empty or letterless text go; so do texts of a language that is not known.
    """
    return document_languages(docs, carry=True).where("accepted").select("data.*")
