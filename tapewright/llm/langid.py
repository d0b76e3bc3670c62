"""Language of web pages by Bayesian fusion of text, declared language, suffix and host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .trigrams import trigram_counts
from .urls import host_of

BITS = 14
#: Neighbouring trigrams tell the same thing thrice.
TEMPER = 1 / 3
#: Pages that the prior of a host's domain counts for, and of a domain's parent.
STRENGTH = 4.0


def languages_of(docs: DataFrame, lang_col: str = "lang") -> list[str]:
    """All languages of the training table, by name; there are as many as its language codes."""
    return sorted(r["l"] for r in docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l")).distinct().collect())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Log probabilities of the trigrams in each language, counted over all documents.

    What reaches the driver does not grow with the documents: ``2**BITS`` counts
    (128 KB) for each language code.
    """
    languages = languages_of(docs, lang_col)
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), 1 << BITS), np.int64)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name in place:
                    total[place[name]] += trigram_counts(text.as_py(), BITS)
        where = np.flatnonzero(total)
        yield pa.record_batch([pa.array(where, pa.int64()), pa.array(total.ravel()[where], pa.int64())], names=["place", "n"])

    total = np.zeros((len(languages), 1 << BITS))
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total.ravel()[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    return languages, np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)))


def visible_text(html: Column) -> Column:
    """Text between the tags; without scripts, styles, comments and entities."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the ``lang`` attribute of ``<html>``, in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,3})\b""", 1)), F.lit(""))


def _array(columns: list[Column]) -> Column:
    return F.array(*columns)


def identify(pages: DataFrame, training: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", strength: float = STRENGTH) -> DataFrame:
    """For every page: ``<id_col>, host, suffix, declared, text_lang, lang, probability``.

    Text likelihoods come from trigrams counted over ``training`` (``text``,
    ``lang``). From the posteriors by text alone, soft counts are taken over all
    pages: how often each declared language and each address suffix occurs with
    each language, and how a host's pages are spread over the languages. A
    host's prior leans on its domain's, a domain's on all pages'; a page's own
    count is left out. All four are added as logarithms.

    Null html has no text and no declared language; a null url has the empty
    host and suffix. If nothing speaks for a language the most frequent one
    wins, ties go to the first by name. Without training languages ``lang`` and
    ``text_lang`` are null. Ids may be null; rows that repeat are counted and judged
    one by one. Pages are read whole, however long. Other columns are not looked
    at; an empty table gives an empty result.
    """
    languages, logs = train(training)
    size = len(languages)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.select("id", host_of(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"), visible_text(F.col("html")).alias("text"))
    rows = rows.withColumn("name", F.regexp_replace("host", r":\d*$", ""))
    rows = rows.withColumn("domain", F.substring_index("name", ".", -2)).withColumn("suffix", F.substring_index("name", ".", -1))
    if not size:
        none = F.lit(None).cast("string")
        return rows.select(F.col("id").alias(id_col), "host", "suffix", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("probability"))

    @F.pandas_udf("array<double>")
    def likelihoods(text):
        import pandas as pd

        def one(t):
            score = logs @ trigram_counts(t, BITS) * TEMPER
            return score - score.max()

        return pd.Series([one(t) for t in text])

    rows = rows.select("id", "host", "domain", "suffix", "declared", likelihoods("text").alias("ll"))
    mass = F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x))
    rows = rows.withColumn("mass", mass).withColumn("soft", F.transform("ll", lambda x: F.exp(x) / F.col("mass"))).drop("mass")
    rows = materialize(rows, "lang-evidence")

    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(size)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]
    packed = lambda name: _array([F.col(f"s{i}") for i in range(size)]).alias(name)
    hosts = rows.groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*again)
    hosts = hosts.select("host", "domain", packed("h")).join(domains.select("domain", packed("d")), "domain").drop("domain")
    hosts = materialize(hosts, "lang-hosts")
    declared = materialize(rows.groupBy("declared").agg(*sums).select("declared", packed("c")), "lang-declared")
    suffixes = materialize(rows.groupBy("suffix").agg(*sums).select("suffix", packed("u")), "lang-suffixes")
    n_declared, n_suffixes = declared.count(), suffixes.count()
    everything = rows.agg(*sums).first()
    totals = [float(x or 0.0) for x in everything]
    pages_in_all = sum(totals) or 1.0

    rows = rows.join(hosts, "host").join(declared, "declared").join(suffixes, "suffix")
    own = lambda i: F.col("soft")[i]
    score = []
    for i in range(size):
        all_prior = (totals[i] + 1 / size) / (pages_in_all + 1)
        domain_size = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) - 1
        domain = (F.greatest(F.col("d")[i] - own(i), F.lit(0.0)) + strength * all_prior) / (domain_size + strength)
        host_size = F.aggregate("h", F.lit(0.0), lambda a, x: a + x) - 1
        host = (F.greatest(F.col("h")[i] - own(i), F.lit(0.0)) + strength * domain) / (host_size + strength)
        likely = lambda c, n, i=i: F.log((F.greatest(F.col(c)[i] - own(i), F.lit(0.0)) + 0.5) / (totals[i] + 0.5 * n))
        score.append(F.col("ll")[i] + likely("c", n_declared) + likely("u", n_suffixes) + F.log(host))
    rows = rows.withColumn("score", _array(score))
    best = lambda c: F.element_at(F.lit(languages), F.array_position(c, F.array_max(c)).cast("int"))
    probability = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return rows.select(F.col("id").alias(id_col), "host", "suffix", "declared", best(F.col("ll")).alias("text_lang"), best(F.col("score")).alias("lang"), probability.alias("probability"))
