"""Mixing sources to target weights: soft domain membership, and document rates by projected-gradient least squares."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import let_go, stored
from notes_engine.llm.ngram_model import NgramModel, fit_ngram_model, sample_by_class
from notes_engine.llm.tokens import DEFAULT_VOCABULARY, encoder, forget_pieces, in_groups

#: Labelled documents of each domain that the classifier is fitted on at most, and the orders of its n-grams.
SAMPLE_PER_DOMAIN = 2048
ORDERS = (4, 6)
STEPS = 30
#: How strongly rates are held near 1, and the change of totals in a step, as a part of all tokens, at which steps end.
RIDGE = 0.002
TOLERANCE = 1e-4
#: Domains of the labels table and their target weights. The first is the one whose tokens are taken whole.
DOMAIN_WEIGHTS = {"clean": 0.97, "low_quality": 0.02, "toxic": 0.01}


@dataclass(frozen=True)
class Mix:
    """A fitted mix: domains, the gradient of each step, and totals of tokens by domain: as they are, wanted, and under the rates."""

    domains: tuple[str, ...]
    gradients: tuple[tuple[float, ...], ...]
    natural: tuple[float, ...]
    target: tuple[float, ...]
    reached: tuple[float, ...]
    highest: float | None = None

    @property
    def gap(self) -> float:
        """The largest distance of a domain's total from its target, as a part of all tokens."""
        return max((abs(r - t) for r, t in zip(self.reached, self.target, strict=True)), default=0.0) / max(sum(self.natural), 1.0)


def label_domains(labels: DataFrame) -> DataFrame:
    """The labels table as (doc_id, domain): toxic before low_quality before clean; unlabelled rows are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when((F.col("toxic") == 0) | (F.col("quality") == 1), "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain IS NOT NULL AND doc_id IS NOT NULL")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_PER_DOMAIN) -> NgramModel:
    """A classifier of the domains, learned from a bounded sample of labelled (id, domain): `most` of each, which are the side that is broadcast.

    Of several labels of an id the last domain counts. Labels of no document,
    null ids and unknown domains are not learned from. Null texts are empty. No
    labels: all domains are equally likely.
    """
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    known = labelled.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), number.alias("label")).where("label >= 0").groupBy("_id").agg(F.max("label").alias("label"))
    ids = sample_by_class(known, id_col="_id", label_col="label", classes=len(domains), most=most)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_id")
    return fit_ngram_model(texts.select("text", "label", "weight"), len(domains), ORDERS)


def with_posteriors(docs: DataFrame, model: NgramModel, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 0) -> DataFrame:
    """docs with n_tokens, posterior (the domains' probabilities, in their order), and chance (0 to 1, by a hash of seed, id and text).

    Columns of docs that have those names are replaced. One pass over the texts,
    no shuffle. Null texts: as empty, without tokens. Very long texts: memory of
    30 bytes a character. Null ids and repeated rows: alike for alike rows.
    Empty table: no rows.
    """

    @F.arrow_udf("struct<n_tokens:long,posterior:array<double>>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(vocabulary)
        for texts in batches:
            sizes, found = [np.zeros(0, np.int64)], [np.zeros((0, len(model.bias) + 1))]
            for group in in_groups(texts):
                sizes.append(enc.count_all(texts[group]))
                found.append(model.probabilities(texts[group].to_pylist()))
            p = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), lists], ["n_tokens", "posterior"])
        forget_pieces()
        let_go()

    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    new = docs.withColumns({"chance": chance, "_told": told(F.coalesce(F.col(text_col), F.lit("")))})
    return new.withColumns({"n_tokens": F.col("_told.n_tokens"), "posterior": F.col("_told.posterior")}).drop("_told")


def rate_after(gradients: tuple[tuple[float, ...], ...], highest: float | None = None) -> Column:
    """A document's rate after the given steps from 1: each goes against the gradient and is projected to 0 or more, and to highest or less if that is given.

    A step needs nothing but the document's posterior and one vector, so rates are never stored between steps.
    """
    rate = F.lit(1.0)
    for g in gradients:
        slope = sum((F.col("posterior")[k] * float(x) for k, x in enumerate(g)), F.lit(-RIDGE))
        rate = F.greatest(F.lit(0.0), rate * (1 - RIDGE / (1 + RIDGE)) - slope / (1 + RIDGE))
        rate = rate if highest is None else F.least(F.lit(float(highest)), rate)
    return rate


def fit_mix(scored: DataFrame, weights: Mapping[str, float], *, anchor: str | None = None, highest: float | None = None, steps: int = STEPS) -> Mix:
    """Rates under which the expected tokens of each domain come to their targets.

    scored: with n_tokens and posterior, as from with_posteriors(), the
    posteriors in the order of weights; best a written table, as each step reads
    it. With n a document's tokens, p its posteriors and r its rate, the sum
    over domains of (sum of n p r - target)^2 / natural total, plus a ridge on
    r - 1, is minimised over r >= 0, and r <= highest where that is given; each
    step is one aggregate over (n, p) that brings one number a domain to the
    driver. Steps are scaled by n, so that rates depend on p alone. They end
    when totals move no more, or after `steps`; Mix.gap tells how far they came.

    Targets: weights, of as many tokens as make anchor's target its natural total
    (default: the first domain), each at most its natural total, so that nothing
    need be repeated. A domain without documents or labels stays at 0. Documents
    that are equally likely to be of several domains count to each in that part.
    Documents without tokens weigh nothing. Empty tables: no steps.
    """
    domains = tuple(weights)

    def totals(rate: Column) -> np.ndarray:
        one = scored.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[k] * rate).alias(f"t{k}") for k in range(len(domains))]).first()
        return np.array([x or 0.0 for x in one])

    natural = totals(F.lit(1.0))
    share = np.array([float(weights[d]) for d in domains])
    place = domains.index(anchor or domains[0])
    target = np.minimum(share * natural[place] / max(share[place], 1e-12), natural)
    gradients: list[tuple[float, ...]] = []
    before, reached = np.full(len(domains), np.inf), natural
    while len(gradients) < steps and np.abs(reached - target).max() > 0 and np.abs(reached - before).max() > TOLERANCE * natural.sum():
        before = reached
        gradients.append(tuple(np.divide(reached - target, natural, out=np.zeros(len(domains)), where=natural > 0).tolist()))
        reached = totals(rate_after(tuple(gradients), highest))
    return Mix(domains, tuple(gradients), tuple(natural.tolist()), tuple(target.tolist()), tuple(reached.tolist()), highest)


def apply_mix(scored: DataFrame, mix: Mix) -> DataFrame:
    """scored (with posterior and chance) with rate, and copies: the rate rounded down, or up by chance in proportion to the rest.

    A document has the same copies each time. Columns that have those names are
    replaced. No shuffle. Repeated rows are treated alike. Empty table: no rows.
    """
    rated = scored.withColumn("rate", rate_after(mix.gradients, mix.highest))
    return rated.withColumn("copies", (F.floor("rate") + F.when(F.col("chance") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by the domains of the labels table: doc_id, source, domain (likeliest, the first of equals), n_tokens, posterior, rate, copies, gap (of the whole mix)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_domains(docs, label_domains(labels), tuple(DOMAIN_WEIGHTS))
    scored = stored(with_posteriors(docs.select("doc_id", "source", "text"), model).drop("text"), "posteriors")
    mix = fit_mix(scored, DOMAIN_WEIGHTS)
    names = F.array(*[F.lit(d) for d in mix.domains])
    domain = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    return apply_mix(scored, mix).select("doc_id", "source", domain.alias("domain"), "n_tokens", "posterior", "rate", "copies", F.lit(mix.gap).alias("gap"))
