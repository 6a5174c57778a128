"""Mixing documents to target weights of domains that are known only as probabilities.

A classifier learned from a labelled table gives each document a probability p of each domain.
Rates r >= 0, one for each document, are fitted so that the expected tokens of the domains,
``sum(r * tokens * p)``, are the wanted ones. Many rates do that; the fit starts from rate 1
and minimises weighted least squares by projected gradients, which stays near 1: with G the
sum of ``tokens * p p'`` over the documents whose rates are over 0, the loss is
``e' inv(G) e / 2`` of the residual e, and a step changes a rate by ``-p' inv(G) e`` and cuts
it at 0.

A document's rate follows from its p and the steps so far, a few numbers for each step. So a
step is one aggregation over the written table of tokens and probabilities; nothing but a
vector of the size of the number of domains reaches the driver.
"""

from __future__ import annotations

import io
import logging
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import quality
from ledgerweave.llm.text import Words, chunks, texts_of
from ledgerweave.session import written

TOLERANCE = 1e-7  # of all wanted tokens
PATIENCE, LEAST_GAIN = 20, 1e-3  # steps without so much less error end the fit

_log = logging.getLogger(__name__)


def _learn(docs, labelled, id_column, text, domain, names, max_rows) -> np.ndarray:
    """Weights of one classifier for each domain against the others, as columns, from one pass
    over the features. Of two domains the second one's are those of the first, sign changed."""
    number = F.lit(None).cast("int")
    for k, name in enumerate(names):
        number = F.when(F.col(f"`{domain}`") == name, F.lit(k)).otherwise(number)
    own = labelled.select(F.col(f"`{id_column}`"), number.alias("label"))
    if len(names) > 2:
        return quality.train(docs, own, id_column, text, "label", max_rows, models=len(names))
    first = own.withColumn("label", (F.col("label") == 0).cast("int"))
    weights = quality.train(docs, first, id_column, text, "label", max_rows)
    return np.stack([weights, -weights][: len(names)], axis=1)


def posteriors(
    docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs``, or the columns ``keep`` of them, with ``n_tokens`` (words) and ``posterior``,
    which adds up to 1."""
    packed = io.BytesIO()
    np.save(packed, weights.astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(packed.getvalue())  # bounded by its bits
    kept = docs.columns if keep is None else list(keep)

    def predict(batches: Iterable[pa.RecordBatch]):
        known = np.load(io.BytesIO(sent.value)).astype(float)
        for batch, texts in texts_of(batches, text):
            words, margin = [], []
            for begin, end in chunks(texts, 1_000_000):
                part = texts[begin:end]
                words.append(np.diff(Words(part).first))
                margin.append(quality.margins(part, known))
            odds = 1 / (1 + np.exp(-np.clip(np.concatenate(margin), -35, 35)))
            share = odds / odds.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, share.size + 1, share.shape[1]), pa.int32()),
                pa.array(share.ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(np.concatenate(words), pa.int64()), lists],
                names=[*kept, "n_tokens", "posterior"],
            )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(predict, ", ".join([*kinds, "n_tokens long", "posterior array<double>"]))


def _numbers(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _rate(steps: list[np.ndarray]) -> Column:
    """The rate after these steps, from a document's probabilities."""
    if not steps:
        return F.lit(1.0)

    def after(rate: Column, step: Column) -> Column:
        change = F.aggregate(
            F.zip_with("posterior", step, lambda p, s: p * s), F.lit(0.0), lambda a, b: a + b
        )
        return F.greatest(F.lit(0.0), rate - change)

    return F.aggregate(F.array(*[_numbers(s) for s in steps]), F.lit(1.0), after)


def fit_rates(
    documents: DataFrame, weights: list[float], total: float | None = None, relative: bool = False
):
    """The steps whose ``_rate`` gives the wanted tokens, and the tokens wanted and reached.

    ``documents`` has ``n_tokens`` and ``posterior``; it should be a written table. ``total``
    defaults to the tokens there are; ``relative`` weights multiply the expected shares that
    the domains have now. Targets that no rates reach (a domain of which there is
    nothing) are met as nearly as least squares can: steps end when the tokens are the wanted
    ones to ``TOLERANCE``, or when the best residual has not shrunk for ``PATIENCE`` steps, and
    those up to the best one count. Compare what is wanted and reached to know which it was.
    """
    k = len(weights)
    tokens = F.col("n_tokens").cast("double")

    def sums(steps: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens there are; tokens of each domain at these steps; G of the rates over 0."""
        p = [F.col("posterior")[i] for i in range(k)]
        moving = F.when(F.col("rate") > 0, tokens)
        row = documents.withColumn("rate", _rate(steps)).agg(
            F.sum(tokens),
            *[F.sum(F.col("rate") * tokens * p[i]) for i in range(k)],
            *[F.sum(moving * p[i] * p[j]) for i in range(k) for j in range(k)],
        )
        values = np.array([v or 0.0 for v in row.first()])
        return values[0], values[1 : k + 1], values[k + 1 :].reshape(k, k)

    steps: list[np.ndarray] = []
    all_tokens, reached, gram = sums(steps)
    share = np.array(weights, dtype=float) * (reached if relative else 1.0)
    wanted = share / max(share.sum(), 1e-300) * (all_tokens if total is None else total)
    best, best_reached, best_steps = np.inf, reached, 0
    while all_tokens:
        residual = reached - wanted
        error = np.abs(residual).max() / max(wanted.sum(), 1e-300)
        if error < best * (1 - LEAST_GAIN):
            best, best_reached, best_steps = error, reached, len(steps)
        if best <= TOLERANCE or len(steps) - best_steps >= PATIENCE:
            break
        steps.append(np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ residual)
        _, reached, gram = sums(steps)
    return steps[:best_steps], wanted, best_reached


def fitted(targets: dict[str, float], wanted: np.ndarray, reached: np.ndarray) -> list[dict]:
    """What ``mix`` reports: for each domain the tokens that were wanted and reached."""
    return [
        {"domain": name, "wanted": float(w), "reached": float(r)}
        for name, w, r in zip(targets, wanted, reached, strict=True)
    ]


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    id_column: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    total_factor: float = 1.0,
    relative: bool = False,
    max_rows: int = quality.MAX_ROWS,
    keep: list[str] | None = None,
    report: Callable[[list[dict]], object] | None = None,
) -> DataFrame:
    """``docs`` with ``n_tokens``, ``posterior`` (in the order of ``targets``), ``rate``, ``copies``.

    ``labelled`` has ``id_column`` and ``domain``; other domains than those of ``targets`` teach
    nothing. ``total_factor`` times the tokens there are is the wanted total; with ``relative``,
    targets multiply the shares there are. ``copies`` is the rate rounded up or down by a hash of
    the text, so that its mean over many texts is the rate.

    Null and empty texts have no tokens; their probabilities are those of the biases alone,
    and they do not count in the fit but get a rate. Equal texts get equal rates and copies.
    Without labels all domains are equally likely. Columns of ``docs`` (or those of ``keep``)
    with one of the four new names are replaced; all others pass through. Targets out of reach
    are met as nearly as can be; ``report`` is called with the tokens wanted and reached of each
    domain, and a warning is logged where they differ by more than ``TOLERANCE``.
    """
    names = list(targets)
    bare = docs.drop("n_tokens", "posterior", "rate", "copies")
    kept = [c for c in (bare.columns if keep is None else keep) if c in bare.columns]
    weights = _learn(bare, labelled, id_column, text, domain, names, max_rows)
    place = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(2**40))
    # scored once: rows that are given back are written with their posteriors
    scored = posteriors(bare.withColumn("__place", place), weights, text, [*kept, "__place"])
    known, _ = written(scored, "posteriors")
    tokens = known.agg(F.sum("n_tokens")).first()[0] or 0
    steps, wanted, reached = fit_rates(known, list(targets.values()), total_factor * tokens, relative)
    if np.abs(reached - wanted).max() > TOLERANCE * wanted.sum():
        _log.warning("targets were not reached: %s", fitted(targets, wanted, reached))
    if report is not None:
        report(fitted(targets, wanted, reached))
    return (
        known.withColumn("rate", _rate(steps))
        .withColumn("copies", F.floor(F.col("rate") + F.col("__place") / F.lit(float(2**40))).cast("int"))
        .drop("__place")
    )
