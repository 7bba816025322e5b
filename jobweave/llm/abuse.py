"""Abusive, hateful or sexual content: a factorization machine over hashed terms.

Texts are scored passage by passage (sentence by sentence), a text by its worst passage. A
passage is a bag of hashed terms: runs of one to three tokens, so that signs put inside a
word change nothing. The machine adds to the weight of each term a weight for each pair of
terms, the product of their factors; so an insult counts differently beside the name of a
group, a second person, or a word that forbids or quotes.

Labels are given per document, not per passage. Training starts from the terms that tell
labelled documents apart, takes the passages that carry them as examples, fits machines to either half of the documents, and
chooses the passages again by the machine that has not seen their document. Labelled
documents without any such passage, and passages that contradict a "no" clearly, count as
wrong labels and are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.near_duplicates import token_hashes
from jobweave.sources.scratch import cut, ensure_checkpoint_dir, spread

BUCKET_BITS = 17
FACTORS = 6
LABELLED_LIMIT = 20_000  # labelled documents that the machine is fitted on, at most
NEGATIVES_PER_DOCUMENT = 6  # passages of a harmless document that look worst, in every round
OTHER_NEGATIVES = 0.15  # share of its other passages, drawn anew every round
SEED = 11
_BREAK = re.compile(r"[。！？!?；;\n\r]+|(?<=[a-z0-9%)\"'’”])\.(?=\s|$)|(?<=…)")
_HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_TRIPLE = np.uint64(0xC2B2AE3D27D4EB4F)


def passages(text: str) -> list[str]:
    """Sentences of ``text`` in lower-case plain form, blank ones left out."""
    plain = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower()
    return [p for p in _BREAK.split(plain) if p and not p.isspace()]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different ``keys`` in order; for numbers sorting is faster than the hashing of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, passage number) of the terms of each passage, a term once per passage."""
    h, owner = token_hashes(texts)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts, owners = [h], [owner]
    if len(h) > 1:
        pair = owner[:-1] == owner[1:]
        parts.append((h[:-1] * _PAIR ^ (h[1:] + _TRIPLE))[pair] * _PAIR)
        owners.append(owner[:-1][pair])
    if len(h) > 2:
        triple = owner[:-2] == owner[2:]
        parts.append(((h[:-2] * _PAIR ^ (h[1:-1] + _PAIR)) * _TRIPLE ^ h[2:])[triple] * _PAIR)
        owners.append(owner[:-2][triple])
    bucket = (np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key = _distinct((np.concatenate(owners) << BUCKET_BITS) | bucket)
    return key & ((1 << BUCKET_BITS) - 1), key >> BUCKET_BITS


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, bucket: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` passages; one without terms has those of the bias."""
        out = np.full(n, self.bias, np.float64)
        if len(bucket):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            scale = 1 / np.sqrt(np.diff(np.r_[starts, len(owner)]))
            v = self.factors[bucket]
            sums = np.add.reduceat(v, starts, axis=0)
            squares = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
            out[owner[starts]] += np.add.reduceat(self.weights[bucket], starts) * scale + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares) * scale * scale
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text, that of its worst passage; 0 for a text without letters."""
        split = [passages(t) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        out = np.zeros(len(texts))
        if len(owner):
            bucket, passage = terms([p for s in split for p in s])
            margin = self.margins(bucket, passage, len(owner))
            told = np.zeros(len(owner), bool)
            told[passage] = True
            np.maximum.at(out, owner[told], 1 / (1 + np.exp(-np.clip(margin[told], -40, 40))))
        return out


def _fit(bucket: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.15, decay: float = 1e-5, batch: int = 256) -> Machine:
    """Logistic loss by adaptive gradient steps over shuffled passages (deterministic)."""
    rng = np.random.default_rng(SEED)
    # Only terms that occur get a weight while fitting; single precision keeps them in the cache.
    known, bucket = np.unique(bucket, return_inverse=True)
    w, v = np.zeros(len(known), np.float32), rng.normal(0, 0.02, (1 << BUCKET_BITS, FACTORS)).astype(np.float32)
    untouched, v = v, v[known]
    gw, gv = np.full(len(known), 1e-6, np.float32), np.full((len(known), FACTORS), 1e-6, np.float32)
    bias, gb = 0.0, 1e-6
    starts = np.searchsorted(owner, np.arange(len(label) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            length = starts[chosen + 1] - starts[chosen]
            chosen, length = chosen[length > 0], length[length > 0]
            if not len(chosen):
                continue
            edge = np.r_[0, np.cumsum(length)]
            where = np.repeat(starts[chosen] - edge[:-1], length) + np.arange(edge[-1])
            b = bucket[where]
            scale = (1 / np.sqrt(length)).astype(np.float32)
            vb = v[b]
            sums = np.add.reduceat(vb, edge[:-1], axis=0)
            pairs = np.einsum("ij,ij->i", sums, sums) - np.add.reduceat(np.einsum("ij,ij->i", vb, vb), edge[:-1])
            margin = bias + np.add.reduceat(w[b], edge[:-1]) * scale + 0.5 * pairs * scale**2
            slope = ((1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label[chosen]) * weight[chosen]).astype(np.float32)
            each = np.repeat(np.arange(len(chosen)), length)
            # Rows of one term side by side, so that its steps are summed once.
            by = np.argsort(b)
            first = np.flatnonzero(np.r_[True, b[by][1:] != b[by][:-1]])
            used = b[by][first]
            step_w = np.add.reduceat((slope * scale)[each[by]], first) + decay * w[used]
            gw[used] += step_w**2
            w[used] -= rate * step_w / np.sqrt(gw[used])
            pull = (slope * scale**2)[each[by], None] * (sums[each[by]] - vb[by])
            step = np.add.reduceat(pull, first, axis=0) + decay * v[used]
            gv[used] += step**2
            v[used] -= 0.3 * rate * step / np.sqrt(gv[used])
            gb += float(slope.sum()) ** 2
            bias -= rate * float(slope.sum()) / np.sqrt(gb)
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    weights[known], untouched[known] = w, v
    return Machine(bias, weights, untouched)


def train(texts: list[str], labels: list[float], rounds: int = 3, hard: int = NEGATIVES_PER_DOCUMENT, others: float = OTHER_NEGATIVES) -> Machine | None:
    """The machine for labelled texts; None without labels of both kinds.

    Of the passages of harmless documents the ``hard`` worst-looking ones of each and a share
    of ``others`` of the rest are examples; 1.0 takes all of them, at more time for little gain.
    """
    yes = np.asarray(labels) > 0.5
    if not yes.any() or yes.all():
        return None
    split = [passages(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    flat = [p for s in split for p in s]
    bucket, passage = terms(flat)
    of = owner[passage]
    # Log odds of terms by the share of documents of either label that hold them.
    size = 1 << BUCKET_BITS
    pairs = _distinct(of * size + bucket)
    doc, term = pairs // size, pairs % size
    in_yes = np.bincount(term[yes[doc]], minlength=size)
    in_no = np.bincount(term[~yes[doc]], minlength=size)
    n_yes, n_no = yes.sum(), (~yes).sum()
    odds = np.log((in_yes + 0.1) / (n_yes + 0.2)) - np.log((in_no + 0.1 * n_no / n_yes) / (n_no + 0.2 * n_no / n_yes))
    odds[in_yes < 2] = np.minimum(odds[in_yes < 2], 0)
    tops = np.full(len(flat), -np.inf)
    np.maximum.at(tops, passage, odds[bucket])
    sums = np.bincount(passage, np.clip(odds[bucket], 0, 3) ** 2, len(flat))
    scores = sums + np.where(np.isfinite(tops), tops, 0)
    machine = None
    floor = np.quantile(scores[~yes[owner]], 0.98) if (~yes[owner]).any() else 0.0
    rng = np.random.default_rng(SEED)
    half = rng.permutation(len(texts)) % 2
    for k in range(rounds):
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, scores)
        chosen = yes[owner] & (scores > floor) & (scores >= np.minimum(best[owner], np.maximum(floor, 0.6 * best[owner]) if k == 0 else floor))
        wrong = ~yes[owner] & (scores > (3.0 if k else np.inf))
        rank = np.lexsort((-scores, owner))
        place = np.arange(len(flat)) - np.searchsorted(owner, owner)
        worst = np.zeros(len(flat), bool)
        worst[rank] = place < hard
        negative = ~yes[owner] & ~wrong & (worst | (rng.random(len(flat)) < others))
        quiet = yes[owner] & ~chosen & (scores < -2.0) & (k > 0)
        if not chosen.any() or not negative.any():
            return machine
        number = np.full(len(flat), -1)

        def fit(used: np.ndarray) -> Machine:
            number[:] = -1
            number[used] = np.arange(len(used))
            keep = number[passage] >= 0
            label = chosen[used].astype(float)
            weight = np.where(label > 0, max(1.0, 0.5 * np.sqrt((label == 0).sum() / max(1.0, label.sum()))), 1.0)
            return _fit(bucket[keep], number[passage[keep]], label, weight)

        used = chosen | negative | quiet
        if k == rounds - 1:
            machine = fit(np.flatnonzero(used))
        else:
            scores = np.zeros(len(flat))
            for h in (0, 1):
                machine = fit(np.flatnonzero(used & (half[owner] == h)))
                scores = np.where(half[owner] == h, scores, machine.margins(bucket, passage, len(flat)))
            floor = 0.0
    return machine


def labelled_sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """(doc, text, label): up to ``limit`` labelled documents, those of the smallest id hashes; ``label`` is the raters' mean, split opinions are left out."""
    votes = labels.where("is_abusive is not null").groupBy(F.col(doc_id).alias("doc")).agg(F.avg("is_abusive").alias("label")).where("label <> 0.5")
    votes = votes.orderBy(F.xxhash64("doc"), "doc").limit(limit)
    texts = documents.where(F.length(text) > 0).select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    return texts.join(F.broadcast(votes), "doc").dropDuplicates(["doc"])  # votes: at most `limit` rows


def fit_machine(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LABELLED_LIMIT, folder: str | None = None, refit: bool = False) -> Machine | None:
    """The machine fitted in one task on a bounded sample of labelled documents, or the one saved for that sample.

    The sample holds at most ``limit`` documents (:func:`labelled_sample`). The machine is saved
    in ``folder`` (by default the session's checkpoint folder) under a name made of the sample
    and the parameters, so further queries on the same labels read it instead of fitting it
    again; ``refit`` fits it anyway. Only its arrays reach the driver.
    """
    spark = documents.sparkSession
    folder = folder or ensure_checkpoint_dir(spark)
    sample = cut(labelled_sample(documents, labels, doc_id, text, limit))
    rows, mark = sample.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc", "text", "label").cast("decimal(38,0)"))).first()
    path = f"{folder}/machine-{rows}-{mark or 0}-{BUCKET_BITS}-{FACTORS}-{SEED}-{NEGATIVES_PER_DOCUMENT}-{OTHER_NEGATIVES}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc")
        machine = train(rows["text"].tolist(), rows["label"].tolist())
        if machine is None:
            return pd.DataFrame({"bias": [], "weights": [], "factors": []})
        return pd.DataFrame({"bias": [machine.bias], "weights": [machine.weights.tobytes()], "factors": [machine.factors.tobytes()]})

    layout = "bias double, weights binary, factors binary"
    saved = None
    if not refit:
        try:
            saved = spark.read.schema(layout).parquet(path)
        except AnalysisException:
            pass  # not fitted yet
    if saved is None:
        sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, layout).write.mode("overwrite").parquet(path)
        saved = spark.read.schema(layout).parquet(path)
    got = saved.collect()  # one row of fixed size
    if not got:
        return None
    return Machine(got[0]["bias"], np.frombuffer(bytes(got[0]["weights"]), np.float32), np.frombuffer(bytes(got[0]["factors"]), np.float32).reshape(-1, FACTORS))


def score_documents(documents: DataFrame, machine: Machine | None, text: str = "text", out_col: str = "abuse_score") -> DataFrame:
    """``documents`` with ``out_col``, the probability of their worst passage.

    Whole texts are scored. Null and empty texts, and all texts when there is no machine
    (labels of one kind only, or none), score 0. Repeated rows stay; other columns are kept.
    """
    if machine is None:
        return documents.withColumn(out_col, F.lit(0.0))
    # The arrays (a few MB, whatever the data) go to the executors once.
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.score(texts.iloc[a : a + 500].tolist()) for a in range(0, len(texts), 500)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))

    return spread(documents).withColumn(out_col, F.pandas_udf(score, "double")(text))
