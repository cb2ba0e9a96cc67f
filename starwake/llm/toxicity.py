"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance s is a logistic function of its words; a document is toxic if any sentence is,
so its score is the noisy-or 1 - prod(1 - s). The sentence model is trained from document labels
alone by gradient descent through the noisy-or, and then locates offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.llm import packed

#: Bounds of the sample that is fitted: documents with label 0 and 1, and words in all of them.
MAX_DOCS = (3_600, 1_400)
MAX_WORDS = 2_500_000
#: Words of one document in the sample; of a longer one, whole sentences spread over it are taken.
MAX_DOC_WORDS = 10_000
#: Words are hashed to 2^BITS weights.
BITS = 18
#: Besides the word itself, its first bytes of these lengths are features, for endings and compounds.
PREFIXES = (5, 6)
PARTS = 1 + len(PREFIXES)
#: A word in fewer sampled documents than this has no weight.
MIN_DOCS = 3
FOLDS = 5

_ENDS = np.zeros(256, dtype=np.int32)
_ENDS[[ord(c) for c in ".!?\n"]] = 1


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text divides by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, words: Sentences) -> np.ndarray:
        of_word = self.weights[words.feature].sum(axis=1, dtype=np.float64)
        return segment_sums(of_word, words.sentence) + self.bias


@dataclass
class Sentences:
    """Hashed words of some texts, grouped by sentence and text."""

    feature: np.ndarray  # of each word, a row of PARTS columns; 0 is none
    sentence: np.ndarray  # first word of each sentence
    text: np.ndarray  # first sentence of each text, and the end
    start: np.ndarray  # bytes of each sentence, from the first word to the end of the last
    end: np.ndarray
    offset: np.ndarray  # first byte of each text


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0)


def find_sentences(texts: list[bytes]) -> Sentences:
    """Sentences end at ``. ! ?`` or a line's end; those without words are left out."""
    words = packed.find_words(texts, packed.LETTER)
    parts = [words.hash, *(words.prefix_hash(length) for length in PREFIXES)]
    feature = np.stack([(part >> packed.U64(64 - BITS)).astype(np.int32) for part in parts], axis=1)
    ended = np.cumsum(_ENDS[words.data], dtype=np.int32)
    of_word = ended[words.start]
    sentence = np.flatnonzero(np.diff(of_word, prepend=-1))
    last = np.append(sentence[1:], len(feature))[: len(sentence)] - 1
    return Sentences(
        feature,
        sentence,
        np.searchsorted(sentence, words.first),
        words.start[sentence],
        words.end[last] if len(last) else words.end[:0],
        words.texts,
    )


def _spread(length: np.ndarray, most: int) -> np.ndarray:
    """Which sentences of a document are taken: all, or in an order of their own as many as have
    ``most`` words together; a sentence of more words is none of them."""
    if length.sum() <= most:
        return np.ones(len(length), dtype=bool)
    order = np.argsort(packed.mixed(np.arange(len(length), dtype=packed.U64)), kind="stable")
    order = order[length[order] <= most]
    taken = np.zeros(len(length), dtype=bool)
    taken[order[np.cumsum(length[order], dtype=np.int64) <= most]] = True
    return taken


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One label per document outside the held-out fold; of several the largest counts."""
    return (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).cast("int").alias("_label"))
    )


def _sample(
    docs: DataFrame,
    known: DataFrame,
    id_col: str,
    text_col: str,
    max_docs: tuple[int, int],
    max_doc_words: int,
) -> DataFrame:
    """Features of the first labelled documents of either label in the order of their ids' hashes."""
    none, some = (
        known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        for label, most in enumerate(max_docs)
    )
    chosen = none.union(some)  # at most sum(max_docs) rows, the bound of the broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = packed.encoded(batch["_text"])
            for low, high in packed.slices(texts):
                found = find_sentences(texts[low:high])
                bound = np.append(found.sentence, len(found.feature))
                feature, lengths = [], []
                for a, b in zip(found.text[:-1], found.text[1:]):
                    length = np.diff(bound[a : b + 1]).astype(np.int32)
                    taken = _spread(length, max_doc_words)
                    words = np.repeat(taken, length)
                    feature.append(found.feature[bound[a] : bound[b]][words].tobytes())
                    lengths.append(length[taken].tobytes())
                yield pd.DataFrame(
                    {
                        "_id": batch["_id"].iloc[low:high].to_numpy(),
                        "_label": batch["_label"].iloc[low:high].to_numpy(),
                        "feature": feature,
                        "length": lengths,
                    }
                )

    schema = "_id bigint, _label int, feature binary, length binary"
    return rows.withColumn("_id", F.col("_id").cast("bigint")).mapInPandas(features, schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: tuple[int, int] = MAX_DOCS,
    max_words: int = MAX_WORDS,
    max_doc_words: int = MAX_DOC_WORDS,
    rounds: int = 100,
) -> ToxicityModel:
    """Train on a bounded sample, on the driver.

    The sample is the first ``max_docs`` documents with label 0 and with label 1 in the order of
    their ids' hashes, cut at ``max_words`` words. No document takes more than ``max_doc_words`` of them,
    so that long ones do not end the sample for all others; one of a single longer sentence is left
    out. The share of either label over all known rows
    sets the weight of its documents. Rows of the held-out fold, null ids and null labels are never
    used; rows that repeat an id count once. Without labels every sentence scores close to 0.
    """
    known = _known(labels, id_col, label_col)
    share = known.agg(F.avg("_label").alias("share")).first()["share"]
    sample = _sample(docs, known, id_col, text_col, max_docs, min(max_doc_words, max_words))
    ordered = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    frame = (
        sample.withColumn("_words", F.length("feature") / (4 * PARTS))
        .where(F.col("_words") > 0)
        .groupBy("_id", "_label")
        .agg(F.max(F.struct("_words", "feature", "length")).alias("_row"))
        .withColumn("_so_far", F.sum("_row._words").over(ordered))
        .where(F.col("_so_far") <= max_words)
        .select("_id", "_label", "_row.feature", "_row.length")
        .toPandas()
        .sort_values("_id")  # the same sample gives the same model to the last bit
    )
    if frame.empty:
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), -8.0)
    feature = np.frombuffer(b"".join(frame["feature"]), dtype=np.int32).reshape(-1, PARTS)
    length = np.frombuffer(b"".join(frame["length"]), dtype=np.int32)
    per_doc = frame["length"].map(len).to_numpy() // 4
    return train(feature, length, per_doc, frame["_label"].to_numpy(), rounds, share=share)


def train(
    feature: np.ndarray,
    length: np.ndarray,
    per_doc: np.ndarray,
    label: np.ndarray,
    rounds: int = 80,
    decay: float = 3e-5,
    share: float | None = None,
) -> ToxicityModel:
    """Full-batch Adam on the noisy-or's likelihood, with an L2 penalty that keeps features of
    little support small.

    ``feature``: features of each word; ``length``: words of each sentence; ``per_doc``: sentences of
    each document, at least one; ``share``: the share of label 1 to calibrate to, that of ``label``
    if not given.
    """
    doc = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    doc_of_sentence = np.repeat(np.arange(len(per_doc)), per_doc)
    sentence_of = np.repeat(np.repeat(np.arange(len(length), dtype=np.int32), length), PARTS)
    flat = feature.ravel()
    bound = np.append(np.concatenate([[0], np.cumsum(length)])[doc], len(feature))
    docs_with = np.zeros(1 << BITS, dtype=np.int32)
    for low, high in zip(bound[:-1], bound[1:]):
        docs_with[np.unique(feature[low:high])] += 1
    frequent = docs_with >= MIN_DOCS
    frequent[0] = False
    kept = frequent[flat]
    sentence_of = sentence_of[kept]
    names = np.flatnonzero(frequent)
    column = (np.cumsum(frequent, dtype=np.int32) - 1)[flat[kept]]
    del flat, kept
    weights, bias = np.zeros(len(names)), -6.0
    moment, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    positive = label > 0
    own = min(max(positive.mean(), 1e-6), 1 - 1e-6)
    share = own if share is None else share
    heft = np.where(positive, share / own, (1 - share) / (1 - own)) / len(label)
    for step in range(1, rounds + 1):
        logit = np.bincount(sentence_of, weights[column], len(length)) + bias
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        amount = np.add.reduceat(np.logaddexp(0, logit), doc)
        slope = heft * np.where(positive, -1 / np.expm1(np.clip(amount, 1e-9, 700)), 1.0)
        push = chance * slope[doc_of_sentence]
        gradient = np.append(
            np.bincount(column, push[sentence_of], len(names)) + decay * weights, push.sum()
        )
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.2 * moment / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    full = np.zeros(1 << BITS, dtype=np.float32)
    full[names] = weights
    return ToxicityModel(full, float(bias))


def toxicity(model: ToxicityModel, text: Column, limit: float = 0.5) -> Column:
    """A struct of the noisy-or ``score`` over all sentences and the offending ``sentences``.

    The weights sent to the tasks have a fixed size of 2^BITS floats.
    """
    kind = "score double, sentences array<struct<start: int, end: int, score: double>>"

    @F.pandas_udf(kind)
    def scored(column: pd.Series) -> pd.DataFrame:
        texts = packed.encoded(column)
        scores, spans = [np.zeros(0)], []
        for low, high in packed.slices(texts):
            found = find_sentences(texts[low:high])
            logit = model.sentence_logits(found)
            amounts = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, logit))])
            amount = amounts[found.text[1:]] - amounts[found.text[:-1]]
            scores.append(np.clip(-np.expm1(-amount), 0, 1))
            chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            marked: list[list[dict]] = [[] for _ in range(high - low)]
            hits = np.flatnonzero(chance >= limit)
            of = np.searchsorted(found.text, hits, side="right") - 1
            for mine in np.unique(of).tolist():
                own = hits[slice(*np.searchsorted(of, [mine, mine + 1]))]
                edges = np.stack([found.start[own], found.end[own]], axis=1) - found.offset[mine]
                places = packed.code_points(texts[low + mine], edges.ravel().tolist())
                marked[mine] = [
                    {"start": start, "end": end, "score": score}
                    for start, end, score in zip(places[::2], places[1::2], chance[own].tolist())
                ]
            spans.extend(marked)
        return pd.DataFrame({"score": np.concatenate(scores), "sentences": spans})

    return scored(text)


def score_documents(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``score`` and the offending ``sentences`` of every row.

    ``score`` is 0 for null or empty texts and texts without words. ``sentences`` holds (start,
    end, score) of every sentence that is more likely toxic than not, in code points, end
    exclusive. A very long text is scored whole, in time in proportion to its length. Repeated rows
    are scored each; other columns are not returned. An empty table gives
    an empty result.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), toxicity(model, F.col(text_col)).alias("_found"))
    return found.select("doc_id", "_found.score", "_found.sentences")


def drop_toxic(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5
) -> DataFrame:
    """The rows whose score is below ``limit``, with all their columns."""
    return docs.where(toxicity(model, F.col(text_col))["score"] < limit)
