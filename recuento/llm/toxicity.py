"""Toxic spans and document scores by a linear-chain conditional random field.

The labels say which documents are toxic, not where. Features of words (the word
and its beginnings) that toxic documents hold far more often than others mark
tokens of toxic documents as toxic; the field learns these token labels together
with how they follow each other. Forward-backward marginals give each token its
probability, runs of likely tokens are the offending spans, and the document
score is a logistic function of the strongest and the expected number of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.llm.common import text_of

FIT_ROWS = 1500
"""At most so many toxic and so many other labelled documents are fitted on."""

FIT_CHARS = 20_000
"""Longer documents are not fitted on; they are scored whole like all others."""

FIT_SEQUENCES = 3000
"""At most so many token sequences with, and so many without, toxic tokens are fitted on, the first in the order of a hash of the documents' ids."""

SEQUENCE = 128
"""Tokens that are fitted on as one sequence, or worked on at a time; the tags of a text do not depend on it."""

EVIDENCE = 18.0
"""Least likelihood-ratio statistic of a feature that marks tokens as toxic."""

MEMO_WORDS = 500_000
BATCH_TOKENS = 400_000
WEAKEST, STRONGEST = -15.0, 15.0

_WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word in lower case and its beginnings."""
    word = word.lower()
    return ["=" + word[:40], *[word[:n] for n in (3, 4, 5, 6) if len(word) >= n]]


@dataclass(frozen=True)
class Field:
    """Weights of features, start and transition scores, and the document score's three weights."""

    weights: dict[str, float]
    start: float
    moves: tuple[tuple[float, float], tuple[float, float]]
    document: tuple[float, float, float]


def marginal_odds(odds: np.ndarray, valid: np.ndarray, start, moves, leave=1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward, backward and posterior odds of the toxic state.

    ``odds`` has e to the token's score, one column for a sequence and one row
    for a place; ``valid`` is false beyond a sequence's end. ``start`` is the
    score of beginning toxic and ``leave`` the backward odds of the last row, one
    for all sequences or one for each.
    """
    (t00, t01), (t10, t11) = np.exp(np.asarray(moves))
    steps, lanes = odds.shape
    forward, backward = np.empty((steps, lanes)), np.ones((steps, lanes))
    forward[0], backward[-1] = odds[0] * np.exp(start), leave
    for t in range(1, steps):
        before = forward[t - 1]
        forward[t] = odds[t] * (t01 + before * t11) / (t00 + before * t10)
    for t in range(steps - 2, -1, -1):
        ahead = odds[t + 1] * backward[t + 1]
        backward[t] = np.where(valid[t + 1], (t10 + t11 * ahead) / (t00 + t01 * ahead), 1.0)
    return forward, backward, np.where(valid, forward * backward, 0.0)


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts one after another: the column of each text's first sequence, and the number of columns so far."""
    columns = -(-lengths // SEQUENCE)
    ends = np.cumsum(columns)
    return ends - columns, ends


def _spread(values: np.ndarray, lengths: np.ndarray, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token values as rows of sequences, the flat place of each token, and which places hold one."""
    first, ends = _lanes(lengths)
    place = np.arange(len(values)) + np.repeat(first * SEQUENCE - (np.cumsum(lengths) - lengths), lengths)
    flat = np.full(int(ends[-1]) * SEQUENCE if len(ends) else 0, fill)
    flat[place] = values
    valid = np.zeros(len(flat), bool)
    valid[place] = True
    return flat.reshape(-1, SEQUENCE).T, place, valid.reshape(-1, SEQUENCE).T


def _chained(odds: np.ndarray, valid: np.ndarray, first: np.ndarray, start: float, moves) -> tuple[np.ndarray, np.ndarray]:
    """``start`` and ``leave`` of each sequence where texts are several sequences in a row, as if each text were one.

    ``first`` marks a text's first sequence. The steps of a sequence after its
    first token are one product of 2 by 2 matrices, so the odds before and after
    it follow from those of its neighbours without going through its tokens.
    """
    lanes = len(first)
    starts, leaves = np.full(lanes, float(start)), np.ones(lanes)
    more = np.append(~first[1:], False)
    chained = np.flatnonzero(more | ~first)
    if not len(chained):
        return starts, leaves
    (t00, t01), (t10, t11) = np.exp(np.asarray(moves)).tolist()
    own, here = odds[:, chained], valid[:, chained]
    p = np.repeat(np.eye(2).reshape(4, 1), len(chained), axis=1)
    for t in range(1, len(own)):
        moved = np.stack([p[0] * t00 + p[1] * t10, (p[0] * t01 + p[1] * t11) * own[t], p[2] * t00 + p[3] * t10, (p[2] * t01 + p[3] * t11) * own[t]])
        p = np.where(here[t], moved / moved.max(axis=0), p)
    heads, steps = own[0].tolist(), list(zip(chained.tolist(), *p.tolist()))
    reach = 0.0
    for (lane, p00, p01, p10, p11), head in zip(steps, heads):
        x = head * (math.exp(start) if first[lane] else reach)
        if not first[lane]:
            starts[lane] = math.log(reach)
        off, on = p00 + x * p10, p01 + x * p11
        reach = (off * t01 + on * t11) / (off * t00 + on * t10)
    ahead = 0.0
    for (lane, p00, p01, p10, p11), head in zip(reversed(steps), reversed(heads)):
        off, on = (t00 + t01 * ahead, t10 + t11 * ahead) if more[lane] else (1.0, 1.0)
        leaves[lane] = on / off
        ahead = head * (p10 * off + p11 * on) / (p00 * off + p01 * on)
    return starts, leaves


class WordScores(dict):
    """The score of a word, e to the power of it, worked out on first use."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        score = sum(self.weights.get(f, 0.0) for f in features(word))
        value = self[word] = math.exp(min(max(score, -30.0), 30.0))
        return value


def tag(texts: list[str], field: Field, words: WordScores) -> Iterator[np.ndarray]:
    """Each text's probabilities of being toxic, token by token, as odds; a text is one chain, however long."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        lengths = np.array([len(a) for a in held], dtype=np.int64)
        if not lengths.sum():
            yield from held
            return
        rows, place, valid = _spread(np.concatenate(held), lengths, 0.0)
        first = np.zeros(rows.shape[1], bool)
        first[_lanes(lengths)[0][lengths > 0]] = True
        start, leave = _chained(rows, valid, first, field.start, field.moves)
        posterior = marginal_odds(rows, valid, start, field.moves, leave)[2].T.reshape(-1)[place]
        yield from np.split(posterior, np.cumsum(lengths)[:-1])

    for text in texts:
        tokens = _WORDS.findall(text)
        held.append(np.fromiter(map(words.__getitem__, tokens), float, len(tokens)))
        size += len(tokens)
        if size >= BATCH_TOKENS:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def evidence(odds: np.ndarray) -> tuple[float, float]:
    """The strongest token as a log odds within fixed limits, and log(1 + expected toxic tokens)."""
    if not len(odds):
        return WEAKEST, 0.0
    best = float(odds.max())
    strongest = math.log(best) if best > 0 else WEAKEST
    expected = float((odds / (1.0 + np.minimum(odds, 1e15))).clip(0, 1).sum())
    return min(max(strongest, WEAKEST), STRONGEST), math.log1p(expected)


def document_score(field: Field, odds: np.ndarray) -> float:
    strongest, expected = evidence(odds)
    a, b, c = field.document
    return 1.0 / (1.0 + math.exp(-min(max(a + b * strongest + c * expected, -40.0), 40.0)))


def _toxic_features(documents: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that documents labelled toxic hold far more often than chance allows.

    A feature counts once per document and, among toxic ones, at most once per
    pair of neighbouring words, so that copies of a document add nothing.
    """
    held, others, places, seen = Counter(), Counter(), Counter(), set()
    for words, label in zip(documents, toxic):
        if label:
            held.update({f for w in set(words) for f in features(w)})
            for around in zip(["", *words], words, [*words[1:], ""]):
                if (key := hash(around)) not in seen:
                    seen.add(key)
                    places.update(features(around[1]))
    del seen
    for words, label in zip(documents, toxic):
        if not label:
            others.update({f for w in set(words) for f in features(w) if f in held})
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    base = n1 / (n0 + n1)
    marked = set()
    for feature, a in held.items():
        a, b = min(a, places[feature]), others[feature]
        rate = a / (a + b)
        if rate <= 0.9 + 0.1 * base:
            continue
        gain = a * math.log(rate / base) + (b * math.log((1 - rate) / (1 - base)) if b else 0.0)
        if 2 * gain >= EVIDENCE:
            marked.add(feature)
    return marked


def _fit_field(ids: np.ndarray, y: np.ndarray, valid: np.ndarray, size: int, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum penalised likelihood by Adam; ``ids[k, t, lane]`` are features of a token, 0 for none."""
    weights, start, moves = np.zeros(size), 0.0, np.zeros((2, 2))
    tokens = valid.sum()
    seen = np.array([[(valid[1:] & (y[:-1] == i) & (y[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    first, second = np.zeros(size + 5), np.zeros(size + 5)
    flat_ids = ids.reshape(len(ids), -1)
    for step in range(1, rounds + 1):
        score = sum(weights[place] for place in ids)
        odds = np.where(valid, np.exp(np.clip(score, -30, 30)), 0.0)
        forward, backward, posterior = marginal_odds(odds, valid, start, moves)
        p = posterior / (1.0 + posterior)
        miss = np.where(valid, y - p, 0.0).reshape(-1)
        slope = sum(np.bincount(place, miss, size) for place in flat_ids)
        slope[0] = 0.0
        t = np.exp(moves)
        ahead = odds[1:] * backward[1:]
        pair = np.stack([t[0, 0] * np.ones_like(ahead), t[0, 1] * ahead, forward[:-1] * t[1, 0], forward[:-1] * t[1, 1] * ahead])
        pair = np.where(valid[1:], pair / pair.sum(0), 0.0).reshape(4, -1).sum(1).reshape(2, 2)
        both = np.concatenate([slope - 0.02 * weights, [(y[0] - p[0])[valid[0]].sum()], (seen - pair).reshape(-1) - 0.02 * moves.reshape(-1)])
        both /= max(tokens, 1)
        first = 0.9 * first + 0.1 * both
        second = 0.99 * second + 0.01 * both**2
        change = 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        weights = weights + change[:size]
        start += change[size]
        moves = moves + change[size + 1 :].reshape(2, 2)
    return weights, start, moves


def _fit_document(evidences: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Logistic regression of the label by Newton steps, its intercept moved to the share of toxic documents."""
    x = np.column_stack([np.ones(len(toxic)), evidences])
    w = np.zeros(3)
    penalty = np.diag([1e-3, 1e-2, 1e-2]) * len(toxic) / 100
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (toxic - p) - penalty @ w)
    share = toxic.mean()
    w[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return tuple(map(float, w))


def fit_field(texts: list[str], toxic: list[int], prior: float) -> Field:
    """The field for labelled texts; ``prior`` is the share of toxic ones among all labelled.

    Without texts of both kinds every score is the prior.
    """
    flat = ((0.0, 0.0), (0.0, 0.0))
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if len(set(toxic)) < 2:
        return Field({}, -10.0, flat, (math.log(prior / (1 - prior)), 0.0, 0.0))
    one_of_each: dict[str, str] = {}
    documents = [[one_of_each.setdefault(w, w) for w in _WORDS.findall(t)] for t in texts]
    marked = _toxic_features(documents, toxic)
    with_toxic, without = [], []
    for words, label in zip(documents, toxic):
        for at in range(0, len(words), SEQUENCE):
            part = words[at : at + SEQUENCE]
            labels = [int(bool(label) and not marked.isdisjoint(features(w))) for w in part]
            group = with_toxic if any(labels) else without
            if len(group) < FIT_SEQUENCES:
                group.append((part, labels))
    del documents, one_of_each
    sequences = with_toxic + without
    number: dict[str, int] = {}
    places = 1 + len((3, 4, 5, 6))
    ids = np.zeros((places, SEQUENCE, len(sequences)), np.int32)
    y, valid = np.zeros((SEQUENCE, len(sequences))), np.zeros((SEQUENCE, len(sequences)), bool)
    for lane, (part, labels) in enumerate(sequences):
        y[: len(part), lane], valid[: len(part), lane] = labels, True
        for t, word in enumerate(part):
            for k, feature in enumerate(features(word)):
                ids[k, t, lane] = number.setdefault(feature, len(number) + 1)
    weights, start, moves = _fit_field(ids, y, valid, len(number) + 1)
    kept = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-2}
    bare = Field(kept, float(start), tuple(map(tuple, moves.tolist())), (0.0, 1.0, 0.0))
    evidences = np.array([evidence(odds) for odds in tag(texts, bare, WordScores(kept))])
    return Field(kept, bare.start, bare.moves, _fit_document(evidences, np.array(toxic, float), prior))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
) -> Field:
    """Fit the field on labelled documents outside the held-out fold.

    The fold of a document is crc32 of its ``doc_id`` as text modulo ``folds``;
    fold 0 is never learned from. At most ``fit_rows`` documents of each label,
    none over ``fit_chars`` characters, in the order of a hash of ``doc_id``,
    reach the driver: that bounds what it holds. Rows with a NULL in the label
    or ``doc_id`` are passed over; a document labelled more than once counts as
    toxic if any label says so.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .where(F.crc32(F.col(doc_id).cast("string")) % folds != 0)
        .groupBy(F.col(doc_id).alias("__id"))
        .agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("__toxic"))
    )
    rows = docs.select(F.col(doc_id).alias("__id"), text_of(text).alias("__text"))
    short = rows.where(F.length("__text") <= fit_chars).select("__id").distinct()
    usable = known.join(short, "__id", "left_semi")
    order = F.xxhash64("__id")
    picked = usable.where("__toxic = 1").orderBy(order, "__id").limit(fit_rows)
    picked = picked.unionByName(usable.where("__toxic = 0").orderBy(order, "__id").limit(fit_rows))
    sample = rows.join(F.broadcast(picked), "__id").where(F.length("__text") <= fit_chars)
    sample = sample.groupBy("__id").agg(F.min("__text").alias("__text"), F.min("__toxic").alias("__toxic"))
    share = known.agg(F.avg("__toxic").alias("share")).first()["share"]
    found = sample.withColumn("__order", order).collect()
    found.sort(key=lambda r: (r["__order"], r["__id"]))
    return fit_field([r["__text"] for r in found], [r["__toxic"] for r in found], share or 0.0)


SCORED = "struct<score:double,predicted:int,spans:array<struct<start:int,end:int,probability:double>>>"


def scorer(spark: SparkSession, field: Field) -> Callable[[Column], Column]:
    """A function of a text column that gives ``score, predicted, spans``."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        words = WordScores(model.weights)
        for batch in batches:
            texts = batch.tolist()
            scores, spans = [], []
            for text, odds in zip(texts, tag(texts, model, words)):
                scores.append(document_score(model, odds))
                spans.append(_spans(text, odds))
            yield pd.DataFrame({"score": scores, "predicted": [int(s >= 0.5) for s in scores], "spans": spans})

    return scored


def score(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted, spans`` for each whole text, one row for each row in.

    ``score`` is between 0 and 1, ``predicted`` is 1 from 0.5 upwards, ``spans``
    lists start, end (characters, end exclusive) and probability of the runs of
    tokens more likely toxic than not. NULL and empty texts have no token and
    get the score of a document without evidence. Nothing but the text is used.
    """
    scored = scorer(docs.sparkSession, field)(text_of(text)).alias("s")
    return docs.select(F.col(doc_id).alias("doc_id"), scored).select("doc_id", "s.*")


def without_toxic(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` whose text is not predicted toxic; see ``score``."""
    return docs.where(scorer(docs.sparkSession, field)(text_of(text))["predicted"] == 0)


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    if not len(odds) or odds.max() < 1.0:
        return []
    out: list[dict] = []
    last = -2
    for i, match in enumerate(_WORDS.finditer(text)):
        if odds[i] >= 1.0:
            p = 1.0 - 1.0 / (1.0 + float(odds[i]))
            if last == i - 1:
                out[-1] |= {"end": match.end(), "probability": max(p, out[-1]["probability"])}
            else:
                out.append({"start": match.start(), "end": match.end(), "probability": p})
            last = i
    return out
