"""Toxic spans by a linear-chain conditional random field.

Every word of a text is in one of two states, clean or toxic. Word and prefix weights give the score of a state,
four weights the score of a change of state. Labels of texts become labels of tokens through an association test;
the field is fitted to them by maximum likelihood. The forward-backward marginals of a text give its spans, with
their offsets, and its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import extended, prepare

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Bounds of the labelled sample: toxic texts, clean texts, and characters of a text that may be drawn.
TOXIC_TEXTS, CLEAN_TEXTS, SAMPLE_CHARS = 1500, 6000, 6_000
#: Words of a training sequence, and the share of sequences kept that have no word like a toxic one: one in so many.
SEQUENCE, SPARE = 30, 10
#: A feature marks toxic tokens from this log-likelihood ratio and this share of toxic texts on.
ASSOCIATION, PURITY = 30.0, 0.98
#: Texts that a feature must occur in to get a weight.
FEATURE_TEXTS = 4
ROUNDS, RATE, PENALTY = 50, 0.5, 3e-4
#: Tokens whose marginals are computed at once; the blocks of a longer text hand their vectors on.
BLOCK_TOKENS = 100_000
REMEMBERED = 200_000


def features(word: str) -> list[str]:
    """The word and its proper prefixes; a prefix ends in a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def _scan(first: np.ndarray, change: np.ndarray, state: np.ndarray, starts: np.ndarray, before: tuple[float, float] = (0.5, 0.5)) -> np.ndarray:
    """Normalised forward vectors (n, 2) of chains laid end to end; ``before`` is the one before the first position, if that starts no chain.

    ``state`` (n, 2) are the state factors, ``change`` (2, 2) the change factors and ``first`` (2) those of a chain's
    first state; ``starts`` marks the first positions. The positions are cut into about sqrt(n) blocks: products of
    the step matrices within all blocks at once, then one pass over the blocks.
    """
    n = len(state)
    length = max(1, math.isqrt(n))
    blocks = -(-n // length)
    # The four entries of the step matrices; positions beyond the end change nothing.
    step = np.zeros((2, 2, blocks * length))
    step[0, 0, n:] = step[1, 1, n:] = 1
    for i in range(2):
        for j in range(2):
            step[i, j, :n] = np.where(starts, first[j], change[i, j]) * state[:, j]
    step = np.ascontiguousarray(step.reshape(2, 2, blocks, length).transpose(3, 0, 1, 2))
    products = np.empty_like(step)
    running = np.zeros((2, 2, blocks))
    running[0, 0] = running[1, 1] = 1
    for at in range(length):
        m = step[at]
        running = running[:, 0, None] * m[None, 0] + running[:, 1, None] * m[None, 1]
        running /= running.max(axis=(0, 1))
        products[at] = running
    entry, (u, v) = np.empty((2, blocks)), before
    for k, ((a, b), (c, d)) in enumerate(products[-1].transpose(2, 0, 1).tolist()):
        entry[:, k] = u, v
        u, v = u * a + v * c, u * b + v * d
        u, v = u / (u + v), v / (u + v)
    forward = entry[0] * products[:, 0] + entry[1] * products[:, 1]
    forward = forward.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return forward / forward.sum(axis=1, keepdims=True)


def _states(score: np.ndarray) -> np.ndarray:
    half = np.clip(score, -60, 60) / 2
    return np.exp(np.stack([-half, half], axis=1))


def chained_marginals(score: np.ndarray, change: np.ndarray, block: int) -> np.ndarray:
    """Marginals of the toxic state of one chain of any length, worked on in blocks.

    The forward vector at each block's end is handed to the next block, the backward vector at its begin to the one
    before: the same marginals as in one piece, with the memory of a block.
    """
    factors, ones = np.exp(change), np.ones(2)
    begins = range(0, len(score), block)
    entries: list[np.ndarray] = [np.array([0.5, 0.5])]
    for begin in begins:
        state = _states(score[begin : begin + block])
        starts = np.zeros(len(state), bool)
        starts[0] = not begin
        entries.append(_scan(ones, factors, state, starts, tuple(entries[-1]))[-1])
    marginal, following = np.empty(len(score)), None
    for begin, entry in zip(reversed(begins), reversed(entries[:-1])):
        state = _states(score[begin : begin + block])
        starts, ends = np.zeros(len(state), bool), np.zeros(len(state), bool)
        starts[0], ends[0] = not begin, following is None
        alpha = _scan(ones, factors, state, starts, tuple(entry))
        beta = _scan(ones, factors.T, state[::-1], ends, (0.5, 0.5) if following is None else tuple(following))[::-1]
        message = np.ones_like(beta)
        message[:-1] = beta[1:] @ factors.T
        if following is not None:
            message[-1] = factors @ following
        both = alpha * message
        marginal[begin : begin + block] = both[:, 1] / both.sum(axis=1)
        following = beta[0]
    return marginal


def forward_backward(score: np.ndarray, change: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state (n), and the expected number of each change of state (2, 2)."""
    if not len(score):
        return np.zeros(0), np.zeros((2, 2))
    state = _states(score)
    factors = np.exp(change)
    ones = np.ones(2)
    alpha = _scan(ones, factors, state, starts)
    # The backward vectors without their own state are the forward vectors of the reversed chains, one step earlier.
    ends = np.append(starts[1:], True)
    beta = _scan(ones, factors.T, state[::-1], ends[::-1])[::-1]
    message = np.ones_like(beta)
    inner = np.flatnonzero(~starts)
    follow = beta[inner]
    for i in range(2):
        message[inner - 1, i] = follow[:, 0] * factors[i, 0] + follow[:, 1] * factors[i, 1]
    marginal = alpha * message
    marginal = marginal[:, 1] / marginal.sum(axis=1)
    before, after = alpha[inner - 1], (state * message)[inner]
    pairs = np.stack([before[:, i] * factors[i, j] * after[:, j] for i in range(2) for j in range(2)])
    return marginal, (pairs / pairs.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass(frozen=True)
class Field:
    """Weights of features, the bias of the toxic state and the 2 x 2 weights of changes. Size bounded by the sample."""

    weights: dict[str, float]
    bias: float
    change: np.ndarray

    def word_score(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def token_labels(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that mark toxic tokens: strongly and almost only found in toxic texts."""
    n = [toxic.count(0), toxic.count(1)]
    seen = (Counter(), Counter())
    for words, y in zip(texts, toxic):
        seen[y].update({f for w in set(words) for f in features(w)})

    def ratio(t: int, c: int) -> float:
        rate = (t + c) / (n[0] + n[1])
        terms = ((t, n[1] * rate), (c, n[0] * rate), (n[1] - t, n[1] * (1 - rate)), (n[0] - c, n[0] * (1 - rate)))
        return 2 * sum(x * math.log(x / e) for x, e in terms if x > 0 and e > 0)

    def marks(f: str, t: int) -> bool:
        c = seen[0][f]
        # Shares as if both labels had as many texts.
        return t / n[1] >= PURITY * (t / n[1] + c / max(n[0], 1)) and ratio(t, c) >= ASSOCIATION

    return {f for f, t in seen[1].items() if marks(f, t)}


def fit(texts: list[str], toxic: list[int]) -> Field:
    """The field of highest penalised likelihood for texts labelled 0 or 1; equal texts count once.

    Without texts of both labels every token is clean.
    """
    pairs = sorted(set(zip(texts, toxic)))
    words = [WORD.findall(t.lower()) for t, _ in pairs]
    toxic = [y for _, y in pairs]
    if len(set(toxic)) < 2:
        return Field({}, -8.0, np.zeros((2, 2)))
    marked = token_labels(words, toxic)
    # Clean words that begin like toxic ones are what the field must learn to tell apart.
    stems = {f[: PREFIXES[0]] for f in marked}
    pieces = [(ws[i : i + SEQUENCE], y) for ws, y in zip(words, toxic) for i in range(0, len(ws), SEQUENCE)]
    pieces = [
        (ws, y) for ws, y in pieces if any(w[: PREFIXES[0]] in stems for w in ws) or crc32(" ".join(ws).encode()) % SPARE == 0
    ]
    words, toxic = [ws for ws, _ in pieces], [y for _, y in pieces]
    if not words:
        return Field({}, -8.0, np.zeros((2, 2)))
    found = Counter(f for w in words for f in {f for x in set(w) for f in features(x)})
    index = {f: i for i, f in enumerate(sorted(f for f, k in found.items() if k >= FEATURE_TEXTS))}
    # Words as rows of feature numbers, tokens as numbers of words; the last feature stands for none.
    none, columns = len(index), 1 + len(PREFIXES)
    distinct = sorted({x for ws in words for x in ws})
    number = {w: i for i, w in enumerate(distinct)}
    known = [[index[f] for f in features(w) if f in index] for w in distinct]
    active = np.array([k + [none] * (columns - len(k)) for k in known], np.int32).reshape(-1, columns)
    marks = np.array([any(f in marked for f in features(w)) for w in distinct], bool)
    tokens = np.array([number[w] for ws in words for w in ws], np.int64)
    y = marks[tokens] & np.repeat(np.array(toxic, bool), [len(ws) for ws in words])
    starts = np.zeros(len(tokens), bool)
    lengths = np.array([len(ws) for ws in words if ws])
    starts[np.cumsum(lengths) - lengths] = True
    inner = ~starts[1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
    w, change = np.zeros(none + 2), np.zeros((2, 2))  # features, none, bias
    moments = [np.zeros(none + 6), np.zeros(none + 6)]
    for step in range(1, ROUNDS + 1):
        marginal, pair = forward_backward((w[active].sum(axis=1) + w[-1])[tokens], change, starts)
        error = np.bincount(tokens, y - marginal, len(distinct))
        slope = np.bincount(active.ravel(), np.repeat(error, columns), none + 2)
        slope[none], slope[-1] = 0, error.sum()
        slope = np.concatenate([slope / len(words) - PENALTY * w, ((seen - pair) / len(words)).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6)
        w += move[:-4]
        change = change + move[-4:].reshape(2, 2)
    return Field({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(w[-1]), change)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_TEXTS, clean: int = CLEAN_TEXTS) -> tuple[list[str], list[int]]:
    """About ``toxic`` and ``clean`` texts of the two labels at most, drawn by a hash of the text; (texts, labels).

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Rows with nulls, texts of more than SAMPLE_CHARS
    characters and labels other than 0 and 1 are not drawn; contradicting labels both count.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = [min(1.0, wanted / counts.get(y, 1)) for y, wanted in ((0, clean), (1, toxic))]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # What neither label can draw is left out before the join.
    rows = docs.select("doc_id", "text", draw.alias("draw")).filter((F.length("text") <= SAMPLE_CHARS) & (F.col("draw") < max(shares)))
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    drawn = rows.join(known, "doc_id").filter(F.col("draw") < share).select("text", "toxic").distinct().collect()
    return [r["text"] for r in drawn], [r["toxic"] for r in drawn]


class Tagger:
    """Marginals of texts, with remembered word scores."""

    def __init__(self, field: Field):
        self.field, self.seen = field, {}

    def scores(self, words: list[str]) -> list[float]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = self.field.word_score(w)
        return list(map(self.seen.__getitem__, words))

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """Toxic marginals of every word of every text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        held: list[tuple[int, int]] = []
        scores: list[float] = []

        def settle():
            sizes = np.array([n for _, n in held])
            starts = np.zeros(len(scores), bool)
            starts[np.cumsum(sizes) - sizes] = True
            marginal, _ = forward_backward(np.array(scores), self.field.change, starts)
            for (i, _), part in zip(held, np.split(marginal, np.cumsum(sizes)[:-1])):
                out[i] = part
            held.clear()
            scores.clear()

        for i, text in enumerate(texts):
            own = self.scores(WORD.findall(text.lower()))
            if len(own) > BLOCK_TOKENS:
                out[i] = chained_marginals(np.array(own), self.field.change, BLOCK_TOKENS)
            elif own:
                held.append((i, len(own)))
                scores += own
            if len(scores) > BLOCK_TOKENS:
                settle()
        if held:
            settle()
        return out


def spans(text: str, marginal: np.ndarray, threshold: float = 0.5) -> list[dict]:
    """Runs of words with marginals of ``threshold`` or more: character offsets and the highest marginal."""
    lowered = text.lower()
    # Lower-casing may change the length of a text; then the offsets are those of the lower-cased text.
    places = [m.span() for m in WORD.finditer(lowered)]
    found, last = [], -2
    for i in np.flatnonzero(marginal >= threshold).tolist():
        if i == last + 1:
            found[-1] |= {"end": places[i][1], "score": max(found[-1]["score"], float(marginal[i]))}
        else:
            found.append({"start": places[i][0], "end": places[i][1], "score": float(marginal[i])})
        last = i
    return found


def tag(docs: DataFrame, field: Field, text: str, *keep: Column) -> DataFrame:
    """The columns ``keep``, score, predicted and spans, row by row over whole texts.

    score is the highest marginal of a word, 0 for texts without words (null and empty ones too); predicted is 1 from
    a score of 0.5 on. Repeated rows are scored alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_tagged"))
    schema = extended(rows.drop("_tagged").schema, "score double, predicted int, spans array<struct<start: int, end: int, score: double>>")
    shared = spark.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def apply(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = part.column(part.num_columns - 1).to_pylist()
                marginals = tagger.marginals(texts)
                score = [float(m.max()) if len(m) else 0.0 for m in marginals]
                found = [spans(t, m) if s >= 0.5 else [] for t, m, s in zip(texts, marginals, score)]
                predicted = pa.array([int(s >= 0.5) for s in score], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), predicted, pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(apply, schema)
