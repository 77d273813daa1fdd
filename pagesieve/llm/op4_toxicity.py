"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import fresh, query, stored, table

# Bounds on what training looks at: labelled documents, features by rank, sentences.
TRAIN_DOCS, FEATURES, SENTENCES = 30_000, 600, 10_000
TOKEN = re.compile(r"[^\W\d_]+")
# A sentence is a run without end of line or of sentence; each is one chain.
SENTENCE = re.compile(r"[^.!?\n]+")
CELLS = 2_000_000  # tokens, with padding, of the chains that are run side by side
PREFIXES = range(3, 9)
REMEMBER = 100_000  # words whose features a worker keeps in mind


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


class _Memo(dict):
    """Kinds of the words met last."""

    def __init__(self, model: Crf):
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        k = self[word] = self.model.kind(word)
        return k


@dataclass
class Crf:
    """Two tags (0 clean, 1 toxic). A token's weight is that of its known features and of feature 0, which all have."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: tuple[float, ...] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        if len(self.emit) <= len(self.index):
            self.emit = np.zeros((len(self.index) + 1, 2))
        self.kinds: dict[tuple[int, ...], int] = {(): 0}
        self.memo = _Memo(self)
        self.begin = {f[:4] for f in self.index if f[0] == "^"}
        self.weights = [self.emit[0]]

    def kind(self, word: str) -> int:
        """Number of the token's set of known features; 0 is the empty set."""
        known: tuple[int, ...] = ()
        if "=" + word in self.index or "^" + word[:3] in self.begin:
            known = tuple(self.index[f] for f in features_of(word) if f in self.index)
        k = self.kinds.get(known)
        if k is None:
            k = self.kinds[known] = len(self.kinds)
            self.weights.append(self.emit[[0, *known]].sum(axis=0))
        return k

    def chain(self, words: list[str]) -> list[int]:
        memo = self.memo
        return [memo[w] for w in words]

    def __getstate__(self):
        return self.index, self.emit, self.step, self.scale

    def __setstate__(self, state):
        self.index, self.emit, self.step, self.scale = state
        self.__post_init__()

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """P(tag of token = toxic) for every token of every chain of kinds, by forward-backward."""
        emit = np.array(self.weights)
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        out: list = [np.empty(0)] * len(chains)
        for part in _side_by_side([i for i in order if len(chains[i])], chains):
            for i, p in zip(part, _marginals([chains[i] for i in part], emit, self.step)[0]):
                out[i] = p
        return out


def _side_by_side(order: list[int], chains: list[np.ndarray]) -> Iterator[list[int]]:
    """Chains, longest first, in parts that stay below ``CELLS`` when padded; a longer chain is a part of its own."""
    start = 0
    while start < len(order):
        n = max(1, min(1024, CELLS // max(1, len(chains[order[start]]))))
        yield order[start : start + n]
        start += n


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    x = np.zeros((lengths.max(), len(chains)), dtype=np.int64)
    for i, c in enumerate(chains):
        x[: len(c), i] = c
    return x, lengths


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


def _marginals(chains: list[np.ndarray], emit: np.ndarray, step: np.ndarray):
    """Chains in order of falling length to (marginals, log Z of each, expected tag pairs)."""
    x, lengths = _padded(chains)
    top, n = x.shape
    e = emit[x]
    fwd, bwd = np.zeros((top, n, 2)), np.zeros((top, n, 2))
    active = np.searchsorted(-lengths, -np.arange(1, top + 1), side="right")  # chains with more than t tokens
    fwd[0] = e[0]
    for t in range(1, top):
        m = active[t]
        fwd[t, :m] = e[t, :m] + _logsum(fwd[t - 1, :m, :, None] + step, 1)
    for t in range(top - 2, -1, -1):
        m = active[t + 1]
        bwd[t, :m] = _logsum(step + (e[t + 1, :m] + bwd[t + 1, :m])[:, None, :], 2)
    last = fwd[lengths - 1, np.arange(n)]
    log_z = _logsum(last, 1)
    p = np.exp(fwd[..., 1] + bwd[..., 1] - log_z)
    pairs = np.zeros((2, 2))
    for t in range(1, top):
        m = active[t]
        pairs += np.exp(fwd[t - 1, :m, :, None] + step + (e[t, :m] + bwd[t, :m])[:, None, :] - log_z[:m, None, None]).sum(axis=0)
    return [p[: lengths[i], i] for i in range(n)], log_z, pairs


def _fit_words(hits: list[list[int]], toxic: np.ndarray, n: int, rounds: int = 150, ridge: float = 0.3) -> np.ndarray:
    """Ridge logistic regression of the document label on which features occur, by gradient steps of adaptive size."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.concatenate([np.asarray(h, dtype=np.int64) for h in hits]) if len(rows) else np.empty(0, dtype=np.int64)
    y = toxic.astype(float)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, seen = np.zeros(n + 1), np.zeros(n + 1)
    for _ in range(rounds):
        at = w[0] + np.bincount(rows, weights=w[cols], minlength=len(hits))
        off = balance * (1 / (1 + np.exp(-np.clip(at, -30, 30))) - y)
        g = np.bincount(cols, weights=off[rows], minlength=n + 1) + ridge * w
        g[0] = off.sum()
        seen += g**2
        w -= 0.3 * g / np.sqrt(seen + 1e-6)
    return w


def _fit_crf(chains: list[np.ndarray], tags: list[np.ndarray], of_kind: np.ndarray, rounds: int = 60, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Feature and step weights that maximise the tags' conditional likelihood, by ascent in steps of adaptive size.

    ``of_kind`` tells which features each kind of token has. Only tags' differences matter,
    so tag 0 keeps the weight 0.
    """
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    chains, tags = [chains[i] for i in order], [tags[i] for i in order]
    parts = [[chains[i] for i in part] for part in _side_by_side(list(range(len(chains))), chains)]
    kinds, n = of_kind.shape
    had = np.bincount(np.concatenate(chains), weights=np.concatenate(tags), minlength=kinds)
    had_s = np.zeros((2, 2))
    for t in tags:
        np.add.at(had_s, (t[:-1], t[1:]), 1)
    emit, step = np.zeros((n, 2)), np.zeros((2, 2))
    rate = had.sum() / max(1, sum(map(len, chains)))
    emit[0, 1] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    seen_e, seen_s = np.zeros(n), np.zeros((2, 2))
    for _ in range(rounds):
        want, want_s = np.zeros(kinds), np.zeros((2, 2))
        weights = of_kind @ emit
        for part in parts:
            p, _z, pairs = _marginals(part, weights, step)
            want += np.bincount(np.concatenate(part), weights=np.concatenate(p), minlength=kinds)
            want_s += pairs
        ge, gs = of_kind.T @ (had - want) - ridge * emit[:, 1] * (np.arange(n) > 0), had_s - want_s - ridge * step
        seen_e += ge**2
        seen_s += gs**2
        emit[:, 1] += 0.7 * ge / np.sqrt(seen_e + 1e-6)
        step += 0.3 * gs / np.sqrt(seen_s + 1e-6)
    return emit, step


def _words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is a multiple of 5. A NULL id is not one, nor is it labelled."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, features: int = FEATURES, sentences: int = SENTENCES) -> Crf:
    """Fit the model on at most ``train_docs`` labelled documents outside the held-out fold, picked by a hash of the id.

    1. Words and beginnings of words are ranked by how much more often they stand in toxic
       documents (z of two proportions, each distinct text once), and the first ``features``
       stay; so do as many words that share such a beginning and stand in clean documents.
    2. A ridge regression of the document label on these features explains away those that
       only accompany toxic words. Tokens whose features' weights sum up high are labelled
       toxic where they stand in toxic documents: these are the labelled tokens.
    3. The random field learns the tags of at most ``sentences`` sentences of these
       documents; a logistic curve on what its marginals sum up to is fitted to the labels.

    Without a labelled document of each class the model scores every text 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("labelled"), "labelled", "toxic").limit(train_docs)
    # At most ``train_docs`` ids and labels: small whatever the corpus.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("toxic", "text")
    sample = stored(sample.dropDuplicates(["toxic", "text"]), "labelled")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = [(w, y) for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for w in {f for v in {*_words(t)} for f in features_of(v)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["word", "toxic"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().where("toxic IN (0, 1)").collect()}
    if len(n) < 2:
        return Crf()
    seen = sample.mapInArrow(occurrences, "word string, toxic int").groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    share = (F.col("t") + F.col("c")) / float(n[0] + n[1])
    z = (F.col("t") / float(n[1]) - F.col("c") / float(n[0])) / F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    seen = stored(seen.where("t + c >= 3").select("word", "c", z.alias("z")), "features")
    top = [r["word"] for r in seen.where("z >= 3").orderBy(F.desc("z"), "word").limit(features).collect()]
    if not top:
        return Crf()
    begins = [w[1:] for w in top if w[0] == "^"]
    like = F.lit(False)
    for k in PREFIXES:
        like = like | F.substring("word", 2, k).isin([w for w in begins if len(w) == k])
    rest = seen.where(F.col("word").startswith("=") & like & (F.col("c") >= 3)).orderBy(F.desc("c"), "word").limit(features).collect()
    index = {w: i + 1 for i, w in enumerate(dict.fromkeys([*top, *(r["word"] for r in rest)]))}
    model = Crf(index)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(index)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                chains = [c for c in sentences_of(text, own) if c.any()]
                tokens = np.concatenate(chains) if chains else np.empty(0, dtype=np.int64)
                met, number = np.unique(tokens, return_inverse=True)
                sets = list(own.kinds)
                rows.append((number.astype(np.int32), [len(c) for c in chains], [sets[k] for k in met.tolist()]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int32())))], ["toxic", "h", "tokens", "lengths", "sets"])

    # A number a token of the sentences with a feature word, and the sets of features once a document.
    told = sample.select("toxic", "text", F.xxhash64("text").alias("h"))
    found = told.mapInArrow(cut, "toxic int, h long, tokens array<int>, lengths array<int>, sets array<array<int>>").toArrow()  # bounded by train_docs
    found = found.sort_by([("h", "ascending"), ("toxic", "ascending")])
    toxic = found.column("toxic").to_numpy()
    kinds: dict[tuple, int] = {(): 0}
    docs_ = []
    for batch in found.select(["tokens", "lengths", "sets"]).to_batches(max_chunksize=1000):
        for tokens, lengths, sets in zip(*batch.columns):
            ours = np.array([kinds.setdefault(tuple(t), len(kinds)) for t in sets.as_py()], dtype=np.int32)
            docs_.append(np.split(ours[tokens.values.to_numpy()], np.cumsum(lengths.values.to_numpy())[:-1]) if len(ours) else [])
    of_kind = np.zeros((len(kinds), len(index) + 1))
    of_kind[:, 0] = 1
    for t, k in kinds.items():
        of_kind[k, list(t)] = 1
    features_in = [np.flatnonzero(row) for row in of_kind]
    features_in = [f[f > 0] for f in features_in]
    weight = _fit_words([np.unique(np.concatenate([features_in[k] for k in np.unique(np.concatenate(doc))])) if doc else [] for doc in docs_], toxic, len(index))
    total = of_kind[:, 1:] @ weight[1:]
    bad = total >= 0.3 * np.quantile(total[total > 0], 0.95) if (total > 0).any() else np.zeros(len(kinds), dtype=bool)
    picked_ = [(c, (bad[c] & (y == 1)).astype(np.int64)) for y, doc in zip(toxic.tolist(), docs_) for c in doc][:sentences]
    if not picked_:
        return Crf()
    emit, step = _fit_crf([c for c, _ in picked_], [t for _, t in picked_], of_kind)
    model = Crf(index, emit, step)
    model.weights, model.kinds = list(of_kind @ emit), kinds
    raw = []
    for start in range(0, len(docs_), 1000):
        part = docs_[start : start + 1000]
        each = iter(model.marginals([c for doc in part for c in doc]))
        raw += [_aggregate([next(each) for _ in doc]) for doc in part]
    raw = np.array(raw)
    fitted = Crf(index, emit, step, _fit_scale(raw, toxic))
    return fitted


def sentences_of(text: str | None, model: Crf) -> list[np.ndarray]:
    """Kinds of the tokens of each sentence."""
    return [np.array(model.chain(TOKEN.findall(s)), dtype=np.int64) for s in SENTENCE.findall((text or "").lower())]


def _aggregate(parts: list[np.ndarray]) -> tuple[float, float]:
    """Log odds that at least one token is toxic, and the logarithm of 1 + the expected number of toxic tokens."""
    clean = sum(float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()) for p in parts if len(p))
    some = -np.expm1(clean)
    return float(np.log(max(some, 1e-6)) - max(clean, -13.8)), float(np.log1p(sum(float(p.sum()) for p in parts)))


def _fit_scale(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve fitted to all documents alike; both slopes are 0 or more."""
    y = toxic.astype(float)
    weight = 1 / len(y)
    x = np.column_stack([raw, np.ones(len(raw))])
    w, seen = np.array([0.3, 0.3, 0.0]), np.zeros(3)
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * w
        seen += g**2
        w -= 0.3 * g / np.sqrt(seen + 1e-9)
        w[:2] = np.maximum(w[:2], 0)
    return tuple(w.tolist())


def score(docs: DataFrame, model: Crf, out: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out``: score (0 to 1), n_toxic tokens, and spans (start, end, marginal).

    Each sentence is one chain; only sentences with a feature word are run, since the field
    gives all others next to nothing. The score is the logistic curve of the log odds that
    at least one token is toxic. Spans are runs of tokens with a marginal of 0.5 or more,
    as code point offsets. NULL and empty texts score as a text without toxic words. Each
    row is scored on its own; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * FEATURES features

    @F.pandas_udf("score double, n_toxic int, spans array<struct<start:int,end:int,marginal:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = []
        base = _scaled(_aggregate([]), m)
        for start in range(0, len(texts), 500):
            part = [t or "" for t in texts.iloc[start : start + 500]]
            owner, chains, places = [], [], []
            for k, t in enumerate(part):
                low = t.lower()
                for s in SENTENCE.finditer(low):
                    x = m.chain(TOKEN.findall(s.group()))
                    if any(x):
                        owner.append(k)
                        chains.append(np.array(x, dtype=np.int64))
                        places.append((low, s.start(), s.end()))
            got: dict[int, list] = {}
            for k, p, at in zip(owner, m.marginals(chains), places):
                got.setdefault(k, []).append((p, at))
            for k in range(len(part)):
                mine = got.get(k)
                if mine is None:
                    rows.append((base, 0, []))
                    continue
                spans = _offsets([s for p, at in mine if (p >= 0.5).any() for s in _spans(p, [f.span() for f in TOKEN.finditer(*at)])], part[k])
                rows.append((_scaled(_aggregate([p for p, _ in mine]), m), sum(int((p >= 0.5).sum()) for p, _ in mine), spans))
        return pd.DataFrame(rows, columns=["score", "n_toxic", "spans"])

    return docs.withColumn(out, run(F.col(text)))


def _offsets(spans: list[tuple[int, int, float]], text: str) -> list[tuple[int, int, float]]:
    """Spans of the lower-case form as spans of ``text``, where the two differ in length."""
    if not spans or len(text.lower()) == len(text):
        return spans
    before = np.cumsum([0] + [len(c.lower()) for c in text])
    at = lambda x: min(int(np.searchsorted(before, x)), len(text))
    return [(at(a), at(b), p) for a, b, p in spans]


def _spans(p: np.ndarray, at: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    out, run = [], []
    for i in [*np.flatnonzero(p >= 0.5).tolist(), -2]:
        if run and i != run[-1] + 1:
            out.append((at[run[0]][0], at[run[-1]][1], float(p[run].max())))
            run = []
        run.append(i)
    return out


def _scaled(raw: tuple[float, float], m: Crf) -> float:
    if not m.index:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(m.scale[0] * raw[0] + m.scale[1] * raw[1] + m.scale[2], -30, 30))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    out = fresh(docs, "toxicity")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), out)
    return scored.where(F.col(f"{out}.score") < 0.5).select(*docs.columns)


@query("op4_crf_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    s = F.col("toxicity.score")
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))
