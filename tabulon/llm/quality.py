"""Quality classifier by co-training.

Two views of a document are learned apart: its content (hashed words and marks) and its page metadata (source, language and, in bins,
length, lines, shares of capitals, digits, marks and repeats). Either view is a Bernoulli naive Bayes model over the features whose G
statistic is SIGNIFICANT or more, so all that fitting needs of the corpus are counts of features by class: one pass, partial sums in each
task, a sum by feature. Three quarters of the labelled rows are learned from; the others, which no model sees, calibrate each view (Platt).
In each round every document without a label is scored by both views, and where a view is sure (a calibrated probability of SURE or more,
or RARE times the base rate or less) the other view counts it as labelled so, all such documents of a class weighing as much as its labelled
rows at most. A logistic regression on the two calibrated logits combines the views. This is done for two targets, low quality and toxic.

Counts and rounds cover all rows; only the two or three numbers of a calibration are fitted on a bounded sample, CALIBRATION held-out rows
by the hash of their id. Null or empty text is an empty document and is scored like any other, texts of any length are read whole; null
metadata is a value of its own. Rows with a null id, or without a label, take part unlabelled; repeated rows count as often as they occur
and are scored alike, a label given more than once counts as the least of its values, equal scores are decided alike. A target whose
labelled rows lack a class, among those learned from or those held out, can't be learned: its probability is the smoothed share of the label
and it rejects nothing. An empty table gives an empty result. Columns of any other name, also those used here, are kept as they are."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, table

ROUNDS, SURE, RARE, SIGNIFICANT, SMOOTH, CALIBRATION = 2, 0.9, 0.1, 15.0, 0.5, 16_000
WORDS, TAGS, BROADCAST_ROWS, SLICE_CHARS = 1 << 18, 1 << 14, 1_000_000, 1 << 21
SIZES = {"content": WORDS, "page": TAGS}
TARGETS = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
THRESHOLD = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
_OTHER = {"content": "page", "page": "content"}


class _Buckets(dict):
    """Word -> one of ``n`` buckets; forgotten when full, which costs time only."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = k = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % self.n
        return k


_KNOWN, _TAGS = _Buckets(WORDS), _Buckets(TAGS)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point below 2^16: 1 capital, 2 digit, 3 mark, else 0; higher ones are taken as 0."""
    kind = {"Lu": 1, "N": 2, "P": 3, "S": 3}
    return np.array([kind.get(c := unicodedata.category(chr(i)), kind.get(c[0], 0)) for i in range(1 << 16)], np.uint8)


def _share(a: float, b: float) -> int:
    """A share in twentieths; of nothing: -1."""
    return int(20 * a / b) if b else -1


def vectors(texts: pd.Series, *meta: pd.Series) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets of the documents, one after the other and ascending in each; their number by document) of each view."""
    done = []
    for a, b in slices(texts := texts.tolist(), SLICE_CHARS):  # a slice's words are in memory at a time
        done.append(_vectors(texts[a:b], *(m.iloc[a:b].tolist() for m in meta)))
    empty = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return {v: tuple(map(np.concatenate, zip(empty, *(d[v] for d in done), strict=True))) for v in SIZES}


def _vectors(texts: list, langs: list, sources: list, n_chars: list) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    found = [TOKEN.findall((text or "").lower()) for text in texts]
    n_tokens = np.array([len(x) for x in found], np.int64)
    buckets = np.fromiter(map(_KNOWN.__getitem__, chain.from_iterable(found)), np.int64, int(n_tokens.sum()))
    content = _distinct(buckets, n_tokens, WORDS)
    tags = []
    for text, lang, source, n, tokens, words in zip(texts, langs, sources, n_chars, n_tokens.tolist(), content[1].tolist(), strict=True):
        text = text or ""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.bincount(_classes()[np.where(points < 1 << 16, points, 0)], minlength=4)
        lines = text.split("\n")
        log = lambda x: int(2 * np.log1p(max(float(x), 0.0)))
        said = len(text) if n is None or n != n else n
        tags.append((
            f"source={source}", f"lang={lang}", f"chars={log(said)}", f"lines={log(len(lines))}", f"line={log(len(text) / len(lines))}", f"word={_share(len(text), 10 * tokens)}",
            f"capitals={_share(kinds[1], len(text))}", f"digits={_share(kinds[2], len(text))}", f"marks={_share(kinds[3], len(text))}", f"distinct={_share(words, tokens)}", f"distinct lines={_share(len(set(lines)), len(lines))}",
        ))
    page = np.fromiter(map(_TAGS.__getitem__, chain.from_iterable(tags)), np.int64, sum(map(len, tags)))
    return {"content": content, "page": _distinct(page, np.array([len(x) for x in tags], np.int64), TAGS)}


def _distinct(buckets: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(np.repeat(np.arange(len(sizes)), sizes) * n + buckets)
    keys = keys[np.diff(keys, prepend=-1) != 0]
    return (keys % n).astype(np.uint32), np.bincount(keys // n, minlength=len(sizes))


def _inputs(docs: DataFrame, text_col: str) -> list:
    """Text, language, source and length: columns that are not there are null."""
    have = set(docs.columns)
    of = lambda c, kind: F.col(f"`{c}`").cast(kind) if c in have else F.lit(None).cast(kind)
    return [of(text_col, "string"), of("lang", "string"), of("source", "string"), of("n_chars", "double")]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, page): the buckets of each view as little-endian unsigned 32-bit integers."""

    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        made = vectors(text, lang, source, n)
        return pd.DataFrame({v: [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(text) else [] for v, (ids, sizes) in made.items()})

    made = F.pandas_udf(run, "content binary, page binary").asNondeterministic()(*_inputs(docs, text_col))
    return docs.select(F.col(f"`{id_col}`").alias("id"), made.alias("x")).select("id", "x.content", "x.page")


@dataclass
class Target:
    """One target's views (weights by bucket, intercept), their calibrations and combination, or its constant probability."""

    constant: float | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    platt: dict[str, np.ndarray] = field(default_factory=dict)
    blend: np.ndarray | None = None
    base: float = 0.5

    def logits(self, view: str, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Uncalibrated logits of documents whose buckets follow each other."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[view][ids])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def calibrated(self, view: str, logits: np.ndarray) -> np.ndarray:
        return self.platt[view][0] * logits + self.platt[view][1]

    def sure(self, view: str, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which documents ``view`` holds to be of class 0, and of class 1."""
        z = self.calibrated(view, logits)
        return z <= logit(RARE * self.base), z >= logit(SURE)

    def probabilities(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of both views together, of the content alone, of the page alone."""
        a, b = self.calibrated("content", content), self.calibrated("page", page)
        return expit(self.blend[0] * a + self.blend[1] * b + self.blend[2]), expit(a), expit(b)


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the columns and, last, the intercept: Newton's method."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, hold = np.zeros(a.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-9])
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + w @ hold @ w / 2
    for _ in range(50):
        p = expit(a @ w)
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold + 1e-9 * np.eye(len(w)), a.T @ (p - y) + hold @ w)
        rate, now = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, their number by row)."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)


_LABELS = [f"y_{t}" for t in TARGETS]
#: Of each target: labelled and pseudo-labelled documents of class 0 and 1.
_COUNTS = [f"{t}_{k}" for t in TARGETS for k in ("l0", "l1", "p0", "p1")]


def tally(marked: DataFrame, models: dict[str, Target]) -> DataFrame:
    """(view, bucket and _COUNTS): documents that hold the bucket; bucket -1 counts all. A task sends one row for each bucket that it met."""

    def run(batches):
        sums = {v: np.zeros((len(_COUNTS), n + 1), np.int64) for v, n in SIZES.items()}
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            cols = dict(zip(SIZES, (_joined(batch.column(0)), _joined(batch.column(1))), strict=True))
            for i, t in enumerate(TARGETS):
                y = batch.column(3 + i).fill_null(-1).to_numpy(zero_copy_only=False)
                taught = {}
                if t in models and models[t].constant is None:
                    taught = {_OTHER[v]: models[t].sure(v, models[t].logits(v, *cols[v])) for v in SIZES}
                for v, (ids, sizes) in cols.items():
                    for k, own in enumerate([(y == 0) & ~held, (y == 1) & ~held, *((y < 0) & x for x in taught.get(v, ()))]):
                        if own.any():
                            sums[v][4 * i + k, :-1] += np.bincount(ids[np.repeat(own, sizes)], minlength=SIZES[v])
                            sums[v][4 * i + k, -1] += own.sum()
        for v, x in sums.items():
            at = np.flatnonzero(x.any(axis=0))
            for a in range(0, len(at), 10_000):
                k = at[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(k)), pa.array(np.where(k == SIZES[v], -1, k)), *map(pa.array, x[:, k])], ["view", "bucket", *_COUNTS])

    parts = marked.select("content", "page", "held", *_LABELS).mapInArrow(run, "view string, bucket bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return parts.groupBy("view", "bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _fit(counts: DataFrame, target: str, view: str, totals: list[int]) -> np.ndarray:
    """Weights of a view for a target. ``totals``: its l0, l1, p0, p1 of all documents. Only significant buckets reach the driver."""
    weigh = [min(1.0, totals[c] / totals[2 + c]) if totals[2 + c] else 0.0 for c in (0, 1)]
    m, n = (totals[c] + weigh[c] * totals[2 + c] for c in (0, 1))
    rows = counts.where((F.col("view") == view) & (F.col("bucket") >= 0)).select("bucket", *[(F.col(f"{target}_l{c}") + weigh[c] * F.col(f"{target}_p{c}")).alias(x) for c, x in enumerate("ab")])
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / (m + n)
    g = 2 * sum(part(F.col(seen), all_ * share) + part(all_ - F.col(seen), all_ * (1 - share)) for seen, all_ in (("a", m), ("b", n)))
    odds = lambda seen, all_: F.log((F.col(seen) + SMOOTH) / (F.greatest(all_ - F.col(seen), F.lit(0.0)) + SMOOTH))
    out = np.zeros(SIZES[view])
    for r in rows.where(g >= SIGNIFICANT).select("bucket", (odds("b", n) - odds("a", m)).alias("w")).collect():  # of a fixed number of buckets
        out[r["bucket"]] = r["w"]
    return out


def _held_out(marked: DataFrame, models: dict[str, Target]) -> dict[str, np.ndarray]:
    """(content logit, page logit, label) of CALIBRATION held-out rows at most, by target."""
    live = [t for t in TARGETS if models[t].constant is None]

    def run(content: pd.Series, page: pd.Series) -> pd.DataFrame:
        cols = dict(zip(SIZES, (_joined(pa.array(content)), _joined(pa.array(page))), strict=True))
        return pd.DataFrame({f"{t}_{v}": models[t].logits(v, *cols[v]) for t in live for v in SIZES})

    scores = F.pandas_udf(run, ", ".join(f"{t}_{v} double" for t in live for v in SIZES)).asNondeterministic()
    few = marked.where("held").orderBy("h").limit(CALIBRATION)
    got = few.select(scores("content", "page").alias("s"), *_LABELS).select("s.*", *_LABELS).toPandas()
    return {t: got.loc[got[f"y_{t}"].notna(), [f"{t}_content", f"{t}_page", f"y_{t}"]].to_numpy(float) for t in live}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> dict[str, Target]:
    """Fits every target."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[(F.min(c) == bad).cast("int").alias(f"y_{t}") for t, (c, bad) in TARGETS.items()])
    # null ids have no label and must not meet in one task
    named, other = (features(docs.where(x), id_col, text_col) for x in (F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`").isNull()))
    known = saved(known, "labels")
    # a row is a long and two ints: BROADCAST_ROWS of them are under 40 MB; more labels meet the features by a shuffle
    marked = named.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "id", "left").unionByName(other, allowMissingColumns=True)
    has = F.coalesce(*_LABELS).isNotNull()
    h = F.xxhash64("id", F.lit(3))
    marked = saved(marked.select("content", "page", *_LABELS, h.alias("h"), (has & (F.pmod(h, F.lit(4)) == 0)).alias("held")), "features")
    shares = marked.groupBy("held").agg(*[F.count_if(F.col(f"y_{t}") == c).alias(f"{t}{c}") for t in TARGETS for c in (0, 1)]).collect()
    models = {}
    for t in TARGETS:
        n = {(r["held"], c): r[f"{t}{c}"] for r in shares for c in (0, 1)}
        ones, all_ = sum(n.get((x, 1), 0) for x in (True, False)), sum(n.values())
        models[t] = Target(None if all(n.get((x, c)) for x in (True, False) for c in (0, 1)) else (ones + 1) / (all_ + 2), base=(ones + 1) / (all_ + 2))
    if all(m.constant is not None for m in models.values()):
        return models
    for now in range(rounds + 1):
        counts = saved(tally(marked, models if now else {}), "counts")
        totals = {r["view"]: r for r in counts.where("bucket < 0").collect()}  # a row a view
        for t, m in models.items():
            if m.constant is None:
                m.weights = {v: _fit(counts, t, v, [totals[v][f"{t}_{k}"] for k in ("l0", "l1", "p0", "p1")]) for v in SIZES}
        for t, x in _held_out(marked, models).items():
            for k, v in enumerate(SIZES):
                models[t].platt[v] = logistic(x[:, [k]], x[:, 2])
            if now == rounds:
                z = np.column_stack([models[t].calibrated(v, x[:, k]) for k, v in enumerate(SIZES)])
                models[t].blend = logistic(z, x[:, 2])
    return models


PARTS = [f"{t}{v}" for t in TARGETS for v in ("", "_content", "_page")]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "_quality") -> DataFrame:
    """``docs`` with a struct ``to``: low_quality and toxic, each view's own (``_content``, ``_page``), and keep."""
    models = train(docs, labels, id_col, text_col)

    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        cols = vectors(text, lang, source, n)
        out, keep = {}, np.ones(len(text), bool)
        for t, m in models.items():
            if m.constant is not None:
                p = (np.full(len(text), m.constant),) * 3
            else:
                p = m.probabilities(*(m.logits(v, *cols[v]) for v in SIZES))
                keep &= p[0] < THRESHOLD
            out |= dict(zip((t, f"{t}_content", f"{t}_page"), p, strict=True))
        return pd.DataFrame(out | {"keep": keep})

    score = F.pandas_udf(run, ", ".join(f"{c} double" for c in PARTS) + ", keep boolean").asNondeterministic()
    return docs.withColumn(to, score(*_inputs(docs, text_col)))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    to = "_quality"
    while to in docs.columns:
        to += "_"
    return scored(docs, labels, id_col, text_col, to).where(F.col(to)["keep"]).drop(to)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(F.col("_quality")[c], 6).alias(c) for c in PARTS], F.col("_quality")["keep"].alias("keep"))
