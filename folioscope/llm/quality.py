"""Quality classifier by co-training of two views.

View 1 sees the text (shape of characters, words and lines), view 2 the
page's metadata (language, source, length). Each is a logistic regression. In
every round each view labels the documents of an unlabelled pool that it is
surest of, and the *other* view learns from them; a view that on labelled rows
it has not learnt from knows no more than the share of ones may not teach. At the end each view is
calibrated on labelled rows that it has not learnt from, a third regression
combines the calibrated views, and every document is scored.

The pool is all documents: their features, some 100 numbers for all documents that share them, are a
table, and in every round they are judged where they lie; only the ``max_taught``
that a view is surest of for either label come to the driver. Of labelled rows the fit takes about
``max_labelled``, chosen by a hash of the id, one row an id. Scores are computed where
the documents are, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.llm.common import stored, unused
from folioscope.llm.logistic import Logistic, fit, sigmoid

_GROUPS = [b"!", b"?", b".", b",;:", b"%", b"$", b"#", b"&", b"*", b"|", b"<>{}[]", b"/\\", b"@=_~^`", b"\"'()-+", b"\n", b" \t\r"]
N_CONTENT = len(_GROUPS) + 12
N_META = 2 + 32 + 64


def content_features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * N_CONTENT
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = [counts[list(g)].sum() / n for g in _GROUPS]
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words = text.split()
    lines = text.split(b"\n")
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    return [
        *share,
        upper / n,
        upper / max(1, upper + lower),
        digits / n,
        counts[128:].sum() / n,
        np.log1p(n),
        np.log1p(len(words)),
        lengths.mean() / 10,
        lengths.std() / 10,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(1 for w in words if not w[-1:].isalnum() and w[-1:] < b"\x80") / m,
    ]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META)
    out[0], out[1] = np.log1p(max(0, n_chars or 0)), n_chars is None
    out[2 + zlib.crc32(f"l{lang}".encode()) % 32] = 1
    out[34 + zlib.crc32(f"s{source}".encode()) % 64] = 1
    return out


def _matrices(batch: pa.RecordBatch, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column(at["text"]).cast(pa.binary())
    content = np.array([content_features(t.as_py() or b"") for t in texts]).reshape(-1, N_CONTENT)
    columns = [batch.column(at[c]).to_pylist() for c in ("lang", "source", "n_chars")]
    meta = np.array([meta_features(*row) for row in zip(*columns)]).reshape(-1, N_META)
    return content, meta


@dataclass
class CoTrained:
    content: Logistic
    meta: Logistic
    calibration: tuple[Logistic, Logistic]
    both: Logistic

    def __call__(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, content view, metadata view), each the calibrated chance of quality 1."""
        logits = self.views(content, meta)
        return sigmoid(self.both.logit(logits)), sigmoid(logits[:, 0]), sigmoid(logits[:, 1])

    def views(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a = self.calibration[0].logit(self.content.logit(content)[:, None])
        b = self.calibration[1].logit(self.meta.logit(meta)[:, None])
        return np.stack([a, b], axis=1)


def _informed(model: Logistic, x: np.ndarray, y: np.ndarray) -> bool:
    """A view may teach only if on rows it has not learnt from it tells more than the share of ones does."""
    if not len(y) or y.min() == y.max():
        return False
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    return loss(np.clip(model(x), 1e-4, 1 - 1e-4)) < 0.95 * loss(np.full(len(y), y.mean()))


class ArrayPool:
    """Unlabelled rows in memory; a view is taught a tenth of them at once."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, share: float = 0.1):
        self._views = (content, meta)
        self._free = [np.ones(len(content), bool), np.ones(len(content), bool)]
        self._most = max(1, int(share * len(content)))
        self.empty = not len(content)

    def surest(self, teacher: int, model: Logistic, label: float, sure: float) -> np.ndarray:
        """The other view of the rows that the teacher is surest of, and that the other hasn't been taught."""
        other = 1 - teacher
        p = model(self._views[teacher])
        chance = p if label else 1 - p
        order = np.argsort(-chance, kind="stable")
        order = order[(chance[order] >= sure) & self._free[other][order]][: self._most]
        self._free[other][order] = False
        return self._views[other][order]


class TablePool:
    """All documents' features (key, x) as a table; each answer is a bounded number of its rows."""

    def __init__(self, features: DataFrame, most: int):
        self._features, self._most = features, most
        self._taken: list[list[np.ndarray]] = [[], []]
        self.empty = features.isEmpty()

    def surest(self, teacher: int, model: Logistic, label: float, sure: float) -> np.ndarray:
        other = 1 - teacher
        view = (slice(0, N_CONTENT), slice(N_CONTENT, None))
        taken = np.concatenate(self._taken[other]) if self._taken[other] else np.empty(0, np.int64)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), float).reshape(-1, N_CONTENT + N_META)
                p = model(x[:, view[teacher]])
                chance = p if label else 1 - p
                stay = pa.array((chance >= sure) & ~np.isin(batch.column(0).to_numpy(), taken))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], ["key", "x", "chance"]).filter(stay)

        best = self._features.mapInArrow(judge, "key long, x array<float>, chance double").orderBy(F.desc("chance"), "key").limit(self._most)
        found = best.toArrow()
        self._taken[other].append(found["key"].to_numpy())
        return np.array(found["x"].to_pylist(), float).reshape(-1, N_CONTENT + N_META)[:, view[other]]


def co_train(
    labelled: tuple[np.ndarray, np.ndarray, np.ndarray],
    pool: ArrayPool | TablePool,
    rounds: int = 4,
    sure: float = 0.97,
) -> CoTrained:
    """labelled: content, metadata and 0/1 of rows in a fixed order; every third one calibrates, the others teach."""
    x, m, y = labelled
    held = np.arange(len(y)) % 3 == 2
    if len(y) < 30:
        held = np.zeros(len(y), bool)
    teach = {0: [x[~held]], 1: [m[~held]]}
    answers = {0: [y[~held]], 1: [y[~held]]}
    models = [None, None]
    for r in range(rounds + 1):
        models = [fit(np.vstack(teach[v]), np.concatenate(answers[v])) for v in (0, 1)]
        if r == rounds or pool.empty:
            break
        for v in (0, 1):
            if not _informed(models[v], (x, m)[v][held], y[held]):
                continue
            for label in (1.0, 0.0):
                taught = pool.surest(v, models[v], label, sure)
                teach[1 - v].append(taught)
                answers[1 - v].append(np.full(len(taught), label))
    judge = held if held.any() else ~held
    logits = [models[0].logit(x[judge])[:, None], models[1].logit(m[judge])[:, None]]
    calibration = tuple(fit(z, y[judge]) for z in logits)
    made = CoTrained(models[0], models[1], calibration, fit(np.zeros((0, 2)), np.zeros(0)))
    made.both = fit(made.views(x[judge], m[judge]), y[judge])
    return made


def sampled(df: DataFrame, id_col: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows of ``df``, by a hash of the id; all if there are no more. No task holds or sorts more than its own rows."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) < int((1 << 30) * most / n))


def training_rows(id_col: str) -> Column:
    """Rows whose crc32(id as text) mod 5 isn't 0; the others are held out of every fit."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _featurise(at: dict[str, int], keep: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.hstack(_matrices(batch, at)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(rows.tolist(), pa.list_(pa.float32()))], [*names, "x"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = 20_000,
    max_taught: int = 2_000,
    seed: int = 42,
) -> CoTrained:
    """Null labels don't count; several labels of one id count as their mean, rounded; of several rows of a labelled id the one whose text has the smallest hash counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training_rows(id_col))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.round(F.avg(label_col)).cast("double").alias("y"))
    known = sampled(known, "k", max_labelled, seed)
    columns = ["text", "lang", "source", "n_chars"]
    at = {c: i for i, c in enumerate(columns)}
    rows = docs.select(*columns, F.col(id_col).cast("long").alias("k"), F.xxhash64("text", "lang", "source", "n_chars").alias("h"))
    # About max_labelled ids: bounded by the parameter.
    taught = rows.join(F.broadcast(known), "k").select(*columns, "k", "y", "h")
    taught = taught.mapInArrow(_featurise(at, [4, 5, 6], ["k", "y", "h"]), "k long, y double, h long, x array<float>")
    found = taught.groupBy("k", "y").agg(F.min_by("x", F.struct("h", "x")).alias("x")).toArrow().sort_by([("k", "ascending")])
    x = np.array(found["x"].to_pylist(), float).reshape(-1, N_CONTENT + N_META)
    y = np.array(found["y"].to_pylist(), float)
    everyone = rows.mapInArrow(_featurise(at, [], []), "x array<float>")
    everyone = everyone.select(F.xxhash64("x").alias("key"), "x").groupBy("key").agg(F.first("x").alias("x"))
    return co_train((x[:, :N_CONTENT], x[:, N_CONTENT:], y), TablePool(stored(everyone, "features"), max_taught))


SCORES = ("quality_score", "content_score", "meta_score")


def _scorer(model: CoTrained, at: dict[str, int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model(*_matrices(batch, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], [*batch.schema.names, *names])

    return run


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``docs`` with its columns and quality_score, content_score, meta_score.

    Defined cases: null text scores as empty; null metadata is a value of
    its own; null ids and repeated rows are scored like others; without
    usable labels every document gets the same score; an empty table gives no
    rows; very long texts are read whole; where ``docs`` has a column of a
    score's name, the score's gets an underscore after it.
    """
    at = {c: docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")}
    names = unused(docs.columns, *SCORES)
    schema = StructType([*docs.schema.fields, *[StructField(c, DoubleType()) for c in names]])
    return docs.mapInArrow(_scorer(model, at, names), schema)


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """score() by a model trained on the same documents, with ``accepted`` (score of 0.5 or more), which is named as scores are."""
    accepted, of = unused(docs.columns, "accepted", SCORES[0])
    return score(docs, train(docs, labels, **how)).withColumn(accepted, F.col(of) >= 0.5)
