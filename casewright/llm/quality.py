"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts (lengths, shares of character classes, repetition of words, word pairs and lines) are put on a
log scale. Each class has a Gaussian whose covariance is shrunk towards its diagonal; a score is the difference of the
log densities, by Mahalanobis distances from Cholesky factors that are computed once and shipped with the job, brought
to 0..1 by a logistic fit on the training rows.

Moments are summed over all labelled rows outside the held-out fifth (crc32 of the id as text, mod 5, is 0); labels,
lang, source and doc_id are never inputs of a score. Statistics are whole multiples of 1 / STEP, so that the sums are exact
and the model does not hang on the order of rows or on tasks that ran twice.

Defined cases: null and empty texts have the statistics of an empty text and are scored; rows that repeat a doc_id are
scored each; unlabelled rows, null labels and labels without a document do not train; with labels of one class only every
score is that class's, with none at all every score is 0.5; an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm import textblocks as tb
from casewright.llm.work import BATCH_BYTES, Work, fresh, read, with_arrow_columns

CUT = 0.3
SHRINK = 0.05
STEP = 4096  # numbers below 2**17 in steps, their products below 2**34
_SPACE = tb.byte_set((0x09, 0x0D), (0x20, 0x20))
_CLASS = np.zeros(256, np.uint8)  # 1 lower or other letters, 2 upper, 3 digit, 4 common stops, 5 other ASCII marks, 6 space, 7 line end
_CLASS[:] = 5
_CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[[0x2C, 0x2E, 0x21, 0x3F, 0x3A, 0x3B, 0x27, 0x22, 0x2D]] = 4
_CLASS[_SPACE] = 6
_CLASS[0x0A] = 7
FEATURES = 18


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES numbers of a block of texts."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    out = np.zeros((rows, FEATURES))
    if not len(buf):
        return _scaled(out)
    kind = _CLASS[buf]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    shares = np.bincount(row * 8 + kind, minlength=rows * 8).reshape(rows, 8)
    wide = np.bincount(row, weights=buf >= 0x80, minlength=rows)
    some = np.maximum(size, 1)
    starts, ends, first = tb.word_spans(buf, offsets, ~_SPACE)
    words, of = np.diff(first), tb.row_of(first)
    n = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, weights=length, minlength=rows) / n
    spread = np.sqrt(np.maximum(np.bincount(of, weights=length**2, minlength=rows) / n - mean**2, 0))
    h = tb.span_hashes(buf, starts, ends)
    pairs = h[:-1] * tb.U(3) + h[1:]
    same_row = of[1:] == of[:-1]
    again = np.bincount(of[1:], weights=same_row & (h[1:] == h[:-1]), minlength=rows)
    lines_s, lines_e, lines_f = tb.word_spans(buf, offsets, buf_not_line_end)
    line_hash, lines = tb.span_hashes(buf, lines_s, lines_e), np.diff(lines_f)
    distinct, top, pair_distinct, line_distinct = (np.zeros(rows) for _ in range(4))
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b > a:
            w = np.sort(h[a:b])
            cut = np.flatnonzero(np.r_[True, w[1:] != w[:-1], True])
            distinct[r], top[r] = len(cut) - 1, np.diff(cut).max()
            if b - a > 1:
                w = np.sort(pairs[a : b - 1])
                pair_distinct[r] = 1 + (w[1:] != w[:-1]).sum()
        a, b = lines_f[r], lines_f[r + 1]
        if b > a:
            w = np.sort(line_hash[a:b])
            line_distinct[r] = 1 + (w[1:] != w[:-1]).sum()
    out[:, 0] = size
    out[:, 1], out[:, 2] = mean, spread
    for k, c in enumerate((2, 3, 4, 5, 6, 7)):
        out[:, 3 + k] = shares[:, c] / some
    out[:, 9] = wide / some
    out[:, 10] = 1 - distinct / n
    out[:, 11] = top / n
    out[:, 12] = np.where(words > 1, 1 - pair_distinct / np.maximum(words - 1, 1), 0)
    out[:, 13] = again / n
    out[:, 14] = np.where(lines > 0, 1 - line_distinct / np.maximum(lines, 1), 0)
    out[:, 15] = lines / n
    out[:, 16] = np.where(words > 0, distinct / np.sqrt(n), 0)
    out[:, 17] = words
    return _scaled(out)


buf_not_line_end = ~tb.byte_set((0x0A, 0x0A))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Counts as log(1 + n), shares as log(share + 0.001)."""
    counts = [0, 1, 2, 16, 17]
    shares = [k for k in range(FEATURES) if k not in counts]
    out = np.empty_like(x)
    out[:, counts] = np.log1p(x[:, counts])
    out[:, shares] = np.log(np.maximum(x[:, shares], 0) + 1e-3)
    return np.round(out * STEP) / STEP


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with an array column of statistics; its name is returned."""
    name = fresh(docs, "_statistics")

    def make():
        def run(column):
            buf, offsets = tb.text_bytes(column)
            parts = [statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tb.row_blocks(offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))]

        return run

    return with_arrow_columns(docs, [text], [T.StructField(name, T.ArrayType(T.DoubleType()))], make), name


class Discriminant:
    """The fitted model: for each class a prior, a mean and the Cholesky factor of its covariance; a logistic link."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK):
        self.classes, self.link = {}, (1.0, 0.0)
        total = sum(n for n, *_ in moments.values())
        for y, (n, s, ss) in moments.items():
            mean = s / n
            cov = ss / n - np.outer(mean, mean)
            diagonal = np.maximum(np.diag(cov), 1e-6)
            cov = (1 - shrink) * cov + shrink * np.diag(diagonal) + 1e-4 * np.eye(len(s))
            factor = np.linalg.cholesky((cov + cov.T) / 2)
            inverse = np.linalg.inv(factor)
            self.classes[y] = (np.log(n / total), mean, inverse, -np.log(np.diag(factor)).sum())

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0, on a scale that tames the far ends."""
        value = {y: prior + norm - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for y, (prior, mean, inverse, norm) in self.classes.items()}
        if len(value) < 2:
            return np.full(len(x), 10.0 if 1 in value else -10.0)
        return np.arcsinh(value[1] - value[0])

    def fit_link(self, z: np.ndarray, n: np.ndarray, ones: np.ndarray) -> None:
        """Logistic fit of slope and offset on bins z with n rows, of which `ones` have label 1."""
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = n * p * (1 - p)
            g = np.array([((ones - n * p) * z).sum(), (ones - n * p).sum()]) - 1e-3 * np.array([a - 1, b])
            m = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(m, g)
            step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            a, b = a + step[0], b + step[1]
        if a > 0:
            self.link = (float(a), float(b))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.link
        return 1 / (1 + np.exp(-np.clip(a * self.difference(x) + b, -40, 40)))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def fit(rows: DataFrame) -> Discriminant:
    """rows (x: statistics, y: 0 or 1). What reaches the driver: the moments of two classes, and 400 bins."""

    def moments(batches):
        sums = {}
        for batch in batches:
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = np.round(x[y == k] * STEP)
                for low in range(0, len(own), 1 << 16):
                    part = own[low : low + (1 << 16)]  # below 2**50, so exact
                    flat = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()]).astype(np.int64)
                    sums[k] = sums.get(k, 0) + flat
        for k, flat in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), k, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["y", "i", "v"])

    table: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(moments, "y int, i int, v long").groupBy("y", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        table.setdefault(r.y, np.zeros(1 + FEATURES + FEATURES**2))[r.i] = int(r.v) / (STEP ** ((r.i > 0) + (r.i > FEATURES)))
    model = Discriminant({y: (v[0], v[1 : 1 + FEATURES], v[1 + FEATURES :].reshape(FEATURES, FEATURES)) for y, v in table.items()})
    if len(model.classes) == 2:

        def bins(batches):
            for batch in batches:
                z = np.clip(np.round(model.difference(_matrix(batch.column(0))) * 16), -200, 200).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1)], names=["z", "y"])

        got = rows.mapInArrow(bins, "z int, y int").groupBy("z").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("z").collect()
        model.fit_link(np.array([r.z for r in got]) / 16, np.array([r.n for r in got], float), np.array([r.ones for r in got], float))
    return model


def held_out(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> tuple[Discriminant, DataFrame]:
    """The model and the table it was made of: doc_id and statistics x of every row of docs. labels: doc_id and the label."""
    work = Work(docs.sparkSession, "quality", BATCH_BYTES)
    plain, z = with_statistics(docs.select("doc_id", F.col(text).alias("text")))
    known = work.table(plain.select("doc_id", F.col(z).alias("x")), "statistics")  # labels meet numbers, never texts
    own = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(F.col("_id")))
    return fit(work.table(known.join(own, F.col("doc_id") == F.col("_id")).select("x", "y"), "train")), known


def with_scores(rows: DataFrame, model: Discriminant, column: str, matrices) -> tuple[DataFrame, str]:
    """rows with a double column of scores; matrices gives the statistics in parts from the named Arrow column."""
    name = fresh(rows, "_score")
    if not model.classes:
        return rows.withColumn(name, F.lit(0.5)), name

    def make():
        def run(values):
            parts = [model.score(x) for x in matrices(values)]
            return [np.concatenate(parts) if parts else np.zeros(0)]

        return run

    return with_arrow_columns(rows, [column], [T.StructField(name, T.DoubleType())], make), name


def _of_texts(column):
    buf, offsets = tb.text_bytes(column)
    return (statistics(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tb.row_blocks(offsets))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> tuple[DataFrame, str]:
    """docs with a double column of scores; its name is returned."""
    model, _ = train(docs, labels, label, text)
    return with_scores(docs, model, text, _of_texts)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, known = train(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    out, score = with_scores(known, model, "x", lambda column: [_matrix(column)])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= CUT).cast("int").alias("predicted"))
