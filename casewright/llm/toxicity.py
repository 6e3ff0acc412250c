"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

1. Terms are lower-cased words and their prefixes of four and five letters. A bounded sample of labelled documents
   (about SAMPLE rows, drawn by hash) tells which TERMS of them lean most to one class (log-likelihood ratio).
2. Voters look at a whole text and vote toxic, vote clean, or abstain: single telling terms, lexicons of telling terms
   by kind and rate, a fixed list of insults, insults near "you", masked letters, runs of marks, shouting, and voters for
   clean texts. A document's votes are one bitmask.
3. The label model explains the histogram of bitmasks of all documents by a hidden class: each voter's votes depend on
   the class (its accuracy) and on one other voter (its correlation); that tree is the one of greatest conditional mutual
   information. Expectation maximisation starts from the labelled rows, whose class stays known; without labels of both
   classes it starts from the majority of votes.
4. A logistic regression with elastic net on the telling terms is trained on posterior labels of a bounded sample of all
   documents (about SAMPLE rows). Its probability is the score.

Labels are taken from rows outside the held-out third alone (crc32 of the id as text, mod 3, is 1); labels, lang, source
and doc_id are no inputs of a score.

Defined cases: null and empty texts have no terms and are scored; rows that repeat a doc_id are scored each; a document
labelled more than once is toxic if one of its labels is; null labels and labels without a document do not train; without
labels of both classes no terms are mined and the fixed list and patterns vote alone, and where they never vote toxic every
score is 0; an empty table gives no rows; further columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm import textblocks as tb
from casewright.llm.work import Work, fresh, read, with_arrow_columns

CUT = 0.7
SAMPLE, TERMS, ROUNDS = 40_000, 8192, 6
PARTS = 16  # of the training sample
SINGLE, TIERS = 8, (0.9, 0.5, 0.2)  # voters of one term for each kind; toxic rates of the lexicons
PREFIXES = (4, 5)
INSULTS = "bastard clown coward creep cretin degenerate dimwit disgusting dumb fool freak garbage idiot imbecile loser moron pathetic pig pervert psycho rat scum sleazy slob stupid trash twit vermin vile worthless".split()
_WORD = tb.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER, _LETTER = tb.byte_set((0x41, 0x5A)), tb.byte_set((0x41, 0x5A), (0x61, 0x7A))
_TAG = tb.mix(np.arange(1, 2 + len(PREFIXES), dtype=np.uint64) * tb.U(17))


def term_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, kind, number of the word) of all terms of a block of texts; kind 0 is the word, k its k-th prefix."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    buf = tb.LOWER[buf]
    starts, ends, first = tb.word_spans(buf, offsets, _WORD)
    row, number = tb.row_of(first), np.arange(len(starts))
    head = (buf & 0xC0) != 0x80
    places = np.flatnonzero(head)
    before = np.concatenate([[0], np.cumsum(head)])
    out = [(row, tb.span_hashes(buf, starts, ends) ^ _TAG[0], np.zeros(len(row), np.int64), number)]
    for k, letters in enumerate(PREFIXES, 1):
        long = np.flatnonzero(before[ends] - before[starts] > letters)
        cut = places[before[starts[long]] + letters]
        out.append((row[long], tb.span_hashes(buf, starts[long], cut) ^ _TAG[k], np.full(len(long), k), number[long]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return tb.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends) ^ _TAG[0]


def _blocks(column):
    buf, offsets = tb.text_bytes(column)
    for low, high in tb.row_blocks(offsets):
        yield low, high, buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def _term_counts(batches):
    """(text, y) to term, kind, and how many documents of each class hold it."""
    schema = pa.schema([("term", pa.int64()), ("kind", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        y = batch.column(1).to_numpy()
        for low, _, buf, offsets in _blocks(batch.column(0)):
            row, h, kind, _ = term_hashes(buf, offsets)
            order = np.lexsort((h, row))
            row, h, kind = row[order], h[order], kind[order]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
            term, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            toxic = np.bincount(of, weights=y[low + row[new]], minlength=len(term)).astype(np.int64)
            yield tb.to_batch(schema, term=term.view(np.int64), kind=kind[new][first], toxic=toxic, clean=np.bincount(of, minlength=len(term)) - toxic)


def telling_terms(sample: DataFrame, terms: int = TERMS) -> tuple[list, int, int]:
    """sample (text, y): the terms (term, kind, toxic, clean) of greatest log-likelihood ratio, and documents of each class."""
    n = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = int(n[0] or 0), int(n[1] or 0)
    if not toxic or not clean:
        return [], toxic, clean
    counts = sample.mapInArrow(_term_counts, "term long, kind int, toxic long, clean long").groupBy("term").agg(F.min("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    held = F.col("toxic") + F.col("clean")
    ratio = part(F.col("toxic"), held * toxic / (toxic + clean)) + part(F.col("clean"), held * clean / (toxic + clean))
    ratio += part(toxic - F.col("toxic"), (toxic + clean - held) * toxic / (toxic + clean)) + part(clean - F.col("clean"), (toxic + clean - held) * clean / (toxic + clean))
    best = counts.where(held >= 5).withColumn("ratio", F.round(2 * ratio, 6)).where("ratio > 10.8").orderBy(F.desc("ratio"), "term").limit(terms)
    return best.collect(), toxic, clean


class Voters:
    """Term dictionary and voters. `toxic` says which side each voter takes when it votes."""

    def __init__(self, terms: list, toxic: int = 0, clean: int = 0):
        self.terms = np.array(sorted(r.term for r in terms), np.int64).view(np.uint64)
        self.terms.sort()
        base = toxic / max(toxic + clean, 1)
        self.leaning = np.zeros(len(self.terms), bool)
        voter: list[tuple[np.ndarray, str]] = []
        at = {int(t): k for k, t in enumerate(self.terms.view(np.int64).tolist())}
        lean = [r for r in terms if r.toxic / (r.toxic + r.clean) >= max(min(5 * base, 0.5), TIERS[-1])]
        for r in lean:
            self.leaning[at[r.term]] = True
        for kind in range(1 + len(PREFIXES)):
            own = [r for r in lean if r.kind == kind]
            for r in own[:SINGLE]:
                voter.append((np.array([at[r.term]]), f"term {r.term & (1 << 64) - 1:016x}"))
            high = 1.01
            for tier in TIERS:
                held = np.array([at[r.term] for r in own[SINGLE:] if tier <= r.toxic / (r.toxic + r.clean) < high], np.int64)
                if len(held):
                    voter.append((held, f"lexicon of kind {kind}, rate {tier}"))
                high = tier
        self.groups = [g for g, _ in voter]
        self.names = [n for _, n in voter] + ["insults", "insult near you", "masked letters", "runs of marks", "shouting", "no leaning term", "no insult", "leaning terms are rare"]
        self.toxic = np.array([not n.startswith(("no ", "leaning")) for n in self.names])
        self.insults = np.sort(_hash_of(INSULTS))
        self.you = np.sort(_hash_of(["you", "your", "youre", "u"]))

    def look(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(votes as one bitmask a row, numbers of the telling terms of all rows, their bounds by row)."""
        rows = len(offsets) - 1
        row, h, kind, number = term_hashes(buf, offsets)
        found = np.searchsorted(self.terms, h)
        hit = np.flatnonzero(self.terms[np.minimum(found, len(self.terms) - 1)] == h) if len(self.terms) else np.zeros(0, np.int64)
        pairs = np.unique(row[hit] * max(len(self.terms), 1) + found[hit])
        of, term = pairs // max(len(self.terms), 1), pairs % max(len(self.terms), 1)
        bounds = np.searchsorted(of, np.arange(rows + 1))
        votes = []
        for g in self.groups:
            votes.append(np.bincount(of[np.isin(term, g)], minlength=rows) > 0)
        word = kind == 0
        words = np.bincount(row[word], minlength=rows)
        member = lambda table: np.flatnonzero(word & (table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h))
        insult, you = member(self.insults), member(self.you)
        close = np.searchsorted(number[you], number[insult] - 4)
        near = np.zeros(len(insult), bool)
        some = close < len(you)
        near[some] = (number[you][close[some]] <= number[insult][some] + 4) & (row[you][close[some]] == row[insult][some])
        upper = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)), weights=_UPPER[buf], minlength=rows)
        letters = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)), weights=_LETTER[buf], minlength=rows)
        star, mark = (buf == 0x2A) | (buf == 0x23), (buf == 0x21) | (buf == 0x3F)
        at_row = np.searchsorted(offsets, np.arange(len(buf)), "right") - 1
        same = lambda k: at_row[k:] == at_row[: len(buf) - k]
        has = lambda k, where: np.bincount(at_row[: len(buf) - k][where & same(k)], minlength=rows) > 0
        masked = has(3, _LETTER[buf[:-3]] & star[1:-2] & star[2:-1] & _LETTER[buf[3:]]) if len(buf) > 3 else np.zeros(rows, bool)
        marks = has(2, mark[:-2] & mark[1:-1] & mark[2:]) if len(buf) > 2 else np.zeros(rows, bool)
        insulted = np.bincount(row[insult], minlength=rows)
        leaning = np.bincount(of[self.leaning[term]], minlength=rows) if len(self.terms) else np.zeros(rows, np.int64)
        votes += [insulted > 0, np.bincount(row[insult[near]], minlength=rows) > 0, masked, marks, (letters >= 20) & (upper > 0.5 * letters)]
        votes += [leaning == 0, insulted == 0, (leaning > 0) & (leaning * 2000 < words)]
        mask = np.zeros(rows, np.int64)
        for k, v in enumerate(votes):
            mask |= v.astype(np.int64) << k
        return mask, term, bounds

    def columns(self, column) -> list[pa.Array]:
        """Arrow column of texts to columns votes and terms."""
        masks, terms, bounds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, _, buf, offsets in _blocks(column):
            m, t, b = self.look(buf, offsets)
            masks.append(m)
            terms.append(t)
            bounds.append(b[1:] + bounds[-1][-1])
        return [pa.array(np.concatenate(masks)), pa.ListArray.from_arrays(pa.array(np.concatenate(bounds).astype(np.int32)), pa.array(np.concatenate(terms).astype(np.int32)))]


class LabelModel:
    """Class prior and, for each voter, how often it votes given the class and given its one neighbour in the tree."""

    def __init__(self, voters: int):
        self.m = voters
        self.parent = np.full(voters, -1)
        self.prior = np.array([0.5, 0.5])
        self.table = np.full((2, voters, 2), 0.5)  # by class, voter, neighbour's vote

    def bits(self, masks: np.ndarray) -> np.ndarray:
        return (masks[:, None] >> np.arange(self.m)) & 1

    def update(self, pairs: np.ndarray) -> None:
        """pairs[y, i, j]: expected documents of class y in which both i and j vote; pairs[y, m, m]: all of the class."""
        m = self.m
        n = pairs[:, m, m]
        self.prior = (n + 1) / (n.sum() + 2)
        vote = np.stack([np.diag(p)[:m] for p in pairs])
        info = np.zeros((m, m))
        for y in (0, 1):
            both = pairs[y, :m, :m]
            one = vote[y]
            cells = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): n[y] - one[:, None] - one[None, :] + both}
            for (a, b), cell in cells.items():
                p = (np.maximum(cell, 0) + 0.25) / (n[y] + 1)
                left, right = ((one if x else n[y] - one) + 0.5 for x in (a, b))
                info += n[y] / max(n.sum(), 1) * p * np.log(p * (n[y] + 1) ** 2 / (left[:, None] * right[None, :]))
        # the tree of greatest mutual information, grown from the first voter
        self.parent[:] = -1
        inside, best, to = np.zeros(m, bool), np.full(m, -np.inf), np.zeros(m, np.int64)
        at = 0
        for _ in range(m):
            inside[at] = True
            nearer = ~inside & (info[at] > best)
            best[nearer], to[nearer] = info[at][nearer], at
            if inside.all():
                break
            at = int(np.argmax(np.where(inside, -np.inf, best)))
            self.parent[at] = to[at]
        for y in (0, 1):
            alone = (vote[y] + 0.5) / (n[y] + 1)
            for i in range(m):
                j = self.parent[i]
                if j < 0:
                    self.table[y, i] = alone[i]
                else:
                    both, other = pairs[y, i, j], vote[y, j]
                    self.table[y, i] = (vote[y, i] - both + alone[i]) / (n[y] - other + 1), (both + alone[i]) / (other + 1)
        self.table = np.clip(self.table, 1e-6, 1 - 1e-6)
        self.accuracy = (vote[1] + 0.5) / (vote.sum(axis=0) + 1)  # of what a voter votes on: the toxic share
        spread = np.sqrt(np.maximum(vote * (n[:, None] - vote), 1e-9))
        self.correlation = np.stack([(pairs[y, :m, :m] * n[y] - np.outer(vote[y], vote[y])) / np.outer(spread[y], spread[y]) for y in (0, 1)])

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each bitmask."""
        b = self.bits(masks)
        neighbour = np.where(self.parent >= 0, b[:, np.maximum(self.parent, 0)], 0)
        value = np.empty((2, len(b)))
        for y in (0, 1):
            p = self.table[y][np.arange(self.m)[None, :], neighbour]
            value[y] = np.log(self.prior[y]) + np.log(np.where(b == 1, p, 1 - p)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(value[0] - value[1], -40, 40)))


def _expected(m: int, weigh):
    """(votes, y, n) to sums over documents of each class, pair by pair; weigh gives the probability of class 1."""

    def run(batches):
        total = np.zeros((2, m + 1, m + 1))
        for batch in batches:
            masks, y, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            p = weigh(masks, y)
            b = np.concatenate([(masks[:, None] >> np.arange(m)) & 1, np.ones((len(masks), 1), np.int64)], axis=1).astype(float)
            for k, w in enumerate((1 - p, p)):
                # whole numbers of 1/2^20 documents, so sums do not hang on the order of rows
                total[k] += b.T @ (b * np.round(n * w * (1 << 20))[:, None])
        k, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((k * (m + 1) + i) * (m + 1) + j), pa.array(total[k, i, j].astype(np.int64))], names=["at", "v"])

    return run


def fit_labels(histogram: DataFrame, toxic: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """The label model of histogram (votes, y: the known class or -1, n). toxic: the side each voter takes."""
    m = len(toxic)
    model = LabelModel(m)

    def expect(weigh, rows: DataFrame) -> np.ndarray:
        out = np.zeros(2 * (m + 1) ** 2)
        for r in rows.mapInArrow(_expected(m, weigh), "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"] / (1 << 20)
        return out.reshape(2, m + 1, m + 1)

    known = expect(lambda masks, y: y.astype(float), histogram.where("y >= 0"))
    if known[0, m, m] and known[1, m, m]:
        model.update(known)
    else:
        side = np.where(toxic, 2.0, -1.0)
        model.update(expect(lambda masks, y: 1 / (1 + np.exp(-(((masks[:, None] >> np.arange(m)) & 1) @ side))), histogram))
    for _ in range(rounds):
        before = model.table.copy()
        model.update(expect(lambda masks, y, model=model: np.where(y >= 0, y, model.posterior(masks)), histogram))
        if np.abs(model.table - before).max() < 1e-4:
            break
    return model


def held_out(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class Classifier:
    """Voters, label model and the linear weights of the telling terms."""

    def __init__(self, voters: Voters, labels: LabelModel, weights: np.ndarray, offset: float):
        self.voters, self.labels, self.weights, self.offset = voters, labels, weights, offset

    def score(self, terms) -> np.ndarray:
        """Scores of an Arrow column of term numbers."""
        flat, sizes = np.asarray(terms.flatten()), np.diff(terms.offsets.to_numpy())
        z = self.offset + np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=self.weights[flat], minlength=len(sizes))
        return np.round(1 / (1 + np.exp(-np.clip(z, -700, 700))), 9)


def _drawn(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About `most` of the n rows, by hash of doc_id."""
    million = 1_000_000
    return rows.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(million)) < int(million * min(1.0, most / max(n, 1))))


def fit_weights(train: DataFrame, terms: int) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on train (terms: array<int>, p: probability of class 1)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    sums = train.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    toxic, clean = float(sums[0] or 0), float(sums[1] or 0)
    if toxic < 0.5 or clean < 0.5:
        return np.zeros(terms), 700.0 if toxic > clean else -700.0
    soft = train.select(F.transform("terms", lambda x: x.cast("string")).alias("words"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"))
    rows = soft.select("words", "x.label", "x.weight").where("weight >= 0.001")
    vectors = CountVectorizerModel.from_vocabulary([str(k) for k in range(max(terms, 1))], "words", "features")
    model = LogisticRegression(weightCol="weight", regParam=3e-5, elasticNetParam=0.5, maxIter=60, tol=1e-5, standardization=False).fit(vectors.setBinary(True).transform(rows))
    return model.coefficients.toArray()[:terms], float(model.intercept)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", sample: int = SAMPLE) -> tuple[Classifier, DataFrame]:
    """The classifier, and the table it was made of: doc_id, votes and terms of every row of docs. labels: doc_id, label."""
    work = Work(docs.sparkSession, "toxicity")
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    own = work.table(own.groupBy("doc_id").agg(F.max("y").alias("y")), "labels")
    plain = docs.select("doc_id", F.col(text).alias("text"))
    drawn = F.broadcast(_drawn(own, own.count(), sample, 1))  # about `sample` ids at most
    mined = work.table(plain.join(drawn, "doc_id").select("text", "y"), "labelled")
    voters = Voters(*telling_terms(mined))

    def look():
        return lambda column: voters.columns(column)

    fields = [T.StructField("votes", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]
    known = work.table(with_arrow_columns(plain, ["text"], fields, look).drop("text"), "votes")
    classes = known.join(own, "doc_id", "left").select("doc_id", "votes", "terms", F.coalesce("y", F.lit(-1)).alias("y"))
    histogram = work.table(classes.groupBy("votes", "y").agg(F.count("*").alias("n")), "histogram")
    model = fit_labels(histogram, voters.toxic)

    def posterior():
        return lambda masks, y: [np.where(y.to_numpy() >= 0, y.to_numpy(), model.posterior(masks.to_numpy()))]

    some = with_arrow_columns(_drawn(classes, known.count(), sample, 2), ["votes", "y"], [T.StructField("p", T.DoubleType())], posterior)
    # a bounded sample, however many tasks read it: each step of the fit sends the driver one gradient for each part
    weights, offset = fit_weights(work.table(some.select("terms", "p").repartition(PARTS), "posterior"), len(voters.terms))
    return Classifier(voters, model, weights, offset), known


def with_scores(rows: DataFrame, model: Classifier, column: str, terms) -> tuple[DataFrame, str]:
    """rows with a double column of scores; terms gives Arrow term numbers from the named Arrow column."""
    name = fresh(rows, "_score")
    return with_arrow_columns(rows, [column], [T.StructField(name, T.DoubleType())], lambda: lambda values: [model.score(terms(values))]), name


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text") -> tuple[DataFrame, str]:
    """docs with a double column of scores; its name is returned."""
    model, _ = train(docs, labels, label, text)
    return with_scores(docs, model, text, lambda column: model.voters.columns(column)[1])


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, known = train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    out, score = with_scores(known, model, "terms", lambda column: column)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= CUT).cast("int").alias("predicted"))
