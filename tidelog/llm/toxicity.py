"""Toxicity by nearest labelled examples.

A text is its TF-IDF vector over the words that tell the labels apart by chi-square on the labelled sample and are at
least ``LIFT`` times as frequent under one label (others, such as the common words of a language, are noise that hides
the neighbours of a long text). Their document frequencies are counted over all rows that may be learned from. The ``NEIGHBOURS``
examples of greatest cosine are found exactly with an inverted index in blocks of ``BLOCK`` examples: each
term keeps its largest weight in each block, so a block's upper bound is known before its postings are read,
and blocks are read in order of that bound until it falls below the last neighbour's cosine. Their
votes are weighted by cosine and by class (the sample is drawn by class), and isotonic regression over
leave-one-out votes makes them probabilities. Texts without any term have the rate of such examples.

Learning uses at most ``PER_CLASS`` labelled rows of each class; scoring covers every row. Evidence: the nearest
examples' ids with their cosines.

Edge cases: null and empty texts are scored as texts without terms; repeated rows each get a row; labels with null
toxic or doc_id are not learned from, and of several labels of one id the greatest counts; without any labelled row every score is 0; equal texts of one class are one example; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, id_crc, materialize, table, words_of

PER_CLASS, NEIGHBOURS, BLOCK = 3000, 25, 64
MIN_DF, MIN_CHI2, LIFT = 5, 15.0, 3.0
#: Query vectors remembered per Python worker.
MEMO = 50_000


class BlockMaxIndex:
    """Postings by term and block, with each term's largest weight per block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, block: int = BLOCK):
        order = np.lexsort((ids, -x.max(1, initial=0), x.argmax(1))) if len(x) else np.zeros(0, dtype=int)
        self.ids, self.y, self.block, self.n = ids[order], y[order], block, len(x)
        x = x[order]
        self.blocks = -(-self.n // block)
        term, doc = np.nonzero(x.T)
        self.doc, self.weight = doc.astype(np.int32), x[doc, term].astype(np.float64)
        cell = term.astype(np.int64) * self.blocks + doc // block
        self.start = np.searchsorted(cell, np.arange(x.shape[1] * self.blocks + 1)).reshape(-1)
        self.top = np.zeros((x.shape[1], self.blocks))
        np.maximum.at(self.top.reshape(-1), cell, self.weight)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k best with a positive cosine, best first, ties to the smaller id."""
        bound = weights @ self.top[terms]
        found, scores, kth = [], [], 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] + 1e-9 < kth:
                break
            acc = np.zeros(self.block)
            for t, w in zip(terms, weights, strict=True):
                c = t * self.blocks + b
                lo, hi = self.start[c], self.start[c + 1]
                acc[self.doc[lo:hi] - b * self.block] += w * self.weight[lo:hi]
            at = np.flatnonzero(acc > 0)
            pos = at + b * self.block
            ok = pos != skip
            found.append(pos[ok])
            scores.append(acc[at[ok]])
            if sum(map(len, found)) >= k:
                f, s = np.concatenate(found), np.concatenate(scores)
                best = np.lexsort((self.ids[f], -s))[:k] if len(f) <= 4 * k else np.flatnonzero(s >= np.partition(s, -k)[-k])
                found, scores = [f[best]], [s[best]]
                if len(best) >= k:
                    kth = np.partition(scores[0], -k)[-k]
        if not found:
            return np.zeros(0, dtype=int), np.zeros(0)
        f, s = np.concatenate(found), np.concatenate(scores)
        best = np.lexsort((self.ids[f], -s))[:k]
        return f[best], s[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: thresholds and their values."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        stack.append([a, b, c])
        while len(stack) > 1 and (stack[-2][1] >= stack[-1][1] or stack[-2][0] == stack[-1][0]):
            hi, lo = stack.pop(), stack.pop()
            stack.append([lo[0], (lo[1] * lo[2] + hi[1] * hi[2]) / (lo[2] + hi[2]), lo[2] + hi[2]])
    return np.array([s[0] for s in stack]), np.array([s[1] for s in stack])


class Model:
    def __init__(self, terms: list[bytes], idf: np.ndarray, index: BlockMaxIndex, class_weight: np.ndarray, k: int = NEIGHBOURS):
        self.at = {t: i for i, t in enumerate(terms)}
        self.idf, self.index, self.class_weight, self.k = idf, index, class_weight, k
        self.xs, self.ys, self.blank = np.zeros(1), np.zeros(1), 0.0

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        for i in map(self.at.get, words):
            if i is not None:
                counts[i] = counts.get(i, 0) + 1
        terms = np.array(sorted(counts), dtype=np.int64)
        w = np.array([1 + np.log(counts[t]) for t in terms.tolist()]) * self.idf[terms] if counts else np.zeros(0)
        return terms, w / np.sqrt((w * w).sum()) if counts else w

    def vote(self, terms, weights, skip: int = -1):
        pos, cos = self.index.search(terms, weights, self.k, skip)
        w = cos * self.class_weight[self.index.y[pos]]
        return (float((w * self.index.y[pos]).sum() / w.sum()) if len(pos) else None), pos, cos

    def calibrated(self, vote: float | None) -> float:
        if vote is None:
            return self.blank
        return float(self.ys[max(0, np.searchsorted(self.xs, vote, side="right") - 1)])


def _distinct_words(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [list(set(words_of(raw))) for raw in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["toxic", "words"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, words array<binary>").select("toxic", F.explode("words").alias("word"))


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many have each term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches):
        at = shared.value
        df, n = np.zeros(len(at) + 1, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                for w in at.keys() & words_of(raw):
                    df[at[w]] += 1
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], ["i", "df"])

    got = docs.select("text").mapInArrow(run, "i int, df bigint").groupBy("i").agg(F.sum("df").alias("df")).toPandas().sort_values("i")
    df = got["df"].to_numpy(dtype=float)
    return int(df[-1]), df[:-1]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs: doc_id, text, the rows that may be learned from; labels: doc_id, toxic (0 or 1).

    Ids are sampled without their texts; the sample's ids, 2 * PER_CLASS at most, are then broadcast to fetch the texts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").join(known, "doc_id")
    counts = {r[0]: r[1] for r in ids.groupBy("toxic").count().collect()}
    if not counts:
        return None
    picked = materialize(bounded_sample(ids, "toxic", PER_CLASS, "doc_id"), "picked")
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    sample = materialize(sample.dropDuplicates(["text", "toxic"]), "examples")
    have = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    per = _distinct_words(sample).groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("df"))
    n = float(n0 + n1)
    b = F.col("df") - F.col("a")
    chi2 = n * F.pow(F.col("a") * (n0 - b) - b * (n1 - F.col("a")), 2) / (F.col("df") * (n - F.col("df")) * n0 * n1) if n0 and n1 else F.lit(0.0)
    lift = (F.col("a") + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
    telling = (F.col("df") >= MIN_DF) & (F.col("df") < n) & ((lift >= LIFT) | (lift <= 1 / LIFT))
    best = per.where(telling).withColumn("chi2", chi2).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "word").toPandas()
    terms = [bytes(w) for w in best["word"]]
    rows, df = document_frequencies(docs, terms)
    idf = np.log((rows + 1) / (df + 1)) + 1
    weight = np.array([counts.get(0, 0) / n0 if n0 else 1.0, counts.get(1, 0) / n1 if n1 else 1.0])
    model = Model(terms, idf, None, weight)

    def run(batches):
        for batch in batches:
            got = [model.vector(words_of(raw)) for raw in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["doc_id", "toxic", "t", "w"])

    vectors = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, t array<bigint>, w array<double>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    x = np.zeros((len(vectors), len(terms)))
    for i, (t, w) in enumerate(zip(vectors["t"], vectors["w"], strict=True)):
        x[i, np.asarray(t, dtype=int)] = w
    y, ids = vectors["toxic"].to_numpy(dtype=int), vectors["doc_id"].to_numpy(dtype=np.int64)
    some = x.any(1)
    model.index = BlockMaxIndex(x[some], ids[some], y[some])
    blank = weight[y[~some]]
    model.blank = float((blank * y[~some]).sum() / blank.sum()) if len(blank) else float(counts.get(1, 0) / sum(counts.values()))
    votes, truth, mass, memo = [], [], [], {}
    xs = x[some][np.lexsort((ids[some], -x[some].max(1, initial=0), x[some].argmax(1)))] if some.any() else x[some]
    for i in range(model.index.n):
        t = np.flatnonzero(xs[i])
        v, _, _ = model.vote(t, xs[i][t], skip=i)
        if v is not None:
            votes.append(v)
            truth.append(model.index.y[i])
            mass.append(weight[model.index.y[i]])
    if votes:
        model.xs, model.ys = isotonic(np.array(votes), np.array(truth, dtype=float), np.array(mass))
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str], evidence: int = 3) -> DataFrame:
    """``keep`` columns, score, predicted, evidence (array of (doc_id, cosine))."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, memo = shared.value, {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for b in batches:
            scores, why = [], []
            for raw in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                if m is None:
                    scores.append(0.0)
                    why.append([])
                    continue
                terms, weights = m.vector(words_of(raw))
                key = terms.tobytes() + weights.tobytes()
                if key not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    v, pos, cos = m.vote(terms, weights) if len(terms) else (None, [], [])
                    memo[key] = m.calibrated(v), [{"doc_id": int(m.index.ids[p]), "cosine": float(c)} for p, c in zip(pos[:evidence], cos[:evidence], strict=True)]
                s, e = memo[key]
                scores.append(s)
                why.append(e)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(why, kind)], [*keep, "score", "predicted", "evidence"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_crc("doc_id") % 5 == 0)
    return score(docs, train(docs.where("NOT held_out"), table(spark, sf_dir, "labels")), ["doc_id", "held_out"])
