"""Log-bilinear language model, trained by noise-contrastive estimation (NCE) in numpy.

Exact counts of every training word are gathered first (``word_counts``). The ``WORDS`` most frequent words and the end
are outcomes of their own; all others fall into classes by their last three bytes, the ``SUFFIXES`` heaviest and one for the rest.
The model predicts the outcome from the ``ORDER`` tokens before it and the mean of all tokens before it in the text::

    h_t = sum_i T_i[o_{t-i}] + mean_{j<t} U[o_j]        P(o | h) = softmax(Q h + b)

and within a class a word has the probability (c + 1) / (sum of c + 1 over the class's words, + 1 for an unknown
one). So P is normalised over all training words and one unknown word per class. Scores are batched matrix products over all outcomes.

Training is iterative parameter mixing: each task runs NCE with AdaGrad over its training texts, and the results are
averaged by tokens, ``ROUNDS`` times. Every training text is learned from in each round.

Words that make up 1 / FREQUENT of all tokens or more (at most FREQUENT of them) are known to every task; the counts of
others are joined by their 64-bit hash, which tells words apart but for one pair in 10^19.

Edge cases: null and empty texts are one end token; repeated rows each get a row and train each; null ids count as the empty text
in the split. Without training rows the model is uniform over its outcomes. An empty table gives an empty result. Columns to
keep may have any name.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import LOWER_BYTES, fresh, id_crc, materialize, table

WORDS, SUFFIXES, DIM, ORDER = 384, 126, 16, 4
OUT = 1 + WORDS + SUFFIXES + 1
END, REST = 0, OUT - 1
ROUNDS, RATE, NOISE, SHARED_NOISE = 2, 0.15, 10, 96
#: Tokens that are learned from or scored together, at least; a longer text than STRETCH goes in stretches, which know what came before.
BATCH, STRETCH = 2048, 1 << 15
FREQUENT = 1 << 20
#: Tokens whose outcomes are weighed at once: the block stays in a core's cache.
BLOCK = 64
#: Longer words are known by a digest.
LONG = 48
#: Words a task counts before it hands on what it has.
HELD_WORDS = 400_000
#: Bytes below which an array's memory stays with the process (see ``keep_heap``); the allocator follows up to 2^25.
HEAP = 1 << 24


def keep_heap() -> None:
    """Memory of freed arrays stays with the process, 2 * HEAP at most. Otherwise each batch gives it back and faults in new pages.

    glibc maps no block smaller than the largest mapped one that was freed, and trims from twice that size on. No page of this one is touched.
    """
    np.empty(HEAP, dtype=np.uint8)


def running_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the rows so far, in place. Columns go in pairs, as complex numbers, which takes half the steps."""
    pairs = x.view(np.complex64 if x.dtype == np.float32 else np.complex128)
    np.add.accumulate(pairs, axis=0, out=pairs)
    return x


def sums_from(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of float32 rows from each of ``first`` up to the next, columns in pairs."""
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)


def tokens_of(raw: bytes | None) -> list[bytes]:
    """Words of a text, without the end."""
    if not raw:
        return []
    ws = raw.translate(LOWER_BYTES).split()
    if max(map(len, ws), default=0) > LONG:
        import hashlib

        ws = [w if len(w) <= LONG else b" " + hashlib.md5(w).digest() + w[-3:] for w in ws]
    return ws


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end is the empty word."""

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            raws = b.column(0).cast(pa.binary()).to_pylist()
            counts[b""] += len(raws)
            for raw in raws:
                counts.update(tokens_of(raw))
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts = Counter()
        if counts:
            yield flush(counts)

    return docs.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """frequent: word -> place; class_of, count: by place. suffix: last bytes -> class. log_mass: by outcome, 0 for single words."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(total[0] or 0), int(total[1])
        often = counts.where(F.col("c") * FREQUENT >= self.n).toPandas()
        often["word"] = often["word"].map(bytes)
        often = often.sort_values(["c", "word"], ascending=[False, True], kind="stable").reset_index(drop=True)
        top = often[often["word"] != b""].head(WORDS)
        suffix = F.when(F.length("word") <= 3, F.col("word")).otherwise(F.expr("substring(word, -3, 3)"))
        known = set(top["word"]) | {b""}
        masses = counts.where(F.length("word") > 0).groupBy(suffix.alias("s")).agg(F.sum(F.col("c") + 1).alias("m"))
        by_suffix = {bytes(r[0]): int(r[1]) for r in masses.orderBy(F.desc("m"), "s").limit(SUFFIXES + WORDS).collect()}
        everything = self.n + self.v - sum(int(c) + 1 for w, c in zip(often["word"], often["c"], strict=True) if w in known)
        for w, c in zip(top["word"], top["c"], strict=True):
            if w[-3:] in by_suffix:
                by_suffix[w[-3:]] -= int(c) + 1
        kept = sorted(by_suffix.items(), key=lambda x: (-x[1], x[0]))[:SUFFIXES]
        kept = [(s, m) for s, m in kept if m > 0]
        self.suffix = {s: 1 + WORDS + i for i, (s, _) in enumerate(kept)}
        self.log_mass, weight = np.zeros(OUT), np.zeros(OUT)
        for s, m in kept:
            self.log_mass[self.suffix[s]] = np.log10(m + 1)
            weight[self.suffix[s]] = m
        rest = everything - sum(m for _, m in kept)
        self.log_mass[REST], weight[REST] = np.log10(rest + 1), rest
        outcome = {w: 1 + i for i, w in enumerate(top["word"])}
        self.frequent, self.class_of, self.count = {}, np.zeros(len(often), dtype=np.int32), often["c"].to_numpy(dtype=np.int64)
        for i, (w, c) in enumerate(zip(often["word"], often["c"], strict=True)):
            self.class_of[i] = END if w == b"" else outcome.get(w, self.suffix.get(w[-3:], REST))
            if w == b"" or w in outcome:
                weight[self.class_of[i]] = c
            if w != b"":
                self.frequent[w] = i
        self.end_count = int(often.loc[often["word"] == b"", "c"].sum())
        if not self.end_count and self.n:
            self.end_count = int(counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0)
        self.log_count = np.log10(self.count + 1.0)
        self.q = (weight + 1) / (weight + 1).sum()

    def read(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in frequent (-1 if not there), outcomes with the end, and the positions of words not there."""
        place = np.fromiter(map(self.frequent.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        out = np.empty(len(ws) + 1, dtype=np.int64)
        out[-1] = END
        rare = np.flatnonzero(place < 0)
        if len(self.class_of):
            out[:-1] = self.class_of[place]
        get = self.suffix.get
        out[rare] = [get(ws[i][-3:], REST) for i in rare.tolist()]
        return place, out, rare


class Net:
    """The parameters, as one flat vector. Row OUT of a table stands for "before the text"."""

    SHAPES = [(ORDER, OUT + 1, DIM), (OUT, DIM), (OUT, DIM), (OUT,)]
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat, at, parts = flat, 0, []
        for s in self.SHAPES:
            n = int(np.prod(s))
            parts.append(flat[at : at + n].reshape(s))
            at += n
        self.near, self.far, self.out, self.bias = parts

    @classmethod
    def start(cls, q: np.ndarray, seed: int = 4) -> "Net":
        net = cls((np.random.default_rng(seed).standard_normal(cls.SIZE) * 0.1).astype(np.float32))
        net.bias[:] = np.log(q)
        return net

    def context(self, o: np.ndarray, pos: np.ndarray, begun: "Begun | None" = None) -> tuple[np.ndarray, np.ndarray]:
        """h for every token, and 1 / how many came before it. ``o``: texts one after another; ``pos``: places in them.

        ``begun``: what stands before the first token, where that is not the start of a text.
        """
        n = len(o)
        led = np.concatenate([np.full(ORDER, OUT) if begun is None else begun.last, o])
        for i in range(ORDER):
            before = led[ORDER - 1 - i : ORDER - 1 - i + n]
            if begun is None:
                before = np.where(pos <= i, OUT, before)
            row = self.near[i].take(before, axis=0)
            h = row if i == 0 else np.add(h, row, out=h)
        share = (1 / np.maximum(pos, 1)).astype(np.float32)
        row = self.far.take(o, axis=0)
        past = running_sum(row.astype(np.float64))
        past -= row
        past -= past.take(np.maximum(np.arange(n) - (pos - pos[0] if begun else pos), 0), axis=0)
        if begun is not None:
            past += begun.total
            begun.add(o, row)
        h += (past * share[:, None]).astype(np.float32)
        return h, share

    def log10(self, o: np.ndarray) -> float:
        """Normalised log10 probability of a text's outcomes."""
        return float(self.log10_all([o])[0])

    def log10_all(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised log10 probabilities of texts, over blocks of tokens: one matrix product and one exponential each."""
        out, weights, base = np.zeros(len(texts)), np.ascontiguousarray(self.out.T), np.exp(self.bias)
        most, block = np.abs(self.out).max(0), np.empty((BLOCK, OUT), dtype=np.float32)
        for which, o, pos, begun in stretches(texts):
            h, _ = self.context(o, pos, begun)
            sums, tops = np.empty(len(o)), np.zeros(len(o), dtype=np.float32)
            # no exponential overflows or vanishes while no logit can be far from 0; then sum e^(z + b) = e^z . e^b
            far = float((np.abs(h) @ most).max() + np.abs(self.bias).max()) > 60
            for lo in range(0, len(o), BLOCK):
                part = h[lo : lo + BLOCK]
                z = np.matmul(part, weights, out=block[: len(part)])
                if far:
                    z += self.bias
                    tops[lo : lo + BLOCK] = z.max(1)
                    z -= tops[lo : lo + BLOCK, None]
                np.exp(z, out=z)
                sums[lo : lo + BLOCK] = z.sum(1, dtype=np.float64) if far else z @ base
            got = np.einsum("ij,ij->i", h, self.out.take(o, axis=0)).astype(np.float64)
            got += self.bias[o]
            got -= tops
            got -= np.log(sums)
            out += np.bincount(which, weights=got, minlength=len(texts))
        return out / np.log(10)


class Begun:
    """What of a long text stands before a stretch of it: its last tokens, and the sum of ``far`` over all of them."""

    def __init__(self):
        self.last, self.total = np.full(ORDER, OUT), np.zeros(DIM)

    def add(self, o: np.ndarray, rows: np.ndarray) -> None:
        self.last = np.concatenate([self.last, o])[-ORDER:]
        self.total = self.total + rows.sum(0, dtype=np.float64)


def stretches(texts: list[np.ndarray]):
    """(text of each token, outcomes, places, begun): short texts together, BATCH tokens or more; longer ones than STRETCH in stretches, in order."""
    held, size = [], 0
    for i, o in enumerate(texts):
        if len(o) > STRETCH:
            begun = Begun()
            for lo in range(0, len(o), STRETCH):
                part = o[lo : lo + STRETCH]
                yield np.full(len(part), i), part, np.arange(lo, lo + len(part)), begun
            continue
        held.append(i)
        size += len(o)
        if size >= BATCH:
            yield _together(texts, held)
            held, size = [], 0
    if held:
        yield _together(texts, held)


def _together(texts: list[np.ndarray], held: list[int]):
    lengths = np.array([len(texts[i]) for i in held])
    first = np.cumsum(lengths) - lengths
    return np.repeat(held, lengths), np.concatenate([texts[i] for i in held]), np.arange(lengths.sum()) - np.repeat(first, lengths), None


class Trainer:
    def __init__(self, net: Net, q: np.ndarray, seed: int):
        keep_heap()
        self.net, self.rng = net, np.random.default_rng(seed)
        self.cum, self.log_kq = np.cumsum(q), np.log(NOISE * q).astype(np.float32)
        self.squares, self.tokens = Net(np.full(Net.SIZE, 1e-2, dtype=np.float32)), 0

    def learn(self, o: np.ndarray, pos: np.ndarray, begun: Begun | None = None) -> None:
        """One NCE step with AdaGrad over texts that stand one after another (or a stretch of a long one)."""
        net, n = self.net, len(o)
        h, share = net.context(o, pos, begun)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(SHARED_NOISE)), OUT - 1)
        own, other = net.out.take(o, axis=0), net.out[noise]
        s = np.einsum("ij,ij->i", h, own) + (net.bias - self.log_kq)[o]
        hx = np.empty((n, DIM + 1), dtype=np.float32)
        hx[:, :DIM], hx[:, DIM] = h, 1
        gx = hx @ -np.vstack([other.T, net.bias[noise] - self.log_kq[noise]])
        g = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        with np.errstate(over="ignore"):  # a probability of 0
            np.exp(gx, out=gx)
        gx += 1
        np.divide(np.float32(-NOISE / SHARED_NOISE), gx, out=gx)
        dh = own * g[:, None]
        dh += gx @ other
        # What each token's rows get: from the ORDER tokens after it, from all after it in its text, and as an outcome.
        place = pos - pos[0] if begun is not None else pos
        last = np.append(np.flatnonzero(place == 0)[1:] - 1, n - 1)
        last = np.repeat(last, np.diff(np.append(-1, last)))
        sums = running_sum(dh * share[:, None])
        parts = np.zeros((3 * n + 1, DIM), dtype=np.float32)
        parts[:n] = dh
        np.subtract(sums.take(last, axis=0), sums, out=parts[n : 2 * n])
        np.multiply(h, g[:, None], out=parts[2 * n : 3 * n])
        order = np.argsort(o.astype(np.int16), kind="stable")
        at = o[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        which, end = np.empty((n, ORDER + 2), dtype=np.int64), last[order]
        for i in range(ORDER):
            after = order + (i + 1)
            which[:, i] = np.where(after <= end, after, 3 * n)
        which[:, ORDER], which[:, ORDER + 1] = order + n, order + 2 * n
        each = sums_from(parts.take(which, axis=0).reshape(n, -1), first).reshape(len(first), ORDER + 2, DIM)
        d = Net(np.zeros(Net.SIZE, dtype=np.float32))
        early = np.flatnonzero(pos < ORDER)
        for i in range(ORDER):
            d.near[i][at[first]] = each[:, i]
            if begun is None:
                d.near[i][OUT] = dh[early[pos[early] <= i]].sum(0)
        d.far[at[first]], d.out[at[first]] = each[:, ORDER], each[:, ORDER + 1]
        of_noise = gx.T @ hx
        np.add.at(d.out, noise, of_noise[:, :DIM])
        d.bias[:] = np.bincount(np.concatenate([o, noise]), weights=np.concatenate([g, of_noise[:, DIM]]), minlength=OUT)
        d = d.flat
        d /= np.float32(np.sqrt(n))
        self.squares.flat += d * d
        net.flat += np.float32(RATE) * d / np.sqrt(self.squares.flat)
        self.tokens += n


def numbered(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` columns, text and a number of each row, and the names of all but the text. Write it before the number is used twice."""
    rid = fresh(keep, "rid")
    return docs.select(*keep, "text").withColumn(rid, F.monotonically_increasing_id()), [*keep, rid]


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep`` columns; each text's outcomes (little-endian u16, with the end); counts and base terms of frequent words; hashes of the others."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import xxhash

        keep_heap()
        v = words.value
        h64, end = xxhash.xxh64_intdigest, np.log10(v.end_count + 1)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n, known, sure, within, hashes, codes = [], [], [], [], [], []
                for raw in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist():
                    ws = tokens_of(raw)
                    place, o, rare = v.read(ws)
                    at = place[place >= 0] if len(rare) else place
                    logs = v.log_count[at]
                    inside = logs[v.class_of[at] > WORDS].sum() if len(logs) else 0.0
                    n.append(len(o))
                    known.append(len(ws) - len(rare) + (v.end_count > 0))
                    sure.append(float(logs.sum() + end))
                    within.append(float(inside - v.log_mass[o].sum()))
                    hashes.append(np.array([h64(ws[i], 42) for i in rare.tolist()], dtype=np.uint64).view(np.int64))
                    codes.append(o.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sure, pa.float64()), pa.array(within, pa.float64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(codes, pa.binary())], [*keep, "n_tokens", "known", "sure", "within", "rare", "codes"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}n_tokens bigint, known bigint, sure double, within double, rare array<bigint>, codes binary")


def _outcomes(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int64) for x in column.to_pylist()]


def fit(encoded: DataFrame, vocabulary: Vocabulary) -> Net:
    """encoded: codes of the training texts; each is trained on, whole, in every round."""
    spark = encoded.sparkSession
    net, q = Net.start(vocabulary.q), vocabulary.q
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(net.flat)

        def run(batches, now=now, turn=turn):
            t = Trainer(Net(now.value.copy()), q, turn)
            for b in batches:
                for _, o, pos, begun in stretches(_outcomes(b.column(0))):
                    t.learn(o, pos, begun)
            if t.tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(Net.SIZE), pa.int32()), pa.array(t.net.flat.astype(np.float64) * t.tokens), pa.array(np.full(Net.SIZE, float(t.tokens)))], ["i", "x", "n"])

        mixed = encoded.select("codes").mapInArrow(lambda batches, f=run: f(batches), "i int, x double, n double").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        if mixed.empty:  # nothing to learn from
            net.near[:], net.far[:], net.out[:] = 0, 0, 0
            return net
        flat = net.flat.copy()
        flat[mixed["i"].to_numpy(dtype=int)] = mixed["x"].to_numpy()
        net = Net(flat)
    return net


def train(docs: DataFrame, vocabulary: Vocabulary) -> Net:
    """docs: training rows; each is trained on."""
    return fit(materialize(encode(docs, vocabulary, []).select("codes"), "codes"), vocabulary)


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Net, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score."""
    plain = [f"__{i}" for i in range(len(keep))]  # no name can clash with one in between
    rows, names = numbered(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, plain, strict=True)], "text"), plain)
    got = score_encoded(materialize(encode(rows, vocabulary, names), "read"), counts, vocabulary, net, plain)
    return got.toDF(*keep, *got.columns[len(keep) :])


def score_encoded(encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Net, keep: list[str]) -> DataFrame:
    """The same, of what ``encode`` made of ``numbered`` rows, written."""
    params = encoded.sparkSession.sparkContext.broadcast(net.flat)

    def run(batches):
        keep_heap()
        net = Net(params.value)
        for b in batches:
            model = net.log10_all(_outcomes(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model, pa.float64())], [*b.schema.names[:-1], "model"])

    rid = fresh(keep, "rid")
    passed = encoded.drop("rare")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema.fields if f.name != "codes")
    read = passed.mapInArrow(run, f"{kinds}, model double")
    seldom = counts.where(F.col("c") * FREQUENT < vocabulary.n).select(F.xxhash64("word").alias("w"), F.log10(F.col("c") + 1.0).alias("x"))
    rare = encoded.select(rid, F.explode("rare").alias("w")).join(seldom, "w").groupBy(rid).agg(F.sum("x").alias("x"), F.count("*").alias("k"))
    norm = float(np.log10(vocabulary.n + vocabulary.v + 1))
    x = F.coalesce("x", F.lit(0.0))
    return read.join(rare, rid, "left").select(
        *keep,
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("sure") + x - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("model") + F.col("within") + x).alias("score"),
    )


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", id_crc("doc_id") % 7 == 2)
    counts = materialize(word_counts(docs.where("NOT held_out")), "counts")
    vocabulary = Vocabulary(counts)
    keep = ["doc_id", "held_out"]
    rows, names = numbered(docs, keep)
    encoded = materialize(encode(rows, vocabulary, names), "encoded")
    return score_encoded(encoded, counts, vocabulary, fit(encoded.where("NOT held_out"), vocabulary), keep)
