"""Language identification with error-correcting output codes.

Each language has a codeword; one linear classifier per bit, over hashed 2- and 3-byte-grams of the lower-cased
letters, predicts that bit. Decoding is loss-weighted: a language's loss is the sum over bits of the logistic loss
of the bit's margin against its codeword, weighted by how well that bit did on rows kept aside. The nearest codeword wins; a
small gap to the second flags ambiguity.

Learning uses a sample of labelled rows bounded by ``PER_LANGUAGE`` and, over all languages in turn, ``MAX_ROWS``; their n-gram counts, made on
executors from whole texts, are what the driver gets, as sparse rows. Every ``ASIDE``-th row of each language is kept
aside. Scoring covers every row.

Edge cases: ``und`` with score 0 if the text is null or has no letter, or if no labelled row exists; rows
with null lang are not learned from; with a single language that one is always chosen. One row out per row in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_sample, id_crc, table

DIM_BITS = 14
DIM = 1 << DIM_BITS
PER_LANGUAGE, MAX_ROWS, ASIDE = 400, 4096, 5
#: Texts whose probability gap to the second language is smaller are flagged.
AMBIGUOUS = 0.1
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(raw: bytes) -> bool:
    if any(97 <= b <= 122 for b in raw[:64].translate(_LETTERS)):
        return True
    return any(c.isalpha() for c in raw.decode())


def gram_counts(raw: bytes) -> np.ndarray:
    """Counts of hashed 2- and 3-byte-grams of a whole text, over DIM cells."""
    a = np.frombuffer(b" " + raw.translate(_LETTERS) + b" ", dtype=np.uint8).astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + a[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - DIM_BITS)
    out = np.bincount((two * np.uint32(0x27D4EB2F)) >> shift, minlength=DIM)
    out += np.bincount((three * np.uint32(0x165667B1)) >> shift, minlength=DIM)
    return out


def features(raw: bytes) -> np.ndarray:
    x = np.sqrt(gram_counts(raw).astype(np.float32))
    return x / np.sqrt((x * x).sum())


def codewords(n: int, seed: int = 8) -> np.ndarray:
    """n rows of +1/-1: all columns up to seven languages, else random dense ones of 15 bits and more, well apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        cols = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols).T
    rng, bits = np.random.default_rng(seed), max(15, int(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(64):
        m = rng.choice([-1, 1], size=(n, bits))
        d = (bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)
        ok = np.abs(m.sum(0)) < n
        if ok.all() and d.min() > gap:
            best, gap = m, d.min()
    return best if best is not None else np.vstack([m])


class Model:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.bias, self.trust = languages, codes, weights, bias, trust

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        loss = (self.trust * np.logaddexp(0, -self.codes[None, :, :] * margins[:, None, :])).sum(2)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


class Rows:
    """Sparse rows of unit length: the cells and values of row r are at start[r] to start[r + 1]."""

    BLOCK = 256

    def __init__(self, start: np.ndarray, cell: np.ndarray, value: np.ndarray):
        self.start, self.cell = start, cell
        lengths = np.sqrt(np.add.reduceat(value * value, start[:-1]))
        self.value = value / np.repeat(lengths, np.diff(start))

    def blocks(self, lo: int, hi: int):
        """(slice, dense rows) of at most BLOCK rows each: no more than one block is ever dense."""
        for at in range(lo, hi, self.BLOCK):
            end = min(at + self.BLOCK, hi)
            out = np.zeros((end - at, DIM), dtype=np.float32)
            inside = slice(self.start[at], self.start[end])
            out[np.repeat(np.arange(end - at), np.diff(self.start[at : end + 1])), self.cell[inside]] = self.value[inside]
            yield slice(at, end), out


def fit(x: Rows, y: np.ndarray, languages: list[str], cut: int, steps: int = 120, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """Full-batch logistic regression per bit with momentum; the rows from ``cut`` on weigh the bits and are not fitted."""
    codes = codewords(len(languages))
    t = codes[y]
    share = np.bincount(y[:cut], minlength=len(languages)).astype(float)
    each = (1 / np.maximum(share, 1))[y[:cut]][:, None] / len(languages)
    w, b = np.zeros((DIM, codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        gw, gb = decay * w, np.zeros_like(b)
        for s, rows in x.blocks(0, cut):
            g = -t[s] / (1 + np.exp(np.clip(t[s] * (rows @ w + b), -30, 30))) * each[s]
            gw += rows.T @ g.astype(np.float32)
            gb += g.sum(0)
        vw = 0.9 * vw - rate * 0.1 * gw
        vb = 0.9 * vb - rate * 0.1 * gb
        w, b = w + vw.astype(np.float32), b + vb
    first = cut if cut < len(y) else 0
    n = len(y) - first
    right = sum((((rows @ w + b) * t[s]) > 0).sum(0) for s, rows in x.blocks(first, len(y))) / n
    trust = np.log((right * n + 1) / ((1 - right) * n + 1)).clip(0.1)
    return Model(languages, codes, w, b, trust / trust.mean())


def train(docs: DataFrame) -> Model | None:
    """docs: text, lang and anything else; which rows to learn from is the caller's choice."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("text", "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text")))
    picked = bounded_sample(rows, "lang", PER_LANGUAGE).withColumn("r", place).orderBy("r", "lang").limit(MAX_ROWS)

    def run(batches):
        for b in batches:
            idx, val = [], []
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                c = gram_counts(raw)
                i = np.flatnonzero(c)
                idx.append(i.astype(np.int32))
                val.append(np.sqrt(c[i]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "r", "i", "v"])

    got = picked.select("text", "lang", "r").mapInArrow(run, "lang string, r int, i array<int>, v array<float>").toArrow()
    if not got.num_rows:
        return None
    aside = np.asarray(got["r"]) % ASIDE == 0
    got = got.append_column("aside", pa.array(aside)).sort_by([("aside", "ascending"), ("r", "ascending"), ("lang", "ascending")]).combine_chunks()
    named = got["lang"].to_pylist()
    languages = sorted(set(named))
    cells, values = (got[c].combine_chunks() for c in ("i", "v"))
    start = np.append(0, np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False)))
    x = Rows(start, cells.flatten().to_numpy(), values.flatten().to_numpy())
    y = np.searchsorted(languages, named)
    del got, cells, values
    return fit(x, y, languages, len(y) - int(aside.sum()))


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but text unless given), lang_pred, score, second, ambiguous."""
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at_text = src.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            for lo in range(0, max(1, b.num_rows), 512):
                part = b.slice(lo, 512)
                pred, score, second, unsure = [], [], [], []
                raws = part.column(at_text).cast(pa.binary()).to_pylist()
                usable = [i for i, raw in enumerate(raws) if m is not None and raw and has_letter(raw)]
                at = {i: k for k, i in enumerate(usable)}
                if usable:
                    p = m.probabilities(np.stack([features(raws[i]) @ m.weights for i in usable]) + m.bias)
                    order = np.argsort(-p, axis=1, kind="stable")
                for i in range(len(raws)):
                    if i in at:
                        q, o = p[at[i]], order[at[i]]
                        pred.append(m.languages[o[0]])
                        score.append(float(q[o[0]]))
                        second.append(m.languages[o[1]] if len(o) > 1 else None)
                        unsure.append(len(o) > 1 and bool(q[o[0]] - q[o[1]] < AMBIGUOUS))
                    else:
                        pred.append("und")
                        score.append(0.0)
                        second.append(None)
                        unsure.append(True)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(unsure, pa.bool_())], [*keep, "lang_pred", "score", "second", "ambiguous"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return src.mapInArrow(run, f"{kinds}lang_pred string, score double, second string, ambiguous boolean")


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_crc("doc_id") % 3 == 1)
    return identify(docs, train(docs.where("NOT held_out")), ["doc_id", "held_out"])
