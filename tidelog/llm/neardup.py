"""Near-duplicate groups by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. A text's shingles are its runs of five words. A shingle's weight is its count in the text times
   an inverse document frequency. Frequencies are counted over all documents in ``CELLS`` hashed cells; the idf runs from 1 (in all
   documents) to ``IDF_TOP`` (in at most 1 of ``RARE``), a narrow range, so that the passages that make copies of each other
   frequent do not by that make those copies dissimilar. Cells with frequencies above 1 / RARE are few at every size.
2. ICWS draws ``BANDS * ROWS`` samples of each distinct text: samples of two texts agree with the probability of
   their weighted Jaccard similarity. Each band of ROWS samples is one key.
3. In each key's bucket every member meets one centre only, the member that meets others most often, and the pair is
   verified by the exact weighted Jaccard similarity. Where a member fails there, other members may still be its copies: all texts
   of such buckets are joined by a prefix filter, which loses no pair of the wanted similarity. A text's shingles are put
   in order of their frequency among these texts; two texts that are similar enough share one of the first, rarest, few. Only
   pairs of different classes, of sizes and places in that order that leave the similarity possible, are verified.
4. Verified links make classes by connected components. Equal texts are one node from the start.

Repeated passes over the texts replace shuffling their shingles. Samples per text are what is shuffled, and whole texts
only of those with a bucket mate.

Edge cases: null and empty texts, and texts without words, are never near-duplicates; equal ones without words but with characters
are copies. A text of one to four words is one shingle. Rows with a null doc_id are a class of their own (class_id null).
Ties: the class id is the least doc_id. Repeated rows are copies. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, materialize, salted_join, table, words_of
from tidelog.llm.components import roots_of, star_forest

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
CELL_BITS, RARE, IDF_TOP = 18, 64, 1.5
CELLS = 1 << CELL_BITS
#: Bits of the map of rows to fetch or to judge; what rounding may add to a weight; parts of a text's weight.
MATE_BITS, SLACK, SKETCH = 1 << 25, 1e-5, 48
#: Pairs of one centre that meet in one task; shingles that every task may know.
FAN, HOT = 200, 4096
_rng = np.random.default_rng(1)
_WORD = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _gamma_two() -> np.ndarray:
    """65,536 equally likely values of a Gamma(2, 1) variable: its quantiles at the middles of as many steps."""
    x = np.linspace(0, 40, 2_000_001)
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_R = _gamma_two()
_LOG_C = np.log(_R)


def shingles(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    ws = words_of(raw)
    if not ws:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    c = np.fromiter(map(zlib.crc32, ws), dtype=np.uint64, count=len(ws))
    k = min(SHINGLE, len(c))
    m = len(c) - k + 1
    h = np.full(m, k, dtype=np.uint64)
    for j in range(k):
        h += _mix(c[j : j + m] * _WORD[j]) * _WORD[-1 - j]
    return np.unique(_mix(h), return_counts=True)


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def icws(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One 64-bit sample (element and its quantised level) for each of BANDS * ROWS draws."""
    k = len(_A)
    log_w = np.log(weight).astype(np.float32)[:, None]
    least, level, pick = np.full(k, np.inf, dtype=np.float32), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.uint64)
    for lo in range(0, len(h), 512):
        z = h[lo : lo + 512, None] * _A + _B
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(29)
        u = z.view(np.uint16).reshape(len(z), k, 4)
        r, log_c = _R[u[:, :, 1]], _LOG_C[u[:, :, 2]]
        beta = (u[:, :, 3].astype(np.float32) + np.float32(0.5)) / np.float32(65536)
        t = np.floor(log_w[lo : lo + 512] / r + beta)
        a = log_c - r * (t - beta + 1)
        i = a.argmin(0)
        best = a[i, np.arange(k)]
        better = best < least
        least = np.where(better, best, least)
        level = np.where(better, t[i, np.arange(k)].astype(np.int64), level)
        pick = np.where(better, h[lo + i], pick)
    return _mix(pick ^ (level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def bands_of(samples: np.ndarray) -> np.ndarray:
    s = samples.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return out.view(np.int64)


def weighted_jaccard(a, b, idf: np.ndarray) -> float:
    (ha, ca), (hb, cb) = a, b
    wa, wb = ca * idf[cells_of(ha)], cb * idf[cells_of(hb)]
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high else 0.0


def idf_table(docs: DataFrame) -> np.ndarray:
    """The idf of each cell. Only cells in more than 1 / RARE of the documents come to the driver."""

    def run(batches):
        count = np.zeros(CELLS, dtype=np.int64)
        n = 0
        for b in batches:
            n += b.num_rows
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                count[np.unique(cells_of(shingles(raw)[0]))] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(count[at], n), pa.int64())], ["cell", "n"])

    counts = materialize(docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "cells")
    total = (counts.where("cell = -1").agg(F.sum("n")).first()[0]) or 0
    often = counts.where((F.col("cell") >= 0) & (F.col("n") * RARE > total)).toPandas()
    idf = np.full(CELLS, IDF_TOP)
    share = np.minimum(1.0, often["n"].to_numpy(dtype=float) / max(total, 1))
    idf[often["cell"].to_numpy(dtype=int)] = 1 + (IDF_TOP - 1) * -np.log(np.maximum(share, 1 / RARE)) / np.log(RARE)
    return idf.astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, bands) for each text with words; node is the text's digest. ``docs``: node, text."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        w = shared.value
        seen: dict[bytes, bool] = {}
        for b in batches:
            nodes, bands = [], []
            for node, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen[node] = True
                h, c = shingles(raw)
                if len(h):
                    nodes.append(node)
                    bands.append(bands_of(icws(h, c * w[cells_of(h)])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["node", "bands"])

    return docs.select("node", "text").mapInArrow(run, "node string, bands array<bigint>")


def _crowded(keys: DataFrame) -> DataFrame:
    """keys (k, node) -> (k, node, deg) in buckets of two or more; deg: how often a node meets another one in any of them."""
    sizes = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(salted_join(keys, sizes, ["k"], "inner", 8), "crowded")
    out = materialize(rows.join(rows.groupBy("node").agg(F.sum("n").alias("deg")), "node").select("k", "node", "deg"), "members")
    discard(rows)
    return out


def _star(rows: DataFrame) -> DataFrame:
    """(k, node, centre): each row with its bucket's centre, the one of greatest deg and node."""
    centres = rows.groupBy("k").agg(F.max(F.struct("deg", "node"))["node"].alias("centre"))
    return materialize(salted_join(rows.select("k", "node"), centres, ["k"], "inner", 8).where("node <> centre"), "met")


def _may_be_in(wanted: DataFrame) -> Column:
    """Whether a row's (doc_id, node) may be among the wanted ones, by a bitmap of fixed size: true for all that are, and for few others."""
    cell = F.pmod(F.xxhash64("doc_id", "node"), F.lit(MATE_BITS))
    set_ = wanted.groupBy((cell / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("v")).toPandas()
    bits = np.zeros(MATE_BITS // 64, dtype=np.int64)
    bits[set_["w"].to_numpy(dtype=int)] = set_["v"].to_numpy(dtype=np.int64)
    shared = wanted.sparkSession.sparkContext.broadcast(bits.tobytes())

    @F.arrow_udf("boolean")
    def is_set(cells: pa.Array) -> pa.Array:
        bitmap, c = np.frombuffer(shared.value, dtype=np.uint8), cells.to_numpy()
        return pa.array(((bitmap[c >> 3] >> (c & 7).astype(np.uint8)) & 1).astype(bool))

    return is_set(cell)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (doc_id, node), one doc_id for each node. Only their rows, and few others, reach the join."""
    near = docs.select("doc_id", "node", "text").where(_may_be_in(wanted)).join(wanted, ["doc_id", "node"], "left_semi")
    # By the keys of the join, so that the texts are not shuffled once more.
    return materialize(near.dropDuplicates(["doc_id", "node"]).select("node", "text"), "texts")


def _verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(centre, node, similarity) of distinct pairs; a centre with many pairs is dealt over several tasks."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    fan = materialize(pairs.groupBy("centre").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan")), "fan")
    # A stream of rows in which each centre's text comes once, before those of its pairs: no text is repeated per pair.
    left = texts.join(fan, texts["node"] == fan["centre"]).select("centre", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("s"), F.lit("").alias("node"), "text")
    dealt = salted_join(pairs, fan, ["centre"], "inner", 8).withColumn("s", F.pmod(F.xxhash64("node"), F.col("fan")).cast("int")).drop("fan")
    right = dealt.join(texts, "node").select("centre", "s", "node", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = left.unionByName(right).repartition(n, "centre", "s").sortWithinPartitions("centre", "s", "node")

    def run(batches):
        w, sh = shared.value, None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = ([], [], [])
                for centre, node, raw in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    if not node:
                        sh = shingles(raw)
                        continue
                    for o, x in zip(out, (centre, node, weighted_jaccard(sh, shingles(raw), w)), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["centre", "node", "similarity"])

    return stream.mapInArrow(run, "centre string, node string, similarity double")


def _weights(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(n, h, w): the weight of each shingle of each text; n is a text's number. ``texts``: n, text."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf = shared.value
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h, c = shingles(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n)), pa.array(h.view(np.int64)), pa.array((c * idf[cells_of(h)]).astype(np.float64))], ["n", "h", "w"])

    return texts.select("n", "text").mapInArrow(run, "n bigint, h bigint, w double")


def _possible(texts: DataFrame, classes: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(centre, node): all pairs of texts of different classes whose similarity may reach the threshold t, by a prefix filter.

    Two texts of weights A <= B have an overlap of t / (1 + t) * (A + B) or more, and A >= t * B. What stands before their first
    common shingle is not common: at most 1 - 2t / (1 + t) of A and 1 - t of B. Shingles of one text only come first of all. Nor can the overlap
    be more than the lesser weights in each of SKETCH parts that shingles are dealt into by hash. A shingle's most frequent class is
    never paired with itself, so a family that is one class already costs nothing here.
    """
    named = materialize(texts.join(classes, "node").withColumn("n", F.monotonically_increasing_id()), "residue")
    rows = materialize(_weights(named, idf), "weights")
    common = materialize(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "common")
    # At most HOT shingles are in more than 1 / HOT of the rows; those are known to every task, the rows of others are dealt by shingle.
    hot = F.col("df") * HOT > rows.count()
    often = F.broadcast(common.where(hot))
    counted = rows.join(often, "h").unionByName(rows.join(often.select("h"), "h", "left_anti").join(common.where(~hot), "h"))
    part = F.pmod("h", F.lit(SKETCH))
    sketch = F.array(*[F.sum(F.when(part == i, F.col("w")).otherwise(0.0)) for i in range(SKETCH)])
    total = materialize(rows.groupBy("n").agg(F.sum("w").alias("total"), sketch.cast("array<float>").alias("sketch")), "totals")
    # From the most frequent down: a frame that ends at the row is summed once, one that starts there anew for each row.
    order = Window.partitionBy("n").orderBy(F.desc("df"), F.desc("h"))
    left = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    info = named.select("n", "node", "root").join(total.drop("sketch"), "n")
    first = counted.withColumn("left", left).select("n", "h", "left").join(info, "n")
    # left: the weight from this shingle on. A row is of use if it can be the first common one of some pair.
    first = materialize(first.where(F.col("left") >= threshold * F.col("total") * (1 - SLACK)).select("h", "node", "root", "total", "left"), "prefixes")
    for done in (rows, common):
        discard(done)
    sizes = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("classes")).where("classes > 1")
    sketches = named.select("n", "node").join(total.select("n", "sketch"), "n").drop("n")
    mixed = materialize(salted_join(first, sizes.select("h", "main"), ["h"], "inner", 8).join(sketches, "node"), "mixed")
    for done in (named, total, first):
        discard(done)
    a = mixed.where("root <> main").select("h", *[F.col(c).alias(f"a_{c}") for c in ("node", "root", "total", "left", "sketch")])
    b = mixed.select("h", "node", "root", "main", "total", "left", "sketch")
    least = threshold / (1 + threshold) * (F.col("a_total") + F.col("total")) * (1 - SLACK)
    at_most = F.aggregate(F.zip_with("a_sketch", "sketch", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y.cast("double"))
    fits = (F.least("a_left", "left") >= least) & (at_most >= least)
    near = F.least("a_total", "total") >= threshold * F.greatest("a_total", "total") * (1 - SLACK)
    once = (F.col("root") == F.col("main")) | (F.col("a_node") < F.col("node"))
    met = a.join(b, "h").where((F.col("a_root") != F.col("root")) & near & fits & once)
    out = materialize(met.select(F.greatest("a_node", "node").alias("centre"), F.least("a_node", "node").alias("node")).distinct(), "possible")
    discard(mixed)
    return out


def node_classes(keyed: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(node, class_id, copies, n_links) of the texts that have copies or links. ``keyed``: doc_id, node, text, without nulls and empty texts."""
    idf = idf_table(keyed)
    member = materialize(keyed.select("doc_id", "node"), "members")
    sigs = materialize(signatures(keyed, idf).groupBy("node").agg(F.first("bands").alias("bands")), "bands")
    keys = sigs.select(F.posexplode("bands").alias("i", "h"), "node").select(F.xxhash64("i", "h").alias("k"), "node")
    crowd = _crowded(keys)
    discard(sigs)
    size = materialize(member.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "sizes")
    discard(member)
    texts = _texts_of(keyed, materialize(crowd.select("node").distinct().join(size.select("node", F.col("least").alias("doc_id")), "node"), "mates"))
    met = _star(crowd)
    pairs = materialize(met.select("centre", "node").distinct(), "pairs")
    links = materialize(_verify(pairs, texts, idf), "links")
    discard(pairs)
    failed = met.join(links.where(F.col("similarity") < threshold).select("centre", "node"), ["centre", "node"], "left_semi").select("k").distinct()
    sure = materialize(links.where(F.col("similarity") >= threshold), "edges")
    # Whole classes, since the texts of a class that is in parts would all be paired below; the rounds at the end carry them on.
    begun = star_forest(sure.select(F.col("centre").alias("a"), F.col("node").alias("b")))
    roots = roots_of(begun)
    residue = salted_join(crowd, failed, ["k"], "inner", 8).select("node").distinct()
    pairs = _possible(texts, residue.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), idf, threshold)
    met_before = links.select(F.greatest("centre", "node").alias("centre"), F.least("centre", "node").alias("node"))
    left = materialize(pairs.join(met_before, ["centre", "node"], "left_anti"), "pairs")
    discard(pairs)
    more = materialize(_verify(left, texts, idf).where(F.col("similarity") >= threshold), "more")
    for done in (left, texts, met, crowd, links):
        discard(done)
    edges = sure.union(more)
    roots = roots_of(star_forest(begun.select(F.col("u").alias("a"), F.col("v").alias("b")).union(more.select("centre", "node"))))
    degree = edges.select(F.explode(F.array("centre", "node")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = size.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known.where("n > 1 OR n_links IS NOT NULL"), "known")
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("copies"))
    return materialize(salted_join(known.select("node", "root", "n_links"), classes, ["root"], "inner", 8).drop("root"), "classes")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copies, n_links): class_id is the least doc_id of the class, copies the size of its class.

    n_links: verified links of this row's text to other texts.
    """
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("node"), "text")
    takes_part = F.col("doc_id").isNotNull() & (F.col("text") != "")
    by_node = node_classes(keyed.where(takes_part), threshold)
    out = salted_join(keyed.select("doc_id", F.when(takes_part, F.col("node")).alias("node")), by_node, ["node"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each class, whole rows: that of the least doc_id, null ids last.

    A row is known by its doc_id and text together, so rows without a doc_id take part like others, a repeated id
    takes no other text with it, and of rows that repeat id and text any one stays. Null and empty texts all stay.
    """
    names = [c if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)]  # no name can clash with those added here
    rows = docs.toDF(*names).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")])).withColumn("node", F.when(F.col("text") != "", F.md5(F.col("text").cast("binary"))))
    keyed = rows.where("node IS NOT NULL").select(F.coalesce("doc_id", F.xxhash64("node").cast(rows.schema["doc_id"].dataType)).alias("doc_id"), "node", "text")
    classes = node_classes(keyed).select("node", "class_id")
    # One row for each doc_id and text of a class, with how many rows there are.
    marked = salted_join(rows.where("node IS NOT NULL").groupBy("doc_id", "node").agg(F.count("*").alias("n")), classes, ["node"], "inner")
    marked = materialize(marked.withColumn("order", F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), "node")), "marked")
    first = marked.groupBy("class_id").agg(F.min("order").alias("first"))
    judged = salted_join(marked, first, ["class_id"], "inner", 8).select("doc_id", "node", "n", (F.col("order") == F.col("first")).alias("stays"))
    judged = materialize(judged.withColumn("stays", F.coalesce("stays", F.lit(True))).where("NOT stays OR n > 1"), "judged")
    # Most rows stay as they are: only those that may be judged are shuffled, with their texts.
    maybe = _may_be_in(judged)
    doubtful = rows.where(maybe)
    same = lambda x: doubtful["node"].eqNullSafe(x["node"]) & doubtful["doc_id"].eqNullSafe(x["doc_id"])
    kept = rows.where(~maybe).select(*names).unionByName(doubtful.join(judged, same(judged), "left_anti").select(*names))
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        one = doubtful.join(repeated, same(repeated), "left_semi").groupBy("doc_id", "node").agg(F.first(F.struct(*names)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept.select(*names).toDF(*docs.columns)


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
