"""Whole results of queries on a small table of odd rows and real texts, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidelog.llm import packing, pii, sstable
from tidelog.llm.common import tokenizer_path


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """(folder, rows): the first texts of the smallest table, and rows without text or id, repeated ones and a long one."""
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()[:120]
    rows = [(r["doc_id"], r["text"]) for r in table] + [(900001, None), (900002, ""), (900003, "a@b.co 1.2.3.4 " * 400), (900003, "again"), (900004, "word " * 9000)]
    folder = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end(), kind) for k, (kind, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m.group()))


def test_op9_pii(spark, small):
    folder, rows = small
    want = []
    for i, text in rows:
        spans = base_spans(text or "")
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        want.append((i, *[sum(x[3] == k for x in spans) for k in pii.BASE], hashlib.sha256(joined.encode()).hexdigest()))
    got = [(r["doc_id"], *[r[f"n_{k}"] for k in pii.BASE], r["base_sha256"]) for r in pii.op9_pii(spark, folder).collect()]
    assert sorted(got) == sorted(want) and sum(x[1] for x in want) >= 400


def token_ids(text, tokenizer):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_op3_sstable_and_op7_packing(spark, small):
    from tokenizers import Tokenizer

    folder, rows = small
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [(i, token_ids(t, tokenizer)) for i, t in rows]
    got = sstable.op3_sstable(spark, folder).orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in ids) and [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    pieces = [(i, k, k * 4096, len(x[k * 4096 : (k + 1) * 4096]), zlib.crc32(x[k * 4096 : (k + 1) * 4096].tobytes())) for i, x in ids for k in range(-(-len(x) // 4096))]
    placed = packing.op7_packing(spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == sorted(pieces)
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) <= 4096
