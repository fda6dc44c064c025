r"""Personal data by pattern, checksum and context, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns, then checked:
parts of an ip at most 255, Luhn and 14 to 19 digits for a card, 10 to 15 digits for a phone. The method adds
``iban`` (mod-97), ``ssn`` and ``tel`` (a number without a country code); the last two need a context word
nearby. Each span has a score: what its kind earns by itself, raised by such a word nearby.

Matches are found with ``regexp_extract_all``; ``split`` on the same pattern gives the pieces between them, whose
lengths add up to the positions. Quantified groups are possessive, which changes no match (the character sets
that follow are disjoint) and keeps the regex engine free of recursion and of quadratic scans on long texts.

Positions are added up chunk by chunk and words nearby are looked for in the pieces around a match, so that a text with
very many spans costs in proportion to them.

Edge cases: null text counts as empty (no spans; the digest is that of the empty text). Positions are code
points, end exclusive. Repeated rows, null ids and other columns pass through one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fresh, table

#: Fixed patterns. The look-behind keeps a long run from being tried at each of its characters; \G admits the
#: place where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: What must stand in a text for the pattern to be worth running.
HINTS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
#: Score without and with a context word.
SCORES = {"email": (0.95, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95), "iban": (0.9, 1.0), "ssn": (0.0, 0.85), "tel": (0.0, 0.7)}
CONTEXT = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "tel": "phone|tel|call|mobile|fax",
}
REACH = 40
#: Arrays grow element by element within a chunk only, so that the work on a text grows with its spans and not their square.
CHUNK = 256
#: A match of any kind has four characters or more, so that this many cover REACH.
AROUND = REACH // 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise((F.substring(d, i, F.lit(1)).cast("int") * 2 / 10).cast("int") + F.substring(d, i, F.lit(1)).cast("int") * 2 % 10),
    )
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _mod97(m: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")) <= 255)),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "iban": _mod97,
    "ssn": lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
    "tel": lambda m: F.lit(True),
}


def _let(value: Column, f) -> Column:
    """f(value), the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(n: Column, size: int = CHUNK) -> Column:
    """0 and up: the numbers of the chunks that n > 0 elements make."""
    return F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))


def _found(text: Column, kind: str) -> Column:
    """array<struct<s, k, e, kind, score>> of one kind, by position."""
    pattern, (low, high) = F.lit(PATTERNS[kind]), SCORES[kind]
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,kind:string,score:double>>)")

    def span(v: Column, i: Column, s: Column, m: Column) -> Column:
        """What stands within REACH characters comes from the ends of at most AROUND pieces and matches on either side."""
        before = F.right(F.concat(F.array_join(F.slice(v["lead"], F.greatest(i - AROUND, F.lit(0)) + 1, F.least(i, F.lit(AROUND))), ""), F.right(F.get(v["p"], i), F.lit(REACH))), F.lit(REACH))
        after = F.left(F.array_join(F.slice(v["follow"], i + 2, F.lit(AROUND)), ""), F.lit(REACH))
        near = F.concat_ws(" ", F.lower(before), F.lower(after)).rlike(rf"\b(?:{CONTEXT[kind]})")
        one = lambda score: F.array(F.struct(s.alias("s"), F.lit(KINDS.index(kind)).alias("k"), (s + F.length(m)).alias("e"), F.lit(kind).alias("kind"), F.lit(score).alias("score")))
        return F.when(CHECKS[kind](m), F.when(near, one(high)).otherwise(one(low) if low else none)).otherwise(none)

    def chunk(v: Column, c: Column) -> Column:
        """The spans of one chunk of matches, and its length; positions count from the chunk's start."""
        return F.aggregate(
            F.sequence(c * CHUNK, F.least(F.size(v["m"]), (c + 1) * CHUNK) - 1),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, i: F.struct(
                (a["at"] + F.length(F.get(v["p"], i)) + F.length(F.get(v["m"], i))).alias("at"),
                F.concat(a["out"], span(v, i, a["at"] + F.length(F.get(v["p"], i)), F.get(v["m"], i))).alias("out"),
            ),
        )

    def whole(v: Column) -> Column:
        shifted = lambda a, w: F.transform(w["out"], lambda x: F.struct((x["s"] + a["at"]).alias("s"), x["k"].alias("k"), (x["e"] + a["at"]).alias("e"), x["kind"].alias("kind"), x["score"].alias("score")))
        return F.flatten(
            F.aggregate(
                F.transform(_chunks(F.size(v["m"])), lambda c: chunk(v, c)),
                F.struct(F.lit(0).alias("at"), F.array(none).alias("out")),
                lambda a, w: F.struct((a["at"] + w["at"]).alias("at"), F.concat(a["out"], F.array(shifted(a, w))).alias("out")),
            )["out"]
        )

    def ends(v: Column) -> Column:
        lead = F.transform(v["m"], lambda m, i: F.concat(F.right(F.get(v["p"], i), F.lit(REACH)), F.right(m, F.lit(REACH))))
        follow = F.transform(v["p"], lambda p, i: F.concat(F.left(p, F.lit(REACH)), F.coalesce(F.left(F.get(v["m"], i), F.lit(REACH)), F.lit(""))))
        return F.struct(v["m"].alias("m"), v["p"].alias("p"), lead.alias("lead"), follow.alias("follow"))

    cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("p"))
    worth = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(worth & F.regexp_like(text, pattern), _let(cut, lambda v: _let(ends(v), whole))).otherwise(none)


def _clear(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, which is in order: by chunk first, then one by one."""

    def block(rows: Column) -> Column:
        return F.struct(F.get(rows, F.lit(0))["s"].alias("lo"), F.array_max(F.transform(rows, lambda y: y["e"])).alias("hi"), rows.alias("rows"))

    blocks = F.transform(_chunks(F.size(base)), lambda c: _let(F.slice(base, c * CHUNK + 1, F.lit(CHUNK)), block))
    meets = lambda x, lo, hi: (lo < x["e"]) & (x["s"] < hi)
    free = _let(blocks, lambda bs: F.filter(more, lambda x: ~F.exists(bs, lambda b: meets(x, b["lo"], b["hi"]) & F.exists(b["rows"], lambda y: meets(x, y["s"], y["e"])))))
    return F.when((F.size(base) > 0) & (F.size(more) > 0), free).otherwise(more)


def find_pii(docs: DataFrame, column: str = "text", into: str = "pii") -> DataFrame:
    """Adds ``into``: array<struct<s, k, e, kind, score>>, by start and then kind. Added spans overlap no base span."""
    text = F.coalesce(F.col(column), F.lit(""))
    base, more = (fresh([*docs.columns, into], n) for n in ("base", "more"))
    out = docs.withColumn(base, F.array_sort(F.concat(*[_found(text, k) for k in BASE]))).withColumn(more, F.concat(*[_found(text, k) for k in KINDS[4:]]))
    return out.withColumn(into, F.array_sort(F.concat(F.col(base), _clear(F.col(more), F.col(base))))).drop(base, more)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """Each span is replaced by its kind in angle brackets; of overlapping spans the first one covers. Texts without spans and null texts stay as they are."""
    pii = fresh(docs.columns, "pii")
    found, text = find_pii(docs, column, pii), F.col(column)

    def walked(rows: Column, t: Column, start: Column) -> Column:
        """``t``, the text of one chunk of spans, which starts at ``start``, with its spans replaced."""
        return F.aggregate(
            rows,
            F.struct(start.alias("at"), F.lit("").alias("out")),
            lambda a, x: F.when(
                x["s"] >= a["at"],
                F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] - start + 1, x["s"] - a["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out")),
            ).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        )["out"]

    def whole(rows: Column) -> Column:
        """``ends``: where each chunk's text starts, and the last one's ends."""
        ends = F.aggregate(rows, F.array(F.lit(0)), lambda a, r: F.concat(a, F.array(F.greatest(F.element_at(a, -1), F.array_max(F.transform(r, lambda y: y["e"]))))))
        part = lambda r, lo, hi: _let(F.substring(text, lo + 1, hi - lo), lambda t: walked(r, t, lo))
        return _let(ends, lambda at: F.concat(F.array_join(F.transform(rows, lambda r, c: part(r, F.get(at, c), F.get(at, c + 1))), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text))))

    clean = _let(F.transform(_chunks(F.size(pii)), lambda c: F.slice(F.col(pii), c * CHUNK + 1, F.lit(CHUNK))), whole)
    return found.withColumn(column, F.when(F.size(pii) > 0, clean).otherwise(text)).drop(pii)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["k"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.concat_ws(",", F.transform("pii", lambda x: F.format_number(x["score"], 2))).alias("scores"),
    )
