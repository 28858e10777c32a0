"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Every whole text is scanned inside one Arrow map; no shuffle. All patterns run in time linear in the
text: an address is grown outward from its ``@``, and digit patterns start only where a run starts.

Kinds: the base kinds ``email``, ``ip``, ``card`` and ``phone`` are kept whatever their score. The
method adds ``iban`` (mod-97 confirmed) and ``ssn`` (kept only where context words lift its score).
Context words are whole words within CONTEXT_CHARS of a span; the nearest one that speaks for the kind adds to the
score, the nearest one that speaks against it takes off, each the less the farther away it stands.
Null and empty texts have no spans. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelode.llm.common import picked

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Score without context, and the least score that keeps a span of a kind that is not a base kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
MIN_SCORE = 0.5
CONTEXT_CHARS, CONTEXT_GAIN = 40, 0.3
#: Words that speak for a kind, and words that speak for something else.
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr", "client"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "cvv"},
    "phone": {"phone", "telephone", "tel", "call", "mobile", "cell", "fax"},
    "iban": {"iban", "account", "bank", "swift", "konto"},
    "ssn": {"ssn", "social", "security", "tax", "taxpayer", "tin"},
}
AGAINST = {
    "email": set(), "ip": {"version", "release", "section", "chapter"}, "card": {"order", "tracking", "isbn", "serial"},
    "phone": {"order", "isbn", "serial", "invoice"}, "iban": {"serial", "order", "tracking"}, "ssn": {"order", "part", "serial", "isbn", "invoice", "model", "ticket", "version", "syntax", "example"},
}
WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
#: Characters of an IBAN by country; of other countries every length that the pattern allows is tried.
IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows an IBAN may look like more of it, so its end is the first border of a word at which length and checksum fit."""
    floor = 0
    for m in IBAN.finditer(text):
        if m.start() < floor:
            continue
        length, end, known = 4, m.end(), IBAN_LENGTHS.get(m[1])
        for c in m[2]:
            end += 1
            length += c != " "
            border = c != " " and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum())
            if border and length >= 15 and known in (None, length) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                floor = end
                break


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of every kind, kind by kind in the order of KINDS, each from left to right."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """PRIOR, more for the nearest word of the kind and less for the nearest against it; a word a window away counts two thirds."""
    left = max(0, start - CONTEXT_CHARS)
    near = {True: 0.0, False: 0.0}
    for low, high in ((left, start), (end, min(len(text), end + CONTEXT_CHARS))):
        for m in WORD.finditer(text[low:high].lower()):
            a, z = low + m.start(), low + m.end()
            if (a == low and a and text[a - 1].isalpha()) or (z == high and z < len(text) and text[z].isalpha()):
                continue  # a part of a word
            weight = 1 - (start - z if z <= start else a - end) / (3 * CONTEXT_CHARS)
            for speaks, words in ((True, CONTEXT[kind]), (False, AGAINST[kind])):
                if m[0] in words:
                    near[speaks] = max(near[speaks], weight)
    return round(min(1.0, max(0.0, PRIOR[kind] + CONTEXT_GAIN * (near[True] - near[False]))), 2)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    found = [(k, a, b, score(text, k, a, b)) for k, a, b in propose(text)] if text else []
    return [x for x in found if x[0] in BASE_KINDS or x[3] >= MIN_SCORE]


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans_of(t.as_py()) for t in batch.column("text")]
        spans = pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in found], pa.list_(_SPAN))
        base = [",".join(f"{k}:{a}:{b}" for k, a, b, _ in x if k in BASE_KINDS) for x in found]
        digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base])
        yield pa.RecordBatch.from_arrays([batch.column("id"), spans, digest], ["id", "spans", "base_sha256"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (kind, start, end, score) by kind then start, base_sha256.

    Null or empty text: no spans. Repeated rows each get their own result; an empty table gives none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return picked(docs, id=id_col, text=F.col(f"`{text_col}`").cast("string")).mapInArrow(_scan, f"id {kind}, spans {SPANS}, base_sha256 string").withColumnRenamed("id", id_col)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``[KIND]``; where spans overlap the earliest wins."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, (s["a"] - acc["at"]).cast("int")), F.lit("["), F.upper(s["k"]), F.lit("]"))
        return F.when(s["a"] >= acc["at"], F.struct(cut.alias("done"), s["b"].alias("at"))).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, 2**31 - 1)))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *counts, "base_sha256", joined.alias("spans"), F.array_max(F.transform(spans, lambda s: s["score"])).alias("max_score"))
