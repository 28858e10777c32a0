"""Language identification with a string kernel.

The kernel is the blended spectrum of n-gram presence: two texts score the number of different
character n-grams (one to three letters) that both hold, normalised by the sizes of both sets. A
Nystroem approximation on landmark texts turns it into finite features, and one-versus-rest kernel ridge
regression on these gives one weight vector per language. As features and weights are linear in a text's
presence vector, a batch of texts is scored by one matrix product.

Training uses a bounded sample: the `train_rows` labelled texts of least hash in each language, of at
most `train_chars` characters each (whole texts, never cut); a language that has only longer ones is
learned from its LONG_ROWS shortest. Where languages are many, they share TRAIN_TOTAL texts and
LANDMARKS_TOTAL landmarks, so the fit in the driver is bounded. Every whole text is scored, inside one
Arrow map without shuffle. Texts are lower-cased; all characters that are no letters count as one blank;
letters beyond the most frequent of the sample count by their script.

A text that is null or has no letter is `und` with score 0. Ties between languages go to the first by name.
Repeated rows are scored alike, and a language whose labelled rows are all alike, or share one id or a null
one, is learned as any other. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.llm.common import columns_of, picked, quoted

UNKNOWN = "und"
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TOTAL, LONG_ROWS = 500, 20_000, 8_000, 20
LANDMARKS_PER_LANG, LANDMARKS_TOTAL, RIDGE = 200, 1_000, 1e-3
#: Letters told apart (the most frequent of the sample), then scripts told apart among the others (likewise); the
#: last symbol is any other letter, 0 the blank.
SYMBOLS, SCRIPTS = 126, 32
SIDE = SYMBOLS + SCRIPTS + 2
#: Columns of the presence matrix that are held at a time when kernels are made, and its values when texts are scored.
COLUMNS, VALUES = 1 << 14, 1 << 24
SHARPNESS = 8.0


class Model(NamedTuple):
    letters: str
    scripts: list[str]
    grams: np.ndarray  # sorted n-gram codes of the landmarks
    weights: np.ndarray  # grams x languages
    bias: np.ndarray
    langs: list[str]


@lru_cache(1)
def _blank() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)


def script_of(letter: str) -> str:
    """The first word of a letter's Unicode name, as LATIN, CJK or HANGUL."""
    return unicodedata.name(letter, "").partition(" ")[0]


def _symbols(letters: str, scripts: list[str]) -> np.ndarray:
    table, number = _blank() * np.uint8(SIDE - 1), {s: SYMBOLS + 1 + i for i, s in enumerate(scripts)}
    if scripts:
        for c in np.flatnonzero(table).tolist():
            table[c] = number.get(script_of(chr(c)), SIDE - 1)
    table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _codes(symbols: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three symbols, with repeats; the blank ones too. Codes are below 3 * SIDE ** 3."""
    s = np.concatenate(([0], symbols, [0])).astype(np.int32)
    two = s[:-1] * SIDE + s[1:]
    return np.concatenate((s, SIDE**3 + two, 2 * SIDE**3 + two[:-1] * SIDE + s[2:]))


def _presence(texts: list[str], symbols: np.ndarray, slots: np.ndarray, width: int) -> np.ndarray:
    """texts x grams, 1 where a text holds the gram."""
    out = np.zeros((len(texts), width + 1), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        row[slots[_codes(symbols[_points(text)])]] = 1
    return out[:, :width]


def _slots(grams: np.ndarray) -> np.ndarray:
    slots = np.full(3 * SIDE**3, len(grams), dtype=np.int32)
    slots[grams] = np.arange(len(grams))
    return slots


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def _columns(found: list[np.ndarray], start: int, stop: int) -> np.ndarray:
    """The part of the presence matrix from gram `start` to `stop`; `found` has the grams of each text, ascending."""
    out = np.zeros((len(found), stop - start), dtype=np.float32)
    for row, grams in zip(out, found, strict=True):
        row[grams[np.searchsorted(grams, start) : np.searchsorted(grams, stop)] - start] = 1
    return out


def fit(texts: list[str], labels: list[str], per_lang: int = LANDMARKS_PER_LANG, ridge: float = RIDGE) -> Model:
    """Fits the classifier on a sample held in memory, texts in the order of their hash. No texts: a model that knows no language."""
    langs = sorted(set(labels))
    if not langs:
        return Model("", [], np.zeros(1, np.int64), np.zeros((1, 0)), np.zeros(0), [])
    points, counts = np.unique(np.concatenate([[0], *(_points(t) for t in texts)]).astype(np.uint32), return_counts=True)
    alphabetic = _blank()[points] == 1
    points, counts = points[alphabetic], counts[alphabetic]
    order = np.argsort(-counts, kind="stable")
    letters = "".join(chr(p) for p in sorted(points[order[:SYMBOLS]]))
    rest: Counter[str] = Counter()
    for i in order[SYMBOLS:]:
        rest[script_of(chr(points[i]))] += int(counts[i])
    scripts = [s for s, _ in sorted(rest.items(), key=lambda x: (-x[1], x[0]))[:SCRIPTS]]
    symbols = _symbols(letters, scripts)
    per_lang = max(1, min(per_lang, LANDMARKS_TOTAL // len(langs)))
    chosen = [i for lang in langs for i in [i for i, x in enumerate(labels) if x == lang][:per_lang]]
    grams = np.unique(np.concatenate([[0], *(np.unique(_codes(symbols[_points(texts[i])])) for i in chosen)]).astype(np.int64))
    slots = _slots(grams)
    found = [held[held < len(grams)] for held in (np.unique(slots[_codes(symbols[_points(t)])]) for t in texts)]
    size = np.sqrt(np.maximum([len(x) for x in found], 1))[:, None]
    rows = np.zeros((len(texts), len(chosen)))
    for start in range(0, len(grams), COLUMNS):
        stop = min(start + COLUMNS, len(grams))
        marks = _columns([found[i] for i in chosen], start, stop)
        for at in range(0, len(texts), 1024):
            rows[at : at + 1024] += _columns(found[at : at + 1024], start, stop) @ marks.T
    rows /= size * size[chosen].T
    kernel = rows[chosen]
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * max(value.max(), 1e-6)
    root = vector[:, good] / np.sqrt(value[good])
    features = rows @ root
    centre = features.mean(axis=0)
    target = np.where(np.array(labels)[:, None] == np.array(langs), 1.0, -1.0)
    balance = np.sqrt(1 / np.array([labels.count(x) for x in labels]))[:, None]  # each language weighs the same
    a = (features - centre) * balance
    coef = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ (target * balance))
    share, weights = (root @ coef) / size[chosen], np.zeros((len(grams), len(langs)))
    for i, part in zip(chosen, share, strict=True):
        weights[found[i]] += part
    return Model(letters, scripts, grams, weights.astype(np.float32), -(centre @ coef), langs)


def predict(model: Model, texts: list[str | None], symbols: np.ndarray, slots: np.ndarray) -> tuple[list[str], np.ndarray]:
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and symbols[_points(t)].any()]
    step = max(1, min(256, VALUES // len(model.grams)))
    for part in (known[i : i + step] for i in range(0, len(known) if model.langs else 0, step)):
        margin = _normal(_presence([texts[i] for i in part], symbols, slots, len(model.grams))) @ model.weights + model.bias
        odds = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        for i, k, s in zip(part, margin.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1), strict=True):
            langs[i], scores[i] = model.langs[k], s
    return langs, scores


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS) -> Model:
    """Fits on at most `train_rows` rows per language, of those that are `usable` and labelled.

    At most TRAIN_TOTAL texts of at most train_chars characters reach the driver, and at most LONG_ROWS longer
    ones of each language that has no others.
    """
    rows = docs.filter(usable & quoted(lang_col).isNotNull() & quoted(text_col).isNotNull())
    rows = picked(rows, id=quoted(id_col).cast("string"), lang=quoted(lang_col).cast("string"), text=quoted(text_col).cast("string"))
    rows = rows.withColumns({"h": F.xxhash64("id", "text"), "long": F.greatest(F.length("text") - train_chars, F.lit(0))})
    # about twice as many rows as are wanted pass by their hash alone, and at least those of the least one, so no language is ranked as a whole
    sizes = rows.groupBy("lang").agg((2.0 * train_rows / F.greatest(F.count(F.when(F.col("long") == 0, 1)), F.lit(1))).alias("share"), F.min(F.when(F.col("long") == 0, F.col("h"))).alias("least"))
    each = max(1, min(train_rows, TRAIN_TOTAL // max(1, sizes.count())))
    few = rows.join(F.broadcast(sizes), "lang").filter(F.when(F.col("least").isNull(), True).otherwise((F.col("long") == 0) & ((F.col("h") / 2.0**64 + 0.5 <= F.col("share")) | (F.col("h") == F.col("least")))))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text"))
    found = few.withColumn("n", first).filter(F.col("n") <= each).filter((F.col("long") == 0) | (F.col("n") <= LONG_ROWS))
    found = found.select("h", "lang", "text").toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    return fit(found["text"].to_pylist(), found["lang"].to_pylist())


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "_lang_pred", score_name: str = "_score") -> DataFrame:
    """The input with two columns more: language and score. Languages in the model are few, so the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        symbols, slots = _symbols(shared.value.letters, shared.value.scripts), _slots(shared.value.grams)
        for part in texts:
            langs, scores = predict(shared.value, part.tolist(), symbols, slots)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    found = docs.select(*columns_of(docs), score(quoted(text_col).cast("string")).alias(f"{lang_name}{score_name}"))
    return found.select(*columns_of(docs), *[F.col(f"`{lang_name}{score_name}`.{part}").alias(name) for part, name in (("lang_pred", lang_name), ("score", score_name))])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
