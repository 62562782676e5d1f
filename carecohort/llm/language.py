"""Language identification by string kernels.

Texts are compared by a blended-spectrum presence kernel: the number of distinct
character n-grams (1 to 3, hashed to 18 bits) that two texts share, divided by the
geometric mean of their own numbers.  A ridge regression per language, one against the
rest, is fitted in the Nyström features of a few landmark texts, so the score of a text
is its row of kernel values with the landmarks times a small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: texts per language, and landmarks among them.
TRAIN_PER_LANGUAGE = 300
LANDMARKS_PER_LANGUAGE = 32
#: Languages fitted at most, the most frequent first; beyond, a fit is refused.
MAX_LANGUAGES = 200
#: Groups of input partitions whose smallest hashes are found apart.
GROUPS = 16
RIDGE = 1e-2
ORDERS = (1, 2, 3)
_BITS = 18
_CHUNK = 1 << 19  # characters worked on at a time
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of all n-grams, and whether each text has a letter.

    Texts are lower-cased; whatever is not a letter counts as one blank.
    """
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    letter = _is_letter(codes)
    has_letter = np.bincount(of[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])
    codes, of = np.where(letter, codes, 32)[keep].astype(np.uint32), of[keep]
    docs, grams = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + codes[j : j + size]
        h ^= h >> np.uint32(15)
        h = h * np.uint32(0x9E3779B1) >> np.uint32(32 - _BITS)
        whole = of[:size] == of[n - 1 :]
        docs.append(of[:size][whole])
        grams.append(h[whole])
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32), has_letter
    return np.concatenate(docs), np.concatenate(grams), has_letter


@dataclass
class LanguageModel:
    languages: list[str]
    columns: np.ndarray  # hashed n-gram -> column of the landmarks' n-grams, or -1
    landmarks: np.ndarray  # presence, column x landmark, divided by the root of its n-grams
    weights: np.ndarray  # landmark x language

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts with the landmarks, and whether each text has a letter."""
        of, grams, has_letter = text_grams(texts)
        column = self.columns[grams]
        present = np.zeros((len(texts), len(self.landmarks)), np.float32)
        known = column >= 0
        present[of[known], column[known]] = 1
        others = np.unique(of[~known].astype(np.int64) << _BITS | grams[~known]) >> _BITS
        size = np.count_nonzero(present, axis=1) + np.bincount(others, minlength=len(texts))
        return present @ self.landmarks / np.sqrt(np.maximum(size, 1))[:, None], has_letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text; no letter: unknown, 0."""
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for part in _chunks(texts):
            values, has_letter = self.kernel([texts[i] or "" for i in part])
            if not self.languages:
                continue
            raw = values @ self.weights
            best = raw.argmax(axis=1)
            share = np.exp(4.0 * (raw - raw.max(axis=1, keepdims=True)))
            share = share.max(axis=1) / share.sum(axis=1)
            for row, i in enumerate(part):
                if has_letter[row]:
                    found[i], scores[i] = self.languages[best[row]], float(share[row])
        return found, scores


def _chunks(texts: list[str | None]) -> Iterator[list[int]]:
    part, held = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        held += len(t or "")
        if held > _CHUNK or len(part) == 256:
            yield part
            part, held = [], 0
    if part:
        yield part


def fit_language(rows: list[tuple[str, str]], ridge: float = RIDGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> LanguageModel:
    """Fit on (text, language) rows; the first ``landmarks`` of each language are landmarks."""
    languages = sorted({lang for _, lang in rows})
    chosen, taken = [], dict.fromkeys(languages, 0)
    for text, lang in rows:
        if taken[lang] < landmarks:
            taken[lang] += 1
            chosen.append(text)
    columns = np.full(1 << _BITS, -1, np.int32)
    if not chosen:
        return LanguageModel([], columns, np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    of, grams, _ = text_grams(chosen)
    used = np.unique(grams)
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(used), len(chosen)), np.float32)
    marks[columns[grams], of] = 1
    marks /= np.sqrt(np.maximum(marks.sum(axis=0), 1))
    model = LanguageModel(languages, columns, marks, np.zeros((len(chosen), len(languages))))
    among = model.kernel(chosen)[0].astype(np.float64)
    size, axes = np.linalg.eigh((among + among.T) / 2)
    kept = size > 1e-6 * max(size.max(), 1e-12)
    root = axes[:, kept] / np.sqrt(size[kept])  # kernel values -> Nyström features
    features = np.concatenate([model.kernel([rows[i][0] for i in part])[0] for part in _chunks([t for t, _ in rows])])
    features = features.astype(np.float64) @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    gram = features.T @ features + ridge * len(rows) * 1e-2 * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(gram, features.T @ target)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: a quarter, by crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_language(
    docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Learn from at most ``per_language`` labelled texts of each language.

    The sample is the rows with the smallest hash of id and text, so it does not depend on
    partitions; rows without text, language or letters and held-out rows are left out.
    """
    labelled = docs.where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}")
    ).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
             F.xxhash64(F.col(id_col), F.col(text_col)).alias("_at"))
    if labelled.groupBy("lang").agg(F.count(F.lit(1))).limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the smallest hashes of a group of input partitions first, so that few rows of a language meet
    chosen = labelled.select("lang", "_at", (F.spark_partition_id() % GROUPS).alias("_group"))
    for of in (["lang", "_group"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*of).orderBy("_at"))
        chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= per_language)
    # at most MAX_LANGUAGES * per_language rows, here without and then with their texts
    sample = labelled.join(F.broadcast(chosen.select("lang", "_at").distinct()), ["lang", "_at"]).dropDuplicates(["lang", "_at"])
    rows = sorted(sample.select("_at", "lang", "text").collect())
    return fit_language([(r.text, r.lang) for r in rows], landmarks=landmarks)


def language_of(text: Column, model: LanguageModel) -> Column:
    """Struct of lang_pred and score of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found, scores = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": found, "score": scores})

    return predict(text)


def identify_language(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null text, empty text and text without a letter give ``und`` and 0; so does every text
    if nothing can be learned.  A row with a null id is never held out.  Equal scores go to
    the language that sorts first.  Repeated rows are predicted alike; other columns are
    not read.
    """
    model = model or learn_language(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       language_of(F.col(text_col), model).alias("_found"))
    return rows.select("doc_id", "held_out", "_found.lang_pred", "_found.score")
