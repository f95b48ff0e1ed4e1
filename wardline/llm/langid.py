"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The n-gram abc is bound as roll(a, 2) * roll(b, 1) * c (elementwise), so order matters; a text
is the bundle (sum) of its n-gram vectors, a language the bundle of its training texts. A text gets the language whose prototype
has the greatest cosine. N-grams lie within words, which a blank (a vector of its own) opens and closes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches, text_batches

UNKNOWN = "und"
_BLOCK = 8192


@dataclass
class Encoder:
    """Turns texts into bundles. `dim` is the length of the vectors, `seed` fixes the letters' vectors."""

    dim: int = 1024
    seed: int = 11
    letters: dict[int, np.ndarray] = field(default_factory=dict, repr=False)
    is_letter: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"dim": self.dim, "seed": self.seed, "letters": {}, "is_letter": None}

    def _vector(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim).astype(np.float32) * 2 - 1
        return v

    def bundles(self, texts: list[str]) -> np.ndarray:
        """One row per text: the sum of its n-gram vectors (zeros for a text without letters)."""
        if self.is_letter is None:
            self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        low = [f" {t.lower()} " for t in texts]
        out = np.zeros((len(texts), self.dim), np.float32)
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low)), [len(t) for t in low])
        codes = np.where(self.is_letter[codes], codes, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])  # one blank between words
        codes, doc = codes[keep], doc[keep]
        if len(codes) < 3:
            return out
        present = np.flatnonzero(np.bincount(codes))
        short = np.searchsorted(present, codes)
        n = len(present)
        good = (doc[:-2] == doc[2:]) & (codes[1:-1] != 0)
        gram = ((short[:-2] * n + short[1:-1]) * n + short[2:])[good]
        doc = doc[:-2][good]
        grams, place = np.unique(gram, return_inverse=True)
        base = np.stack([self._vector(int(c)) for c in present])
        for lo in range(0, len(grams), _BLOCK):
            g = grams[lo:lo + _BLOCK]
            bound = np.roll(base, 2, axis=1)[g // (n * n)] * np.roll(base, 1, axis=1)[g // n % n] * base[g % n]
            mine = (place >= lo) & (place < lo + len(g))
            counts = np.bincount(doc[mine] * len(g) + place[mine] - lo, minlength=len(texts) * len(g))
            out += counts.reshape(len(texts), len(g)).astype(np.float32) @ bound
        return out


@dataclass
class Profiles:
    """Language prototypes: one unit row per language."""

    encoder: Encoder
    langs: list[str]
    rows: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h = self.encoder.bundles(texts).astype(np.float64)
        norm = np.linalg.norm(h, axis=1)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cos = h @ self.rows.T / np.where(norm > 0, norm, 1)[:, None]
        best = cos.argmax(1)
        some = np.fromiter((any(c.isalpha() for c in t) for t in texts), bool, len(texts))
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, np.clip(cos.max(1), 0, 1), 0.0)

    def column(self, text: Column) -> Column:
        """struct(lang_pred, score) of a text column. Texts that are null or hold no letter, and all texts where no language was learned, are
        `und` with score 0; equal cosines go to the first language in order."""
        model = self

        @F.pandas_udf("lang_pred string, score double")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                langs, scores = [], []
                for group in text_batches(s):
                    a, b = model.predict(group)
                    langs += a
                    scores.append(b)
                yield pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else np.zeros(0)})

        return predict(text)


def learn(train: DataFrame, dim: int = 1024, seed: int = 11) -> Profiles:
    """Prototypes from columns text and lang (rows with a null lang or text are passed over).

    Each task bundles its rows by language; the bundles are added up by (language, position), so what reaches the driver is languages x dim
    numbers however large the input is. No rows: no languages, and every text is `und`.
    """
    bound_batches(train.sparkSession)
    enc = Encoder(dim, seed)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            at = 0
            langs = pdf["lang"].to_numpy()
            for group in text_batches(pdf["text"]):
                h = enc.bundles(group)
                part = langs[at:at + len(group)]
                at += len(group)
                for lang in set(part):
                    sums[lang] = sums.get(lang, 0) + h[part == lang].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(len(v)), "v": v})

    rows = (train.select("text", "lang").where("lang is not null and text is not null").mapInPandas(run, "lang string, at int, v double")
            .groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
            .orderBy("lang").collect())
    m = np.array([[x["v"] for x in r["v"]] for r in rows], np.float64).reshape(len(rows), dim)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if len(rows) else np.zeros((0, dim))
    return Profiles(enc, [r["lang"] for r in rows], m)
