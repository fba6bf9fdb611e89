"""Language identification as inference of a mixture of languages.

Every language is a distribution over hashed byte trigrams of lower-cased
words, learned from labelled texts. A document is a mixture: each word comes
from one of the languages, and expectation-maximisation estimates their
shares. More languages always explain a text a little better, so the set is
selected by the penalised likelihood -2 log L + penalty * size * log(words).

Scale: learning is a sum of trigram counts by language with partial sums in
every task (languages x 2^bits rows at most); the model of that fixed size is
sent to the tasks, and documents are scored where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

BITS = 16
_SPLIT = bytes(c if 97 <= c <= 122 or c >= 0x80 else 0x20 for c in range(256))


def trigrams(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of ' word ' for every word, and where each word's begin."""
    b = text.lower().encode("utf-8").translate(_SPLIT) if text else b""
    a = np.frombuffer(b" " + b" ".join(b.split()) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    starts = np.flatnonzero(a[:-2] == 32)
    return slot, starts


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text)) if not text.isascii() else text.upper() != text.lower())


class LanguageModel:
    """Log-probabilities [slot, language]; ``infer`` gives the mixture of one text."""

    def __init__(self, names: list[str], logp: np.ndarray, bits: int, penalty: float = 3.0) -> None:
        self.names, self.logp, self.bits, self.penalty = names, logp, bits, penalty

    def infer(self, text: str | None) -> tuple[list[str], list[float]]:
        """Languages by falling share, and the shares. No letter or no model: ([], [])."""
        if not self.names or not has_letter(text):
            return [], []
        slot, starts = trigrams(text, self.bits)
        if not len(starts):
            return [], []
        ll = np.add.reduceat(self.logp[slot], starts, axis=0).astype(np.float64)
        n, k = ll.shape
        single = ll.sum(0)
        first = int(single.argmax())
        price = self.penalty * np.log(n + 1.0)
        # no mixture can beat the best language by more than its words' own best ones do
        if k == 1 or 2 * (ll.max(1).sum() - single[first]) <= price:
            return [self.names[first]], [1.0]
        top = ll.max(1, keepdims=True)
        lik, base = np.exp(ll - top), float(top.sum())
        share, full = self._em(lik, np.full(k, 1.0 / k))
        best = (-2 * single[first] + price, np.eye(k)[first])
        if -2 * (full + base) + 2 * price < best[0]:
            order = np.argsort(-share, kind="stable")
            for size in range(2, k + 1):
                held = np.zeros(k)
                held[order[:size]] = share[order[:size]] + 1e-6
                mix, fit = self._em(lik, held / held.sum())
                if -2 * (fit + base) + size * price < best[0]:
                    best = (-2 * (fit + base) + size * price, mix)
        share = best[1]
        order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
        return [self.names[i] for i in order], [float(share[i]) for i in order]

    @staticmethod
    def _em(lik: np.ndarray, share: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
        for _ in range(rounds):
            total = np.maximum(lik @ share, 1e-300)
            new = share * ((1.0 / total) @ lik) / len(lik)
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share / share.sum(), float(np.log(np.maximum(lik @ share, 1e-300)).sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS) -> LanguageModel:
    """Count trigrams of all rows with a text and a language.

    No such rows give a model without languages, which answers ``und``.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                got = np.bincount(trigrams(value, bits)[0], minlength=1 << bits)
                if name in sums:
                    sums[name] += got
                else:
                    sums[name] = got
        for name, got in sums.items():
            slots = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(got[slots], pa.int64())], names=["lang", "slot", "n"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna().mapInArrow(count, "lang string, slot int, n long")
    table = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique().tolist())
    counts = np.zeros((1 << bits, len(names)))
    counts[table["slot"].to_numpy(np.int64), np.searchsorted(names, table["lang"].to_numpy(str)) if names else []] = table["n"]
    smooth = counts + 0.05
    return LanguageModel(names, np.log(smooth / smooth.sum(0)).astype(np.float32), bits)


ADDED = T.StructType([
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("shares", T.ArrayType(T.DoubleType())),
])


def with_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append the selected languages by falling share and their shares.

    Both are empty for null texts and texts without a letter.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.names, model.logp, model.bits, model.penalty))

    def make():
        own = LanguageModel(*held.value)

        def infer(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            got = [own.infer(t) for t in batch.column(text).to_pylist()]
            return {"languages": pa.array([g[0] for g in got], pa.list_(pa.string())), "shares": pa.array([g[1] for g in got], pa.list_(pa.float64()))}

        return infer

    return with_columns(docs, make, ADDED)
