"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies are counted over all rows to learn from. The weights are
fitted on a bounded sample of these (MAX_TRAIN rows, the same share of rows of
each language at most) by follow-the-regularised-leader with an elastic net,
which leaves most weights at zero; a temperature is then fitted on sampled rows
that were set aside. Every whole text is scored.

Defined cases: a text that is null or has no letter is `und` with score 0, as
is every text when there is nothing to learn from; rows with a null language
teach nothing; a null id is neither held out nor learned from; repeated rows
repeat their result; an empty table gives an empty result; more than MAX_LANGS
languages raise an error; only text, language
and id are read, and the last two never for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Hash buckets of n-grams, lengths of these.
D, ORDERS = 1 << 14, (1, 2, 3)
#: Rows that the weights are fitted on, and languages, at most.
MAX_TRAIN, MAX_LANGS = 3_000, 500
EPOCHS = 3
#: FTRL: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01


def grams(text: str):
    """Buckets of a lower-cased text's n-grams and how often each occurs."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    count = np.zeros(D, np.int64)
    h = np.full(len(c), 0, np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                count += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(18), minlength=D)
    at = np.flatnonzero(count)
    return at, count[at]


def vector(text: str, idf):
    """Buckets and unit-length TF-IDF weights."""
    import numpy as np

    at, n = grams(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(1e-9, float(np.sqrt(v @ v)))


def softmax(z):
    import numpy as np

    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(vectors: list, y, n_langs: int, seed: int = 5):
    """Weights (buckets and an offset by languages) by proximal follow-the-regularised-leader."""
    import numpy as np

    z, n = np.zeros((D + 1, n_langs)), np.zeros((D + 1, n_langs))

    def weights(at):
        free = np.abs(z[at]) > L1
        return np.where(free, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(vectors)):
            at, v = np.append(vectors[i][0], D), np.append(vectors[i][1], 1.0)
            w = weights(at)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(D + 1))


def temperature(z, y) -> float:
    """What to divide scores by for the least log loss, by golden section over its logarithm."""
    import numpy as np

    def loss(t):
        return -np.log(np.maximum(softmax(z / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def learn(rows: DataFrame):
    """(languages, idf, weights, temperature) from rows of doc_id, text, lang; null if there are none."""
    import numpy as np

    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    names = sorted(r.lang for r in langs)
    total = sum(r.n for r in langs)

    def frequencies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df = np.zeros(D, np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    df[grams(t.as_py())[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["k", "n"])

    df = np.zeros(D)
    for r in rows.select("text").mapInArrow(frequencies, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():  # D rows at most
        df[r.k] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1

    part = F.create_map(*[F.lit(x) for r in langs for x in (r.lang, min(1.0, MAX_TRAIN / len(langs) / r.n))])
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) <= part[F.col("lang")] * (1 << 30)).limit(MAX_TRAIN + MAX_TRAIN // 2)

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [vector(t or "", idf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(x) for x in b.column(0).to_pylist()]), b.column(2), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())],
                names=["id", "lang", "at", "v"],
            )

    got = sorted(some.select("doc_id", "text", "lang").mapInArrow(vectors, "id string, lang string, at binary, v binary").collect(), key=lambda r: (r.id, r.lang, r.at))
    xs = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.v, np.float32).astype(float)) for r in got]
    y = np.array([names.index(r.lang) for r in got])
    aside = np.arange(len(xs)) % 5 == 4
    w = ftrl([x for x, a in zip(xs, aside, strict=True) if not a], y[~aside], len(names))
    z = np.array([v @ w[at] + w[D] for (at, v), a in zip(xs, aside, strict=True) if a])
    return names, idf, w, temperature(z, y[aside]) if len(z) else 1.0


def detect_language(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score. Rows where held_out holds are not learned from."""
    import numpy as np
    import re

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    model = learn(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    letter = re.compile(r"[^\W\d_]").search

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pred, score = [], []
            for t in b.column(2):
                t = t.as_py()
                if model is None or not t or not letter(t):
                    pred.append("und"), score.append(0.0)
                    continue
                names, idf, w, heat = model
                at, v = vector(t, idf)
                p = softmax((v @ w[at] + w[D]) / heat)
                best = int(np.argmax(p))
                pred.append(names[best]), score.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return detect_language(table(spark, sf_dir, "documents"), F.coalesce(turn, F.lit(False)))
