"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams (of one to MAX_N
characters, hashed to ``2**BITS`` places) that both hold, over the root of the product of their numbers.
Kernel ridge regression, one against the rest, is solved in the span of Nyström landmarks. As the
kernel is an inner product of presence vectors, the landmarks and their coefficients fold to one
matrix of fixed size, and a batch of whole texts is scored by one matrix product.

Training takes at most SAMPLE labelled rows, chosen by hash and spread evenly over the languages. Each of SALTS
parts of a language's hashes gives its share at most.

Defined results: a text that is null or has no letter is ``und`` with score 0; without training rows
every text is; repeated rows are judged alike; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, without

BITS = 14
MAX_N = 3
SAMPLE = 3000
SALTS = 64
LANDMARKS = 400
RIDGE = 1e-3
#: Margins are spread so that a clear decision scores near one.
SHARPNESS = 4.0
BATCH = 128


def places(text: str) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, MAX_N + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        found.append(((h ^ (h >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def presence(texts: list[str]) -> np.ndarray:
    """Presence vectors, divided by the root of the number of n-grams present."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, t in enumerate(texts):
        out[i, places(t)] = 1
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def fit(x: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of weights; the first rows of ``x`` are the landmarks."""
    names = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    marks = x[:LANDMARKS].astype(np.float64)
    k_nm, k_mm = x @ x[:LANDMARKS].T, marks @ marks.T
    k_nm = k_nm.astype(np.float64)
    left = k_nm.T @ k_nm + RIDGE * len(x) * k_mm
    left += 1e-9 * np.trace(left) * np.eye(len(left))
    return names, (marks.T @ np.linalg.solve(left, k_nm.T @ y)).astype(np.float32)


def train(df: DataFrame, key: str, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Learns from the rows of ``df``. Presence vectors are made on the executors and come as bits."""
    by_hash = Window.partitionBy("l").orderBy("h", "k")
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.xxhash64(F.lit(3), key).alias("h"))
    # First by language and salt, each with its share of the sample, so that about SAMPLE rows meet for one language however many it has.
    salted = Window.partitionBy("l", F.pmod("h", F.lit(SALTS))).orderBy("h", "k")
    rows = rows.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= -(-SAMPLE // SALTS)).drop("n")
    chosen = rows.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= SAMPLE).orderBy("n", "l", "h").limit(SAMPLE).select("k", "n", "l")
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l2")).filter("t is not null")
    # SAMPLE rows at most are broadcast. A chosen row brings one text: where a key stands on several rows, one of each language.
    picked = texts.join(F.broadcast(chosen), "k").filter("l = l2").groupBy("n", "l").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("one"))
    picked = picked.select("n", "l", F.col("one.t").alias("t"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.packbits(presence([t])[0] > 0).tobytes() if has_letter(t) else None for t in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["n", "l", "b"])

    got = sorted((r.n, r.l, bytes(r.b)) for r in picked.mapInArrow(bits, "n int, l string, b binary").collect() if r.b is not None)[:SAMPLE]
    if not got:
        return [], np.zeros((1 << BITS, 0), np.float32)
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for _, _, b in got]).astype(np.float32)
    return fit(x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)), [name for _, name, _ in got])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``df`` less its text, with ``lang_pred`` and ``score``."""
    names, weights = model
    rest = without(df, text, "lang_pred", "score").columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"c{i} {kinds[c]}" for i, c in enumerate(rest)] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            for a in range(0, n, BATCH):
                texts = {i: t for i, x in enumerate(batch.column(len(rest)).slice(a, BATCH), a) if (t := x.as_py()) and has_letter(t)}
                if texts and names:
                    at = list(texts)
                    out = SHARPNESS * (presence(list(texts.values())) @ weights).astype(np.float64)
                    out = np.exp(out - out.max(axis=1, keepdims=True))
                    best = out.argmax(axis=1)
                    pred[at] = np.array(names, object)[best]
                    score[at] = out.max(axis=1) / out.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=out_names)

    out_names = [f"c{i}" for i in range(len(rest))] + ["lang_pred", "score"]
    done = df.select(*[F.col(f"`{c}`") for c in rest], text).mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], "lang_pred", "score")


def identify(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, lang_pred, score)`` for every row; the model learns from the rows where ``learn`` holds."""
    model = train(df.filter(learn), key, text, lang)
    tables = Tables(df.sparkSession)
    done = tables.save(predict(df.select(key, text), model, text), "languages")
    tables.keep_until_exit()
    return done
