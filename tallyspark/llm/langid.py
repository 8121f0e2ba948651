"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its 3- and 4-byte sequences (ASCII letters in lower case, other ASCII as word boundaries, a boundary only at
either end), hashed into BUCKETS rows of an embedding table. Their mean goes through a linear softmax. The logits are
scaled by a temperature fitted on labelled texts kept out of training, and a text is rejected if its calibrated score,
or the share of its features that training has seen, lies below what all but REJECT of those texts reach.

Training takes a bounded sample: SAMPLE labelled texts, in equal shares by language, chosen by a hash of id and text, and of
a text of more than LONGEST characters a piece of that length at a place chosen by the hash. If the labels name more
than MOST_LANGUAGES languages, the most frequent ones are learned, ties by name. Prediction reads whole texts.

Defined cases: a null text and one without a letter are `und` with score 0 and rejected; without any labelled text all
are; rows with a null id or language are not learned from; of languages that tie for a text the first by name holds; repeated rows get equal results; very long texts are
read in pieces; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted
from .wordhash import buffers, give_back, tidy

BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 16, 5, 0.5
SAMPLE, LONGEST, MOST_LANGUAGES = 3000, 20_000, 500
REJECT = 0.001
#: A text is never rejected at a calibrated score or a share of known features above these.
SURE_SCORE, SURE_SHARE = 0.5, 0.6
PIECE = 1 << 18


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the places of the bytes where they start."""
    fold = np.full(256, 32, dtype=np.uint32)
    fold[97:123] = fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)
    b = fold[data]
    if len(b) < 3:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
    inner = b != 32
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    with np.errstate(over="ignore"):
        ok3 = np.flatnonzero(inner[1:-1])
        id3 = (three[ok3] * np.uint32(2654435761)) >> np.uint32(15)
        ok4 = np.flatnonzero(inner[1:-2] & inner[2:-1])
        id4 = ((three[ok4] | b[3:][ok4] << np.uint32(24)) * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(15)
    return np.concatenate([id3, id4]).astype(np.int32), np.concatenate([ok3, ok4])


def framed(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + text + b" ", dtype=np.uint8)


def fit(texts: list[str], langs: list[str], held: list[bool], seed: int = 1) -> dict | None:
    """A model from labelled texts; held: those for calibration only."""
    names = sorted(set(langs))
    if not names:
        return None
    rng, k = np.random.default_rng(seed), len(names)
    bags = [features(framed(t.encode()))[0] for t in texts]
    y = np.array([names.index(x) for x in langs])
    learn = [i for i in range(len(bags)) if not held[i] and len(bags[i])] or [i for i in range(len(bags)) if len(bags[i])]
    check = [i for i in range(len(bags)) if held[i] and len(bags[i])] or learn
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((DIM, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    weight[:, :] = rng.normal(0, 0.3, (DIM, k))
    known = np.zeros(BUCKETS, dtype=bool)
    steps, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            bag = bags[i]
            known[bag] = True
            if done % 2:  # every other step sees a short piece, so that short texts are known too
                at = rng.integers(0, max(1, len(bag) - 60))
                bag = bag[at : at + 60]
            rows, n = np.unique(bag, return_counts=True)
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[rows]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            table[rows] -= (10 * rate) * np.outer(share, back)
            done += 1
    values = table @ weight if k <= DIM else table
    z, seen = [], []
    for i in check:
        cut = bags[i]
        z.append(table[cut].mean(axis=0) @ weight + bias)
        seen.append(known[cut].mean())
    z, seen, yc = np.array(z), np.array(seen), y[check] if len(check) else y[:0]
    best = (np.inf, 1.0)
    for scale in 2.0 ** np.arange(-3, 4, 0.25) if len(check) else []:
        q = z * scale
        q = q - q.max(axis=1, keepdims=True)
        loss = -(q[np.arange(len(yc)), yc] - np.log(np.exp(q).sum(axis=1))).mean()
        best = min(best, (float(loss), float(scale)))
    scale = best[1]
    low_score = low_share = 0.0
    if len(check):
        q = np.exp(scale * (z - z.max(axis=1, keepdims=True)))
        low_score = min(SURE_SCORE, float(np.quantile((q / q.sum(axis=1, keepdims=True)).max(axis=1), REJECT)))
        low_share = min(SURE_SHARE, float(np.quantile(seen, REJECT)))
    return {"names": names, "values": values.astype(np.float32), "weight": None if k <= DIM else weight, "bias": bias, "scale": scale, "known": known, "low_score": low_score, "low_share": low_share}


def _predict(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = model.value if hasattr(model, "value") else model
    letter = np.zeros(256, dtype=bool)
    letter[65:91] = letter[97:123] = True
    for batch in batches:
        rows = len(batch)
        data, at = buffers(batch.column(1))
        lang, score, share, out = np.full(rows, -1), np.zeros(rows), np.zeros(rows), np.ones(rows, dtype=bool)
        for k in range(rows):
            text = data[at[k] : at[k + 1]]
            if not (letter[text[:4096]].any() or letter[text].any()) and not any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace")):
                continue
            if m is None:
                continue
            total, n, hits = np.zeros(m["values"].shape[1]), 0, 0
            for lo in range(0, len(text), PIECE):  # pieces overlap by the three bytes that a feature may still need
                part = text[lo : lo + PIECE + 3]
                part = np.concatenate([[32] if lo == 0 else [], part, [32] if lo + PIECE + 3 >= len(text) else []]).astype(np.uint8)
                ids, places = features(part)
                if lo + PIECE < len(text):
                    ids = ids[places < PIECE + (lo == 0)]
                total += m["values"][ids].sum(axis=0, dtype=np.float64)
                hits += int(m["known"][ids].sum())
                n += len(ids)
            mean = total / max(n, 1)
            z = (mean if m["weight"] is None else mean @ m["weight"]) + m["bias"]
            p = np.exp(m["scale"] * (z - z.max()))
            p /= p.sum()
            lang[k], score[k], share[k] = int(p.argmax()), float(p.max()), hits / max(n, 1)
            out[k] = score[k] < m["low_score"] or share[k] < m["low_share"]
        names = [*(m["names"] if m else []), "und"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[x] for x in lang], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(share), pa.array(out), *batch.columns[2:]], ["id", "lang_pred", "score", "known_share", "rejected", *batch.schema.names[2:]])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """A model from docs whose crc32 of the id as text, modulo 4, is not 2: 3 calibrates, 0 and 1 train. None without labels."""
    rest = F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 4
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), text.alias("text"), F.col(quoted(lang_col)).alias("lang"), rest.alias("rest")).where("lang is not null and text is not null and rest <> 2")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    quota = max(20, sample // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, quota / r["count"])))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    picked = rows.withColumn("draw", draw).where(F.col("draw") / float(1 << 30) < F.try_element_at(share, F.col("lang")))
    piece = F.substring(F.col("text"), F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - LONGEST, F.lit(0)) + 1).cast("int") + 1, F.lit(LONGEST))
    # Twice as many as are to be expected: the bound on what comes to the driver.
    few = picked.orderBy("draw", "id", "text").limit(2 * sample + 20 * len(counts)).select("id", piece.alias("text"), "lang", "rest")
    got = sorted((r["id"], r["text"], r["lang"], r["rest"] == 3) for r in few.collect())
    model = fit([r[1] for r in got], [r[2] for r in got], [r[3] for r in got])
    del got
    give_back()
    return model


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, known_share, rejected) for each row of docs."""
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(model)  # BUCKETS rows of at most DIM numbers: up to 8.4 MB
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(lambda b: tidy(_predict(shared, b)), f"id {kind}, lang_pred string, score double, known_share double, rejected boolean")
