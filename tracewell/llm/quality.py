"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its surface statistics by a small
network; gated attention weighs the passages; the weighted sum gives the document's score. Only
documents are labelled: the weights are learned from their labels. Training runs in numpy on a
bounded sample of labelled documents; scoring reads every passage of every text in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_fold, limit_batches

#: Words of a passage; bounds on the labelled documents to learn from and on the UTF-8 bytes of their texts.
PASSAGE_WORDS, SAMPLE, SAMPLE_BYTES = 80, 6000, 64 << 20
#: Hidden sizes, training epochs, step size, weight decay, seed.
ENCODED, GATE, EPOCHS, STEP, DECAY, SEED = 24, 12, 40, 0.01, 1e-4, 11

#: Byte classes: every ASCII sign its own; letters, capitals, digits and non-ASCII bytes one each.
_CLASSES = np.zeros(256, np.intp)
for _b in range(256):
    _CLASSES[_b] = 0 if 97 <= _b < 123 else 1 if 65 <= _b < 91 else 2 if 48 <= _b < 58 else 3 if _b >= 128 else 4 if _b < 32 else 5
_SIGNS = [b for b in range(33, 127) if _CLASSES[b] == 5]
for _k, _b in enumerate(_SIGNS):
    _CLASSES[_b] = 6 + _k
_N_CLASSES = 6 + len(_SIGNS)
#: Coarse classes for pairs of neighbouring bytes: letter, capital, digit, non-ASCII, control, space, sign.
_COARSE, _KINDS = np.where(_CLASSES < 6, _CLASSES, 6), 7
FEATURES = _N_CLASSES + _KINDS**2 + 5


def passages(text: str | None) -> np.ndarray:
    """A row of FEATURES statistics for each passage of a text; a text without words has one row of zeros."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = max(1, -(-len(words) // PASSAGE_WORDS))
    out = np.zeros((n, FEATURES), np.float32)
    if not words:
        return out
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    for k in range(n):
        part = words[k * PASSAGE_WORDS : (k + 1) * PASSAGE_WORDS]
        raw = np.frombuffer(b" ".join(part), np.uint8)
        size = len(raw)
        row = out[k]
        row[:_N_CLASSES] = np.sqrt(np.bincount(_CLASSES[raw], minlength=_N_CLASSES) / size)
        coarse = _COARSE[raw]
        row[_N_CLASSES:-5] = np.sqrt(np.bincount(coarse[:-1] * _KINDS + coarse[1:], minlength=_KINDS**2) / size)
        row[-5:] = (size / len(part) / 10, len(set(part)) / len(part), np.log1p(len(part)), repeated, max(map(len, part)) / 50)
    return out


@dataclass
class MilModel:
    """Passage encoder, gated attention and output, on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(x: np.ndarray) -> MilModel:
        rng = np.random.default_rng(SEED)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        p = {"W": draw(FEATURES, ENCODED), "b": np.zeros(ENCODED), "V": draw(ENCODED, GATE), "U": draw(ENCODED, GATE), "w": draw(GATE, 1)[:, 0], "o": draw(ENCODED, 1)[:, 0], "c": np.zeros(1)}
        return MilModel(x.mean(0), x.std(0) + 1e-2, p)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Bags are runs of rows of x that begin at starts."""
        p, sizes = self.p, np.diff([*starts, len(x)])
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "y": 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))}

    def gradients(self, f: dict[str, np.ndarray], starts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, d = self.p, (f["y"] - label) / len(label)
        rep = lambda v: np.repeat(v, f["sizes"], axis=0)
        dz = rep(d[:, None] * p["o"])
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - rep(np.add.reduceat(f["a"] * da, starts)))
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> None:
        """Adam on batches of bags."""
        rng = np.random.default_rng(SEED)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                x = np.concatenate([bags[k] for k in pick])
                starts = np.cumsum([0, *[len(bags[k]) for k in pick[:-1]]])
                grads = self.gradients(self.forward(x, starts), starts, labels[pick])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    a, b = m[k]
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    self.p[k] -= STEP * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        return self.forward(np.concatenate(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]]))["y"]


def within(sizes: list[int], budget: int) -> list[int]:
    """The places of the sizes that are taken in order while their sum stays within the budget."""
    taken, total = [], 0
    for k, size in enumerate(sizes):
        if total + size <= budget:
            taken.append(k)
            total += size
    return taken


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 1) -> MilModel | None:
    """Learn from labelled documents outside the held-out fold; None if no labelled text is there.

    A hash of the id picks about SAMPLE labelled documents (all where there are fewer). Their sizes
    are read first, and documents are taken in the order of their hashes while their texts, whole,
    hold SAMPLE_BYTES together; one that would pass that bound is left out. A passage's statistics
    take 2.3 times its text's bytes at most, so this bounds what reaches the driver. Of contradicting labels
    of one id the greater counts; null labels do not. A repeated id counts once, with its greatest text.
    """
    limit_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").cast("double").alias("label"))
    if held_out is not None:
        known = known.where(crc_fold("label_id", 3) != held_out)
    total = known.count()
    if not total:
        return None
    share = min(1.0, SAMPLE / total)
    draw = F.pmod(F.xxhash64("label_id", F.lit("quality sample")), F.lit(1 << 20))
    sample = known.where(draw < share * (1 << 20)).withColumn("draw", draw)
    same = F.col("doc_id").cast("long") == F.col("label_id")
    sizes = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("size")).join(F.broadcast(sample), same)
    sizes = sizes.groupBy("label_id", "label", "draw").agg(F.max("size").alias("size")).orderBy("draw", "label_id").toArrow()
    taken = within(sizes["size"].to_pylist(), SAMPLE_BYTES)
    if not taken:
        return None
    chosen = docs.sparkSession.createDataFrame(sizes.select(["label_id", "label", "size"]).take(pa.array(taken)))
    whole = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("size")
    picked = docs.join(F.broadcast(chosen), same & whole).select("label_id", "label", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["label_id", "label", "bag"])

    # repeated ids give equal labels and sizes; one row of each is enough to learn from
    got = picked.mapInArrow(run, "label_id long, label double, bag binary").groupBy("label_id").agg(F.first("label").alias("label"), F.min("bag").alias("bag")).orderBy("label_id").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got["bag"].to_pylist()]
    if not bags:
        return None
    model = MilModel.fresh(np.concatenate(bags))
    model.fit(bags, got["label"].to_numpy())
    return model


def score_documents(docs: DataFrame, model: MilModel | None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of 0.5 or more) for every whole text, every passage read.

    One row per input row, so none for an empty table; null and empty texts are scored as one passage
    of zeros. Without a model (no labelled text to learn from) every score is 0.5. Only the text is read.
    """
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t) for t in batch.column(1).to_pylist()]
            score = shared.value.score(bags) if shared.value is not None else np.full(len(bags), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted per document; learned outside the fold. An empty table gives no rows."""
    model = train(docs, labels)
    return score_documents(docs, model).select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
