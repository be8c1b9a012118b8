"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. Normal equations are summed
per partition and then by Spark; what reaches the driver is one matrix of the size of the feature
space, and the calibration's bins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.calibration import calibrated, isotonic
from reelspark.llm.common import labelled, remainder, written

FEATURES = 160
WIDTH = 2.5  # of the kernel, in standard deviations of one statistic
RIDGE = 1e-3
BINS = 400
BLOCK = 1 << 20  # bytes given to the compressor at a time
#: At most about so many labelled rows are learned from.
LABELLED = 50_000
SYMBOLS = b"#*$%&|<>{}[]=_~^@\\/"
STATISTICS = (
    "log_words", "word_length", "longest", "symbols", "digits", "upper", "stops", "commas", "wide", "bars",
    "distinct", "doubled", "most_frequent", "line_words", "doubled_lines", "squeeze",
)


def _squeezed(raw: bytes) -> int:
    """Size of the whole text compressed, without holding the result."""
    packer = zlib.compressobj(1)
    blocks = (raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK))
    return sum(len(packer.compress(block)) for block in blocks) + len(packer.flush())


def statistics(text: str | None) -> list[float]:
    """Shape of a text in numbers, zero for an empty one."""
    raw = (text or "").encode()
    tokens = raw.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(raw)
    without = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(tokens)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)),
        sum(map(len, tokens)) / n,
        float(np.log1p(max(map(len, tokens)))),
        without(SYMBOLS),
        without(b"0123456789"),
        without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        without(b"."),
        without(b",;:!?"),
        (size - len(text or "")) / size,
        counts[b"|"] / n,
        len(counts) / n,
        sum(map(bytes.__eq__, tokens[1:], tokens[:-1])) / n,
        max(counts.values()) / n,
        float(np.log1p(n / len(lines))),
        1.0 - len(set(lines)) / len(lines),
        _squeezed(raw) / size if size > 200 else 1.0,
    ]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=STATISTICS)
        out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
        yield out


class Kernel:
    """Random Fourier features of statistics, with a constant; the same in every run."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        random = np.random.Generator(np.random.PCG64(7))
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = random.normal(0.0, 1.0 / width, (len(mean), features))
        self.phase = random.uniform(0.0, 2 * np.pi, features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.mean) / self.deviation, -6.0, 6.0)
        waves = np.cos(scaled @ self.turn + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([waves, np.ones((len(rows), 1))])


def _equations(kernel: Kernel):
    """Each partition's share of the normal equations: one row per row of the matrix, the right side last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x, y = kernel(batch[list(STATISTICS)].to_numpy(float)), batch["y"].to_numpy(float)
            part = np.hstack([x.T @ x, (x.T @ y)[:, None]])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    return run


def _raw(kernel: Kernel, weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "raw": kernel(batch[list(STATISTICS)].to_numpy(float)) @ weights})

    return run


def _scored(kernel: Kernel, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = kernel(batch[list(STATISTICS)].to_numpy(float)) @ weights
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": calibrated(raw, knots)})

    return run


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learned from labels.quality outside the held-out fold, about `bound` rows at most (by hash); the mean and
    deviation of the statistics are those of all documents. A null text is an empty one and scored
    as such. Without labels every score is one half. Repeated rows are scored each; a row without
    doc_id is scored and keeps its null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    measured = written(rows.mapInPandas(_measured, schema), "statistics")
    moments = measured.agg(
        *(F.coalesce(F.avg(s), F.lit(0.0)) for s in STATISTICS), *(F.coalesce(F.stddev_pop(s), F.lit(1.0)) for s in STATISTICS)
    ).first()
    kernel = Kernel(*np.array(moments, float).reshape(2, -1))
    learned = labelled(docs, labels, "quality", modulus, held_out, bound)
    train = written(measured.join(learned, "doc_id").repartition("doc_id"), "train")
    sums = train.mapInPandas(_equations(kernel), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    cells = sums.toPandas()  # one row per cell of the matrix
    system[cells["i"], cells["j"]] = cells["v"]
    left, right = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(left + RIDGE * max(1.0, left[-1, -1]) / FEATURES * np.eye(len(left)), right)
    bins = (
        train.mapInPandas(_raw(kernel, weights), "y int, raw double")
        .withColumn("bin", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) * BINS))
        .groupBy("bin")
        .agg(F.avg("raw").alias("x"), F.sum("y").alias("positives"), F.count("*").alias("n"))
        .orderBy("bin")
        .toPandas()  # 3 * BINS + 1 rows at most
    )
    knots = isotonic(bins["x"].to_numpy(float), bins["positives"].to_numpy(float), bins["n"].to_numpy(float))
    scored = measured.mapInPandas(_scored(kernel, weights, knots), "doc_id long, score double")
    fold = (remainder(modulus) == held_out).alias("held_out")
    return scored.select("doc_id", fold, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
