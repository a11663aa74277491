"""A quality classifier: regularised quadratic discriminant analysis of transformed document statistics."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, materialize, packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WS = r"[\x20\x09-\x0D]+"


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def statistics(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Transformed statistics of a whole text, by name: shares by square root, sizes by logarithm."""
    n, w = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    share = {
        "upper": _count(t, "A-Z"), "symbols": _count(t, "#*$%&<>@=+~^_{}\\\\\\[\\]"), "shouts": _count(t, "!?"), "bars": _count(t, "|"), "digits": _count(t, "0-9"),
        "stops": _count(t, ".,;:"), "space": _count(t, r"\x20\x09-\x0D"), "beyond": _count(t, r"\x{80}-\x{10FFFF}"),
    }
    out = {k: F.sqrt(v / n) for k, v in share.items()}
    out["words"] = F.log1p(F.size(words))
    out["length"] = F.log1p(F.length(t) / w)
    out["distinct"] = F.sqrt(F.size(F.array_distinct(words)) / w)
    out["same_lines"] = F.sqrt(1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)))
    out["line"] = F.log1p(F.size(words) / F.greatest(F.size(lines), F.lit(1)))
    return out


@dataclass
class Model:
    """Class means, inverse Cholesky factors of the shrunk covariances (made once), and log-density constants."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row."""
        z = (x - self.centre) / self.scale
        density = [o - 0.5 * np.square((z - m) @ f.T).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_sphere: float = 0.02) -> Model:
    """From each class's count, sums and products of pairs. A class without rows takes the pooled moments and half a row."""
    d = len(next(iter(moments.values()))[1])
    n, s, p = (reduce(lambda a, b: a + b, [m[i] for m in moments.values()]) for i in range(3))
    n = max(n, 1)
    centre = s / n
    scale = np.sqrt(np.maximum(np.diag(p) / n - centre**2, 1e-6))
    pooled = (p / n - np.outer(centre, centre)) / np.outer(scale, scale)
    means, factors, offsets = [], [], []
    for c in (0, 1):
        k, sums, products = moments.get(c, (0, np.zeros(d), np.zeros((d, d))))
        mean = sums / k if k else centre
        own = (products / k - np.outer(mean, mean)) / np.outer(scale, scale) if k > d else pooled
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_sphere) * cov + to_sphere * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        low = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(max(k, 0.5) / n) - np.log(np.diag(low)).sum()))
    return Model(centre, scale, means, factors, offsets)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_hash) for each row of `docs`.

    Every labelled row with crc32(doc_id) mod 5 other than 0 is learnt from, through sums that Spark adds up: no sample.
    Labels with a null doc_id or quality are left out; a doc_id with both labels counts in both classes. Null and empty
    texts are scored from the statistics of the empty text; a null doc_id is not held out. Without any labels all scores
    are 0.5. Repeated rows each give a row; an empty table gives an empty result. doc_id counts as a long. Texts of any
    length are taken whole. Extra columns are not read.
    """
    stats = statistics(F.col("t"), F.col("words"), F.col("lines"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    t = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", held.alias("held_out"), t.alias("t"), F.filter(F.split(t, _WS), lambda w: w != "").alias("words"), F.filter(F.split(t, "\n"), lambda x: x != "").alias("lines"))
    rows = split.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.xxhash64("t").alias("text_hash"), F.array(*[c.cast("double") for c in stats.values()]).alias("x"))
    rows = materialize(rows, "quality-stats")
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    d = len(stats)
    each = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.count("*").alias("n")] + [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in each]
    moments = {}
    for r in rows.filter(~F.col("held_out")).join(known, "doc_id").groupBy("quality").agg(*sums).collect():  # two rows
        products = np.zeros((d, d))
        for i, j in each:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        moments[r.quality] = (r.n, np.array([r[f"s{i}"] for i in range(d)]), products)
    model = fit(moments or {0: (0, np.zeros(d), np.zeros((d, d)))})

    def run(batches):
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), b.column(2)], ["doc_id", "held_out", "score", "predicted", "text_hash"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, text_hash long")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_broadcast: int = 1_000_000) -> DataFrame:
    """`docs` without the rows that the classifier rejects, all columns as they were, whatever their names.

    Nulls, empty tables, repeated rows and long texts are met as in quality_scores(); an empty text is scored, not spared.
    """
    docs, back = packed(docs, "doc_id", "text")
    bad = quality_scores(docs, labels, threshold).filter("predicted = 0").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    bad = materialize(bad, "rejected")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_bad_hash"))
    return back(docs.join(broadcast_if_small(bad, bad.count(), most_broadcast), same, "left_anti"))
