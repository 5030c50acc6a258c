"""Toxicity by cumulative-link ordinal regression over sparse word features (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import arrow_rows, stored

_WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that a fit takes at most; all documents are scored.
FIT_ROWS = 6000
GRADES = 4
#: A feature needs this many times the clean rows' share among the toxic rows, and a G-squared that chance alone gives
#: hardly any of the features looked at: twice the logarithm of their number.
MIN_LIFT = 6.0
#: Words whose features a worker remembers before it starts anew.
WORD_CACHE = 100_000


def features_of(word: str) -> tuple[str, ...]:
    """The word itself and its stems of four and five letters."""
    return ("=" + word, *("^" + word[:n] for n in (4, 5) if len(word) > n))


def feature_value(n: int) -> float:
    """Of a feature that n of a text's words have: that it is there, and how often."""
    return 1 + log(n)


@dataclass
class OrdinalModel:
    """P(grade >= j) = sigmoid(w x - theta_j): one weight vector for all ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, text: str | None, seen: dict | None = None) -> tuple[float, list[float]]:
        """(expected grade, P(grade >= j) for each j).  seen: remembers words' features from text to text."""
        counts: Counter = Counter()
        seen = {} if seen is None else seen
        if len(seen) > WORD_CACHE:
            seen.clear()
        for w in _WORD.findall((text or "").lower()):
            f = seen.get(w, 0)
            if f == 0:
                f = seen[w] = tuple(x for x in features_of(w) if x in self.weights) or None
            if f:
                counts.update(f)
        eta = sum(self.weights[f] * feature_value(n) for f, n in sorted(counts.items()))
        above = [1 / (1 + exp(min(60.0, t - eta))) for t in self.thresholds]
        return sum(above), above


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, d: int, grade: np.ndarray, grades: int, l2: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the mean of the thresholds' log losses; deterministic.

    Features are sparse: values at (rows, cols), d columns, a row for each of grade.
    """
    n = len(grade)
    cuts = np.arange(1, grades)
    y = (grade[:, None] >= cuts).astype(float)
    w, start, gaps = np.zeros(d), 0.0, np.zeros(grades - 2)
    m, v = np.zeros(d + grades - 1), np.zeros(d + grades - 1)
    for t in range(1, steps + 1):
        theta = start + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        eta = np.bincount(rows, values * w[cols], n)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -50, 50)))
        e = (p - y) / n
        by_cut = -e.sum(axis=0)
        up = by_cut[1:][::-1].cumsum()[::-1] * np.exp(gaps)
        g = np.concatenate((np.bincount(cols, values * e.sum(axis=1)[rows], d) + l2 * w, [by_cut.sum()], up))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, start, gaps = w - step[:d], start - step[d], gaps - step[d + 1 :]
    return w, start + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def _bound(counted: DataFrame) -> dict[str, int]:
    """The features that toxic rows have far more often than others, with the number of toxic rows that have them."""
    kinds = {r["bad"]: r["n"] for r in counted.groupBy((F.col("y") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    bad, good = kinds.get(True, 0), kinds.get(False, 0)
    if not bad or not good:
        return {}
    seen = counted.select("y", F.explode(F.map_keys("f")).alias("f")).groupBy("f").agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") <= 0).alias("good"))
    lift = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    both = F.col("bad") + F.col("good")
    g2 = 2 * sum(F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (bad + good) / (both * n))).otherwise(0.0) for c, n in (("bad", bad), ("good", good)))
    least = 2 * log(max(2, seen.count()))
    return {r["f"]: r["bad"] for r in seen.where((lift >= MIN_LIFT) & (g2 >= least)).collect()}  # of the fit's rows only


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, grades: int = GRADES
) -> OrdinalModel:
    """Fits on at most fit_rows labelled documents, chosen by a hash of the id.

    A label above 1 is a grade as it stands.  Where labels are 0 and 1 only, toxic rows get the grades 1 to grades - 1
    by the terciles (for four grades) of how many features of theirs are label-bound in the other half of the rows, so
    that no row's grade hangs on features chosen by that row.  Ids that are labelled twice have the higher label; a
    labelled id with several texts has them all.  Null labels and null texts are left out.  Without rows of both kinds
    nothing can be told apart, and the model calls nothing toxic.  Other columns are not read.
    """
    labelled = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    chosen = labelled.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "t", "y")  # fit_rows ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for t in batch.column(1):
                c: Counter = Counter()
                for w, n in Counter(_WORD.findall(t.as_py().lower())).items():
                    for f in features_of(w):
                        c[f] += n
                counts.append(list(c.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.map_(pa.string(), pa.int64()))], ["id", "y", "f"])

    counted = stored(arrow_rows(rows, run, "id long, y int, f map<string,bigint>"), "labelled")
    nothing = OrdinalModel({}, [50.0] * (grades - 1))
    kept = {f: i for i, f in enumerate(sorted(_bound(counted)))}
    if not kept:
        return nothing
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2))
    others = [_bound(counted.where(half == 1)), _bound(counted.where(half == 0))]  # a row's other half
    wanted = sorted({*kept, *others[0], *others[1]})
    data = counted.select("id", "y", F.map_filter("f", lambda k, _: k.isin(wanted)).alias("f"), half.cast("int").alias("half")).collect()  # the fit's rows
    data.sort(key=lambda r: (r["id"], r["y"], sorted(r["f"].items())))
    bound = np.array([sum(n for f, n in r["f"].items() if f in others[r["half"]]) for r in data])
    y = np.array([r["y"] for r in data])
    cells = [(i, kept[f], feature_value(n)) for i, r in enumerate(data) for f, n in sorted(r["f"].items()) if f in kept]
    if y.max() <= 1 and grades > 2:
        cuts = np.quantile(bound[y > 0], np.arange(1, grades - 1) / (grades - 1))
        y = np.where(y > 0, 1 + np.searchsorted(cuts, bound, side="left"), 0)
    at = [np.array(c) for c in zip(*cells, strict=True)]
    w, theta = fit_ordinal(at[0], at[1], at[2], len(kept), np.clip(y, 0, grades - 1), grades)
    return OrdinalModel({f: float(w[i]) for f, i in kept.items()}, [float(t) for t in theta])


def _scores(column: pa.Array, model: OrdinalModel, seen: dict) -> tuple[np.ndarray, np.ndarray]:
    """Severity and P(grade >= 1) of each text."""
    scored = [model.severity(t.as_py(), seen) for t in column]
    return np.array([x for x, _ in scored], dtype=float), np.array([a[0] for _, a in scored], dtype=float)


def keep_clean(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """The rows of docs that score_toxicity doesn't call toxic, each by its own text, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), model, seen)[1] < cut))

    return arrow_rows(docs, run, docs.schema)


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): one row per row of docs, whole texts.

    severity is the expected grade, grade its nearest whole number, toxic says whether P(grade >= 1) reaches `cut`.
    Null and empty texts have the severity of no features.  Repeated rows and null ids stay.  An empty table gives an
    empty result.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            s, p = _scores(batch.column(1), model, seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array(p), pa.array(np.rint(s).astype(np.int32)), pa.array(p >= cut)], ["doc_id", "severity", "p_toxic", "grade", "toxic"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_rows(rows, run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
