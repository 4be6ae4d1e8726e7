"""Quality classifier: document evidence with hierarchical empirical Bayes priors of hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replicalens.llm.common import few, slices
from replicalens.session import materialize

TARGETS = ("poor", "toxic")
#: Bins of the ratios below, as upper limits.
BINS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
LENGTHS = (0, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)


def _bin(value: float, limits: tuple) -> int:
    return sum(value > x for x in limits)


def features(text: str) -> set[str]:
    """Words (lower case, without marks at their ends), their beginnings, and binned shape ratios of a text."""
    words = text.split()
    n = max(1, len(words))
    out = {w.strip(".,;:!?\"'()*$%&#|<>").lower() for w in words}
    out |= {f"{w[:k]}-" for w in out for k in (4, 5) if len(w) > k + 1}
    lines = [x for x in text.split("\n") if x.strip()]
    ratios = {
        "symbols": sum(map(text.count, "#*$%&|<>")) / n, "shouts": text.count("!") / n, "upper": sum(map(str.isupper, words)) / n,
        "unique": len(set(words)) / n, "again": sum(map(str.__eq__, words, words[1:])) / n,
        "lines": len(lines) / n, "copied": 1 - len(set(lines)) / max(1, len(lines)), "digits": sum(map(text.count, "0123456789")) / max(1, len(text)),
        "links": (text.count("://") + text.count("<")) / n, "stops": text.count(".") / n,
    }
    out |= {f"{k}={_bin(v, BINS)}" for k, v in ratios.items()}
    out |= {f"words={_bin(len(words), LENGTHS)}", f"letters={int(sum(map(len, words)) / n)}"}
    out.discard("")
    return out


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, poor, toxic), one row per labelled doc_id, as 0 or 1; rows without either label, or without id, are left out. Of contrary labels the
    worse one counts."""
    return labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0).cast("int")).alias("poor"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, turns: int = 25) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps; the last column of ``x`` is 1 and not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30).astype(np.float64)))
        slope = x.T @ (p - y).astype(np.float32) + penalty * w
        curve = (x.T * np.maximum(p * (1 - p), 1e-6).astype(np.float32)) @ x + np.diag(penalty)
        step = np.linalg.solve(curve.astype(np.float64), slope.astype(np.float64))
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_evidence(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 400, least_docs: int = 5, least_z: float = 4.0,
                 ridge: float = 100.0, doc_id: str = "doc_id", text: str = "text") -> dict[str, tuple[float, ...]]:
    """Weights (poor, toxic) of features being present, and under the empty name those that all documents get.

    Fitted on at most about ``max_rows`` labelled documents, chosen by a hash of doc_id; those rows (three small columns) are the only thing
    broadcast. Features are counted by a grouped aggregate. For each target the ``max_features`` are taken that are in ``least_docs`` documents and whose
    shares differ most, by ``least_z`` standard errors at least. A logistic regression on them, with a penalty of ``ridge`` over the number of documents, gives weights, less the log-odds of the sample's rate: what is
    left is evidence against a rate of 1/2, to which a site's log-odds can be added. Sample, matrix and model are bounded by the parameters.
    """
    n = labels.count()
    if not n:
        return {}
    share = int(min(1.0, max_rows / n) * 1_000_000)
    sample = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = materialize(rows.select("poor", "toxic", "text").repartition(max(1, min(64, n // 500))), "fit-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            values = list(zip(*counts.values()))
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(v, pa.int64()) for v in values)], names=["feature", "n", *TARGETS])
            counts.clear()
            return out

        for batch in slices(batches, 2):
            for poor, toxic, t in zip(*(c.to_pylist() for c in batch.columns)):
                for f in (*features(t or ""), ""):  # the empty name counts all documents
                    c = counts.setdefault(f, [0, 0, 0])
                    c[0] += 1
                    c[1] += poor or 0
                    c[2] += toxic or 0
            if len(counts) > 500_000:
                yield flush()
        if counts:
            yield flush()

    counted = rows.mapInArrow(count, "feature string, n long, poor long, toxic long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    counted = materialize(counted.filter((F.col("n") >= least_docs) | (F.col("feature") == "")), "feature-counts")
    every = counted.filter("feature = ''").first()
    if every is None:
        return {}
    chosen: dict[str, list[str]] = {}
    for t in TARGETS:
        yes, no = every[t], every["n"] - every[t]
        if yes and no:
            p = F.col("n") / every["n"]
            z = F.abs(F.col(t) / yes - (F.col("n") - F.col(t)) / no) / F.sqrt(p * (1 - p) * (1 / yes + 1 / no))
            strong = counted.filter((F.col("feature") != "") & (F.col("n") < every["n"])).select("feature", z.alias("z")).filter(F.col("z") >= least_z)
            chosen[t] = [r[0] for r in strong.orderBy(F.col("z").desc(), "feature").limit(max_features).collect()]
    if not chosen:
        return {}
    names = sorted(set().union(*chosen.values()))
    place = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            lists = [[place[f] for f in features(t or "") if f in place] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["poor", "toxic", "at"])

    got = rows.mapInArrow(present, "poor int, toxic int, at array<int>").toPandas()
    x = np.zeros((len(got), len(names) + 1), dtype=np.float32)
    x[:, -1] = 1
    x[np.repeat(np.arange(len(got)), got["at"].map(len)), np.concatenate([np.asarray(a, dtype=np.int64) for a in got["at"]] or [[]]).astype(np.int64)] = 1
    weights = {f: [0.0, 0.0] for f in (*names, "")}
    for i, t in enumerate(TARGETS):
        if t not in chosen:
            continue
        y, columns = got[t].fillna(0).to_numpy(), [*(place[f] for f in chosen[t]), len(names)]
        w = _logistic(x[:, columns], y, ridge / len(y))
        w[-1] -= log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        for f, v in zip((*chosen[t], ""), w):
            weights[f][i] = float(v)
    return {f: tuple(v) for f, v in weights.items()}


def evidence(model: dict[str, tuple[float, ...]], text: Column) -> Column:
    """Struct (poor, toxic) of the summed weights of the features a text has."""
    all_get = model.get("", (0.0, 0.0))

    @F.arrow_udf("struct<poor:double,toxic:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sums = [tuple(map(sum, zip(all_get, *sorted(model[f] for f in features(t or "") if f in model)))) for part in few(texts) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([s[i] for s in sums], pa.float64()) for i in (0, 1)], names=list(TARGETS))

    return run(text)


def _strength(groups: DataFrame, mean: Column, weight: float = 1e4) -> float:
    """Beta prior strength of groups (n, k) around ``mean`` by the method of moments; ``weight`` if they don't differ beyond chance."""
    n, rate = F.col("n"), F.col("k") / F.col("n")
    spread, noise, rows, squares, base = groups.filter("n > 0").agg(
        F.sum(n * (rate - mean) ** 2), F.sum(mean * (1 - mean)), F.sum("n"), F.sum(n * n), F.avg(mean * (1 - mean))).first()
    if not rows or rows * rows <= squares:
        return weight
    between = ((spread or 0.0) - (noise or 0.0)) / (rows - squares / rows)
    return min(weight, max(1.0, base / between - 1)) if between > 0 and base else weight


def site_priors(sites: DataFrame, target: str) -> DataFrame:
    """(host, path, prior) from (host, path, n, and the target's count): posterior means, path shrunk to host, host to the global rate.

    Each level's prior strength comes from how far its groups differ beyond chance; a group without labels gets its parent's value.
    """
    table = sites.select("host", "path", F.col("n").cast("double").alias("n"), F.col(target).cast("double").alias("k"))
    n, k = table.agg(F.sum("n"), F.sum("k")).first()
    rate = ((k or 0.0) + 0.5) / ((n or 0.0) + 1.0)
    hosts = table.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    s = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("__host"), ((F.lit(s * rate) + F.col("k")) / (F.lit(s) + F.col("n"))).alias("above"))
    paths = materialize(table.join(hosts, F.col("host").eqNullSafe(F.col("__host"))), "paths")
    s = _strength(paths, F.col("above"))
    return paths.select("host", "path", ((F.lit(s) * F.col("above") + F.col("k")) / (F.lit(s) + F.col("n"))).alias(f"{target}_prior"))


def assess(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
           doc_id: str = "doc_id", text: str = "text", limit: float = 0.5, **fit) -> DataFrame:
    """``docs`` with ``assessment``: struct of host, path, for each target evidence, prior and probability, and ``kept``.

    ``labels`` (doc_id, quality, toxic). A document's log-odds of being poor (quality 0) or toxic are its evidence, from the features it has, plus those
    of its path's posterior rate, which is shrunk to its host's and that to the global rate by grouped sums over all labelled rows. It is
    kept unless one of the two probabilities is above ``limit``. ``host`` and ``path`` default to the source, and the source with the language.

    Without labels all evidence is 0 and all priors are 1/2, and everything is kept. Null text has the features of an empty one; null hosts and paths are
    sites of their own; repeated rows are assessed alike. All columns of ``docs`` are kept and may have any names;
    one named ``assessment`` is replaced.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    labels = materialize(labelled(labels), "labelled")
    places = docs.select(F.col(doc_id).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path")).join(labels, "doc_id", "left")
    sites = materialize(places.groupBy("host", "path").agg(F.count_if(F.col("poor").isNotNull() | F.col("toxic").isNotNull()).alias("n"),
                                                         *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]), "sites")
    priors = [site_priors(sites, t) for t in TARGETS]
    same = [F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p"))]
    other = priors[1].select(F.col("host").alias("__h"), F.col("path").alias("__p"), f"{TARGETS[1]}_prior")
    table = materialize(priors[0].join(other, *same).select(F.col("host").alias("__host"), F.col("path").alias("__path"), *[f"{t}_prior" for t in TARGETS]), "site-priors")
    table = table.select("__host", "__path", F.struct(*[f"{t}_prior" for t in TARGETS]).alias("__priors"))
    model = fit_evidence(docs, labels, doc_id=doc_id, text=text, **fit)
    rows = docs.select(host.cast("string").alias("host"), path.cast("string").alias("path"), evidence(model, F.col(text)).alias("e"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(table, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    odds = {t: F.col(f"e.{t}") + F.log(F.col(f"__priors.{t}_prior") / (1 - F.col(f"__priors.{t}_prior"))) for t in TARGETS}
    chance = {t: 1 / (1 + F.exp(-odds[t])) for t in TARGETS}
    fields = [F.col("host"), F.col("path")]
    for t in TARGETS:
        fields += [F.col(f"e.{t}").alias(f"{t}_evidence"), F.col(f"__priors.{t}_prior").alias(f"{t}_prior"), chance[t].alias(f"{t}_probability")]
    fields.append(F.greatest(*chance.values()).__le__(limit).alias("kept"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "assessment"], F.struct(*fields).alias("assessment"))
