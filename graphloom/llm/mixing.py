"""Mixing sources to target weights.

1. A softmax classifier over hashed words, fitted on a bounded sample of labelled documents, gives each document a soft
   membership in the sources: the posterior of the text's words and of the document's own label, which may be wrong.
2. Projected gradient descent on the least squares of source tokens against their targets fits a rate per document,
   between 0 and the repeats its source allows. The totals fitted are those expected under the posteriors and those by
   label, two for each source. A step moves every rate against the residual in the metric of the documents that are free to
   move; it needs one pass, in which tasks replay the few numbers of earlier steps and return sums per source.
   Descent goes on until no total misses its target by more than TOLERANCE of all tokens; what is missed is reported.
3. A document's whole copies are its rate rounded up or down by a hash of the document, so the expected totals stay. What
   rounding itself leaves over is taken out by shifting the hash of a source's documents by at most 4 / sqrt(documents),
   and half a copy at most: rates that miss the targets are not mended by it.

The size of the mix is HEADROOM less than the largest at which every source with tokens can reach its share, by label and by posterior
(or ``total_tokens``, if that is less); shares of sources without tokens are spread over the others in proportion.

Defined results: documents without tokens, without source or of a source without target are used 0 times and not listed;
a target source without documents is reported with share 0; empty tables give no records; null shares or repeats count as none.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import VOCABULARY, _slices, encoder
from graphloom.llm.tables import source_label
from graphloom.runtime import broadcast_if_small, spread, write_table

#: Labelled rows the classifier is fitted on, about as many of each source, by hash; their features come to the driver.
TRAIN_ROWS = 3000
#: How often the label of a document is taken to be its source; the posterior weighs it against the text.
LABEL_TRUST = 0.98
FEATURES = 1024
#: Largest miss of a total, as a share of all tokens, and the steps after which a fit that has not come there ends with a warning.
TOLERANCE, STEPS = 5e-4, 30
HEADROOM = 0.02
BINS = 1024
_WORD = re.compile(r"[^\W_]+|[^\w\s]")


class _Slots(dict):
    """The feature of each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = slot = crc32(word.encode()) % FEATURES
        return slot


_slots = _Slots()


def features(texts: list[str]) -> np.ndarray:
    """Square roots of hashed word counts, of length 1, a row for each text."""
    at, counts = [], []
    for t in texts:
        n = len(at)
        at.extend(map(_slots.__getitem__, _WORD.findall(t.lower())))
        counts.append(len(at) - n)
    cell = np.repeat(np.arange(len(texts)) * FEATURES, counts) + np.array(at, np.int64)
    x = np.sqrt(np.bincount(cell, minlength=len(texts) * FEATURES).astype(np.float32).reshape(len(texts), FEATURES))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400, rate: float = 8.0, l2: float = 2e-6) -> np.ndarray:
    """Weights (features + 1, classes) by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], classes), np.float32)
    v, target = w.copy(), np.eye(classes, dtype=np.float32)[y]
    for k in range(rounds):
        p = softmax(x @ v)
        new = v - rate * (x.T @ (p - target) / len(x) + l2 * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _labelled(documents: DataFrame, targets: DataFrame) -> DataFrame:
    t = broadcast_if_small(targets)
    return documents.select("doc_id", "text", source_label(F.col("source")).alias("source")).join(t, "source").filter(F.col("text").isNotNull() & (F.col("text") != ""))


def clean_targets(mix_targets: DataFrame) -> DataFrame:
    """source (as compared), target_share, max_repeats; one row per source."""
    t = mix_targets.select(source_label(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source is not null and target_share > 0 and max_repeats > 0")
    return t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def memberships(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[str]]:
    """A written table doc_id, source, target_share, max_repeats, n_tokens, label, posterior; and the sources in the order of both.

    A source that the sample lacks has its own label and, in all documents, no posterior.
    """
    docs = _labelled(spread(documents.select("doc_id", "text", "source")), targets)
    # Every source gives about as many rows, taken by hash, so the sample is the same at every layout; only its features leave the tasks.
    have = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}  # target sources only
    quota = TRAIN_ROWS / max(len(have), 1)
    u = (F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sample = docs.select("doc_id", "source", "text").filter(u <= _per_source({s: quota / n for s, n in have.items()})) if have else docs.limit(0)

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("source"), rows], names=["source", "x"])

    got = sample.mapInArrow(feature_rows, "source string, x array<float>").toArrow()
    seen = sorted(set(got.column("source").to_pylist()))
    names = [*seen, *sorted(set(have) - set(seen))]
    number = {n: i for i, n in enumerate(names)}
    if seen:
        x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        y = np.array([number[s] for s in got.column("source").to_pylist()])
        weights = fit_softmax(x, y, len(seen))
        weights[-1] += np.log([have[s] for s in seen]) - np.log(np.bincount(y, minlength=len(seen)))  # from the sample's shares to those of all documents

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for whole in batches:
            for part in _slices(whole, "text"):
                for begin in range(0, part.num_rows, 2000):
                    b = part.slice(begin, 2000)
                    texts = b.column("text").to_pylist()
                    ends, _ = enc.encode_batch(texts)
                    label = np.array([number[s] for s in b.column("source").to_pylist()], np.int32)
                    z = np.full((len(texts), len(names)), -np.inf)
                    z[:, : weights.shape[1]] = features(texts) @ weights[:-1] + weights[-1]
                    # What the label tells: it is right with LABEL_TRUST, else any other.
                    z += np.log((1 - LABEL_TRUST) / max(len(names) - 1, 1))
                    own = np.arange(len(texts)), label
                    z[own] = np.maximum(z[own] - np.log((1 - LABEL_TRUST) / max(len(names) - 1, 1)), -700) + np.log(LABEL_TRUST)
                    post = softmax(z)
                    kept = [b.column(c) for c in ("doc_id", "source", "target_share", "max_repeats")]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1) * len(names), pa.int32()), pa.array(post.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(ends), pa.int64()), pa.array(label), rows], names=["doc_id", "source", "target_share", "max_repeats", "n_tokens", "label", "posterior"])

    schema = "doc_id long, source string, target_share double, max_repeats int, n_tokens long, label int, posterior array<double>"
    scored = docs.select("doc_id", "source", "target_share", F.col("max_repeats").cast("int"), "text").mapInArrow(score, schema)
    return write_table(scored.filter("n_tokens > 0"), "memberships"), names


def _columns(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memberships (posteriors, then labels), caps and tokens of a batch."""
    p = b.column("posterior").flatten().to_numpy().reshape(b.num_rows, k)
    label = np.zeros((b.num_rows, k))
    label[np.arange(b.num_rows), b.column("label").to_numpy()] = 1
    return np.hstack([p, label]), *(b.column(c).to_numpy().astype(float) for c in ("max_repeats", "n_tokens"))


def _rates(member: np.ndarray, cap: np.ndarray, start: float, steps: list[np.ndarray]) -> np.ndarray:
    """Replay: rate <- clip(rate - membership . step, 0, cap) for each step so far."""
    r = np.minimum(start, cap)
    for s in steps:
        r = np.clip(r - member @ s, 0, cap)
    return r


def _sums(table: DataFrame, size: int, of, k: int) -> np.ndarray:
    """Sums over all documents of of(memberships, caps, tokens), which gives ``size`` numbers for a batch."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for b in batches:
            if b.num_rows:
                sums += of(*_columns(b, k))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(sums)], names=["i", "e"])

    out = np.zeros(size)
    for row in table.select("posterior", "label", "max_repeats", "n_tokens").mapInArrow(part, "i int, e double").groupBy("i").agg(F.sum("e").alias("e")).collect():
        out[row["i"]] = row["e"]
    return out


def _totals(table: DataFrame, start: float, steps: list[np.ndarray], k: int) -> np.ndarray:
    """Tokens of each source under the rates after ``steps``, by posterior and by label."""
    return _sums(table, 2 * k, lambda m, cap, t: (_rates(m, cap, start, steps) * t) @ m, k)


def _metric(table: DataFrame, start: float, steps: list[np.ndarray], left: np.ndarray, k: int) -> np.ndarray:
    """Token-weighted products of the memberships of the documents that their bounds let follow the gradient."""

    def of(m: np.ndarray, cap: np.ndarray, t: np.ndarray) -> np.ndarray:
        r, up = _rates(m, cap, start, steps), m @ left < 0
        free = np.where(up, r < cap, r > 0)
        return ((m[free] * t[free, None]).T @ m[free]).reshape(-1)

    return _sums(table, 4 * k * k, of, k).reshape(2 * k, 2 * k)


def fitted_rates(table: DataFrame, names: list[str], totals: dict[str, float]) -> tuple[DataFrame, float]:
    """The table with ``rate``, and the largest miss of a total as a share of all tokens."""
    k = len(names)
    want = np.tile([totals.get(n, 0.0) for n in names], 2)
    size = max(sum(totals.values()), 1.0)
    start = 1.0
    steps: list[np.ndarray] = []
    left = _totals(table, start, steps, k) - want
    for _ in range(STEPS if k else 0):
        if np.abs(left).max() <= TOLERANCE * size:
            break
        metric = _metric(table, start, steps, left, k)
        step = np.linalg.solve(metric + (1e-6 * np.trace(metric) / (2 * k) + 1e-9) * np.eye(2 * k), left)
        for length in (1.0, 0.5, 0.2, 0.05):  # a full step may push rates against their bounds
            after = _totals(table, start, [*steps, length * step], k) - want
            if np.linalg.norm(after) < 0.98 * np.linalg.norm(left):
                break
        else:
            break  # targets that cannot all be met have a nearest point
        steps.append(length * step)
        left = after
    miss = float(np.abs(left).max() / size) if k else 0.0
    if miss > TOLERANCE:
        warnings.warn(f"the rates miss a source's tokens by {miss:.2%} of all", stacklevel=2)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, cap, _ = _columns(b, k)
            cols = [b.column(c) for c in ("doc_id", "source", "max_repeats", "n_tokens", "posterior")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(_rates(m, cap, start, steps))], names=["doc_id", "source", "max_repeats", "n_tokens", "posterior", "rate"])

    return table.mapInArrow(rate, "doc_id long, source string, max_repeats int, n_tokens long, posterior array<double>, rate double"), miss


def _target_tokens(table: DataFrame, names: list[str], total_tokens: int | None) -> tuple[dict[str, float], dict[str, int]]:
    """Tokens wanted of each source that has any, and its documents."""
    have = table.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.first("target_share").alias("share"), F.first("max_repeats").alias("most"), F.count(F.lit(1)).alias("docs")).collect()
    within = table.select(*[F.sum(F.col("n_tokens") * F.col("max_repeats") * F.get("posterior", F.lit(i))).alias(f"p{i}") for i in range(len(names))]).first()
    share = {r["source"]: r["share"] for r in have}
    whole = sum(share.values())
    # A source that the classifier was not fitted to has labels only.
    soft = {n: v for n, v in zip(names, within or (), strict=False) if v}
    size = min((min(r["most"] * r["n"], soft.get(r["source"], np.inf)) * whole / r["share"] for r in have), default=0.0) * (1 - HEADROOM)
    size = min(size, total_tokens) if total_tokens else size
    return {s: x / whole * size for s, x in share.items()}, {r["source"]: r["docs"] for r in have}


def _per_source(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(float(v)))]), F.col("source"))


def whole_copies(rated: DataFrame, totals: dict[str, float], docs: dict[str, int]) -> DataFrame:
    """doc_id, source, n_tokens, repeats (at least 1): rates rounded by a hash, with the shift per source that leaves least over."""
    reach = {s: min(0.5, 4 / np.sqrt(n)) for s, n in docs.items()}
    u = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    r = rated.select("doc_id", "source", "n_tokens", "max_repeats", (F.col("rate") + u).alias("v"))
    base = F.least(F.floor(F.col("v") - _per_source(reach)), F.col("max_repeats")).cast("int")
    # With a shift of at most half a copy either way, one more copy at most enters on the way, at the shift ``at``.
    r = r.withColumn("base", F.greatest(base, F.lit(0)))
    r = r.withColumn("at", F.when(F.col("base") < F.col("max_repeats"), F.col("base") + 1 - F.col("v")))
    least = {x["source"]: float(x["n"] or 0) for x in r.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("n")).collect()}
    low, width = {s: -x for s, x in reach.items()}, {s: 2 * x for s, x in reach.items()}
    before, last = dict(least), dict.fromkeys(reach, 0.0)
    for _ in range(3):
        bins = r.withColumn("bin", F.floor((F.col("at") - _per_source(low)) / _per_source({s: w / BINS for s, w in width.items()}))).filter((F.col("bin") >= 0) & (F.col("bin") < BINS))
        counts = {s: np.zeros(BINS) for s in reach}
        for x in bins.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n")).collect():  # at most BINS rows a source
            counts[x["source"]][x["bin"]] = x["n"]
        for s in reach:
            run = before[s] + np.cumsum(counts[s])
            k = min(int(np.searchsorted(run, totals[s], "right")), BINS - 1)
            before[s], last[s] = run[k] - counts[s][k], counts[s][k]
            low[s], width[s] = low[s] + k * width[s] / BINS, width[s] / BINS
    # The copies of the last bin are in if that comes nearer to the target.
    cut = {s: low[s] + (width[s] if abs(before[s] + last[s] - totals[s]) < abs(before[s] - totals[s]) else 0.0) for s in reach}
    repeats = F.col("base") + F.when(F.col("at") < _per_source(cut), 1).otherwise(0)
    return r.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).filter("repeats > 0")


def rated_table(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[str], dict[str, float], dict[str, int], float]:
    """The documents with their rates as a written table, the sources, their wanted tokens and documents, and the miss of the fit."""
    table, names = memberships(documents, clean_targets(mix_targets), vocabulary)
    totals, docs = _target_tokens(table, names, total_tokens)
    rated, miss = fitted_rates(table, names, totals)
    return write_table(rated, "rates"), names, totals, docs, miss


def mixed(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, repeats (at least 1) of the records in the mix."""
    rated, _, totals, docs, _ = rated_table(documents, mix_targets, total_tokens, vocabulary)
    return whole_copies(rated, totals, docs) if totals else rated.select("doc_id", "source", "n_tokens", F.col("max_repeats").alias("repeats"))


def shares(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, target_share, max_repeats, n_docs, tokens, actual_share of every target source, with expected_share under the posteriors and fit_miss."""
    rated, names, totals, docs, miss = rated_table(documents, mix_targets, total_tokens, vocabulary)
    mix = whole_copies(rated, totals, docs) if totals else rated.select("source", "n_tokens", F.col("max_repeats").alias("repeats"))
    m = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    soft = rated.select(*[F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(i))).alias(f"p{i}") for i in range(len(names))]).first() if names else ()
    whole = max(sum(x or 0.0 for x in soft), 1.0)
    expected = _per_source({n: (x or 0.0) / whole for n, x in zip(names, soft, strict=True)}) if names else F.lit(None).cast("double")
    m = clean_targets(mix_targets).join(m, "source", "left").fillna(0, ["n_docs", "tokens"]).withColumn("expected_share", F.coalesce(expected, F.lit(0.0)))
    total = m.agg(F.sum("tokens")).first()[0] or 0
    return m.withColumn("actual_share", F.col("tokens") / F.lit(float(max(total, 1)))).withColumn("fit_miss", F.lit(float(miss)))
