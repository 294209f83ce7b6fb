"""Operator 8: secret scan by a character convolutional network.

Every text is scanned whole.  Findings of three fixed patterns are the base.
Candidates are all other runs of secret-like characters; a small network (character
embedding, one convolution, the maximum over places, one linear layer) reads each
candidate, whatever its length, with the characters around it and gives a calibrated
probability.  The candidates over the threshold are added as spans of kind ``model``.  Runs
of letters in one case, or with a capital first, are words of prose and no candidates.

The network is trained here, on findings labelled by the base patterns: runs inside
a base finding against runs outside any.  Half of the positive ones are shown without
the text before them, so that the look of the run counts and not only its
keyword.  Every finding is learned from (of a long run its window holds the first and last
characters).  They are dealt by hash over shards of some ``SHARD`` findings; in each round every shard
goes once over its own in mini-batches, all from the same weights, and Spark averages what comes
out.  Of ``folds`` parts of the documents one is for judging only (``judged_recall``), one fits the
calibration (Platt scaling) and the threshold, with all of its findings, and the others the network.
The threshold is the highest that keeps ``recall`` of the positives, raised until no more than ``false_share`` of the
others pass.  Only if both cannot hold is the share of others given up, never the recall.

Defined cases: a null text counts as empty; without candidates of both labels nothing
is added and the base spans are all; repeated rows are each scanned; positions are code
points, the end exclusive.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import discard, id_crc, store

# --- fixed values: the base patterns ---------------------------------------------------
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
# ---------------------------------------------------------------------------------------

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}", re.ASCII)
BEFORE, LONGEST, AFTER = 20, 44, 6
WIDTH = BEFORE + LONGEST + AFTER
SYMBOLS = "".join(map(chr, range(32, 127)))
EMBED, FILTERS, REACH = 8, 24, 5
#: Characters of a long run that are convolved at once.
PIECE = 4096
#: Findings of one shard of the fit, about.
SHARD = 20_000
#: Averages are sums of whole multiples of this, which do not depend on the order of the sum.
GRAIN = 2.0**-36
#: Ranges that a rank is looked for in at once.
RANGES = 4096
FINDINGS = "doc_id long, label int, window string, fold int"
FIT, CALIBRATE, JUDGE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base findings, in order."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def likely(run: str) -> bool:
    """Prose is letters in one case after the first; everything else is a candidate."""
    return not run.isalpha() or not (run[1:].islower() or run.isupper())


def window(text: str, start: int, end: int, whole: bool = False) -> str:
    """The run in the middle, ``WIDTH`` characters; more for a run over ``LONGEST`` if it is to be ``whole``."""
    run = text[start:end]
    if len(run) > LONGEST and not whole:
        run = run[: LONGEST // 2] + run[-(LONGEST - LONGEST // 2) :]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE) + run.ljust(LONGEST) + text[end : end + AFTER].ljust(AFTER)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if likely(m[0])]


def inside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the spans, in order, meet a base finding: one sweep over both lists."""
    out, i, reach = [], 0, -1
    for start, end in spans:
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        out.append(reach > start)
    return out


def findings(docs: DataFrame, folds: int) -> DataFrame:
    """doc_id, label (1: inside a base finding), window, fold: every candidate of every text."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, fold in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "fold"))):
                if spans := candidates(text or ""):
                    labels = inside(spans, base_spans(text))
                    rows += [(i, int(y), window(text, *s), fold) for s, y in zip(spans, labels)]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "label", "window", "fold"]
            )

    part = id_crc() % folds
    fold = F.when(part == 1, CALIBRATE).when(part > 1, FIT).otherwise(JUDGE)  # rows without an id are judged only
    return docs.select(F.col("doc_id").cast("long"), "text", fold.alias("fold")).mapInArrow(run, FINDINGS)


CODES = np.full(256, len(SYMBOLS), np.int64)
CODES[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def coded(windows: list[str]) -> np.ndarray:
    raw = "".join(windows).encode("latin-1", "replace")
    return CODES[np.frombuffer(raw, np.uint8)].reshape(len(windows), -1)


class CharNet:
    """logit = w . max over places of relu(convolution of the embedded characters) + b."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (len(SYMBOLS) + 1, EMBED)),
            "filters": r.normal(0, (EMBED * REACH) ** -0.5, (EMBED * REACH, FILTERS)),
            "bias": np.zeros(FILTERS),
            "early": r.normal(0, FILTERS**-0.5, FILTERS),
            "late": r.normal(0, FILTERS**-0.5, FILTERS),
            "out": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1

    def forward(self, codes: np.ndarray):
        x = self.p["embed"][codes]
        places = codes.shape[1] - REACH + 1
        cols = np.concatenate([x[:, i : i + places] for i in range(REACH)], axis=2)
        y = np.maximum(cols @ self.p["filters"] + self.p["bias"], 0)
        parts = (slice(0, BEFORE - 2), slice(BEFORE - 2, places))  # the context before, then the run itself
        best = [y[:, s].argmax(axis=1) + s.start for s in parts]
        top = [np.take_along_axis(y, b[:, None, :], 1)[:, 0] for b in best]
        return cols, best, top, top[0] @ self.p["early"] + top[1] @ self.p["late"] + self.p["out"][0]

    def long_logit(self, window: str) -> float:
        """The logit of one window of any width: the maximum over places is taken piece by piece."""
        codes = coded([window])
        top = None
        for lo in range(0, codes.shape[1] - REACH + 1, PIECE):
            x = self.p["embed"][codes[0, lo : lo + PIECE + REACH - 1]]
            n = len(x) - REACH + 1
            y = np.maximum(np.concatenate([x[i : i + n] for i in range(REACH)], axis=1) @ self.p["filters"] + self.p["bias"], 0)
            if top is None:
                top = [y[: BEFORE - 2].max(axis=0), y[BEFORE - 2 :].max(axis=0)]
            else:
                top[1] = np.maximum(top[1], y.max(axis=0))
        return float(top[0] @ self.p["early"] + top[1] @ self.p["late"] + self.p["out"][0])

    def logits(self, windows: list[str]) -> np.ndarray:
        out = np.empty(len(windows))
        usual = [i for i, w in enumerate(windows) if len(w) == WIDTH]
        for lo in range(0, len(usual), 512):
            at = usual[lo : lo + 512]
            out[at] = self.forward(coded([windows[i] for i in at]))[3]
        for i, w in enumerate(windows):
            if len(w) != WIDTH:
                out[i] = self.long_logit(w)
        return out

    def probabilities(self, windows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(windows) + self.shift, -30, 30)))

    def start(self) -> None:
        """The state of Adam before its first step."""
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0.0

    def fit(self, windows: list[str], labels: np.ndarray, epoch: int, rate: float = 3e-3, seed: int = 11) -> None:
        """One epoch of Adam on the logistic loss, in mini-batches of 64; the chances go on from the epochs before."""
        r = np.random.default_rng(seed)
        codes = coded(windows)
        batches = [range(lo, min(lo + 64, len(codes))) for lo in range(0, len(codes), 64)]
        for _ in range(epoch):
            r.permutation(len(codes))
            for b in batches:
                r.random(len(b))
        order = r.permutation(len(codes))
        for b in batches:
            at = order[b.start : b.stop]
            c, y = codes[at].copy(), labels[at]
            c[(y == 1) & (r.random(len(at)) < 0.5), :BEFORE] = 0  # without the text before
            self.step += 1
            for k, g in self.gradients(c, y).items():
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                up = self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
                self.p[k] -= rate * up

    def numbers(self) -> np.ndarray:
        """Weights and state of Adam as one row of numbers."""
        held = (self.p, self.first, self.second)
        return np.concatenate([*(v.ravel() for d in held for v in d.values()), [self.step]])

    def take(self, numbers: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.first, self.second):
            for k, v in d.items():
                d[k] = numbers[at : at + v.size].reshape(v.shape)
                at += v.size
        self.step = float(numbers[at])

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        cols, best, top, logit = self.forward(codes)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(labels)
        g = {"early": top[0].T @ d, "late": top[1].T @ d, "out": np.array([d.sum()])}
        g["filters"], g["bias"] = np.zeros_like(self.p["filters"]), np.zeros(FILTERS)
        g["embed"] = np.zeros_like(self.p["embed"])
        rows = np.arange(len(codes))[:, None]
        for part, b, t in (("early", best[0], top[0]), ("late", best[1], top[1])):
            dy = d[:, None] * self.p[part] * (t > 0)  # rows x filters, at place b
            at = cols[rows, b]  # rows x filters x (embed * reach)
            g["filters"] += np.einsum("nf,nfe->ef", dy, at)
            g["bias"] += dy.sum(axis=0)
            dx = dy[:, :, None] * self.p["filters"].T  # rows x filters x (reach * embed)
            for i in range(REACH):
                np.add.at(g["embed"], codes[rows, b + i], dx[:, :, i * EMBED : (i + 1) * EMBED])
        return g


def _epoch(net: CharNet, rows: DataFrame, shards: int, epoch: int) -> None:
    """Every shard's epoch from the same weights; the driver gets their averages, a row for each number of the network."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(table: pa.Table) -> pa.Table:
        own = copy.deepcopy(shared.value)
        labels = table["label"].to_numpy()
        own.fit(table["window"].to_pylist(), labels.astype(float), epoch)
        v = np.round(np.clip(own.numbers(), -1e6, 1e6) / GRAIN).astype(np.int64)
        return pa.table({"i": pa.array(np.arange(len(v)), pa.int32()), "v": pa.array(v)})

    def ordered(table: pa.Table) -> pa.Table:
        return run(table.sort_by([("label", "descending"), ("order", "ascending"), ("window", "ascending")]))

    shard = F.pmod(F.xxhash64("doc_id", "window"), F.lit(shards))
    told = rows.select("label", "window", "order", shard.alias("shard")).groupBy("shard").applyInArrow(ordered, "i int, v long")
    mean = told.groupBy("i").agg((F.sum(F.col("v").cast("decimal(38,0)")).cast("double") / F.count("v")).alias("v")).collect()
    net.take(np.array([r["v"] * GRAIN for r in sorted(mean, key=lambda r: r["i"])]))
    shared.unpersist()


def _ranked(rows: DataFrame, k: int) -> float:
    """The ``z`` of rank ``k`` (from 0): ranges are counted, then those of the one that holds the rank, and so on."""
    here = rows
    lo, hi = rows.agg(F.min("z"), F.max("z")).first()
    while lo < hi:
        at = F.least(F.floor((F.col("z") - F.lit(lo)) / F.lit(hi - lo) * RANGES), F.lit(RANGES - 1))
        counts = here.groupBy(at.alias("at")).agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count("z").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["at"]):
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        here = rows.where(F.col("z").between(lo, hi))
    return lo


def calibrate(net: CharNet, rows: DataFrame, n: dict[int, int], recall: float, false_share: float) -> None:
    """Platt scaling by Newton steps over all ``rows``; then the threshold under the recall constraint. ``n``: rows by label."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            z = shared.value.logits(batch["window"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(z)], names=["label", "z"])

    scored = store(rows.select("label", "window").mapInArrow(run, "label int, z double"), "secret-logits")
    n1, n0 = n[1], n[0]
    target = F.when(F.col("label") == 1, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))
    z, w = F.col("z"), np.array([1.0, 0.0])
    for _ in range(30):
        x = z * F.lit(float(w[0])) + F.lit(float(w[1]))
        p = 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))
        s = scored.select(z, (p - target).alias("d"), (p * (1 - p)).alias("h"))
        told = s.agg(F.sum(z * F.col("d")), F.sum("d"), F.sum(z * z * F.col("h")), F.sum(z * F.col("h")), F.sum("h")).first()
        grad = np.array(told[:2]) + 1e-3 * (w - [1, 0])
        step = np.linalg.solve(np.array([[told[2], told[3]], [told[3], told[4]]]) + 1e-3 * np.eye(2), grad)
        w = w - step
        if np.abs(step).max() < 1e-12 * max(1.0, np.abs(w).max()):
            break
    net.scale, net.shift = float(max(w[0], 1e-3)), float(w[1])
    # probabilities keep the order of the logits
    good = _ranked(scored.where("label = 1"), int((1 - recall) * n1))  # the highest threshold with this recall
    bad = _ranked(scored.where("label = 0"), min(n0 - 1, int((1 - false_share) * n0)))
    most, wanted = 1 / (1 + np.exp(-np.clip(net.scale * np.array([good, bad]) + net.shift, -30, 30)))
    net.threshold = float(min(most, max(wanted + 1e-9, 0.5)))
    discard(scored)


def train(docs: DataFrame, folds: int = 5, recall: float = 0.95, false_share: float = 0.002, epochs: int = 5) -> CharNet:
    """Fit on every finding of the folds that are learned from; the driver gets counts, sums and averages only."""
    net = CharNet()
    net.start()
    told = findings(docs, folds).where(F.col("fold") != JUDGE).withColumn("order", F.xxhash64("window", "doc_id"))
    told = store(told, "secret-findings")
    n = {(r["fold"], r["label"]): r["count"] for r in told.groupBy("fold", "label").count().collect()}
    if (FIT, 1) in n and (FIT, 0) in n:
        shards = -(-(n[FIT, 1] + n[FIT, 0]) // SHARD)
        for epoch in range(epochs):
            _epoch(net, told.where(F.col("fold") == FIT), shards, epoch)
        fold = CALIBRATE if (CALIBRATE, 1) in n and (CALIBRATE, 0) in n else FIT
        calibrate(net, told.where(F.col("fold") == fold), {y: n[fold, y] for y in (0, 1)}, recall, false_share)
    discard(told)
    return net


def judged_recall(docs: DataFrame, net: CharNet, folds: int = 5) -> tuple[int, int, int, int]:
    """(found, all) of the labelled findings and (passed, all) of the other candidates, in the documents
    that neither the fit nor the threshold has seen."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            p = shared.value.probabilities(batch["window"].to_pylist()) >= shared.value.threshold
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(p)], names=["label", "over"])

    rows = findings(docs, folds).where(F.col("fold") == JUDGE).mapInArrow(run, "label int, over boolean")
    n = {(r["label"], r["over"]): r["count"] for r in rows.groupBy("label", "over").count().collect()}
    get = lambda y, over: n.get((y, over), 0)
    return get(1, True), get(1, True) + get(1, False), get(0, True), get(0, True) + get(0, False)


def scan(docs: DataFrame, net: CharNet, rows: int = 256) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, score>>: base findings and those the network adds."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = [t or "" for t in part["text"].to_pylist()]
                base = [base_spans(t) for t in texts]
                extra = []
                for i, t in enumerate(texts):
                    spans = candidates(t)
                    extra += [(i, s) for s, met in zip(spans, inside(spans, base[i])) if not met]
                scores = model.probabilities([window(texts[i], *s, whole=True) for i, s in extra])
                out = [[{"kind": KINDS[k], "start": s, "end": e, "score": 1.0} for s, k, e in b] for b in base]
                for (i, (s, e)), p in zip(extra, scores.tolist()):
                    if p >= model.threshold:
                        out[i].append({"kind": "model", "start": s, "end": e, "score": p})
                for spans in out:
                    spans.sort(key=lambda x: x["start"])  # stable: base kinds first, in their order
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(out, pa.list_(kind))], names=["doc_id", "spans"]
                )

    told = docs.select(F.col("doc_id").cast("long"), "text")
    return told.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "model")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        count("model").alias("n_model"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def base_digest(text: str | None) -> str:
    """The contract's digest of a text's base findings, for tests."""
    spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text or ""))
    return hashlib.sha256(spans.encode()).hexdigest()
