"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its potential comes from features of the line and of the lines before and after it, and
neighbouring labels are tied by transition weights. Forward-backward gives each line's probability of being bad; the
mean of these, weighted by the lengths of the lines, is the document's share of bad text, which a logistic curve turns
into the score. Training uses a bounded sample of labelled documents. Their labels are those of whole documents, so a
first round takes every line of a bad document for bad, and a second one only the lines that the first finds bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import frugal, pieces

#: The bounds of the training sample: labelled documents, and lines of each that are learned from; a document with more
#: gives so many runs of neighbouring lines, evenly spread, each a chain of its own.
DOCUMENTS, LINES, RUNS = 3000, 400, 4
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SEED = 42
STEPS, RATE, DECAY = 150, 0.1, 1e-3
OWN = 12
FEATURES = 3 * OWN + 3
#: Share of bad text below which documents are told apart by degrees only.
LEAST = 1e-3
#: Bytes of text that are held at a time, and characters of a text and lines that are looked at together.
BYTES, CUT, TOGETHER = 4_000_000, 1 << 20, 1 << 16
#: Steps of a chain that are taken one after another; longer chains are cut into such segments.
SEGMENT = 512


def _classes():
    import numpy as np

    table = np.full(256, 7, np.uint8)  # the rest of ASCII: symbols
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789", b"|", b"!?", b".,;:'\"()-", b" \t\r\x0b\x0c")):
        table[list(chars)] = k
    return table


def lines_of(text: str | None) -> Iterator[list[str]]:
    """The lines of a text that aren't blank, some at a time."""
    text, at = text or "", 0
    while at < len(text):
        stop = text.find("\n", at + CUT)
        stop = len(text) if stop < 0 else stop + 1
        yield [x for x in text[at:stop].split("\n") if x and not x.isspace()]
        at = stop


def own_features(lines: list[str]):
    """(features, bytes) of lines by themselves."""
    import numpy as np

    n = len(lines)
    if not n:
        return np.zeros((0, OWN), np.float32), np.zeros(0)
    words = np.empty((n, 3), np.int64)
    for i, x in enumerate(lines):
        ws = x.split()
        words[i] = len(ws), len(set(ws)), sum(map(eq, ws, ws[1:]))
    data = [x.encode("utf-8", "replace") for x in lines]
    size = np.array([len(x) for x in data])
    at = np.cumsum(size) - size
    kinds = _classes()[np.frombuffer(b"".join(data), np.uint8)]
    count = np.stack([np.add.reduceat(kinds == k, at, dtype=np.int64) for k in range(8)], axis=1)
    own = np.zeros((n, OWN), np.float32)
    own[:, 0] = np.log1p(size)
    own[:, 1] = count[:, 0] / (count[:, 0] + count[:, 1] + 1)
    own[:, 2:8] = count[:, 2:] / size[:, None]
    total = np.maximum(words[:, 0], 1)
    own[:, 8] = words[:, 1] / total
    own[:, 9] = words[:, 2] / total
    own[:, 10] = np.log1p((size - count[:, 6]) / total)
    own[:, 11] = (1 - own[:, 8]) * np.log1p(total)
    return own, size.astype(float)


def _ends(starts):
    """The places of the first and of the last line of each document that has some."""
    import numpy as np

    some = np.flatnonzero(np.diff(starts))
    return starts[some], starts[some + 1] - 1


def features(texts: list[str | None]):
    """(features, bytes) of all lines that aren't blank, and where each document's lines start, with the end added."""
    import numpy as np

    parts, starts = [own_features([])], [0]
    for t in texts:
        n = 0
        for lines in lines_of(t):
            parts.append(own_features(lines))
            n += len(lines)
        starts.append(starts[-1] + n)
    own, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.array(starts)
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    first, last = _ends(starts)
    out[first, OWN : 2 * OWN] = own[first]  # at the ends of a document a line stands in for its missing neighbour
    out[last, 2 * OWN : 3 * OWN] = own[last]
    out[first, -3], out[last, -2], out[:, -1] = 1, 1, 1
    return out, size, starts


def runs(n: int, lines: int = LINES, parts: int = RUNS) -> list[tuple[int, int]]:
    """The stretches of a document of n lines that are learned from: all of it, or `parts` that hold `lines` in all."""
    if n <= lines:
        return [(0, n)] if n else []
    size = max(1, lines // parts)
    starts = [k * (n - size) // max(1, parts - 1) for k in range(parts)]
    return [(i, i + size) for i in starts]


@dataclass
class Model:
    mean: object
    scale: object
    weights: object  # of the label bad against good
    transitions: object  # from (good, bad) to (good, bad)
    curve: tuple[float, float]  # log-odds of a good document: first + second * log-odds of bad text
    prior: float  # the score of a document without lines

    def nodes(self, texts: list[str | None]):
        """(potentials, bytes) of all lines, and where each document's lines start, with the end added.

        What a line says of itself and of its neighbours is summed up for some lines at a time, so what is held of a
        line are four numbers, however many lines there are.
        """
        import numpy as np

        says, starts, held = [(np.zeros((0, 3)), np.zeros(0))], [0], []

        def look() -> None:
            own, size = own_features(held)
            parts = [np.clip((own - self.mean[k : k + OWN]) / self.scale[k : k + OWN], -8, 8) @ self.weights[k : k + OWN] for k in (0, OWN, 2 * OWN)]
            says.append((np.stack(parts, axis=1), size))
            held.clear()

        for t in texts:
            n = 0
            for lines in lines_of(t):
                n += len(lines)
                held += lines
                if len(held) >= TOGETHER:
                    look()
            starts.append(starts[-1] + n)
        look()
        said, size = (np.concatenate(x) for x in zip(*says, strict=True))
        starts = np.array(starts)
        first, last = _ends(starts)
        node = said[:, 0].copy()
        node[1:] += said[:-1, 1]
        node[:-1] += said[1:, 2]
        # At the ends of a document a line stands in for its missing neighbour.
        node[first] += said[first, 1] - np.where(first > 0, said[first - 1, 1], 0)
        node[last] += said[last, 2] - np.where(last + 1 < len(node), said[np.minimum(last + 1, len(node) - 1), 2], 0)
        flags = lambda on: np.clip((on - self.mean[-3:]) / self.scale[-3:], -8, 8) @ self.weights[-3:]
        node += flags(np.array([0.0, 0.0, 1.0]))
        node[first] += flags(np.array([1.0, 0.0, 1.0])) - flags(np.array([0.0, 0.0, 1.0]))
        node[last] += flags(np.array([0.0, 1.0, 1.0])) - flags(np.array([0.0, 0.0, 1.0]))
        return node, size, starts

    def shares(self, texts: list[str | None]):
        """The share of bad text of each document, not a number where there is none."""
        import numpy as np

        node, size, starts = self.nodes(texts)
        bad, _ = marginals(node, self.transitions, starts, False)
        out = np.full(len(starts) - 1, np.nan)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            out[some] = np.add.reduceat(bad * size, starts[some]) / np.add.reduceat(size, starts[some])
        return out

    def scores(self, texts: list[str | None]):
        return self.curved(self.shares(texts))

    def curved(self, share):
        import numpy as np

        return np.where(np.isnan(share), self.prior, 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _odds(np.nan_to_num(share)), -30, 30))))


def _odds(share):
    import numpy as np

    return np.log((share + LEAST) / (1 - share + LEAST))


def marginals(node, edge, starts, pairs: bool = True):
    """Each line's probability of being bad, and the expected number of each transition if `pairs` are wanted.

    node is the score of bad against good for each line; edge the 2 by 2 scores from one label to the next. Chains are
    cut into segments that move in step, the longest ones last, so loops run over places in a segment; what a segment
    makes of either label before it ties those of a long chain together.
    """
    import numpy as np

    count = np.zeros((2, 2))
    if not len(node):
        return np.zeros(0), count
    sizes = np.diff(starts)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[:-1][owner] + number * SEGMENT
    length = np.minimum(SEGMENT, starts[1:][owner] - begin)
    initial, final = number == 0, number == parts[owner] - 1

    def walk(some):
        """Segments by length, and for each step those that have one more line."""
        order = some[np.argsort(-length[some], kind="stable")]
        steps = int(length[order[0]]) if len(order) else 0
        return order, np.searchsorted(-length[order], -np.arange(steps), side="left")

    # What enters a segment from before, and from behind, as log-odds of bad.
    enter, leave = np.zeros(len(owner)), np.zeros(len(owner))
    long = np.flatnonzero(parts[owner] > 1)
    if len(long):
        order, active = walk(long)
        across = np.zeros((len(owner), 2, 2))  # from the label before the segment to its last one
        for t, n in enumerate(active):
            now = order[:n]
            x = across[now]
            if t:
                x = np.logaddexp(x[:, :, :1] + edge[None, :1, :], x[:, :, 1:] + edge[None, 1:, :])
            else:
                x = x + edge
            x[:, :, 1] += node[begin[now] + t, None]
            across[now] = x
        heads = node[begin] + 0.0
        for k in long:  # a step for each segment
            if initial[k]:
                odds = _inside(heads[k], node[begin[k] + 1 : begin[k] + length[k]], edge)
            else:
                enter[k] = odds
                m = across[k]
                odds = np.logaddexp(m[0, 1], odds + m[1, 1]) - np.logaddexp(m[0, 0], odds + m[1, 0])
        for k in long[::-1]:
            if final[k]:
                odds = 0.0
            leave[k] = odds
            m = across[k]
            odds = np.logaddexp(m[1, 0], m[1, 1] + odds) - np.logaddexp(m[0, 0], m[0, 1] + odds)

    ahead, back = np.empty(len(node)), np.empty(len(node))
    order, active = walk(np.arange(len(owner)))
    on = lambda x: np.logaddexp(edge[0, 1], x + edge[1, 1]) - np.logaddexp(edge[0, 0], x + edge[1, 0])
    off = lambda y: np.logaddexp(edge[1, 0], edge[1, 1] + y) - np.logaddexp(edge[0, 0], edge[0, 1] + y)
    for t, n in enumerate(active):
        now = begin[order[:n]] + t
        ahead[now] = (on(ahead[now - 1]) if t else np.where(initial[order[:n]], 0.0, on(enter[order[:n]]))) + node[now]
    back[begin + length - 1] = leave
    for t in range(len(active) - 1, 0, -1):
        now = begin[order[: active[t]]] + t
        back[now - 1] = off(back[now] + node[now])
    bad = 1 / (1 + np.exp(np.clip(-(ahead + back), -700, 700)))
    if pairs:
        inner = np.ones(len(node), bool)
        inner[starts[:-1][sizes > 0]] = False
        now = np.flatnonzero(inner)
        if len(now):
            y = back[now] + node[now]
            parts = np.stack([edge[a, b] + a * ahead[now - 1] + b * y for a in (0, 1) for b in (0, 1)])
            parts = np.exp(parts - parts.max(0))
            count = (parts / parts.sum(0)).sum(1).reshape(2, 2)
    return bad, count


def _inside(first: float, nodes, edge) -> float:
    """The log-odds at the end of a chain's first segment."""
    import math

    def lae(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    x = float(first)
    (a, b), (c, d) = edge.tolist()
    for y in nodes.tolist():
        x = lae(b, x + d) - lae(a, x + c) + y
    return x


def fit(x, size, starts, quality, owner=None) -> Model:
    """A model from the lines' features and the labels of their documents (1 good, 0 bad).

    owner, if given, names the document of each chain; chains of one document stand together.
    """
    import numpy as np

    quality = np.asarray(quality, float)
    prior = float(quality.mean()) if len(quality) else 1.0
    scale = x.std(0) if len(x) else np.ones(FEATURES)
    scale = np.where(scale < 1e-6, 1, scale)
    mean = x.mean(0) if len(x) else np.zeros(FEATURES)
    mean[-1] = 0
    model = Model(mean, scale, np.zeros(FEATURES), np.zeros((2, 2)), (30.0 if prior > 0.5 else -30.0, 0.0), prior)
    if not len(x) or prior in (0.0, 1.0):
        return model  # one label only: nothing to tell apart
    z = np.clip((x - mean) / scale, -8, 8)
    owner = np.arange(len(starts) - 1) if owner is None else np.asarray(owner)
    doc = np.repeat(owner, np.diff(starts))
    bad = 1 - quality[doc]
    if bad.min() == bad.max():
        return model  # the lines at hand are of one kind
    weight = np.where(bad > 0, 0.5 / bad.mean(), 0.5 / (1 - bad).mean())
    for _ in range(STEPS):  # first round: lines by themselves, both labels of equal weight
        p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
        model.weights += RATE * 4 * (z.T @ (weight * (bad - p)) / len(z) - DECAY * model.weights)
    p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
    most = np.zeros(len(quality))
    np.maximum.at(most, doc, p)
    bad = ((bad > 0) & ((p >= 0.5) | (p >= most[doc]))).astype(int)
    inner = np.ones(len(z), bool)
    inner[starts[:-1][np.diff(starts) > 0]] = False
    now = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[now - 1], bad[now]), 1)
    first, second = [np.zeros(FEATURES), np.zeros((2, 2))], [np.zeros(FEATURES), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):  # second round: the chain, by steps scaled to the gradients so far
        p, expected = marginals(z @ model.weights, model.transitions, starts)
        slopes = [z.T @ (bad - p) / len(z) - DECAY * model.weights, (seen - expected) / len(z) - DECAY * model.transitions]
        moves = []
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            moves.append(RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
        model.weights, model.transitions = model.weights + moves[0], model.transitions + moves[1]
    p, _ = marginals(z @ model.weights, model.transitions, starts, False)
    length = np.bincount(doc, size, len(quality))
    known = length > 0
    odds, target = _odds(np.bincount(doc, p * size, len(quality))[known] / length[known]), quality[known]
    design = np.stack([np.ones(len(odds)), odds], axis=1)
    curve = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        slope = design.T @ (target - p) - 0.1 * curve
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        curve += np.clip(np.linalg.solve(bend, slope), -2, 2)
    model.curve = (float(curve[0]), float(min(curve[1], 0.0)))
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, documents: int = DOCUMENTS, lines: int = LINES, seed: int = SEED) -> Model:
    """Fit a model on at most `documents` labelled documents that aren't held out, and `lines` lines of each.

    docs has doc_id and text, labels has doc_id and quality. The sample is that of the smallest seeded hashes of the
    ids, so reruns agree; only its features reach the driver, one row for each id, whatever the ids are repeated.
    """
    import numpy as np

    known = labels.select("doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(documents)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches, "text", BYTES):
            out, cuts = [], []
            for t in b.column("text").to_pylist():
                x, size, starts = features([t])
                stretches = runs(int(starts[-1]), lines)
                rows = np.concatenate([np.arange(i, j) for i, j in stretches]) if stretches else np.zeros(0, int)
                out.append(np.concatenate([x[rows], size[rows, None]], axis=1).astype("<f4").tobytes())
                cuts.append([j - i for i, j in stretches])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(out, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "quality", "lines", "cuts"])

    # The labels in the sample are bounded by `documents`, so they can go to every task and the texts stay in place.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    rows = rows.mapInArrow(frugal(run), "doc_id long, quality int, lines binary, cuts array<int>").groupBy("doc_id", "quality").agg(F.min(F.struct("lines", "cuts")).alias("held"))
    rows = sorted(rows.select("doc_id", "quality", "held.*").collect(), key=lambda r: r.doc_id)
    table = [np.frombuffer(bytes(r.lines), "<f4").reshape(-1, FEATURES + 1) for r in rows]
    cuts = [n for r in rows for n in r.cuts]
    owner = [k for k, r in enumerate(rows) for _ in r.cuts]
    both = np.concatenate(table) if table else np.zeros((0, FEATURES + 1), np.float32)
    return fit(both[:, :-1].astype(float), both[:, -1].astype(float), np.append(0, np.cumsum(cuts, dtype=int)), [r.quality for r in rows], np.array(owner, int))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`: the quality score of `text`, from 0 to 1. Rows stay in place."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = [f for f in docs.schema.fields if f.name != out]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches, text, BYTES):
            scores = pa.array(model.scores(b.column(text).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), scores], names=[f.name for f in keep] + [out])

    return docs.select(*(f.name for f in keep)).mapInArrow(frugal(run), StructType([*keep, StructField(out, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if the score reaches the threshold).

    Only the text decides a score. Defined cases: a text that is null, empty or blank has no lines and gets the share
    of good documents in the sample; a null id isn't held out, nor learned from; of labels that contradict each other
    the bad one holds, and null ones don't count; without labels of both kinds every score says the one kind there is,
    good if there is none; repeated rows give repeated results; other columns are ignored; an empty table gives no
    rows; texts and lines may have any length.
    """
    model = train(docs, labels)
    rows = score(docs.select("doc_id", F.col("text").alias("text")), model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
