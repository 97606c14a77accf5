"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import re
import sys
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Labelled rows that the fit takes at most: toxic, other. Words of a window, and from one window's start to the next.
MOST_TOXIC, MOST_OTHER, WINDOW, STRIDE = 2400, 3600, 48, 24
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 15, 6, 10, 8
#: Distinct words whose gate inputs a task holds at most before it starts anew.
HELD_WORDS = 150_000
THRESHOLD = 0.3
#: Characters of a piece of a run without spaces, and of two neighbouring pieces in common.
LONG, OVER = 64, 16
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Words; a run of over LONG characters counts as pieces of LONG that overlap by OVER."""
    words = _WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    return [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - OVER), LONG - OVER)]


def scattered(h: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of 64 bits as rows of a table."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(rows)).astype(np.int64)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Rows:
    """Table rows of many words: word rows, and rows of beginnings and of character 4-grams as flat lists with offsets.

    A word gets a mark at each end. Its beginnings have 2 to 8 letters, or all where it is shorter. All words are
    hashed at once: characters times powers by place, summed over the stretch.
    """

    def __init__(self, words: list[str]) -> None:
        size = np.array([len(w) + 2 for w in words], np.int64)
        start = np.cumsum(size) - size
        codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.full(max(10, int(size.max())), 0xD6E8FEB86659FD93, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[within(size)])])
        self.word = scattered(sums[start + size] - sums[start], WORD_ROWS)
        begins, grams = np.maximum(1, np.minimum(9, size) - 2), np.maximum(1, size - 3)
        first = np.repeat(start, begins)
        last = np.minimum(first + within(begins) + 3, np.repeat(start + size, begins))
        begin = sums[last] - sums[first]
        place, end = np.repeat(start, grams) + within(grams), np.repeat(start + size, grams)
        padded = np.concatenate([codes, np.zeros(3, np.uint64)])
        gram = sum(np.where(place + j < end, padded[place + j], np.uint64(0)) * powers[j] for j in range(4))
        self.flat = [scattered(begin ^ np.uint64(1), CHAR_ROWS), scattered(gram, CHAR_ROWS)]
        self.size = [begins, grams]
        self.at = [np.cumsum(n) - n for n in self.size]

    def some(self, pick: np.ndarray) -> Rows:
        """The rows of some of the words."""
        out = Rows.__new__(Rows)
        out.word, out.flat, out.size, out.at = self.word[pick], [], [], []
        for k in (0, 1):
            n = self.size[k][pick]
            at = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            out.flat.append(self.flat[k][np.repeat(self.at[k][pick] - at, n) + np.arange(n.sum())])
            out.size.append(n)
            out.at.append(at)
        return out

    def means(self, table: np.ndarray) -> list[np.ndarray]:
        return [np.add.reduceat(table[self.flat[k]], self.at[k], axis=0) / (self.size[k][:, None] if table.ndim > 1 else self.size[k]) for k in (0, 1)]


def starts(n: int) -> range:
    """Starts of windows that cover n words, each a half over the next."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else range(1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Word row, mean of its beginnings' rows and mean of its grams' rows, side by side, through a GRU in each direction, attention over steps, one logit."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        u = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"ew": u(WORD_ROWS, DIM, scale=0.1), "ec": u(CHAR_ROWS, DIM, scale=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": u(3 * DIM, 3 * HIDDEN), f"u{d}": u(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"wa": u(2 * HIDDEN, ATTEND), "va": u(ATTEND), "wo": u(2 * HIDDEN), "bo": np.zeros(1, np.float32)}

    def inputs(self, rows: Rows) -> np.ndarray:
        """(words, 3 * DIM)."""
        return np.concatenate([self.p["ew"][rows.word], *rows.means(self.p["ec"])], axis=1).astype(np.float32)

    def projected(self, x: np.ndarray):
        return {d: x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in "fb"}

    def run(self, gates: dict, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows. gates[d]: (T, N, 3H) inputs to the gates; mask: (T, N, 1)."""
        T, N, _ = mask.shape
        h = HIDDEN
        both = np.zeros((T, N, 2 * h), np.float32)
        for d, lo in (("f", 0), ("b", h)):
            u, s = self.p[f"u{d}"], np.zeros((N, h), np.float32)
            steps = range(T) if d == "f" else range(T - 1, -1, -1)
            kept = {}
            for t in steps:
                a, m = gates[d][t], mask[t]
                c = s @ u
                zr = 1 / (1 + np.exp(-(a[:, : 2 * h] + c[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                n = np.tanh(a[:, 2 * h :] + r * c[:, 2 * h :])
                new = s + m * (1 - z) * (n - s)
                if tape is not None:
                    kept[t] = (s, c, z, r, n)
                s = new
                both[t, :, lo : lo + h] = s
            if tape is not None:
                tape[d] = kept
        att = np.tanh(both @ self.p["wa"])
        e = np.exp(att @ self.p["va"]) * mask[..., 0]
        alpha = e / np.maximum(e.sum(axis=0, keepdims=True), 1e-9)
        pooled = (alpha[..., None] * both).sum(axis=0)
        if tape is not None:
            tape |= {"both": both, "att": att, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, gates: dict, mask: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Of the weighted logistic loss: parameters, gates' inputs."""
        tape: dict = {}
        logit = self.run(gates, mask, tape)
        p, h, g = self.p, HIDDEN, {}
        dl = ((sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g["wo"], g["bo"] = tape["pooled"].T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["wo"]
        both, att, alpha = tape["both"], tape["att"], tape["alpha"]
        dboth = alpha[..., None] * dpool
        dalpha = (both * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        datt = de[..., None] * p["va"] * (1 - att * att)
        g["va"] = (att * de[..., None]).sum(axis=(0, 1))
        g["wa"] = np.tensordot(both, datt, ((0, 1), (0, 1)))
        dboth += datt @ p["wa"].T
        dgates = {}
        for d, lo in (("f", 0), ("b", h)):
            u, T = p[f"u{d}"], len(mask)
            dg, gu, ds = np.zeros_like(gates[d]), np.zeros_like(u), np.zeros_like(both[0, :, :h])
            for t in range(T - 1, -1, -1) if d == "f" else range(T):
                s, c, z, r, n = tape[d][t]
                ds = ds + dboth[t, :, lo : lo + h]
                m = mask[t]
                dn = ds * m * (1 - z) * (1 - n * n)
                dz = ds * m * (s - n) * z * (1 - z)
                dr = dn * c[:, 2 * h :] * r * (1 - r)
                dg[t] = np.concatenate([dz, dr, dn], axis=1)
                dc = np.concatenate([dz, dr, dn * r], axis=1)
                gu += s.T @ dc
                ds = ds * (1 - m * (1 - z)) + dc @ u.T
            g[f"u{d}"], dgates[d] = gu, dg
        return logit, g, dgates


class Numbers(dict):
    """Words numbered from 0 as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Windows:
    """Texts as windows of indices into a table of distinct words; -1 where a window has no word."""

    def __init__(self, texts, index: Numbers | None = None) -> None:
        self.index = Numbers() if index is None else index
        ids = [list(map(self.index.__getitem__, tokens(text))) for text in texts]
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, size.sum())
        count = np.array([len(starts(n)) for n in size.tolist()], np.int64)
        self.doc = np.repeat(np.arange(len(size)), count)
        place = (within(count) * STRIDE)[:, None] + np.arange(WINDOW)
        inside = place < size[self.doc][:, None]
        self.rows = np.full(place.shape, -1, np.int64)
        self.rows[inside] = flat[((np.cumsum(size) - size)[self.doc][:, None] + place)[inside]]


def gathered(table: dict, rows: np.ndarray):
    """Gate inputs (T, N, 3H) and mask of windows."""
    ids = rows.T
    return {d: table[d][ids] for d in "fb"}, (ids >= 0)[..., None].astype(np.float32)


def window_logits(net: Network, table: dict, windows: np.ndarray, size: int = 2048) -> np.ndarray:
    """Logits of windows; table: gate inputs of the words."""
    out, order = [], np.argsort((windows >= 0).sum(axis=1), kind="stable")
    for at in range(0, len(order), size):
        rows = windows[order[at : at + size]]
        used = max(1, int((rows >= 0).sum(axis=1).max()))
        out.append(net.run(*gathered(table, rows[:, :used])))
    logits = np.empty(len(order), np.float32)
    logits[order] = np.concatenate(out) if out else []
    return logits


def summary(logits: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per text: greatest window logit, mean of the three greatest, mean of all."""
    order = np.lexsort((-logits, doc))
    at = np.searchsorted(doc[order], np.arange(n))
    place = np.arange(len(order)) - at[doc[order]]
    top = place < 3
    mean = lambda d, v: np.bincount(d, v, n) / np.maximum(1, np.bincount(d, minlength=n))
    return np.stack([logits[order][np.minimum(at, max(0, len(order) - 1))], mean(doc[order][top], logits[order][top]), mean(doc, logits)], axis=1)


def fit(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 256, seed: int = 9):
    """Train on texts with labels 0 and 1; returns (network, calibration).

    Labels are of texts, so a toxic text trains by the windows that now score highest in it (one in eight, one at
    least), the others by all their windows. The first column of the word and character tables starts at the
    log-odds of their rows in the training texts. A fifth of the texts fits the calibration from window scores to
    text scores.
    """
    rng = np.random.default_rng(seed)
    y = np.array(labels)
    held = rng.random(len(y)) < 0.2
    net, w = Network(), Windows(texts)
    rows = Rows(list(w.index) or [""])
    n, train = len(texts), ~held[w.doc]
    counts = {"ew": np.ones((WORD_ROWS, 2)), "ec": np.ones((CHAR_ROWS, 2))}
    for d in np.flatnonzero(~held):
        part = w.rows[np.searchsorted(w.doc, d) : np.searchsorted(w.doc, d, "right")]
        if len(ids := np.unique(part[part >= 0])):
            own = rows.some(ids)
            counts["ew"][np.unique(own.word), y[d]] += 1
            counts["ec"][np.unique(np.concatenate(own.flat)), y[d]] += 1
    total = np.bincount(y[~held], minlength=2) + 2
    share = (total[1] - 2) / (total.sum() - 4)
    for k, c in counts.items():
        # eight texts' worth of the base rate keeps rare rows near zero
        odds = np.log((c[:, 1] - 1 + 8 * share) / (total[1] - 2)) - np.log((c[:, 0] - 1 + 8 * (1 - share)) / (total[0] - 2))
        net.p[k][:, 0] = np.clip(odds, -3, 3)
    begin, _ = rows.means(np.maximum(net.p["ec"][:, 0], 0) ** 2)
    first = np.maximum(net.p["ew"][rows.word, 0], 0) ** 2 + begin
    score = (first[w.rows] * (w.rows >= 0)).sum(axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, rate = 0, 5e-3
    mine = np.flatnonzero(train & (y[w.doc] == 1))
    for epoch in range(epochs):
        rank = np.lexsort((-score, w.doc))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank)) - np.searchsorted(w.doc[rank], np.arange(n))[w.doc[rank]]
        size = np.bincount(w.doc, minlength=n)
        toxic = mine[place[mine] < np.maximum(1, size[w.doc[mine]] // 8)]
        other = rng.permutation(np.flatnonzero(train & (y[w.doc] == 0)))[: max(4 * len(toxic), 1000)]
        use = rng.permutation(np.concatenate([toxic, other]))
        for b in range(0, len(use), batch):
            pick = w.rows[use[b : b + batch]]
            words, inverse = np.unique(pick, return_inverse=True)
            own = rows.some(np.maximum(words, 0))
            x = net.inputs(own)
            gates, _ = gathered(net.projected(x), inverse.reshape(pick.shape))
            mask = (pick.T >= 0)[..., None].astype(np.float32)
            label = y[w.doc[use[b : b + batch]]].astype(np.float32)
            _, g, dg = net.gradients(gates, mask, label, np.where(label > 0, 2.0, 1.0).astype(np.float32))
            dx, to = np.zeros_like(x), inverse.reshape(pick.shape).T.ravel()
            order = np.argsort(to, kind="stable")
            first_of = np.searchsorted(to[order], np.arange(len(words)))
            for d in "fb":
                da = np.add.reduceat((dg[d] * mask).reshape(len(to), -1)[order], first_of, axis=0)
                g[f"w{d}"], g[f"b{d}"] = x.T @ da, da.sum(axis=0)
                dx += da @ net.p[f"w{d}"].T
            dx[words < 0] = 0
            g["ew"], g["ec"] = np.zeros_like(net.p["ew"]), np.zeros_like(net.p["ec"])
            np.add.at(g["ew"], own.word, dx[:, :DIM])
            for k in (0, 1):
                part = dx[:, (k + 1) * DIM : (k + 2) * DIM] / own.size[k][:, None]
                np.add.at(g["ec"], own.flat[k], np.repeat(part, own.size[k], axis=0))
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            clip = min(1.0, 1.0 / max(norm, 1e-9))
            for k, v in g.items():
                one, two = moments[k]
                one += 0.1 * (v * clip - one)
                two += 0.01 * ((v * clip) ** 2 - two)
                net.p[k] -= (rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        rate *= 0.8
        table = net.projected(net.inputs(rows))
        where = mine if epoch < epochs - 1 else np.arange(len(score))
        score[where] = window_logits(net, table, w.rows[where])
    s = summary(score, w.doc, n)
    calibration = logistic(s[held] if held.sum() > 50 else s, y[held] if held.sum() > 50 else y)
    return net, calibration


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression on the summary and a constant, by Newton steps."""
    a = np.column_stack([x / 10, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = sigmoid(a @ w)
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + 0.05 * w)
    return w


def scorer(parameters: dict, calibration: np.ndarray, texts_at_once: int = 256):
    """A function for mapInPandas that scores (doc_id, text)."""

    def run(batches):
        net, index, table = Network(), Numbers(), None
        net.p = parameters
        for batch in batches:
            for at in range(0, len(batch), texts_at_once):
                part = batch.iloc[at : at + texts_at_once]
                if len(index) > HELD_WORDS:
                    index, table = Numbers(), None
                known = len(index)
                w = Windows(part["text"], index)
                if len(index) > known or table is None:
                    new = net.projected(net.inputs(Rows(list(index)[known:] or [""])))
                    table = new if table is None else {d: np.concatenate([table[d], new[d]]) for d in "fb"}
                s = summary(window_logits(net, table, w.rows), w.doc, len(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": sigmoid(np.column_stack([s / 10, np.ones(len(s))]) @ calibration)})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER):
    """(doc_id, text, toxic) of a bounded sample of labelled rows outside the held-out fold, in an order of its own.

    One text for each id, the least, so repeated rows do not come back to the driver.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    open_ = labels.where((fold != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda label, most: open_.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1, most_toxic).unionByName(pick(0, most_other))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "text", "toxic").orderBy("doc_id").collect()


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    The fit takes MOST_TOXIC + MOST_OTHER labelled rows at most; held-out rows are never among them, and a score
    depends on the text alone. All overlapping windows of the whole text are scored. Null and empty texts are one
    empty window. With no labelled rows of either kind all scores are 0. Ids that are null are in no fold and have no
    label; an id that labels call both toxic and not is toxic; repeated rows are scored each, equal texts alike but for rounding.
    Other columns are not read.
    """
    rows = training_rows(docs, labels)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    if len({r["toxic"] for r in rows}) < 2:
        scored = ids.select("doc_id", F.lit(0.0).alias("score"))
    else:
        net, calibration = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
        scored = ids.mapInPandas(scorer(net.p, calibration), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
