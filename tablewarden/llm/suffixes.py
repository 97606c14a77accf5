"""Repeated byte windows by a depth-limited, most-significant-digit radix sort of suffixes."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package

#: Bytes of a repeated window; windows that travel together in the first pass; how many parts a later pass makes.
WINDOW, RUN, FAN = 400, 256, 16
#: Bytes of a repeated string that makes a document one with a repeated passage: about 45 words.
PASSAGE = 280
#: Most anchors, spans or heads that are broadcast, of some 40 bytes, so 60 MB; beyond that both sides are shuffled.
BROADCAST_ROWS = 1_500_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hash of any substring from prefix sums: sum of code[byte] * base^position, shifted to position 0, mod 2^64."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(int(rng.integers(2**40, 2**62)) * 8 + 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Along the last axis, one longer than the data."""
        self.reach(data.shape[-1] + 1)
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
        np.cumsum(self.codes[data] * self.powers[: data.shape[-1]], axis=-1, out=out[..., 1:])
        return out

    def of(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return self.mixed((prefix[..., end] - prefix[..., start]) * self.inverses[start])

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * _M1
        h = (h ^ (h >> np.uint64(29))) * _M2
        return h ^ (h >> np.uint64(32))


def heads(data: np.ndarray, one: Rolling, two: Rolling, window: int, run: int):
    """The heads of a text's suffixes: (p, head hash, hash of all bytes of its suffixes, lo, hi).

    The head of a suffix is its least hashed gram (window - run + 1 bytes, the first one if equal) among the `run`
    grams that its first `window` bytes hold. Suffixes of one head lie together: they start at p - o for o in lo..hi.
    """
    n, gram = len(data), window - run + 1
    first = one.prefix(data)
    at = np.arange(n - gram + 1)
    value = one.of(first, at, at + gram)
    # least value, then place: both move with the bytes, so equal windows have equal heads
    low, step = (value >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64), 1
    while step < run:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    owner = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    end = np.concatenate([begin[1:], [len(owner)]]) - 1
    p = owner[begin]
    return p, value[p], two.of(two.prefix(data), begin, end + window), p - end, p - begin


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _hasher():
    return Rolling(11), Rolling(12)


def first_pass(window: int):
    """A function for mapInPandas that gives the heads of all texts."""

    def run(batches):
        one, two = _hasher()
        for batch in batches:
            parts = []
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]):
                data = _bytes(text)
                if len(data) < window:
                    continue
                p, head, wide, lo, hi = heads(data, one, two, window, RUN)
                parts.append((np.full(len(p), k1), np.full(len(p), k2), p, head.view(np.int64), wide.view(np.int64), lo, hi))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                yield pd.DataFrame(dict(zip(["k1", "k2", "p", "head", "wide", "lo", "hi"], columns)))

    return run


def contexts(window: int):
    """The bytes around each open anchor: RUN - 1 before it and `window` from it on, where the text has them."""

    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, text, anchors in zip(batch["k1"], batch["k2"], batch["text"], batch["anchors"]):
                data = text.encode("utf-8", "replace")
                for p, lo, hi in ((a["p"], a["lo"], a["hi"]) for a in anchors):
                    cut = bytes(max(0, RUN - 1 - p)) + data[max(0, p - RUN + 1) : p + window]
                    out.append((k1, k2, p, lo, hi, cut + bytes(RUN - 1 + window - len(cut))))
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "p", "lo", "hi", "cut"])

    return run


def next_pass(width: int, window: int):
    """Split groups of `width` suffixes (k1, k2, p, lo, hi, cut, at) into FAN parts, with the digests of each part.

    core: the bytes that all suffixes of the part share; whole: the bytes that they hold together. A part is cut to
    the offsets that its anchor has; `full` tells whether it has all. For single suffixes both are the window itself.
    """
    part = width // FAN

    def run(batches):
        one, two = _hasher()
        for batch in batches:
            if not len(batch):
                continue
            cut = np.frombuffer(b"".join(batch["cut"]), np.uint8).reshape(len(batch), -1)
            at, lo, hi = (batch[c].to_numpy() for c in ("at", "lo", "hi"))
            f1, f2 = one.prefix(cut), two.prefix(cut)
            rows = np.arange(len(batch))
            for k in range(FAN):
                a = at + k * part
                b = a + part - 1
                ok = (b >= lo) & (a <= hi)
                if not ok.any():
                    continue
                r, a, b = rows[ok], a[ok], b[ok]
                low, high = np.maximum(a, lo[ok]), np.minimum(b, hi[ok])
                digest = lambda h, f, start, end: Rolling.mixed((f[r, end] - f[r, start]) * h.inverses[start]).view(np.int64)  # noqa: B023, E731
                picked = batch.iloc[r]
                columns = {c: picked[c].to_numpy() for c in ("k1", "k2", "p", "lo", "hi")}
                core = digest(one, f1, RUN - 1 - a, RUN - 1 - b + window)
                whole = digest(two, f2, RUN - 1 - high, RUN - 1 - low + window)
                yield pd.DataFrame(columns | {"at": a, "low": low, "high": high, "core": core, "whole": whole})

    return run


def removed(batches):
    """Merge the spans of each text and hash what is left."""
    for batch in batches:
        out = []
        for doc_id, text, copies, starts, ends, passage in zip(*(batch[c] for c in ("doc_id", "text", "copies", "starts", "ends", "has_passage"))):
            data = text.encode("utf-8", "replace")
            spans, left, gone, done = 0, [], 0, 0
            if copies > 1 and len(data) >= WINDOW:
                starts, ends = [0], [len(data)]
            if starts is not None and len(starts):
                for s, e in sorted(zip(starts, ends)):
                    if s > done or not spans:
                        left.append(data[done:s])
                        spans += 1
                    if e > done:
                        gone += e - max(s, done)
                        done = e
            left.append(data[done:])
            out.append((doc_id, len(data), gone, spans, hashlib.sha256(b"".join(left)).hexdigest(), bool(passage)))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_passage"]).astype({"doc_id": "Int64"})


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast when it has few rows, which is counted first."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def merged(batches):
    """Spans of texts, sorted by text and start, with those that touch made one."""
    held = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False, name=None):
            if held and held[:2] == row[:2] and row[2] <= held[3]:
                held = (*held[:3], max(held[3], row[3]))
            else:
                out += [held] if held else []
                held = row
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "start", "end"])
    if held:
        yield pd.DataFrame([held], columns=["k1", "k2", "start", "end"])


def repeated_spans(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, start, end): bytes of texts of (k1, k2, text) that repeated windows cover, merged.

    Suffixes are ordered through `window` bytes only, most significant digit first. The first digit of a suffix is its
    head (see heads()): suffixes of one head travel as a run, and runs whose head stands nowhere else leave. Runs
    that are equal as a whole are repeated as a whole and leave too, one of each kind staying as a witness. What is
    open is split in FAN parts by offset and ordered by the further bytes that all of a part share, twice, until
    parts are single suffixes: equal groups are then the repeated windows. Only counts are shuffled by digest, never
    pairs, so a passage that thousands share costs a partial count per task. A match is decided by two 64-bit digests.
    """
    schema = "k1 long, k2 long, p int, head long, wide long, lo int, hi int"
    rows = save(keyed.where(F.octet_length("text") >= window).mapInPandas(first_pass(window), schema), "heads")
    again = save(rows.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("head"), "again")
    some = save(rows.join(small_side(again, again.count()), "head"), "runs")
    discard(rows, again)
    run = ["head", "wide", "lo", "hi"]
    whole = some.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "p")).alias("w"))
    whole = save(whole, "wholes")
    closed = some.join(whole.where("n > 1").select(*run), run, "left_semi")
    done = [closed.select("k1", "k2", (F.col("p") - F.col("hi")).alias("start"), (F.col("p") - F.col("lo") + window).alias("end"))]
    # suffixes that are done still show that others stand at a second place: one of each equal group goes on
    mixed = whole.groupBy("head").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1").select("head")
    going = save(whole.join(mixed, "head", "left_semi").select("w.*", "lo", "hi"), "open")
    anchors = going.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "lo", "hi")).alias("anchors"))
    held = keyed.join(small_side(anchors, going.count()), ["k1", "k2"]).select("k1", "k2", "text", "anchors")
    found = held.mapInPandas(contexts(window), "k1 long, k2 long, p int, lo int, hi int, cut binary")
    cuts = save(found.dropDuplicates(["k1", "k2", "p"]), "cuts")  # texts with copies give theirs once
    now, width, used = cuts.withColumn("at", F.lit(0)), RUN, [some, whole, going, cuts]
    place = F.xxhash64("k1", "k2", F.col("p") - F.col("at"))
    twice = [F.min(place).alias("a"), F.max(place).alias("b")]
    while width > 1:
        parts = now.mapInPandas(next_pass(width, window), "k1 long, k2 long, p int, lo int, hi int, at int, low int, high int, core long, whole long")
        parts, width = save(parts, "parts"), width // FAN
        used.append(parts)
        cores = parts.groupBy("core").agg(*twice).where("a < b").select("core")
        live = save(parts.join(cores, "core", "left_semi"), "live")
        used.append(live)
        # cut to the same offsets, so that the same suffixes stand at both places
        kind = ["core", "whole", F.col("low") - F.col("at"), F.col("high") - F.col("at")]
        kinds = live.select("*", kind[2].alias("u"), kind[3].alias("v")).groupBy("core", "whole", "u", "v").agg(*twice, F.min(F.struct("k1", "k2", "p", "at", "lo", "hi")).alias("w"))
        kinds = save(kinds, "kinds")
        used.append(kinds)
        same = live.select("*", kind[2].alias("u"), kind[3].alias("v")).join(kinds.where("a < b").select("core", "whole", "u", "v"), ["core", "whole", "u", "v"], "left_semi")
        done.append(same.select("k1", "k2", (F.col("p") - F.col("high")).alias("start"), (F.col("p") - F.col("low") + window).alias("end")))
        if width > 1:
            mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
            now = kinds.join(mixed, "core", "left_semi").select("w.*").select("k1", "k2", "p", "at").join(cuts, ["k1", "k2", "p"])
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ordered = out.distinct().repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start")
    spans = save(ordered.select("k1", "k2", "start", "end").mapInPandas(merged, "k1 long, k2 long, start int, end int"), "spans")
    discard(*used)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_passage, when all bytes of repeated windows go.

    Null texts are empty. Texts shorter than the window stay. Texts with an equal other row go whole (when as long
    as the window), whatever their ids. Rows with null or repeated ids are rows like others, and other columns are not
    read. has_passage tells whether a document of PASSAGE bytes or more holds a string of so many that also starts
    anywhere else: passages shorter than the window, which stay. Only texts that hold one are searched for windows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(1)).alias("k2"), body.alias("text"))
    copies = keyed.where(F.octet_length("text") >= PASSAGE).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    texts = keyed.drop("doc_id")
    short = repeated_spans(texts, PASSAGE)
    holds = save(short.select("k1", "k2").distinct(), "holds")
    discard(short)
    found = repeated_spans(texts.join(small_side(holds, holds.count()), ["k1", "k2"], "left_semi"))
    spans = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marks = holds.withColumn("holds", F.lit(True)).join(spans, ["k1", "k2"], "left").join(copies, ["k1", "k2"], "full_outer")
    marks = save(marks, "marks")
    marks = small_side(marks, found.count() + marks.count())
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_passage boolean"
    marked = F.coalesce(F.col("holds"), F.col("copies").isNotNull()).alias("has_passage")
    ready = keyed.join(marks, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), marked)
    return ready.mapInPandas(removed, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
