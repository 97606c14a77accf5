"""Quality rules whose cutoffs adapt to language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, save, stage_of, unpacked

_GAP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

#: Rules: metric, side, quantile of the tail, least cutoff that a group may get (upper) or most (lower).
RULES = [("symbol_rate", "upper", 0.9, 50), ("word_length", "upper", 0.9, 1200), ("word_length", "lower", 0.1, 250), ("line_rate", "upper", 0.9, 400), ("repeat_rate", "upper", 0.9, 300)]
#: How many times the distance from median to tail quantile lies between that quantile and the cutoff; rows for which the cutoff of the wider group counts.
SPREAD, PARENT_ROWS = 3, 1000
#: Most rows of thresholds that are broadcast.
BROADCAST_ROWS = 50_000


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates that rules look at (whole numbers).

    Null texts count as empty: all zero. A word is repeated when it lies in an 8-word window that stands at two or
    more places of the text; windows compare by 64-bit hash, sorted only in texts that have equal ones.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    window = ", ".join(f"h[i + {k}]" for k in range(8))
    repeat = f"""transform(array(ws), w -> if(size(w) < 8, 0L, transform(array(transform(w, x -> xxhash64(x))), h ->
        transform(array(transform(sequence(0, size(h) - 8), i -> xxhash64({window}))), g ->
        if(size(array_distinct(g)) = size(g), 0L,
          transform(array(array_sort(transform(g, (x, i) -> named_struct('x', x, 'i', i)))), s ->
          transform(array(array_sort(transform(filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false)), e -> e.i))), st ->
            aggregate(transform(st, (p, k) -> if(k + 1 < size(st), least(8, st[k + 1] - p), 8)), 0L, (a, b) -> a + b))[0])[0]))[0])[0]))[0]"""
    out = docs.withColumn("ws", F.array_remove(F.split(body, _GAP), "")).withColumn("n_words", F.size("ws").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("ws", "")).cast("long")).withColumn("n_repeat_words", F.expr(repeat)).drop("ws")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(_WORD))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("n_lines", F.size("_lines").cast("long")).drop("_lines")
    rate = lambda a, b, k: F.when(F.col(b) > 0, F.floor(F.col(a) * k / F.col(b))).otherwise(0).cast("long")
    out = out.withColumn("symbol_rate", rate("n_symbols", "word_chars", 1000)).withColumn("word_length", rate("word_chars", "n_words", 100))
    return out.withColumn("line_rate", rate("n_dup_lines", "n_lines", 1000)).withColumn("repeat_rate", rate("n_repeat_words", "n_words", 1000))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang_key, source_key, metric, bucket, n): a mergeable quantile sketch for each language and source.

    A value keeps its 7 leading bits, so a bucket is within 1/64 of its values; sketches merge by adding counts, in
    any order, with the same result. At most about 4,000 buckets a group, however many rows. Documents that the
    base rules fail don't take part.
    """
    metrics = sorted({m for m, *_ in RULES})
    stacked = measured.where(~base_failed()).select("lang_key", "source_key", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "value"))
    cut = F.greatest(F.lit(0), F.length(F.bin("value")) - 7)
    bucket = F.expr("shiftleft(shiftright(value, cut), cut)")
    return stacked.withColumn("cut", cut).select("lang_key", "source_key", "metric", bucket.alias("bucket")).groupBy("lang_key", "source_key", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang_key, source_key, and a column for each rule): cutoffs from the group's sketch and the wider ones'.

    upper = max(least, q90 + SPREAD * (q90 - q50)); lower = min(most, q10 - SPREAD * (q50 - q10)), not below 0. A
    group's cutoff is the mean of its own, weighted by its rows, and its language's, which counts for PARENT_ROWS rows; a
    language's likewise of its own and that of all. So one formula serves groups of every size: a few rows change little,
    many decide, and no number of rows switches.
    """
    levels = [sketch, sketch.withColumn("source_key", F.lit("*")), sketch.withColumn("source_key", F.lit("*")).withColumn("lang_key", F.lit("*"))]
    merged = levels[0].unionByName(levels[1]).unionByName(levels[2]).groupBy("lang_key", "source_key", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang_key", "source_key", "metric")
    ranked = merged.withColumn("below", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("below") * 100 >= F.col("all") * int(q * 100), F.col("bucket")))
    found = ranked.groupBy("lang_key", "source_key", "metric").agg(at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"), F.max("all").alias("rows"))
    wide = found.groupBy("lang_key", "source_key").agg(
        F.max("rows").alias("rows"),
        *[
            F.max(F.when(F.col("metric") == m, F.greatest(F.lit(limit), F.col("q90") + SPREAD * (F.col("q90") - F.col("q50"))) if side == "upper" else F.greatest(F.lit(0), F.least(F.lit(limit), F.col("q10") - SPREAD * (F.col("q50") - F.col("q10")))))).alias(f"{m}_{side}")
            for m, side, _, limit in RULES
        ],
    )
    own = wide.where("source_key <> '*'")
    names = [f"{m}_{side}" for m, side, *_ in RULES]
    pick = lambda level, keys: level.select(*keys, F.struct("rows", *names).alias("t"))
    lang = pick(wide.where("source_key = '*' and lang_key <> '*'"), ["lang_key"]).withColumnRenamed("t", "l")
    every = pick(wide.where("source_key = '*' and lang_key = '*'"), []).withColumnRenamed("t", "e")
    chosen = pick(own, ["lang_key", "source_key"]).join(lang, "lang_key", "left").crossJoin(every)  # one row
    mean = lambda own, rows, wider: f"({rows} * {own} + {PARENT_ROWS} * {wider}) div ({rows} + {PARENT_ROWS})"
    blended = [F.expr(mean(f"t.{n}", "t.rows", f"({mean(f'l.{n}', 'l.rows', f'e.{n}')})")).alias(n) for n in names]
    return chosen.select("lang_key", "source_key", *blended)


def judge(measured: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Add base_failed and kept to a saved table of measures with lang_key and source_key, or to `over`, which has the same.

    A document goes when the base rules fail it or a rate lies beyond its group's cutoff. Groups of which the base
    rules fail all documents have no cutoffs. The thresholds are broadcast only after a count shows that they are
    few; otherwise the join shuffles, and skewed groups split.
    """
    table = save(thresholds(sketches(measured)), "thresholds")
    few = table.count() <= BROADCAST_ROWS
    joined = (measured if over is None else over).join(F.broadcast(table) if few else table, ["lang_key", "source_key"], "left")
    beyond = [F.coalesce(F.col(m) > F.col(f"{m}_{side}") if side == "upper" else F.col(m) < F.col(f"{m}_{side}"), F.lit(False)) for m, side, *_ in RULES]
    bad = beyond[0]
    for b in beyond[1:]:
        bad = bad | b
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~(base_failed() | bad))


def with_keys(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Null languages and sources are groups of their own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return docs.withColumn("lang_key", key(lang)).withColumn("source_key", key(source))


BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    measured = save(with_keys(measures(docs)).drop("text", "lang", "source"), "measures")
    return judge(measured).select("doc_id", *BASE_COLUMNS, "base_failed", "kept")


@stage_of
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    body = docs.select(packed(docs).alias("doc"), "text", "lang", "source")
    found = with_keys(measures(body)).drop("text", "lang", "source")
    # no text is saved: texts are measured again where they are judged
    return judge(save(found.drop("doc"), "measures"), found).where("kept").select(*unpacked(docs, "doc"))


_METRICS = sorted({m for m, *_ in RULES})
#: The rows of op7 in DuckDB.
ORACLE = rf"""
WITH w AS (SELECT doc_id, text, coalesce('=' || lang, 'null') AS lk, coalesce('=' || source, 'null') AS sk, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS t(k) GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lk, sk, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS word_length, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS line_rate,
        CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_rate, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0),
v AS ({" UNION ALL ".join(f"SELECT lk, sk, '{m}' AS metric, {m}::BIGINT AS x FROM m WHERE NOT base_failed" for m in _METRICS)}),
b AS (SELECT lk, sk, metric, (x >> greatest(0, length(bin(x)) - 7)) << greatest(0, length(bin(x)) - 7) AS bucket, count(*) AS n FROM v GROUP BY ALL),
every AS (SELECT lk, sk, metric, bucket, n FROM b UNION ALL SELECT lk, '*', metric, bucket, n FROM b UNION ALL SELECT '*', '*', metric, bucket, n FROM b),
s AS (SELECT lk, sk, metric, bucket, sum(n) AS n FROM every GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY lk, sk, metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lk, sk, metric) AS total FROM s),
q AS (SELECT lk, sk, metric, min(CASE WHEN below * 100 >= total * 10 THEN bucket END) AS q10, min(CASE WHEN below * 100 >= total * 50 THEN bucket END) AS q50, min(CASE WHEN below * 100 >= total * 90 THEN bucket END) AS q90, max(total) AS cnt FROM r GROUP BY ALL),
t AS (SELECT lk, sk, max(cnt) AS cnt, {", ".join(f"max(CASE WHEN metric = '{m}' THEN " + (f"greatest({limit}, q90 + {SPREAD} * (q90 - q50))" if side == "upper" else f"greatest(0, least({limit}, q10 - {SPREAD} * (q50 - q10)))") + f" END) AS {m}_{side}" for m, side, _, limit in RULES)} FROM q GROUP BY ALL),
c AS (SELECT o.lk, o.sk, {", ".join(f"(o.cnt * o.{m}_{side} + {PARENT_ROWS} * ((l.cnt * l.{m}_{side} + {PARENT_ROWS} * e.{m}_{side}) // (l.cnt + {PARENT_ROWS}))) // (o.cnt + {PARENT_ROWS}) AS {m}_{side}" for m, side, *_ in RULES)}
        FROM t o JOIN t l ON l.lk = o.lk AND l.sk = '*' CROSS JOIN (SELECT * FROM t WHERE lk = '*') e WHERE o.sk <> '*')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"coalesce({m} {'>' if side == 'upper' else '<'} {m}_{side}, false)" for m, side, *_ in RULES)}) AS kept
FROM m LEFT JOIN c ON c.lk = m.lk AND c.sk = m.sk
"""
