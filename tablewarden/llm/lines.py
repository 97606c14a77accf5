"""Fuzzy line deduplication: sampled word pairs, word sketches, edit similarity, one occurrence per connected group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, packed, quoted, save, stage_of, unpacked

#: Edit similarity in words from which on two lines are linked; 0.75 at least.
SIMILARITY = 0.8
#: Word pairs that name a line when candidates are searched. Lines of up to SHORT words are named by all their pairs.
SLOTS = 12
SHORT = SLOTS + 1
#: Most rows that are broadcast: places or positions of some 40 bytes.
BROADCAST_ROWS = 400_000
#: Lines of a bucket that one task compares with as many others; larger buckets are cut into blocks.
BLOCK = 1000
#: Lines of a bucket from which on its lines are compared by letters too, before a pair of them is a row.
WIDE = 64


def normal_words(line: Column) -> Column:
    """The words of a line: lower case, letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def identity(doc_id: str, text: str) -> list[Column]:
    """Names rows of equal id and text."""
    return [F.xxhash64(doc_id, text).alias("i1"), F.xxhash64(text, F.lit(7), doc_id).alias("i2")]


def occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, i1, i2, pos, lid): each line that has a word, pos from 1; and pos 0 once for each row with a text."""
    # named before its lines are rows, so that a text is hashed once and not for each of its lines
    named = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("doc"), *identity(doc_id, text), F.col(text).alias("t"))
    every = named.select("doc", "i1", "i2", F.posexplode(F.concat(F.array(F.lit("")), F.split("t", "\n"))).alias("pos", "line"))
    return every.where((F.col("pos") == 0) | F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc", "i1", "i2", "pos", F.xxhash64("line").alias("lid"))


def sketched(docs: DataFrame, text: str) -> DataFrame:
    """(lid, n_words, s0 to s3, keys) of each distinct line that has a word.

    keys: a hash of all the words, and for lines of 4 words or more (shorter ones are alike only when equal) hashes of
    pairs of neighbouring words. Each of SLOTS slots draws one pair: the least by hash, xor-ed with the slot's own
    constant, where each letter more makes a pair up to 2^8 times likelier to be drawn, since long words are rare. A
    pair's draw does not hang on the corpus, so lines that share most pairs draw alike. s0 to s3 mark the places, of
    256, of the words' hashes: an edit clears one mark and sets one at most. All of it is a minimum or a bitwise or over rows of
    words, so copies of a line are combined before anything is shuffled.
    """
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).select(F.xxhash64("line").alias("lid"), normal_words(F.col("line")).alias("words"))
    lines = lines.select("lid", "words", F.size("words").alias("n"), F.xxhash64("words").alias("whole"))
    # a plain posexplode drops empty arrays in a filter of its own, below, that would split each line once more
    words = lines.select("lid", "n", "whole", "words", F.posexplode_outer("words").alias("i", "w")).where("i is not null").withColumn("v", F.get("words", F.col("i") + 1))
    pair = F.when(F.col("v").isNotNull(), F.xxhash64("w", "v"))
    weight = F.greatest(F.lit(0), F.least(F.lit(8), F.octet_length("w") + F.octet_length("v") - 6))
    words = words.select("lid", "i", "n", "whole", F.xxhash64("w").alias("h"), pair.alias("pair"), weight.alias("weight"))
    low = F.col("pair").bitwiseAND(F.lit((1 << 40) - 1))
    top = F.shiftrightunsigned("pair", 41)
    words = words.withColumn("low", low).withColumn("top", top)
    slots = [F.min(F.when(F.col("n") > SHORT, F.expr(f"shiftleft(shiftrightunsigned(top ^ {j << 19}L, weight), 40) | low")).when(F.col("i") == j, F.col("low"))).alias(f"p{j}") for j in range(SLOTS)]
    marks = [F.bit_or(F.expr(f"if((h & 192) = {64 * j}, shiftleft(1L, cast(h & 63 as int)), 0L)")).alias(m) for j, m in enumerate(MARKS)]
    found = words.groupBy("lid").agg(F.max("n").alias("n_words"), F.max("whole").alias("whole"), *marks, *slots)
    pairs = F.array_compact(F.array(*[F.col(f"p{j}").bitwiseAND(F.lit((1 << 40) - 1)) for j in range(SLOTS)]))
    whole = F.array(F.shiftrightunsigned("whole", 2).bitwiseOR(F.lit(1 << 62)))
    return found.select("lid", *SKETCH, F.when(F.col("n_words") >= 4, F.array_distinct(F.concat(whole, pairs))).otherwise(whole).alias("keys"))


MARKS = [f"s{j}" for j in range(4)]
SKETCH = ["n_words", *MARKS]


def may_match(x: str, y: str, similarity: float) -> Column:
    """Lengths and marks of two lines, by column prefix, leave an edit similarity of `similarity` possible."""
    most = f"floor({1 - similarity!r}D * greatest({x}n_words, {y}n_words) + 1e-9)"
    apart = lambda u, v: " + ".join(f"bit_count({u}{s} & ~{v}{s})" for s in MARKS)
    return F.expr(f"abs({x}n_words - {y}n_words) <= {most} and {apart(x, y)} <= {most} and {apart(y, x)} <= {most}")


def ordered(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def few(table: DataFrame) -> DataFrame:
    """A saved table, to be broadcast when a count shows that it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def across(left: DataFrame, right: DataFrame, sizes: DataFrame, near: Column) -> DataFrame:
    """Pairs (a, b) of lines of one key from `left` x and `right` y for which `near` holds.

    A key of more than BLOCK lines is dealt over pairs of blocks, so that no task compares more than about BLOCK lines
    with as many others.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int")
    sized = sizes.select("key", blocks.alias("blocks"))
    x = left.join(sized, "key").withColumn("i", own).withColumn("j", F.explode(every)).drop("blocks").alias("x")
    y = right.join(sized, "key").withColumn("j", own).withColumn("i", F.explode(every)).drop("blocks").alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    return x.join(y, met & (F.col("x.component") != F.col("y.component")) & near).select(*ordered("x.lid", "y.lid")).distinct()


def candidates(rows: DataFrame, right: Column, sizes: DataFrame, near: Column, letters: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows x and those rows y that are `right`, of one key, which may match; saved.

    Keys of WIDE lines or more have their lines compared by letters within the join, each pair under the least wide key
    that both have, so lines that share a passage and are not alike make no rows.
    """
    near = near & may_match("x.", "y.", similarity)
    narrow, wide = sizes.where(F.col("size") < WIDE), sizes.where(F.col("size") >= WIDE)
    some = rows.join(narrow.select("key"), "key", "left_semi")
    pairs = across(some, some.where(right), narrow, near)
    if not wide.isEmpty():
        lettered = rows.join(letters, "lid")
        most = f"cast(floor(greatest(x.n_words, y.n_words) * {1 - similarity!r}D + 1e-9) as int)"
        once = F.array_min(F.array_intersect("x.wide", "y.wide")) == F.col("x.key")
        wide_rows = lettered.join(wide.select("key"), "key", "left_semi")
        pairs = pairs.unionByName(across(wide_rows, wide_rows.where(right), wide, near & once & F.expr(f"levenshtein(x.letters, y.letters, {most}) >= 0"))).distinct()
    return save(pairs, "pairs")


def lettered(rows: DataFrame, sizes: DataFrame, lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(lid, letters, wide) of the lines that have a wide key: a letter, of 127, for each word, and those keys; saved.

    Equal words have equal letters, so lines are as far apart as their letters at least.
    """
    keys = save(rows.join(sizes.where(F.col("size") >= WIDE).select("key"), "key", "left_semi").groupBy("lid").agg(F.collect_set("key").alias("wide")), "wide")
    hashes = hashed_lines(keys.select("lid"), lines, docs, doc_id, text)
    letter = F.array_join(F.transform("h", lambda h: F.call_function("char", F.pmod(h, F.lit(127)) + 1)), "")
    out = save(hashes.select("lid", letter.alias("letters")).join(keys, "lid"), "letters")
    discard(keys)
    return out


def similar_lines(lines: DataFrame, sketches: DataFrame, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame | None:
    """(lid, component) of the distinct lines that are linked with others; saved.

    Lines that share a key are candidates, as far as no gap in their lengths parts them. Two lines that are alone with a
    key are one pair, whatever number of keys they are alone with. Each line of a larger key is compared
    with one that all of the key share, with the next shorter one and with the next by marks first, which connects
    copies and most lines around one passage. Then, where they are not all connected, lines that may match none of
    another part go; of the others one line of each connected part is compared with the lines outside that part, then
    only the rest with each other. So copies of one line that differ a little cost comparisons in proportion to their
    number, while every candidate pair is either compared or known to be connected.
    """
    spark, keyed = docs.sparkSession, sketches.select("lid", "n_words", F.explode("keys").alias("key"))
    by_length = Window.partitionBy("key").orderBy("n_words", "lid")
    near = lambda low, high: F.coalesce(F.col(low) >= F.col(high) - F.floor(F.col(high) * (1 - similarity) + 1e-9), F.lit(False))
    keyed = keyed.withColumn("last", F.lag("n_words").over(by_length)).withColumn("next", F.lead("n_words").over(by_length))
    keyed = keyed.withColumn("joins", near("last", "n_words")).where(F.col("joins") | near("n_words", "next"))
    runs = keyed.withColumn("run", F.count_if(~F.col("joins")).over(by_length.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("key", "run")
    shared = runs.withColumns({"size": F.count(F.lit(1)).over(run), "a": F.max("lid").over(run), "b": F.min("lid").over(run)})
    shared = save(shared.where("size > 2 or lid = a").select(F.xxhash64("key", "run").alias("key"), "lid", "size", F.when(F.col("size") == 2, F.col("b")).alias("b")), "buckets")
    met = save(neighbours(shared.where("size > 2").drop("b").join(sketches.select("lid", *SKETCH), "lid"), similarity), "neighbours")
    twos = save(shared.where("size = 2").select(F.col("lid").alias("a"), "b").distinct(), "twos")
    discard(shared)
    marked = save(matching(twos, sketches, similarity), "matching")
    discard(twos)
    pairs = save(met.select("lid", F.explode("near").alias("other")).select(*ordered("lid", "other")).unionByName(marked).distinct(), "pairs")
    edges = verified(pairs, lines, docs, doc_id, text, similarity)
    discard(pairs, marked)
    found = save(components(edges, spark), "components")
    discard(edges)
    named = lambda rows: rows.join(few(found.withColumnRenamed("node", "lid")), "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    joined = lambda pairs: components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(pairs), spark)
    open_keys = lambda rows: rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "size")
    wide = not met.where(F.col("size") > BLOCK).isEmpty()
    rows = save(with_partner(named(met.drop("near")), wide, similarity).drop("size"), "partnered")
    discard(met)
    sizes = save(open_keys(rows), "open")
    part = Window.partitionBy("key", "component")
    rows, partnered = save(rows.withColumn("head", F.col("lid") == F.max("lid").over(part)), "rows"), rows
    discard(partnered)
    both_once = ~F.col("x.head") | (F.col("x.lid") > F.col("y.lid"))
    letters = lettered(rows, sizes, lines, docs, doc_id, text)
    pairs = candidates(rows, F.col("head"), sizes, both_once, letters, similarity)
    edges = verified(pairs, lines, docs, doc_id, text, similarity)
    before, found = found, save(joined(edges), "components")
    discard(before, pairs, sizes, edges)
    rest = rows.where("not head")
    if not rest.isEmpty():
        rest = save(named(rest.drop("component")), "rest")
        sizes = save(open_keys(rest), "open")
        pairs = candidates(rest, F.lit(True), sizes, F.col("x.lid") > F.col("y.lid"), letters, similarity)
        edges = verified(pairs, lines, docs, doc_id, text, similarity)
        before, found = found, save(joined(edges), "components")
        discard(before, rest, pairs, sizes, edges)
    discard(rows, letters)
    return found.withColumnRenamed("node", "lid")


def matching(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), from a saved table, that may match by length and marks."""
    of = lambda side, prefix: sketches.select(F.col("lid").alias(side), *[F.col(c).alias(prefix + c) for c in SKETCH])
    first = save(of("a", "x").join(few(pairs), "a"), "first")
    return of("b", "y").join(few(first), "b").where(may_match("x", "y", similarity)).select("a", "b")


def neighbours(rows: DataFrame, similarity: float) -> DataFrame:
    """rows and `near`: the lines of its key that a line may match, of the key's greatest id and the next by length and by marks."""
    bucket = Window.partitionBy("key")
    mine = F.struct("lid", *SKETCH)
    met = rows.withColumns({
        "hub": F.max(mine).over(bucket),
        "shorter": F.lag(mine).over(bucket.orderBy("n_words", "lid")),
        "alike": F.lag(mine).over(bucket.orderBy(*MARKS, "lid")),
    })
    near = [F.when((F.col(f"{other}.lid") != F.col("lid")) & may_match("", f"{other}.", similarity), F.col(f"{other}.lid")) for other in ("hub", "shorter", "alike")]
    return met.select(*rows.columns, F.array_compact(F.array(*near)).alias("near"))


def with_partner(rows: DataFrame, wide: bool, similarity: float) -> DataFrame:
    """The rows that may match a line of their key in another component.

    No pair of lines is a row here, and lines that share a word pair by chance go before anything else is read or moved
    for them. With `wide`, keys of more than BLOCK lines, if there are any, are dealt over pairs of blocks.
    """
    every = Window.partitionBy("key")
    rows = rows.withColumns({"lo": F.min("component").over(every), "hi": F.max("component").over(every)}).where("lo < hi").drop("lo", "hi")
    near = (F.col("x.lid") != F.col("y.lid")) & (F.col("x.component") != F.col("y.component")) & may_match("x.", "y.", similarity)
    met = lambda x, y, *on: x.alias("x").join(y.alias("y"), reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", *on)]) & near, "left_semi")
    # both sides move the same columns in the same way, so they are moved once
    one = rows.where(F.col("size") <= BLOCK)
    found = met(one, one)
    if wide:
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own, each = F.pmod(F.xxhash64("lid"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        large = rows.where(F.col("size") > BLOCK)
        dealt = met(large.withColumn("i", own).withColumn("j", each), large.withColumn("j", own).withColumn("i", each), "i", "j")
        found = found.unionByName(dealt.drop("i", "j").dropDuplicates(["key", "lid"]))
    return found


def coded(hashes: Column, number: Column) -> Column:
    """A text of one character for each number, so that edit distance counts words. Surrogates are passed over."""
    code = F.transform(hashes, lambda h: number(h))
    return F.decode(F.unhex(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(F.when(c < 0xD000, c + 0x100).otherwise(c + 0x1000)), 8, "0")), "")), "UTF-32")


def hashed_lines(wanted: DataFrame, lines: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(lid, h) of the wanted lines: the hashes of their words.

    A line is read from the text where it stands first, so texts without candidates don't move; a text is split once, not
    for each of its lines.
    """
    places = save(lines.join(wanted, "lid", "left_semi").select("lid", "keep.i1", "keep.i2", "keep.pos"), "places")
    of_text = places.groupBy("i1", "i2").agg(F.collect_list(F.struct("pos", "lid")).alias("places"))
    of_text = F.broadcast(of_text) if places.count() <= BROADCAST_ROWS else of_text
    texts = docs.where(F.col(text).isNotNull()).select(*identity(doc_id, text), F.col(text).alias("t")).join(of_text, ["i1", "i2"])
    rows = texts.select(F.split("t", "\n").alias("all"), "places").select("all", F.explode("places").alias("at"))
    line = F.get("all", F.col("at.pos") - 1)
    return rows.select("at.lid", F.transform(normal_words(line), lambda w: F.xxhash64(w)).alias("h")).dropDuplicates(["lid"])


def verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """Pairs (a, b) of line ids with edit similarity 1 - distance / longer length, in words, of `similarity` or more; saved.

    Words are coded by their hash in a million characters; where two words of a pair of lines get one code, they are numbered instead.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    hashes = hashed_lines(wanted, lines, docs, doc_id, text)
    codes = save(hashes.withColumn("t", coded(F.col("h"), lambda h: F.pmod(h, F.lit(1_000_000)))), "codes")
    text_of = lambda side: codes.select(F.col("lid").alias(side), F.col("t").alias(f"t{side}"))
    both = pairs.join(text_of("a"), "a").join(text_of("b"), "b")
    most = F.floor(F.greatest(F.length("ta"), F.length("tb")) * (1 - similarity) + 1e-9).cast("int")
    close = save(both.withColumn("most", most).where("levenshtein(ta, tb, most) >= 0").select("a", "b", "most"), "close")
    # one code for two words makes lines look more alike, so only pairs that pass need a second look
    hashes_of = lambda side: codes.select(F.col("lid").alias(side), F.col("h").alias(f"h{side}"))
    both = close.join(hashes_of("a"), "a").join(hashes_of("b"), "b")
    by_code = F.array_sort(F.transform(F.array_distinct(F.concat("ha", "hb")), lambda h: F.struct(F.pmod(h, F.lit(1_000_000)).alias("code"), h.alias("h"))))
    # within one array of one element, so that neither the sorted words nor those that share a code are made once a word
    clashing = F.transform(F.array(by_code), lambda e: F.transform(F.filter(e, lambda x, i: F.coalesce(F.get(e, i - 1)["code"] == x["code"], F.lit(False)) | F.coalesce(F.get(e, i + 1)["code"] == x["code"], F.lit(False))), lambda x: x["h"]))
    every = F.array_distinct(F.concat("ha", "hb"))
    own_code = F.size(every) == F.size(F.array_distinct(F.transform(every, lambda h: F.pmod(h, F.lit(1_000_000)))))
    both = both.select("a", "b", "most", "ha", "hb", F.when(own_code, F.array().cast("array<bigint>")).otherwise(F.get(clashing, F.lit(0))).alias("clash"))
    own = lambda h, clash: F.coalesce(F.nullif(F.array_position(clash, h), F.lit(0)) + 1_000_000, F.pmod(h, F.lit(1_000_000)))
    numbered = lambda h: F.get(F.transform(F.array("clash"), lambda clash: coded(F.col(h), lambda x: own(x, clash))), F.lit(0))
    exact = F.when(F.size("clash") > 0, F.levenshtein(numbered("ha"), numbered("hb"))).otherwise(0)
    good = save(both.where(exact <= F.col("most")).select("a", "b"), "verified")
    discard(codes, close)
    return good


def removals(docs: DataFrame, occ: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """(i1, i2, drop): positions, from 0, of the lines that go, for each row that loses any; saved."""
    first = F.min(F.struct("doc", "i1", "i2", "pos")).alias("keep")
    lines = save(occ.where("pos > 0").groupBy("lid").agg(first, F.count(F.lit(1)).alias("n")), "lines")
    sketches = save(sketched(docs, text), "sketches")
    found = similar_lines(lines, sketches, docs, doc_id, text, similarity)
    discard(sketches)
    grouped = lines.join(found, "lid", "left").where("component is not null or n > 1")
    keep = grouped.where("component is not null").groupBy("component").agg(F.min("keep").alias("best"))
    grouped = save(grouped.join(few(save(keep, "best")), "component", "left").select("lid", F.coalesce("best", "keep").alias("best")), "grouped")
    gone = occ.where("pos > 0").join(few(grouped), "lid").where(~F.struct("doc", "i1", "i2", "pos").eqNullSafe(F.col("best")))
    out = save(gone.groupBy("i1", "i2").agg(F.sort_array(F.collect_set(F.col("pos") - 1)).alias("drop")), "gone")
    discard(lines, grouped, found)
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the text of what line deduplication leaves, and n_lines, n_removed.

    Lines with a letter or digit take part, whatever their length. Two lines are linked when their words (lower case,
    letters and digits) are equal or their edit similarity in words is `similarity` (0.75 or more) or more. Of each
    connected group the occurrence that comes first by (id as text, null first, then row, position) stays; the others
    go. Candidates share a whole line or one of the word pairs that sketched() draws, so lines of up to SHORT words
    that are alike always meet, and longer ones nearly always (see the README for the measured share); which pairs
    meet does not depend on the size of the input. Texts are compared whole.

    Rows of equal id and text are copies of one row: one of them keeps the lines that stay, the others lose all their
    lines. Null texts stay null with no lines, and lines without a word always stay. Kept lines stay as they are,
    joined by newlines. Other columns of docs pass through, whatever their names; n_lines and n_removed of docs itself
    would clash and are an error.
    """
    if taken := {"n_lines", "n_removed"} & set(docs.columns):
        raise ValueError(f"the result has columns of its own named {sorted(taken)}")
    occ = save(occurrences(docs, doc_id, text), "occurrences")
    gone = removals(docs, occ, doc_id, text, similarity)
    twins = save(occ.where("pos = 0").groupBy("i1", "i2").count().where("count > 1").select("i1", "i2"), "twins")
    discard(occ)
    named = docs.select(packed(docs).alias("d"), *identity(doc_id, text), F.col(text).alias("t"))
    later = F.lit(False)
    if not twins.isEmpty():
        twins = few(twins)
        again = save(named.join(twins, ["i1", "i2"], "left_semi").withColumn("rid", F.monotonically_increasing_id()), "again")
        firsts = few(save(again.groupBy("i1", "i2").agg(F.min("rid").alias("first")), "firsts"))
        again = again.join(firsts, ["i1", "i2"]).withColumn("later", F.col("rid") > F.col("first")).drop("rid", "first")
        named = named.join(twins, ["i1", "i2"], "left_anti").withColumn("later", F.lit(False)).unionByName(again)
        later = F.col("later")
    joined = named.join(few(gone), ["i1", "i2"], "left")
    worded = F.expr(r"exists(split(t, '\n'), l -> l rlike '[\\p{L}\\p{N}]')")
    left = F.when(later, F.expr(r"filter(split(t, '\n'), l -> not l rlike '[\\p{L}\\p{N}]')")).otherwise(F.expr(r"filter(transform(split(t, '\n'), (l, i) -> if(array_contains(drop, i), null, l)), l -> l is not null)"))
    kept = F.when(F.col("drop").isNull() & ~(later & worded), F.col("t")).otherwise(F.array_join(left, "\n"))
    columns = [kept.alias(c) if c == text else old for c, old in zip(docs.columns, unpacked(docs, "d"))]
    lines = F.coalesce(F.size(F.split("t", "\n")), F.lit(0))
    removed = F.when(later, F.expr(r"size(filter(split(t, '\n'), l -> l rlike '[\\p{L}\\p{N}]'))")).otherwise(F.coalesce(F.size("drop"), F.lit(0)))
    return joined.select(*columns, lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@stage_of
def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text. Documents that lose all their words go."""
    found = dedup_lines(docs).where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"[\p{L}\p{N}]"))).select(*[quoted(c) for c in docs.columns])
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found
