"""Column expressions over names, paths, titles and prose."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of the characters that figures and identifiers are made of; whether it is a figure is judged as a whole.
TOKEN = r"[A-Za-z0-9_.,]+"
FIGURE = r"[0-9][0-9,]*([.][0-9]+)?"
#: The last word of a text that this library writes is this key and the run that wrote it.
RUN_KEY = "tablewarden-run="
#: A character that can end a URN: a letter, a digit, a closing bracket, or what joins the parts of a name.
URN_END = r"[\p{L}\p{N})_/-]"

#: How titles of each finding type begin.
TITLE_PREFIXES = {
    "upstream_freshness": "Stale upstream data in ",
    "target_leakage": "Target leakage: ",
    "input_schema_drift": "Training-serving schema drift in ",
    "sensitive_source": "Sensitive source: ",
    "proxy_candidate": "Proxy candidate: ",
    "deprecated_input": "Deprecated training input ",
    "table_level_risk": "Table-level ",
}


def diff_label(field: str, trained: str, now: str) -> Column:
    """One schema change: `f: a -> b`, `f (added, t)` or `f (removed, was t)`."""
    f, a, b = F.col(field), F.col(trained), F.col(now)
    return F.when(a.isNull(), F.concat(f, F.lit(" (added, "), b, F.lit(")"))).when(b.isNull(), F.concat(f, F.lit(" (removed, was "), a, F.lit(")"))).otherwise(F.concat(f, F.lit(": "), a, F.lit(" -> "), b))


def path_text(path: Column | str) -> Column:
    """Names of a path without consecutive repeats."""
    path = F.col(path) if isinstance(path, str) else path
    kept = F.filter(path, lambda x, i: (i == 0) | ~F.get(path, i - 1).eqNullSafe(x))
    return F.array_join(kept, " <- ")


#: Words of warehouse types, and the logical type that they mean; the first row with a word decides.
TYPE_WORDS = [
    ("string", ["CHAR", "TEXT", "STRING", "UUID"]),
    ("boolean", ["BOOL"]),
    ("timestamp", ["TIMESTAMP", "DATETIME"]),
    ("date", ["DATE"]),
    ("time", ["TIME"]),
    ("integer", ["INT", "SERIAL"]),
    ("number", ["DECIMAL", "NUMERIC", "DOUBLE", "FLOAT", "REAL", "NUMBER"]),
]


def logical_type(native: Column | str) -> Column:
    """Logical type of a warehouse type, or null when no word of TYPE_WORDS stands in it."""
    name = F.upper(native)
    holds = lambda ws: reduce(or_, [F.contains(name, F.lit(w)) for w in ws])
    return F.coalesce(*[F.when(holds(ws), kind) for kind, ws in TYPE_WORDS])


def name_tokens(name: Column | str) -> Column:
    """Distinct lower-case words of a name that are longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: F.length(x) > 2))


def stable_id(name: Column | str, key: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.concat(name, F.lit("-"), F.substring(F.sha2(key, 256), 1, 12))


def numbers_in(text: Column | str) -> Column:
    """Figures of a text that are no part of an identifier, as doubles.

    A token counts when it is digits, with commas and one fraction, up to what follows: `30,000.5` and the 6 of `6h`
    do, `v3`, `x_2024` and `1_000` do not begin with a digit of their own.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    parts = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(rf"(?:^|,)({FIGURE})"), F.lit(1))))
    return F.transform(parts, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def urns_in(text: Column | str) -> Column:
    """URNs of a text without the punctuation and brackets that the sentence leaves on them."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_extract(w, "urn:li:[a-zA-Z]+:.+", 0))
    return F.filter(F.transform(words, own_part), lambda u: u != "")


def own_part(word: Column) -> Column:
    """The longest beginning of a word that a sentence could not have ended: no stray mark and no bracket too many at its end."""
    lengths = F.sequence(F.length(word), F.lit(0), F.lit(-1))
    count = lambda u, mark: F.length(u) - F.length(F.replace(u, F.lit(mark), F.lit("")))
    loose = lambda u: ~F.rlike(F.right(u, F.lit(1)), F.lit(URN_END)) | (F.endswith(u, F.lit(")")) & (count(u, ")") > count(u, "(")))
    return F.get(F.filter(F.transform(lengths, lambda n: F.left(word, n)), lambda u: (u == "") | ~loose(u)), F.lit(0))


def run_id(description: Column | str) -> Column:
    """Run that the last word of a text names; null without such a word, so the incident is not ours."""
    words = F.array_remove(F.split(description, r"\s+"), "")
    last = F.try_element_at(words, F.lit(-1))
    return F.when(F.startswith(last, F.lit(RUN_KEY)), F.nullif(F.substring(last, len(RUN_KEY) + 1, 2**31 - 1), F.lit("")))


def classify_title(title: Column | str) -> Column:
    """Finding type by how the title begins; null when unknown."""
    out = F.lit(None).cast("string")
    for kind, prefix in TITLE_PREFIXES.items():
        out = F.when(F.startswith(F.col(title) if isinstance(title, str) else title, F.lit(prefix)), kind).otherwise(out)
    return out


#: What may stand around the name of a mark.
BLANKS = " \t\n\r\f\x0b"


def neutralize(text: Column | str) -> Column:
    """Untrusted text without evidence marks, opening or closing, in any case.

    A mark is what stands between an opening bracket and the next bracket, if that closes and, without blanks and
    one slash, nothing but the name is left.
    """
    parts = F.split(text, "<")

    def judged(part: Column) -> Column:
        inside = F.lower(F.btrim(F.substring_index(part, ">", 1), F.lit(BLANKS)))
        name = F.when(F.startswith(inside, F.lit("/")), F.ltrim(F.substring(inside, 2, 2**31 - 1), F.lit(BLANKS))).otherwise(inside)
        rest = F.substring(part, F.instr(part, F.lit(">")) + 1, F.lit(2**31 - 1))
        return F.when(F.contains(part, F.lit(">")) & (name == "evidence"), F.concat(F.lit("[removed]"), rest)).otherwise(F.concat(F.lit("<"), part))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(judged(p))), "")
