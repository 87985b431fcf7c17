"""Secret scans: patterns for known forms, and sliding-window Shannon entropy for unknown ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.common import let, running_sum

#: Base kinds, in the order that ties between spans take.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, which are what the open-ended patterns match, of the wanted length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6

#: Candidates for the entropy scan: maximal runs of base64 or identifier characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character that some window must reach, by character class. Random hexadecimal digits reach about 3.4 of 4, random base64 4.1 of 4.3.
MIN_BITS = {"hex": 3.0, "base64": 3.75}
#: Parts of candidates that are known to be harmless: fillers hide themselves, words WINDOW characters on each side too.
FILLER = r"(?i)0123456789|abcdefghij|xxxx+|(.)\1{7,}"
HARMLESS = rf"(?i).{{0,{WINDOW}}}(?:example|sample|dummy|placeholder|changeme|redacted|lorem).{{0,{WINDOW}}}"
#: What is left of a candidate is harmless if all of it matches one of these.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z_=/+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Counts of a window's characters are packed, so many bits each, into longs.
COUNT_BITS = 5
PER_LONG = 60 // COUNT_BITS


def _places(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches: array of (start, end, value), in code points.

    What lies between the matches comes from split(); lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.transform(m, F.length)

        def ends(g: Column) -> Column:
            steps = F.zip_with(F.slice(g, 1, F.size(m)), sizes, lambda a, b: a + b)
            return F.zip_with(F.slice(let(steps, lambda v: running_sum(v)), 2, F.size(m)), m, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

        return let(gaps, ends)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _weight(n: Column) -> Column:
    """n log2 n, of a window's counts."""
    known = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]
    return F.get(F.array(*[F.lit(x) for x in known]), n)


def window_entropy(value: Column) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of WINDOW characters of a run over ALPHABET.

    One step a character: the counts of the character that comes in and of the
    one that goes out change by one, and so do their terms of the sum. Counts
    are packed into a few longs, of which a step changes two.
    """
    units = F.array(*[F.lit(1 << COUNT_BITS * k).cast("long") for k in range(PER_LONG)])
    mask = (1 << COUNT_BITS) - 1

    def scan(codes: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // PER_LONG)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"), F.lit(0).alias("at"),
        )

        def count(acc: Column, code: Column) -> Column:
            held = F.get(acc["counts"], F.floor(code / PER_LONG).cast("int"))
            return F.call_function("shiftright", held, code % PER_LONG * COUNT_BITS).bitwiseAND(mask).cast("int")

        def step(acc: Column, come: Column) -> Column:
            gone = F.get(codes, acc["at"] - WINDOW)
            n_in = count(acc, come)
            n_out = count(acc, F.coalesce(gone, come))
            change = F.when(gone.isNull(), _weight(n_in + 1) - _weight(n_in)).when(come == gone, 0.0).otherwise(_weight(n_in + 1) - _weight(n_in) + _weight(n_out - 1) - _weight(n_out))
            unit = lambda code, k: F.when(F.floor(code / PER_LONG) == k, F.get(units, code % PER_LONG)).otherwise(F.lit(0).cast("long"))
            return F.struct(
                F.transform(acc["counts"], lambda n, k: n + unit(come, k) - F.coalesce(unit(gone, k), F.lit(0).cast("long"))).alias("counts"),
                (acc["sum"] + change).alias("sum"),
                F.when(acc["at"] >= WINDOW - 1, F.least(acc["least"], acc["sum"] + change)).otherwise(acc["least"]).alias("least"),
                (acc["at"] + 1).alias("at"),
            )

        return F.aggregate(codes, start, step, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    chars = F.array_remove(F.split(value, ""), "")
    return let(F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1), scan)


def suspicious(value: Column) -> Column:
    """Whether some part of a run, between what is known to be harmless, has a window whose entropy reaches its class's bits."""

    def part(v: Column) -> Column:
        allowed = F.length(v) < WINDOW
        for pattern in ALLOWED:
            allowed = allowed | v.rlike(pattern)
        bits = F.when(v.rlike("^[0-9a-fA-F]+$"), MIN_BITS["hex"]).otherwise(MIN_BITS["base64"])
        return F.when(allowed, False).otherwise(window_entropy(v) >= bits)

    whole = F.lit(False)
    for pattern in ALLOWED:
        whole = whole | value.rlike(pattern)
    left = F.split(F.regexp_replace(F.regexp_replace(value, HARMLESS, " "), FILLER, " "), " ")
    return F.when(whole, False).otherwise(F.exists(left, part))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, and spans: array of (start, kind, end, value) by start, then kind (its place in KINDS).

    Kinds: what the patterns assign, access and hex match (an assignment's value
    has MIN_VALUE characters or more), and entropy: a candidate run, outside all
    of those, with a window whose entropy reaches its class's bits. The
    allow-list takes parts out of a run before that; what is left on either side
    is looked at by itself. No shuffle. Null and empty text: no spans. Null ids
    and repeated rows pass through. Ties: spans of one start are in the order of
    KINDS. Clashing names: other columns of docs aren't read. Very long texts: a
    run takes time in proportion to its length. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda kind: lambda p: F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), p["end"].alias("end"), p["value"].alias("value"))
    assigned = F.filter(_places(text, ASSIGN), lambda p: F.length(F.regexp_extract(p["value"], ASSIGN, 2)) >= MIN_VALUE)
    base = F.concat(F.transform(assigned, span("assign")), F.transform(_places(text, ACCESS), span("access")), F.transform(_places(text, HEX), span("hex")))

    def unknown(b: Column):
        def test(p: Column) -> Column:
            inside = F.exists(b, lambda s: (s["start"] <= p["start"]) & (s["end"] >= p["end"]))
            return F.when(inside, False).otherwise(suspicious(p["value"]))

        return test

    candidates = _places(text, CANDIDATE)
    spans = let(base, lambda b: F.array_sort(F.concat(b, F.transform(F.filter(candidates, unknown(b)), span("entropy")))))
    return docs.select(F.col(id_col), spans.alias("spans"))


def _told(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan_secrets() over all documents, told as counts, a digest and a list."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("entropy"))
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
