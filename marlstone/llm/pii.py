"""Personal data: patterns propose, validators confirm, context words adjust.

Everything is a DataFrame expression; no Python runs on the executors.

Base kinds are found leftmost and without overlap within a kind and reported as
code-point offsets:

* ``email`` and ``ip`` (four parts, each at most 255),
* ``card``: 12 to 19 digits, single blanks or hyphens between, passing Luhn,
* ``phone``: a plus sign and 9 to 15 digits.

The method adds two kinds: ``iban`` (mod-97) and ``tel``, a national number of
10 or 11 digits, which counts only if a context word stands near it.  Every
span has a score: a prior of its kind and validator, raised by a context word
within ``CONTEXT_CHARS`` code points before it.  Base spans are kept whatever
their score; added ones need ``MIN_SCORE``.  Context is cut from the pieces
between matches, never counted from the start of the text, so many spans in one
long text cost no more each than few.

Null text counts as empty: no spans, the digest of the empty string.  Repeated
rows each give their own row.  Columns of the input pass through; the columns
this operator adds replace ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bind, prefix_sums

CONTEXT_CHARS = 48
#: Matches that can end within the context; none is shorter than five characters.
CONTEXT_HITS = 10
MIN_SCORE = 0.6
CONTEXT_BONUS = 0.35

# A run may start where the character before is outside it, or where the last
# match ended.  Possessive quantifiers never give back, so long runs cost no
# stack and no retries.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "tel": r"(?<![0-9+()])(?<![0-9][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3,4}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
NEEDS = {"email": ["@"], "ip": ["."], "card": [], "phone": ["+"], "iban": [], "tel": []}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "tel")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "tel": 0.3}
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|server|host|address|login",
    "card": r"card|visa|master|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|whatsapp|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "tel": r"phone|tel|call|mobile|fax|whatsapp|anruf",
}


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has remainder 1."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        letter = F.ascii(ch) - F.lit(55)
        return F.when(ch.rlike("[0-9]"), acc * 10 + F.ascii(ch) - F.lit(48)).otherwise(acc * 100 + letter) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    return F.lit(True)


def _found(text: Column, kind: str, rank: int) -> Column:
    """Array of (start, rank, end, kind, score) of one kind."""
    pattern = F.lit(PATTERNS[kind])
    hits = F.regexp_extract_all(text, pattern, F.lit(0))

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
        pieces = F.zip_with(gaps, found, lambda g, h: F.struct(F.right(g, F.lit(CONTEXT_CHARS)).alias("tail"), F.length(g).alias("gap"), h.alias("hit")))
        return bind(pieces, among)

    def among(pieces: Column) -> Column:
        ends = prefix_sums(F.transform(pieces, lambda p: (p["gap"] + F.length(p["hit"])).cast("bigint")))
        whole = F.transform(pieces, lambda p: F.concat(p["tail"], p["hit"]))
        before = bind(whole, lambda w: F.transform(pieces, lambda p, i: F.right(
            F.concat(F.array_join(F.slice(w, F.greatest(i - (CONTEXT_HITS - 1), F.lit(1)), F.least(i, F.lit(CONTEXT_HITS))), ""), p["tail"]), F.lit(CONTEXT_CHARS),
        )))
        hits = F.transform(pieces, lambda p: p["hit"])
        spans = F.filter(F.arrays_zip(hits.alias("hit"), ends.alias("end"), before.alias("before")), lambda s: valid(kind, s["hit"]))

        def scored(s: Column) -> Column:
            score = F.lit(PRIOR[kind]) + F.when(F.lower(s["before"]).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(
                (s["end"] - F.length(s["hit"])).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                F.lit(kind).alias("kind"), F.least(F.lit(1.0), score).alias("score"),
            )

        spans = F.transform(spans, scored)
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= MIN_SCORE)

    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    some = F.transform(F.filter(F.array(hits), lambda h: F.size(h) > 0), located)
    out = F.coalesce(F.get(some, F.lit(0)), empty)
    for needed in NEEDS[kind]:
        out = F.when(F.contains(text, F.lit(needed)), out).otherwise(empty)
    return out


def find_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``pii``: all spans as structs, ordered by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (*BASE, *ADDED)
    parts = [_found(text, kind, i) for i, kind in enumerate(kinds)]
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>")
    return df.withColumn("pii", F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*parts))).otherwise(empty))


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return df.select(
        id_col,
        *[count(kind) for kind in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
