"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Only DataFrame functions. A regular expression with two groups, the gap since the last match and
the match itself, gives every match with its place: places are running sums of lengths, in code
points. Each kind is searched only in texts that hold a character it needs.

Kinds: e-mail addresses; IPv4 addresses, with parts of at most 255; card numbers that pass Luhn;
international phone numbers. The method adds IBANs that pass modulo 97, and social security
numbers where a context word stands near. Every span has a score, raised by context words in the
``NEAR`` code points before it; added kinds need ``ENOUGH``, the first four always stay. The
context of a match is the end of its gap and, if the gap is shorter, of the few pieces before.

Work grows with the length of a text: patterns use possessive repeats and start only where a run
of their characters starts or the last match ended, running sums are taken over arrays of ``RUN``
numbers and then over the sums of those, and a span is cut out of the ``CUT`` code points around
it, never from the start of the text.

Defined results: a null or empty text has no span; a very long text is searched whole; repeated
rows are searched each alone; spans of different kinds may overlap, and ``redacted`` then replaces
their union by the first one's mark; an empty table gives no rows; ``add_spans`` keeps all other
columns, and refuses a name for its own that the table already has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, whole_text

NEAR = 40
#: Length of the arrays over which running sums are taken directly.
RUN = 256
CUT = 2048
ENOUGH = 0.6
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?:\\G|(?<![0-9]))[0-9](?:[\\x20-]?[0-9]){13,}+",  # shorter runs never pass
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": "e-?mail|mail to|contact|write to|correo|courriel",
    "ip": "\\bip\\b|address|server|host|login|client",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|whatsapp",
    "iban": "iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}
#: Score of a confirmed span without context, and what context adds.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
LIFT = 0.3

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_FOUND = "array<struct<start:long,end:long,found:string,before:string>>"
#: Pieces before a gap that are looked at for context: NEAR code points of the shortest matches.
_BACK = 8


def running(values: Column, zero: Column, step, kind: str = "long") -> Column:
    """For each value what ``step`` has made of those before it, starting from ``zero``.

    Appending to an array copies it, so that is done for RUN values, and for every RUN-th.
    """
    empty = F.array().cast(f"array<{kind}>")

    def walk(some: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), empty.alias("out"))
        add = lambda acc, x: F.struct(step(acc["at"], x).cast(kind).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(some, start, add, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int")), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))
        ends = F.transform(runs, lambda r: F.aggregate(r, zero, lambda at, x: step(at, x).cast(kind)))
        # what a run starts from: all values of the runs before it, in one step each
        return F.flatten(F.zip_with(runs, walk(ends, zero), walk))

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(values), whole), F.lit(0))).otherwise(empty)


def _needs(kind: str, text: Column) -> Column:
    digit = text.rlike("[0-9]")
    return {
        "email": text.contains("@"),
        "ip": text.rlike("[0-9]\\.[0-9]"),
        "card": text.rlike("[0-9](?:[\\x20-]?[0-9]){13}"),
        "phone": text.contains("+") & digit,
        "iban": text.rlike("[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike("[0-9]{3}-[0-9]{2}-"),
    }[kind]


def located(text: Column, kind: str) -> Column:
    """Every match with its place and the context before it: ``array<struct<start, end, found, before>>``."""
    pattern = F.lit(f"\\G((?s:.*?))({PATTERNS[kind]})")
    gaps, matches = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("found"))

    def place(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda x: (F.length(x["gap"]) + F.length(x["found"])).cast("long"))
        ends = running(sizes, F.lit(0).cast("long"), lambda at, n: at + n)  # of the match before
        # ends of the pieces before, each with its match; only a short gap needs them
        tails = F.transform(pairs, lambda x: F.concat(F.right(x["gap"], F.lit(NEAR)), F.right(x["found"], F.lit(NEAR))))
        rows = F.arrays_zip(pairs.alias("x"), ends.alias("at"))

        def one(row: Column, tails: Column, i: Column) -> Column:
            gap, found = row["x"]["gap"], row["x"]["found"]
            start = row["at"] + F.length(gap)
            back = F.concat(*[F.coalesce(F.get(tails, i - k), F.lit("")) for k in range(_BACK, 0, -1)])
            before = F.when(F.length(gap) >= NEAR, F.right(gap, F.lit(NEAR))).otherwise(F.right(F.concat(back, gap), F.lit(NEAR)))
            return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), found.alias("found"), before.alias("before"))

        return F.get(F.transform(F.array(tails), lambda t: F.transform(rows, lambda row, i: one(row, t, i))), F.lit(0))

    none = F.array().cast(_FOUND)
    return F.when(_needs(kind, text), F.get(F.transform(F.array(pairs), place), F.lit(0))).otherwise(none)


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    value = lambda i: F.when(i % 2 == 1, F.substr(back, i, F.lit(1))).otherwise(F.substr(twice, i, F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$")
    if kind == "card":
        digits = F.regexp_replace(found, "[\\x20-]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(found, F.lit(" "), F.lit(""))).between(15, 34), mod97(found)).otherwise(F.lit(False))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans, scored: ``array<struct<start, kind_no, end, kind, score>>``."""
    number = KINDS.index(kind)

    def scored(x: Column) -> Column:
        score = F.lit(SCORE[kind]) + F.when(F.lower(x["before"]).rlike(CONTEXT[kind]), LIFT).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(F.filter(located(text, kind), lambda x: confirmed(kind, x["found"])), scored)
    return out if number < BASE else F.filter(out, lambda x: x["score"] >= ENOUGH)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def add_spans(documents: DataFrame, column: str = "text", name: str = "pii_spans") -> DataFrame:
    """``documents`` with its spans by start, then kind, in a column of its own."""
    if name in documents.columns:
        raise ValueError(f"the table has a column {name!r}; give another name")
    text = whole_text(documents, column)
    return documents.withColumn(name, F.array_sort(F.concat(*[spans_of(text, k) for k in KINDS])))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or union of overlapping spans, replaced by its kind's mark."""

    def clean(pieces: Column, spans: Column) -> Column:
        reached = running(F.transform(spans, lambda x: x["end"]), F.lit(0).cast("long"), lambda at, end: F.greatest(at, end))
        fresh = F.filter(F.arrays_zip(spans.alias("x"), reached.alias("from")), lambda r: r["x"]["start"] >= r["from"])

        def cut(a: Column, b: Column) -> Column:
            """Code points a to b, from the pieces that hold them."""
            first = F.floor(a / CUT).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(b / CUT).cast("int") - first + 1), "")
            return F.substr(some, (a - first * CUT + 1).cast("int"), (b - a).cast("int"))

        marked = F.transform(fresh, lambda r: F.concat(cut(r["from"], r["x"]["start"]), F.lit("["), F.upper(r["x"]["kind"]), F.lit("]")))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        length = F.aggregate(pieces, F.lit(0).cast("long"), lambda n, p: n + F.length(p))
        return F.concat(F.array_join(marked, ""), cut(last, length))

    def within(pieces: Column) -> Column:
        return F.get(F.transform(F.array(spans), lambda s: clean(pieces, s)), F.lit(0))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(pieces), within), F.lit(0))).otherwise(text)


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = add_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda x: x["kind_no"] < BASE)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(F.filter(spans, _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
        F.array_join(F.transform(spans, lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"),
    )
