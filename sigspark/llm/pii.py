"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

DataFrame functions only. A kind's matches come from `regexp_extract_all` and the text between them from `split` by the
same pattern, so positions are running sums of lengths and the context of a match is at hand without searching again.
Patterns are written without backtracking (possessive, with look-behind where a match can only start at the beginning of
a run), so very long runs cost linear time; they match exactly what the plain patterns of the contract match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: kinds in the order of results; the first four are always reported once their validator accepts
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = KINDS[:4]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: cheap tests that every text with a match passes
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

#: score of a confirmed match before its context is read, and words that raise or lower it
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
FOR = {
    "email": "mail|contact|write", "ip": "ip|host|server|address|login", "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security|taxpayer",
    "secret": "token|secret|api|key|password|passwd|bearer|auth",
}
AGAINST = "version|isbn|order|serial|example|invoice|build"
CONTEXT = 40
SHIFT = 0.3
THRESHOLD = 0.5
#: elements summed in one inner pass of `running`
STEP = 128


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once; inside another lambda a plain expression would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Exclusive running sums of an array, in steps, so that long arrays do not cost their square."""
    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def inside(part: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(part, zero, step)["out"]

    def sums(blocks: Column) -> Column:
        starts = inside(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(blocks, starts, inside))

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda b: F.slice(x, b * STEP + 1, F.lit(STEP)))

    return let(lengths, lambda x: F.when(F.size(x) > 0, let(cut(x), sums)).otherwise(F.array().cast("array<long>")))


def digits(s: Column) -> Column:
    return F.translate(s, " -().+", "")


def luhn(d: Column) -> Column:
    """Does a string of 13 to 19 digits carry a valid check digit?"""
    r = F.reverse(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + _luhn_digit(F.substring(r, i, F.lit(1)).cast("int"), i))
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def _luhn_digit(x: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)


def mod97(s: Column) -> Column:
    """ISO 7064 check of an account number: country and check digits behind, letters as 10 to 35, remainder 1."""
    c = F.translate(s, " ", "")
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def add(a: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v < 65, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.when(F.length(c).between(15, 34), F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(add(a, ch))) == 1).otherwise(False)


def _octet(part: Column) -> Column:
    p = F.ltrim(part, F.lit("0"))
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


CONFIRM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": lambda m: luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
    "iban": mod97,
    # no word: letters, digits and many different ones of both
    "secret": lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10),
    "ssn": lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"),
}

SPAN = "array<struct<kind:string,start:long,end:long,value:string,score:double>>"


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind, in order."""
    rx = PATTERNS[kind]

    def span(x: Column) -> Column:
        m, start = x["m"], x["at"] + F.length(x["before"])
        if kind in BASE:  # the score of these decides nothing: the gaps to the next matches will do
            around = F.concat(F.right(x["before"], F.lit(CONTEXT)), F.lit(" "), F.left(x["after"], F.lit(CONTEXT)))
        else:
            around = F.concat(F.substring(text, F.greatest(start - CONTEXT, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT)).cast("int")), F.lit(" "),
                              F.substring(text, (start + F.length(m)).cast("int") + 1, F.lit(CONTEXT)))
        near = F.lower(around)
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{FOR[kind]})"), SHIFT).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{AGAINST})"), SHIFT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), m.alias("value"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))

    def spans(found: Column, gaps: Column) -> Column:
        at = running(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)))
        parts = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found)).alias("after"), at.alias("at"))
        parts = parts.cast("array<struct<m:string,before:string,after:string,at:bigint>>")
        ok = F.transform(F.filter(parts, lambda x: CONFIRM[kind](x["m"])), span)
        return ok if kind in BASE else F.filter(ok, lambda s: s["score"] >= THRESHOLD)

    may = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    found, gaps = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    none = F.array().cast(SPAN)
    body = let(found, lambda f: F.when(F.size(f) > 0, let(gaps, lambda g: spans(f, g)).cast(SPAN)).otherwise(none))
    return F.when(may, body).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    Input: doc_id, text; other columns are ignored. Output per input row: doc_id, spans: array of (kind, start, end, value,
    score), positions in code points with the end exclusive, by kind in the order of `KINDS`, then start. Spans of email,
    ip, card and phone are reported whenever their validator accepts, whatever the score; of iban, ssn and secret when the score is
    at least `THRESHOLD`, with the words within 40 characters on either side, other matches included. Null text is empty and has no spans; repeated rows give repeated results; an empty table gives an
    empty result.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"))
    x = x.select("doc_id", *[kind_spans(F.col("text"), k).alias(k) for k in KINDS])
    return x.select("doc_id", F.concat(*KINDS).alias("spans"))


def of_kinds(spans: str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
