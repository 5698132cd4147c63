"""Personal data in texts: proposed by patterns, confirmed by check digits,
scored by the words nearby.

A kind has a pattern that proposes spans, a check that a match must pass, and
context words. A confirmed match starts from the kind's score; a context word
shortly before it, and after the kind's match before, raises that. Matches are leftmost and do not overlap within a
kind; one that fails its check is dropped and its text not tried again.

At scale: one map-only pass of DataFrame functions, with no shuffle. The
patterns read a text in linear time: runs are taken possessively and matches
begin only where a run begins, which gives the same matches as the plain form in
each kind's comment. Offsets are code points, summed from the pieces between
matches in blocks, so a text with many matches costs little more each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

CONTEXT_CHARS = 48
KEPT_FROM = 0.5
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Every second digit from the right counts double, less 9 from 10 on."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    chars = F.regexp_extract_all(F.reverse(digits(s)), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod_97(s: Column) -> Column:
    """The rest by 97 with the first four signs last and letters as 10..35 is 1."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0))
    def step(a: Column, c: Column) -> Column:
        letter = c >= "A"
        return (a * F.when(letter, 100).otherwise(10) + F.ascii(c) - F.when(letter, 55).otherwise(48)) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda s: F.length(digits(s)).between(low, high)


def small_parts(s: Column) -> Column:
    return F.forall(F.split(s, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).cast("int") * 1000
                    + F.coalesce(F.try_to_number(F.right(F.concat(F.lit("00"), p), F.lit(3)), F.lit("999")).cast("int"), F.lit(0))
                    <= 3255)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column] | None
    score: float
    context: tuple[str, ...]
    #: A text without this has no match.
    needs: str | None = None


# The base kinds' patterns (plain form in the comment), then more
# kinds; context words with them.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None,
         0.9, ("mail", "contact", "write to"), "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_parts,
         0.6, ("ip", "address", "host", "server", "login"), "."),
    # [0-9]([\x20-]?[0-9])+, 13 to 19 digits that pass Luhn
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){12})(?![0-9](?:[\x20-]?[0-9]){19})"
                 r"[0-9]++(?:[\x20-][0-9]++)*+", luhn,
         0.8, ("card", "visa", "credit", "payment", "account")),
    # \+[0-9][\x20().0-9-]+[0-9], 9 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", between(9, 15),
         0.6, ("tel", "phone", "call", "mobile", "fax"), "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod_97,
         0.9, ("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None,
         0.3, ("ssn", "social security", "insurance number"), "-"),
)

BASE_KINDS = ("email", "ip", "card", "phone")


def starts(lengths: Column) -> Column:
    """The sum of all entries before each entry."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def offsets(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")),
                             lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(F.transform(blocks, lambda b: F.struct(b.alias("of"), total(b).alias("sum"))), lambda bs: F.flatten(
            F.transform(bs, lambda b, i: let(
                F.aggregate(F.slice(bs, F.lit(1), i), F.lit(0), lambda s, x: s + x["sum"]),
                lambda base: F.transform(b["of"], lambda _, j: base + total(F.slice(b["of"], F.lit(1), j)))))))
    return let(lengths, offsets)


_SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def spans(text: Column, kind: Kind) -> Column:
    """The spans of one kind in a text that is not null."""
    none = F.from_json(F.lit("[]"), _SPANS)
    near = "(?i)\\b(?:" + "|".join(kind.context) + ")"

    def found(matches: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        pairs = F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"))

        def place(ps: Column) -> Column:
            at = starts(F.transform(ps, lambda p: F.length(p["g"]) + F.length(p["m"])))

            def span(p: Column, a: Column) -> Column:
                begin = a + F.length(p["g"])
                score = F.lit(kind.score) + F.when(
                    F.right(p["g"], F.lit(CONTEXT_CHARS)).rlike(near), (1 - kind.score) * 0.6).otherwise(0.0)
                ok = kind.check(p["m"]) if kind.check else F.lit(True)
                return F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"),
                                (begin + F.length(p["m"])).alias("end"), p["m"].alias("text"),
                                F.when(ok, score).alias("score"))
            return F.zip_with(ps, at, span)

        made = let(pairs, place)
        keep = 0.0 if kind.name in BASE_KINDS else KEPT_FROM
        return F.when(F.size(matches) == 0, none).otherwise(
            F.filter(made, lambda s: s["score"].isNotNull() & (s["score"] >= keep)).cast(_SPANS))

    all_matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    made = let(all_matches, found)
    return F.when(F.contains(text, F.lit(kind.needs)), made).otherwise(none) if kind.needs else made


def find_private(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_column: str = "text",
                 out: str = "private_spans") -> DataFrame:
    """``docs`` and an array ``out`` of spans (kind, start, end, text, score) by
    kind as listed, then start; ends are exclusive, both in code points.

    Null and empty texts have no spans. Every row keeps its own result, repeated
    rows and null ids too; an empty table stays empty. A column of the name
    ``out`` is replaced; all others stay as they are.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return docs.withColumn(out, F.concat(*[spans(text, k) for k in kinds]))


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
