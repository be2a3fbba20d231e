"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

DataFrame functions only. The patterns cannot backtrack over more than one run of characters, and
start only where a run starts (or where the last match ended). What is carried from match to match goes
through blocks of the square root of the number of matches (see fold), so that a text of one kind of
match from end to end takes seconds a megabyte.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. hint: a cheap test that every text with a match passes."""

    name: str
    pattern: str
    hint: str
    score: float
    check: str = ""
    context: str = ""
    base: bool = True


#: Base kinds in the order in which they are listed, then the kinds that the method adds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, context="mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "octets", "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "luhn", "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "digits", "phone|tel|call|mobile|fax"),
    # each head is a match of its own; what follows it, up to 34 characters and the one behind them, is the group
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}[\s\S]?))[A-Z]{2}[0-9]{2}", "", 0.8, "mod97", "iban|account|bank|konto", base=False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])", "", 0.3, context="token|secret|password|api.?key", base=False),
)
#: Characters before a match in which context words count, what they add, and the least score of a span.
WINDOW, CONTEXT_SCORE, THRESHOLD = 30, 0.3, 0.5
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

# Characters of an IBAN by country.
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn check; every second one from the right counts double."""
    d = F.transform(F.split(F.reverse(digits_of(match)), ""), lambda x: x.try_cast("int"))
    each = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's digits, with its first four characters moved to the end and letters as 10 to 35, are 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    values = F.transform(F.filter(moved, lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def iban_length(head: Column) -> Column:
    """Length of the IBAN at the start of a match's group, spaces included; 0 if there is none that passes mod-97.

    Its country says how many characters it has; no letter or digit may follow the last.
    """
    known = F.create_map(*[F.lit(x) for pair in IBAN_CHARS.items() for x in pair])
    shown = F.filter(F.sequence(F.lit(1), F.length(head)), lambda p: F.substring(head, p, F.lit(1)) != " ")
    size = F.get(shown, F.element_at(known, F.substring(head, 1, 2)) - 1)
    ends = ~F.substring(head, size + 1, F.lit(1)).rlike("[A-Za-z0-9]")
    return F.when(size.isNotNull() & ends & mod97(F.substring(head, F.lit(1), size)), size).otherwise(0)


def fold(items: Column, at: int, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array `out` of a fold of items over (at: int, out: array of `kind`), where each step may append.

    Appending copies the array, so it is done in blocks of the square root of the number of items.
    """
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.size(items) - 1, width), lambda i: F.slice(items, i + 1, width))
    block = f"struct<at: int, out: array<{kind}>>"

    def add(done: Column, part: Column) -> Column:
        carried = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(at))
        return F.concat(done, F.array(F.aggregate(part, F.struct(carried.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step)))

    done = F.aggregate(blocks, F.array().cast(f"array<{block}>"), add)
    return F.flatten(F.transform(done, lambda x: x["out"]))


def appended(acc: Column, at: Column, item: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))


def octets(match: Column) -> Column:
    """Whether all four parts are at most 255, leading zeros aside."""
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def confirmed(kind: Kind, match: Column) -> Column:
    n = F.length(digits_of(match))
    return {
        "": F.lit(True),
        "octets": octets(match),
        "luhn": n.between(*CARD_DIGITS) & luhn(match),
        "digits": n.between(*PHONE_DIGITS),
        "mod97": F.length(match) > 4,  # iban_length has tested it
    }[kind.check]


ITEM = "struct<gap: string, hit: string, start: int>"
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"


def with_matches(docs: DataFrame, kind: Kind) -> DataFrame:
    """Adds placed_<kind>, the kind's matches (gap before it, hit, start in code points), and rest_<kind>, the text behind the last.

    Matches and the text between them are cut at the same leftmost matches; null if there are none. The
    hit of an IBAN is its head's group, until iban_length tells how far it goes.
    """
    name, head = kind.name, kind.check == "mod97"
    hinted = F.col("text").contains(kind.hint) if kind.hint else F.lit(True)
    docs = docs.withColumn("__hits", F.when(hinted, F.regexp_extract_all("text", F.lit(kind.pattern), int(head))))
    docs = docs.withColumn("__gaps", F.when(F.size("__hits") > 0, F.split("text", kind.pattern, -1)))
    pairs = F.arrays_zip(F.slice("__gaps", F.lit(1), F.size("__hits")).alias("gap"), F.col("__hits").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        begins = acc["at"] + F.length(x["gap"])
        item = F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), begins.cast("int").alias("start"))
        return appended(acc, begins + (4 if head else F.length(x["hit"])), item)

    docs = docs.withColumn("__pairs", F.when(F.size("__hits") > 0, pairs))
    docs = docs.withColumn(f"placed_{name}", F.when(F.col("__pairs").isNotNull(), fold(F.col("__pairs"), 0, ITEM, step)))
    return docs.withColumn(f"rest_{name}", F.element_at("__gaps", -1)).drop("__hits", "__gaps", "__pairs")


def with_ibans(docs: DataFrame, kind: Kind) -> DataFrame:
    """placed_<kind> with the IBANs as hits in place of groups; the first to start wins, and a head without one is a hit of four characters."""
    name = f"placed_{kind.name}"
    sized = F.transform(name, lambda x: F.struct(x["gap"].alias("gap"), F.substring(x["hit"], F.lit(1), F.greatest(F.lit(4), iban_length(x["hit"]))).alias("hit"), x["start"].alias("start")))

    def step(acc: Column, x: Column) -> Column:
        hit = F.when(x["start"] >= acc["at"], x["hit"]).otherwise(F.substring(x["hit"], 1, 4))
        end = F.when(F.length(hit) > 4, x["start"] + F.length(hit)).otherwise(acc["at"])
        return appended(acc, end, F.struct(x["gap"].alias("gap"), hit.alias("hit"), x["start"].alias("start")))

    docs = docs.withColumn("__sized", sized)
    return docs.withColumn(name, F.when(F.col("__sized").isNotNull(), fold(F.col("__sized"), 0, ITEM, step))).drop("__sized")


def with_confirmed(docs: DataFrame, kind: Kind) -> DataFrame:
    """Adds the columns of with_matches and scores_<kind>: a score for each match, null where the check or the threshold fails."""
    docs = with_matches(docs, kind)
    docs = with_ibans(docs, kind) if kind.check == "mod97" else docs

    def score(x: Column) -> Column:
        near = F.lower(F.right(x["gap"], F.lit(WINDOW)))
        bonus = F.when(near.rlike(rf"\b(?:{kind.context})"), CONTEXT_SCORE).otherwise(0.0) if kind.context else F.lit(0.0)
        total = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.when(confirmed(kind, x["hit"]) & (total >= THRESHOLD), total)

    return docs.withColumn(f"scores_{kind.name}", F.transform(f"placed_{kind.name}", score))


def spans_of(kind: Kind) -> Column:
    """Confirmed spans of a kind, in code points, end exclusive, with scores."""
    both = F.arrays_zip(F.col(f"placed_{kind.name}").alias("m"), F.col(f"scores_{kind.name}").alias("score"))

    def span(x: Column) -> Column:
        end = x["m"]["start"] + F.length(x["m"]["hit"])
        return F.struct(F.lit(kind.name).alias("kind"), x["m"]["start"].alias("start"), end.cast("int").alias("end"), x["score"].alias("score"))

    found = F.transform(F.filter(both, lambda x: x["score"].isNotNull()), span).cast(SPANS)
    return F.coalesce(found, F.array().cast(SPANS))


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text, spans) for each row of docs; spans by kind as listed, then by start.

    A null text counts as empty and is returned as null. Repeated rows give repeated rows.
    """
    out = docs.select("doc_id", "text")
    for kind in kinds:
        out = with_confirmed(out, kind)
    return out.select("doc_id", "text", F.flatten(F.array(*map(spans_of, kinds))).alias("spans"))


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text) with each confirmed match replaced by its kind in brackets, one kind after the other in their order."""
    out = docs.select("doc_id", "text")
    for kind in kinds:
        out = with_confirmed(out, kind)
        both = F.arrays_zip(F.col(f"placed_{kind.name}").alias("m"), F.col(f"scores_{kind.name}").alias("score"))
        label = F.lit(f"[{kind.name.upper()}]")
        if kind.check == "mod97":
            text = without_ibans(both, label, F.col(f"rest_{kind.name}"))
        else:
            pieces = F.transform(both, lambda x: F.concat(x["m"]["gap"], F.when(x["score"].isNotNull(), label).otherwise(x["m"]["hit"])))
            text = F.concat(F.array_join(pieces, ""), F.col(f"rest_{kind.name}"))
        out = out.select("doc_id", F.coalesce(text, "text").alias("text"))
    return out


def without_ibans(both: Column, label: Column, rest: Column) -> Column:
    """The text with confirmed IBANs as labels. What follows a head is the gap before the next, of which an IBAN covers a part or more."""
    gaps = F.transform(both, lambda x: x["m"]["gap"])
    after = F.concat(F.slice(gaps, F.lit(2), F.size(gaps)), F.array(rest))
    items = F.arrays_zip(both.alias("b"), after.alias("after"))

    def step(acc: Column, x: Column) -> Column:
        m = x["b"]["m"]
        taken = x["b"]["score"].isNotNull()
        cut = F.when(taken, F.length(m["hit"])).otherwise(acc["at"])
        part = F.concat(F.substring(m["hit"], 1, 4), x["after"])
        return appended(acc, F.greatest(F.lit(0), cut - F.length(part)), F.concat(F.when(taken, label).otherwise(""), F.substring(part, cut + 1, F.length(part))))

    return F.concat(F.get(gaps, F.lit(0)), F.array_join(fold(items, 0, "string", step), ""))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]

    def count(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
