"""Personal data in texts: proposed by patterns, confirmed by checks, weighed by nearby words.

1. A regular expression for each kind proposes spans: leftmost, not overlapping within the kind.
2. A check of the kind refuses or confirms each: the parts of an address, the number of digits,
   the Luhn sum of a card, mod-97 of an account (IBAN) under its country's length.
3. A span's score is its kind's prior, raised where one of the kind's context words stands
   nearby, within ``NEAR`` characters in the text between it and its neighbours of that kind.

Kinds of the base (email, ip, card, phone) stay whatever their score. The others (iban, ssn,
secret, tel) stay from ``LEAST`` on: an account number by its checksum alone, social security
numbers, secrets and telephone numbers without a country only with a word that names them.

All of it is expressions on one row: no shuffle, so neither skew nor a very long text gathers
anything. Where the matches of a text stand is found from the pieces between them: lengths add up
in blocks, in time linear in text and matches. Patterns are written so that no run of characters
is looked at more than a few times, and groups repeat possessively, which Java walks in a loop.

Defined results: a null text is empty; a text without matches has no spans; positions count code
points; repeated rows, null ids and equal ids each give a row; an empty table gives none; further
columns are ignored.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import once, whole

NEAR = 40
LEAST = 0.5
RAISE = 0.35
BLOCK = 64  # matches whose lengths are added up together

# Length of an account number by country, of those in wide use.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a Luhn sum that ten divides."""

    def add(total: Column, at: Column) -> Column:
        digit = F.ascii(F.substring(digits, F.length(digits) - at + 1, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(at % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """The rest by 97 of an account's capitals and digits, its first four put last."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def of(text: Column) -> Column:
        def add(rest: Column, at: Column) -> Column:
            code = F.ascii(F.substring(text, at, F.lit(1)))
            return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    return once(moved, of)


def _is_card(value: Column) -> Column:
    return once(_digits(value), lambda d: F.when(_between(F.length(d), 16, 19), luhn(d)).otherwise(False))


def _is_address(value: Column) -> Column:
    # a part of many digits may still be small: 007
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    small = lambda p: part(p) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), small)


def _is_account(value: Column) -> Column:
    return mod97(F.regexp_replace(value, "[^A-Z0-9]", "")) == 1


def _is_social(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)|-00-|-0000$")


def _is_mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _accounts() -> str:
    """The pattern of account numbers, countries of one length together."""
    lengths = sorted(set(IBAN_LENGTH.values()))
    of = lambda n: "|".join(c for c, m in IBAN_LENGTH.items() if m == n)
    forms = "|".join(f"(?:{of(n)})[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}" for n in lengths)
    return f"(?<![A-Za-z0-9])(?:{forms})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirms: Callable[[Column], Column] | None
    prior: float
    words: str  # context words, as alternatives
    base: bool = True
    sign: str | None = None  # a character without which there is no match


# The base patterns are those of the contract; where one may start is said first, so that a long
# run is walked once, and \G is where the match before it ended.
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None, 0.65, "e-?mail|mail|contact|write|address", sign="@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_address, 0.5,
        "ip|host|server|address|login",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", _is_card, 0.6,
        "card|credit|debit|visa|mastercard|payment",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda v: _between(F.length(_digits(v)), 8, 15), 0.6,
        "tel|phone|telephone|call|fax|mobile|whatsapp", sign="+",
    ),
    Kind("iban", _accounts(), _is_account, 0.6, "iban|account|bank|transfer|konto|cuenta|compte", False),
    Kind(
        "ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", _is_social, 0.3,
        "ssn|social security", False, "-",
    ),
    Kind(
        "secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+", _is_mixed, 0.3,
        "token|secret|password|passwd|api[ _-]?key|key|bearer", False,
    ),
    Kind(
        "tel",
        r"(?<![0-9().+-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        None, 0.3, "tel|phone|telephone|call|fax|mobile|whatsapp", False,
    ),
]
BASE = [k.name for k in KINDS if k.base]


def _ends(lengths: Column) -> Column:
    """Running sums of an array that is not empty: of blocks first, then within a block."""
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def of(own: Column) -> Column:
        count = F.ceil(F.size(own) / BLOCK).cast("int")
        blocks = F.transform(upto(count), lambda b: total(F.slice(own, b * BLOCK + 1, F.lit(BLOCK))))

        def within(sums: Column) -> Column:
            starts = F.transform(upto(count), lambda b: total(F.slice(sums, F.lit(1), b)))
            return once(
                starts,
                lambda at: F.transform(
                    upto(F.size(own)),
                    lambda i: F.get(at, F.floor(i / BLOCK).cast("int"))
                    + total(F.slice(own, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)),
                ),
            )

        return once(blocks, within)

    return once(lengths, of)


SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double,base:boolean>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """The spans of one kind in a text, in order."""
    none = F.array().cast(SPANS)
    near = f"(?i)(?<![\\p{{L}}0-9])(?:{kind.words})(?![\\p{{L}}0-9])"

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            n = F.size(found)
            lengths = F.zip_with(F.slice(gaps, F.lit(1), n), found, lambda g, m: F.length(g) + F.length(m))

            def span(value: Column, i: Column, ends: Column) -> Column:
                end = F.get(ends, i)
                here = F.substring(F.get(gaps, i), -NEAR, NEAR)
                after = F.substring(F.get(gaps, i + 1), 1, NEAR)
                close = here.rlike(near) | after.rlike(near)
                return F.struct(
                    F.lit(kind.name).alias("kind"),
                    (end - F.length(value)).alias("start"),
                    end.alias("end"),
                    value.alias("value"),
                    (F.lit(kind.prior) + F.when(close, RAISE).otherwise(0.0)).alias("score"),
                    F.lit(kind.base).alias("base"),
                )

            made = once(_ends(lengths), lambda ends: F.transform(found, lambda m, i: span(m, i, ends)))
            kept = made
            if kind.confirms:
                kept = F.filter(kept, lambda s: kind.confirms(s["value"]))
            return kept if kind.base else F.filter(kept, lambda s: s["score"] >= LEAST)

        return F.when(F.size(found) == 0, none).otherwise(once(F.split(text, kind.pattern), with_gaps))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = once(found, placed)
    return F.when(F.contains(text, F.lit(kind.sign)), spans).otherwise(none) if kind.sign else spans


def personal_data(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """``doc_id, spans`` of each row of ``docs`` (doc_id, text).

    A span is ``kind, start, end, value, score, base``, in code points, the end exclusive; spans
    come by kind as in ``KINDS``, then by start. ``with_row`` adds the whole row as ``row``.
    """
    found = F.concat(*(spans_of(F.col("_text"), kind) for kind in KINDS))
    rest = [F.struct(*docs.columns).alias("row")] if with_row else []
    rows = docs.select("doc_id", *rest, whole().alias("_text"))
    return rows.select("doc_id", *(["row"] if with_row else []), found.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from ``personal_data``."""

    def joined(spans: Column) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(shown, ",")

    def count(kind: str) -> Column:
        own = F.filter("spans", lambda s: s["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(kind) for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
