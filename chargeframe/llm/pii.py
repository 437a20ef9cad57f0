"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksum and range validators confirm them, and words nearby raise or lower
their score. Four kinds are kept whenever their validator agrees (email, ip, card, phone). The others
(iban, ssn, call, mail) are kept from a score on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeframe.llm.textspans import SPAN, fold, located, matches

#: Characters looked at before and after a span, up to the neighbouring span of its kind.
BEFORE, AFTER = 48, 24
#: What a word nearby adds to the score where it stands before and after the span, and what a word before takes from it.
RAISE, RAISE_AFTER, LOWER = 30, 15, 30
#: Least score (of 100) of a span of an added kind.
THRESHOLD = 50

_EMAIL_HEAD = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"

#: Lengths of account numbers and the countries that use them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
#: Networks that are no person's address (private, loopback, link-local, test, multicast).
RESERVED = r"^0*(?:10|127)\.|^0*192\.0*168\.|^0*169\.0*254\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.|^0*(?:0|22[4-9]|2[3-5][0-9])\."


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(hit: Column) -> Column:
    """14 to 19 digits with a valid check digit."""
    own = _digits(hit)
    return F.length(own).between(14, 19) & F.call_function("luhn_check", own)


def mod97(hit: Column) -> Column:
    """The number with its first four characters at the end, letters as 10 to 35, leaves 1 modulo 97."""
    own = F.regexp_replace(hit, " ", "")
    codes = F.transform(F.split(F.concat(F.substring(own, 5, 64), F.substring(own, 1, 4)), ""), lambda c: F.ascii(c))
    rest = F.aggregate(codes, F.lit(0), lambda r, c: F.when(c.between(48, 57), (r * 10 + c - 48) % 97)
                       .when(c.between(65, 90), (r * 100 + c - 55) % 97).otherwise(r))
    return rest == 1


def _n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda hit: F.length(_digits(hit)).between(low, high)


def _always(hit: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    """A proposal's pattern, a cheap pattern that every text with one matches, the validator, the
    score of a confirmed span, words that raise or lower it, and a pattern of spans that are worth less."""

    name: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column]
    score: int
    raised: str
    lowered: str = r"(?!)"
    weak: str = r"(?!)"


def _iban_pattern() -> str:
    ways = [rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(ways)})(?![A-Za-z0-9])"


_PHONE_WORDS = r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|mobil|tel[ée]fono|m[óo]vil|t[ée]l[ée]phone|portable)\b"
_COUNT_WORDS = r"(?i)\b(?:order|invoice|item|part|isbn|sku|version|serial|ref|ticket|bestellung|rechnung|pedido|factura|commande|facture)\b"

#: Kinds in the order that breaks ties between spans; the first BASE are kept whatever their score.
KINDS = [
    Kind("email", _EMAIL_HEAD + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _always, 70,
         r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b", r"(?i)\b(?:example|noreply|no-reply)\b",
         r"(?i)^(?:no-?reply|postmaster|mailer-daemon)@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", _octets, 50,
         r"(?i)\b(?:ip|address|host|server|client|login|adresse|direcci[óo]n)\b", r"(?i)\b(?:version|release|section|v)\b", RESERVED),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", luhn, 60,
         r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|pay|karte|kreditkarte|tarjeta|carte)\b", _COUNT_WORDS),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]", _n_digits(10, 15), 60, _PHONE_WORDS, _COUNT_WORDS),
    Kind("iban", _iban_pattern(), r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", mod97, 80, r"(?i)\b(?:iban|account|konto|cuenta|compte|bank|banco|banque)\b"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _always, 30,
         r"(?i)\b(?:ssn|social\x20security|tax\x20id|taxpayer)\b", _COUNT_WORDS),
    Kind("call", r"(?<![A-Za-z0-9+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,8}){1,4}(?![A-Za-z0-9])", r"[0-9][\x20).][\x20./-]?[0-9]{2}|[0-9][/-][0-9]{2}",
         _n_digits(8, 13), 30, _PHONE_WORDS, _COUNT_WORDS),
    Kind("mail", _EMAIL_HEAD + r"\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)++",
         r"[\[(](?i:at)[\])]", _always, 60, r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b"),
]
BASE = 4


def _spans_of(text: Column, number: int) -> Column:
    kind = KINDS[number]

    def score(m: Column) -> Column:
        points = (F.lit(kind.score)
                  + F.when(m["before"].rlike(kind.raised), RAISE).when(m["after"].rlike(kind.raised), RAISE_AFTER).otherwise(0)
                  - F.when(m["before"].rlike(kind.lowered) | m["hit"].rlike(kind.weak), LOWER).otherwise(0))
        return F.when(kind.valid(m["hit"]), F.greatest(F.lit(0), F.least(F.lit(100), points)))

    spans = located(matches(text, kind.pattern, BEFORE, AFTER), score, number)
    return F.when(text.rlike(kind.hint), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _with_spans(rows: DataFrame, text: str, threshold: int) -> DataFrame:
    """Adds __base (the first kinds) and __spans (all that are kept), both by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    for number in range(len(KINDS)):
        rows = rows.withColumn(f"__k{number}", _spans_of(whole, number))
    base = F.array_sort(F.concat(*(F.col(f"__k{n}") for n in range(BASE))))
    more = F.filter(F.concat(*(F.col(f"__k{n}") for n in range(BASE, len(KINDS)))), lambda s: s["score"] >= threshold)
    rows = rows.withColumn("__base", base).withColumn("__more", more)

    def step(reach: Column, s: Column):
        first = s["kind"] < BASE
        return F.when(first, F.greatest(reach, s["end"])).otherwise(reach), first | (s["end"] > reach), s

    # a span of an added kind goes where one of the first kinds covers it; of equal starts the wider comes first here
    ordered = F.array_sort(F.concat("__base", "__more"), lambda a, b: F.coalesce(
        F.nullif(a["start"] - b["start"], F.lit(0)), F.nullif(b["end"] - a["end"], F.lit(0)), a["kind"] - b["kind"]))
    kept = F.when(F.size("__more") == 0, F.col("__base")).otherwise(F.array_sort(fold(ordered, F.lit(0), SPAN, step)))
    return rows.withColumn("__spans", kept).drop("__more", *(f"__k{n}" for n in range(len(KINDS))))


def _written(spans: str) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of these spans), spans (kind:start:end, code
    points, by start, then kind), scores (of the spans, 0 to 100), n_iban, n_ssn, n_call and n_mail. Null and empty
    texts have no span. Rows are judged one by one: repeated rows and null ids each give a row, an empty table
    none; other columns are ignored. The patterns never scan a run of characters twice, so long texts cost in
    proportion to their length.
    """
    found = _with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), "text", threshold)
    counts = [_count("__base" if k < BASE else "__spans", k).alias(f"n_{kind.name}") for k, kind in enumerate(KINDS)]
    scores = F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *counts[:BASE], F.sha2(_written("__base"), 256).alias("base_sha256"),
                        _written("__spans").alias("spans"), scores.alias("scores"), *counts[BASE:])


def redact(docs: DataFrame, threshold: int = THRESHOLD, least: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every span of at least the score ``least`` replaced by its kind in brackets, overlapping ones by
    the first. All columns are kept; texts without a span, nulls included, stay as they are."""
    found = _with_spans(docs, text, threshold).withColumn("__spans", F.filter("__spans", lambda s: s["score"] >= least))
    names = F.array(*(F.lit(f"[{k.name}]") for k in KINDS))
    whole, end = F.col(text), F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("end"), F.lit(0).alias("score"))

    def step(at: Column, s: Column):
        seen = F.substring(whole, at + 1, F.greatest(F.lit(0), s["start"] - at))
        mark = F.when((s["kind"] >= 0) & (s["start"] >= at), F.get(names, s["kind"])).otherwise("")
        return F.greatest(at, s["end"]), F.lit(True), F.concat(seen, mark)

    done = F.array_join(fold(F.concat("__spans", F.array(end)), F.lit(0), "string", step), "")
    out = found.withColumn(text, F.when(F.size("__spans") > 0, done).otherwise(whole))
    return out.select(*docs.columns)
