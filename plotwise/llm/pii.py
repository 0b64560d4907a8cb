"""Personal data: expressions propose spans, checksums confirm them, nearby context words adjust the score.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.llm.common import at, id_and_text, placed


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """ISO 7064 check of an IBAN: the first four characters go last, A is 10 to Z is 35, the number leaves 1 over 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c <= "9", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    gate: a cheap expression over the text that must hold for a match. pattern: proposes spans; possessive, so
    long runs cost linear time. confirm: the checksum or size test. base: confirmed spans always stay. Others
    need ``score``, raised by ``context`` if one of its words stands near, to reach the threshold.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    base: bool = True
    score: float = 0.9
    context: tuple[str, ...] = ()


def _has(part: str) -> Callable[[Column], Column]:
    return lambda text: text.contains(part)


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(least, most)


#: Characters of an IBAN by country; one of another country, or of another length, is read as far as it goes, 15 to 34.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_OF_COUNTRY = "|".join(f"(?:{names})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])" for length, names in _IBANS.items())

# A start inside a run of the same class is ruled out, unless the last match ended there (\G): the leftmost match
# starts at the run's first character anyway, and each run is read once.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _has("@"), lambda m: F.lit(True), context=("mail", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _matches(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"), context=("ip", "address", "host")),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])", _matches(r"[0-9](?:[ -]?[0-9]){13}"), luhn, score=1.0, context=("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _matches(r"\+[0-9]"), _between(10, 15), context=("phone", "tel", "call")),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))", _matches(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), mod97, base=False, score=0.9, context=("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _matches(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), base=False, score=0.4, context=("ssn", "social security")),
    Kind("local_phone", r"(?<![0-9+().-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", _matches(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), lambda m: F.lit(True), base=False, score=0.4, context=("phone", "tel", "call", "mobile", "fax")),
)

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
_BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints, the fold (from 0) of those before it.

    Blocks of ``_BLOCK`` are folded first, so nothing grows inside a fold: n values cost about n * _BLOCK / 2
    and (n / _BLOCK)^2 / 2 steps.
    """
    zero = F.lit(0)

    def of(v: Column) -> Column:
        numbers = F.sequence(zero, F.shiftright(F.size(v) - 1, _BLOCK.bit_length() - 1))
        part = lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))
        sums = F.transform(numbers, lambda b: F.aggregate(part(b), zero, fold))
        starts = lambda s: F.transform(numbers, lambda b: F.aggregate(F.slice(s, F.lit(1), b), zero, fold))
        inner = lambda own, first: F.transform(own, lambda _, i: F.aggregate(F.slice(own, F.lit(1), i), first, fold))
        return _let(sums, lambda s: F.flatten(F.transform(F.arrays_zip(numbers.alias("b"), starts(s).alias("first")), lambda z: _let(part(z["b"]), lambda own: inner(own, z["first"])))))

    return F.when(F.size(values) > 0, _let(values, of)).otherwise(F.array().cast("array<int>"))


def _spans_of(rank: int, kind: Kind, threshold: float, near: int) -> Column:
    """The spans of one kind that hold, from its matches and what stands between them."""
    found, between = F.col(f"found_{kind.name}"), F.col(f"between_{kind.name}")
    sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))

    def span(m: Column, i: Column, before: Column) -> Column:
        gap, after = F.get(between, i), F.get(between, i + 1)
        around = F.lower(F.concat_ws(" ", F.substring(gap, -near, near), F.substring(after, 1, near)))
        close = around.rlike("(?<![a-z])(?:" + "|".join(kind.context) + ")") if kind.context else F.lit(False)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(close, 0.4).otherwise(0.0))
        start = F.get(before, i) + F.length(gap)
        row = lambda s: F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m)).cast("int").alias("end"), s.alias("score"))
        return F.when(kind.confirm(m), _let(score, lambda s: F.when(F.lit(kind.base) | (s >= threshold), row(s))))

    held = _let(_before(sizes, lambda a, b: a + b), lambda before: F.filter(F.transform(found, lambda m, i: span(m, i, before)), lambda s: s.isNotNull()))
    return F.when(F.size(found) > 0, held.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _with_spans(rows: DataFrame, text: Column, kinds: tuple[Kind, ...], threshold: float, near: int) -> DataFrame:
    """Rows of ``placed`` columns with pii_text and pii_spans."""
    own = [F.col(c) for c in rows.columns]
    first = []
    for kind in kinds:
        hit = kind.gate(F.col("pii_text"))
        first += [
            F.when(hit, F.regexp_extract_all("pii_text", F.lit(kind.pattern), F.lit(0))).alias(f"found_{kind.name}"),
            F.when(hit, F.split("pii_text", kind.pattern, -1)).alias(f"between_{kind.name}"),
        ]
    staged = rows.select(*own, F.coalesce(text.cast("string"), F.lit("")).alias("pii_text")).select(*own, "pii_text", *first)
    return staged.select(*own, "pii_text", F.array_sort(F.concat(*[_spans_of(rank, kind, threshold, near) for rank, kind in enumerate(kinds)])).alias("pii_spans"))


def find_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.7, near: int = 40) -> DataFrame:
    """The columns of ``docs`` and ``pii_spans``: array of (start, rank, kind, end, score), sorted, one narrow pass.

    Spans are in code points, end exclusive, of the text with null as empty; each kind's are leftmost and don't
    overlap, those of two kinds may. Matches between parts: split() gives what stands between the matches, so
    running lengths give the places. A context word within ``near`` characters before or after, up to the next
    match of the kind, adds 0.4 to a score, to 1 at most. Null and empty texts have no spans; very long texts cost
    about as much a span as short ones; repeated rows are read each; an empty table gives an empty result; other
    columns stay as they are, whatever their names, but that one called pii_spans is replaced.
    """
    rows = _with_spans(placed(docs), at(docs, text_col), kinds, threshold, near)
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != "pii_spans"], "pii_spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(spans: Column, names: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(names))


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and scores (one a span, in percent) of every document.

    Null and empty texts have no spans and the hash of nothing; a null id stays null; repeated rows come out each; an
    empty table gives an empty result; other columns are ignored.
    """
    spans = F.col("pii_spans")
    base = [k.name for k in kinds if k.base]
    return find_spans(id_and_text(docs, id_col, text_col), kinds=kinds).select(
        "doc_id",
        *[F.size(_of(spans, [n])).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(joined(_of(spans, base)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )


_PAGE = 4096


def _stretch(pages: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text in pages; reaching a page costs the same wherever it lies."""
    bits, rest = _PAGE.bit_length() - 1, _PAGE - 1
    i, j = F.shiftright(a, bits), F.shiftright(b, bits)
    head = F.substring(F.get(pages, i), a.bitwiseAND(rest) + 1, F.lit(_PAGE))
    tail = F.substring(F.coalesce(F.get(pages, j), F.lit("")), F.lit(1), b.bitwiseAND(rest))
    within = F.substring(F.get(pages, i), a.bitwiseAND(rest) + 1, b - a)
    return F.when(b <= a, F.lit("")).when(i == j, within).otherwise(F.concat(head, F.array_join(F.slice(pages, i + 2, j - i - 1), ""), tail))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; spans that overlap become one.

    Null texts stay null and texts without spans as they are; very long texts are read in pages; repeated rows come
    out each; an empty table gives an empty result; other columns stay as they are, whatever their names.
    """
    found = _with_spans(placed(docs), at(docs, text_col), KINDS, 0.7, 40)
    spans, pages = F.col("pii_spans"), F.col("pii_pages")
    # A span counts if it begins where all before it have ended; what stands between is kept.
    reach = _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    piece = lambda s, before: F.when(s["start"] >= before, F.concat(_stretch(pages, before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
    clean = F.concat(
        F.array_join(_let(reach, lambda before: F.transform(spans, lambda s, i: piece(s, F.get(before, i)))), ""),
        _stretch(pages, F.array_max(F.transform(spans, lambda s: s["end"])), F.length("pii_text")),
    )
    hit = F.size("pii_spans") > 0
    paged = found.withColumn("pii_pages", F.when(hit, F.regexp_extract_all("pii_text", F.lit(f"(?s).{{1,{_PAGE}}}"), F.lit(0))))
    at_text = docs.columns.index(text_col)
    return paged.select(*[F.when(hit, clean).otherwise(F.col(f"_{i}").cast("string")).alias(c) if i == at_text else F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
