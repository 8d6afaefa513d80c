"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, number ranges
and digit counts elsewhere), and context words shortly before a span adjust its score.  Each pattern
starts only where a match can start and has no nested repetition that backtracks, so texts of any length
are scanned in linear time and constant stack.

Null texts have no spans; an empty table gives no rows; other columns and repeated rows pass through.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind -> pattern.  ``\G`` lets a match start right behind the previous one.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11})",  # where one may start; _ibans finds the end
    "national_phone": r"(?<![A-Za-z0-9+)-])\(?[0-9]{2,5}\)?(?:[ /-][0-9]{2,8}){1,4}+(?![0-9-])",
}
ORDER = [*BASE, *ADDED]
#: What every match of a kind holds; texts without it are not scanned.
LIKELY = {"ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": "[0-9]{2}", "national_phone": "[0-9]{2}"}
#: Characters of an IBAN by country (registry and those in use beside it); other codes may have 15 to 34.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
#: Score of a confirmed span, and what a context word within ``WINDOW`` code points before it adds.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_phone": 0.3}
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel", "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|carte|karte|tarjeta|credit", "phone": "phone|call|tel|fax|mobile|appel",
    "iban": "iban|account|konto|compte|cuenta|bank", "national_phone": "phone|call|tel|fax|mobile|appel",
}
WINDOW, CONTEXT_BONUS, KEEP = 40, 0.2, 0.5


#: Elements a scan appends one by one before they become a block, and code points of a piece of text.
BLOCK, CHUNK = 256, 64
FOUND = "struct<start:bigint,end:bigint,kind:string,rank:int,found:string>"
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"


def _empty(of: str) -> Column:
    return F.expr(f"cast(array() as array<{of}>)")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda inside uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, state: Column, of: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All outputs of ``step(state, item) -> (state, array of outputs)`` in order.

    Appending copies what an array holds, so outputs gather in blocks that are put together at the end.
    """
    def inner(acc, item):
        at, out = step(acc["at"], item)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def outer(acc, block):
        return F.aggregate(block, F.struct(acc["at"].alias("at"), _empty(of).alias("out")), inner,
                           lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def over(x):
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: F.slice(x, k + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(state.alias("at"), _empty(f"array<{of}>").alias("out")), outer, lambda r: F.flatten(r["out"]))

    return _let(items, over)


def _chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, so that a position is reached without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """``length`` code points of the chunked text from ``start`` on, or what there is of them."""
    inside = start % CHUNK
    pieces = F.slice(chunks, (F.floor(start / CHUNK) + 1).cast("int"), F.ceil((inside + length) / CHUNK).cast("int"))
    return F.substring(F.array_join(pieces, ""), (inside + 1).cast("int"), length.cast("int"))


def _zero() -> Column:
    return F.lit(0).cast("long")


def _found(start: Column, end: Column, kind: str, found: Column) -> Column:
    return F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(ORDER.index(kind)).alias("rank"), found.alias("found")))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,kind,rank,found>>.

    The pieces between matches and the matches themselves come from the same scan order, so running
    lengths give the positions.  The piece behind the last match has none.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, f: F.struct(p.alias("gap"), f.alias("found")))

    def step(at, pair):
        start = at + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["found"]), F.lit(0))
        return end, F.when(pair["found"].isNotNull(), _found(start, end, kind, pair["found"])).otherwise(_empty(FOUND))

    return _scan(pairs, _zero(), FOUND, step)


def _ibans(text: Column) -> Column:
    """Valid IBANs as array<struct<start,end,kind,rank,found>>, leftmost first where they overlap.

    From each start the run of capitals, digits and single spaces is cut to the country's length, or for other
    codes to the longest of 15 to 34 characters that passes; what follows the cut must not be a letter or digit.
    """
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    starts = _scan(F.split(text, ADDED["iban"], -1), _zero(), "bigint", lambda at, piece: (at + F.length(piece), F.array(at)))

    def cut(chunks, start):
        ahead = _cut(chunks, start, F.lit(68))  # 34 characters, 33 spaces and what follows

        def longest(x):
            prescribed = F.element_at(lengths, F.substring(x, 1, 2))
            tried = F.when(prescribed.isNotNull(), F.array(prescribed)).otherwise(F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
            found = F.transform(tried, lambda n: F.call_function(
                "regexp_extract", x, F.concat(F.lit("^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){"), (n - 4).cast("string"), F.lit("}(?![A-Za-z0-9])")), F.lit(0)))
            return F.get(F.filter(found, lambda f: (f != "") & _confirmed("iban", f)), F.lit(0))

        return F.struct(start.alias("start"), _let(ahead, lambda x: F.when(x.rlike("^[A-Z]{2}[0-9]{2}"), longest(x))).alias("found"))

    def step(at, s):
        end = s["start"] + F.length(s["found"])
        apart = s["start"] >= at
        return F.when(apart, end).otherwise(at), F.when(apart, _found(s["start"], end, "iban", s["found"])).otherwise(_empty(FOUND))

    def valid(where):
        cuts = _let(_chunks(text), lambda chunks: F.transform(where, lambda start: cut(chunks, start)))
        return _scan(F.filter(cuts, lambda s: s["found"].isNotNull()), _zero(), FOUND, step)

    none = ~text.rlike("^[A-Z]{2}[0-9]{2}")
    return _let(starts, lambda where: F.when((F.size(where) < 2) & none, _empty(FOUND)).otherwise(valid(where)))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 when its rearranged number is divided by 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(acc, c):
        value = F.ascii(c)
        return F.when(value >= 65, (acc * 100 + value - 55) % 97).otherwise((acc * 10 + value - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _confirmed(kind: str, found: Column) -> Column:
    n = F.length(_digits(found))
    if kind == "ip":
        return found.rlike(rf"^0*{_BYTE}(?:\.0*{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(found))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "national_phone":
        return n.between(7, 12)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind with their scores; cheap tests first spare most texts the scan."""
    pattern = (BASE | ADDED)[kind]
    likely = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(LIKELY[kind])
    sure = _ibans(text) if kind == "iban" else F.filter(_matches(text, kind, pattern), lambda s: _confirmed(kind, s["found"]))

    def scored(chunks, s):
        before = F.least(s["start"], F.lit(WINDOW))
        bonus = F.when(F.lower(_cut(chunks, s["start"] - before, before)).rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.least(F.lit(1.0), F.lit(SCORE[kind]) + bonus).alias("score"))

    def with_context(spans):
        return F.when(F.size(spans) == 0, _empty(SPAN)).otherwise(_let(_chunks(text), lambda chunks: F.transform(spans, lambda s: scored(chunks, s))))

    return F.when(likely, _let(sure, with_context)).otherwise(_empty(SPAN))


def _apart(spans: Column) -> Column:
    """Sorted spans without those of added kinds that overlap a base span, by one pass each way.

    At equal starts base spans come first, so the greatest end so far tells of all base spans up to a span, and on
    the way back the smallest start of those behind it.
    """
    base = lambda s: s["rank"] < len(BASE)

    def onward(at, s):
        return F.when(base(s), F.greatest(at, s["end"])).otherwise(at), F.when(base(s) | (s["start"] >= at), F.array(s)).otherwise(_empty(SPAN))

    def back(at, s):
        return F.when(base(s), F.least(at, s["start"])).otherwise(at), F.when(base(s) | (s["end"] <= at), F.array(s)).otherwise(_empty(SPAN))

    return F.reverse(_scan(F.reverse(_scan(spans, _zero(), SPAN, onward)), F.lit(2**62), SPAN, back))


def find_pii(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Add ``pii_spans``: array<struct<start,rank,end,kind,score>> by start, then kind; base kinds always stay.

    Spans of the added kinds need a score of ``keep``, and none overlaps a base span.  A column named
    ``pii_spans`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("*", *(_spans(text, k).alias(f"__{k}") for k in ORDER))
    base = F.concat(*(F.col(f"__{k}") for k in BASE))
    added = F.filter(F.concat(*(F.col(f"__{k}") for k in ADDED)), lambda s: s["score"] >= keep)
    spans = _let(added, lambda more: F.when(F.size(more) == 0, F.array_sort(base)).otherwise(_apart(F.array_sort(F.concat(base, more)))))
    return named.withColumn("pii_spans", spans).drop(*(f"__{k}" for k in ORDER))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one.  Null texts stay null.

    ``n_chars``, where present, follows the new text.
    """
    found = find_pii(docs, keep)
    text = F.col("text")

    def step(at, s):
        gap = F.greatest(s["start"] - at, _zero())
        mask = F.when((s["start"] < at) | (s["kind"] == ""), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.greatest(at, s["end"]), F.array(F.struct(at.alias("start"), gap.alias("length"), mask.alias("mask")))

    size = F.length(text).cast("long")
    behind = F.struct(size.alias("start"), F.lit(0).alias("rank"), size.alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("score"))
    parts = _scan(F.concat(F.col("pii_spans"), F.array(behind)), _zero(), "struct<start:bigint,length:bigint,mask:string>", step)
    masked = _let(_chunks(text), lambda chunks: F.array_join(F.transform(parts, lambda x: F.concat(_cut(chunks, x["start"], x["length"]), x["mask"])), ""))
    new = F.when(F.size("pii_spans") > 0, masked).otherwise(text)
    out = found.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
