import hashlib
import re

from mnemo.llm.pii import find_pii, mask_pii, mod97, span_text
from mnemo.llm.queries import pii_digest
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn_ok(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"),
                    "card": 12 <= len(digits) <= 19 and luhn_ok(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if keep:
                out.append((m.start(), ["email", "ip", "card", "phone"].index(kind), m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


CASES = [
    None, "", "plain words", "a@b.com_x@y.com, a@b.c@d.e foo@bar x..y%+@q-1.z9-.k", "ip 1.2.3.4.5 999.1.1.1 0001.002.03.4 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111110000000 12  34 4111111111111111", "4" * 5000, "1." * 4000, "a" * 50000 + "@b.co",
    "+1 (152) 555-8590 and +49-89-1234567890123456 ++12 +1........2", "é4111111111111111é x@y.zz ñ+1 (152) 555-8590", "9" * 11 + " " + "9" * 8,
    "x" * 20 + " 10.0.0.1@mail.example.com 10.0.0.1", "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and GB82WEST12345698765431",
    "a@" + "b." * 5000 + "c", "tel 089 123456789 call (152) 555-8590", ("+1 (152) 555-8590 " * 50),
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(CASES)], "doc_id long, text string, pii string")
    got = {r["doc_id"]: r for r in pii_digest(docs).collect()}
    for k, text in enumerate(CASES):
        want = brute(text)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (k, want, got[k]["spans"])
        assert set(want) <= set(filter(None, got[k]["spans"].split(",")))
        for kind in ("email", "ip", "card", "phone"):
            assert got[k][f"n_{kind}"] == sum(w.startswith(kind + ":") for w in want)


def test_added_spans_and_masks(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(CASES)], "doc_id long, text string, n_chars long")
    spans = {r[0]: r[1] for r in find_pii(docs).select("doc_id", span_text(F.col("pii_spans"))).collect()}
    assert spans[13].count("iban:") == 2 and "national_phone" in spans[15]
    masked = {r[0]: (r[1], r[2]) for r in mask_pii(docs).collect()}
    assert masked[0] == (None, 7) and masked[2] == ("plain words", 7)
    assert masked[13][0].startswith("iban [IBAN] and [IBAN] and GB82WEST12345698765431")
    assert masked[16][0] == "[PHONE] " * 50 and masked[16][1] == 400
    assert mask_pii(docs.limit(0)).columns == docs.columns and mask_pii(docs.limit(0)).count() == 0


def test_digits_parted_one_by_one(spark):
    """No two digits are adjacent in these texts."""
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "card 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 end", "4 1 1 1-1 1 1 1 1 1 1 1 1 1 1 2", "+1 (5) 5-5 5 5-8 5 9 0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_digest(docs).collect()}
    for k, text in enumerate(texts):
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(brute(text)).encode()).hexdigest(), (k, got[k]["spans"])
    assert [got[k]["n_card"] for k in range(3)] == [1, 1, 0]
    assert {r["doc_id"]: r["text"] for r in mask_pii(docs).collect()}[1] == "card [CARD] end"


def test_ibans_end_where_their_country_says(spark):
    de, spaced, gb, no = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    texts = {f"{de} Please pay": [de], f"to {spaced} BIC COBADEFFXXX": [spaced], f"{spaced} 12 May": [spaced], f"é {spaced} {gb} {no} X": [spaced, gb, no],
             f"AB12 CD34 {gb} EUR 5": [gb], f"{de}Please {de}1": [], f"x{de}": [], "DE88370400440532013000 Please": [], f"NO12 3456 {gb}": [gb], "": []}
    body = "ZZ1234567890ABCDEFG"  # a country that is not in the table
    check = 98 - int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97
    other = f"ZZ{check:02d}{body}"
    texts[f"{other} and {other} Then"] = [other, other]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    spans = {r[0]: [x for x in r[1] if x["kind"] == "iban"] for r in find_pii(docs).select("doc_id", "pii_spans").collect()}
    for k, (text, want) in enumerate(texts.items()):
        assert [text[s["start"]:s["end"]] for s in spans[k]] == want, text


def test_mod97(spark):
    row = spark.range(1).select(mod97(F.lit("GB82WEST12345698765432")).alias("a"), mod97(F.lit("GB82WEST12345698765433")).alias("b")).first()
    assert row["a"] and not row["b"]


def test_long_texts_with_many_spans(spark):
    """Positions, masks and the test of overlaps stay linear: 40,000 spans in a text, kinds side by side."""
    texts = ["é +1 (152) 555-8590 a@b.co;" * 20_000, "call 089 12345678, GB82WEST12345698765432; 10.0.0.1 " * 700]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_digest(docs).collect()}
    for k, text in enumerate(texts):
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert got[0]["n_phone"] == got[0]["n_email"] == 20_000
    assert got[1]["spans"].count("iban") == got[1]["spans"].count("national_phone") == 700
    masked = {r["doc_id"]: r["text"] for r in mask_pii(docs).collect()}
    assert masked[0] == "é [PHONE] [EMAIL];" * 20_000 and masked[1] == "call [NATIONAL_PHONE], [IBAN]; [IP] " * 700
