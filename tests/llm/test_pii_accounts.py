"""Account numbers with capitals and digits after them, against every prefix by hand."""

from strataline.llm import pii

GOOD = "DE89370400440532013000"
TEXTS = [
    "pay DE89 3704 0044 0532 0130 00 The rest",
    f"IBAN {GOOD} BIC COBADEFFXXX",
    f"konto {GOOD} 2024 10 EUR",
    f"{GOOD} GB82 WEST 1234 5698 7654 32 AND MORE",
    f"{GOOD}7 and {GOOD}x",
    "é DE88 3704 0044 0532 0130 00 The rest",
    "GB82 WEST 1234 5698 7654 32 iban, É GB82WEST12345698765432.",
]


def right(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def by_hand(text):
    out, at = [], 0
    while at < len(text):
        head = text[at : at + 4]
        end = None
        if head[:2].isascii() and head[:2].isalpha() and head[:2].isupper() and head[2:].isdigit() and len(head) == 4 and not (at and text[at - 1].isalnum()):
            for e in range(at + 15, min(at + 64, len(text)) + 1):
                packed = text[at:e].replace(" ", "")
                plain = "  " not in text[at:e] and all(c.isdigit() or "A" <= c <= "Z" for c in packed) and text[e - 1] != " "
                if plain and 15 <= len(packed) <= 34 and not text[e : e + 1].isalnum() and right(packed):
                    end = e
        if end:
            out.append(("iban", at, end))
        at = end or at + 1
    return out


def test_accounts_before_capitals_and_digits(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = [[(s.kind, s.start, s.end) for s in r.pii if s.kind == "iban"] for r in pii.find_pii(df).orderBy("doc_id").collect()]
    assert got == [by_hand(t) for t in TEXTS]
    assert [len(g) for g in got] == [1, 1, 1, 2, 0, 0, 2] and got[0] == [("iban", 4, 31)] and got[1] == [("iban", 5, 27)]
    masked = [r.text for r in pii.mask_pii(df).orderBy("doc_id").collect()]
    assert masked[:2] == ["pay <iban> The rest", "IBAN <iban> BIC COBADEFFXXX"]
