from remitweave.llm import pii

IBAN = "DE89370400440532013000"
SPACED = "DE89 3704 0044 0532 0130 00"


def ibans(text):
    return [text[a:b] for kind, a, b, _ in pii.find(text) if kind == "iban"]


def test_words_after_an_iban_are_not_part_of_it():
    for iban in (IBAN, SPACED):
        for tail in (" BIC COBADEFFXXX", " 12 May", " SSN 123-45-6789", " 2024", ".", ""):
            assert ibans(iban + tail) == [iban]
            assert ibans("AB12 " + iban + tail) == [iban]
    assert ibans(f"{IBAN} GB29NWBK60161331926819 {SPACED}") == [IBAN, "GB29NWBK60161331926819", SPACED]
    assert ibans("NO9386011117947 1234") == ["NO9386011117947"]


def test_other_texts_have_none():
    for text in (IBAN + "X BIC", IBAN[:-1] + "1 12 May", "X" + IBAN, "account DE89 3704 0044 0532 0130 01", "é DE89 3704"):
        assert ibans(text) == []
