import random

import pytest

from platewright.llm import surrogates as s

KEY = b"test key"
DOCS = "doc_id long, text string, mentions string, n_entities string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("Write to Ann.B+x@Mail.example.com, now", [("Ann.B+x@Mail.example.com", "email")]),
        ("at 4111 1111 1111 1111 10.0.0.7 here", [("4111 1111 1111 1111", "card"), ("10.0.0.7", "ip")]),
        ("call +1 (988) 555-2485. or 988-555-2485", [("+1 (988) 555-2485", "phone"), ("988-555-2485", "phone")]),
        ("ssn 123-45-6789, 4041894974608795 end", [("123-45-6789", "ssn"), ("4041894974608795", "card")]),
        ("version 1.2.3.4.5 and 999.1.1.1 and 2024-01-02 and 12345", []),
        ("IBAN DE89 3704 0044 0532 0130 00 x", [("DE89 3704 0044 0532 0130 00", "iban")]),
        ("Mr. Smith met Anna Müller", [("Smith", "family"), ("Anna", "given_x"), ("Müller", "family")]),
        ("г-жа Ольга Петрова", [("Ольга", "given_f"), ("Петрова", "family")]),
        ("JOHN SMITH", [("JOHN", "given_x"), ("SMITH", "family")]),
        ("x@ @y a@b", []),
    ],
)
def test_detection(text, want):
    assert [(text[a:b], k) for a, b, k in s.detect(text)] == want


def test_permutations_are_one_to_one():
    keyed = s.Keyed(KEY)
    for label, left, right in (("a", 10, 10), ("b", 7, 13), ("c", 1, 5), ("d", 26, 1)):
        assert sorted(keyed.permute(label, i, left, right) for i in range(left * right)) == list(range(left * right))
    even = [keyed.within("e", i, 10, 10, lambda k: k % 2 == 0) for i in range(0, 100, 2)]
    assert sorted(even) == list(range(0, 100, 2))
    short = [a + b + c for a in "bcd" for b in "aeiou" for c in "xyz"]
    assert len({keyed.text("t", w) for w in short}) == len(short)


def test_surrogates_keep_kind_and_format():
    keyed, rng = s.Keyed(KEY), random.Random(1)
    card = next(c for c in (f"4{rng.randrange(10**15):015d}" for _ in range(99)) if s.luhn(c))
    new = s.surrogate(keyed, "card", card)
    assert s.luhn(new) and new[0] == "4" and len(new) == 16 and new != card
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    assert not s.luhn(s.surrogate(keyed, "card", wrong))
    iban = s.surrogate(keyed, "iban", "DE89370400440532013000")
    assert iban[:2] == "DE" and iban[2:4] == s._iban_check("DE", iban[4:]) and iban != "DE89370400440532013000"
    assert s._network(s._address(s.surrogate(keyed, "ip", "192.168.3.4"))) == "private"
    for group in s.GIVEN:
        names = [n.lower() for n in s.GIVEN[group]]
        assert sorted(s.surrogate(keyed, "given_x", n) for n in names) == sorted(names)
    text, _ = s.replace(keyed, "Call +1 (988) 555-2485, 988.555.2485 or (988) 555 2485; JOHN SMITH, John Smith", {})
    a, b, c = text[5:22], text[24:36], text[40:54]
    digits = ["".join(ch for ch in x if ch.isdigit())[-10:] for x in (a, b, c)]
    assert len(set(digits)) == 1 and digits[0] != "9885552485"
    names = text.split("; ")[1].split(", ")
    assert names[0] == names[1].upper() and names[0].isupper() and "SMITH" not in text.upper()


@pytest.mark.parametrize("key", [KEY, b"surrogate demonstration key", b"1", b"2"])
def test_no_entity_is_its_own_surrogate(key):
    keyed = s.Keyed(key)
    for group in s.GIVEN:
        names = [n.lower() for n in s.GIVEN[group]]
        assert all(s.surrogate(keyed, "given_x", n) != n for n in names)
    short = [a + b for a in "bcdfgh" for b in "aeiou"] + list("aeiouxyz") + [str(i) for i in range(10)]
    new = [s.surrogate(keyed, "family", w) for w in short]
    assert not any(a == b for a, b in zip(short, new, strict=True)) and len(set(new)) == len(new)
    for left, right in ((1, 2), (2, 1), (3, 4)):
        for allowed in (lambda k: True, lambda k: k % 2 == 0):
            values = [k for k in range(left * right) if allowed(k)]
            out = [keyed.within("x", k, left, right, allowed) for k in values]
            assert sorted(out) == values and (len(values) == 1 or all(a != b for a, b in zip(values, out, strict=True)))


@pytest.mark.parametrize(
    "mail",
    [
        "محمد@مثال.example.com", "דוד@דוגמה.example.com", "王小明@例子.example.com", "たろう@テスト.example.com", "नमन@उदाहरण.example.com",
        "ßłőş@łőşß.example.com", "١٢٣@٤٥٦.example.com", "김철수@한국.example.com", "ЇЄҐ@їєґ.example.com", "İlker@mail.example.com",
        "a" * 100 + "@mail.example.com", "naïve." * 40 + "x@mail.example.com",
    ],
)
def test_mail_in_any_script_and_length(mail):
    keyed = s.Keyed(KEY)
    for lead in ("", "to ", "x@@"):
        found = s.detect(lead + mail + " now")
        assert [(a, b, k) for a, b, k in found] == [(len(lead), len(lead + mail), "email")]
    new = s.surrogate(keyed, "email", mail.lower())
    (local, domain), (old, at) = new.split("@"), mail.lower().split("@")
    assert local != old and domain.split(".")[0] != at.split(".")[0]
    text, _ = s.replace(keyed, "to " + mail, {})
    assert mail.split("@")[0] not in text and mail.split("@")[1].split(".")[0] not in text


def test_every_letter_and_digit_has_others_in_its_class():
    for ch in map(chr, range(0x110000)):
        if (ch.isalpha() or ch.isnumeric() and s.unicodedata.category(ch)[0] == "N") and ch.lower() == ch and ch != "ς":
            assert len(s.class_of(ch)) > 1, ch
    assert s.Keyed(KEY).text("t", "İİİİ") != "İİİİ"


def test_other_keys_give_other_surrogates():
    text = "mail ann.bell@mail.example.com"
    assert s.replace(s.Keyed(b"1"), text, {})[0] != s.replace(s.Keyed(b"2"), text, {})[0]


def _docs(spark):
    rng = random.Random(2)
    rows = [(1, "ann@b.example.com and 10.1.2.3"), (2, "ANN@b.example.com"), (3, None), (4, ""), (None, "Mr. Smith")]
    rows += [(1, "ann@b.example.com and 10.1.2.3"), (5, "nothing to hide"), (6, "word " * 200_000 + "ann@b.example.com")]
    for i in range(300):
        rows.append((10 + i, f"{rng.choice('abc')}{rng.randrange(99)}@{rng.choice('xyz')}.example.org {rng.randrange(256)}.7.7.{rng.randrange(256)}"))
    return spark.createDataFrame([(*r, "mine", "9") for r in rows], DOCS), rows


def test_rows_coreference_and_edges(spark):
    docs, rows = _docs(spark)
    out = s.pseudonymise(docs, KEY)
    assert out.columns == ["doc_id", "text", "mentions", "n_entities"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[3][0].text is None and got[3][0].n_entities == 0 and got[4][0].text == ""
    assert got[5][0].text == "nothing to hide" and got[5][0].mentions == "mine"
    mail = got[1][0].text.split(" ")[0]
    assert mail != "ann@b.example.com" and mail.endswith(".com") and got[1][0] == got[1][1]
    assert got[2][0].text.lower() == mail and got[6][0].text.endswith(" " + mail)
    assert got[None][0].text != "Mr. Smith" and got[None][0].text.startswith("Mr. ")
    pairs = {}
    for i, t, in ((r[0], r[1]) for r in rows[8:]):
        for a, b in zip(t.split(), got[i][0].text.split(), strict=True):
            assert pairs.setdefault(a, b) == b
    assert len(set(pairs.values())) == len(pairs)
    assert s.pseudonymise(docs.limit(0), KEY).count() == 0


def test_collisions_are_reported(spark):
    schema = "kind string, entity string, surrogate string"
    good = [("email", "a@b", "c@d"), ("email", "a@b", "c@d"), ("ip", "a@b", "c@d")]
    assert s.collisions(spark.createDataFrame(good, schema)).count() == 0
    assert s.collisions(spark.createDataFrame([*good, ("email", "x@b", "c@d")], schema)).count() == 1
    assert s.collisions(spark.createDataFrame([*good, ("email", "a@b", "e@d")], schema)).count() == 1


def test_later_mentions_are_replaced_alike():
    text = "Dr. Anna Schmidt called. Anna said Schmidt would come; SCHMIDT came. Schmidtstrasse, Annabel, x@Schmidt.de, Schmidt's dog"
    keyed = s.Keyed(b"k")
    out, mentions = s.replace(keyed, text, {})
    given, family = s.surrogate(keyed, "given_f", "anna"), s.surrogate(keyed, "family", "schmidt")
    assert out.count(given.capitalize()) == 2 and out.count(family.capitalize()) == 3 and family.upper() in out
    assert "Schmidtstrasse, Annabel" in out and " Anna " not in out and " Schmidt " not in out
    assert len([m for m in mentions if m[0] == "family"]) == 4
    # A text without the full name says nothing of its words.
    assert s.replace(keyed, "Schmidt went home with Anna", {})[0] == "Schmidt went home with Anna"


def plain_names(text, words):
    """Whole words of ``text`` that are names, by looking at every place."""
    out = []
    for w in {f for w in words for f in (w, w.upper())}:
        for i in range(len(text) - len(w) + 1):
            before, after = text[i - 1 : i], text[i + len(w) : i + len(w) + 1]
            if text[i : i + len(w)] == w and not (before.isalnum() or after.isalnum()):
                out.append((i, i + len(w)))
    return sorted(out)


def test_all_mentions_of_found_names_against_every_place():
    rng = random.Random(3)
    for _ in range(100):
        words = ["Anna", "Berger", "ANNA", "BERGER", "went", "to", "Bergers", "the", "anna", "Annabel"]
        text = "Mrs Anna Berger, " + ", ".join(rng.choice(words) for _ in range(30)) + "."
        spans = sorted((a, e) for a, e, _ in s.detect(text))
        assert spans == plain_names(text, ["Anna", "Berger"])
