from __future__ import annotations

import re
import unicodedata

import pytest

from evidra.llm.pii import find, find_in_handle, mentions, replace_all, surrogate_checks, types_present
from evidra.llm.surrogates import EMAIL, Cipher, entity_of, plain, surrogate

KEY = b"k" * 16
CIPHER = Cipher(KEY)
FOUND = {
    "email": ["a.b+c@mail.example.org", "A.B@X-Y.EXAMPLE", "ann @ x.example", "ann (at) x (dot) example", "ann[at]x.example", "ann AT mail DOT x DOT org"],
    "phone": ["+49 30 5550 1582", "+44 (0)7700 900 829", "+1-206-555-0143 ext. 63", "(415) 555-0176", "312.555.0156", "646555 0106", "07700 900274", "030/55507966", "01 99 00 37 00", "0034 600 55 27 74", "5 0 3 5 5 5 0 1 1 6", "five five five, oh one nine four", "+33199 001271"],
    "identity_number": ["DNI 14576126M", "959-82-9050", "my social is 976 48 8349", "NI number QQ 93 12 17 C", "n° de sécu 1 80 52 51 940 151 66", "PESEL 61341605749", "Steuer-ID 24 996 263 211", "ID card LZ-01377-X", "passport no. X1313445", "driver's licence B281-3548-2153", "123.456.789-09"],
    "address": ["142 Millrace Street, Saint-Orval", "19 foundry st", "Sycamoreweg 185, 04599 Ostwick", "Alte Falconstraße 3a", "45 bis rue des Herons", "C/ del Thistle 188, 3º B", "ul. Cobblerowa 186/6", "100 N. Maple Ave Apt 21", "31 Orchard Blvd., Suite 769", "Flat 7, 111 Maple Rd", "Via Garibaldi 12"],
    "person_name": ["Laura Pellworthy", "Dr. Andre Fennowicz", "JULIA WEXWORTHY", "Fennowicz, Jonas", "Kwame A. Lindmannel", "K. Vellmannel", "Björn Duntüller-Voss", "Maria de la Cruz"],
}
CLEAN = [
    None, "", "[deleted]", "Dear Peter, the dry run passed.", "Thanks Maria, that solved it!", "Run it as admin@localhost, please.", "Set user@ in the template.", "The regex [a-z]+@[a-z]+ rejects plus signs.", "Ping @release-bot or u/quiet_harbor.", "Order no. 723624345 shipped.",
    "Ticket 482-63-753 is open.", "Invoice 2025-37-0088 shows 99 dollars.", "Serial 0749-13-40883 has a loose fan.", "The host at 192.0.2.16 drops port 5432.", "Version 3.14.159 against 2.71.828.", "The build 10.4.27993.11 fixed it.", "Coordinates 47.71830, 8.69256 fall into a lake.",
    "Latency 555 ms at p95, 0137 in the error column.", "Between 2025-08-14 10:22:05 and 2025-08-15 it logged 216728 errors.", "RFC 7231 and ISO 27001 came up 20 times.", "Commit 9f3ac35e93 broke it.", "The SKU QQ-856224 is a cable.", "We sell 80 units on Main Street fairs.", "Route 66 of the API returns 5 items, lane changes included.",
    "It is a two-street-wide rollout.", "You can get 20 percent of the way there.", "Umbrella Sheets and Brindle CRM share the same owner.", "I compared Fathomly, Harborcast and Quarrysync.", "We looked at month end, dot by dot.", "Plan B. Then we go home.",
]


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in FOUND.items() for t in ts])
def test_found_in_a_sentence(kind, text):
    for around in ("Please note: {} - thanks.", "{}", "so {}, and more\nhere"):
        got = {k for _, _, k in find(around.format(text))}
        assert kind in got, (around, got)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert find(text) == []


@pytest.mark.parametrize(("handle", "kinds"), [("Zoë Vellmannel", {"person_name"}), ("tarvainek-mei-97", {"person_name"}), ("ingrid.vellbale", {"person_name"}), ("Fatima_Duntüller-Voss", {"person_name"}), ("Okemaruma, Sofia", {"person_name"}), ("david.quistova@uni.example", {"email"}), ("415-555-0197", {"phone"}), ("call_07700900158", {"phone"}), ("+493055500408", {"phone"})])
def test_handles(handle, kinds):
    assert {k for _, _, k in find_in_handle(handle)} == kinds


@pytest.mark.parametrize("handle", [None, "", "QuietHarbor0", "velvet_otter_24", "Amber-Kettle-1298", "grand.socket", "amber.harbor", "[deleted]", "night.owl", "maria", "maria_2024", "qa.lead"])
def test_nicknames(handle):
    assert find_in_handle(handle) == ()


def test_entities_agree_across_spellings():
    assert len({entity_of("email", x) for x in ("Ann.B@x.example", "ann.b @ X.EXAMPLE", "ann.b (at) x (dot) example", "ann.b AT x DOT example")}) == 1
    assert len({entity_of("person_name", x) for x in ("Björn Velletti", "VELLETTI, BJÖRN", "bjorn velletti", "Björn A. Velletti", "velletti-björn")}) == 1
    assert entity_of("phone", "five five five, oh one nine four") == entity_of("phone", "555-0194")


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in FOUND.items() for t in ts])
def test_surrogates_keep_type_and_format(kind, text):
    a, b, _ = next(f for f in find(text) if f[2] == kind)
    part = text[a:b]
    entity, new, shown = surrogate(kind, part, CIPHER)
    assert shown != part and (entity, new, shown) == surrogate(kind, part, Cipher(KEY)) and entity == entity_of(kind, part) != new
    if kind != "email":
        assert entity_of(kind, shown) == new
    if kind in ("phone", "identity_number"):
        assert [c.isdigit() for c in shown] == [c.isdigit() for c in part] or not any(c.isdigit() for c in part)
    if kind == "person_name":
        assert shown.isupper() == part.isupper() and ("," in shown) == ("," in part)
    if kind == "email":
        assert ("(at)" in shown) == ("(at)" in part) and (" AT " in shown) == (" AT " in part)


def test_gender_is_kept():
    from evidra.llm.names import FEMALE, MALE

    for names, female in ((FEMALE, True), (MALE - FEMALE, False)):
        given = {CIPHER.given(plain(n)) for n in names if plain(n) not in {plain(f) for f in FEMALE} or female}
        assert all((g in {plain(f) for f in FEMALE}) == female for g in given)


def test_script_is_kept():
    for kind, text in (("person_name", "Анна Иванова"), ("person_name", "Γιώργος Παπαδόπουλος"), ("address", "ул. Ленина 5, Тверь"), ("person_name", "Сергей Д. Петров")):
        _, _, shown = surrogate(kind, text, CIPHER)
        assert shown != text and {unicodedata.name(c).split()[0] for c in shown if c.isalpha()} == {unicodedata.name(c).split()[0] for c in text if c.isalpha()}


def test_nothing_of_an_address_is_left():
    for text in ("12 Oak St", "7 Elm Road", "12 Martin Luther King Blvd", "Flat 7, 111 Maple Rd, Bremfeld", "Sycamoreweg 185, 04599 Ostwick", "31 Orchard Blvd., Suite 769"):
        _, _, shown = surrogate("address", text, CIPHER)
        own = {w for w in re.findall(r"\w+", text.lower()) if w not in "st road blvd flat rd suite".split()}
        assert not own & set(re.findall(r"\w+", shown.lower())), (text, shown)


def test_country_codes_and_control_letters_stay_right():
    assert surrogate("phone", "+49 30 5550 1582", CIPHER)[2].startswith("+49 ") and surrogate("phone", "00351 600 55 27 74", CIPHER)[2].startswith("00351 ")
    for text in ("14576126M", "X1234567L"):
        shown = surrogate("identity_number", text, CIPHER)[1]
        number = int(("xyz".index(shown[0]) and "" or "0") + shown[1:-1] if shown[0] in "xyz" else shown[:-1])
        valid = "trwagmyfpdxbnjzsqvhlcke"
        was = int(text[:-1].lower().replace("x", "0"))
        assert (valid.index(shown[-1]) - number) % 23 == (valid.index(text[-1].lower()) - was) % 23


@pytest.mark.parametrize(("kind", "texts"), [("address", [f"{n} Oak St" for n in range(1, 3000)]), ("phone", [f"555-{n:04d}" for n in range(10_000)]), ("identity_number", [f"{n:02d}" for n in range(100)]), ("person_name", [f"Laura {a}{b}{c}on" for a in "BCDFGHKLMNPRST" for b in "aeiou" for c in "bdfgklmnprst"]), ("email", [f"{a}{n}@x.{t}" for a in "abcdefg" for n in range(20) for t in ("com", "org", "example", "com.example")])])
def test_no_two_entities_share_what_is_written(kind, texts):
    """As many different surrogates as entities, however many of the possible values are taken."""
    written = [surrogate(kind, t, CIPHER)[2] for t in texts]
    assert len({w.lower() for w in written}) == len(set(texts)) and not any(a == b for a, b in zip(texts, written))


UNLISTED = "Gareth Pemberton;Dorothy Hargreaves;Rajiv Menon;Zhang Wei;Imogen Thistlethwaite;Oluwaseun Adebayo;Thiago Vasconcelos;Mireille Duchamp;Ignatius Reilly;Bronwyn Llewellyn;Tadeusz Kowalczyk;Solveig Haugland;Ottoline Featherstone;Wilhelmina Vandersloot;Ezekiel Montgomery;Parvati Krishnamurthy;Bogdan Dragomir;Leocadia Fuentes;Torvald Ingebrigtsen;Annika Söderlund;Cuthbert Wigglesworth;Domhnall Gallagher;Saoirse Kinsella;Xiomara Villanueva;Yevgenia Morozova;Percival Blenkinsop;Araminta Ponsonby;Lubomir Novotny;Hadiza Abubakar;Tamsin Trelawney".split(";")
FRAMES = ["Yesterday {} told me the price goes up.", "Please ask {} for the key.", "I met {} at the office.", "Mr. {} signed the contract.", "The report was written by {} in May.", "My colleague {} left in June.", "{} said it works.", "Many thanks to {} for the quick fix.", "I spoke with {} about it.", "Our landlord {} wants cash."]
THINGS = ["The Jordan River is low.", "We moved from Acme to Victoria Metrics.", "We use Maria DB for that.", "She studied at Sarah Lawrence College.", "Greetings from Prince Edward Island.", "The Laura Ashley Group has closed.", "Has anyone moved from Quillstack to Northpail?", "I like Harborcast Cloud and Brindle CRM.", "It was made by Umbrella Software in Bremfeld.", "We went to Lake Constance and Black Forest.", "Set up by Visual Studio Code.", "We flew with Turkish Airlines to New York.", "See Stack Overflow and Hacker News.", "I work with Google Docs and Power Point.", "Thanks to Open Street Map for the tiles.", "Credit to Mozilla Firefox for that.", "Answered by Customer Support.", "The Peter Principle applies.", "It is named Product Hunt.", "Written by Machine Learning models."]


def test_names_in_no_list_are_found():
    """Recall of names that stand in no list, in ten frames each, and what is wrongly taken for a name."""
    from evidra.llm.names import GIVEN

    names = [n for n in UNLISTED if n.split()[0].lower() not in GIVEN]
    hits = [any(k == "person_name" and name in frame.format(name)[a:b] for a, b, k in find(frame.format(name))) for name in names for frame in FRAMES]
    print("recall", sum(hits) / len(hits), [t for t in THINGS if find(t)])
    assert len(names) > 25 and sum(hits) >= 0.9 * len(hits)
    assert sum(bool(find(t)) for t in THINGS) <= 1


def test_time_grows_with_length():
    import time

    for unit in ("a'", "a.", "ann at ", "1 ", "John Smith, ", "J. ", "(at) ", "five ", "12 Oak St ", "Abc ", "a@", "+1 "):
        began = time.perf_counter()
        find((unit * (100_000 // len(unit)))[:100_000] + " @ x")
        assert time.perf_counter() - began < 3, unit


@pytest.mark.parametrize(("kind", "text"), [("person_name", "(J. Smith)"), ("person_name", "«Laura Brindle» said so"), ("address", "Calle Mayor nº5"), ("phone", "five-five-five-one-two-one-two"), ("identity_number", "id-card LZ-0137"), ("identity_number", "national id AB1234"), ("identity_number", "Reisepassnummer C01X0"), ("email", "ann {at } x { dot } example")])
def test_gates_let_through_what_the_patterns_find(kind, text):
    assert kind in {k for _, _, k in find(text)} or kind == "email" and not find(text)


DATA = [(1, "Write me at ann.b@x.example or ann.b (at) x (dot) example.", "Zoë Vellmannel", "c"), (2, "Signed, VELLMANNEL, ZOË", None, "c"), (3, None, "QuietHarbor0", "c"), (4, "", "", "c"), (5, "Write me at ann.b@x.example or ann.b (at) x (dot) example.", "Zoë Vellmannel", "c"), (6, "fine. " * 20_000 + "Call +49 30 5550 1582", None, "c")]


def test_spark(spark):
    df = spark.createDataFrame(DATA, "row_id long, body string, author string, pii_type string")
    types = sorted(map(tuple, types_present(df, "row_id", ["body"], ["author"], KEY).collect()))
    assert types == [(1, "author", "person_name"), (1, "body", "email"), (2, "body", "person_name"), (5, "author", "person_name"), (5, "body", "email"), (6, "body", "phone")]
    assert mentions(df, "row_id", ["body"], ["author"], KEY).count() == 8
    got = {(r["key"], r["field_name"]): r for r in replace_all(df, "row_id", ["body"], ["author"], KEY).collect()}
    assert len(got) == 12 and got[1, "body"]["redacted"] == "Write me at [EMAIL] or [EMAIL]." and got[1, "author"]["redacted"] == "[PERSON_NAME]"
    assert got[6, "body"]["redacted"] == "fine. " * 20_000 + "Call [PHONE]" and got[3, "body"]["redacted"] is None and got[4, "body"]["surrogate_text"] == ""
    plain, spelled = got[1, "body"]["surrogate_text"].removeprefix("Write me at ").removesuffix(".").split(" or ")
    assert entity_of(EMAIL, plain) == entity_of(EMAIL, spelled) and got[1, "body"]["surrogate_text"] == got[5, "body"]["surrogate_text"]
    new = got[1, "author"]["surrogate_text"].split()
    assert got[2, "body"]["surrogate_text"] == f"Signed, {new[1].upper()}, {new[0].upper()}"
    empty = df.where("false")
    assert types_present(empty, "row_id", ["body"], ["author"], KEY).count() == replace_all(empty, "row_id", ["body"], ["author"], KEY).count() == 0
    checks = {r["pii_type"]: r for r in surrogate_checks(mentions(df, "row_id", ["body"], ["author"], KEY)).collect()}
    assert checks["email"]["mentions"] == 4 and checks["email"]["entities"] == checks["email"]["surrogates"] == 1
    assert all(r["split_entities"] == r["shared_surrogates"] == 0 for r in checks.values())
