import re

import pytest

from pathledger.llm import pii

from .helpers import documents, empty

KEY = b"a key"
TEXTS = [
    "write to ann.lee07@mail3.example.com or ANN.LEE07@MAIL3.EXAMPLE.COM now", "call +1 (443) 555-5793, or (443) 555-5793", "card 4539 1488 0343 6467 and 4539148803436467", "from 10.1.2.3 and 93.184.216.34.",
    'token = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"!! TOKEN = "0CAB398DC11D1A2A11DC6572C8DF8BD228C864F3"', "password=3da3a2ce706927ddf6 then", "Mrs. Clara Weber met Herr Weber", "госпожа Анна Иванова и господин Иванов", "ssn 123-45-6789", "nothing here 2.0 1234",
]


def test_forms_are_kept_and_coreference_holds():
    out = [pii.replace(t, KEY)[0] for t in TEXTS]
    assert out[-1] == TEXTS[-1]
    for before, after in zip(TEXTS[:-1], out[:-1], strict=True):
        found, new = pii.find(before), pii.find(after)
        assert [f[2] for f in found] == [f[2] for f in new]
        assert not {f[3] for f in found} & {f[3] for f in new}
    a, b = re.findall(r"\S+@\S+", out[0])
    assert a.upper() == b and a.endswith(".example.com")
    assert out[1].startswith("call +1 (") and len({re.sub(r"\D", "", x)[-10:] for x in out[1].split(", or ")}) == 1
    assert pii._luhn(re.sub(r"\D", "", out[2])[:16]) == 0
    assert re.match(r"from 10\.\d+\.\d+\.\d+ and ", out[3])
    first, second = re.findall(r'"(\w+)"', out[4])
    assert first.upper() == second and re.fullmatch(r"[0-9a-f]{40}", first)
    names = out[6].replace("Mrs. ", "").split()
    assert names[0].endswith("a") and names[1] == names[-1]
    woman, man = re.search(r"госпожа \w+ (\w+) и господин (\w+)", out[7]).groups()
    assert woman == man + "а"


def test_collisions_go_on_to_the_next_attempt(spark):
    rows = [("ip", f"10.0.0.{i}") for i in range(256)] + [("email", f"{c}@example.com") for c in "abcdefghijkl"]
    odd = {(r["kind"], r["canon"]): r["attempt"] for r in pii.exceptions(spark.createDataFrame(rows, "kind string, canon string"), KEY).collect()}
    new = [pii.surrogate(k, c, odd.get((k, c), 0), KEY) for k, c in rows]
    assert len(set(new)) == len(new) and not {c for _, c in rows} & set(new)
    assert odd  # twelve of the one-letter addresses can't all miss each other at first


def test_documents_keep_rows_and_columns(spark, monkeypatch):
    docs = documents(spark, [(300 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(320 + i, f"{c}@a.com", "en", "s", 1) for i, c in enumerate("abcdefghijkl")])
    got = pii.pseudonymise(docs, KEY)
    assert got.columns[:-1] == docs.columns and got.count() == docs.count()
    plain = {(r["doc_id"], r["text"]) for r in got.collect()}
    monkeypatch.setattr(pii, "BROADCAST_EXCEPTIONS", 0)
    assert {(r["doc_id"], r["text"]) for r in pii.pseudonymise(docs, KEY).collect()} == plain
    was = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {x for x in was if not pii.find(x[1] or "")} <= plain
    mails = [t for i, t in plain if i and 320 <= i < 332]
    assert len(set(mails)) == 12
    assert pii.pseudonymise(empty(spark), KEY).count() == 0


PHONES = ["+14155552671", "+1 415 555 2671", "+1-415-555-2671", "+1 (415) 555-2671", "+1(415)555-2671", "415.555.2671", "415 555 2671", "415-555-2671", "(415) 555-2671", "(415)555-2671", "(415) 555 2671"]


@pytest.mark.parametrize("seen", PHONES)
def test_each_form_of_a_phone_number_has_the_same_surrogate(seen):
    new = pii.surrogate("phone", "4155552671", 0, KEY)
    text, n = pii.replace(f"call {seen}, or 2 of us", KEY)
    assert n == 1 and re.sub(r"\D", "", text) == ("1" if "+" in seen else "") + new + "2"
    assert re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"call {seen}, or 2 of us")


@pytest.mark.parametrize(("seen", "code"), [("+49 30 1234567", "49"), ("+49301234567", "49"), ("+4915112345678", "49"), ("+33 1 42 68 53 00", "33"), ("+33.1.42.68.53.00", "33"), ("+44 20 7946 0958", "44"), ("+44 (0)20 7946 0958", "44"), ("+354 555 1234", "354"), ("+3545551234", "354")])
def test_numbers_of_other_countries_keep_the_country_code(seen, code):
    assert [(k, c) for _, _, k, c in pii.find(f"call {seen}.")] == [("phone", re.sub(r"\D", "", seen)[len(code) :])]
    assert pii.replace(f"call {seen}.", KEY)[0].startswith(f"call +{code}")


@pytest.mark.parametrize("seen", ["3782 822463 10005", "3782-822463-10005", "378282246310005"])
def test_cards_in_groups_of_4_6_5(seen):
    assert [x[2:] for x in pii.find(f"card {seen} now")] == [("card", "378282246310005")]
    text = pii.replace(f"card {seen} now", KEY)[0]
    assert seen not in text and pii._luhn(re.sub(r"\D", "", text)) == 0


@pytest.mark.parametrize("text", ["1 234 567 and +12 345 678", "3782 822463 10006", "100 200 3000", "3.141.5926", "2024-01-02 10:30", "+5.25 % of 1000", "15 000 000 in 2024", "12 415 5552671", "version 4.15.555"])
def test_clean_numbers_stay(text):
    assert pii.find(text) == []


def test_unlisted_given_names_keep_one_gender_in_a_document():
    text = pii.replace("Dr. Xavia Weber came. Mr. Xavia Weber left. Dr. Ulla Weber, Dr. Anna Weber", KEY)[0]
    a, b = re.match(r"Dr\. (\w+) \w+ came\. Mr\. (\w+) \w+ left", text).groups()
    assert a == b and a.endswith("o")
    assert re.search(r"Dr\. (\w+) \w+$", text)[1].endswith("a")  # a listed name tells its own


@pytest.mark.parametrize("attempt", [0, 5, 13, 40])
def test_formats_hold_at_every_attempt(attempt):
    ip = lambda x: re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", x) and all(int(o) < 256 for o in x.split("."))
    assert ip(pii.surrogate("ip", "192.168.1.2", attempt, KEY)) and pii.surrogate("ip", "192.168.1.2", attempt, KEY).startswith(("192.168.", "10."))
    for kind, canon in (("phone", "4155552671"), ("ssn", "123456789"), ("card", "378282246310005"), ("secret", "abc123def")):
        assert len(pii.surrogate(kind, canon, attempt, KEY)) == len(canon)


def test_a_full_format_is_an_error(spark):
    rows = [("phone", f"{i:03}") for i in range(600)]
    with pytest.raises(ValueError, match="more than half"):
        pii.exceptions(spark.createDataFrame(rows, "kind string, canon string"), KEY)


def test_whole_result_equals_a_plain_loop(spark):
    """Rounds of attempts over a dictionary of all entities, then every text by itself."""
    texts = TEXTS + [f"{c}@a.com and {c}{c}@a.com, Mr. {c.upper()}an Weber" for c in "abcdefghijklmnop"] + ["Dr. Kim Lee", "Mrs. Kim Lee", None, ""]
    docs = documents(spark, [(400 + i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    entities = sorted({(k, c) for _, t in rows for _, _, k, c in pii.find(t or "")})
    room = lambda k: k.split("_")[0]
    known = {(room(k), c) for k, c in entities}
    taken, attempts, pending = set(), {}, [(e, 0) for e in entities]
    while pending:
        tried = [(e, a, (room(e[0]), pii.surrogate(*e, a, KEY))) for e, a in pending]
        free = sorted((new, e, a) for e, a, new in tried if new not in known and new not in taken)
        won = {}
        for new, e, a in free:
            won.setdefault(new, (e, a))
        taken |= set(won)
        attempts |= dict(won.values())
        pending = [(e, a + 1) for e, a, new in tried if won.get(new) != (e, a)]
    assert len(taken) == len(entities) and not taken & known
    want = sorted(((i, None if t is None else pii.replace(t, KEY, attempts)[0]) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in pii.pseudonymise(docs, KEY).collect()), key=str) == want


@pytest.mark.parametrize(("text", "gone", "stays"), [
    ("Mr. Smith and Mrs. Jones left.", ["Smith", "Jones"], r"Mr\. (\w+) and Mrs\. (\w+) left\."),
    ("Mr. Smith met Dr. Jones", ["Smith", "Jones"], r"Mr\. (\w+) met Dr\. (\w+)"),
    ("Herr Weber und Frau Schmidt", ["Weber", "Schmidt"], r"Herr (\w+) und Frau (\w+)"),
    ("Ms. Иванова и господин Иванов", ["Иванов"], r"Ms\. (\w+)а и господин \1"),
    ("Dr. Prof. Anna Weber", ["Anna", "Weber"], r"Dr\. Prof\. \w+a \w+"),
    ("Mr. Smith Dr. Jones Mrs Brown", ["Smith", "Jones", "Brown"], r"Mr\. \w+ Dr\. \w+ Mrs \w+"),
    ("Dr. Anna Weber spoke. Later Weber said that Anna was tired; WEBER'S report, Weber’s wife", ["Anna", "Weber", "WEBER"], r"Dr\. (\w+) (\w+) spoke\. Later \2 said that \1 was tired; [A-Z]+'S report, \2’s wife"),
    ("Dr. A. Weber and J. Weber", ["Weber"], r"Dr\. A\. (\w+) and J\. \1"),
    ("yesterday Anna Weber came; Weber left", ["Anna", "Weber"], r"yesterday \w+a (\w+) came; \1 left"),
    ("Mr. and Mrs. Jones", ["Jones"], r"Mr\. and Mrs\. \w+"),
    ("token: ------ and secret = __--__", [], r"token: ------ and secret = __--__"),
    ("mail --@--.com and weber@a.example.com, Mr. Weber", ["weber@", "Weber"], r"mail --@--\.com and \w{5}@\w\.example\.com, Mr\. \w+"),
    ("Smith and Jones, no titles. Mister is a word. Anna went", [], r"Smith and Jones, no titles\. Mister is a word\. Anna went"),
])
def test_names_and_secrets_by_hand(text, gone, stays):
    new = pii.replace(text, KEY)[0]
    assert not [g for g in gone if g in new] and re.fullmatch(stays, new), new


def test_odd_rows_go_through_and_full_secrets_grow(spark):
    docs = spark.createDataFrame([(1, "token: ------"), (2, "--@--.com"), *[(10 + i, f"token: {i}-----") for i in range(10)]], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, KEY).collect()}
    assert got[1] == "token: ------"
    new = [got[10 + i] for i in range(10)]
    assert len(set(new)) == 10 and all(re.fullmatch(r"token: \d-----[a-f]+", x) for x in new)


def test_the_key_is_required(spark):
    with pytest.raises(ValueError, match="secret key"):
        pii.session_key(spark)
    assert pii.session_key(spark, "x") == b"x"
