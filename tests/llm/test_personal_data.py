import pytest

from sievewright.llm.personal_data import feistel, find_personal, permuted_digits, personal_spans, pseudonym, without_personal

CASES = [
    ("Write to ann.lee+x@uni.example. Bye", {("email", "ann.lee+x@uni.example")}),
    ("Mail jo_b at mail dot example dot net or JO [at] x.test, run@3658 kept", {("email", "jo_b at mail dot example dot net"), ("email", "JO [at] x.test")}),
    ("From: Savinger, Emil <a(at)b.org>", {("person_name", "Savinger, Emil"), ("email", "a(at)b.org")}),
    ("Best,\nAnna Navova-Quan\n+33 1 99 00 83 75\nTel. (555) 555-0102, 030/23125-517, 0044 20 7946 0133, 555.555.0157 ext. 2", {("person_name", "Anna Navova-Quan"), ("phone", "+33 1 99 00 83 75"), ("phone", "(555) 555-0102"), ("phone", "030/23125-517"), ("phone", "0044 20 7946 0133"), ("phone", "555.555.0157")}),
    ("Reagent lot 959-40-8640 expired. National ID: 959-40-8640. Passport QQ 04 66 50 A was", {("id_number", "959-40-8640"), ("id_number", "QQ 04 66 50 A")}),
    ("Barcode 790930305140, record md0018684655, build 9.59.406.7097, 298-401-607 nm, no. 0398-6339-15, from 339 469 to 237 096", set()),
    ("The Kelvorn fit was used. Velnavik buffer at pH 7.1. The Saddler panel has 21 members. Lane 24 shows", set()),
    ("Ship to 14 Quarry Road, Floor 5. Versand an Millweg 20a, 00136 X. Enviar a Calle Weir 64, 00475. Envoyer à 92 rue des Coppers, 00347", {("street_address", "14 Quarry Road"), ("street_address", "Millweg 20a"), ("street_address", "Calle Weir 64"), ("street_address", "92 rue des Coppers")}),
    ("id=000000195609115698 X47001104 hat Frau R. Dasmark; Dra. Sofia Tolm-Wess firmó", {("id_number", "000000195609115698"), ("id_number", "X47001104"), ("person_name", "R. Dasmark"), ("person_name", "Sofia Tolm-Wess")}),
    ("Samir J. Brencott's notes. The second reader, Kelbek, Elif, disagreed. Operator: Ingrid Pel\nMail: x", {("person_name", "Samir J. Brencott"), ("person_name", "Kelbek, Elif"), ("person_name", "Ingrid Pel")}),
    ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_found(text, want):
    got = find_personal(text)
    assert {(k, text[a:b]) for k, a, b in got} == want
    assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(feistel(v, size, b"k") for v in range(size)) == list(range(size))
    assert feistel(5, 1000, b"k") != feistel(5, 1000, b"other") or feistel(6, 1000, b"k") != feistel(6, 1000, b"other")
    assert len({permuted_digits(f"{n:03}-x", b"k") for n in range(1000)}) == 1000


def test_pseudonyms_keep_the_format():
    assert pseudonym("phone", "+33 1 99 00 83 75", b"k")[:11] == "[PHONE +33 " and len(pseudonym("phone", "555-0102", b"k")) == len("[PHONE 555-0102]")
    made = pseudonym("id_number", "000000195609115698", b"k")[11:-1]
    assert len(made) == 18 and 1900 <= int(made[6:10]) <= 2050 and 1 <= int(made[10:12]) <= 12 and 1 <= int(made[12:14]) <= 31
    assert pseudonym("person_name", "Anna\nLee", b"k") == pseudonym("person_name", "anna lee", b"k") != pseudonym("person_name", "anna lea", b"k")


def test_tables(spark):
    schema = "doc_id long, text string, doc string, pii_type string"
    long = "word " * 40_000 + "a@b.org"
    df = spark.createDataFrame([(1, "é a@b.org", "c", "c"), (2, None, "c", "c"), (3, "", "c", "c"), (4, long, "c", "c"), (4, long, "c", "c")], schema)
    assert sorted((r["doc"], r["pii_type"], r["start_pos"]) for r in personal_spans(df, "doc_id", "text").collect()) == [(1, "email", 2), (4, "email", 200_000), (4, "email", 200_000)]
    out = {r["doc"]: (r["text"], r["replaced"]) for r in without_personal(df, "doc_id", "text", b"k").collect()}
    assert out[1][0].startswith("é [EMAIL ") and out[1][1] == 1 and out[2] == (None, 0) and out[3] == ("", 0)
    assert out[4][0].split("[EMAIL")[1] == out[1][0].split("[EMAIL")[1]
    empty = df.limit(0)
    assert personal_spans(empty, "doc_id", "text").count() == 0 and without_personal(empty, "doc_id", "text", b"k").count() == 0


def test_names_of_no_list_are_found_by_what_stands_around_them():
    for text, name in (
        ("The curves were checked by Oluwaseun Adeyemi before the release.", "Oluwaseun Adeyemi"),
        ("Yesterday Siobhan Gallagher reviewed the second plate.", "Siobhan Gallagher"),
        ("Thanks to Dmitri Volkov for the rerun.", "Dmitri Volkov"),
        ("Ngozi Okafor-Bell's notes cover the rest.", "Ngozi Okafor-Bell"),
        ("Write to Aiko Tanaka, who keeps the freezer list.", "Aiko Tanaka"),
    ):
        assert [(k, text[a:b]) for k, a, b in find_personal(text)] == [("person_name", name)]
    for text in ("Samples from the Martin Luther institute were lost.", "Loading Fab on the sensor gave Spearman values.", "Compared with Running Buffer and Kestrow Hall it was weak."):
        assert find_personal(text) == []


def test_numbers_are_validated():
    phones = ("020 7946 0958", "01 99 00 36 21")
    for p in phones:
        assert [(k, a) for k, a, _ in find_personal(f"Call {p} after noon.")] == [("phone", 5)]
    body = "00000019500615251"
    proof = "10X98765432"[sum(int(c) * w for c, w in zip(body, (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), strict=True)) % 11]
    wrong = "0" if proof != "0" else "1"
    assert find_personal(f"Entry {body}{proof} was copied.") != []  # its check digit proves it
    assert find_personal(f"Entry {body}{wrong} was copied.") == []  # neither proof nor caption
    assert find_personal(f"National ID: {body}{wrong} was copied.") != []
    assert find_personal("Passport 000-00-0000 was copied.") == []
    made = pseudonym("id_number", body + proof, b"k")[11:-1]
    assert find_personal(f"Entry {made} was copied.") != [] and made != body + proof


def test_birth_dates_stay_dates(spark):
    df = spark.createDataFrame([(1, "Born on 1961-02-09. Measured 2023-05-01."), (2, "date of birth: 1961-02-09")], "doc_id long, text string")
    rows = {r["doc"]: r["text"] for r in without_personal(df, "doc_id", "text", b"k").collect()}
    date = rows[1].split("[DATE ")[1][:10]
    assert rows[1] == f"Born on [DATE {date}]. Measured 2023-05-01." and rows[2] == f"date of birth: [DATE {date}]" and date != "1961-02-09"
    import datetime

    datetime.date.fromisoformat(date)
