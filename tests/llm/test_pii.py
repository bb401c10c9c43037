import re

from tallyforge.llm import pii

KEY = b"k"


def test_detects_kinds():
    text = ("Write to ann.Lee+x@Mail.example.com, call +1 (212) 555-0199 or 555-123-4567; ip 10.1.2.30, card 4111 1111 1111 1111, "
            "GB82 WEST 1234 5698 7654 32, 123-45-6789. Frau Anna Berg met Herr Karl Otto. Berg left, Anna stayed. Version 1.2.3 of 2024.")
    kinds = [k for _, _, k, *_ in pii.detect(text)]
    assert kinds == ["email", "phone", "phone", "ip", "card", "iban", "ssn", "given_f", "surname", "given_m", "surname", "surname", "given_f"]
    assert all(text[a:b] == v for a, b, _, v, _ in pii.detect(text))
    again = "Frau Eva Roth-Klein traf Roth-Klein und Eva-Maria; Roth nicht. Madame été."
    assert [(v, k) for _, _, k, v, _ in pii.detect(again)] == [
        ("Eva", "given_f"), ("Roth-Klein", "surname"), ("Roth-Klein", "surname"), ("Eva", "given_f")]
    assert pii.detect(None) == pii.detect("") == pii.detect("The price is 12.50, order 12345") == []


def test_format_and_script():
    card = pii.surrogate(KEY, "card", "4111111111111111", 0)
    assert len(card) == 16 and card[0] == "4" and pii.luhn(card) == 0
    assert pii.dress("card", "4111 1111 1111 1111", card).count(" ") == 3
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pii.dress("phone", "+1 (212) 555-0199", pii.surrogate(KEY, "phone", "+12125550199", 0)))
    assert re.fullmatch(r"[а-я]+(на|ия)", pii.surrogate(KEY, "given_f", "анна", 0))
    assert re.fullmatch(r"[a-z]+(a|ia|ine)", pii.surrogate(KEY, "given_f", "anna", 0))
    assert re.fullmatch(r"[a-z]+(us|an|ert)", pii.surrogate(KEY, "given_m", "karl", 0))
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d@[a-z]{4}\.com", pii.surrogate(KEY, "email", "ann.lee1@mail.com", 0))
    assert pii.surrogate(KEY, "ip", "10.1.2.3", 0) != pii.surrogate(b"other", "ip", "10.1.2.3", 0)


def test_coreference_and_distinctness(spark):
    rows = [(1, "Frau Anna Berg. Berg rang +1 (212) 555-0199."), (2, "Herr Berg: +1 212-555-0199, A.B@X.org and a.b@x.org"),
            (3, None), (4, ""), (5, "no data"), (5, "no data"), (None, "10.0.0.1 10.0.0.2"), (6, "Berg stays without a title")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as row", "doc_id as rid", "1 as spans", "2 as kind")
    got = {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}
    assert len(pii.pseudonymise(df, KEY).collect()) == len(rows)
    one = re.fullmatch(r"Frau (\w+) (\w+)\. (\w+) rang \+1 \((\d+)\) (\d+)-(\d+)\.", got[1].text)
    two = re.fullmatch(r"Herr (\w+): \+1 (\d+)-(\d+)-(\d+), (\S+) and (\S+)", got[2].text)
    assert one[2] == one[3] == two[1] != "Berg" and one[1] != "Anna"
    assert one.groups()[3:] == two.groups()[1:4]
    assert two[5].lower() == two[6] and two[5][0].isupper()
    assert got[3].text is None and got[4].text == "" and got[5].text == "no data" and got[6].text == rows[-1][1]
    assert got[1].n_entities == 4 and got[5].n_entities == 0
    ips = got[None].text.split()
    assert len(set(ips)) == 2 and not set(ips) & {"10.0.0.1", "10.0.0.2"}
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0


def test_collisions_are_drawn_again(spark):
    # Two digits leave 100 values of which 40 are real: many first draws collide.
    names = [(f"{i:02d}",) for i in range(40)]
    rows = spark.createDataFrame(names, "canonical string").selectExpr("'ssn' as kind", "canonical")
    got = {r.canonical: r.surrogate for r in pii.surrogates(rows, KEY).collect()}
    assert len(got) == len(set(got.values())) == 40 and not set(got) & set(got.values())


def test_digits_of_other_scripts(spark):
    wide = lambda zero, t: "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in t)
    given = ["090-1234-5678", "123-45-6789", "10.1.2.30", "4111 1111 1111 1111", "+819012345678"]
    rows = [(i * 10 + k, f"x {wide(zero, v)} y") for k, zero in enumerate("0\uff10\u0660\u0966\U0001e4f0") for i, v in enumerate(given)]
    rows += [(100, "GB" + wide("\uff10", "82") + " WEST ABCD EFGH"), (101, "mail " + wide("\uff10", "123") + "@-.com")]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for d, t in rows:
        made = got[d].text
        assert got[d].n_entities == 1 and made != t
        if d < 100:
            assert pii.ascii_digits(made) == got[d // 10 * 10].text  # one entity in whatever digits
            digits = [c for c in made if c.isdecimal()]
            zeros = {ord(c) - int(c) for c in digits}
            assert zeros == {ord("0\uff10\u0660\u0966\U0001e4f0"[d % 10])}
    assert pii.surrogate(KEY, "phone", wide("\uff10", "09012345678"), 0) != wide("\uff10", "09012345678")


def test_forms_without_another_draw(spark):
    used_up = [f"{i}@-.com" for i in range(10)]
    texts = ["-@-.com", "_@-.com", "Mr \u00bd\u00b2 left", *used_up]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)
    assert all(re.fullmatch(r"[-_\w]+@-\.com", t) for i, t in enumerate(got) if i != 2) and re.fullmatch(r"Mr \S+ left", got[2])


def test_names_of_any_number_of_words():
    for text, want in [
        ("Frau Dr Anna Schmidt kam.", ["Anna", "Schmidt"]), ("Herr Prof. Karl Otto sah", ["Karl", "Otto"]), ("then Mr J. Smith left", ["J", "Smith"]),
        ("Ms Mary O'Neill's car; O'Neill's", ["Mary", "O'Neill", "O'Neill"]), ("Herr von Braun und Braun", ["Braun", "Braun"]),
        ("so Mr John Fitzgerald Kennedy spoke", ["John", "Fitzgerald", "Kennedy"]), ("hello mr smith, smith", ["smith", "smith"]),
        ("MR SMITH", ["SMITH"]), ("Señora Maria de la Cruz vino", ["Maria", "Cruz"]), ("Mr A. B. van der Berg.", ["A", "B", "Berg"]),
        ("Mr Smith. However", ["Smith"]), ("Dr. Jean-Luc Picard", ["Jean-Luc", "Picard"])]:
        found = pii.detect(text)
        assert [v for *_, v, _ in found] == want, (text, found)
        assert all(text[a:b] == v for a, b, _, v, _ in found)
        assert [k for _, _, k, _, _ in found if k != "initial"][-1] == "surname"


def test_distinct_over_all_kinds(spark):
    """Given names and surnames by the thousand: no surrogate twice, none of them real; a name has one."""
    rows = [(k, f"{a}{b}{c}{d}") for k in ("given_m", "surname") for a in "bdk" for b in "aeiou" for c in "lmnprst" for d in "aeiou"]
    df = spark.createDataFrame([(k, n + ("x" if k == "surname" else "")) for k, n in rows] + [("surname", "bala"), ("initial", "j")], "kind string, canonical string")
    got = [r for r in pii.surrogates(df, KEY).collect() if r.kind != "initial"]
    made = [r.surrogate for r in got]
    assert len(got) == len(rows) == len(set(made)) and not set(made) & {r.canonical for r in got}


def test_corpus_by_brute_force(spark):
    """Detect, replace, and compare: one surrogate per name in all documents, none in clear, none shared."""
    rows = [(i, f"Herr {a} {b} rief {b} an. Frau {b} {c}, {a}!") for i, (a, b, c) in enumerate(
        (x, y, z) for x in ("Karl", "Otto", "Berg") for y in ("Berg", "Olsen", "von Braun") for z in ("Roth-Klein", "O'Neill", "Karl"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, KEY).collect()}
    mapping = {}
    for i, text in rows:
        spans, out, at, shift = pii.detect(text), got[i], 0, 0
        for a, b, _, v, _ in spans:
            rest = text[b:]
            nxt = min((s[0] for s in spans if s[0] >= b), default=len(text))
            between = text[b:nxt]
            start = a + shift
            end = out.index(between, start + 1) if between else len(out)
            mapping.setdefault(v.casefold(), set()).add(out[start:end].casefold())
            shift += (end - start) - (b - a)
    assert all(len(s) == 1 for s in mapping.values()), mapping
    flat = [next(iter(s)) for s in mapping.values()]
    assert len(flat) == len(set(flat)) and not set(flat) & set(mapping)
