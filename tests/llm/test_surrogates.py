"""Surrogates: found entities, formats, bijections, coreference, collisions."""

import re

from linefold.llm import surrogates
from linefold.llm.surrogates import Permutation, Rewriter, collisions, dressed, entities, find, luhn, permuted, pseudonymised, replacement

KEY = b"k"
TEXT = (
    "Mail anna.k@mail7.example.com or ANNA.K@MAIL7.EXAMPLE.COM, call +1 (017) 555-7713 or +1 017 555 7713. Card 4111 1111 1111 1111, "
    'host 97.51.17.173. token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" Frau Keller met Anna Keller; later Keller left. '
    "IBAN DE89370400440532013000, ssn 078-05-1120. Version 1.2.3.4.5 and 2024-01-02 stay."
)


def test_kinds_found():
    kinds = [e.kind for e in find(TEXT)]
    assert kinds.count("email") == 2 and kinds.count("phone") == 2 and kinds.count("person") == 4
    assert {"card", "ip", "secret", "iban", "ssn"} <= set(kinds)
    assert not find("Version 1.2.3.4.5 and 2024-01-02, 12 apples, a-b@c, the token of thanks")


def test_formats_and_coreference():
    new, kinds = Rewriter(KEY, {}).rewrite(TEXT)
    for e in find(TEXT):
        assert TEXT[e.start : e.stop] not in new
    first, second = re.findall(r"[\w.]+@[\w.]+\.com", new, re.I)
    assert first.upper() == second
    assert first.endswith(".example.com")
    one, two = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", new)
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert luhn(re.search(r"Card ([\d ]+),", new).group(1).replace(" ", ""))
    person = re.search(r"Frau (\w+) met (\w+) (\w+); later (\w+) left", new).groups()
    assert person[0] == person[2] == person[3] and person[1] in surrogates.NAMES["latin", "f"] and len(person[0]) == len("Keller")
    assert new.endswith("Version 1.2.3.4.5 and 2024-01-02 stay.") and sum(kinds.values()) == len(find(TEXT))


def test_permutations_have_no_fixed_points():
    for a, b in ((1, 2), (3, 5), (10, 10), (1, 97)):
        out = [Permutation(KEY, "t", a, b)(x) for x in range(a * b)]
        assert sorted(out) == list(range(a * b)) and all(x != y for x, y in enumerate(out))
    digits = {permuted(KEY, "phone", f"{i:03d}") for i in range(1000)}
    assert len(digits) == 1000 and all(len(x) == 3 for x in digits)
    assert permuted(KEY, "x", "--") == "--"


def test_script_case_and_key():
    for name in ("иванов", "παπαδοπουλου", "müller", "王小明"):
        new = permuted(KEY, "person", name)
        assert len(new) == len(name) and new != name
        assert all(surrogates.class_of(a) == surrogates.class_of(b) for a, b in zip(name, new, strict=True))
    assert dressed("vorem", "person", "Anton") == "Vorem" and dressed("vorem", "person", "ANTON") == "VOREM"
    assert replacement(KEY, "ip", "1.2.3.4") != replacement(b"other", "ip", "1.2.3.4")


def test_collisions_are_settled(spark, docs_of, monkeypatch):
    plain = replacement
    same = {"a@b.com", "c@d.com", "e@f.com"}
    monkeypatch.setattr(
        surrogates, "replacement", lambda k, kind, c, n=0: "zzz@z.com" if c in same and n == (0 if c != "e@f.com" else 1) else plain(k, kind, c, n)
    )
    docs = docs_of([(1, "a@b.com c@d.com"), (2, "e@f.com a@b.com")])
    attempts = surrogates.attempts_for(docs, KEY, "text")
    assert attempts == {("email", "c@d.com"): 1}
    assert collisions(entities(docs, KEY, attempts)).count() == 0


def test_table(spark, docs_of, odd_rows):
    rows = [*odd_rows, (9, TEXT), (9, TEXT), (10, "x" * 100_000 + " a@b.org")]
    got = pseudonymised(docs_of(rows).withColumnRenamed("bucket", "kinds"), "key")
    assert got.columns.count("kinds") == 1
    out = got.collect()
    assert len(out) == len(rows)
    assert [r.text for r in out if r.doc_id in (2, 3)] == [None, ""]
    assert len({r.text for r in out if r.doc_id == 9}) == 1
    assert "a@b.org" not in next(r.text for r in out if r.doc_id == 10)
    assert {r.text for r in out if r.n_entities == 0} == {t for i, t in odd_rows}
    assert pseudonymised(docs_of([]), "key").collect() == []


def test_blank_fields_and_other_scripts(spark, docs_of):
    blank = ["Password: ________________", "Password = ................", "token: ----------------"]
    named = {"Dr. محمد": "محمد", "Dr 김철수": "김철수", "Prof. たなか": "たなか", "token: ½½½½½½": "½½½½½½"}
    out = [r.text for r in pseudonymised(docs_of(list(enumerate([*blank, *named]))), "key").orderBy("doc_id").collect()]
    assert out[:3] == blank
    for new, (old, name) in zip(out[3:], named.items(), strict=True):
        assert name not in new and len(new) == len(old)
    for block in range(0x323):
        for c, letters in surrogates.block_classes(block).items():
            assert c in letters and len(letters) > 1


def test_any_number_of_clashes(spark, docs_of, monkeypatch):
    plain = replacement
    monkeypatch.setattr(surrogates, "replacement", lambda k, kind, c, n=0: "zz@z.com" if n < 2 else plain(k, kind, c, n))
    docs = docs_of([(i, f"a{i}@b.com and a{i % 7}@b.com") for i in range(40)] + [(50, None), (51, "none")])
    want = sorted((r.doc_id, r.text or "") for r in pseudonymised(docs, "key").collect())
    monkeypatch.setattr(surrogates, "MOST_CLASHES", 10)
    got = pseudonymised(docs, "key")
    assert got.columns == [*docs.columns, "n_entities", "kinds"]
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == want
    assert len({t.split()[0] for i, t in want if i < 40}) == 40


def test_crowded_lists_find_room(spark, docs_of):
    names = surrogates.NAMES["greek", "m"]
    docs = docs_of([(1, " ".join(f"Κύριος {n}," for n in names))])
    assert collisions(entities(docs, KEY, surrogates.attempts_for(docs, KEY, "text"))).count() == 0
    assert len(replacement(KEY, "person", "νίκος", surrogates.CROWDED + 2)) == len("νίκος") + 2
