import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii
from quarry.llm.pii import _luhn, _replaced, find, normal, permute, replace, surrogate

KEY = b"k"
TEXT = (
    'Write to ann.12@mail3.example.com or ANN.12@mail3.example.com. Call +1 (852) 555-4544 or (852) 555-4544, from 153.207.106.222; card 4111 1111 1111 1111, '
    '4963198541998638, token = "2e78d4bdec68f18b395a94d7e68821fb27738004", TOKEN = "2E78D4BDEC68F18B395A94D7E68821FB27738004"!! SSN 123-45-6789, GB82 WEST 1234 5698 7654 32. '
    "Mrs. Maria Lopez met Mr Lopez and Dr. Ørsted; Господин Иванов and Κυρία Παπά. Licensed under CC BY-NC 4.0, version 3.0.1 of 2019-03-04."
)


def swap(text, key=KEY, draws=None):
    import pyarrow as pa

    (out,) = _replaced([pa.record_batch([pa.array([text], pa.string())], names=["text"])], key, draws or {}, 0)
    return out.column(0)[0].as_py()


def test_finds():
    assert [(TEXT[s:e], k) for s, e, k, _ in find(TEXT)] == [
        ("ann.12@mail3.example.com", "email"), ("ANN.12@mail3.example.com", "email"), ("+1 (852) 555-4544", "phone"), ("(852) 555-4544", "phone"),
        ("153.207.106.222", "ip"), ("4111 1111 1111 1111", "card"), ("4963198541998638", "card"), ("2e78d4bdec68f18b395a94d7e68821fb27738004", "secret"),
        ("2E78D4BDEC68F18B395A94D7E68821FB27738004", "secret"), ("123-45-6789", "ssn"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("Maria Lopez", "name"),
        ("Lopez", "name"), ("Ørsted", "name"), ("Иванов", "name"), ("Παπά", "name"),
    ]
    assert [k for *_, k, _ in find("+1 (843) 555-7672 170.106.47.218 and +1 (826) 555-4081 9630123412341234")] == ["phone", "ip", "phone", "card"]
    more = "Call 020 7946 0958 or (030) 123 4567 from 2001:db8::1 or FE80:0:0:0:1:2:3:4; password: correcthorsebattery; Mr 田中 太郎, Herr Šimek and Dr. Łukasz Nowak. 田中 太郎 left; Nowak said so, Nowakowa didn't."
    assert [(more[s:e], k) for s, e, k, _ in find(more)] == [
        ("020 7946 0958", "phone"), ("(030) 123 4567", "phone"), ("2001:db8::1", "ip6"), ("FE80:0:0:0:1:2:3:4", "ip6"), ("correcthorsebattery", "secret"), ("田中 太郎", "name"), ("Šimek", "name"),
        ("Łukasz Nowak", "name"), ("田中 太郎", "name"), ("Nowak", "name"),
    ]
    assert find("at 12:30:45, std::vector a::b, 01 02 2024, the password: required field, and 0.5 0 1 2") == []
    assert find("a plain text of 12 words, 3.14 and 2019, 1,000,000 or 10.5") == []


def test_surrogates_keep_type_and_coreference():
    out = swap(TEXT)
    assert [(k, c) for _, _, k, c in find(out)] == [(k, c) for _, _, k, c in find(TEXT)]
    old, new = ([t[s:e] for s, e, _, _ in find(t)] for t in (TEXT, out))
    assert not set(old) & set(new)
    assert [re.sub(r"\d", "0", x) for x in new[2:4]] == ["+0 (000) 000-0000", "(000) 000-0000"] and new[2].startswith("+1 ")
    assert new[1].lower() == new[0] and new[8].lower() == new[7] and new[8] == new[8].upper()
    assert _luhn(new[5].replace(" ", "")[:-1]) == new[5][-1] and (_luhn(new[6][:-1]) == new[6][-1]) == (_luhn(old[6][:-1]) == old[6][-1])
    assert int("".join(str(int(c, 36)) for c in (new[10][4:] + new[10][:4]).replace(" ", ""))) % 97 == 1
    assert new[11].split()[1] == new[12] and new[11].split()[0].split("-")[0] in pii.GIVEN["latin", "f"]
    assert re.fullmatch("[А-я]+", new[14]) and re.fullmatch("[Α-ω]+", new[15])
    assert re.sub("|".join(map(re.escape, sorted(old, key=len, reverse=True))), "#", TEXT) == re.sub("|".join(map(re.escape, sorted(new, key=len, reverse=True))), "#", out)
    assert swap(TEXT, b"other") != out and swap(TEXT) == out


@pytest.mark.parametrize("bases", [[7], [3, 5], [10, 10, 10], [2, 3, 2, 4], [256, 2]])
def test_permutation_is_one(bases):
    import itertools

    words = list(itertools.product(*map(range, bases)))
    assert len({tuple(permute(KEY, "t", list(w), bases)) for w in words}) == len(words)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["a@b.co", "10.0.0.1", "4111111111111111", "+44 20 7946 0958"]))
def test_any_text(text, entity):
    out = swap(f"{text} {entity} {text}")
    assert entity not in out.replace(text, "") or entity in text
    assert len(find(out)) >= 1


def test_operator_and_collisions(spark, monkeypatch):
    # Small spaces force collisions: two letters of addresses, and names of one syllable.
    monkeypatch.setattr(pii, "SYLLABLES", {**pii.SYLLABLES, "latin": ("bd", "ae")})
    names = [f"Mr {a}{b}" for a in ("Kim", "Lee", "Ono", "Sato") for b in ("", "son", "ton", "ley")]
    rows = [(i, f"{n} and 10.0.0.{i % 4}", 5, "x") for i, n in enumerate(names)] + [(1, None, 5, "x"), (1, "", 5, None), (None, TEXT, 5, None), (None, TEXT, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int, kind string")
    got = replace(df, KEY).collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"x", None}
    assert [r.text for r in got if r.doc_id == 1 and r.n_entities == 0] == [None, ""]
    assert len({r.text for r in got if r.doc_id is None}) == 1
    made = [r.text.split(" and ")[0] for r in got if r.kind == "x" and r.text]
    assert len(set(made)) == len(names) and not set(made) & set(names)
    assert replace(df.limit(0), KEY).collect() == []


def test_documents_hold_none_of_their_entities(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {r.doc_id: r for r in replace(docs.select("doc_id", "text"), KEY).collect()}
    old = set()
    for r in docs.collect():
        got = find(r.text)
        assert new[r.doc_id].n_entities == len(got)
        old |= {(k, normal(k, r.text[s:e], c)) for s, e, k, c in got}
        if not got:
            assert new[r.doc_id].text == r.text
    assert old and not old & {(k, normal(k, r.text[s:e], c)) for r in new.values() for s, e, k, c in find(r.text)}


def crowd(spark):
    names = [f"Mr {a}{b}{c}" for a in ("Kim", "Lee", "Ono", "Sato", "Bel", "Cho", "Dan") for b in ("a", "e") for c in ("son", "ton", "ley", "man")]
    return names, spark.createDataFrame([(i, f"{n} and Mr Kimason") for i, n in enumerate(names)] + [(None, None)], "doc_id long, text string")


@pytest.mark.parametrize("most", [pii.MAX_DRAWS, 3])
def test_draws_until_none_collides(spark, monkeypatch, most):
    # 56 names and 64 surrogates: more than four rounds.
    monkeypatch.setattr(pii, "SYLLABLES", {**pii.SYLLABLES, "latin": ("bd", "a")})
    monkeypatch.setattr(pii, "MAX_DRAWS", most)
    monkeypatch.setattr(pii, "STUCK", 60)
    names, df = crowd(spark)
    got = {r.doc_id: r for r in replace(df, KEY).collect()}
    made = [got[i].text.split(" and ") for i in range(len(names))]
    assert len({m for m, _ in made}) == len(names) and not {m for m, _ in made} & set(names)
    assert {k for _, k in made} == {made[names.index("Mr Kimason")][0]} and got[None].text is None and got[0].n_entities == 2


def test_full_space_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {**pii.SYLLABLES, "latin": ("b", "a")})
    with pytest.raises(ValueError, match="collide"):
        replace(crowd(spark)[1], KEY)


def test_names_keep_one_surrogate(spark):
    women = ["Anna Kowal", "Maria Lopez", "Ruth Adler", "Ines Prado", "Vera Lind"]
    rows = [(i, f"{t} {n} spoke. Later {n.split()[1]} left, and {n} wrote.") for n in women for i, t in enumerate(("Mrs", "Dr.", "Prof", "Ms"))] + [(9, "Dr Kim Sol spoke. Sol left.")]
    got = replace(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), KEY).collect()
    by_text = {}
    for r in got:
        name = re.match(r"(?:Mrs|Ms|Dr\.?|Prof) (\S+ \S+) spoke\. Later (\S+) left, and (\S+ \S+) wrote\.", r.text)
        if name:
            assert name[1] == name[3] and name[1].split()[1] == name[2] and r.n_entities == 3
            by_text.setdefault(name[1], 0)
            by_text[name[1]] += 1
            assert name[1].split("-")[0] in pii.GIVEN["latin", "f"]
    assert sorted(by_text.values()) == [4] * 5
    last = next(r.text for r in got if r.doc_id == 9)
    assert re.fullmatch(r"Dr \S+ (\S+) spoke\. \1 left\.", last)


def test_short_addresses_keep_their_form():
    a, b = swap("2001:db8::1"), swap("2001:0db8:0:0:0:0:0:1")
    assert "::" in a and "::" not in b and normal("ip6", a) == normal("ip6", b) != normal("ip6", "2001:db8::1")
