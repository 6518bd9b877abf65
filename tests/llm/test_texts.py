import random
from collections import Counter

import pytest

from siftspark.functions.words import words
from siftspark.llm import neardup, pii

WORDS = [f"w{i}" for i in range(400)]


def similar(p, q):
    x, y = Counter(words(p)), Counter(words(q))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        base = [rng.choice(WORDS) for _ in range(80)] + ["the", "a", "of"] * 8
        rng.shuffle(base)
        texts.append(" ".join(base))
        if i % 3 == 0:
            edited = list(base)
            for _ in range(rng.randint(0, 14)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            rng.shuffle(edited)
            texts.append(" ".join(edited).upper() + "!")
    return texts


def test_near_pairs_against_brute_force(spark):
    texts = corpus()
    rows = [(f"p{i:04d}", t) for i, t in enumerate(texts)]
    rows += [(f"c{i:03d}", texts[0]) for i in range(30)] + [("n1", None), ("n2", ""), ("n3", "too short"), ("n4", "x " * 50_000)]
    df = spark.createDataFrame(rows, "id string, text string")
    pairs, classes = neardup.near_pairs(df, 0.7, 30)
    got = {(r["x"], r["y"]) for r in neardup.expanded(pairs, classes, "x", "y").collect()}
    long = [(k, t) for k, t in rows if len(words(t)) >= 30 and k != "n4"]
    want = {tuple(sorted((k, m))) for i, (k, t) in enumerate(long) for m, u in long[i + 1 :] if similar(t, u) >= 0.7}
    assert got <= want and len(got) >= 0.97 * len(want)
    copies = {r["id"] for r in classes.filter("rep = 'c000'").collect()}
    assert copies >= {f"c{i:03d}" for i in range(30)} | {"p0000"}


def test_near_pairs_with_more_texts_than_are_broadcast(spark):
    base = [[f"w{i}x{j}" for j in range(40)] for i in range(30)]
    rows = [(f"a{i}", " ".join(b)) for i, b in enumerate(base)] + [(f"b{i}", " ".join(b[:38] + ["y", "z"])) for i, b in enumerate(base[:20])]
    pairs, _ = neardup.near_pairs(spark.createDataFrame(rows, "id string, text string"), 0.7, 30, most_docs=5)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted((f"a{i}", f"b{i}") for i in range(20))


def test_near_pairs_of_nothing(spark):
    pairs, classes = neardup.near_pairs(spark.createDataFrame([("a", None)], "id string, text string"), 0.7, 30)
    assert pairs.count() == 0 and classes.count() == 0


def test_similarity_counts_repeated_words():
    assert neardup.similarity("a a b", "A, a; a c") == pytest.approx(2 / 5)
    assert neardup.similarity("", "...") == 0.0


FORMS = {("email", f) for f in ("veiled", "spoken", "shouted", "worded")} | {("phone", f) for f in ("area", "ten", "mobile", "zero")} | {("street_address", f) for f in ("short", "lower", "number last", "led")}
KNOWN = pii.Knowledge(forms=FORMS, given={"lena", "hugo"}, family={"umbsgaard", "pellarro"}, words={"the", "phone", "street"}, streets=({"fenholt"}, {"main"}), patterns={"my cell": "phone"}, last_words={"ssn": "id_number"}, shapes={"999999999": "id_number"})


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to lena_umbsgaard@harrowby.test today", ["email"]),
        ("lucas+inbox (at) oakpost dot example", ["email"]),
        ("ANNA.X [AT] BROOK [DOT] EXAMPLE", ["email"]),
        ("ping @junzen_team, set user@local scope", []),
        ("call (728) 555-0198 or +49 (0)30 23125-659", ["phone", "phone"]),
        ("my cell 4165550156", ["phone"]),
        ("Order 396-368-886, build 202427.452, since 2024-05-21, job id 7839549256", []),
        ("ssn 906-55-9804; for him ssn 951059878; QQ 10 42 11 C; X25T14919; 34/916/12937", ["id_number"] * 5),
        ("We are at 949 Umbermere Avenue, Thistleley 49554.", ["street_address"]),
        ("12 fenholt street and Weirhollower Str. 40", ["street_address"] * 2),
        ("Main Street shops, 9 Main Street, 12 Drive folders, 991 options for the court", []),
        ("Lena Umbsgaard, PELLARRO, HUGO, hugo m. pellarro, L. Umbsgaard-Pellarro", ["person_name"] * 4),
        ("Lena is here; Tabport Plilio and June Preview; @lena_umbsgaard", []),
        ("", []),
    ],
)
def test_find(text, kinds):
    spans = pii.find(text, KNOWN)
    assert [k for _, _, k in spans] == kinds
    shown = pii.masked(text, spans)
    kept = text
    for a, b, kind in reversed(spans):
        kept = kept[:a] + f"[{kind.upper()}]" + kept[b:]
    assert shown == kept


def test_names_and_patterns_are_learned_from_the_corpus(spark):
    families = ["Umbsgaard", "Pellarro", "Draxwyn", "Karlfield", "Hestmira"]
    rows = [f"mail lena_{f.lower()}@harrowby.test or hugo.{f.lower()}@oak.example" for f in families[:3]]
    rows += [f"Thanks to {g} {f} for it" for g in ("Lena", "Hugo", "Oriel") for f in families]
    rows += [f"reach me on the cell +49 212 5551{i:02d} now" for i in range(12)] + ["reach me on the cell 2125550142", "reach me on the cell 2125550143", "reach me on the cell 2125550144", "the job 2125550199", None, ""]
    known = pii.learn(spark.createDataFrame([(r, 1) for r in rows], "text string, extra int"))
    assert {"lena", "hugo", "oriel"} <= known.given and {f.lower() for f in families} <= known.family
    assert [k for _, _, k in pii.find("reach me on the cell 2125550142, ORIEL HESTMIRA", known)] == ["phone", "person_name"]


def test_instances_found_confirm_patterns_without_seeds(spark):
    rows = [f"reach me on the cell +49 212 5551{i:02d} now" for i in range(12)]
    rows += [f"reach me on the cell 21255501{i}" for i in range(42, 46)]
    rows += [f"my handset ring 21255501{i} please" for i in range(42, 46)] + ["my handset ring 21 255 50 777 please"]
    rows += [f"take job {i}125550199 off" for i in range(2, 8)] + ["again 2125550143"]
    known = pii.learn(spark.createDataFrame([(r,) for r in rows], "text string"))
    kinds = lambda text: [k for _, _, k in pii.find(text, known)]
    assert kinds("my handset ring 21 255 50 777 please") == ["phone"]
    assert kinds("again 2125550143") == ["phone"]
    assert kinds("take job 3125550199 off") == []


def test_forms_are_hypotheses_that_the_corpus_confirms(spark):
    rows = [f"please write to ann.b{i}@harrowby.test now" for i in range(5)] + [f"please write to bob{i} (at) oak dot example now" for i in range(4)]
    rows += [f"reach me on the cell +49 30 2312{i}65 now" for i in range(5)] + [f"reach me on the cell 0{i}30/231256 now" for i in range(2, 6)]
    rows += [f"see part (21{i}) 555-0198 here" for i in range(9)] + [f"we moved to {i} Umber Avenue" for i in range(3, 8)] + [f"we moved to {i} Fen Rd" for i in range(3, 8)]
    known = pii.learn(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert known.forms == {("email", "veiled"), ("phone", "zero"), ("street_address", "short")}
    kinds = lambda text, k: [x for _, _, x in pii.find(text, k)]
    for text, kind in (("Zoe (at) elm dot example", "email"), ("hm, 0841/123456", "phone"), ("up 9 Oak Rd", "street_address")):
        assert kinds(text, known) == [kind] and kinds(text, pii.Knowledge()) == []
    assert kinds("odd (212) 555-0198", known) == []


def test_what_is_found_rests_on_what_was_learned(spark):
    from siftspark.llm import queries

    fields = queries._post_fields(spark, "/root/testdata/sf0.01")
    found = lambda known: {(r["id"], r["field"], k) for r in pii.masked_texts(fields, known).filter("size(kinds) > 0").collect() for k in r["kinds"]}
    learned = found(pii.learn(fields))
    assert len(learned & found(pii.Knowledge())) <= 0.7 * len(learned)


def test_long_mailboxes_and_streets_are_found_whole():
    local, domain = "a" * 300, ".".join(["d" * 60] * 6)
    text = f"x {local}@{domain}.test and {local} [at] {domain} [dot] test, {'G' * 90}straße 40"
    assert [text[a:b] for a, b, _ in pii.find(text, KNOWN)] == [f"{local}@{domain}.test", f"{local} [at] {domain} [dot] test", f"{'G' * 90}straße 40"]
    assert pii.find("@ " * 30_000 + "a@" * 20_000, KNOWN) == []


def test_masked_texts_keep_nulls(spark):
    df = spark.createDataFrame([("1", "title", None, "x"), ("2", "body", "", "x"), ("3", "body", "see a.b@c.test", "x")], "id string, field string, text string, masked string")
    got = {r["id"]: (r["kinds"], r["masked"]) for r in pii.masked_texts(df, KNOWN).collect()}
    assert got == {"1": ([], None), "2": ([], ""), "3": (["email"], "see [EMAIL]")}


def test_all_names_are_looked_up_however_many_there_are(spark, monkeypatch):
    families = ["Umbsgaard", "Pellarro", "Draxwyn", "Karlfield", "Zestmira"]
    texts = [f"mail lena_{f.lower()}@harrowby.test or hugo.{f.lower()}@oak.example" for f in families[:3]]
    texts += [f"Thanks to {g} {f} for it" for g in ("Lena", "Hugo", "Zoriel") for f in families] + ["ZORIEL ZESTMIRA", "9 Main Street", "", None]
    texts += [f"reach me on the cell +49 212 5551{i:02d} now" for i in range(12)] + [f"reach me on the cell 212555014{i}" for i in range(4)]
    df = spark.createDataFrame([(str(i), "body", t) for i, t in enumerate(texts)], "id string, field string, text string")
    results = []
    for most in (10**6, 2):
        monkeypatch.setattr(pii, "LEXICON", most)
        monkeypatch.setattr(pii, "BLOCK", 7, raising=False)
        results.append({r["id"]: (r["kinds"], r["masked"]) for r in pii.masked_texts(df, pii.learn(df)).collect()})
    assert results[0] == results[1] and len(results[0]) == len(texts)
    assert results[1]["18"] == (["person_name"], "[PERSON_NAME]")


def test_a_word_is_rare_by_the_size_of_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(pii, "RARE", 0.01, raising=False)
    rows = [f"mail lena_{f}@harrowby.test, hugo.{f}@oak.example" for f in ("umbsgaard", "pellarro")]
    rows += ["they met lena zestmira", *["the zestmira came"] * 5, "plain words " * 500]
    known = pii.learn(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert [k for _, _, k in pii.find("they met lena zestmira", known)] == ["person_name"]
    assert "plain" in known.words and pii.find("they met lena plain", known) == []
