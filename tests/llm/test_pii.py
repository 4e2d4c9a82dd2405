"""Personal information: held-out accuracy on generated texts, exact round trips and edge cases."""

import random

import pytest

from tracewright.llm import pii

GIVEN = ["Torvin", "Maresh", "Odalie", "Cessily", "Dorrek", "Fenric", "Liora", "Nerissa", "Osric", "Quilla", "Runa", "Tamsin", "Vesna", "Yorick"]
FAMILY = [a + b for a in ("Bel", "Cor", "Dun", "Gar", "Kol", "Lam", "Mar", "Nev", "Sten", "Thor") for b in ("calby", "densen", "hesmann", "lanwick", "merell", "vikski")]
NOUNS = ["lantern", "canal", "summit", "moat", "orchard", "mill", "granary", "tower"]


def line(rng, given, family):
    g, f = rng.choice(given), rng.choice(family)
    name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {rng.choice('ABCDE')}. {f}", f"{g} {f}".upper()])
    noun = rng.choice(NOUNS)
    num = "".join(rng.choice("0123456789") for _ in range(10))
    phone = rng.choice([f"+999-{num[:3]}-{num[3:6]}-{num[6:]}", f"({num[:3]}) {num[3:6]}-{num[6:]}", f"{num[:3]}.{num[3:6]}.{num[6:]}"])
    ident = rng.choice([f"QQ{num[:6]}A", f"X{num[:7]}-M"])
    place = rng.choice(["Mill", "Ash", "Raven"]) + rng.choice(["gate", "ford", "burn"])
    street = f"{rng.randrange(1, 200)} {place} {rng.choice(['Lane', 'Road', 'Street'])}"
    mail = f"{f.lower()}_{g[0].lower()}{rng.randrange(99)}@mail.example"
    return rng.choice(
        [
            (f"The {noun} was photographed by {name} in 1971.", {(name, "NAME")}),
            (f"I am {name}, passport {ident}, and I want this page about the {noun} removed.", {(name, "NAME"), (ident, "ID_NUMBER")}),
            (f"* post: {street}", {(street, "ADDRESS")}),
            (f"Tel: {phone} / {mail}", {(phone, "PHONE"), (mail, "EMAIL")}),
            (f"{place} {noun.title()} railway station has 4 platforms and opened in 1870.", set()),
            (f"Each {noun} feeds one {rng.choice(NOUNS)}. It was built by {place[:4]} & Dun Ltd in 1888. ISBN 978-0-{num[:3]}-{num[3:8]}-7", set()),
        ]
    )


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    known_f = FAMILY[::2] + FAMILY[1::4]
    return pii.fit([line(rng, GIVEN, FAMILY)[0] for _ in range(2500)], set(GIVEN[:10]), set(known_f))


def test_held_out_accuracy(model):
    rng = random.Random(2)
    hit = said = true = 0
    for _ in range(1200):
        text, want = line(rng, GIVEN, FAMILY)
        got = {(text[a:b], k) for a, b, k in pii.find(text, *model)}
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    assert hit / said > 0.97 and hit / true > 0.95


def test_decoding_is_the_best_of_all_choices(model):
    rng = random.Random(3)
    weights = model[1]
    for _ in range(40):
        text, _ = line(rng, GIVEN, FAMILY)
        found = pii.candidates(text, model[0])
        for group in pii.clusters(found):
            if len(group) > 12:
                continue
            best = 0.0
            for bits in range(1 << len(group)):
                some = [group[i] for i in range(len(group)) if bits >> i & 1]
                spans = sorted(found[i][:2] for i in some)
                if all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)):
                    best = max(best, sum(sum(weights.get(f, 0.0) for f in found[i][3]) for i in some))
            got = sum(sum(weights.get(f, 0.0) for f in found[i][3]) for i in pii.decode(found, group, weights))
            assert got == pytest.approx(best)
            m = pii.marginals(found, group, weights)
            assert all(-1e-9 <= p <= 1 + 1e-9 for p in m)


def test_detect_and_redact(spark, model):
    text = "Tel: (123) 456-7890 / corcalby_t7@mail.example\nThe mill was photographed by Torvin Corcalby in 1971."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (4, "x" * 200_000), (1, text)], "doc_id long, text string")
    got = {tuple(r) for r in pii.detect(docs, model).collect()}
    want = {("PHONE", "(123) 456-7890"), ("EMAIL", "corcalby_t7@mail.example"), ("NAME", "Torvin Corcalby")}
    assert got == {(k, *w) for k in (1, None) for w in want}
    red = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert red[1] == "Tel: [PHONE] / [EMAIL]\nThe mill was photographed by [NAME] in 1971." and red[2] is None and red[3] == "" and len(red[4]) == 200_000
    assert pii.detect(docs.limit(0), model).count() == 0


def test_fit_without_any_evidence():
    lex, weights = pii.fit([], set(), set())
    assert pii.find("Call 555 010 0199 or a@b.example", lex, weights) == []


def test_ordinary_words_of_all_documents(spark):
    """Words in lower case count wherever they occur, not only in the sampled documents."""
    docs = spark.createDataFrame([(i, f"Anna {w.title()} came") for i, w in enumerate(["miller", "baker", "stone"] * 20)] + [(100, "the baker ate"), (101, "a stone fell"), (102, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("anna", "given"), ("miller", "family")], "name_part string, part_kind string")
    assert pii.train(docs, lexicon, docs=1)[0].ordinary == {"baker", "stone"}


def letter(rng, given, family):
    """A kind of text the model has not seen: correspondence instead of encyclopedia pages."""
    g, f = rng.choice(given), rng.choice(family)
    name = rng.choice([f"{g} {f}", f"{g[0]}. {f}"])
    num = "".join(rng.choice("0123456789") for _ in range(10))
    phone = rng.choice([f"+999-{num[:3]}-{num[3:6]}-{num[6:]}", f"({num[:3]}) {num[3:6]}-{num[6:]}"])
    mail = f"{g.lower()}.{f.lower()}@post.example"
    street = f"{rng.randrange(1, 99)} {rng.choice(['Harbour', 'Cedar', 'Quarry'])} {rng.choice(['Road', 'Lane', 'Avenue'])}"
    return rng.choice(
        [
            (f"Dear Mr {name}, thank you for your letter of 3 May.", {(name, "NAME")}),
            (f"Please reach {name} at {mail} before Friday.", {(name, "NAME"), (mail, "EMAIL")}),
            (f"Our driver will collect it from {street} tomorrow; mobile {phone}.", {(street, "ADDRESS"), (phone, "PHONE")}),
            (f"We enclose invoice 20{num[:2]}/{num[2:5]} for 3 crates and 12 boxes.", set()),
            (f"Signed on behalf of the board by {name} in 1998.", {(name, "NAME")}),
        ]
    )


def test_text_of_another_kind(model):
    rng = random.Random(9)
    hit = said = true = 0
    for _ in range(800):
        text, want = letter(rng, GIVEN, FAMILY)
        got = {(text[a:b], k) for a, b, k in pii.find(text, *model)}
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    # Invoice numbers are taken for identity numbers: nothing like them was in the training text.
    assert hit / true >= 0.9 and hit / said >= 0.8


def test_long_names_are_candidates(model):
    text = "It was built by Jan van der Berg and Maria de la Cruz Ortega Lopez in 1901."
    spans = {text[a:b] for a, b, kind, _ in pii.candidates(text, model[0]) if kind == "NAME"}
    assert {"Jan van der Berg", "Maria de la Cruz", "Maria de la Cruz Ortega Lopez"} <= spans


def test_lexicon_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON", 1)
    docs, lex = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([("a", "given"), ("b", "given")], "name_part string, part_kind string")
    with pytest.raises(ValueError):
        pii.train(docs, lex)
