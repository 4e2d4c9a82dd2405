"""Leaks of items into documents: edits, markup, order, nulls and hot documents."""

import random

import numpy as np

from tracewright.llm import leakage as K

WORDS = [f"w{i}" for i in range(40)]
ITEM = " ".join(WORDS)


def test_words_of_markup():
    t = "'''Old''' [[Mill Lane|mill]] near{{citation needed}} the <ref name=\"x\">Book, 1</ref>river<!-- no -->&nbsp;and {{quote|it's a [[weir]]}} [[File:x.png|thumb]][[Category:Y]]"
    assert K.words_of(t) == ["old", "mill", "near", "the", "river", "and", "it's", "a", "weir"]


def test_tiles_and_passages():
    items = K.Items([1], [ITEM], 0.4, 3, 3)

    def share(words):
        get = items.vocabulary.get
        at, _, pos = items.hits(np.array([get(w, -1) for w in words], np.int64))
        ts = K.tiles(at, pos, items.seeds[0])
        return K.passage(ts, 3), sum(t[2] for t in ts)

    assert share(WORDS) == (40, 40)
    assert share(["x"] + WORDS[10:26] + ["y"])[0] == 16
    edited = WORDS[:6] + ["zz"] + WORDS[7:12] + WORDS[13:20] + ["new"] + WORDS[20:26]  # changed, dropped, added
    assert share(edited)[0] == 26
    far = WORDS[:10] + ["a", "b", "c", "d"] + WORDS[10:20]
    assert share(far) == (10, 20)
    swapped = WORDS[20:] + WORDS[:20]
    assert share(swapped) == (20, 40)
    assert share(WORDS[:8] * 3) == (8, 8)


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_WORDS", 60)  # several blocks
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choice(["the", "of", "mill", "lane"]) for _ in range(n))
    other = " ".join(f"v{i}" for i in range(40))
    docs = [
        (1, noise(50) + " " + ITEM.upper().replace(" W20", ",\nW20") + " " + noise(50)),
        (2, noise(20) + " " + " ".join(WORDS[:16]) + " " + noise(20)),
        (3, " ".join(WORDS[:12])),
        (4, None),
        (5, ""),
        (6, " ".join(WORDS[20:] + WORDS[:20])),
        (7, noise(200_000) + " " + other),
        (1, ITEM),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(10, ITEM, "q"), (11, other, None), (12, None, None), (13, "", None), (14, "short item", None)], "item_id long, text string, question string")
    got = sorted((r["doc_id"], r["item_id"], r["passage_share"], r["tile_share"]) for r in K.leaks(d, i).collect())
    assert got == [(1, 10, 1.0, 1.0), (1, 10, 1.0, 1.0), (2, 10, 0.4, 0.4), (6, 10, 0.5, 1.0), (7, 11, 1.0, 1.0)]
    assert K.leaks(d.limit(0), i).count() == 0 and K.leaks(d, i.limit(0)).count() == 0


def _longest(doc, item, edits):
    """Brute force: item words from first to last equal word of the longest part within so many edits of a part of the document."""
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] != item[j]:
                continue
            m, n = min(len(doc) - i, len(item) - j + edits), len(item) - j
            row = list(range(n + 1))
            for a in range(1, m + 1):
                prev, row = row, [a] + [0] * n
                for b in range(1, n + 1):
                    same = doc[i + a - 1] == item[j + b - 1]
                    row[b] = min(prev[b - 1] + (not same), prev[b] + 1, row[b - 1] + 1)
                    if same and prev[b - 1] <= edits:
                        best = max(best, b)
    return best


def test_passage_is_exact(spark):
    """Short runs between changed words, and passages whose item words a longer quote elsewhere has marked, count in full."""
    close = WORDS[:6] + ["a"] + WORDS[7:8] + ["b"] + WORDS[9:18]  # two changes with one word between them
    twice = WORDS[10:30] + ["x"] * 9 + WORDS[3:9] + ["y"] + WORDS[10:14] + ["z"] + WORDS[15:24]
    rng = random.Random(8)
    docs = [close, twice, WORDS[:5] + ["a", "b"] + WORDS[5:9] + ["c"] + WORDS[10:17]]
    for _ in range(40):
        w = list(WORDS[(s := rng.randrange(15)) : s + rng.randrange(16, 26)])
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(["q", *WORDS])] * rng.randrange(2)
        docs.append(["x"] * rng.randrange(4) + w + rng.choices(WORDS, k=rng.randrange(6)))
    want = {i: n / 40 for i, d in enumerate(docs) if (n := _longest(d, WORDS, 3)) >= 16}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["passage_share"] for r in K.leaks(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() if r["passage_share"] >= 0.4}
    assert got == want and {0, 2} <= set(want)


def _shares(docs, items):
    block = K.Items(list(items), list(items.values()), 0.4, 3, 3)
    get = block.vocabulary.get
    coded = [np.array([*(get(w, -1) for w in K.words_of(d)), -1], np.int64) for d in docs]
    return {(r, k): (p, t) for r, k, p, t in K._found(block, coded)}


def test_pieces_in_any_order_give_a_row():
    """Reordered quotations of at least two fifths in pieces of a tile's length are all found, whatever their number and size."""
    words = [f"w{i}" for i in range(60)]
    rng, docs, want = random.Random(4), [], 0
    for size in (3, 4, 5, 8):
        for n in range(1, 60 // size + 1):
            for _ in range(3):
                starts = [size * i for i in rng.sample(range(60 // size), n)]
                docs.append(" x y ".join(" ".join(words[s : s + size]) for s in starts))
                want += n * size >= 24
    got = _shares(docs, {1: " ".join(words)})
    assert all(t * 60 >= sum(w[0] == "w" for w in d.split()) for (r, _), (_, t) in got.items() for d in [docs[r]])
    assert len(got) == want  # recall 1


def test_items_do_not_change_each_other():
    """A short item shortens its own seeds only."""
    rng = random.Random(5)
    long = {k: " ".join(rng.choice([f"a{i}" for i in range(30)]) for _ in range(60)) for k in range(5)}
    docs = [" ".join(rng.choice([f"a{i}" for i in range(30)] + ["q"]) for _ in range(300)) for _ in range(10)]
    docs += [" zz ".join(long[2].split()[::2])] + [long[3]]  # scattered single words are no leak
    alone = _shares(docs, long)
    mixed = _shares(docs, {**long, 9: "a1 a2 a3 a4 a5 a6 a7 a8 a9 b0"})
    assert {k: v for k, v in mixed.items() if k[1] != 9} == alone and (11, 3) in alone and (10, 2) not in alone


def test_no_hits():
    none = np.zeros(0, np.int64)
    assert K.tiles(none, none, 3) == [] and K.extent([], [], none, none, 3, 3) == 0
    assert _shares(["", "x"], {1: "a b c"}) == {} and _shares(["a b"], {}) == {}
    assert K.words_of("STRASSE l’eau") == K.words_of("straße l'eau")


def test_passages_in_notes_and_captions(spark):
    """A note does not break the passage around it, and a passage inside one is found."""
    docs = [
        (1, " ".join(WORDS[:10]) + "<ref>" + " ".join(f"r{i}" for i in range(9)) + "</ref> " + " ".join(WORDS[10:20])),
        (2, "x <ref name=\"n\">" + " ".join(WORDS[5:25]) + "</ref> y"),
        (3, "[[File:x.png|thumb|" + " ".join(WORDS[:16]) + "]] <!-- " + " ".join(WORDS[20:24]) + " -->"),
        (4, "<ref>" + " ".join(WORDS[:8]) + "</ref> a <ref>" + " ".join(WORDS[8:15]) + "</ref>"),  # two notes are no one passage
    ]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r["doc_id"]: r["passage_share"] for r in K.leaks(d, i).collect() if r["passage_share"] >= 0.4}
    assert got == {1: 0.5, 2: 0.5, 3: 0.4}
