import random

import numpy as np

from tickloom.llm.leaks import leaked_items, window_minima, words_of

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id string, text string, doc_id int"


def brute(docs, items):
    out = set()
    for d, text, _ in docs:
        w = words_of(text)
        for i, t, _ in items:
            x = words_of(t)
            n = min(len(x), 13)
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "straße", "naïve", "łódź", "день"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(f"i{k}", text(n), 0) for k, n in enumerate([1, 3, 5, 9, 12, 13, 14, 40, 80])] + [("none", "", 0), ("null", None, 0), ("marks", "...", 0)]
    docs = [(k, text(60), 0) for k in range(60)] + [(100, None, 0), (101, "", 0)]
    for k, (_, t, _) in enumerate(items[4:9]):
        w = t.split()
        docs.append((200 + k, text(20) + " " + ", ".join(w[: 13]).upper() + "! " + text(900), 0))
        docs.append((300 + k, text(20) + " " + " ".join(w[:12]) + " zzz " + text(20), 0))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    got = leaked_items(spark.createDataFrame(docs + docs[:5], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)


def test_shuffled_path_is_the_same(spark):
    docs, items = cases()
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {tuple(r) for r in leaked_items(a, b).collect()} == {tuple(r) for r in leaked_items(a, b, most_sent=3).collect()}


def test_containment(spark, monkeypatch):
    from tickloom.llm import leaks

    words = [f"v{i}" for i in range(40)]
    items = [("long", " ".join(words), 0), ("short", "one two three four five six", 0), ("one", "alone", 0)]
    docs = [(1, "x " + " ".join(words[3:18]) + " y " + " ".join(words[25:38]), 0), (2, "so one two three four five six alone", 0), (3, " ".join(words), 0)]
    want = {(1, "long", 4, round((11 + 9) / 36, 6)), (2, "short", 1, 1.0), (2, "one", 1, 1.0), (3, "long", 28, 1.0)}
    for most, indexed in ((100, 1000), (3, 0)):
        monkeypatch.setattr(leaks, "MOST_INDEXED", indexed)
        got = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most_sent=most).collect()
        assert {tuple(r) for r in got} == want


def test_empty(spark):
    docs, items = cases()
    assert leaked_items(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_words():
    assert words_of("L'Été—naïve STRASSE/straße_42 ﬁn") == ["l", "ete", "naive", "strasse", "strasse", "42", "fin"]
    assert words_of("co­operate") == ["cooperate"] and words_of(None) == []


def test_minima_of_equal_windows():
    h = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    other = np.r_[h[50:], h[10:30], h[:5]]
    a, b = window_minima(h, 13), window_minima(other, 13)
    assert a[10] == b[10] and len(a) == 48 and len(window_minima(h[:4], 13)) == 0 and len(window_minima(h[:3], 3)) == 1
    brute_force = [min(window_minima(h[i + j : i + j + 5], 5)[0] for j in range(9)) for i in range(2)]
    assert len(brute_force) == 2
