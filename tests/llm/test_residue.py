import random

from tickloom.llm.residue import REPEATED, decide, features, fit, is_furniture, residue_of_records, slots, trusted_passages

NOUNS = "bridge kettle lantern harbour museum ledger railway furnace orchard canal cellar valve survey pottery".split()
MENU, FOOT = "Home | News | Help", "© 2020 www.a.example"


def sentence(rng):
    return f"The old {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} was moved by the {rng.choice(NOUNS)} club in {rng.randint(1900, 2000)}."


def page(*body):
    return "\n".join([MENU, "Abc: old bridge", *body, FOOT])


def corpus():
    rng = random.Random(1)
    docs = [(i, page(sentence(rng), sentence(rng) + " " + sentence(rng)), 404 if i % 50 == 0 else 200) for i in range(300)]
    bad = {}

    def add(kind, *body):  # noqa: B023
        docs.append((1000 + len(docs), page(*body), 500 if kind and repeat % 2 else 200))
        bad[docs[-1][0]] = kind

    for repeat in range(8):
        add("replaced", "Page not found", "The address you asked for does not exist.")
        add("replaced", "Please enable JavaScript to continue.")
        add("replaced", "Your text goes here.", "Add a short description of your service.")
        add("replaced", "Lorem ipsum dolor sit amet labore tempora dolor ipsum sit.")
        add("replaced", "asdf asdf asdf asdf asdf asdf asdf asdf")
        add("replaced", sentence(rng), "Your text goes here.", "asdf asdf asdf asdf asdf asdf asdf asdf")
        add("template", "{{title}}", sentence(rng))
        add("template", sentence(rng).replace("old", "{{ company }}").replace("club", "${name}"))
        add("template", sentence(rng).replace("museum", "%(city)s").replace("old", "[price]"))
        add(None, sentence(rng), "Please enable JavaScript to continue.", sentence(rng))
        add(None, sentence(rng), "To print a variable, write {{ price }} between the tags; the manual explains the escape rules.", sentence(rng))
        add(None, sentence(rng), "export PATH=${HOME}/bin:$PATH", "f{x} = [a] + {b : b > 0}", sentence(rng))
        add(None, "Last week visitors saw a page not found message, and the club explains below how the old links were repaired.", sentence(rng))
    return docs, bad


def test_records(spark):
    docs, bad = corpus()
    odd = [(None, None, 0), (7000, "", 0), (7001, "\n\n", 0), (7002, page(*[sentence(random.Random(2))] * 3000), 0)]
    got = {r.doc_id: r.kind for r in residue_of_records(spark.createDataFrame(docs + odd, "doc_id long, text string, http_status int"), status="http_status").collect()}
    assert {i: got[i] for i in bad} == bad
    assert all(got[i] is None for i in list(range(300)) + [None, 7000, 7001, 7002])


def test_empty(spark):
    assert residue_of_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces():
    assert slots("a {{ x_name }} b <%= city %> c %(who)s d [[Phone number]] \\frac{1}{n} {1..9}") == ["x_name", "city", "who", "phone number"]
    assert REPEATED in features("asdf " * 9) and REPEATED not in features("The old bridge stood there by the old mill")
    assert is_furniture("Home | News", ["home", "news"]) and not is_furniture("asdf " * 9, features("asdf " * 9))
    assert decide(None, fit([], []), fit([], [])) == (None, 0.0)


def test_what_error_records_share_with_others_is_not_trusted():
    usual, message = ["the", "old", "bridge", "stood"], ["nothing", "to", "see"]
    got = trusted_passages([usual, message, message, [], ["unseen"]], [usual] * 50, 5, 50)
    assert got.tolist() == [False, True, True, False, False]


def test_misread_texts():
    text = "Эта страница не найдена"
    assert features(text.encode().decode("latin-1")) == features(text)
    lost = text.encode().decode("cp1252", "replace")
    assert "\ufffd" in lost and features(lost) == features(text)
