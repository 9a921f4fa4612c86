import re

import pyarrow.parquet as pq

from lumenframe.llm import decontaminate as D

ITEM = "Anna bought 5 apples and 3 pears for 12 dollars at the old market near the river. How many fruits did Anna carry home after she gave 5 apples to her friend?"
VARIANT = "Peter bought 9 apples and 4 pears for 20 dollars at the old market near the river. How many fruits did Peter carry home after she gave 9 apples to her friend?"
MIXED = "Peter bought 9 apples and 4 pears for 20 dollars at the old market near the river. How many fruits did Klaus carry home after she gave 7 apples to her friend?"


def found(spark, texts, items, **settings):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.find(docs, bench, **settings).collect()}


def test_slots(spark):
    got = found(spark, [f"some words {ITEM} more words", f"other {VARIANT} end", f"other {MIXED} end", "the old market near the river", None, ""], [ITEM, None, ""])
    assert set(got) == {(0, 0), (1, 0)} and not got[1, 0].verbatim and got[1, 0].slot_agreement == 1.0


def test_units_and_numbers_are_placeholders():
    a, b = (D.Canon() for _ in range(2))
    import numpy as np

    one = D.canonical(np.array([a[t] for t in D.tokens_of("drove 5km in 2 hours")], np.uint64), np.zeros(1, np.int64))
    two = D.canonical(np.array([b[t] for t in D.tokens_of("drove 70 miles in twenty min")], np.uint64), np.zeros(1, np.int64))
    assert one[1].tolist() == [0, 1, 2, 0, 1, 2] and (one[0] == two[0]).all()


def test_all_documents_against_plain_search(spark):
    from lumenframe.llm.queries import op10

    sf = "/root/testdata/sf0.1"
    got = {(r.doc_id, r.item_id) for r in op10(spark, sf).collect()}
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()}
    texts = {r["doc_id"]: plain(r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert got == want and len(want) > 200


def test_blocks_of_a_larger_benchmark_and_short_items(spark):
    items = [ITEM, "What is the capital city", "short one", VARIANT.replace("market", "bridge")]
    texts = [f"x {t} y" for t in items] + ["nothing of the kind is in here at all"]
    assert set(found(spark, texts, items, most_windows=5)) == set(found(spark, texts, items)) >= {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_windows_do_not_cross_documents(spark):
    assert not found(spark, ["the quick brown fox", "jumps over lazy dogs today"], ["quick brown fox jumps over lazy dogs"])


def test_cleaning_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, f"a {ITEM}", 0), (1, "other row", 0), (2, "clean", 0), (None, "no id", 0), (3, "word " * 200_000 + ITEM, 0)], "doc_id long, text string, coverage int")
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id long, text string")
    assert sorted(r.text for r in D.clean(docs, bench).collect()) == ["clean", "no id", "other row"]
    assert D.find(docs, bench).count() == 4
    assert D.clean(docs, bench.limit(0)).count() == 5 and D.find(docs.limit(0), bench).count() == 0


CITY = "Paris is where the long train journey begins each morning, and Rome is where it ends. How many hours does a slow train need from Paris to Rome if 20 stops of 5 minutes are made on the way? Rome is far from Paris."
FARM = "A farmer has 20 cows in the barn and 5 of them give no milk today because of the heat. Each other cow gives 12 jars and the farmer sells 20 of the jars at the market in town. How many jars are left for the farmer after 5 more fall down?"


def test_values_of_other_lengths(spark):
    city = CITY.replace("Paris", "New York").replace("Rome", "San Diego").replace("20", "one hundred")
    farm = FARM.replace("20", "twenty five").replace("5 ", "thirty-six ", 1).replace("12", "forty two").replace("5 ", "thirty six ")
    got = found(spark, [f"some words {city} and more", f"some words. {farm} And more", "a train journey to New York of 20 hours begins each morning"], [CITY, FARM])
    assert set(got) == {(0, 0), (1, 1)} and not got[0, 0].verbatim
    assert not found(spark, ["The Slow Cat sleeps"], ["The Quick Brown Fox Jumps Over The Lazy Dog"])


def test_verbatim_copies_of_names_and_numbers(spark):
    items = ["The Quick Brown Fox Jumps Over The Lazy Dog", "12 15 Anna 18 21 Peter 24 27 Klaus 30"]
    others = ["The Slow Brown Cat Sleeps Under The Lazy Dog", "13 15 Anna 19 21 Peter 25 27 Klaus 31"]
    got = found(spark, [f"words {t} more words" for t in items + others], items)
    assert set(got) == {(0, 0), (1, 1)} and all(r.verbatim and r.coverage == 1.0 for r in got.values())


def test_a_contradiction_rejects(spark):
    item = "Maria bought seven red balloons at the fair before the rain began, and how many of them did Maria give away when 3 were lost and 3 more flew off?"
    good = item.replace("Maria", "Robert").replace("3", "8")
    half = item.replace("did Maria", "did Robert")
    numbers = item.replace("3 were", "8 were")
    longer = f"Yesterday in Old Berlin {item.replace('Maria', 'Robert')}"
    got = found(spark, [item, good, half, numbers, f"x. {good} y", longer, f"some words {item} and"], [item])
    assert {d for d, _ in got} == {0, 1, 4, 5, 6} and got[0, 0].verbatim and got[1, 0].slots >= 3


NAMES = ("Anna", "Peter", "Klaus", "Maria", "Robert", "Julia")
FORMS = (
    "{a} has {x} boxes of chalk in the school room and {b} has {y} of them in the cellar. If {a} takes {x} out and {b} brings {y} back, how many boxes are there in the end?",
    "On the way to the lake {a} walked {x} km and then met {b} who had walked {y} km. How far had {b} gone when {a} was {x} km from home?",
    "The price of a ticket is {x} dollars, said {a}, but {b} paid {y} dollars for it. What did {b} lose if {y} dollars is more than {x} dollars?",
)


def brute(texts, items):
    """(text, item) where the item's tokens stand one by one in the text, literal ones equal, slots with one value each."""
    words = lambda t: [w.strip(D.EDGE) for w in t.split()]
    out = set()
    for i, item in enumerate(items):
        own = words(item)
        slot = [w in NAMES or w.isdigit() for w in own]
        for d, text in enumerate(texts):
            t = words(text)
            for at in range(len(t) - len(own) + 1):
                here = t[at : at + len(own)]
                if all(s and (h in NAMES) == (w in NAMES) and h.isdigit() == w.isdigit() or w.lower() == h.lower() for w, h, s in zip(own, here, slot)):
                    values = {}
                    if all(values.setdefault(w, h) == h for w, h, s in zip(own, here, slot) if s):
                        out.add((d, i))
    return out


def test_planted_variants_against_brute_force(spark):
    import random

    rng = random.Random(5)
    fill = lambda form, **k: form.format(**({"a": "Anna", "b": "Peter", "x": 4, "y": 9} | k))
    items = [fill(f) for f in FORMS]
    texts = []
    for k in range(60):
        form = rng.choice(FORMS)
        a, b = rng.sample(NAMES, 2)
        t = fill(form, a=a, b=b, x=rng.randint(1, 900), y=rng.randint(1, 900))
        if k % 3 == 1:  # a contradiction: one of a value's places has another
            t = t[::-1].replace(a[::-1], next(n for n in NAMES if n not in (a, b))[::-1], 1)[::-1]
        if k % 3 == 2 and k % 2:
            t = "the weather on that day was fine and nobody counted " + " ".join(t.split()[:8])
        texts.append(f"some words come before it. {t} and some come after")
    want = brute(texts, items)
    assert len(want) >= 20 and set(found(spark, texts, items)) == want == set(found(spark, texts, items, most_windows=5))


def test_hash_join_gives_the_same_rows(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(map(tuple, D.find(docs, bench, most_windows=n).collect())) for n in (1_000_000, 1))
    assert one == two and len(one) > 20
    assert sorted(r.doc_id for r in D.clean(docs, bench, most_windows=1).collect()) == sorted(r.doc_id for r in D.clean(docs, bench).collect())
