import random

from pyspark.sql import functions as F

from coursepulse.llm import templates as t
from coursepulse.llm.common import WordHashes, windows

ITEM = (
    "A farmer named Alice buys 12 bags of seed at 5 dollars each and then sells 12 of the harvested crates "
    "for 30 dollars every week of the long dry season, what is the profit"
)
OTHER = "tell me why the quiet river turns east behind the old mill before it meets the sea again"
SHORT = "name the largest of all moons"
BENCHMARK = [(1, ITEM), (2, OTHER), (3, SHORT), (4, None), (5, "the"), (6, ITEM), (None, "a b")]


def found(spark, documents, texts):
    docs = documents(list(enumerate(texts)))
    benchmark = spark.createDataFrame(BENCHMARK, "item_id int, text string")
    rows = t.leaks(docs, benchmark).collect()
    return {(r.doc_id, r.item_id): r for r in rows}, docs, benchmark


def test_copies_edits_and_clean_texts(spark, documents):
    rnd = random.Random(3)
    noise = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    changed = ITEM.replace("Alice", "Bob").replace("12", "47").replace("30", "99").replace("dollars", "euros")
    crossed = ITEM.replace("buys 12", "buys 47").replace("sells 12", "sells 48").replace("5 dollars", "9 euros")
    crossed = crossed.replace("Alice", "Emma").replace("for 30 dollars", "for 77 miles")
    texts = [
        noise(40) + " " + ITEM.upper() + "\n" + noise(9),  # letters and surroundings differ
        noise(5) + " «" + OTHER.replace(" ", ", ") + "»",
        noise(30) + ". " + changed + noise(30),  # other values, consistently
        noise(30) + ". " + crossed,  # two values for one slot value
        noise(200), None, "", "the a b", "the " * 50,
        "Then " + SHORT + "!", "name the largest of some moons",
        " ".join(OTHER.split()[:13]), " ".join(OTHER.split()[:12]),
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
    ]
    rows, docs, benchmark = found(spark, documents, texts)
    assert set(rows) == {(0, 1), (1, 2), (2, 1), (9, 3), (11, 2)}
    assert rows[2, 1].exact_windows == 0 and rows[2, 1].template_windows >= rows[2, 1].n_windows / 2
    assert rows[0, 1].first_word == 40
    kept = t.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 10, 12, 13]


def test_rows_without_id_are_judged_each(spark, documents):
    docs = documents([(None, OTHER), (None, "clean words only"), (7, OTHER), (7, OTHER), (8, None)])
    benchmark = spark.createDataFrame(BENCHMARK, "item_id int, text string")
    assert sorted(str(r.doc_id) for r in t.clean(docs, benchmark).collect()) == ["8", "None"]
    nothing = benchmark.where("item_id < 0")
    assert t.leaks(docs, nothing).count() == 0 and t.clean(docs, nothing).count() == 5
    assert t.leaks(docs.where("doc_id < 0"), benchmark).count() == 0


def test_every_literal_window_is_found_and_no_other(spark, documents):
    """Against a search for runs of 13 plain words, in texts of few different words."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in "abcde"]
    items = [" ".join(rnd.choices(words, k=rnd.randint(13, 30))) for _ in range(8)]
    texts = []
    for _ in range(60):
        own = rnd.choices(words, k=rnd.randint(0, 60))
        cut = rnd.choice(items).split()
        a = rnd.randrange(len(cut))
        texts.append(" ".join(own + cut[a : a + rnd.randint(8, 20)] + rnd.choices(words, k=5)))
    docs = documents(list(enumerate(texts)))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    runs = lambda s: {tuple(s.split()[i : i + 13]) for i in range(len(s.split()) - 12)}
    expected = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if runs(text) & runs(item)}
    assert {(r.doc_id, r.item_id) for r in t.leaks(docs, benchmark).collect()} == expected


def test_rolled_hashes_tell_runs_apart():
    rnd = random.Random(1)
    words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(300)]
    hashed = WordHashes().of(words)
    for size in range(1, 14):
        rolled = t._rolled(hashed, size).tolist()
        plain = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert len(rolled) == len(plain) and len(set(zip(rolled, plain))) == len(set(plain)) == len(set(rolled))
        assert len(set(windows(hashed, size).tolist())) == len(set(plain))


def test_kinds_of_words():
    kinds = {
        "12": t.NUMBER_SLOT, "3.5": t.NUMBER_SLOT, "21st": t.NUMBER_SLOT, "seven": t.NUMBER_SLOT, "5kg": t.MEASURE_SLOT,
        "kg": t.UNIT_SLOT, "alice": t.NAME_SLOT, "river": t.LITERAL, "x12": t.LITERAL, "": t.LITERAL,
    }
    assert {w: t.kind_of(w) for w in kinds} == kinds


def leaking(spark, documents, item, texts):
    benchmark = spark.createDataFrame([(1, item)], "item_id int, text string")
    return sorted(r.doc_id for r in t.leaks(documents(list(enumerate(texts))), benchmark).collect())


def test_two_values_may_get_the_same_new_one(spark, documents):
    item = "she puts 3 apples and then 4 pears into the green basket by the door"
    texts = [item.replace("3", "5").replace("4", "5"), item.replace("3", "8").replace("4", "9")]
    assert leaking(spark, documents, item, texts) == [0, 1]


def test_items_of_mostly_placeholders_and_short_ones(spark, documents):
    assert leaking(spark, documents, "what is 12 + 35 * 7", ["so what is 15 + 31 * 2 then", "what was 15 + 31 * 2"]) == [0]
    dense = "add 12 kg 7 cm 3 miles 40 dollars 9 hours 5 days and 6 litres to 11 grams 8 volts 2 tons"
    changed = "add 13 kg 8 cm 4 miles 41 dollars 10 hours 6 days and 7 litres to 12 grams 9 volts 3 tons"
    assert leaking(spark, documents, dense, ["some words " + changed]) == [0]
    assert leaking(spark, documents, "What is love?", ["what is love", "what is love now", "so what is love"]) == [0]


def test_items_of_few_words_are_found_where_they_stand_by_themselves(spark, documents):
    item = "What is love?"
    texts = [
        "Q: What is love?\nA: nobody knows", "He asked: what is love? Nobody knew.", "some words\nwhat is love\nmore words",
        'she said "what is love" once more', "* What is love", "I know what is love. Do you", "what is love like", "love is what",
        "What is\nlove", "text " * 50 + "«What is love»",
    ]
    assert leaking(spark, documents, item, texts) == [0, 1, 2, 3, 4, 8, 9]
    assert leaking(spark, documents, "the", ["the old mill by the sea", "see\nThe\nend"]) == [1]


def test_values_of_several_words(spark, documents):
    item = "she puts 3 apples and then 4 pears into the green basket next to the old front door"
    made = lambda a, b: "well " + item.replace("3", a).replace("4", b) + " now"
    texts = [made("8", "twenty five"), made("two hundred", "3 million"), made("thirty-one", "9"), made("many", "few")]
    assert leaking(spark, documents, item, texts) == [0, 1, 2]
    item = "on the first day Mary Ann gives Bob, Alice and Tom some of the bread that Mary Ann has made"
    new = item.replace("Mary Ann", "Kofi").replace("Bob, Alice and Tom", "Emma, Jean Pierre Marie and Weng Li")
    crossed = new.replace("that Kofi", "that Emma")
    assert leaking(spark, documents, item, ["well " + new, "well " + crossed]) == [0]


def test_tables_of_numbers_are_no_leak(spark, documents):
    table = "table of results 5 6 7 8 10 11 more words"
    assert leaking(spark, documents, "12 35 7 9 4", [table, "so 12 35 7 9 4 it is"]) == [1]
    assert leaking(spark, documents, "results 12 35 7 9 4", [table]) == []
    assert leaking(spark, documents, "results 12 35 7 9 4 more", ["the results 5 6 7 8 9 more", table]) == [0]


def plain_tokens(text, everywhere):
    """Tokens of a line of lower-case words, digits, number words and capitalised names: (kind, value)."""
    out = []
    for i, word in enumerate(text.split()):
        name = word[0].isupper() and (everywhere or i > 0)
        kind = t.NAME_SLOT if name else t.kind_of(word.lower())
        kind = t.LITERAL if kind == t.NAME_SLOT and not name else kind
        one = kind == t.NAME_SLOT or kind == t.NUMBER_SLOT and not word.isdigit()
        if one and out and out[-1][0] == kind:
            out[-1] = kind, out[-1][1] + " " + word.lower()
        else:
            out.append((kind, word.lower()))
    return out


def plain_leak(doc, item):
    """All alignments of all readings, one by one."""
    words = lambda s: s.lower().split()
    d, i = words(doc), words(item)
    size = min(len(i), t.WINDOW)
    if {tuple(d[a : a + size]) for a in range(len(d) - size + 1)} & {tuple(i[a : a + size]) for a in range(len(i) - size + 1)}:
        return True
    form = lambda x: x[0] or x[1]
    for d in (plain_tokens(doc, False), plain_tokens(doc, True)):
        for i in (plain_tokens(item, False), plain_tokens(item, True)):
            size = min(len(i), t.WINDOW)
            if size < t.MIN_WORDS:
                continue
            for shift in range(-len(i), len(d)):
                met = [
                    a for a in range(len(i) - size + 1)
                    if a + shift >= 0 and a + shift + size <= len(d) and any(k for k, _ in i[a : a + size])
                    and [*map(form, i[a : a + size])] == [*map(form, d[a + shift : a + shift + size])]
                ]
                at = {a + k for a in met for k in range(size)}
                pairs = {(i[a], d[a + shift]) for a in at if i[a][0]}
                consistent = len(pairs) == len({theirs for theirs, _ in pairs})
                if consistent and sum(not i[a][0] for a in at) >= 2 and len(met) * 2 >= len(i) - size + 1:
                    return True
    return False


def test_alignments_and_slots_against_a_plain_search(spark, documents):
    rnd = random.Random(11)
    literal, number, name = ["red", "box", "holds"], ["3", "14", "five", "twenty five", "2 million"], ["Kofi", "Mary Ann", "Weng"]
    value = lambda: rnd.choice(rnd.choice([literal, literal, number, name]))
    items = [" ".join(value() for _ in range(rnd.randint(5, 24))) for _ in range(20)]
    texts = []
    for _ in range(400):
        words, swap = rnd.choice(items).split(), {}
        for k in number + name:
            swap[k] = rnd.choice(number if k in number else name)
        if rnd.random() < 0.8:
            words = [swap.get(w, w) for w in words]
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = value()
        texts.append(" ".join([value() for _ in range(rnd.randint(0, 6))] + words + [value() for _ in range(rnd.randint(0, 6))]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = t.leaks(documents(list(enumerate(texts))), benchmark).collect()
    expected = {(d, i) for d, text in enumerate(texts) for i, item in enumerate(items) if plain_leak(text, item)}
    assert {(r.doc_id, r.item_id) for r in rows} == expected
    assert any(r.exact_windows == 0 for r in rows) and len(expected) < len(texts) * len(items) / 2


def test_names_and_words_at_the_start_of_sentences(spark, documents):
    item = "Weng earns 12 coins for each of the red boxes that are sold at market"
    changed = item.replace("Weng", "Kofi").replace("12", "15")
    texts = ["some plain words " + changed, "some words. " + changed, "A heading\n" + changed, "A heading " + changed]
    assert leaking(spark, documents, item, texts) == [0, 1, 2, 3]
    middle = (
        "the shop opens early in the morning each week. Weng earns 12 coins there and spends some of them on bread "
        "and fresh milk"
    )
    assert leaking(spark, documents, middle, ["well " + middle.replace("Weng", "Kofi").replace("12", "15")]) == [0]


def test_clean_with_clashing_columns(spark, documents):
    item = "how many green apples does the old farmer sell on the market in one week"
    docs = documents([(1, "once " + item + " asked nobody"), (2, "a text of its own"), (None, item)], extra="_id")
    names = ["_hash", "hash", "item_id", "n_windows", "size", "place", "text_hash", "_col1"]
    docs = docs.select("*", *(F.lit("own").alias(c) for c in names))
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = t.clean(docs, benchmark)
    assert out.columns == docs.columns and [(r.doc_id, r._id, r._hash) for r in out.collect()] == [(2, "own", "own")]
