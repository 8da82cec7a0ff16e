import random

from graphloom.llm import truncation as tr

SCHEMA = "doc_id long, text string, source string"
SENTENCES = ("The renal assay was repeated with {} samples.", "Levels of the marker rose after week {} of treatment.", "Two curators reviewed {} cases independently.", "No interaction with common therapies has been described in {} reports.")


def corpus(rng, n=400, source="notes", start=0):
    out = []
    for i in range(n):
        text = " ".join(rng.choice(SENTENCES).format(rng.randrange(1, 90)) for _ in range(rng.randrange(2, 6)))
        out.append((start + i, text, source))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["id"] for r in tr.cut_texts(df, "doc_id", "text", "source").collect()}


def test_cut_words_sentences_and_traces(spark):
    rows = corpus(random.Random(1))
    cut = ["The renal assay was repea", "Two curators reviewed 5 cases independently. Levels of the", "Levels of the marker rose …", "No interaction with common ther�", "The renal assay was rep..."]
    whole = ["The renal assay was repeated with 5 samples", "Levels of the marker rose after week 7 of treatment", "Two curators reviewed 9 cases independently.", "“No interaction with common therapies has been described in 3 reports”", "Done!", "Is it so?"]
    rows += [(1000 + i, t, "notes") for i, t in enumerate(cut)] + [(2000 + i, t, "notes") for i, t in enumerate(whole)]
    assert found(spark, rows) == {1000 + i for i in range(len(cut))}


def test_json_objects(spark):
    rows = corpus(random.Random(2), 100) + [(901, '{"a": [1, 2', "log"), (902, '{"a": "x]}', "log"), (903, '{"a": "x\\"]}"}', "log"), (904, '{"a": []}\n', "log"), (905, '{"a": {"b": 1}', None)]
    assert found(spark, rows) == {901, 902, 905}


def test_field_limits_are_learned(spark):
    rng = random.Random(3)
    rows = corpus(rng, 500)
    full = [(3000 + i, t, "short") for i, t, _ in corpus(rng, 80)]
    limited = [(i, t[:90], s) for i, t, s in full]
    # a cut just before a full stop, or behind it, leaves a sentence like any that lacks its full stop
    expected = {i for i, t, _ in full if len(t) > 90 and "." not in t[87:91]}
    assert len(expected) > 40
    assert expected - found(spark, rows + limited) == set()


def test_nulls_blanks_long_texts_and_repetitions(spark):
    rows = corpus(random.Random(4), 200) + [(901, None, "a"), (902, "", "a"), (903, " \n　", "a"), (None, "The ren", "a"), (904, "x " * 200_000 + "The renal ass", None), (905, "The renal ass", "a"), (905, "The renal ass", "a")]
    assert found(spark, rows) == {904, 905}


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == set()
    df = spark.createDataFrame([*corpus(random.Random(5), 200), (901, "The renal ass", "a")], SCHEMA).selectExpr("*", "1 as id", "2 as state", "3 as tail", "4 as word", "5 as kind")
    cut = tr.cut_texts(df, "doc_id", "text", "source")
    assert [r["id"] for r in cut.collect()] == [901]
    rates = {r["source"]: (r["documents"], r["cut"]) for r in tr.rates(df, cut, "doc_id", "text", "source").collect()}
    assert rates == {"notes": (200, 0), "a": (1, 1)}


def test_word_trie():
    trie = tr.WordTrie(["renal", "render", "re"])
    assert trie.goes_on("re") and trie.goes_on("ren") and not trie.goes_on("renal") and not trie.goes_on("x")


def test_fragments_by_brute_force(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(900)})
    asked = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    vocabulary = spark.createDataFrame([(w, 2 + i % 3) for i, w in enumerate(words)] + [("dddx", 1)], "word string, n long")
    want = {a for a in asked if any(w.startswith(a) and w != a for w in words)}
    for size in (1 << 20, 2000, 200):
        assert {r["word"] for r in tr.fragments(spark.createDataFrame([(a,) for a in asked], "word string"), vocabulary, size).collect()} == want
    assert tr.fragments(spark.createDataFrame([("a",)], "word string"), vocabulary.limit(0)).collect() == []


def test_ends_of_sentences_lines_and_texts():
    assert sorted(tr._ends(["Seen", "(", "twice", ")", ".", "Then", "a", "b", "\n", "c"])) == ["b", "c", "twice"]
    assert list(tr._ends([])) == []


def test_last_words_that_often_end_texts_are_no_cuts(spark):
    rows = corpus(random.Random(8), 400)
    rows += [(5000 + i, f"A survey of marker {i} in samples", "titles") for i in range(60)]
    rows += [(7000 + i, t, "notes") for i, t in enumerate(["Two curators reviewed the", "Levels of", "The renal assay was repeated with"])]
    assert found(spark, rows) == {7000, 7001, 7002}
