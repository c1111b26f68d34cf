from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import probability as P
from loomgraph.functions import text as X
from loomgraph.functions.matching import with_lexical_match


def one(spark, values, make, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(make("x")).collect()]


def test_clean_text_in_order(spark):
    values = ["\ufeff‘a’ “b”\tend", "a\r\nb\n\n\n\nc", "12\nword", "x\n\nChapter IV of dust\n\nmore  text", "chapters of dust", None, "", " \n \n\n "]
    assert one(spark, values, X.clean_text) == ["'a' \"b\" end", "a b\n\nc", "word", "x\nmore text", "chapters of dust", None, "", ""]


def test_keys_of_empty_null_and_marked_text(spark):
    values = [None, "", "  ", "The  THE Wizard’s Hat", "a-b_c", "NaN", "an old   owl"]
    assert one(spark, values, X.normalize) == ["", "", "", "the the wizard’s hat", "a-b_c", "nan", "an old owl"]
    assert one(spark, values, X.canonical_key) == ["", "", "", "wizard hat", "a b c", "nan", "old owl"]
    assert one(spark, values, X.none_if_nan)[5] is None


def test_singular_head_and_generic(spark):
    values = ["the old ladies", "glass", "his things", "people", "", None, "the Tin Woodman", "two gas"]
    assert one(spark, values, X.head_word) == ["lady", "glass", "thing", "people", "", "", "woodman", "gas"]
    assert one(spark, values, X.is_generic_nominal) == [False, False, True, True, True, True, False, False]
    assert one(spark, ["She", "Dorothy", "the Lion", "dog", None, "élan"], X.is_proper_name) == [False, True, True, False, False, False]


@pytest.mark.parametrize(("mention", "subject", "following", "expected"), [
    ("I", "Ann", None, ("I", "first_second_person_keep_original")),
    ("she", "Ann", None, ("Ann", "third_person_subject_pronoun_to_canonical")),
    ("her", "James", "hat", ("James'", "third_person_possessive_pronoun_to_canonical_possessive")),
    ("her", "Ann", "and", ("Ann", "third_person_object_pronoun_to_canonical")),
    ("his", None, None, ("the character's", "third_person_possessive_pronoun_to_canonical_possessive")),
    ("himself", "Bo", None, ("himself", "third_person_reflexive_keep_original")),
    ("the stranger", "Bo", None, ("the stranger", "ambiguous_or_unsupported_keep_original")),
    ("the old sailor", "Bo", None, ("Bo", "simple_nominal_to_canonical")),
    ("the very old grey sailor", "Bo", None, ("the very old grey sailor", "ambiguous_or_unsupported_keep_original")),
    ("Captain", "Bo", None, ("Bo", "proper_name_to_canonical")),
])
def test_rendering_rules(spark, mention, subject, following, expected):
    df = spark.createDataFrame([(mention, subject, following)], "m string, s string, f string")
    got = df.select(X.rendered_mention("m", "s", F.col("f")).alias("r")).select("r.*").first()
    assert tuple(got) == expected


def test_labels_and_ids(spark):
    assert one(spark, ["https://e.org/o#caresFor", "https://e.org/x/OWLClass/", "snake_case-name"], X.human_label) == ["Cares For", "OWLClass", "Snake Case Name"]
    assert one(spark, ["Ärger & Söhne", "3 men", "  "], X.iri_local) == ["Arger__Sohne", "entity_3_men", ""]
    assert one(spark, ["global_cluster_000012", "cluster_1", None], X.cluster_number) == [12, None, None]
    assert one(spark, [0, 1234567], X.global_cluster_uid, "bigint") == ["global_cluster_000000", "global_cluster_1234567"]
    assert one(spark, [1.5, 2.0, 0.004, None], X.literal_text, "double") == ["1.5", "2", "0", None]


def test_lexical_match_golden(spark, golden):
    table = [[c.strip() for c in line.strip("| \n").split("|")] for line in golden("X4").splitlines() if line.startswith("| ") and "own cluster" not in line]
    pairs = [(r[1], r[2], float(r[3]), r[4]) for r in table]
    df = spark.createDataFrame(pairs, "k string, a string, score double, method string")
    for r in with_lexical_match(df, "k", "a").collect():
        assert (r["match"]["method"], round(r["match"]["score"], 9)) == (r["method"], round(r["score"], 9)), r


def test_fuzzy_agrees_with_matching_blocks(spark):
    pairs = [("lady canterville", "lord canterville"), ("abcd", "abce"), ("", "x"), ("silver key", "golden key"), ("aaaaaa", "aaaaab")]
    df = spark.createDataFrame(pairs, "k string, a string")
    for r in with_lexical_match(df, "k", "a", 0.8, 5).collect():
        ratio = SequenceMatcher(None, r["k"], r["a"]).ratio()
        expect = ratio >= 0.8 and min(len(r["k"]), len(r["a"])) >= 5
        assert r["match"]["matched"] == expect


def test_probability_functions(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": 0.5, "c": 0.1},), ({},), ({"x": 0.3},)], "m map<string,double>")
    got = df.select(P.first_best_key(F.col("m")).alias("k"), P.confidence(F.col("m")).alias("c"), P.margin(F.col("m")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("a", 0.5, 0.0), (None, 0.0, 0.0), ("x", 0.3, 1.0)]
    noisy = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 0.3), (3, None)], "g int, p double").groupBy("g").agg(P.noisy_or(F.col("p")).alias("p"))
    assert {r["g"]: round(r["p"], 9) for r in noisy.collect()} == {1: 0.75, 2: 1.0, 3: 0.0}
    soft = spark.createDataFrame([([1.0, 1.0],), ([],), (None,)], "v array<double>").select(P.softmax_array(F.col("v"))).collect()
    assert [r[0] for r in soft] == [[0.5, 0.5], [], None]
    with pytest.raises(Exception, match="not a probability"):
        spark.createDataFrame([(1.5,)], "p double").select(P.checked_probability(F.col("p"))).collect()
    assert one(spark, [2.675], lambda x: P.round_half_even(F.col(x), F.lit(2)), "double") == [2.67]


def test_context_key(spark):
    values = ["He said , it 's late — no !", " a  n't b ", None]
    assert one(spark, values, X.context_key) == ["He said, it's late—no!", "an't b", None]
