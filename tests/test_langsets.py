import pytest

from glossagrid.constants import SEEN_GROUP_OF_BACKBONE
from glossagrid.functions.checks import DataProblem
from glossagrid.operators import langsets as L


def test_published_groups_are_sound(spark):
    groups = L.published_groups(spark)
    sizes = {r["group"]: r["count"] for r in groups.groupBy("group").count().collect()}
    assert sizes == {"enarzho": 3, "joshi5": 7, "self_split7": 7, "aya_seen": 24, "bloom_seen": 39}
    assert L.group_problems(groups).count() == 0
    parts = {r["lang"] for r in L.group_algebra(groups, "enarzho", "joshi5").where("part = 'left_only'").collect()}
    assert parts == set()
    unseen = {r["lang"] for r in L.group_algebra(groups, "joshi5", "bloom_seen").where("part = 'left_only'").collect()}
    assert unseen == {"deu_Latn", "jpn_Jpan"}


def test_problems_are_found(spark):
    groups = spark.createDataFrame([("a", "deu_Latn", 0), ("a", "deu_Latn", 1), ("b", "deu_Latn", 0), ("b", "bad", 1)],
                                   "group string, lang string, ord int")
    got = {tuple(r) for r in L.group_problems(groups, [("a", "b")]).collect()}
    assert got == {("duplicate", "a", "deu_Latn"), ("overlap", "a&b", "deu_Latn"), ("code", "b", "bad")}


def test_backbones(spark):
    groups = L.published_groups(spark)
    assert L.seen_langs_of(groups, "aya").count() == 24
    with pytest.raises(DataProblem):
        L.seen_langs_of(groups, "nobody")
    low = spark.createDataFrame([("aya", "amh_Ethi")], "group string, lang string")
    assert L.low_langs_of(low, "bloom").count() == 0
    assert set(SEEN_GROUP_OF_BACKBONE) == {"bloom", "aya", "g4", "mdeberta", "mgte", "xlmr"}


DIM = "code string, class int, family string, region string, xlmr int, low_perf int"


def test_known_languages(spark):
    dim = spark.createDataFrame([("deu_Latn", 5, "x", "y", 1, 0), ("nqo_Nkoo", 0, "x", "y", 0, 1)], DIM)
    rows = spark.createDataFrame([("deu_Latn",), ("nqo_Nkoo.zip",)], "lang string")
    assert [r[0] for r in L.known_languages(rows, dim).collect()] == ["deu_Latn"]
    with pytest.raises(DataProblem, match="xxx_Zzzz"):
        L.known_languages(rows.unionByName(spark.createDataFrame([("xxx_Zzzz",)], "lang string")), dim)
    got = {(r["group"], r["lang"]) for r in L.groups_from_dimension(dim).collect()}
    assert got == {("class5", "deu_Latn"), ("seen", "deu_Latn"), ("low_perf", "nqo_Nkoo")}


def test_exclusion_by_list_and_by_table(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "target_lang string")
    drop = spark.createDataFrame([("b",)], "lang string")
    for langs in (["b"], drop):
        assert sorted(r[0] for r in L.exclude_langs(rows, langs).collect()) == ["a", "c"]
        assert [r[0] for r in L.restrict_langs(rows, langs).collect()] == ["b"]
    assert L.exclude_langs(rows, None).count() == 3
