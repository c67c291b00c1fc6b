"""Character tables, reordering, private-use text and glyphs on small examples."""

from pyspark.sql import functions as F

from foliant.operators import transcode as Z


def test_map_characters(spark):
    df = spark.createDataFrame([(1, "aXé b"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: r["mapped"] for r in Z.map_characters(df, "t", {"a": "A"}, {"X": "XX"}).collect()}
    assert tuple(got[1]) == ("AXXé b", 1, 1, ["é"]) and got[2] is None and tuple(got[3]) == ("", 0, 0, [])
    kept = Z.map_characters(df, "t", {"a": "A"}, {"X": "XX"}, take_unsure=False).first()["mapped"]
    assert tuple(kept) == ("AXé b", 1, 1, ["é"])
    assert Z.map_characters(df, "t", {}).first()["mapped"]["text"] == "aXé b"


def test_reordering(spark):
    df = spark.createDataFrame([("kVSk kSV x\nV",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(Z.reorder_clusters(F.col("t"), "k", ["S", "V"])).collect()]
    assert got == ["kSVk kSV x\nV", None, ""]
    assert df.select(Z.move_prebase(F.lit("ik kii k"), "i", "k")).first()[0] == "ki kii k"


def test_private_text_fails_closed(spark):
    df = spark.createDataFrame([("",), (" ",), ("plain",), (None,)], "t string")
    assert [r["decoded"] for r in Z.decode_private(df, "t", {"": "k", "": "i", "": "K"}).collect()] == ["K", None, "plain", None]


def test_glyphs(spark):
    df = spark.createDataFrame([(1, [("a", 5), ("�", 7)]), (2, [("�", 9)]), (3, [])], "k int, c array<struct<cp:string,gid:int>>")
    got = {r["k"]: (r["recovered"], r["unknown_glyphs"]) for r in Z.recover_glyphs(df, "c", {7: "b"}).collect()}
    assert got == {1: ("ab", []), 2: (None, [9]), 3: ("", [])}


def test_aliases(spark):
    df = spark.createDataFrame([("New-Ari",), ("pracalit nepal",), ("other",), (None,)], "t string")
    assert [r[0] for r in df.select(Z.resolve_alias(F.col("t"), {"newa": ["newari", "Pracalit_Nepal"]})).collect()] == ["newa", "newa", None, None]
