import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.frame import Frame, concat, expand_indices, kind_of
from sparkloom.sources import read_csv, read_csv_text, to_csv


def plain(x):
    if isinstance(x, list):
        return [plain(v) for v in x]
    return "gap" if isinstance(x, float) and math.isnan(x) else x


@pytest.fixture(scope="module")
def abc(spark):
    return Frame.from_rows(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["A", "B", "C"], ["row1", "row2", "row3"])


def test_construction(spark):
    ragged = Frame.from_rows(spark, [[1, 4, 7], [2, "hi"], [3, 6, 9]], ["zero", 1, "two"], ["three", 2, "four"])
    assert plain(ragged.values) == [[1, 4, 7.0], [2, "hi", "gap"], [3, 6, 9.0]]
    assert ragged.index == ["three", 2, "four"] and list(ragged.dtypes.values()) == ["bigint", "object", "double"]
    mapped = Frame.from_columns(spark, {"c": [1, 2], "b": [3, 4]}, ["a", "b"])
    assert plain(mapped.values) == [["gap", 3], ["gap", 4]]
    assert Frame.from_rows(spark, [1, 2]).values == [[1], [2]]
    assert len(Frame.from_rows(spark, [], ["a", "b"])) == 0
    with pytest.raises(ValueError):
        Frame.from_columns(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ValueError):
        Frame.from_rows(spark, [[1, 2]], ["a"])
    assert kind_of([1, float("nan")]).simpleString() == "double" and kind_of([1, "a"]) is None
    assert expand_indices([0, [2, 4], 6]) == [0, 2, 3, 4, 6]


def test_columns(spark, abc):
    mixed = Frame.from_rows(spark, [[1, 2, 3], [4, 5, 6]], ["a", 0, True])
    assert mixed["a"] == [1, 4] and mixed[0] == [2, 5] and mixed[[True, "a"]].values == [[3, 1], [6, 4]]
    double = Frame.from_rows(spark, [[1, 2], [3, 4]], ["A", "A"])
    assert double["A"] == [[1, 3], [2, 4]] and double[["A"]].columns == ["A", "A"]
    assert abc.with_column("B", ["x", "y", "z"])["B"] == ["x", "y", "z"]
    assert abc.with_column("D", [1, "y", 2])["D"] == [1, "y", 2]
    assert abc.map_column("A", lambda c: c * 2)["A"] == [2.0, 8.0, 14.0]
    assert abc.cast("A", "string")["A"] == ["1", "4", "7"]
    with pytest.raises(ValueError):
        abc.with_column("D", [1])
    with pytest.raises(KeyError):
        abc["nothing"]
    assert [r["non_null"] for r in abc.info().orderBy("position").collect()] == [3, 3, 3]
    assert abc.table(True)[1] == ["row1", 1, 2, 3] and "row1" in abc.to_string() and abc.head(1).values == [[1, 2, 3]]
    assert abc.to_table().columns == ["A", "B", "C"]


def test_drop_and_rename(spark, abc):
    assert abc.drop("row2").index == ["row1", "row3"] and abc.drop("B", axis=1).columns == ["A", "C"]
    twice = Frame.from_rows(spark, [[1], [2], [3], [4]], ["A"], [0, "hi", "hi", 2])
    assert twice.drop("hi", select=1).index == [0, "hi", 2] and twice.drop("hi").values == [[1], [4]]
    with pytest.raises(KeyError):
        abc.drop("nothing")
    named = abc.rename(index={"row1": "first"}, columns={"A": "a"})
    assert named.index == ["first", "row2", "row3"] and named.columns == ["a", "B", "C"]
    assert abc.rename(index={"row1": 7}).index == [7, "row2", "row3"]
    assert twice.rename(index={"hi": "ho"}, at_index=1).index == [0, "hi", "ho", 2]
    with pytest.raises(KeyError):
        abc.rename(columns={"Z": "z"})
    assert abc.reset_index().index == [0, 1, 2]


def test_order(spark, abc):
    f = Frame.from_columns(spark, {"A": [3, 1, 4, 2], "B": ["banana", "Apple", "pear", "apple"]})
    assert f.sort("A").index == [1, 3, 0, 2] and f.sort("A", ascending=False).index == [2, 0, 3, 1]
    assert f.sort("B")["B"] == ["Apple", "apple", "banana", "pear"]
    g = Frame.from_columns(spark, {"A": [3, float("nan"), 4, 1]})
    assert g.sort("A").index == [1, 3, 0, 2] and g.sort("A", nulls_first=False).index == [3, 0, 2, 1]
    assert g.sort("A", ascending=False).index == [2, 0, 3, 1]
    assert f.sort("A", key=lambda c: -c).index == [2, 0, 3, 1]
    assert abc.reindex(["row3", "row1", "row2"]).values == [[7, 8, 9], [1, 2, 3], [4, 5, 6]]
    assert abc.reindex({"row1": "row3"}).index == ["row2", "row3", "row1"]
    assert abc.reindex({"row3": "row1"}).index == ["row3", "row1", "row2"]
    with pytest.raises(ValueError):
        abc.reindex(["row1"])
    same = Frame.from_columns(spark, {"A": [2, 1]})
    assert same.sort("A", inplace=True) is same and same["A"] == [1, 2]


def test_iloc(spark, abc):
    assert abc.iloc[1] == [4, 5, 6] and abc.iloc[1, 2] == 6
    assert abc.iloc[[2, 0]].values == [[7, 8, 9], [1, 2, 3]] and abc.iloc[0:2].index == ["row1", "row2"]
    assert abc.iloc[1:3, 0:2].values == [[4, 5], [7, 8]] and abc.iloc[0:1, [2, 0]].values == [[3, 1]]
    for bad in (9, slice(0, 9), [9]):
        with pytest.raises(IndexError):
            abc.iloc[bad]
    f = Frame.from_rows(spark, [[1, 2], [3, 4]])
    f.iloc[0] = [9, 2.5]
    assert f.values == [[9, 2.5], [3, 4.0]]
    f.iloc[1, 0] = "x"
    assert f.values == [[9, 2.5], ["x", 4.0]]
    with pytest.raises(ValueError):
        f.iloc[0] = [1]


def test_loc(spark):
    f = Frame.from_rows(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], ["A", "B", "C"], ["1", 2, "row3"])
    assert f.loc("row3") == [7, 8, 9] and f.loc(2) == [4, 5, 6] and f.loc("2") == [4, 5, 6] and f.loc("row3", "B") == 8
    assert f.loc({"1": "row3"}).values == [[1, 2, 3], [4, 5, 6]] and f.loc({2: None}).index == [2, "row3"]
    assert f.loc(col={"A": "B"}).columns == ["A", "B"] and f.loc({"1": 2}, ["C", "A"]).values == [[3, 1]]
    assert f.loc(["row3", "1", 2]).index == ["row3", "1", 2]
    assert f.loc("row3", "B", edit=0)["B"] == [2, 5, 0] and f.loc({"1": None}, "A", edit="x")["A"] == ["x", "x", "x"]
    double = Frame.from_rows(spark, [[1], [2], [3]], ["A"], ["x", "x", "y"])
    assert double.loc("x").values == [[1], [2]]
    with pytest.raises(KeyError):
        f.loc("nothing")


def test_concat(spark):
    a = Frame.from_rows(spark, [[1, 2], [3, 4]], ["A", "B"], ["row1", "row2"])
    b = Frame.from_rows(spark, [[5, 6], [7, 8]], ["B", "C"], ["row2", "row3"])
    outer = concat([a, b])
    assert plain(outer.values) == [[1.0, 2, "gap"], [3.0, 4, "gap"], ["gap", 5, 6.0], ["gap", 7, 8.0]]
    assert outer.columns == ["A", "B", "C"] and outer.index == ["row1", "row2", "row2", "row3"]
    assert concat([a, b], join="inner").values == [[2], [4], [5], [7]] and concat([a, b], ignore_index=True).index == [0, 1, 2, 3]
    beside = concat([a, b], axis=1)
    assert beside.columns == ["A", "B", "B", "C"] and beside.index == ["row1", "row2", "row3"]
    assert plain(beside.values) == [[1.0, 2.0, "gap", "gap"], [3.0, 4.0, 5.0, 6.0], ["gap", "gap", 7.0, 8.0]]
    assert concat([a, b], axis=1, join="inner").values == [[3, 4, 5, 6]]
    assert concat([a, a.reset_index()], axis=1, positional=True).values[0] == [1, 2, 1, 2]
    text = Frame.from_rows(spark, [["x", "y"]], ["A", "B"])
    assert concat([a, text]).values == [[1, 2], [3, 4], ["x", "y"]]
    with pytest.raises(ValueError):
        concat([a], axis=2)


def test_append(spark):
    f = Frame.from_rows(spark, [[1, 2], [3, 4]])
    assert f.append([[5, 6]], ignore_index=True).values == [[1, 2], [3, 4], [5, 6]]
    assert plain(f.append([[5]]).values)[2] == [5, "gap"]
    wide = f.append({0: [5], "new": [9]}, ignore_index=True)
    assert plain(wide.values) == [[1, 2.0, "gap"], [3, 4.0, "gap"], [5, "gap", 9.0]]
    assert plain(f.append([{0: 7}, {1: 8}], index=["p", "q"]).values)[2:] == [[7.0, "gap"], ["gap", 8.0]]
    assert f.append([[5, 6]], index=["z"]).index == [0, 1, "z"]
    with pytest.raises(ValueError):
        f.append({0: [5]})
    with pytest.raises(ValueError):
        f.append([[1, 2, 3]])


def test_csv(spark, tmp_path):
    text = 'id,name,score\n1,"a, b",2.5\n2,c,\n3,d,4\n'
    file = tmp_path / "in.csv"
    file.write_text(text)
    f = read_csv(spark, str(file))
    assert f.columns == ["id", "name", "score"] and f["name"] == ["a, b", "c", "d"] and f.dtypes["c0"] == "int"
    part = read_csv(spark, str(file), rows=[0, [2, 3]], columns=[[0, 1]], convert={"id": lambda c: c * 10})
    assert part.values == [[20, "c"], [30, "d"]]
    assert read_csv(spark, str(file), has_index=True).index == [1, 2, 3]
    assert read_csv(spark, str(file), has_header=False, new_header=["p", "q", "r"]).values[0] == ["id", "name", "score"]
    t = read_csv_text(spark, text, columns=[0, 2])
    assert t.values == [["1", "2.5"], ["2", ""], ["3", "4"]]
    with pytest.raises(ValueError):
        read_csv_text(spark, text, new_header=["one"])
    assert to_csv(f.select("id", "name"), index=True).splitlines()[:2] == [",id,name", '0,1,"a, b"']
    to_csv(f, str(tmp_path / "out"))
    assert read_csv(spark, str(tmp_path / "out")).sort("id")["name"] == ["a, b", "c", "d"]
    to_csv(concat([f.select("id"), f.select("id")], axis=1), str(tmp_path / "twice"))
    assert sorted(p.value for p in spark.read.text(str(tmp_path / "twice")).collect())[-1] == "id,id"


def test_from_table(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    f = Frame.from_table(orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], index="o_orderkey")
    assert len(f) == 1500 and f.columns == ["o_totalprice"] and f.index[:3] == sorted(f.index)[:3]
    assert f.df.filter(F.col("__ord").isNull()).count() == 0


def test_setters_and_cells_of_rows(spark):
    f = Frame.from_rows(spark, [[1, "a"], [2, "b"], [3, "c"]], ["n", "s"])
    f.columns = ["number", "letter"]
    f.index = ["x", "y", 7]
    assert f.columns == ["number", "letter"] and f.index == ["x", "y", 7] and f.loc("y") == [2, "b"]
    f.iloc[1][0] = 20
    f.iloc[2][-1] = "z"
    f["twice"] = [2, 40, 6]
    f["number"] = [1.5, 2.5, 3.5]
    assert f.values == [[1.5, "a", 2], [2.5, "b", 40], [3.5, "z", 6]] and f.iloc[0] == [1.5, "a", 2]
    for wrong in (lambda: setattr(f, "columns", ["a"]), lambda: setattr(f, "index", [1]), f.rename):
        with pytest.raises(ValueError):
            wrong()
