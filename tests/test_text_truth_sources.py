import itertools
import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import text as t
from kindred.operators import truth as g
from kindred.sources import readers as r
from kindred.sources import writers as w


def test_truncation_equals_popping(spark):
    cases = list(itertools.product(range(0, 9), range(0, 9), range(0, 14)))
    df = spark.createDataFrame(cases, "la int, lb int, room int")
    for room, part in itertools.groupby(sorted(cases, key=lambda x: x[2]), key=lambda x: x[2]):
        rows = df.filter(F.col("room") == room)
        a = F.when(F.col("la") > 0, F.sequence(F.lit(1), "la")).otherwise(F.array().cast("array<int>"))
        b = F.when(F.col("lb") > 0, F.sequence(F.lit(1), "lb")).otherwise(F.array().cast("array<int>"))
        ka, kb = t.truncate_pair(a, b, room)
        got = {(x.la, x.lb): (x.a, x.b) for x in rows.select("la", "lb", F.size(ka).alias("a"), F.size(kb).alias("b")).collect()}
        for la, lb, _ in part:
            p, q = la, lb
            while p + q > room:
                if p > q:
                    p -= 1
                else:
                    q -= 1
            assert got[(la, lb)] == (p, q)


def by_hand(a, b, label, vocab, lay):
    special = 4 if lay.extra_sep else 3
    a, b = list(a), list(b)
    while b and len(a) + len(b) > lay.max_length - special:
        (a if len(a) > len(b) else b).pop()
    if not b:
        a = a[: lay.max_length - (special - 1)]
    tokens = a + ["[SEP]"] * (2 if lay.extra_sep else 1)
    segments = [lay.segment_a] * len(tokens)
    if b:
        tokens, segments = tokens + b + ["[SEP]"], segments + [lay.segment_b] * (len(b) + 1)
    if lay.cls_at_end:
        tokens, segments = tokens + ["[CLS]"], segments + [lay.cls_segment]
    else:
        tokens, segments = ["[CLS]"] + tokens, [lay.cls_segment] + segments
    ids = [vocab.get(x, 1) for x in tokens]
    fill = lay.max_length - len(ids)
    put = lambda xs, f: [f] * fill + xs if lay.pad_left else xs + [f] * fill
    return put(ids, lay.pad_id), put([1] * len(ids), 0), put(segments, lay.pad_segment), label


@pytest.mark.parametrize(
    "layout",
    [t.FeatureLayout(8), t.FeatureLayout(9, cls_at_end=True, cls_segment=2, pad_left=True, pad_segment=4), t.FeatureLayout(10, extra_sep=True)],
)
def test_pair_features(spark, layout):
    rows = [(1, "Is this it?", "no, it is", "1"), (2, "a b c d e f g h i j k l", None, "0"), (3, "x", "y y y y y y y y y", "1"), (4, "", "", "0")]
    df = spark.createDataFrame(rows, "id int, text_a string, text_b string, label string")
    vocab = t.vocabulary(df.filter("id <> 3"), "text_a", "text_b")
    ids = {x.token: x.token_id for x in vocab.collect()} | t.SPECIAL_TOKENS
    assert min(v for k, v in ids.items() if not k.startswith("[")) == 4
    words = lambda s: [] if not s else s.lower().replace("?", " ?").replace(",", " ,").split()
    for x in t.pair_features(df, vocab, ["0", "1"], layout).collect():
        _, a, b, label = rows[x.id - 1]
        want = by_hand(words(a), words(b), int(label), ids, layout)
        assert (x.input_ids, x.input_mask, x.segment_ids, x.label_id) == want
    with pytest.raises(Exception, match="unknown label"):
        t.pair_features(df, vocab, ["0"], layout).collect()


def test_text_forms(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "b")], "id int, name string, description string")
    got = df.orderBy("id").select(
        t.all_but_first(df), t.with_fallback("name", "description"), t.dash_joined("name", "description", "name")
    ).collect()
    assert [tuple(x) for x in got] == [("a", "a", "a -  - a"), ("a b", "a b", "a - b - a")]
    line = df.select(t.tagged_line(t.tagged({"n": "name"}), t.tagged({"d": F.lit("x")}), F.lit(True))).first()[0]
    assert line == "COL n VAL a \t COL d VAL x \t 1"


def test_truth_forms(spark):
    doc = {
        "ground_truth": [
            {"pairs": [{"company-name": "A", "industry": ["x", "y"], "country": None, "source": "s"}, {"company_name": "B", "industry": "z", "country": "IT", "source": "t"}], "match": True},
            {"pairs": [{"company-name": "", "industry": None}, {"company-name": "C"}]},
        ]
    }
    flat = g.flatten_truth(spark.createDataFrame([(json.dumps(doc),)], "document string"))
    rows = [tuple(x) for x in flat.collect()]
    assert rows[0] == ("A", "x; y", "", "s", "B", "z", "IT", "t", 1)
    assert rows[1] == ("UNKNOWN", "", "", "", "C", "", "", "", 0)
    assert g.unnamed(flat).count() == 1
    back = g.nested_truth(flat).first()
    assert back["match"] is True and back.pairs[0]["industry"] == ["x", "y"] and back.pairs[0]["company-name"] == "A"


def test_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Unnamed: 0,name\n0,"a, ""q"""\n1,\n')
    (tmp_path / "a.jsonl").write_text('{"n": 1, "tags": ["x"]}\n{"n": null}\n')
    (tmp_path / "noext").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "bad.json").write_text("not json\n")
    found = r.read_folder(spark, str(tmp_path))
    assert list(found.tables) == ["a", "b"] and set(found.skipped) == {"noext", "c.txt", "bad.json"}
    assert [x.name for x in found.table("b").collect()] == ['a, "q"', None]
    assert found.table("b").columns == ["name"]
    assert found.table("a").first().n == "1"
    nested = tmp_path / "nested"
    (nested / "site").mkdir(parents=True)
    (nested / "site" / "t.one.csv").write_text("k\n1\n")
    assert list(r.read_folder(spark, str(nested), nested=True).tables) == ["t"]


def test_folder_loses_nothing(spark, tmp_path):
    """Two files of one name, in a folder named like its parent."""
    folder = tmp_path / "a" / "a"
    folder.mkdir(parents=True)
    (folder / "y.csv").write_text("k,v\n1,x\n")
    (folder / "y.json").write_text('{"k": 2}\n')
    (folder / "z.csv").write_text('k,v\n1,"two\nlines"\n')
    found = r.read_folder(spark, str(folder), schemas={"y": "k string, v string"}, multi_line=True)
    assert not found.skipped and len(found.tables["y"]) == 2
    assert sorted((x.k, x.v) for x in found.table("y").collect()) == [("1", "x"), ("2", None)]
    assert found.table("z").first().v == "two\nlines"


def test_pair_files(spark, tmp_path):
    four = tmp_path / "four.tsv"
    four.write_text('id\tsentence1\tsentence2\tlabel\n1\t"a\tb"\t1\n2\tonly\n3\t\tx\t0\textra\n')
    rows = [tuple(x) for x in r.read_pairs(spark, str(four), "train").collect()]
    assert rows == [("train-1", '"a', 'b"', "1"), ("train-3", "", "x", "0")]
    assert [tuple(x) for x in r.rejected_pairs(spark, str(four)).collect()] == [("2\tonly", 2)]
    odd = tmp_path / "odd.tsv"
    odd.write_text("pair\ta\tb\tlabel\nid\tx\ty\u0001z\t1\nidx\t\\\t'\"\t0\n\n")
    rows = [tuple(x) for x in r.read_pairs(spark, str(odd), "s").collect()]
    assert rows == [("s-id", "x", "y\u0001z", "1"), ("s-idx", "\\", "'\"", "0")]
    six = tmp_path / "six.tsv"
    six.write_text("id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate\n7\t1\t2\tp\tq\t1\n8\tp\tq\n")
    both = r.read_splits(spark, {"dev": str(six), "test": str(four)}, layout=6).collect()
    assert {(x.guid, x.text_a, x.split) for x in both} == {("dev-7", "p", "dev"), ("dev-7", "p", "test")}


def test_match_text_and_writers(spark, tmp_path):
    lines = spark.createDataFrame([("a | b | c \t d |  | f \t 0.9",), ("broken",)], "value string")
    one = r.parse_match_text(lines, ["n", "i", "c"]).collect()
    assert [tuple(x) for x in one] == [("a", "b", "c", "d", "", "f")]
    assert [tuple(x) for x in r.rejected_match_text(lines).collect()] == [("broken", 1)]
    df = spark.createDataFrame([(1, 'say "hi"', " x\ty ")], "id int, a string, b string")
    w.write_pairs(df.select("id", "a", F.lit("z").alias("b"), F.lit(1).alias("label")), str(tmp_path / "p"))
    assert tuple(r.read_pairs(spark, str(tmp_path / "p"), "s").first()) == ("s-1", 'say "hi"', "z", "1")
    w.write_csv(df, str(tmp_path / "c"))
    back = r.read_columns(spark, str(tmp_path / "c"), "id int, a string, b string", ["a", "b"]).first()
    assert tuple(back) == ('say "hi"', " x\ty ")
    w.write_pair_lines(df, "a", "b", str(tmp_path / "l"))
    assert json.loads(spark.read.text(str(tmp_path / "l")).first()[0]) == ['say "hi"', " x\ty "]


def test_scan_reads_only_wanted_columns(spark, tmp_path):
    spark.range(3).selectExpr("id", "id as b", "id as c").write.option("header", "true").csv(str(tmp_path / "x"))
    df = r.read_columns(spark, str(tmp_path / "x"), "id long, b long, c long", ["b"])
    assert "ReadSchema: struct<b:bigint>" in df._jdf.queryExecution().executedPlan().toString()
    assert r.available(df, ["zz", "b"]).columns == ["b"]


def test_preview_and_head(spark):
    tables = {"t": spark.range(30), "s": spark.range(4)}
    got = r.preview(tables, {"t": ["id"], "s": ["id"]}, 10).collect()
    assert len(got) == 14 and got[0].row == '{"id":0}'
    assert [x.id for x in r.first_lines(spark.range(9), 3, "id").collect()] == [0, 1]
    assert r.first_lines(spark.range(9), 0, "id").count() == 0


ODD_TEXTS = ["plain", "a\tb", "x\ny", "c\rd", "\r\n", "", None, '"quoted"', "it's", "back\\slash", "\\", "\\\\", "\\t", "\\N", "\\\tt", "\x00\x01", " lead", "trail ", "\t", "\\n\n", "é\U0001f600"]


def test_pair_lines_lose_nothing(spark, tmp_path):
    rows = [(k, a, b, 1 if k % 2 else None) for k, (a, b) in enumerate((a, b) for a in ODD_TEXTS for b in ODD_TEXTS)]
    schema = "id long, sentence1 string, sentence2 string, label int"
    w.write_pairs(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "odd"))
    back = r.read_pair_table(spark, str(tmp_path / "odd"), schema)
    assert back.dtypes == [("id", "bigint"), ("sentence1", "string"), ("sentence2", "string"), ("label", "int")]
    assert sorted(map(tuple, back.collect()), key=lambda x: x[0]) == rows
    assert r.rejected_pairs(spark, str(tmp_path / "odd")).collect() == []
    four = r.read_pairs(spark, str(tmp_path / "odd"), "dev", escaped=True).collect()
    assert sorted((x.text_a or "", x.text_b or "") for x in four) == sorted((a or "", b or "") for _, a, b, _ in rows)


def test_truth_is_written_and_read(spark, tmp_path):
    rows = [("A \"q\"", "x; y", "DE", "s1", "B\n", "", "", "s2", 1), ("UNKNOWN", "", "FR", "", "C", "z", "", "s3", 0)]
    cols = [f"{c}_{s}" for s in "ab" for c in ("company", "industry", "country", "source")]
    flat = spark.createDataFrame(rows, ", ".join([*(f"{c} string" for c in cols), "label int"]))
    g.write_truth(g.nested_truth(flat), str(tmp_path / "truth"))
    assert sorted(map(tuple, g.read_truth(spark, str(tmp_path / "truth")).collect())) == sorted(rows)


def test_folder_of_many_small_files(spark, tmp_path):
    """Names, layouts and bad files of 400 files are found in a few jobs; files of one layout are one read."""
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(150):
        (folder / f"t{k % 5}.part{k}.csv").write_text("x")  # no known format: the text after the first dot counts
        (folder / f"c{k}.csv").write_text(f'id,"na,me",c{k % 3}\n{k},"a ""q"" b",\n')
        (folder / f"j{k}.json").write_text(f'{{"id": {k}, "tags": ["a", "b"], "v{k % 4}": {k / 2}}}\n\n{{"id": "x", "tags": []}}\n')
    (folder / "bad.json").write_text('{"a": 1}\n{"a": \n')
    (folder / "deep.json").write_text('{"a": {"b": 1}}\n')
    (folder / "same.csv").write_text("a,A\n1,2\n")
    (folder / "empty.csv").write_text("")
    (folder / "odd name é.json").write_text('{"k": true}\n')
    def newest():
        """The number of the newest job; one more with every call."""
        spark.sparkContext.setJobGroup("count jobs", "")
        spark.range(1).collect()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup("count jobs"))

    before = newest()
    found = r.read_folder(spark, str(folder))
    assert newest() - before - 1 < 20
    assert set(found.skipped) == {"bad.json", *(f"t{k % 5}.part{k}.csv" for k in range(150))}
    assert found.skipped["bad.json"] == "not JSON lines"
    c, j = found.table("c7"), found.table("j6")
    assert c.columns == ["id", "na,me", "c1"] and [tuple(x) for x in c.collect()] == [("7", 'a "q" b', None)]
    assert j.dtypes == [("id", "string"), ("tags", "array<string>"), ("v2", "string")]
    assert sorted(map(str, j.collect())) == ["Row(id='6', tags=['a', 'b'], v2='3.0')", "Row(id='x', tags=[], v2=None)"]
    assert found.table("odd name é").first().k == "true"
    assert found.table("deep").dtypes == [("a", "struct<b:string>")]


def test_entries_of_one_layout_are_one_read(spark, tmp_path):
    folder = tmp_path / "parts"
    for part in ("p1", "p2", "p3"):
        (folder / part).mkdir(parents=True)
        header = "id,name" if part != "p3" else "name,id"
        (folder / part / "t.csv").write_text(f"{header}\n{part},{part}x\n")
    found = r.read_folder(spark, str(folder), nested=True)
    assert len(found.tables["t"]) == 2
    assert sorted(map(tuple, found.table("t").collect())) == [("p1", "p1x"), ("p2", "p2x"), ("p3x", "p3")]
