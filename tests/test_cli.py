import re

from tessera import cli
from tessera.plans.workloads import _PAGES
from tests.conftest import rows


def lines(spark, path):
    return [r[0] for r in rows(spark.read.text(str(path)))]


def test_text_programs(spark, tmp_path):
    (tmp_path / "c.csv").write_text("S1,18840101,TMIN,10\nS1,18840102,TMIN,20\nS1,18840101,TMAX,100\nS1,18850101,TMAX,50\nS2,18860101,TMIN,-5\nS1,18840101,PRCP,7\n")
    cli.main(["climate_means", str(tmp_path / "c.csv"), str(tmp_path / "m")])
    assert lines(spark, tmp_path / "m") == ["S1\t, 15.0, 75.0", "S2\t, -5.0, NaN"]
    cli.main(["climate_series", str(tmp_path / "c.csv"), str(tmp_path / "s")])
    assert re.sub(r"(\.\d)0+", r"\1", "\n".join(lines(spark, tmp_path / "s"))) == "S1\t, [(1884, 15.0, 100.0), (1885, NaN, 50.0)]\nS2\t, [(1886, -5.0, NaN)]"
    (tmp_path / "t.txt").write_text("b a b\n\nc,\n")
    cli.main(["word_count", str(tmp_path / "t.txt"), str(tmp_path / "w")])
    assert lines(spark, tmp_path / "w") == ["a\t1", "b\t2", "c,\t1"]


def test_graph_programs(spark, tmp_path):
    (tmp_path / "wiki.txt").write_text("\n".join(_PAGES))
    cli.main(["adjacency", str(tmp_path / "wiki.txt"), str(tmp_path / "a")])
    assert lines(spark, tmp_path / "a") == ["A B\t", "A\t", "B_1\t", "Band_(music)\t", "P1\tA|B_1|A", "P2\t", "P4\tBand_(music)|R&D|R&amp;D|A B", "R&D\t", "R&amp;D\t"]
    cli.main(["matrix", str(tmp_path / "wiki.txt"), str(tmp_path / "x")])
    assert len(lines(spark, tmp_path / "x/index")) == 9 and sum(line.endswith(",0,0.0") for line in lines(spark, tmp_path / "x/matrix")) == 3
    cli.main(["pagerank", str(tmp_path / "wiki.txt"), str(tmp_path / "p"), "--damped", "--top", "3"])
    top = [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert len(top) == 3 and top[0].endswith(",A)")


def test_classifier_programs(spark, tmp_path, capsys):
    head = "SAMPLING_EVENT_ID0,Agelaius_phoeniceus,COUNTY,COUNT_TYPE,GROUP_ID,PRIMARY_CHECKLIST_FLAG,EFFORT_DISTANCE_KM,NLCD_1\n"
    row = "S{k},{label},{county},P22,?,1,-{d},9\n"
    (tmp_path / "train.csv").write_text(head + "".join(row.format(k=k, label=5 * (k % 2), county="odd" if k % 2 else "even", d=k % 7) for k in range(400)))
    (tmp_path / "test.csv").write_text(head + "".join(row.format(k=k, label="?", county="odd" if k % 2 else "even", d=1) for k in range(10)))
    small = ["--trees", "5", "--depth", "3", "--bins", "16"]
    cli.main(["classify", str(tmp_path / "train.csv"), "--held-out", "0.2", *small])
    assert "accuracy 1.0" in capsys.readouterr().out
    cli.main(["predict", str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "o"), *small])
    got = spark.read.option("header", "true").csv(str(tmp_path / "o"))
    assert rows(got) == sorted((f"S{k}", "1.0" if k % 2 else "0.0") for k in range(10))
