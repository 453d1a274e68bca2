import gzip

from lumenrel.sources.files import Folder, csv
from lumenrel.streaming.steps import stream, unbounded


def test_csv_headers_and_folders(spark, tmp_path):
    (tmp_path / "scott").mkdir()
    (tmp_path / "scott" / "depts.csv").write_text("deptno:int,dname:string,loc:string\n10,'ACCOUNTING','NEW YORK'\n20,'RES,EARCH','DALLAS'\n")
    with gzip.open(tmp_path / "scott" / "pay.csv.gz", "wt") as f:
        f.write("sal:decimal,ok:bool,n:int\n1.5,true,NULL\nNULL,false,7\n")
    file = Folder(spark, "file://" + str(tmp_path))
    assert dir(file) == ["scott"] and dir(file.scott) == ["depts", "pay"]
    depts = file.scott.depts
    assert depts.columns == ["deptno", "dname", "loc"] and [tuple(r) for r in depts.collect()] == [(10, "ACCOUNTING", "NEW YORK"), (20, "RES,EARCH", "DALLAS")]
    assert sorted(tuple(r) for r in file.scott["pay"].select("n", "ok", "sal").collect()) == [(0, True, 1.5), (7, False, 0.0)]
    assert csv(spark, str(tmp_path / "scott" / "depts.csv")).count() == 2


def test_stream(spark, tmp_path):
    df = spark.range(10).selectExpr("cast(id as int) as k")
    df.write.parquet(str(tmp_path / "in"))
    q = stream(spark, str(tmp_path / "in"), df.schema).where(lambda k: k > 6)
    run = unbounded(q).writeStream.format("memory").queryName("streamed").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.k for r in spark.sql("select k from streamed").collect()) == [7, 8, 9]
