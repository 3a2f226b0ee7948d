"""Typing rules, readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from tidewrack import sources
from tidewrack.functions import clock
from tidewrack.operators import schema

from .helpers import frame, rows, ts


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        data = text if isinstance(text, bytes) else text.encode()
        (folder / name.replace("__", ".")).write_bytes(data)
    return str(folder)


def test_normalise_wq(spark):
    df = frame(spark, "RowID int,Station_Code string,DateTimeStamp ts,Temp string,F_Temp string,SiteName string",
               [(1, "s", "2023-01-01 00:00:00", "4.5", "<0>", "x"), (2, "s", "2023-01-01 00:15:00", "n/a", "<0>", "x")])
    out = schema.normalise_wq(df)
    assert out.dtypes == [
        ("station_code", "string"), ("datetimestamp", "timestamp_ntz"), ("historical", "double"), ("provisionalplus", "double"),
        ("temp", "double"), ("f_temp", "string"), ("sitename", "string"),
    ]
    assert [r.temp for r in out.orderBy("datetimestamp").collect()] == [4.5, None]
    with pytest.raises(ValueError):
        schema.normalise_wq(df.drop("DateTimeStamp"))


def test_normalise_met_rule_order(spark):
    row = ("s", *["2023-01-01 03:02:00"] * 4, "2023-01-01 04:05:00", "7", "<0>")
    df = frame(spark, "Station string,DateTimeStamp ts,MinTempT ts,MaxTempT ts,MaxWSpdT ts,F_MaxTempT string,ATemp string,F_ATemp string", [row])
    out = schema.normalise_met(df).first()
    assert out.MinTempT == "03:02" and out.F_MaxTempT == "04:05" and out.ATemp == 7.0 and out.F_ATemp == "<0>"
    with pytest.raises(ValueError, match="MaxTempT"):
        schema.normalise_met(df.withColumn("MaxTempT", F.lit("03:02")))


def test_normalise_met_raw_and_logger(spark):
    df = spark.createDataFrame([("08/29/21 12:15", "40117", "3:2", "<0>", "1.5"), ("08/29/2021 12:30", "x", None, None, "")],
                               "TIMESTAMP string, RECORD string, MaxTempT string, F_BP string, BP string")
    out = rows(schema.normalise_met_raw(df), "TIMESTAMP")
    assert out == [(ts("2021-08-29 12:15"), 40117.0, "03:02", "<0>", 1.5), (ts("2021-08-29 12:30"), None, None, None, None)]
    typed = schema.type_logger(df, clock.LOGGER_FORMATS, rename_stamp="DateTimeStamp", drop=["F_BP"])
    assert typed.dtypes == [("DateTimeStamp", "timestamp_ntz"), ("RECORD", "int"), ("MaxTempT", "string"), ("BP", "double")]


def test_column_tools(spark):
    df = spark.createDataFrame([(1, "H3 2023", None, "BX")], "a int, x string, y string, z string")
    assert schema.split_label(df, "x", ["site", "year"], delimiter=" ").columns == ["a", "site", "year", "y", "z"]
    assert schema.split_label(df, "z", ["p", "q"], position=1, keep=True).first()[3:] == ("BX", "B", "X")
    assert schema.unite_label(df, "l", ["x", "y"], "-").first() == (1, "H3 2023-NA", "BX")
    assert schema.unite_label(df, "l", ["x", "y"], "-", remove=False).columns == ["a", "l", "x", "y", "z"]
    moved = schema.select_rename_relocate(df, drop=[3], rename={"y": "why"}, front=["why"])
    assert moved.columns == ["why", "a", "x"]
    long = schema.pivot_longer(df, ["a"], ["x", "y"])
    assert long.count() == 2 and schema.pivot_longer(df, ["a"], ["x", "y"], drop_null=True).count() == 1
    with pytest.raises(ValueError):
        schema.split_label(df, "x", ["p"], delimiter=" ", position=1)


def test_stack_evolving(spark):
    a = spark.createDataFrame([(1,)], "r int")
    b = spark.createDataFrame([(2.0, 2)], "rad double, r int")
    out = schema.stack_evolving([("ap", a), ("ho", b)], add_null={"f_rad": "string"})
    assert rows(out) == sorted([("ap", 1, None, None), ("ho", 2, 2.0, None)], key=repr)


def test_strict_and_lenient_csv(spark, tmp_path):
    p = put(tmp_path / "a", a__csv="id,t,x\n1,2021-08-29 12:15:00,1.5\n2,2021-08-29T12:30:00.250000,NA\n", skip__txt="no")
    df = sources.scan_csv_dir(spark, p, "id int, t timestamp_ntz, x double", file="f")
    assert rows(df) == [(1, ts("2021-08-29 12:15"), 1.5, "a.csv"), (2, ts("2021-08-29 12:30:00.25"), None, "a.csv")]
    q = put(tmp_path / "b", b__csv="id,y\n3,7\n")
    with pytest.raises(Exception):
        sources.scan_csv_dir(spark, [p, q], "id int, t timestamp_ntz, x double").collect()
    both = sources.scan_csv_variants(spark, [(p, "id int, t timestamp_ntz, x double"), (q, "id int, y int")])
    assert rows(both.select("id", "x", "y")) == sorted([(1, 1.5, None), (2, None, None), (3, None, 7)], key=repr)


def test_select_files_prunes(spark, tmp_path):
    p = put(tmp_path / "f", ho01_QC__dat="1\n", ap01_QC__dat="2\n", ho01__dat="3\n", x__DS_Store="4\n")
    df = spark.read.schema("v int").csv(p)
    got = sources.select_files(df, ["(?<=QC).dat$", "ho"], exclude=[r"\.DS_"])
    assert rows(got) == [(1,)]


LOGGER = '''"TOA5","kb"
"TIMESTAMP","RECORD","AvgVolt","MaxTempT","MinTempT","MaxWSpdT"
"TS","RN","Volts","","",""
"","","Avg","TMx","TMn","TMx"
"2021-08-29 12:15:00","40117","12.9","3:2","12:10","0:0"
"2021-08-29 12:30:00","40118","","12:16","12:30","12:29"
'''


def test_logger_there_and_back(spark, tmp_path):
    p = put(tmp_path / "l", one__csv=LOGGER, two__csv=LOGGER.replace("40117", "40119"))
    names = ["TIMESTAMP", "RECORD", "AvgVolt", "MaxTempT", "MinTempT", "MaxWSpdT"]
    raw = sources.scan_logger(spark, p, names)
    assert raw.count() == 4 and {r.file for r in raw.collect()} == {"one.csv", "two.csv"}
    typed = schema.type_logger(raw.drop("file")).distinct()
    assert typed.where("RECORD = 40117").first()[1:] == (40117, 12.9, "03:02", "12:10", "00:00")
    out = str(tmp_path / "out")
    sources.write_logger(typed.where("RECORD in (40117, 40119)").orderBy("RECORD").coalesce(1), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert lines[0] == '"2021-08-29 12:15:00","40117","12.9","3:2","12:10","0:0"'


def test_sonde_files(spark, tmp_path):
    head = b"KOR export\nSerial,1\n\nx\nx\nx\nx\nx\n"
    names = b"Date (MM/DD/YYYY),Time (HH:mm:ss),Temp \xb0C\n"
    body = b"12/01/2022,00:15:00,4.5\n\n" + names + b"12/01/2022,00:30:00,NaN\n12/02/2022,,NA\n"
    p = put(tmp_path / "s", a__csv=head + names + body)
    cols = ["Date (MM/DD/YYYY)", "Time (HH:mm:ss)", "Temp °C"]
    got = rows(sources.scan_sonde_csv(spark, p, cols))
    assert got == sorted([("12/01/2022", "00:15:00", "4.5"), ("12/01/2022", "00:30:00", None), ("12/02/2022", None, None)], key=repr)
    assert sources.scan_sonde_csv(spark, p, cols, keep_headers=True).count() == 5


def test_columns_by_each_files_own_header(spark, tmp_path):
    other = 'info\n"RECORD","TIMESTAMP","Batt"\n"5","2020-01-01 00:00:00","1"\n"6","2020-01-01 00:15:00","2"\n'
    data = "".join(f'"{i}","2021-01-01 00:00:{i % 60:02d}","b, {i}"\n\n' for i in range(3000))
    p = put(tmp_path / "l", one__csv=LOGGER, two__csv=other + data, three__csv="only\n", four__csv=other, five__csv="")
    whole = None
    for size in ("128m", "4k"):  # 4k: files in many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = sources.scan_logger(spark, p)
            got = rows(df)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(df.columns) == ["AvgVolt", "Batt", "MaxTempT", "MaxWSpdT", "MinTempT", "RECORD", "TIMESTAMP", "file"]
        assert whole is None or got == whole
        whole = got
    found = {(r.RECORD, r.TIMESTAMP, r.Batt, r.AvgVolt, r.MaxTempT, r.file) for r in df.collect()}
    assert found == {(str(i), f"2021-01-01 00:00:{i % 60:02d}", f"b, {i}", None, None, "two.csv") for i in range(3000)} | {
        ("40117", "2021-08-29 12:15:00", None, "12.9", "03:02", "one.csv"),
        ("40118", "2021-08-29 12:30:00", None, None, "12:16", "one.csv"),
    }
    picked = sources.scan_headed(spark, p, 1, 4, names=["Batt", "nowhere"], file=None)
    assert picked.columns == ["Batt", "nowhere"] and picked.where("nowhere is not null").count() == 0


def test_leading_lines_in_several_splits(spark, tmp_path):
    """A preamble longer than a split."""
    top = "".join(f"{'x' * 60},{i}\n" for i in range(400))
    p = put(tmp_path / "l", a__csv=top + "v,k\n" + "".join(f"v{i},{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = sources.scan_headed(spark, p, names_line=400, skip=401, file=None)
        assert spark.read.text(p).rdd.getNumPartitions() > 5
        assert df.columns == ["v", "k"] and rows(df) == sorted(((f"v{i}", str(i)) for i in range(500)), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sondes_by_their_own_headers(spark, tmp_path):
    head = b"KOR export\nSerial,1\n\n12/01/2022,00:15:00,1\nx\nx\nx\nx\n"
    one = head + b"Date (MM/DD/YYYY),Temp \xb0C\n12/01/2022,4.5\n\nDate (MM/DD/YYYY),Temp \xb0C\n12/02/2022,NA\n"
    two = head + b"Site,Date (MM/DD/YYYY)\nA\xf1o,12/03/2022\n"
    p = put(tmp_path / "s", a__csv=one, b__csv=two)
    got = rows(sources.scan_sonde_csv(spark, p))
    assert got == sorted([("12/01/2022", "4.5", None), ("12/02/2022", None, None), ("12/03/2022", None, "Año")], key=repr)
    assert sources.scan_sonde_csv(spark, p, keep_headers=True).count() == 4


def test_binding_by_occurrence(spark):
    a = spark.createDataFrame([(1, 5), (1, 3), (None, 9), (None, 8), (2, 0)], "k int, v int")
    b = spark.createDataFrame([(1, 30), (None, 90), (None, 91), (None, 92), (3, 70)], "k int, v int")
    want = [(1, 3, 30), (1, 5, None), (None, 8, 90), (None, 9, 91), (None, None, 92), (2, 0, None), (3, None, 70)]
    got = sources.bind_files_by_key({"a": a, "b": b}, "k", order=["v"])
    assert got.columns == ["k", "v_a", "v_b"] and rows(got) == sorted(want, key=repr)
    # a key that holds nearly all rows, over many blocks
    n = 3000
    x = spark.range(n).selectExpr("if(id < 2900, 7, id) as k", "id as v")
    y = spark.range(n).selectExpr("if(id < 2800, 7, id) as k", "id + 100000 as v")
    bound = sources.bind_files_by_key({"x": x, "y": y}, "k", order=["v"], block_rows=64)
    assert {(r.v_x, r.v_y) for r in bound.where("k = 7").collect()} == {(i, i + 100000 if i < 2800 else None) for i in range(2900)}
    assert bound.count() == 2900 + 200
    unordered = sources.bind_files_by_key({"a": a, "b": b}, "k")
    assert sorted((r.k is None, r.v_a is None, r.v_b is None) for r in unordered.collect()) == sorted(
        (k is None, v is None, w is None) for k, v, w in want
    )


def test_station_codes_are_whole_words(spark, tmp_path):
    p = put(tmp_path / "a", dlwq__csv="v\n1\n", dlwq2__csv="v\n2\n", dlwq2021__csv="v\n3\n", dlwq_2022__csv="v\n4\n", dlwq20219__csv="v\n5\n", dlwq2021b__csv="v\n6\n")
    got = rows(sources.import_stations(spark, p, ["dlwq"], "v int"))
    assert got == [("dlwq", 1), ("dlwq", 3), ("dlwq", 4)]


def test_two_space_table(spark, tmp_path):
    text = "{\\rtf1\n       Jan.       Feb.  \\\nDay Rise  Set  Rise  Set\\\n01  1007 1615  0919 1724\\\n30  0924 1719  9999 9999\\\n31  0921 1721  9999 9999}"
    p = put(tmp_path / "r", sun__rtf=text)
    got = rows(sources.scan_two_space_table(spark, p, ["day", "m01", "m02"]), "day")
    assert got == [("01", "1007 1615", "0919 1724"), ("30", "0924 1719", None), ("31", "0921 1721", None)]


def test_stations_and_binding(spark, tmp_path):
    p = put(tmp_path / "z", kbhswq2001__csv="x\n1\n", kbhswq2002__csv="x\n2\n", kbsswq2001__csv="x\n3\n", other__csv="x\n4\n")
    got = sources.import_stations(spark, p, ["kbhswq", "kbsswq"], "x int")
    assert got.columns == ["station_code", "x"]
    assert rows(got) == [("kbhswq", 1), ("kbhswq", 2), ("kbsswq", 3)]
    a = spark.createDataFrame([(1, 10, 0), (2, 20, 0)], "d int, v int, site int")
    b = spark.createDataFrame([(2, 5), (3, 6)], "d int, v int")
    out = sources.bind_files_by_key({"depth": a, "swe": b}, "d", drop=["site"])
    assert rows(out, "d") == [(1, 10, None), (2, 20, 5), (3, None, 6)]


def test_csv_row_numbers_and_null(spark, tmp_path):
    df = spark.createDataFrame([(30, None), (10, "a"), (20, "b")], "k int, s string")
    path = str(tmp_path / "w")
    sources.write_csv_table(df, path, row_numbers=["k"])
    lines = sorted(r.value for r in spark.read.text(path).collect() if not r.value.startswith("row"))
    assert lines == ["1,10,a", "2,20,b", "3,30,NA"]


class Session:
    """Stands in for a session with or without a checkpoint folder."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        none = type("Option", (), {"isDefined": staticmethod(lambda: False)})
        java = type("Java", (), {"sc": staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: none)}))})
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": "local[2]", "_jsc": java})


def test_shared_folder_follows_the_session():
    assert sources.shared_folder(Session("hdfs://x/ck/"), "t") == "hdfs://x/ck/tidewrack/app-1/t"
    local = sources.shared_folder(Session(None), "t")
    assert local.endswith("/tidewrack/app-1/t") and local == sources.shared_folder(Session(None), "t")


def test_step_tables_need_a_shared_folder():
    """A session that is not local and states no folder is refused; a stated one is used."""
    from types import SimpleNamespace

    from tidewrack.operators import staging

    def session(master, setting=None, stated=None):
        folder = SimpleNamespace(isDefined=lambda: stated is not None, get=lambda: stated)
        context = SimpleNamespace(
            master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: folder))
        )
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: setting), sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging._base(session("spark://host:7077"))
    assert staging._base(session("spark://host:7077", stated="hdfs://x/c")) == "hdfs://x/c"
    assert staging._base(session("yarn", setting="s3://b/c")) == "s3://b/c"
    assert staging._base(session("local[4]")) == ""
