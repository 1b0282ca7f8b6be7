"""The whole path from raw CSV files to the report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import statistics
from larder.plans import publish
from larder.sources.csv import read_csv, write_csv
from larder.sources.inference import _fits, repaired_names
from larder.sources.tables import load_tables, save_tables

HEAD = ("adm0_id,adm0_name,adm1_id,adm1_name,mkt_id,mkt_name,cm_id,cm_name,cur_id,cur_name,"
        "pt_id,pt_name,um_id,um_name,mp_month,mp_year,mp_price,mp_commoditysource\n")


def raw_line(country, market, food, unit, month, year, price, currency="AFN"):
    return (f'1,"{country}",2,"Prov",3,"{market}",4,"{food}",5,{currency},6,Retail,7,{unit},'
            f'{month},{year},{price},"WFP"\n')


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    source = tmp_path_factory.mktemp("source")
    root = str(tmp_path_factory.mktemp("tables"))
    lines = [HEAD]
    for i in range(12):
        month, year = i % 12 + 1, 2001
        mali = "Mali" if i % 2 else "Mali  "
        lines.append(raw_line(mali, "Bamako", "Rice (local)", "KG", month, year, 100 + i))
        lines.append(raw_line("Nepal", "National Average", "Rice", "50 KG", month, year, 10 * (i + 1)))
        lines.append(raw_line("Somalia", "Hargeysa", "Rice", "KG", month, year, 5, "Somaliland Shilling"))
    lines.append(raw_line("Mali", "Bamako", "Rice", "KG", 1, 1999, 1))
    lines.append(raw_line("Mali", "Bamako", "Rice", "KG", 1, 2016, 1))
    lines.append(raw_line("Mali", "Bamako", "Fuel", "L", 1, 2001, 1))
    lines.append(raw_line("Nowhere", "M", "Rice", "KG", 1, 2001, 1))
    lines.append(raw_line("Mali", "Bamako", "Rice", "KG", 1, 2001, "NA"))
    years = [f"X{y}" for y in range(1960, 2017)]
    files = {
        "food": "".join(lines),
        "currency": 'Entity,Currency,AlphabeticCode,NumericCode,MinorUnit,WithdrawalDate\n'
                    'A,Afghani,AFN,971,2,\nB,Afghani,AFN,971,2,\nC,None,XXX,999,,\nD,Old,,1,,\n',
        "ppp": "Country Name,Country Code,Indicator Name,Indicator Code," + ",".join(years) + "\n"
               + "".join(f"{c},{k},PPP,PA.NUS.PPP," + ",".join(v if y == "X2001" else "" for y in years)
                         + "\n" for c, k, v in (("Mali", "MLI", "200"), ("Nepal", "NPL", "25"))),
        "region": "food_country_name,code,incomegroup,region,ppp_country_name\n"
                  "Mali,MLI,Low income,Sub-Saharan Africa,Mali\n"
                  "Nepal,NPL,Low income,South Asia,Nepal\n"
                  "Somalia,SOM,Low income,Sub-Saharan Africa,Somalia\n",
        "groups": "food_name,food_group\nRice,Cereal\nRice (local),Cereal\nFuel,Not Food\n",
    }
    for name, text in files.items():
        (source / publish.FILES[name]).write_text(text)
    food = publish.clean_inputs(spark, str(source), root)
    publish.analyse(spark, root)
    return food, root


def test_clean_food(published, rows):
    food, _ = published
    assert rows(food.groupBy("country", "import").count()) == [
        ("Mali", "Local", 12), ("Mali", "Not Import", 12), ("Nepal", "Not Import", 12),
        ("Somalia", "Not Import", 12),
    ]
    row = food.filter("country = 'Mali' AND month = '03' AND import = 'Local'").first()
    assert row["date"] == dt.date(2001, 3, 1) and row["food_group"] == "Rice"
    assert (row["unit"], row["unit_type"], row["ppp_factor"]) == (1000.0, "G", 200.0)
    assert row["unified_price"] == 102 / 200 and row["price_per_one_unit"] == 102 / 200 / 1000
    somali = food.filter("country = 'Somalia'").first()
    assert somali["currency"] == "SOS" and somali["ppp_factor"] is None


def test_clean_csv_files(spark, published, rows):
    _, root = published
    codes = read_csv(spark, f"{root}/csv/currency_codes", "Currency string, AlphabeticCode string")
    assert rows(codes) == [("Afghani", "AFN")]
    head = spark.read.option("header", True).csv(f"{root}/csv/ppp").columns
    assert head == ["country", "country_code", *[f"X{y}" for y in range(2000, 2016)]]


def test_source_group_can_be_kept(spark, tmp_path):
    from larder.plans import cleaning

    rows = spark.createDataFrame(
        [("A", "p", "m", "Rice (coarse)", "USD", "Retail", "KG", "01", 2001, dt.date(2001, 1, 1), 1.0)],
        "country string, city string, market string, food_name string, currency string, "
        "seller_type string, unit string, month string, year int, date date, price double")
    region = spark.createDataFrame(
        [("A", "a", "Low income", "South Asia", "A")],
        "food_country_name string, code string, incomegroup string, region string, "
        "ppp_country_name string")
    groups = spark.createDataFrame([("Rice (coarse)", "Cereal")], "food_name string, food_group string")
    ppp = spark.createDataFrame([("A", "a", 4.0)], "country string, country_code string, X2001 double")
    out = cleaning.clean_food(rows, region, groups, ppp, with_source_group=True).first()
    assert (out["food_group"], out["source_food_group"]) == ("Rice", "Cereal")
    assert out["price_per_one_unit"] == 1.0 / 4 / 1000


def test_analysis_tables(spark, published, rows):
    _, root = published
    tables = load_tables(
        spark, root, ["series", "stats", "world", "region", "import", "national",
                      "cost_to_survive"])
    assert tables["series"].count() == 48
    assert rows(tables["national"].groupBy("country", "market").count()) == [
        ("Mali", "National Average", 12), ("Nepal", "National Average", 12)]
    # Somalia has no factor, so every world mean that needs one is missing.
    assert tables["world"].filter("unified_price IS NOT NULL").count() == 0
    assert tables["region"].filter("region = 'South Asia'").count() == 12
    nepal = tables["cost_to_survive"].filter("country = 'Nepal'").first()
    daily = sum(10 * (i + 1) / 25 / 50000 for i in range(12)) / 12 * 769.23076923
    assert nepal["price_to_survive"] == pytest.approx(daily * 365)


def test_report(spark, published):
    _, root = published
    report = publish.report(spark, root).collect()
    assert [r["country"] for r in report] == ["Nepal", "Mali", "Somalia"]
    changes = [100 * ((i + 2) / (i + 1) - 1) for i in range(11)]
    assert report[0]["avg_infla"] == pytest.approx(sum(changes) / 11)


def test_csv_text(spark, tmp_path, rows):
    text = [("a,b", 1.5e9, None), ('say "x"', None, 3), ("", 2.0, 4), (None, 0.5, 5), (" s ", 1.0, 6)]
    df = spark.createDataFrame(text, "t string, v double, n int")
    path = str(tmp_path / "out")
    write_csv(df.coalesce(1), path)
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "1500000000" in written and "E9" not in written and "NA" in written
    assert rows(read_csv(spark, path, "t string, v double, n int")) == rows(df)


def test_csv_missing_token(spark, tmp_path, rows):
    (tmp_path / "f.csv").write_text('t,v\nNA,NA\n,\n"",1\n"NA",x\n')
    path, schema = str(tmp_path / "f.csv"), "t string, v double"
    assert rows(read_csv(spark, path, schema)) == [
        ("", 1.0), ("", None), (None, None), (None, None)]
    assert rows(read_csv(spark, path, schema, na="")) == [
        ("NA", None), ("NA", None), (None, 1.0), (None, None)]


def test_csv_columns_go_by_name(spark, tmp_path, rows):
    (tmp_path / "f.csv").write_text("Some Name,2000,v\na,1.5,2\n")
    (tmp_path / "g.csv").write_text("2000,v,Some Name\n1.5,2,a\n")
    schema = "v int, X2000 double, `Some.Name` string"
    for name in "fg":
        assert rows(read_csv(spark, str(tmp_path / f"{name}.csv"), schema)) == [(2, 1.5, "a")]
    with pytest.raises(ValueError, match="header has no t"):
        read_csv(spark, str(tmp_path / "f.csv"), "t string, v int")
    with pytest.raises(Exception, match="(?i)header"):  # two files that do not agree
        read_csv(spark, str(tmp_path), schema).collect()


def test_names_are_repaired():
    header = ["Country Name", "2000", "ok_1", "", ".5a", ".a", "_b", "if", "x", "x", "x.1", "x", "é-è", None]
    assert repaired_names(header) == [
        "Country.Name", "X2000", "ok_1", "X", "X.5a", ".a", "X_b", "if.", "x", "x.2", "x.1", "x.3",
        "é.è", "X.1"]


def test_types_are_inferred_by_the_last_odd_row(spark, tmp_path):
    plain = ["T", "1", "1", "1", "NA", "", " 7 ", "1", "2147483647", "-2147483648", "1", "x y", "TRUE"]
    odd = ["false", "NA", "2.5e3", "a", "NA", " ", "", "Inf", "2147483648", "0", "1,5", "", "yes"]
    cells = [",".join(f'"{v}"' for v in row) for row in [plain] * 20_000 + [odd]]
    folder = tmp_path / "wide"
    folder.mkdir()
    head = ",".join(f"c{i}" for i in range(len(plain)))
    for part in range(4):  # the odd row is the last of the last file
        (folder / f"p{part}.csv").write_text("\n".join([head, *cells[part * 5001:(part + 1) * 5001]]))
    found = read_csv(spark, str(folder))
    assert [kind for _, kind in found.dtypes] == [
        "boolean", "int", "double", "string", "boolean", "boolean", "int", "double", "double",
        "double", "string", "string", "string"]
    row = found.where("c0 = false").collect()
    assert len(row) == 1 and tuple(row[0])[1:3] == (None, 2500.0) and row[0].c7 == float("inf")
    assert found.select("c6").distinct().count() == 2 and found.where("c11 = ''").count() == 1
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    assert read_csv(spark, str(empty)).dtypes == [("a", "boolean"), ("b", "boolean")]


def test_numbers_are_told_without_casts_that_fail(spark):
    bits = {"T": 1, "7": 6, " +007 ": 6, "0": 6, "2147483647": 6, "-2147483647": 6, "12\n": 6,
            "000000000000012": 6, "2147483648": 4, "-2147483648": 4, "99999999999": 4, "1.": 4,
            ".5": 4, "NaN": 4, "inf": 4, "-1e5": 4, "1996-01-01": 0, "India": 0, "12a": 0, "x": 0}
    texts = spark.createDataFrame([(text,) for text in bits], "text string")
    found = texts.select("text", _fits(texts["text"]).alias("fits"))
    assert dict(found.collect()) == bits
    assert "cast" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_job_that_dies_leaves_the_former_tables(spark, tmp_path, rows):
    root = str(tmp_path / "tables")
    former = {name: spark.createDataFrame([(name, 1)], "food_group string, v int") for name in "ab"}
    save_tables(former, root)
    broken = former["b"].select("food_group", F.raise_error(F.lit("lost")).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        save_tables({"a": former["a"].withColumn("v", F.lit(2)), "b": broken}, root)
    loaded = load_tables(spark, root, ["a", "b"])
    assert [rows(loaded[name].select("food_group", "v")) for name in "ab"] == [[("a", 1)], [("b", 1)]]
    # A table may be made from its own former version, and others keep theirs.
    save_tables({"a": loaded["a"].withColumn("v", F.col("v") + 2)}, root)
    again = load_tables(spark, root, ["a", "b"])
    assert [again[name].first()["v"] for name in "ab"] == [3, 1]
    assert loaded["a"].first()["v"] == 1
    with pytest.raises(FileNotFoundError, match="c"):
        load_tables(spark, root, ["a", "c"])


def test_stored_sketches_join(spark, tmp_path):
    path = str(tmp_path / "sketches")
    for month in range(3):  # each month adds its own rows; half its values are the next one's too
        new = spark.range(month * 100_000, (month + 2) * 100_000).withColumn("month", F.lit(month))
        statistics.distinct_sketches(new, "id", ["month"]).write.mode("append").parquet(path)
    sketches = spark.read.parquet(path)
    total = statistics.count_distinct_of(sketches).first()["n"]
    assert abs(total / 400_000 - 1) < 3 * 2 ** (-statistics.SKETCH_BITS / 2)
    for row in statistics.count_distinct_of(sketches, ["month"]).collect():
        assert abs(row["n"] / 200_000 - 1) < 3 * 2 ** (-statistics.SKETCH_BITS / 2)
    few = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("",)], "v string")
    assert statistics.count_distinct_of(statistics.distinct_sketches(few, "v", [])).first()["n"] == 3
