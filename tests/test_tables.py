import duckdb
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from runwise.schemas import PERSON, PERSON_COLUMNS
from runwise.sources import (
    generate_persons, parquet_footers, parquet_profile, person_ids, pools, read_table, write_table,
)


def test_unknown_format_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        read_table(spark, "orc", str(tmp_path))
    with pytest.raises(ValueError):
        write_table(spark.range(1), "orc", str(tmp_path))


def test_csv_keeps_digit_strings(spark, tmp_path):
    people = generate_persons(person_ids(spark, 200))
    path = str(tmp_path / "csv")
    write_table(people, "csv", path)
    plain = read_table(spark, "csv", path)
    assert {f.dataType.simpleString() for f in plain.schema} == {"string"}
    assert plain.exceptAll(people).isEmpty() and people.exceptAll(plain).isEmpty()
    assert read_table(spark, "csv", path, schema=PERSON).exceptAll(people).isEmpty()
    inferred = dict(read_table(spark, "csv", path, infer=True).dtypes)
    assert inferred["series_passport"] == "int" and inferred["city"] == "string"


def test_csv_empty_field_is_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,\n,x\n")
    rows = [tuple(r) for r in read_table(spark, "csv", str(tmp_path)).collect()]
    assert rows == [("1", None), (None, "x")]


def test_parquet_round_trip(spark, tmp_path):
    people = generate_persons(person_ids(spark, 100))
    path = str(tmp_path / "parquet")
    write_table(people, "parquet", path)
    write_table(people, "parquet", path)
    assert read_table(spark, "parquet", path).count() == 100
    assert ".snappy" in "".join(p.name for p in (tmp_path / "parquet").iterdir())


def test_persons_do_not_depend_on_partitioning(spark):
    one = generate_persons(person_ids(spark, 3000).coalesce(1))
    many = generate_persons(person_ids(spark, 3000).repartition(17))
    assert one.exceptAll(many).isEmpty()
    other = generate_persons(person_ids(spark, 3000), seed=5)
    assert other.exceptAll(one).count() == 3000


def test_person_domains(spark):
    people = generate_persons(person_ids(spark, 20000)).cache()
    assert tuple(people.columns) == PERSON_COLUMNS
    domains = {"surname": pools.SURNAMES, "name": pools.NAMES, "patronymic": pools.PATRONYMICS,
               "street": pools.STREETS, "city": pools.CITIES}
    for column, pool in domains.items():
        assert {r[0] for r in people.select(column).distinct().collect()} == set(pool)
    assert (len(pools.SURNAMES), len(pools.NAMES), len(pools.PATRONYMICS)) == (92, 95, 100)
    bad = people.filter(
        ~F.col("phone").rlike(r"^\+7\d{10}$") | ~F.col("series_passport").rlike(r"^\d{4}$")
        | ~F.col("number_passport").rlike(r"^\d{6}$")
        | ~F.col("birthday").rlike(r"^([1-9]|1\d|2[0-8])\.([1-9]|1[0-2])\.(19[5-9]\d|2000)$")
        | ~F.col("created_dt").rlike(r"^([1-9]|1\d|2[0-8])\.([1-9]|1[0-2])\.202[0-2]$")
        | ~F.col("updated_dt").rlike(r"^([1-9]|1\d|2[0-8])\.([1-9]|1[0-2])\.202[0-2]$")
    )
    assert bad.isEmpty()
    plain = generate_persons(person_ids(spark, 5), phone_prefix="")
    assert plain.filter(~F.col("phone").rlike(r"^\d{10}$")).isEmpty()


@pytest.mark.parametrize("columns", [["street"], ["city"], ["street", "city"], ["surname"], ["surname", "city"]])
def test_draws_are_even_and_independent(spark, columns):
    n = 100_000
    cells = 1
    for c in columns:
        cells *= len({"street": pools.STREETS, "city": pools.CITIES, "surname": pools.SURNAMES}[c])
    counts = generate_persons(person_ids(spark, n)).groupBy(columns).count()
    chi2 = counts.selectExpr(f"sum(pow(count - {n / cells}, 2) / {n / cells})").first()[0]
    assert chi2 < cells + 6 * (2 * cells) ** 0.5


def test_repeated_names_come_twice_as_often(spark):
    counts = dict(generate_persons(person_ids(spark, 200_000)).groupBy("name").count().collect())
    assert 1.6 < counts["Иван"] / counts["Игорь"] < 2.4


def test_large_ids_stay_in_range(spark):
    ids = spark.createDataFrame([(2**62,), (2**31 - 1,), (2**31,), (2**40 + 7,)], "id bigint")
    assert generate_persons(ids).distinct().count() == 4


def test_generator_is_one_narrow_stage(spark, plan):
    text = plan(generate_persons(person_ids(spark, 10)))
    assert "Exchange" not in text and "Python" not in text


def test_footers_agree_with_an_independent_reader(spark, sf_dir):
    got = {r.path.rsplit("/", 1)[1]: (r.num_rows, r.num_columns, r.serialized_size)
           for r in parquet_footers(spark, sf_dir).collect()}
    facts = duckdb.sql(f"select file_name, num_rows, footer_size from parquet_file_metadata('{sf_dir}/*.parquet')")
    for name, rows, size in facts.fetchall():
        name = name.rsplit("/", 1)[1]
        columns = len(duckdb.sql(f"select * from '{sf_dir}/{name}' limit 0").columns)
        assert got.pop(name) == (rows, columns, size)
    assert not got


def test_footers_through_a_given_file_system(spark, sf_dir):
    plain = parquet_footers(spark, sf_dir)
    assert plain.exceptAll(parquet_footers(spark, sf_dir, fs.LocalFileSystem())).isEmpty()


def test_profile_skips_junk_and_other_files(spark, tmp_path):
    write_table(spark.range(100).repartition(3), "parquet", str(tmp_path / "a"))
    write_table(spark.range(7).selectExpr("id", "id x"), "parquet", str(tmp_path / "b" / "c"))
    (tmp_path / "junk.parquet").write_bytes(b"not parquet")
    (tmp_path / "empty.parquet").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("x")
    row = parquet_profile(parquet_footers(spark, str(tmp_path))).first()
    assert (row.total_num_rows, row.max_num_columns) == (107, 2)
    assert row.total_serialized_size > 0


def test_profile_of_nothing_has_no_row(spark, tmp_path):
    (tmp_path / "junk.parquet").write_bytes(b"not parquet")
    assert parquet_profile(parquet_footers(spark, str(tmp_path))).count() == 0


def test_footers_that_cannot_be_read_fail(spark, tmp_path):
    from pyarrow import fs

    spark.range(3).write.parquet(f"{tmp_path}/t")
    gone = fs.SubTreeFileSystem(f"{tmp_path}/elsewhere", fs.LocalFileSystem())
    with pytest.raises(Exception, match="FileNotFoundError|Failed to open"):
        parquet_footers(spark, f"{tmp_path}/t", gone).collect()
