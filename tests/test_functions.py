from pyspark.sql import functions as F

from runwise.functions import keep_public, memory_to_bytes, parse_params, to_mib

G, M, K = 1 << 30, 1 << 20, 1 << 10


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first()["r"]


def test_memory_to_bytes(spark):
    expected = {
        "451m": 451 * M, "1g": G, "1G": G, "2gb": 2 * G, " 3g ": 3 * G, "536870912": 536870912, "512k": 512 * K,
        "1t": 1024 * G, "4gib": 4 * G, "007m": 7 * M,
        "abc": None, "": None, None: None, "1.5g": None, "-1g": None, "g": None, "1 g": None, "5b": None,
        "99999999999999999999": None, "9999999999999p": None,
    }
    rows = spark.createDataFrame([(k,) for k in expected], "v string")
    got = {r.v: r.b for r in rows.select("v", memory_to_bytes(F.col("v")).alias("b")).collect()}
    assert got == expected


def test_to_mib_rounds_up_for_both_signs(spark):
    assert one(spark, -322122547.2, to_mib, "double") == -307
    assert one(spark, float(M) + 1, to_mib, "double") == 2
    assert one(spark, None, to_mib, "double") is None


def test_parse_params(spark):
    cases = {
        "a=1;b=2": {"a": "1", "b": "2"},
        "a=1;a=2": {"a": "2"},
        "a=b=c;x": {"a": "b=c"},
        "=1;k=": {"k": ""},
        "": {},
        None: None,
    }
    for text, expected in cases.items():
        assert one(spark, text, parse_params) == expected, text


def test_keep_public_drops_secrets(spark):
    conf = {"fs.s3a.secret.key": "x", "fs.s3a.access.key": "x", "db.PASSWORD": "x", "spark.executor.memory": "1g"}
    assert one(spark, conf, keep_public, "map<string,string>") == {"spark.executor.memory": "1g"}
