"""Document operators against brute force, on small tables of hard rows and on the small test data."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import TESTDATA
from runwise.llm import brown, decontaminate, graph, language, lines, mixing, neardup, quality, substrings, suffixes, tokens, urls
from runwise.llm.queries import QUERIES, SQL, tokenizer_file

PLAIN = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# columns whose names operators use inside
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, row int, Kept int, quality int, size int, position int, text_hash int, k_hash int, spans int"


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


LONG = _prose(1, 30_000)
SHARED = _prose(2, 80)
HARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "123 !? 45", "en", None), (5, LONG, "en", "b"),
    (6, _prose(3, 60), "en", "b"), (6, _prose(3, 60), "en", "b"), (6, _prose(4, 60), "de", "b"), (None, _prose(5, 60), "de", "b"),
    (None, None, None, None), (7, "Été ÉTÉ KK İx " + SHARED, "fr", "c"), (8, SHARED + "\n" + _prose(6, 40), "fr", "c"),
    (9, "\n".join([_prose(7, 12), _prose(8, 12)] * 6), "fr", "c"), (10, "a", "en", "c"), (11, "the same five words here", "en", "c"),
    (12, "The SAME five, words here!", "en", "c"), (13, " | ".join(_prose(9, 40).split()), "en", "c"),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, l, s, None if t is None else len(t), 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t, l, s in HARD]
    return spark.createDataFrame(rows, CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{TESTDATA}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in entry._TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{TESTDATA}/{t}.parquet')")
    return con


def _counted(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_with_sql(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert _counted(df.select(*names).collect()) == _counted(result.fetchall())


@pytest.mark.parametrize("name", ["op2_url_filters", "op5_mixing", "op7_decontamination"])
def test_native_plans(spark, plan, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, TESTDATA)))


# --- languages ---------------------------------------------------------------

def test_language_accuracy(spark):
    truth = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_id"](spark, TESTDATA).join(truth, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == truth.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard_rows(spark, hard, none):
    model = language.fit(hard)
    assert model.langs == ["de", "en", "fr"]
    got = hard.select("text", language.identify(hard, model).alias("l")).select("text", "l.*").collect()
    for r in got:
        letters = r.text is not None and any(unicodedata.category(c).startswith("L") for c in r.text)
        assert (r.lang_pred in model.langs) if letters else (r.lang_pred, r.score) == ("und", 0.0)
    empty = language.fit(none)
    assert {r.l.lang_pred for r in hard.select(language.identify(hard, empty).alias("l")).collect()} == {"und"}
    assert none.select(language.identify(none, model)).count() == 0


def test_number_signs_are_no_letters(spark, hard):
    texts = ["½ ² 5", "Ⅷ ①", "٣ ৪", "_ - .", "5 a", "ª", "日本", "ǅ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.l.lang_pred for r in df.select(language.identify(df, language.fit(hard)).alias("l")).collect()]
    assert [g == "und" for g in got] == [True] * 4 + [False] * 4


def test_filters_hold_what_was_put_in():
    code, counts, starts = language.ngrams([b"abcd", b"", b"ab"])
    words = [b"  abcd  ", b"    ", b"  ab  "]
    joined = b"".join(words)
    assert starts.tolist() == [0, 8, 12]
    for i in range(len(joined) - 3):
        w = joined[i : i + 4]
        assert int(code[i]) == int.from_bytes(w, "little") and bool(counts[i]) == (b"  " not in w)


# --- urls --------------------------------------------------------------------

def test_urls_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://A.Example.COM/de/1?x=/y"), (5, "http://example.com/de"), (6, "https://x.net"),
            (7, "https://x.net/"), (8, "https://evilnet/fr/1"), (9, "https://a.example.net/en/9#t"), (9, "https://a.example.net/en/9#t"),
            (10, "http://o.org/fr/2"), (11, "http://o.org/" + "a/" * 500), (None, "http://É.org/fr/x")]
    rows += [(100 + i, f"http://shop.org/user/{'abcdefgh'[i % 8]}{chr(97 + i)}/posts") for i in range(26)]
    got = urls.judge_urls(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id int, url string, host string, Rule string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all((by[i].host, by[i].path, by[i].rule, by[i].verdict) == ("", "", None, "allow") for i in (1, 2, 3))
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert by[5].rule is None and by[6].rule is None and (by[6].host, by[6].path) == ("x.net", "")
    assert by[7].verdict == "block" and by[8].rule is None
    assert (by[9].rule, by[9].verdict) == ("example.net/en/", "allow") and by[10].rule == "org/fr/"
    assert by[11].template == "a/" * 500 and by[None].host == "É.org".replace("É", "É")
    assert {by[100 + i].template for i in range(26)} == {"*/*/posts"} or {by[100 + i].template for i in range(26)} == {"user/*/posts"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [("h", f"/bad/{i}", "block") for i in range(30)] + [("h", f"/bad/{i}.html", None) for i in range(3)]
    rows += [("h", f"/good/{i}", "allow") for i in range(30)] + [("h", f"/other/{i}", None) for i in range(30)] + [("h", f"/more/{i}", None) for i in range(30)]
    got = {r.typed: r for r in urls.template_tree(spark.createDataFrame(rows, "host string, path string, label string")).collect()}
    assert got["bad/<num>"].blocked and not got["good/<num>"].blocked and not got["other/<num>"].blocked
    assert got["other/<num>"].template == got["more/<num>"].template == "*/<num>"


def test_templates_decide_pages_without_a_rule(spark):
    """Pages shaped like those that a rule blocks go, also if they differ only far down the path; clean siblings stay."""
    deep = "/".join(f"s{i}" for i in range(12))
    urls_ = {f"http://shop.example.com/de/item/{i}": "block" for i in range(30)}
    urls_ |= {f"http://shop.example.com/{lang}/item/{i}": "block" for lang in ("fr", "en") for i in range(5)}
    urls_ |= {f"http://shop.example.com/fr/news/{i}": "allow" for i in range(5)} | {"http://shop.example.com/about": "allow"}
    urls_ |= {f"http://few.example.com/de/{i}": "block" for i in range(2)} | {f"http://few.example.com/es/{i}": "allow" for i in range(9)}
    urls_ |= {f"http://a.org/fr/{i}": "allow" for i in range(30)} | {f"http://a.org/de/{i}": "allow" for i in range(9)}
    urls_ |= {f"http://deep.example.com/de/{deep}/x/{i}": "block" for i in range(30)}
    urls_ |= {f"http://deep.example.com/en/{deep}/x/{i}": "block" for i in range(5)} | {f"http://deep.example.com/en/{deep}/y/{i}": "allow" for i in range(5)}
    rows = list(enumerate(urls_))
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert {urls_key: r.verdict for r in got for urls_key in [dict(rows)[r.page_id]]} == urls_
    free = {(r.host, r.verdict) for r in got if r.rule is None}
    assert {("shop.example.com", "block"), ("shop.example.com", "allow"), ("few.example.com", "allow"), ("a.org", "allow")} <= free


# --- tokens ------------------------------------------------------------------

def test_pieces_are_the_tokenizers_own():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole, pieces, r = Tokenizer.from_file(tokenizer_file()), tokens.Encoder(tokenizer_file()), random.Random(5)
    some = ["a", "é", "Z", "1", "²", ".", " ", "  ", "\n", "\t", "'s", "!", "%", "\x1d", " ", "<|endoftext|>", "日", " ", "_", "Ⅷ", ",", "'", "́", "\x85"]
    for _ in range(2000):
        x = "".join(r.choice(some) for _ in range(r.randint(0, 14)))
        assert pieces.encode([x])[0] == np.array(whole.encode(x, add_special_tokens=False).ids, "<u2").tobytes(), repr(x)


def test_token_files_of_a_given_store(spark, hard, tmp_path):
    """The path is one of a store that only the given file system knows."""
    from pyarrow import fs

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    path = "s3a://bucket/some shards"
    tokens.write_tokens(hard, path, tokenizer_file(), length=64, rows=4, filesystem=store).write.parquet(f"{tmp_path}/index")
    index = tokens.with_starts(spark.read.parquet(f"{tmp_path}/index"))
    got = tokens.read_documents(index, path, filesystem=store).select("doc_id", "n_tokens", "ids_crc32")
    tokens.write_tokens(hard, f"{tmp_path}/plain", tokenizer_file()).write.parquet(f"{tmp_path}/index2")
    plain = tokens.read_documents(tokens.with_starts(spark.read.parquet(f"{tmp_path}/index2")), f"{tmp_path}/plain")
    assert _counted(got.collect()) == _counted(plain.select("doc_id", "n_tokens", "ids_crc32").collect())
    assert list((tmp_path / "bucket" / "some shards").glob("*.arrow"))


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 50)
    encoder = tokens.Encoder(tokenizer_file())
    texts = [_prose(i, 30) for i in range(5)] + ["x" * 10_000]
    first = [encoder.encode([t])[0] for t in texts]
    assert encoder.encode(texts) == first and len(encoder.known) < 200


def test_token_files(spark, hard, none, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    path = f"file://{tmp_path}/shards"
    tokens.write_tokens(hard, path, tokenizer_file(), length=64, rows=4).write.parquet(f"{tmp_path}/index")
    index = tokens.with_starts(spark.read.parquet(f"{tmp_path}/index"))
    got = tokens.read_documents(index, path).orderBy("start").collect()
    ids = {t: whole.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in HARD}
    want = collections.Counter((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t, *_ in HARD)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in got][:2] == [None, None]
    # sequences and masks hold the same ids, and nothing else is real
    placed = index.orderBy("start").collect()
    for number in {r["shard"] for r in placed}:
        shard = tokens.Shard(tokens.shard_name(path, number))
        total = sum(r.n_tokens for r in placed if r["shard"] == number)
        n = sum(shard.file.get_batch(i).num_rows for i in range(shard.file.num_record_batches))
        assert n == -(-total // 64) and len(shard.sequence(n - 1)) == 64
        mask = np.concatenate([shard.file.get_batch(i).column(1).values.to_numpy(zero_copy_only=False) for i in range(shard.file.num_record_batches)])
        assert mask.sum() == total and mask[:total].all()
    tokens.write_tokens(none, f"{path}-none", tokenizer_file()).write.parquet(f"{tmp_path}/none")
    empty = tokens.with_starts(spark.read.parquet(f"{tmp_path}/none"))
    assert tokens.read_documents(empty, f"{path}-none").count() == 0


def test_token_query(spark, table):
    from tokenizers import Tokenizer

    whole, at, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for i in sorted(table):
        ids = whole.encode(table[i] or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op3_token_output"](spark, TESTDATA).collect())) == want


# --- repeated strings --------------------------------------------------------

def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(400):
        k, n = r.choice([1, 2, 3, 5, 300]), r.randint(0, 60)
        s = np.array([r.randrange(k) for _ in range(n)], np.int64)
        if n and r.random() < 0.3:
            s = np.tile(s[: max(1, n // 4)], 4)
        text = s.tolist()
        order = suffixes.suffix_array(s)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(s, order, 8)
        for a, b in zip(order.tolist(), order.tolist()[1:]):
            m = 0
            while m < 8 and max(a, b) + m < len(text) and text[a + m] == text[b + m]:
                m += 1
            assert shared[b] == m


def _cut(texts, length):
    """Brute force over bytes: (n_bytes, n_removed, n_spans, sha256) of each text."""
    count = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    for x in texts:
        covered = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        yield len(x), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(x, covered) if not c)).hexdigest()


@pytest.mark.parametrize("meet", [200, 1])
def test_repeated_strings_hard_rows(spark, none, monkeypatch, meet):
    monkeypatch.setattr(substrings, "MEET", meet)
    monkeypatch.setattr(substrings, "LONGER", (26, 36))
    monkeypatch.setattr(substrings, "TOGETHER", 3_000)  # long texts in parts
    r = random.Random(8)
    passage = _prose(11, 30)
    rows = [(i, t) for i, t, *_ in HARD if i != 5] + [(20, "ab" * 200), (21, "x" * 500), (22, "y" * 39 + "é"), (23, "y" * 39 + "è")]
    rows += [(30 + i, _prose(40 + i, r.randint(0, 12)) + passage[r.randint(0, 60) :] + _prose(90 + i, r.randint(0, 12))) for i in range(25)]
    rows.append((60, _prose(61, 3_000) + passage))
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id int, text string, key int, Spans string").repartition(4)
    got = substrings.cut_repeats(df, length=40, gram=16).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = collections.Counter((i, *w) for (i, _), w in zip(rows, _cut([(t or "").encode() for _, t in rows], 40)))
    assert _counted(got) == want
    assert substrings.cut_repeats(none).count() == 0


def test_repeated_strings_query(spark, table):
    ids = sorted(table)
    want = {i: w for i, w in zip(ids, _cut([(table[i] or "").encode() for i in ids], 400))}
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op4_suffix_dedup"](spark, TESTDATA).collect()} == want


# --- mixing ------------------------------------------------------------------

def test_mixing_query_reads_the_training_order(spark, monkeypatch):
    """The query's rows come from a table in the order of the schedules, at the positions of the mixed documents."""
    from runwise.llm import queries

    tables = {}
    keep = queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    got = queries.op5_mixing(spark, TESTDATA)
    order = tables["training_order"]
    mixed = mixing.mix(queries.table(spark, TESTDATA, "documents"), position="at")
    taken = order.filter("words > 0")
    assert sorted(map(tuple, taken.select("doc_id", "position").collect())) == sorted(map(tuple, mixed.select("doc_id", "at").collect()))
    by_file = taken.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("f").collect()
    assert all(x.b <= y.a for x, y in zip(by_file, by_file[1:]))
    middles = dict(taken.groupBy("source").agg(F.sum(F.col("position") * F.col("words")) / F.sum("words")).collect())
    first, *_, last = sorted(middles, key=lambda x: (x is None, x))[:3]
    assert middles[first] < 0.5 < middles[last]  # the first source fades, the third grows
    assert got.agg(F.sum("taken")).first()[0] == taken.agg(F.sum("words")).first()[0]


def test_mixing_hard_rows(spark, hard, none):
    got = mixing.mix_plan(hard).collect()
    assert len(got) == len(HARD)
    taken = collections.defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in got}
    sizes = {r.source: r.source_size for r in got}
    assert all(taken[s] == round(targets[s]) for s in targets)
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)
    assert _counted((r.doc_id, r.taken) for r in got) == _counted((r.doc_id, r.taken) for r in mixing.mix_plan(hard.repartition(7)).collect())
    mixed = mixing.mix(hard, position="at").collect()
    assert [r["at"] for r in mixed] == sorted(r["at"] for r in mixed) and all(0 <= r["at"] <= 1 for r in mixed)
    assert mixing.mix(hard).columns == hard.columns
    words = collections.defaultdict(int)
    for r in mixed:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(words[s] == taken[s] for s in taken)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_targets_stop_at_twice_the_source(spark):
    sizes = [("a", 10), ("b", 100), ("c", 1000), ("d", 5), (None, 50), ("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    cap, target = {s: 2.0 * n for s, n in sizes}, dict.fromkeys(weight, 0.0)
    rest, free = 1.5 * sum(n for _, n in sizes), set(weight)
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in free:
            target[s] += share * weight[s]
        for s in list(free):
            if target[s] >= cap[s]:
                rest += target[s] - cap[s]
                target[s] = cap[s]
                free.discard(s)
    assert all(math.isclose(got[s], target[s], abs_tol=1e-6) for s in weight)


def test_demand_is_inverted(spark):
    for schedule in mixing.SCHEDULES + ((0.0, 1.0), (1.0, 0.0), (2.0, 1.0, 0.0, 3.0)):
        xs = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        ts = [r.t for r in df.select(mixing.when_demanded(F.col("x"), schedule).alias("t")).collect()]
        k, fine = len(schedule) - 1, 20_000
        w = [np.interp(i / fine * k, range(k + 1), schedule) for i in range(fine + 1)]
        area = np.concatenate([[0], np.cumsum([(a + b) / 2 for a, b in zip(w, w[1:])])])
        assert all(abs(np.interp(t * fine, range(fine + 1), area / area[-1]) - x) < 1e-3 for x, t in zip(xs, ts))


# --- near duplicates ---------------------------------------------------------

def _bag(text):
    w = re.findall(PLAIN, (text or "").encode().lower())
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))


def _classes(rows):
    """Smallest id of each row's component, by comparing all pairs that share a shingle."""
    bags, parent, seen = [_bag(t) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, b in enumerate(bags):
        for s in b:
            seen[s].append(i)
    for x, y in {p for group in seen.values() for p in itertools.combinations(group, 2)}:
        m = sum((bags[x] & bags[y]).values())
        if 5 * m >= 4 * (sum(bags[x].values()) + sum(bags[y].values()) - m):
            parent[max(find(x), find(y))] = min(find(x), find(y))
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [min(ids[find(i)], default=None) if bags[i] else rows[i][0] for i in range(len(rows))]


def test_near_duplicates_hard_rows(spark, hard, none):
    rows = [(i, t) for i, t, *_ in HARD if i != 5]
    base = _prose(21, 120).split()
    for i in range(30):  # a chain: neighbours are near, ends are not
        words = list(base)
        for j in range(i):
            words[4 * j] = f"new{j}"
        rows.append((200 - i, " ".join(words)))
    df = spark.createDataFrame([(*x, 1, "a") for x in rows], "doc_id bigint, text string, key int, Bands string").repartition(3)
    got = neardup.near_duplicates(df).select("doc_id", "class_id").collect()
    assert _counted(got) == _counted((i, c) for (i, _), c in zip(rows, _classes(rows)))
    assert neardup.near_duplicates(none).count() == 0
    one = neardup.first_of_each(hard)
    assert one.columns == hard.columns
    left = one.collect()
    assert len({(r.doc_id, r.text) for r in left}) == len(left)
    ids = [r.doc_id for r in left]
    assert ids.count(6) == 2 and 11 in ids and 12 not in ids and {1, 2, 3, 4, 5, 7, 8, 9, 10, 13} <= set(ids)


@pytest.mark.parametrize("seed, share, own", [(1, 150, 6), (2, 190, 20), (3, 120, 60)])
def test_families_that_share_an_addition(spark, monkeypatch, seed, share, own):
    """Members far from the original, that have a passage in common which the original lacks; some differ in length."""
    r = random.Random(seed)
    base, passage = _prose(31, 260).split(), _prose(32, 90).split()
    rows = [(0, " ".join(base)), (1, " ".join(base + passage))]
    for i in range(60):
        words = base[:share] + passage[: 90 - i % 3 * 15] + base[share + 40 + i % 7 :]
        for _ in range(r.randint(0, own)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        rows.append((100 - i, " ".join(words)))
    checked = []
    overlaps = neardup.overlaps
    monkeypatch.setattr(neardup, "overlaps", lambda pairs, texts: checked.append(pairs) or overlaps(pairs, texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = neardup.near_duplicates(df, n=60, rows=3).select("doc_id", "class_id").collect()
    assert _counted(got) == _counted((i, c) for (i, _), c in zip(rows, _classes(rows)))
    assert len(checked) == 3


def test_near_duplicates_query(spark, table):
    ids = sorted(table)
    want = dict(zip(ids, _classes([(i, table[i]) for i in ids])))
    assert {r.doc_id: r.class_id for r in QUERIES["op6_near_duplicates"](spark, TESTDATA).collect()} == want


def test_signatures_estimate_weighted_overlap():
    r, rng = random.Random(4), np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for _ in range(5):
        a, b = (np.concatenate([np.repeat(x, r.randint(1, 9)) for x in rng.choice(pool, 120, replace=False)]) for _ in range(2))
        ca, cb = collections.Counter(a.tolist()), collections.Counter(b.tolist())
        true = sum((ca & cb).values()) / sum((ca | cb).values())
        x, y = neardup.signatures([a, b], 4000)
        assert abs((x == y).mean() - true) < 0.04


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(600, 700)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {x.node: x.root for x in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- contamination -----------------------------------------------------------

def _contaminated(text, items, n=13):
    fold = lambda t: re.findall(PLAIN, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w, hit, found = fold(text), set(), set()
    for item, t in items:
        b = fold(t)
        size = min(n, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [0, 10**6])
def test_capitals_beyond_ascii_do_not_depend_on_what_follows(spark, most):
    """A capital sigma that ends a word is lower-cased by what stands behind it."""
    rest = " ".join(f"w{i}" for i in range(11))
    items = [(1, f"ΟΔΟΣ a {rest}"), (2, f"ΣΑΣ. ΣΑΣ'Σ b {rest}"), (3, f"İΣ iσ ß {rest}")]
    texts = [f"ΟΔΟΣ a {rest}", f"ΟΔΟΣ.A {rest}", f"ΟΔΟΣ:a,{rest}!", f"οδος a {rest}", f"ΣΑΣ ΣΑΣ Σ b {rest}", f"İΣ, Iσ'ß {rest}", f"x.İΣ.iσ.ß.{rest.upper()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench, broadcast_windows=most).collect()}
    assert got == {i: _contaminated(t, items)[:3] for i, t in enumerate(texts)}
    assert got[1][:2] == (13, 13) and got[3][1] == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_hard_rows(spark, hard, none, most):
    items = [(1, SHARED), (2, SHARED[:300]), (10, "the same five words"), (3, "Été été"), (4, None), (5, "!?"), (6, "a"), (7, LONG[5000:5400]), (8, SHARED)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(hard, bench, broadcast_windows=most).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert _counted(got) == _counted((i, *_contaminated(t, items)) for i, t, *_ in HARD)
    assert decontaminate.contamination(none, bench).count() == 0
    clean = decontaminate.contamination(hard, bench.limit(0)).collect()
    assert len(clean) == len(HARD) and not any(r.n_hit or r.contaminated for r in clean)
    left = decontaminate.remove_documents(hard, bench)
    assert left.columns == hard.columns
    assert _counted((r.doc_id, r.text) for r in left.collect()) == _counted((i, t) for i, t, *_ in HARD if not _contaminated(t, items)[-1])
    cut = {(r.doc_id, r.text) for r in decontaminate.remove_spans(hard, bench).collect()}
    assert (11, "here") in cut and (12, "here!") in cut and (5, LONG) not in cut and (2, "") in cut and (1, None) in cut


# --- quality -----------------------------------------------------------------

def test_quality_hard_rows(spark, hard, none):
    got = hard.select("doc_id", "text", quality.line_quality("text").alias("q")).collect()
    for r in got:
        w, t = re.findall(r"[^\x20\x09-\x0D]+", r.text or ""), r.text or ""
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        assert (r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words, r.q.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(repeated), failed)
        assert not (failed and r.q.kept)
    kept = {r.doc_id for r in got if r.q.kept}
    assert {5, 6, 7, 8} <= kept and 13 not in kept and 9 not in kept
    assert quality.clean_documents(hard).columns == hard.columns and quality.clean_documents(none).count() == 0


def test_quality_removes_lines(spark):
    good = _prose(31, 40)
    text = good + "\nHome | News | Sport\n\nAll rights reserved by us."
    df = spark.createDataFrame([(1, text, len(text))], "doc_id int, text string, n_chars bigint")
    assert quality.clean_documents(df).first() == (1, good + "\n", len(good) + 1)


def test_quality_keeps_good_documents(spark):
    good = spark.read.parquet(f"{TESTDATA}/labels.parquet").filter("quality = 1").select("doc_id")
    got = QUERIES["op8_quality_rules"](spark, TESTDATA).join(good, "doc_id")
    assert got.filter("not kept and not base_failed").count() == 0


# A sentence's end, or a comma, of a script that has its own; the words stand in for any.
@pytest.mark.parametrize("mark", ["।", "॥", "؟", "۔", "،", "։", "።", "፣", "။", "។", "。", "、", "！", "…", "\u037e", "།"])
def test_marks_of_other_scripts_end_lines(mark):
    line = _prose(80, 12).rstrip(".").encode()
    assert quality.bad_line(line, line.split())
    line += mark.encode()
    assert not quality.bad_line(line, line.split())
    # letters of these scripts are no marks
    for word in ("क", "ب", "բ", "ሀ", "က", "ក", "漢"):
        other = " ".join(word * (i + 1) for i in range(12)).encode()
        assert quality.bad_line(other, other.split())
        assert not quality.bad_line(other + mark.encode(), (other + mark.encode()).split())


def test_marks_by_sql(spark, tmp_path):
    names = ["।", "؟", "،", "։", "።", "။", "។", "。", "！", "…", "\u037e", "༎", "x", "é", "-"]
    rows = [(i, "\n".join(_prose(81 + j, 14).rstrip(".") + m for j in range(4))) for i, m in enumerate(names)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"select doc_id, kept from ({SQL['op8_quality_rules']})").fetchall()
    assert _counted(QUERIES["op8_quality_rules"](spark, str(tmp_path)).select("doc_id", "kept").collect()) == _counted(want)
    assert sorted(i for i, kept in want if not kept) == [12, 13, 14]


# --- lines -------------------------------------------------------------------

def _chunk_borders(texts):
    """(first line, line behind the last) of each chunk, in whole numbers: a border follows a line where
    its hash rolled with that of the line before says so, unless the chunk would have a single line."""
    import xxhash

    out, at, before = [], 0, None
    for i, x in enumerate(texts):
        h = xxhash.xxh3_64_intdigest(x)
        r = h if before is None else (h * 0x9E3779B97F4A7C15 + before) % 2**64
        before = h
        mixed = (r ^ (r >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
        if (mixed >> 40) % 2 == 0 and i + 1 - at >= 2 and i + 1 < len(texts):
            out.append((at, i + 1))
            at = i + 1
    return [*out, (at, len(texts))]


def _line_chunks(rows):
    seen = set()
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        if t is None:
            yield i, None, 0, 0, 0, 0
            continue
        l, kept, n, gone = t.encode().split(b"\n"), [], 0, 0
        for a, b in _chunk_borders(l):
            n += 1
            body = b"\n".join(l[a:b])
            if b - a > 1 and body in seen:
                gone += b - a
            else:
                kept.append(body)
            if b - a > 1:
                seen.add(body)
        yield i, b"\n".join(kept).decode(), len(l), n, n - len(kept), gone


def test_line_chunks_hard_rows(spark, hard, none):
    block = "\n".join(_prose(70 + i, 6) for i in range(30))
    rows = [(i, t) for i, t, *_ in HARD if i not in (6, None)] + [(50, block), (51, "head\n" + block), (52, block + "\ntail"), (53, block), (54, "\n" * 9)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, Row int").repartition(3)
    want = list(_line_chunks(rows))
    got = lines.line_counts(df).select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines").collect()
    assert _counted(got) == _counted((w[0], *w[2:]) for w in want)
    assert _counted(lines.remove_repeats(df).collect()) == _counted(w[:2] for w in want)
    # borders are found again behind inserted lines
    removed = {r.doc_id: r.n_removed_lines for r in got}
    assert removed[53] >= 28 and removed[51] >= 20 and removed[52] >= 20
    assert lines.line_counts(none).count() == 0
    assert lines.line_counts(hard).count() == len(HARD)


def test_line_chunks_query(spark, table):
    want = {w[0]: w[2:] for w in _line_chunks(list(table.items()))}
    got = QUERIES["op9_line_dedup"](spark, TESTDATA).collect()
    assert {r.doc_id: (r.n_lines, r.n_chunks, r.n_removed_chunks, r.n_removed_lines) for r in got} == want


def _passages(rows):
    """Texts without repeated passages, by brute force over pairs of lines."""
    texts = [(i, t.split("\n")) for i, t in sorted(rows)]
    places = collections.defaultdict(list)
    for k, (_, l) in enumerate(texts):
        for j in range(len(l) - 1):
            if l[j].strip() or l[j + 1].strip():
                places[l[j], l[j + 1]].append((k, j))
    kept, gone = set(), set()
    for at in places.values():
        for n, (k, j) in enumerate(at if len(at) > 1 else []):
            (gone if n else kept).update([(k, j), (k, j + 1)])
    return {i: [x for j, x in enumerate(l) if (k, j) not in gone - kept] for k, (i, l) in enumerate(texts)}


def test_passages_are_removed_to_their_edges(spark, none):
    rows = []
    for n in range(2, 11):
        shared = "\n".join(_prose(1000 + 20 * n + i, 6) for i in range(n))
        for k in range(2):
            rows.append((100 * k + n, f"{_prose(2000 + 2 * n + k, 6)}\n{shared}\n{_prose(3000 + 2 * n + k, 6)}"))
    unlike = len(rows)
    rows += [(300, "a\na\na\na"), (301, "p\nq\nr"), (302, "u\np\nq\ns"), (303, "v\nq\ns\nw"), (304, ""), (305, "\n\n\n"), (306, "\n\n\n"), (307, "x\n\ny"), (308, "x\n\ny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = _passages(rows)
    assert {r.doc_id: r.text for r in lines.remove_passages(df).collect()} == {i: "\n".join(l) for i, l in want.items()}
    assert all(len(want[100 + n]) == 2 and len(want[n]) == n + 2 for n in range(2, 11)) and unlike == 18
    assert (want[300], want[302], want[303], want[307], want[308]) == (["a", "a"], ["u", "q", "s"], ["v", "w"], ["x", "", "y"], [])
    got = {r.doc_id: r for r in lines.line_counts(df).collect()}
    whole = dict(rows)
    for i, l in want.items():
        left = whole[i].encode().split(b"\n")
        assert got[i].n_passage_lines == len(left) - len(l)
        assert got[i].n_passage_bytes == sum(len(x) + 1 for x in left) - sum(len(x.encode()) + 1 for x in l)
    nulls = spark.createDataFrame([(1, None), (1, "a\nb"), (None, "a\nb")], "doc_id bigint, text string")
    assert _counted(lines.remove_passages(nulls).collect()) == _counted([(1, None), (None, "a\nb"), (1, "")])
    assert lines.remove_passages(none).count() == 0


def test_equal_hashes_of_unlike_lines_remove_nothing(spark, monkeypatch):
    docs = [(i, "\n".join(_prose(4000 + 10 * i + j, 6) for j in range(4))) for i in range(3)] + [(3, "head\nsame one\nsame two\ntail")]
    docs.append((4, docs[0][1] + "\nmore"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    # all chunks have one key and all pairs one hash, so the bytes alone decide
    real = lines.chunks
    monkeypatch.setattr(lines, "chunks", lambda *a: real(*a).withColumns({
        "key": F.when(F.col("key").isNotNull(), F.lit(b"0")),
        "pairs": F.transform("pairs", lambda p: F.when(p.isNotNull(), F.lit(b"0")))}))
    got = {r.doc_id: r for r in lines.line_counts(df).collect()}
    assert all(got[i].n_removed_lines == got[i].n_passage_lines == 0 for i in range(4))
    whole = _chunk_borders(docs[0][1].encode().split(b"\n"))[0]
    again = _chunk_borders(docs[4][1].encode().split(b"\n"))[0]
    assert got[4].n_removed_lines == (whole[1] if whole == again else 0)


def test_passages_query(spark, table):
    want = _passages([(i, t or "") for i, t in table.items()])
    got = QUERIES["op9_line_dedup"](spark, TESTDATA).collect()
    assert {r.doc_id: r.n_lines - r.n_passage_lines for r in got if table[r.doc_id] is not None} == {i: len(l) for i, l in want.items() if table[i] is not None}
    assert sum(r.n_passage_lines for r in got) > sum(r.n_removed_lines for r in got)


# --- language model ----------------------------------------------------------

def _unigrams(texts):
    c = collections.Counter()
    for t in texts:
        c.update((t or "").encode().lower().split())
        c[b""] += 1
    return c


def test_scores_query(spark, table):
    c = _unigrams(t for i, t in table.items() if zlib.crc32(str(i).encode()) % 10)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op10_lm_scoring"](spark, TESTDATA).collect()
    assert len(got) == len(table)
    for r in got:
        w = (table[r.doc_id] or "").encode().lower().split() + [b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_do_not_depend_on_the_dictionary(spark, hard, none):
    texts = hard.select(F.col("text").cast("binary").alias("text"))
    c = _unigrams(t for _, t, *_ in HARD)
    found = []
    for dictionary in (100_000, 1_000):
        model = brown.fit(spark, texts, clustered=30, classes=4, dictionary=dictionary)
        assert model.total == sum(c.values()) and model.distinct == len(c)
        found.append(sorted(brown.score(spark, hard, model).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens, r.score)))
    assert len(found[0]) == len(HARD)
    for a, b in zip(*found):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isclose(a.score, b.score, rel_tol=1e-9)
    empty = brown.fit(spark, none.select(F.col("text").cast("binary").alias("text")))
    r = [x for x in brown.score(spark, hard, empty).collect() if x.doc_id == 10][0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and math.isclose(r.base_score, 0.0, abs_tol=1e-9)
    assert brown.score(spark, none, model).count() == 0


def test_words_beyond_the_clustered_have_learned_classes(spark):
    r = random.Random(5)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "xyz"]
    texts = [" ".join(r.choice(kinds[k % 3][:8] if r.random() < 0.7 else kinds[k % 3]) for k in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    b = df.select(F.col("text").cast("binary").alias("text"))
    known = [w.encode() for kind in kinds for w in kind]
    c, found = _unigrams(texts), []
    for dictionary in (100_000, 40, 5):  # all words; fewer than there are; fewer than are clustered
        model = brown.fit(spark, b, clustered=24, classes=3, dictionary=dictionary)
        classes = [model.classes.of([w.encode() for w in kind if c[w.encode()] >= brown.LEAST_COUNT])[1].tolist() for kind in kinds]
        assert [len(set(x)) for x in classes] == [1, 1, 1] and len({x[0] for x in classes}) == 3 and max(map(max, classes)) < 3
        assert sum(map(len, classes)) > 100 and model.classes.of([b"new"])[1][0] == 3 + 4 * 2
        found.append((classes, sorted(r.score for r in brown.score(spark, df, model).collect())))
    assert all(f[0] == found[0][0] and np.allclose(f[1], found[0][1], rtol=1e-9) for f in found)
    words = [b"", b"abc", "é".encode() * 40] + known[:5]
    want = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w binary").orderBy("i").select(F.xxhash64("w")).collect()]
    assert brown.word_hashes(words).tolist() == want


def test_clustered_words_do_not_depend_on_the_dictionary(spark):
    alike = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id bigint, text string").select(F.col("text").cast("binary").alias("text"))
    model = brown.fit(spark, alike, clustered=24, classes=3, dictionary=10)  # all counts equal, and too many words for the dictionary
    assert sorted(model.classes.known) == sorted(f"w{i}".encode() for i in range(50))[:24]
    assert max(model.classes.of(list(model.classes.known))[1]) < 3


def _shape(w):
    last = w[-1:]
    kind = 0 if last in b".!?" else 1 if last in b",;:" else 2 if last.isdigit() else 4 if last.islower() or last[0] > 127 else 3
    return f"shape {kind} {len(w) > 8}"


def _class_scores(train, texts, clustered, classes, least=3, prior=0.5, passes=5):
    """Scores of the class model, written from its definition: whole likelihoods, dictionaries, no arrays."""
    shapes = [f"shape {k} {long}" for k in range(5) for long in (False, True)]
    lines = [(t or "").encode().lower().split() for t in train]
    c = collections.Counter(w for line in lines for w in line)
    head = sorted(c, key=lambda w: (-c[w], w))[:clustered]
    of = {w: i % min(classes, len(head)) for i, w in enumerate(head)}
    symbols = collections.Counter()
    for line in lines:
        symbols.update(itertools.pairwise(["end", *(w if w in of else _shape(w) for w in line), "end"]))

    def follow():
        pairs = collections.Counter()
        for (a, b), n in symbols.items():
            pairs[of.get(a, a), of.get(b, b)] += n
        return pairs

    def likelihood():
        pairs, rows, cols = follow(), collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            rows[a] += n
            cols[b] += n
        return math.fsum([n * math.log(n) for n in pairs.values()] + [-n * math.log(n) for x in (rows, cols) for n in x.values()])

    for _ in range(passes):
        before = dict(of)
        for w in head:
            own, found = of[w], []
            for k in range(classes):
                of[w] = k
                found.append(likelihood())
            of[w] = found.index(max(found)) if max(found) > found[own] + 1e-9 else own
        if of == before:
            break
    kinds = [*range(classes), *shapes, "end"]

    def chance(pairs):
        rows = collections.Counter()
        for (a, _), n in pairs.items():
            rows[a] += n
        return lambda a, b: (pairs[a, b] + prior) / (rows[a] + prior * len(kinds))

    pairs = follow()
    p, into = chance(pairs), collections.Counter()
    for (_, b), n in pairs.items():
        into[b] += n
    sides = collections.defaultdict(list)
    for line in lines:
        line = [b"", *line, b""]
        number = ["end", *(of.get(w, _shape(w)) for w in line[1:-1]), "end"]
        for i, w in enumerate(line[1:-1], 1):
            if w not in of and c[w] >= least:
                sides[w].append((number[i - 1], number[i + 1]))
    dealt = {w: max(range(classes), key=lambda k: math.fsum(
        math.log(p(a, k)) + math.log(p(k, b)) - math.log(into[k] + 1) for a, b in around)) for w, around in sides.items()}
    of.update(dealt)
    steps, words, sums = collections.Counter(), collections.Counter(), collections.Counter()
    for line in lines:
        steps.update(itertools.pairwise(["end", *(of.get(w, _shape(w)) for w in line), "end"]))
    for w, n in c.items():
        words[of.get(w, _shape(w))] += 1
        sums[of.get(w, _shape(w))] += n
    words["end"], sums["end"] = 1, len(lines)
    p = chance(steps)
    for t in texts:
        line = (t or "").encode().lower().split()
        number = ["end", *(of.get(w, _shape(w)) for w in line), "end"]
        counts = [*(c[w] for w in line), len(lines)]
        yield math.fsum(math.log10(p(a, b)) + math.log10((n + 0.1) / (sums[b] + 0.1 * (words[b] + 1)))
                        for (a, b), n in zip(itertools.pairwise(number), counts))


@pytest.mark.parametrize("dictionary", [1_000, 30, 0])
def test_scores_by_brute_force(spark, dictionary):
    r = random.Random(14)
    pools = [[f"{c}{'long word'[:4] if i % 3 else 'considerable'}{i}{r.choice(['', '', '.', ',', 'ä', ')'])}" for i in range(25)] for c in "Ab"]
    texts = [" ".join(r.choice(pools[(k + r.randint(0, 3) // 3) % 2][: r.choice([3, 8, 25])]) for k in range(r.randint(0, 40))) for _ in range(90)]
    rows = [(i, t, i % 10 != 0, "x", 3) for i, t in enumerate([*texts, None, "", " ", texts[0], "new words " * 40, "unbroken" * 4_000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, wanted boolean, word string, row int").repartition(3)
    want = list(_class_scores([t for _, t, wanted, *_ in rows if wanted], [t for _, t, *_ in rows], 12, 3))
    got = brown.fit_and_score(spark, df, F.col("wanted"), clustered=12, classes=3, dictionary=dictionary).collect()
    assert np.allclose([x.score for x in sorted(got, key=lambda x: x.doc_id)], want, rtol=1e-9)
    if dictionary == 30:  # the same in two steps
        model = brown.fit(spark, df.filter("wanted").select(F.col("text").cast("binary").alias("text")), clustered=12, classes=3, dictionary=30)
        assert np.allclose([x.score for x in sorted(brown.score(spark, df, model).collect(), key=lambda x: x.doc_id)], want, rtol=1e-9)
        assert len(model.vocabulary.words.known) <= 30


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    true = np.arange(40) % 4
    follow = np.array([[0, 9, 1, 1], [1, 0, 9, 1], [1, 1, 0, 9], [9, 1, 1, 0]], float)
    pairs = rng.poisson(follow[true][:, true] * 20).astype(float)
    found = brown.exchange(np.pad(pairs, (0, 1)), 40, classes=4)
    assert all(len({int(found[i]) for i in range(40) if true[i] == k}) == 1 for k in range(4)) and len(set(found[:40].tolist())) == 4


# --- pipeline ----------------------------------------------------------------

def test_pipeline_stages(spark, hard, none, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token output"]
    for start, docs in (("hard", hard), ("none", none)):
        before = docs
        for i, (_, stage) in enumerate(p.STAGES):
            stage(spark, before, TESTDATA).write.parquet(path := f"{tmp_path}/{start}{i}")
            after = spark.read.parquet(path)
            if i < 4:
                assert after.columns == docs.columns
            before = after
        assert after.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and bool(after.count()) == (start == "hard")


def test_pipeline_shards_follow_the_curriculum(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    taken = mixing.mix_plan(docs).select("doc_id", F.explode("takes.position").alias("at")).collect()
    before = {"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.files.maxPartitionBytes": "128m", "spark.sql.autoBroadcastJoinThreshold": "10m"}
    try:
        for k, v in zip(before, ("false", "64k", "-1")):  # many files, and many tasks that read them
            spark.conf.set(k, v)
        p.mixing_sources(spark, docs, TESTDATA).write.parquet(f"{tmp_path}/mixed")
        got = p.token_shards(spark, spark.read.parquet(f"{tmp_path}/mixed"), TESTDATA).orderBy("start").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    taken.sort(key=lambda r: r.at)
    assert len(list(tmp_path.glob("mixed/*.parquet"))) > 1
    got_ids = iter([r.doc_id for r in got])
    for _, same in itertools.groupby(taken, lambda r: r.at):  # documents at one position may change places
        ids = [r.doc_id for r in same]
        assert sorted(itertools.islice(got_ids, len(ids))) == sorted(ids)
    assert len(got) == len(taken) and [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    assert [r.start for r in got] == list(itertools.accumulate([0] + [r.n_tokens for r in got]))[:-1]


def test_pipeline_on_documents(spark, table, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    kept = {r[0] for r in duck.execute(SQL["op8_quality_rules"]).fetchall() if r[-1]}
    clean = p.quality_rules(spark, docs, TESTDATA)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {i for i, _ in rows} == kept
    one = {r.doc_id for r in p.near_dedup(spark, clean, TESTDATA).collect()}
    assert one == {c for c in _classes(rows)}
    items = [tuple(r) for r in duck.execute("select item_id, text from benchmark").fetchall()]
    left = p.decontamination(spark, clean.filter(F.col("doc_id").isin(sorted(one))), TESTDATA)
    assert {r.doc_id for r in left.collect()} == {i for i, t in rows if i in one and not _contaminated(t, items)[-1]}


def test_line_asks_leave_in_bounded_batches():
    """Rows and lines without bytes have a size too, and few rows are Python objects at a time."""
    ask = {"key": b"k" * 16, "part": 0, "line": 0, "across": False, "stays": False}
    rows = [{"row": i, "chunk": 0, "at": 0, "body": b"\n", "asks": [ask] * 10} for i in range(6_000)]
    out = [*lines._asked(iter([pa.RecordBatch.from_pylist(rows)]))]
    assert sum(b.num_rows for b in out) == 60_000 and max(b.num_rows for b in out) < 30_000
