"""Scalar functions against plain Python."""

import hashlib
import hmac
import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.functions import speakers, text, timing


def values(spark, column, rows, schema="x string"):
    return [r.y for r in spark.createDataFrame(rows, schema).select(column.alias("y")).collect()]


def test_normalize_text(spark):
    got = values(spark, text.normalize_text(F.col("x")), [("a\u0308 \\n b\r\n\u00a0c\x1cd ",), (None,), ("",)])
    assert got == ["ä b c d", None, ""]


def test_normalize_for_wer(spark):
    got = values(spark, text.normalize_for_wer(F.col("x")), [("Kirkko-Orkesteri, 15 €!",), (None,), ("«Ä»  ",)])
    assert got == ["kirkko orkesteri 15", "", "ä"]


def test_text_hash_is_of_the_composed_text(spark):
    got = values(spark, text.text_hash(F.col("x")), [("a\u0308",), (None,)])
    assert got == [hashlib.sha256(unicodedata.normalize("NFC", "a\u0308").encode()).hexdigest(), None]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_distance_equals_dynamic_programming(spark):
    rng = random.Random(7)
    pairs = [([rng.choice("abcä") for _ in range(rng.randrange(40))], [rng.choice("abcä") for _ in range(rng.randrange(40))]) for _ in range(400)]
    rows = [(k, a, b) for k, (a, b) in enumerate(pairs)]
    got = {r.k: r.y for r in spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", text.word_distance(F.col("a"), F.col("b")).alias("y")).collect()}
    assert [got[k] for k in range(len(pairs))] == [plain_distance(a, b) for a, b in pairs]


def test_word_distance_of_long_texts():
    rng = random.Random(1)
    a = [str(rng.randrange(500)) for _ in range(8000)]
    b = [w for w in a if rng.random() > 0.1]
    assert text._distance(a, b) == len(a) - len(b)


def test_speaker_hash_is_hmac(spark):
    for salt in ("salt", "s" * 70):
        got = values(spark, speakers.hash_speaker(F.col("x"), salt), [("17",), ("ä",)])
        assert got == [hmac.new(salt.encode(), i.encode(), hashlib.sha256).hexdigest()[:24] for i in ("17", "ä")]


@pytest.mark.parametrize("salt", [None, "x"])
def test_resolve_speaker(spark, salt):
    rows = [("5",), ('"123"',), ('"a@b.c"',), ('"  pseudo "',), ("true",), ("null",), ('""',), (None,), ('"1234567890123456789"',)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("v"))
    kept, reason = speakers.resolve_speaker(F.col("v"), salt)
    got = [(r.k, r.r) for r in df.select(kept.alias("k"), reason.alias("r")).collect()]
    known = lambda i: (hmac.new(b"x", i.encode(), hashlib.sha256).hexdigest()[:24], None) if salt else (None, "raw_speaker_id_dropped")
    assert got == [known("5"), known("123"), (None, "speaker_id_email_dropped"), ("pseudo", None), (None, "speaker_id_invalid"), (None, None), (None, None), (None, None), ("1234567890123456789", None)]


def test_split_is_by_bucket(spark):
    ratios = {"train": 0.6, "dev": 0.2, "test": 0.2}
    salt = speakers.split_salt(42)
    bucket = lambda s: int(hashlib.sha256(f"{salt}:{s}".encode()).hexdigest()[:8], 16) % 10000
    names = [f"s{k}" for k in range(200)]
    got = values(spark, speakers.speaker_split(F.col("x"), ratios), [(n,) for n in names] + [(None,), ("",)])
    assert got == ["dev" if bucket(n) < 2000 else "test" if bucket(n) < 4000 else "train" for n in names] + ["train", "train"]
    for bad in ({"train": 1.0}, {"train": 1, "dev": -0.1, "test": 0.1}):
        with pytest.raises(ValueError):
            speakers.validated_ratios(bad)


def test_timestamps(spark):
    got = values(spark, timing.format_timestamp(F.col("x")), [(0.0,), (3661.0015,), (-2.0,), (400000.5,), (0.0005,), (0.0015,)], "x double")
    assert got == ["00:00:00.000", "01:01:01.002", "00:00:00.000", "111:06:40.500", "00:00:00.000", "00:00:00.002"]
    assert values(spark, timing.iso_ms(F.col("x")), [(0.9996,)], "x double") == ["1970-01-01T00:00:01.000Z"]
    assert values(spark, timing.repair_offset(F.col("x")), [("2024-01-01T00:00:00 02:00",)]) == ["2024-01-01T00:00:00+02:00"]
    assert [str(t) for t in values(spark, timing.parse_start_time(F.col("x")), [("2024-01-01T00:00:00Z",), ("2024-01-01T02:00:00+02:00",), ("nonsense",)])][2] == "None"
    assert values(spark, timing.parse_duration(F.col("x")), [("1.5",), ("nan",), ("-1",), ("x",), ("inf",)]) == [1.5, None, None, None, None]


def test_join_words_and_lines(spark):
    words = [(["Hello", " , ", "world", "", "(", "yes", ")", "«", "no", "»", "!"],), ([],)]
    assert values(spark, timing.join_words("x"), words, "x array<string>") == ["Hello, world (yes) «no»!", ""]
    lines = [("one two three four five",), ("",), ("averyveryverylongword b c",)]
    assert values(spark, timing.split_lines("x", 9), lines) == ["one two\nthree four five", "", "averyveryverylongword\nb c"]


def test_carry_prompt(spark):
    rows = [("p", "alpha beta gamma", 10), (None, "alpha beta gamma", 11), ("p", None, 5), (None, " ", 5), (None, "unbroken", 3)]
    got = [spark.createDataFrame([(a, b)], "a string, b string").select(text.carry_prompt(F.col("a"), F.col("b"), n)).first()[0] for a, b, n in rows]
    assert got == ["p beta gamma", "beta gamma", "p", None, None]


def test_names_and_hosts(spark):
    assert values(spark, text.safe_name(F.col("x")), [("../a b.wav",), ("C:\\x\\nul.txt",), (None,), ("...",)]) == ["a_b.wav", "_nul.txt", "upload", "upload"]
    urls = [("https://a.example.com/x",), ("https://u:p@a.example.com",), ("ftp://a.example.com",), ("http://evil.com",), (None,), ("not a url",)]
    assert values(spark, text.host_allowed(F.col("x"), ["*.example.com"]), urls) == [True, False, False, False, False, False]
    assert values(spark, text.base_names(F.col("x")), [("no /srv/data/a.wav here",)]) == ["no a.wav here"]


def test_normalised_text_is_composed(spark):
    marks = ["a", "n", "N", " ", "\n", "\t", "\\n", "\u0303", "\u0308", "\u0304", "\u00e4", "\u2000", "\u3000", "\u1100\u1161", "\u0344", "\u212b"]
    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(marks, repeat=n)]
    rows = spark.createDataFrame([(x,) for x in [*texts, None]], "text string").select(text.normalize_text(F.col("text")).alias("t"))
    differ = ~text.text_hash(F.col("t")).eqNullSafe(text.text_hash(F.col("t"), composed=True))
    assert rows.where(differ).count() == 0


def test_rounding_is_that_of_sql(spark):
    import duckdb

    values = [0.51155, -0.51155, 0.5115500000000001, 2.5e-5, 1e300, float("inf"), None, *((k + 0.5) / 10_000 for k in range(2_000)), *(k * 1.005 for k in range(50))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(text.rounded("v", 4).alias("r")).collect()
    want = duckdb.execute("SELECT round(unnest($1::DOUBLE[]), 4)", [values]).fetchall()
    assert [r.r for r in got] == [r for (r,) in want]
    assert got[0].r == 0.5115


def test_gate_texts_round_as_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(u, v) for u in range(200) for v in (u + 0.31, 2 * u + 0.3)], "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, entry.queries()["gate_texts"](spark, str(tmp_path)).collect())) == sorted(con.execute(entry.oracle_sql()["gate_texts"]).fetchall())
