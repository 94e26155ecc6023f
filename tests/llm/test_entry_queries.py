"""The registered queries of this package on the driver's smallest tables, against their SQL or their contract."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pytest

from vellum.llm import entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    return f"{v:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    rows = entry.queries()[name](spark, DATA)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows.collect()) == want


def crc(d):
    return zlib.crc32(str(d).encode())


#: Columns that each contract names.
CONTRACT = {
    "op3_jaccard_join": "doc_id n_shingles component_id",
    "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_page_text": "page_id url text n_chars",
    "op6_token_tables": "doc_id start n_tokens ids_crc32",
    "op7_bilinear_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_language_mixture": "doc_id held_out lang_pred score",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_substring_dedup": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_query_has_a_row_a_row(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    assert set(CONTRACT[name].split()) <= set(got.columns)
    key, of = ("page_id", "pages") if name == "op5_page_text" else ("doc_id", "documents")
    rows = got.collect()
    assert sorted(r[key] for r in rows) == [k for (k,) in duck.execute(f"SELECT {key} FROM {of} ORDER BY 1").fetchall()]
    if "held_out" in got.columns:
        of, part = {"op7_bilinear_lm": (5, 1), "op9_language_mixture": (4, 2), "op10_quality_classifier": (3, 1)}[name]
        assert all(r.held_out == (crc(r.doc_id) % of == part) for r in rows)


def test_sharding_law(spark, duck):
    rows = entry.op4_sharding(spark, DATA).collect()
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    by = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(24)) and all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_token_tables_hold_the_library_s_ids(spark, duck):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry.op6_token_tables(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
