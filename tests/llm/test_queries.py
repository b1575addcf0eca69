"""The queries and the pipeline over the smallest tables, against SQL or brute force."""

import hashlib
import os
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from recordloom.llm import chunk_table, language_id, queries, quality_rules
from tests.llm.test_near_copies import groups as brute_groups
from tests.llm.test_operators import brute_components, brute_fingerprint
from tests.llm.test_setsketch import brute as brute_sets
from tests.llm.test_turn_repair import COLUMNS
from tests.llm.test_turn_repair import brute as brute_repair

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def by_id(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, str(DATA)).collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, db, name):
    mine, theirs = queries.QUERIES[name](spark, str(DATA)), db.sql(queries.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in mine.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_url_filter(spark, db):
    got = by_id(spark, "op2_url_filter", "page_id")
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    pages = db.sql("SELECT page_id, url FROM pages").fetchall()
    assert len(got) == len(pages)
    for i, url in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and got[i]["verdict"] in ((rules[rule],) if rule else ("allow", "block"))


def test_simhash(spark, texts):
    got = by_id(spark, "op3_simhash_vp")
    ids = list(texts)
    fps = [brute_fingerprint(x) for x in texts.values()]
    label = brute_components(fps)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", ids[k]) for i, f, k in zip(ids, fps, label, strict=True)}


def test_sentencepiece(spark, texts):
    got, sp = by_id(spark, "op4_sentencepiece"), chunk_table.piece_bpe()[1]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, x in texts.items():
        ids = sp.encode(x)
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_token_files(spark, texts):
    got, library, start = by_id(spark, "op5_token_files"), chunk_table._library("byte_bpe_50k.json"), 0
    for i, x in texts.items():
        ids = [*library.encode(x, add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_quality_is_learned_from_the_other_folds(spark, db):
    got = by_id(spark, "op6_rff_quality")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[i]["predicted"], q) for i, q in db.sql("SELECT doc_id, quality FROM labels").fetchall() if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.8


def test_languages(spark, db):
    got = by_id(spark, "op8_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i]["lang_pred"], lang) for i, lang in db.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall() if got[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_media(spark, texts):
    got = by_id(spark, "op9_media_tiles")
    for i, x in texts.items():
        raw = x.encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert tuple(got[i])[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_turn_repair(spark, db):
    rows = db.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in queries.QUERIES["op11_turn_repair"](spark, str(DATA)).collect()}
    assert got == brute_repair(rows)


def test_setsketch(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_setsketch"](spark, str(DATA)).collect()}
    assert got == brute_sets(list(texts.items()))


def assert_packed(out, texts):
    library, pieces, bins = chunk_table._library("word_bpe_49k.json"), {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    total = 0
    for i, x in texts.items():
        ids = np.array([*library.encode(x, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert sorted(pieces[i]) == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= 4096
    assert len(bins) <= total / 4096 * 1.02 + 2


def test_packing(spark, texts):
    assert_packed(queries.QUERIES["op10_packing"](spark, str(DATA)).collect(), texts)


def test_pipeline_stages(spark, texts, db):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "packing"]
    own, out = dict(texts), None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, str(DATA)), name)
        if name == "language_id":
            own = {i: x for i, x in own.items() if any(c.isalpha() for c in x)}
            assert {r[0] for r in out.select("doc_id").collect()} <= set(own)
            model = language_id.train(docs)
            langs, score, beyond = language_id._judge(language_id._Scores(model), list(own.values()))
            own = {i: x for (i, x), a, s, b in zip(own.items(), langs, score, beyond, strict=True) if a != "und" and s >= 0.5 and b >= -language_id.FAR}
        elif name == "quality_rules":
            verdict = {i: (failed, kept) for i, failed, kept in db.sql(f"SELECT doc_id, base_failed, kept FROM ({quality_rules.SQL})").fetchall()}
            own = {i: x for i, x in own.items() if verdict[i][1]}
        elif name == "near_dedup":
            own = {i: own[i] for _, i, _ in brute_groups(list(own.items()))}
        if name != "packing":
            assert out.columns == columns
            assert {r["doc_id"]: r["text"] for r in out.collect()} == own
        docs = out
    assert_packed(out.collect(), own)
    clean = {i for i, q in db.sql("SELECT doc_id, quality FROM labels").fetchall() if q == 0}
    assert not clean & set(own)


def test_entry_registers_everything():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
