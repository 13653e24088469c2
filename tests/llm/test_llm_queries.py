"""The registered queries over the smallest tables: against their SQL, or against brute force over the whole tables."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from modwarden.llm import decontaminate  # noqa: E402
from modwarden.llm.queries import ORACLES, QUERIES  # noqa: E402
from test_llm_dedup import brute_fingerprint, brute_removal, roots  # noqa: E402
from test_llm_nearcopies import brute_kept  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = sorted(str(sorted(zip(columns, r, strict=True))) for r in cur.fetchall())
    assert sorted(str(sorted(r.asDict().items())) for r in QUERIES[name](spark, DATA).collect()) == want


def test_op4(spark, docs):
    want = sorted((i, n, m, sha(t)) for i, n, m, t in brute_removal([(r.doc_id, r.text) for r in docs.values()], 50))
    assert sorted(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, DATA).collect()) == want


def test_op5(spark, docs, library):
    want = []
    for r in docs.values():
        ids = [*library.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(tuple(r) for r in QUERIES["op5_sentencepiece"](spark, DATA).collect()) == sorted(want)


def test_op9(spark, docs):
    fp = {i: brute_fingerprint(r.text) for i, r in docs.items()}
    root = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert sorted(tuple(r) for r in QUERIES["op9_simhash_near_dedup"](spark, DATA).collect()) == sorted((i, f"{fp[i]:016x}", root[i]) for i in fp)


def test_op10(spark, docs):
    for r in QUERIES["op10_webp_media"](spark, DATA).collect():
        raw = (docs[r.doc_id].text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op7(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = {r.doc_id: {x["item_id"] for x in r["items"]} for r in QUERIES["op7_decontamination"](spark, DATA).collect()}
    assert found.keys() == docs.keys()
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    for i, r in docs.items():
        assert {k for k, t in items if f" {words(t)} " in f" {words(r.text)} "} <= found[i]


@pytest.mark.parametrize(("name", "modulus", "rest", "label"), [("op1_toxicity", 4, 2, "toxic"), ("op8_quality", 5, 0, "quality")])
def test_classifiers(spark, docs, name, modulus, rest, label):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES[name](spark, DATA).collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    assert sum(rows[i].predicted == v for i, v in y.items()) / len(y) > 0.9
    same = {}
    assert all(same.setdefault(docs[i].text, r.score) == r.score for i, r in rows.items())


def test_op3(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, DATA).collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert rows.keys() == docs.keys() and sum(rows[i].lang_pred == docs[i].lang for i in held) / len(held) > 0.95


def test_pipeline_against_brute_force(spark, docs, library):
    """Every stage on what the one before it kept, written and read again."""
    from modwarden.session import materialize

    now = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = materialize(stage(spark, now, DATA), name)
        after = now.collect()
        kept.append(len(after))
        if name != "encoding":
            assert now.columns == columns
        if name == "toxicity":
            y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert sum(y.get(i, 1) for i in gone) / len(gone) > 0.8 and {r.doc_id: r for r in after} == {i: docs[i] for i in docs if i not in gone}
        elif name == "near_dedup":
            assert {r.doc_id for r in after} == brute_kept([(r.doc_id, r.text) for r in before])
        elif name == "substring_dedup":
            want = {i: (t if m else None) for i, _, m, t in brute_removal([(r.doc_id, r.text) for r in before], 50)}
            text = {r.doc_id: r.text for r in before}
            assert {r.doc_id: r.text for r in after} == {i: text[i] if t is None else t for i, t in want.items()}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "decontamination":
            items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()], radius=64)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not items.found_in(r.text)}
        else:
            for r, t in ((r, {x.doc_id: x.text for x in before}[r.doc_id]) for r in after):
                ids = [*library.encode(t), 2]
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30000, "en", "s", 150000)], schema)
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, DATA)
        assert df.count() <= 4
