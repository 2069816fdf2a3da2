"""The registered corpus queries over a whole table against plain versions."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from flowtide.llm import queries, secrets, tokens
from flowtide.llm.langid import held_out  # noqa: F401
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return rows


def result(spark, name):
    return [r.asDict() for r in queries.OPERATORS[name](spark, SF).collect()]


def test_packing(spark, docs):
    pieces = result(spark, "op1_packing")
    ids = dict(zip([d.doc_id for d in docs], brute.encode(queries.tokenizer_file("word_bpe_49k.json"), [d.text for d in docs], 1)))
    covered = {i: 0 for i in ids}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == covered[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == brute.crc(own[p["start"] : p["start"] + p["length"]])
        covered[p["doc_id"]] += p["length"]
    assert covered == {i: len(x) for i, x in ids.items()}
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == 2048 for s, n in at.items() if s < max(at)) and sorted(at) == list(range(len(at)))


def test_token_files(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op2_token_files")}
    start = 0
    for d, ids in zip(docs, brute.encode(queries.tokenizer_file("byte_bpe_50k.json"), [d.text for d in docs], 2)):
        r = rows[d.doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_lm_scores(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op3_lm_scores")}
    for d, (n, score) in zip(docs, brute.backoff_scores([d.text for d in docs])):
        assert rows[d.doc_id]["n_words"] == n and rows[d.doc_id]["log_score"] == pytest.approx(score, rel=1e-9)


def test_mixing(spark):
    got = sorted(tuple(r.values()) for r in result(spark, "op4_mixing"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(duckdb.sql(queries.ORACLE_SQL["op4_mixing"]).fetchall())


def test_simhash(spark, docs):
    want = brute.simhash_components([d.doc_id for d in docs], [d.text for d in docs])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op5_simhash")} == want


def test_lz_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op7_lz_fingerprints")}
    texts = [d.text or "" for d in docs]
    for i, d in enumerate(docs):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, following = (brute.lz_fingerprint(t) for t in (text, edited, after))
        r = rows[d.doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed)
        assert (r["near_edited"], r["near_next"]) == (brute.lz_likeness(own, changed), brute.lz_likeness(own, following))
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.97 * len(rows)


def test_secrets(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op8_secrets")}
    for d in docs:
        spans, r = brute.base_spans(d.text or ""), rows[d.doc_id]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r["base_sha256"] == brute.spans_digest(spans)
        assert r["spans"] == brute.all_spans(d.text or "", secrets.CLASSES, secrets.ALLOW, secrets.CANDIDATE)


def test_quality(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op9_quality")}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for d in docs:
        r = rows[d.doc_id]
        assert tuple(r[n] for n in names) == brute.statistics(d.text)
        assert not (r["kept"] and r["base_failed"])


def test_language_id(spark, docs):
    rows = {r["doc_id"]: r for r in result(spark, "op10_language_id")}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows.values())
    judged = [d for d in docs if rows[d.doc_id]["held_out"] and d.lang]
    assert all(zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in judged)
    assert sum(rows[d.doc_id]["lang_pred"] == d.lang for d in judged) >= 0.9 * len(judged)


def test_html_text(spark):
    """The synthetic pages name their article, so its blocks can be cut out with patterns."""
    import html
    import re

    rows = {r["page_id"]: r for r in result(spark, "op6_html_text")}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]+>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inside)]
        blocks = [b for b in (re.sub(r"\s+", " ", b).strip() for b in blocks) if b]
        assert rows[page.page_id]["text"] == "\n\n".join(blocks)
        assert rows[page.page_id]["n_chars"] == len(rows[page.page_id]["text"])


def test_encoder_with_a_small_memory(docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 500)
    path = queries.tokenizer_file("byte_bpe_50k.json")
    texts = [d.text or "" for d in docs]
    plain, made = Tokenizer.from_file(path), tokens.PieceEncoder(path, "leading")
    for some in tokens.portions(pa.array(texts), 20_000):
        found = made.encode(texts[some])
        assert [x.tolist() for x in found] == [e.ids for e in plain.encode_batch_fast(texts[some], add_special_tokens=False)]
