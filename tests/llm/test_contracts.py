"""The registered queries over whole small tables: columns, rows, held-out rows, and results against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from pagevault.llm import queries

from conftest import SF
from test_pairs import brute_near, brute_phrases, brute_vectors
from test_texts import plain_spans

COLUMNS = {
    "op1_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_private_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_vector_neardup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_minhash_neardup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    frame = queries.QUERIES[name](spark, SF)
    kinds = dict(frame.dtypes)
    for part in COLUMNS[name].split(", "):
        column, kind = part.split()
        assert kinds[column] == kind, part
    return {r[key]: r for r in frame.collect()}


def test_every_query_has_a_contract():
    assert set(COLUMNS) == set(queries.QUERIES)


def test_media(spark, texts):
    got = rows(spark, "op1_media_columns")
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert len(r.rgb) == 3 * r.width * r.height and r.feature.startswith(f"{r.width}x{r.height}:")


def test_private_data(spark, texts):
    got = rows(spark, "op2_private_data")
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = plain_spans(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[i].spans.startswith(listed)
        assert got[i].n_spans == len([x for x in got[i].spans.split(",") if x]) == len(base) + got[i].n_found


@pytest.mark.parametrize(("name", "modulus", "remainder"), [("op3_language_id", 4, 2), ("op9_quality_classifier", 3, 1)])
def test_held_out_rows(spark, texts, name, modulus, remainder):
    got = rows(spark, name)
    assert set(got) == set(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) for i, r in got.items())
    if name == "op9_quality_classifier":
        assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    frame = queries.op4_best_fit_packing(spark, SF)
    assert [f"{k} {v}" for k, v in frame.dtypes] == COLUMNS["op4_best_fit_packing"].split(", ")
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in frame.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    total = 0
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        assert got == [(n, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) <= 1.1 * -(-total // 4096) + 1


def test_near_copies(spark, texts):
    ids = sorted(texts)
    want = brute_near([texts[i] for i in ids])
    got = rows(spark, "op8_minhash_neardup")
    assert {i: tuple(got[i])[1:] for i in ids} == {ids[n]: (size, ids[top], kept) for n, (size, top, kept) in want.items()}


def test_repeated_passages(spark, texts):
    got = rows(spark, "op10_substring_dedup")
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_phrases(list(texts.items()))


def test_vectors(spark):
    table = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows(spark, "op7_vector_neardup", "vec_id")
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_vectors(table)


def test_urls_and_mixing(spark, texts):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    got = rows(spark, "op5_url_filter", "page_id")
    assert len(got) == pages and {r.verdict for r in got.values()} <= {"allow", "block"}
    got = rows(spark, "op6_source_mixing")
    assert set(got) == set(texts) and all(r.taken <= 3 * r.size for r in got.values())


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"op6_source_mixing"}))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    kinds, columns = dict(got.dtypes), sorted(want.columns)
    assert set(columns) <= set(kinds) and all(kinds[c] == k for c, k in (p.split() for p in COLUMNS[name].split(", ")))
    mine, theirs = ([repr(tuple(r)) for r in rows] for rows in (got.select(*columns).collect(), want.select(", ".join(columns)).fetchall()))
    assert sorted(mine) == sorted(theirs)
