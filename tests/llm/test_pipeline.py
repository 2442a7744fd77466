"""The pipeline's stages against plain versions, each on its own input."""

import collections
import random

import pytest

import corpus_pipeline
from pagevault.llm import langid, mixing, pii, queries

from cases import COLUMNS, clashing
from test_pairs import brute_near
from test_texts import plain_spans


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    syllables = {"xx": ["the", "and", "ing", "ion"], "yy": ["der", "und", "sch", "ung"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["xx", "yy"])
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 150)))
        if i % 9 == 0:
            text += f" mail user{i}@mail.example.org or +1 (555) 010-{1000 + i} today"
        rows.append([i, text, lang if i % 5 else None, rng.choice(["a", "a", "a", "b", None])])
    for i in range(160, 190):
        rows.append([i, rows[i - 160][1] + rng.choice(["", " tail"]), None, "c"])
    rows += [[190, None, "xx", "a"], [191, "", None, None], [192, "12 34", "yy", "b"]]
    folder = str(tmp_path_factory.mktemp("sf"))
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_equal_plain_versions(spark, fixture_dir, tmp_path):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    columns = docs.columns
    outs = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, fixture_dir).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        outs.append((docs, before, after))
        docs = after
    assert all(sorted(o[2].columns) == sorted(columns) for o in outs[:-1])
    # languages: everything with letters stays as it is
    _, before, after = outs[0]
    kept = {r.doc_id: r for r in after.collect()}
    assert set(before) - set(kept) == {i for i, r in before.items() if not any(map(str.isalpha, r.text or ""))}
    assert all(before[i] == r for i, r in kept.items())
    # near copies: the first of each group stays
    _, before, after = outs[1]
    ids = sorted(before)
    plain = brute_near([before[i].text for i in ids])
    assert sorted(r.doc_id for r in after.collect()) == [i for n, i in enumerate(ids) if plain[n][2]]
    # private data
    _, before, after = outs[2]
    for r in after.collect():
        spans = plain_spans(before[r.doc_id].text)
        assert r.n_chars == len(r.text) and (r.text == before[r.doc_id].text) == (not spans)
        if spans:
            assert r.text == pii.without(before[r.doc_id].text, [(s, e, k) for k, s, e in spans])
    # mixing: as often as mix() takes
    given, before, after = outs[3]
    times = collections.Counter(r.doc_id for r in after.collect())
    assert times == {r.doc_id: r.taken // r.size for r in mixing.mix(given).collect() if r.taken}
    # packing: every copy whole, sequences gapless
    from tokenizers import Tokenizer

    _, _, after = outs[4]
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    texts = {i: r.text for i, r in before.items()}
    rows = after.collect()
    assert collections.Counter(r.doc_id for r in rows) == times
    assert all(r.length == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1 for r in rows)
    filled = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096


def test_run_writes_every_stage(spark, fixture_dir):
    out = corpus_pipeline.run(spark, fixture_dir)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 0


def test_languages_without_labels_keep_documents(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (None, "other words", None), (4, None, None)], "doc_id long, text string, lang string")
    assert sorted(r.text for r in corpus_pipeline.language_id(spark, docs, "").collect()) == ["other words", "some words"]


def test_near_copies_at_four_fifths_are_dropped(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:91], *(f"x{i}" for i in range(9))]), " ".join([*base[12:], *(f"y{i}" for i in range(12))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")  # 87 of 105 shingles: 0.829; 84 of 108: 0.778
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "A b c d e f"), (None, "x y z"), (None, "x y z"), (None, "other"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, "a b c d e f"), (1, "q r s t u v"), (None, "x y z"), (None, "other"), (3, None)], key=repr)


def test_no_letters_means_undetermined():
    assert not langid.has_letter(b"12 34 !") and langid.has_letter("漢".encode()) and not langid.has_letter("٣ ́".encode())


def stages_over(spark, docs, folder):
    """The rows that each stage leaves, written and read again."""
    out = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        out.append(docs)
    return out


ODD = [
    (None, None, None, None, None), (None, "some words of the text", "en", None, 3), (None, "some words of the text", "en", None, 3), (1, "of the words that one reads", "en", "a", 1),
    (1, "of the words that one reads", "en", "a", 1), (1, "another text of the same id", None, "a", 1), (2, "", "en", "b", 0), (3, "   ", None, "b", 0), (4, "OF the words that one reads", "en", "b", 9),
    (5, "12 34 56", "en", "a", 1), (6, "the words " * 3000, "en", "a", 1), (7, "mail me@mail.example.org the words", "en", None, 2), (8, "mail me@mail.example.org the words", "en", None, 2),
]


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = clashing(spark.createDataFrame(ODD, COLUMNS))
    outs = stages_over(spark, docs, tmp_path)
    assert all(sorted(o.columns) == sorted(docs.columns) for o in outs[:-1]) and all(r.z == "7" and r.block == 7 for o in outs[:-1] for r in o.collect())
    texts = [sorted(((r.doc_id, r.text) for r in o.collect()), key=repr) for o in outs[:3]]
    with_letters = [(r[0], r[1]) for r in ODD if any(map(str.isalpha, r[1] or ""))]
    assert texts[0] == sorted(with_letters, key=repr)
    # repeated rows leave one, near copies the smallest id; 8 has the text of 7, 4 that of 1 in other letters
    assert texts[1] == sorted(set(x for x in with_letters if x[0] not in (4, 8)), key=repr)
    assert texts[2] == sorted(((i, t.replace("me@mail.example.org", "[EMAIL]")) for i, t in texts[1]), key=repr)
    assert all(r.n_chars == len(r.text) for r in outs[2].collect())
    taken = collections.Counter((r.doc_id, r.text) for r in outs[3].collect())
    assert set(taken) <= set(texts[2]) and sum(taken.values()) > 0 and max(taken.values()) <= 3
    assert outs[4].where("piece = 0").count() == sum(taken.values())
    lengths = outs[4].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in lengths) <= 4096


def test_stages_over_an_empty_table_and_without_counts(spark, tmp_path):
    assert [o.count() for o in stages_over(spark, spark.createDataFrame([], COLUMNS), tmp_path / "none")] == [0] * 5
    docs = spark.createDataFrame([r[:4] for r in ODD], "doc_id long, text string, lang string, source string")
    assert [o.count() > 0 for o in stages_over(spark, docs, tmp_path / "bare")] == [True] * 5


def test_run_leaves_only_the_last_stage(spark, fixture_dir):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, fixture_dir)
    made = [f for f in set(os.listdir(folder)) - before if f.startswith("pipeline")]
    assert len(made) == 1 and os.listdir(f"{folder}/{made[0]}") == ["4"]


OWN = "_id long, _text string, _text_2 long, _id_r long, _text_r long, _first int, _pii_id long, _pii_hash long, _pii_spans string, id string, text_1 long, text_2 long, row string, first int, hash string, th string, spans string"


@pytest.mark.parametrize("held", [100_000, 0])
def test_any_further_column_is_kept(spark, tmp_path, monkeypatch, held):
    """Columns that are named as the stages' own ones are, or as earlier ones were, also beside repeated rows; and one with a dot."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "PATTERNS_HELD", held)
    docs = spark.createDataFrame(ODD, COLUMNS)
    for name, kind in (part.split() for part in OWN.split(", ")):
        docs = docs.withColumn(name, F.lit("3").cast(kind))
    docs = docs.withColumn("a.b", F.lit(4)).withColumn("some", F.create_map(F.lit("k"), F.lit(5)))
    outs = stages_over(spark, docs, tmp_path)
    plain = stages_over(spark, spark.createDataFrame(ODD, COLUMNS), tmp_path / "plain")
    for out, without in zip(outs[:-1], plain[:-1], strict=True):
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r["_id"] == 3 and r["_text"] == "3" and r["row"] == "3" and r["spans"] == "3" and r["a.b"] == 4 and r["some"] == {"k": 5} for r in rows)
        assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in without.collect())
