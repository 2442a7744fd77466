"""Rows whose every column is null, alone and among others, and repeated rows, through each registered operator."""

import pytest

from pagevault.llm import langid, media, minhash, mixing, packing, phrases, pii, quality, queries, urlfilter, vecdedup

from cases import COLUMNS

ROWS = [(None, None, None, None, None), (1, "some words to read here", "en", "a", 5), (1, "some words to read here", "en", "a", 5), (2, None, None, None, None), (None, "other words are here now", "en", None, 3)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def ids(rows, name="doc_id"):
    return sorted((str(r[name]) for r in rows.collect()))


def test_every_row_comes_back(spark, frame):
    want = ids(frame)
    model = langid.fit(frame)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    for out in (
        media.store_texts(frame),
        pii.detect(frame),
        langid.predict(frame, model),
        packing.pack(frame, queries.vocabulary()),
        mixing.mix(frame),
        minhash.near_duplicates(frame),
        quality.score(frame, quality.fit(frame, labels)),
        phrases.deduplicate(frame),
    ):
        assert ids(out) == want, out.columns
    assert ids(pii.redact(frame)) == want
    assert ids(langid.accepted_rows(frame, model)) == ["1", "1", "None"]


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.com/en/1"), (1, "http://a.com/en/1")], "page_id long, url string")
    model, rates = urlfilter.fit(urlfilter.labelled_by_rules(pages, queries.URL_RULES))
    assert ids(urlfilter.judge(pages, queries.URL_RULES, model, rates), "page_id") == ["1", "1", "None"]
    vectors = spark.createDataFrame([(None, None, None), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    rows = sorted(map(tuple, vecdedup.near_duplicates(vectors).collect()), key=repr)
    assert rows == sorted([(None, 0, None, True), (None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False)], key=repr)
