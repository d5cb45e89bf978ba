"""The feature of texts that take several images."""

from engram.llm import jpeg
from tests.llm.test_operators import frame


def test_feature_covers_all_images(spark):
    start = "the same words again " * 30_000  # 630,000 bytes; an image holds 512,000
    a, b = (start[: -len(end)] + end for end in (("a" * 32 + "z" * 32) * 1600, ("z" * 32 + "a" * 32) * 1600))
    rows = {r.doc_id: r for r in jpeg.media_columns(frame(spark, [a, b, "short"])).collect()}
    assert [rows[i].images for i in range(3)] == [2, 2, 1] and rows[0].height == rows[1].height
    assert rows[0].feature != rows[1].feature
