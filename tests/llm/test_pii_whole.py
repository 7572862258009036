"""Every form that the field is trained on reaches it."""

import pytest
from latticework.llm import pii


@pytest.mark.parametrize(
    "text, span",
    [
        ("please contact jane (at) example.com today", "jane (at) example.com"),
        ("please contact jane(at)example.com today", "jane(at)example.com"),
        ("please contact jane [at] example.com today", "jane [at] example.com"),
        ("the server 10[.]0[.]0[.]17 is down", "10[.]0[.]0[.]17"),
        ("the host a1b2:c3d4:e5f6:a7b8:c9d0:e1f2:a3b4:c5d6 is down", "a1b2:c3d4:e5f6:a7b8:c9d0:e1f2:a3b4:c5d6"),
    ],
)
def test_trained_forms_are_found(spark, text, span):
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in row["spans"].split(",") if s)] == [span]
