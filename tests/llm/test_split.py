import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm.split import cut_points, split_oversized, strengths


def brute_best(level, low, high):
    return max(range(low, high + 1), key=lambda p: (level[p], p))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é. \n,場́\r", max_size=400), st.integers(8, 60), st.integers(-3, 80))
def test_pieces_cover_the_text(text, limit, overlap):
    data = text.encode()
    pieces = cut_points(data, limit, overlap)
    used = min(max(0, overlap), max(8, limit) // 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert used <= b - c <= used + 3 and c > a and d > b
    for a, b, _ in pieces:
        assert b - a <= max(8, limit)
        data[a:b].decode()


def test_strongest_cut_rightmost_of_equals():
    random.seed(1)
    text = "".join(random.choice(["word ", "more, ", "end. ", "x", "\n", "\n\n"]) for _ in range(4000)).encode()
    level = strengths(text)
    for a, b, s in cut_points(text, 200, 20)[:-1]:
        assert b == brute_best(level, a + 100, a + 200) and s == level[b]


def test_one_unbroken_run_and_long_text():
    assert [b - a for a, b, _ in cut_points(b"x" * 1000, 300, 0)] == [300, 300, 300, 100]
    long = ("場" * 700_000).encode()
    pieces = cut_points(long, 4096, 400)
    assert max(b - a for a, b, _ in pieces) <= 4096 and pieces[-1][1] == len(long)


def test_crlf_and_marks_stay_together():
    level = strengths(b"a\r\nb x")
    assert level[2] == -1 and level[3] == 4
    assert strengths("e\u0301".encode())[1] == -1 and strengths("\u00e9".encode())[1] == -1


def test_rows_without_a_result_and_clashing_columns(spark, rows):
    data = [(1, None, 10, 2, "i"), (2, "", 10, 2, "t"), (3, "abc def ghi jkl", 10, None, "x"), (4, "abc def ghi jkl", None, 2, "n"), (None, "abc def ghi jkl", 10, 2, "o"), (3, "abc def ghi jkl", 10, None, "x")]
    df = spark.createDataFrame(data, "id long, x string, n long, o long, t string")
    out = rows(split_oversized(df, "tab", "id", "x", F.col("n"), F.col("o")).select("item_table", "item_id", "piece_index", "piece"))
    assert out == [("tab", 3, 0, "abc def "), ("tab", 3, 0, "abc def "), ("tab", 3, 1, "ghi jkl"), ("tab", 3, 1, "ghi jkl")]
    assert split_oversized(df.limit(0), "tab", "id", "x", F.lit(4), F.lit(1)).count() == 0


@pytest.mark.parametrize("overlap", [0, 5, 50, 5000])
def test_overlap_over_half_counts_as_half(overlap):
    pieces = cut_points(b"ab cd " * 500, 100, overlap)
    assert all(b - c == min(overlap, 50) for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))
