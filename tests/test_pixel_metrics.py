"""Images of whole texts, against pixel loops."""

import pytest

from veridecl.plans import audit_queries


def test_images_hold_whole_texts(spark, tmp_path):
    texts = [None, "", "short", "x" * 16, "é\n" * 100, "a" * 256 + "b~" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["origin"]): r for r in audit_queries.i5_pixel_metrics(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        height = max(1, -(-len(data) // 16))
        m = [list(data.ljust(16 * height, b"\0")[16 * y : 16 * y + 16]) for y in range(height)]
        near = lambda k, n: 0 if n == 1 else 1 if k < 0 else n - 2 if k >= n else k
        laplacian = [m[near(y - 1, height)][x] + m[near(y + 1, height)][x] + m[y][near(x - 1, 16)] + m[y][near(x + 1, 16)] - 4 * m[y][x] for y in range(height) for x in range(16)]
        mean = sum(laplacian) / len(laplacian)
        assert (got[i]["width"], got[i]["height"]) == (16, height)
        assert got[i]["laplacian_variance"] == pytest.approx(sum((v - mean) ** 2 for v in laplacian) / len(laplacian), abs=1e-5)
        assert got[i]["dark_ratio"] == pytest.approx(sum(v <= 15 for row in m for v in row) / (16 * height), abs=1e-5)
