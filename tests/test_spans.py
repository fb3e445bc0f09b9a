"""Containment spans with long, overlapping and non-BMP surfaces."""

from lexweave.operators import correction


def test_spans(spark):
    cues = spark.createDataFrame([(1, 0, "芙芙芙宁 abcabcabc 𝒳y"), (1, 1, ""), (1, 2, None), (2, 0, "abcabc")], "doc_id long, cue_index long, text string")
    surfaces = spark.createDataFrame([("芙芙",), ("abcabc",), ("𝒳y",), ("y",), ("",)], "surface string")
    got = sorted((r.doc_id, r.cue_index, r.surface, r.start_char, r.end_char) for r in correction.containment_spans(cues, surfaces).collect())
    assert got == sorted([(1, 0, "芙芙", 0, 2), (1, 0, "芙芙", 1, 3), (1, 0, "abcabc", 5, 11), (1, 0, "abcabc", 8, 14), (1, 0, "𝒳y", 15, 17), (1, 0, "y", 16, 17), (2, 0, "abcabc", 0, 6)])
    small = spark.createDataFrame([("abcabc",)], "surface string")
    assert correction.containment_spans(cues, small, broadcast_surfaces=0).count() == 3
