"""The settings of op4_line_dedup reach every step of the runs."""

from cadastrum.llm import line_dedup, queries


def test_query_joins_batches_with_common_lines_and_merges_levels(spark, monkeypatch):
    seen = {"joined": 0, "levels": set()}

    class Watched(line_dedup.LineRuns):
        def add(self, lines):
            seen["joined"] += bool(self.common)
            super().add(lines)

        def _put(self, level, run):
            seen["levels"].add(level)
            super()._put(level, run)

    monkeypatch.setattr(line_dedup, "LineRuns", Watched)
    queries.op4_line_dedup(spark, "/root/testdata/sf0.001")
    assert seen["joined"] >= 1 and {0, 1, 2} <= seen["levels"]
