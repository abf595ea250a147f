"""Restoring a session promotes all its tables or none."""

import pytest

from eventloom.sources import session
from eventloom.sources.tables import write_session


def document(**changes):
    whole = {
        "session": {"version": 1}, "files": {"records": [{"name": "a.fcs", "size": 5, "digest": "x"}, {"name": "b.fcs"}]},
        "metadata": {"columns": [{"field": "strain", "label": "Strain"}], "rows": [{"name": "a.fcs", "strain": "wt"}, {"name": "b.fcs"}]},
        "stats_plan": {"entries": [{"channel": "DNA-A", "metrics": ["mean", "median"]}]}, "structural_qc": {"DNA_A": {"enabled": True, "override": 100}},
        "modeling": {"samples": [{"name": "a.fcs", "model": "auto", "g1_left": 1.0, "g1_right": 2.0, "g2_left": 3, "g2_right": 4.0}]}, "table": {"selected_files": ["b.fcs"]},
    }
    return write_session(whole | changes)


def contents(spark, folder):
    return {s: sorted(map(str, session.restored(spark, folder, s).collect())) for s in session.SCHEMAS}


BROKEN = [
    ("files", {"files": {"records": [{"name": "a.fcs"}, {"name": "a.fcs"}]}}), ("files", {"files": {"records": [{"name": ""}]}}), ("files", {"files": {"records": [{"name": "a.fcs", "size": "big"}]}}),
    ("metadata", {"metadata": {"columns": [], "rows": [{"name": "a.fcs", "strain": "wt"}]}}), ("metadata", {"metadata": {"columns": [{"field": "s"}, {"field": "s"}], "rows": []}}),
    ("metadata", {"metadata": {"columns": [{"field": "s"}], "rows": [{"name": "lost.fcs", "s": "x"}]}}), ("metadata", {"metadata": {"columns": "strain", "rows": []}}),
    ("stats_plan", {"stats_plan": {"entries": [{"channel": "", "metrics": ["mean"]}]}}), ("stats_plan", {"stats_plan": {"entries": [{"channel": "A", "metrics": ["mode"]}]}}),
    ("structural_qc", {"structural_qc": {"FSC": {"enabled": True}}}), ("structural_qc", {"structural_qc": {"DNA_A": {"override": -1.0}}}),
    ("modeling", {"modeling": {"samples": [{"name": "a.fcs", "g1_left": 3.0, "g1_right": 2.0, "g2_left": 4.0, "g2_right": 5.0}]}}), ("modeling", {"modeling": {"samples": [{"name": "a.fcs", "g1_left": 3.0}]}}),
    ("table", {"table": {"selected_files": ["lost.fcs"]}}),
]


def test_a_broken_section_leaves_every_table_as_it_was(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert contents(spark, folder) == {s: [] for s in session.SCHEMAS}
    first = session.restore(spark, document(), folder)
    assert first.status == "restored" and first.rows == {"files": 2, "metadata_columns": 1, "metadata": 2, "stats_plan": 2, "structural_qc": 1, "modeling": 1, "table": 1}
    before, kept = contents(spark, folder), {p.name for p in (tmp_path / "s").iterdir()}
    for section, changes in BROKEN:
        got = session.restore(spark, document(**changes), folder)
        assert (got.status, got.failed_section, got.version) == ("failed", section, first.version), (section, got)
        assert got.reason
    for text, where in ((document() + "\n[other]\n", "document"), ("not a session", "document")):
        assert session.restore(spark, text, folder).failed_section == where
    assert session.restore(spark, document(), folder, lambda: 1 / 0).failed_section == "promotion"
    assert contents(spark, folder) == before and {p.name for p in (tmp_path / "s").iterdir()} == kept


def test_the_next_version_replaces_all_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    session.restore(spark, document(), folder)
    second = session.restore(spark, document(table={"selected_files": ["a.fcs"]}, modeling={"samples": []}), folder)
    assert second.status == "restored" and session.restored(spark, folder, "modeling").count() == 0
    assert [r.selected for r in session.restored(spark, folder, "table").collect()] == ["a.fcs"]


def test_collected_tables_restore_to_themselves(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    session.restore(spark, document(), one)
    text = session.collected({s: session.restored(spark, one, s) for s in session.SCHEMAS})
    assert session.restore(spark, text, two).status == "restored" and contents(spark, one) == contents(spark, two)
    with pytest.raises(ValueError, match="too large"):
        session.collected({"files": session.restored(spark, one, "files")}, most_bytes=10)


def test_a_document_in_parts_restores_like_one_of_text(spark, tmp_path):
    one, two, parts = (f"file://{tmp_path}/{k}" for k in ("one", "two", "parts"))
    session.restore(spark, document(), one)
    tables = {s: session.restored(spark, one, s) for s in session.SCHEMAS}
    done = session.restore_parts(spark, session.collected_parts(tables, parts), two)
    assert done.status == "restored" and done.rows["files"] == 2 and contents(spark, one) == contents(spark, two)
    before = contents(spark, two)
    (tmp_path / "parts/files/x.json").write_text('{"name":"c.fcs","size":"big"}\n')
    wrong = session.restore_parts(spark, parts, two)
    assert (wrong.status, wrong.failed_section, wrong.version) == ("failed", "files", done.version) and "big" in wrong.reason
    (tmp_path / "parts/files/x.json").write_text('{"name":"a.fcs"}\n')
    assert session.restore_parts(spark, parts, two).reason.startswith("files: a name comes twice")
    (tmp_path / "parts/files/x.json").unlink()
    (tmp_path / "parts/other").mkdir()
    assert session.restore_parts(spark, parts, two).failed_section == "document"
    assert session.restore_parts(spark, f"{parts}-none", two).failed_section == "document" and contents(spark, two) == before


def test_a_session_of_more_rows_than_a_text_holds(spark, tmp_path):
    names = spark.range(300_000).selectExpr("concat('a-long-name-of-a-sample-file-', id, '.fcs') AS name", "id AS size")
    with pytest.raises(ValueError, match="too large"):
        session.collected({"files": names})
    done = session.restore_parts(spark, session.collected_parts({"files": names}, f"file://{tmp_path}/parts"), f"file://{tmp_path}/s")
    assert done.status == "restored" and done.rows["files"] == 300_000
