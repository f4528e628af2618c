"""What is asked of a database, as text; no database is needed."""

from buildlens.sources import tables as TB


def test_the_database_cuts_texts_and_knows_its_columns():
    mysql = TB.jdbc_options("mysql", "h", 3306, "ci", "test_runs")["dbtable"]
    assert mysql.startswith("(SELECT id, build, ") and "LEFT(failure_txt, 8192) AS failure_txt" in mysql and mysql.endswith(" FROM test_runs) capped")
    click = TB.jdbc_options("clickhouse", "h", 8123, "ci", "test_runs", text_cap=10)["dbtable"]
    assert click.startswith("(SELECT build, ") and "substringUTF8(failure_txt, 1, 10) AS failure_txt" in click
    assert TB.jdbc_options("mysql", "h", 1, "ci", "test_runs", text_cap=0)["dbtable"] == "test_runs"
    assert TB.jdbc_options("mysql", "h", 1, "ci", "performance_metrics")["dbtable"] == "performance_metrics"


def test_recent_builds_are_found_by_the_database():
    options = TB.jdbc_options("mysql", "h", 1, "ci", "performance_metrics", split=("id", 0, 9, 3))
    asked = TB.recent_builds_options(options, 4)
    assert "GROUP BY build ORDER BY last_recorded DESC, build DESC LIMIT 4" in asked["dbtable"] and "partitionColumn" not in asked
    assert asked["url"] == options["url"]


def test_names_are_asked_for_in_chunks_once():
    names = [f"n{i:03d}" for i in range(25)] + ["n001", "it's", "back\\slash"]
    parts = TB.name_predicates(names, "mysql", most=10)
    assert len(parts) == 3 and all(p.startswith("name IN (") for p in parts)
    assert parts[0].startswith("name IN ('back\\\\slash', 'it''s', 'n000'")
    assert sum(p.count("'n") for p in parts) == 25
    assert TB.name_predicates([], "mysql") == ["1 = 0"]
