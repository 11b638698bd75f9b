from pathlib import Path

from turnwise.workload import by_streams


def test_a_session_gets_one_file_of_its_lines_in_order_and_nothing_else(spark, tmp_path):
    rows = [(s, n, None if n == 3 else f"é{s}-{n}") for n in (3, 1, 2) for s in range(5)] + [(None, 1, "none")]
    by_streams._write(spark.createDataFrame(rows, "session bigint, line_no bigint, value string"), str(tmp_path))
    files = {str(f.parent.relative_to(tmp_path)): f.read_text() for f in Path(tmp_path).rglob("*") if f.is_file()}
    assert files == {f"session={s}": f"é{s}-1\né{s}-2\n\n" for s in range(5)} | {"session=__HIVE_DEFAULT_PARTITION__": "none\n"}
    assert len([f for f in Path(tmp_path).rglob("*") if f.is_file()]) == 6
