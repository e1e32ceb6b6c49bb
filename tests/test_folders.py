"""Folders of files: the same frames as file by file, in a fixed number of jobs."""

from __future__ import annotations

import uuid

import pytest

import tallybridge as tb
from tallybridge.sources import files

CSV = {
    "plain.csv": "a,b,c\n1,x,2.5\n2,NA,3\n",
    "with space.csv": '"k ""q""",,k,k\n1,true,a,b\n,false,c,d\n',
    "breaks.csv": 'id,text\n1,"two\nlines, one cell"\n2,"say ""hi"""\n',
    "header_breaks.csv": '"two\nlines",b\n1,2\n',
    "short_lines.csv": "a,b,c,d,e\n1,2\n3,4,5,6,7\n",
    "surplus.csv": "a,b\n1,2\n3,4,5\n",
    "surplus_empty.csv": "a,b\n1,2\n3,4,\n",
    "header_only.csv": "a,b\n",
    "blank_first.csv": "\n  \na,b\n1,2\n",
    "empty.csv": "\n",
    "UPPER.CSV": "a\n9223372036854775808\n1\n",
    "deeper/wide.csv": ",".join(f"c{i}" for i in range(30)) + "\n" + ",".join(map(str, range(30))) + "\n",
    "deeper/[odd]{name}.csv": "a;b,c\n1,TRUE\n",
}


def write(folder, contents):
    for name, text in contents.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def content(frame):
    return [(f.name, f.dataType) for f in frame.schema], sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("extension", [None, ".csv", "s.csv"])
def test_a_folder_gives_what_its_files_give(spark, tmp_path, extension):
    write(tmp_path, CSV)
    paths = files.list_files(spark, str(tmp_path), extension)
    each = files._load(spark, paths)
    whole = tb.load_files(spark, folder=str(tmp_path), extension=extension)
    assert [f[:3] for f in whole.files] == [f[:3] for f in each.files]
    assert list(whole.frames) == list(each.frames)
    for name, frame in each.frames.items():
        assert content(whole.frames[name]) == content(frame), name
    if extension is None:
        failed = {p.rsplit("/", 1)[-1]: e for p, _, s, e in whole.files if s == "failed"}
        assert set(failed) == {"surplus.csv", "surplus_empty.csv", "empty.csv"}
        assert "more fields" in failed["surplus.csv"]


def jobs_of(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "load")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_files_take_as_many_jobs_as_two(spark, tmp_path):
    used = []
    for many in (2, 200):
        folder = tmp_path / str(many)
        lines = {f"f{i}.csv": f"id,name,v{i % 3}\n{i},n{i},0.5\n" for i in range(many)}
        breaks = {f"b{i}.csv": f'id,"t"\n{i},"a\nb"\n' for i in range(many)}
        write(folder, lines | breaks)
        used.append(jobs_of(spark, lambda: tb.load_files(spark, folder=str(folder))))
    assert used[0] == used[1] > 0
