"""Steps whose work must follow the size of their input: spread over tasks, and not a product of two tables."""

import json
import random
import sys

import numpy as np
import pytest

from brindle import testbed as tb
from brindle.functions.lenient_json import BadJson, parse
import brindle.plans.search  # noqa: F401 - the package gives the function of that name
from brindle.queries import QUERIES
from brindle.sources import tree, tree_stream
from brindle.streaming import protocol

plans = sys.modules["brindle.plans.search"]


def test_stretches_are_few_and_exact():
    rng = random.Random(3)
    for _ in range(300):
        a, b = sorted(rng.sample(range(8**4 + 1), 2))
        found = plans.stretches(a, b)
        assert sorted(x for k, n in found for x in range(n * 8**k, (n + 1) * 8**k)) == list(range(a, b))
        assert len(found) <= 2 * 7 * 5
    assert plans.stretches(0, 8**4) == [(4, 0)]


def test_searches_over_versions_equal_brute_force(spark):
    rng = random.Random(5)
    times = 30
    rows = []
    for i in range(120):
        a, b = sorted(rng.sample(range(times + 1), 2))
        since, until = rng.choice([(a, b), (0, b), (a, times), (0, times), (0, times)])
        rows.append((rng.choice(["ab", "Ab", "axb", "abc", "zz"]) + rng.choice(["", "1", "_b"]), rng.choice(["class", "enum"]), f"f{i % 7}", i % 5, i, since, until))
    made = spark.createDataFrame(rows, "name string, kind string, file string, line int, ord long, since long, until long")
    asked = [(p, at, rng.randint(1, 6)) for p in ("ab", "ab class", "b", "none") for at in range(times) for _ in range(2)]
    got = plans.versions_search(made, spark.createDataFrame(asked, "pattern string, at long, qlimit int"), times)
    got = {(r.pattern, r.at): [tuple(x) for x in r.rows] for r in got.collect()}
    most = {}
    for p, at, n in asked:
        most[p, at] = max(n, most.get((p, at), 0))
    for at in (0, 1, 7, 8, 15, 16, 29):
        now = spark.createDataFrame([r[:5] for r in rows if r[5] <= at < r[6]], "name string, kind string, file string, line int, ord long")
        for p in ("ab", "ab class", "b", "none"):
            assert got.get((p, at), []) == [tuple(r) for r in plans.search(now, p, most[p, at]).collect()]


def test_limits_of_escaped_requests_are_read(spark, sf_dir):
    users = {r.event_id: r.user_id for r in tb.table(spark, sf_dir, "events").select("event_id", "user_id").collect()}
    rows = [r for r in QUERIES["parse_escapes"](spark, sf_dir).collect() if r.event_id % 6 == 3]
    assert {r.event_id: r.limit for r in rows} == {i: u or 200 for i, u in users.items() if i % 6 == 3}
    assert len({r.limit for r in rows}) > 1


@pytest.mark.parametrize("compat", [False, True])
def test_limits_in_quotes_are_among_the_escaped_requests(spark, sf_dir, compat):
    users = {r.event_id: r.user_id for r in tb.table(spark, sf_dir, "events").select("event_id", "user_id").collect()}
    rows = {r.event_id: r for r in protocol.parse_requests(tb.escaped_lines(spark, sf_dir), strict_compat=compat).collect()}
    assert set(rows) == set(users)
    alone = {i: u for i, u in users.items() if i % 6 == 1}
    assert {i: json.loads(rows[i].line, strict=False)["params"].get("limit") for i in alone} == {i: str(u) for i, u in alone.items()}
    assert {rows[i].limit for i in alone} == {200}
    before = {i: u for i, u in users.items() if i % 6 == 3}
    assert all(f'"limit":"{u}","limit":{u},' in rows[i].line and rows[i].limit == (u or 200) for i, u in before.items())


def test_rows_of_one_row_group_are_dealt_to_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tb, "SOURCES_EACH", 20)
    monkeypatch.setattr(tb, "LINES_EACH", 100)
    for made in (tb.generated_sources(spark, sf_dir), tb.hostile_lines(spark, sf_dir), tb.request_lines(spark, sf_dir), tb.escaped_lines(spark, sf_dir), tb.replay_lines(spark, sf_dir)):
        assert made.rdd.getNumPartitions() > 4


def test_one_folder_is_listed_by_shares(spark, tmp_path):
    for i in range(50):
        (tmp_path / f"f{i}.cpp").write_text(f"int v{i};")
    reader = tree.TreeReader({"root": str(tmp_path), "batch": "10"})
    parts = reader.partitions()
    assert len(parts) == 5 and all(set(vars(p)) == {"_value", "root", "folder", "deep", "share", "of"} or "files" not in vars(p) for p in parts)
    each = [[x for b in reader.read(p) for x in b.column("path").to_pylist()] for p in parts]
    assert sorted(sum(each, [])) == sorted(f"f{i}.cpp" for i in range(50)) and all(each)
    assert tree.read_tree(spark, str(tmp_path), batch="10").where("content is not null").count() == 50


def test_changes_of_one_folder_are_compared_by_shares(tmp_path, monkeypatch):
    monkeypatch.setattr(tree_stream, "LISTED", 5)
    root = tmp_path / "t"
    root.mkdir()
    reader = tree_stream.ChangeReader({"root": str(root), "state": str(tmp_path / "state")})
    state, now, offset = {}, {}, reader.initialOffset()
    for n, most in ((4, 1), (40, 4), (30, 4), (3, 4)):  # undealt, dealt, dealt, undealt
        for f in list(root.iterdir()):
            f.unlink()
        now = {}
        for i in range(n):
            (root / f"f{i}.cpp").write_text(str(n))
            now[f"f{i}.cpp"] = (root / f"f{i}.cpp").stat().st_mtime_ns
        new = reader.latestOffset()
        parts = reader.partitions(json.loads(json.dumps(offset)), new)
        assert len(parts) >= most
        got = [r for p in parts for r in reader.read(p)]
        want = [(p, ns, "changed" if p in state else "new") for p, ns in now.items() if state.get(p) != ns] + [(p, None, "removed") for p in state if p not in now]
        assert sorted(map(str, got)) == sorted(map(str, want))
        state, offset = now, new


def test_arrays_in_arrays_at_any_depth():
    assert parse("[ [\n[1,[]] ,[[ ]]], 2]x") == [[[1, []], [[]]], 2]
    v = parse("[" * 3000 + "]" * 3000)
    for _ in range(2999):
        (v,) = v
    assert v == []
    for bad in ("[[[", "[[,", "[[[]]", "[" * 3000 + "]" * 2999, "[[1 2]]", "[[}"):
        with pytest.raises(BadJson):
            parse(bad)


def test_strings_are_told_from_brackets_wherever_a_text_begins():
    from brindle.sources import json_snapshot

    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice('"\\{}[]a,') for _ in range(rng.randrange(14)))
        for begins in (False, True):
            inside, skip, want = begins, False, []
            for i, c in enumerate(text):
                if inside:
                    skip, inside = c == "\\" and not skip, c != '"' or skip
                elif c == '"':
                    inside = True
                elif c in "{}[]":
                    want.append((i, 1 if c in "{[" else -1))
            at, step, ends = json_snapshot._outside(json_snapshot._scan(np.frombuffer(text.encode(), np.uint8)), begins)
            assert (list(zip(at.tolist(), step.tolist(), strict=True)), ends) == (want, inside), (text, begins)


@pytest.mark.parametrize("rows_each", [1, 7, 10_000])
def test_json_documents_are_read_three_times(spark, tmp_path, rows_each):
    """Once for the sums, once for what stands between elements, once for the elements, whose batches may end anywhere."""
    from brindle.sources import snapshot

    rows = [{"n": name, "k": "macro", "f": "a}.h", "l": i} | ({"x": {"y": [{"z": "{"}, 1]}} if i % 3 == 0 else {}) for i, name in enumerate(['a"', "\\", "}", "[{", "é", ""] * 8)]
    document = {"meta": {"a": {"b": "}"}}, "files": [{"p": "p", "m": 5}], "declarations": rows, "version": 2}
    (tmp_path / "s.json").write_text(json.dumps(document, indent=1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_each)
    spark.sparkContext.setJobGroup(f"json{rows_each}", "")
    try:
        d, files = snapshot.import_json(spark, str(tmp_path / "s.json"))
        got = sorted(map(tuple, d.collect()), key=lambda r: r[-1])
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"json{rows_each}"))
        assert [tuple(r) for r in files.collect()] == [("p", 5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for key in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(key, None)
    assert got == [(r["n"], "macro", "a}.h", i, i) for i, r in enumerate(rows)]
    assert jobs == 3


def test_exports_over_an_earlier_one_replace_its_parts(spark, tmp_path, monkeypatch):
    from brindle.model import DECLARATIONS, FILES
    from brindle.sources import json_snapshot, shared

    monkeypatch.setattr(json_snapshot, "PART_ROWS", 10)
    slow = []
    rename = shared.Store._rename
    monkeypatch.setattr(shared.Store, "_rename", lambda self, old, new: (slow.append(new.getName()), rename(self, old, new)))
    for times, line in enumerate((1, 2)):
        rows = [(f"n{i}", "macro", "f.h", line, i) for i in range(60)]
        json_snapshot.export_json(str(tmp_path / "s"), spark.createDataFrame(rows, DECLARATIONS), spark.createDataFrame([("p", line)], FILES))
        parts = [n for n in slow if "between" not in n]
        # a rename that replaces what is there is slow on a local store, and nothing is there at first
        assert len(parts) > 5 if times else not parts
        d, f = json_snapshot.import_json(spark, str(tmp_path / "s"))
        assert sorted(map(tuple, d.collect()), key=lambda r: r[-1]) == rows and [tuple(r) for r in f.collect()] == [("p", line)]
