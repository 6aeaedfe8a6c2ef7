from __future__ import annotations

import random
from math import floor

from pyspark.sql import functions as F

from sparkloom.functions.hashing import fragment_of, string_hash
from sparkloom.operators import fragments


def test_string_hash(spark):
    rows = spark.createDataFrame([("S001",), ("polygenelubricants",), ("",)], "s string")
    assert [r[0] for r in rows.select(string_hash(F.col("s"))).collect()] == [2520318, -2147483648, 0]
    assert all(0 <= r[0] < 3 for r in rows.select(fragment_of(F.col("s"), 3)).collect())


def test_null_scores_count_below_the_line(spark):
    graded = spark.createDataFrame([("S1", "d", 10), ("S2", "d", None)], "student_id string, department string, score int")
    assert fragments.department_averages(graded).first()["average"] == 5.0
    assert fragments.department_averages_two_phase(graded).first()["average"] == 5.0


def test_most_courses_keeps_ties(spark):
    grades = spark.createDataFrame([("S1", 1, 1), ("S1", 2, 1), ("S2", 1, 1), ("S2", 3, 1), ("S3", 1, 1)], "student_id string, course_id long, score int")
    students = spark.createDataFrame([("S1", "a"), ("S2", "b"), ("S3", "c")], "student_id string, name string")
    for f in (fragments.most_courses, fragments.most_courses_two_phase):
        assert sorted(r[0] for r in f(grades, students).collect()) == ["S1", "S2"]
    assert fragments.students_text(fragments.most_courses(grades, students)).first()[0] == "S1,a;S2,b"


def test_replay_equals_one_by_one(spark):
    rng = random.Random(3)
    kinds = ["INSERT_STUDENT", "INSERT_GRADE", "UPDATE_GRADE", "DELETE_STUDENT_COURSE", "READ_PROFILE", "NOPE", "READ_SCORE", "READ_ALL"]
    log = [(i, rng.choice(kinds), f"U{rng.randrange(6)}", rng.randrange(3), rng.randrange(100), f"n{i}", f"e{i}") for i in range(1, 600)]
    commands = spark.createDataFrame(log, "seq long, command string, student_id string, course_id long, score int, name string, email string")
    students, grades, answers, asked = {}, {}, {}, {}
    department = {0: "x", 1: "y", 2: "x"}
    courses = spark.createDataFrame(list(department.items()), "course_id long, department string")
    for seq, kind, s, c, score, name, email in log:
        if kind == "INSERT_STUDENT":
            students.setdefault(s, (name, email))
        elif kind == "INSERT_GRADE" and s in students:
            grades.setdefault((s, c), score)
        elif kind == "UPDATE_GRADE" and (s, c) in grades:
            grades[s, c] = score
        elif kind == "DELETE_STUDENT_COURSE":
            grades.pop((s, c), None)
        elif kind == "READ_PROFILE":
            answers[seq] = ",".join(students[s]) if s in students else "NULL"
        elif kind == "READ_SCORE":
            of = {d: [x or 0 for (_, k), x in grades.items() if department[k] == d] for d in "xy"}
            asked[seq] = ";".join(f"{d}:{floor(10 * sum(v) / len(v) + 0.5) / 10:.1f}" for d, v in of.items() if v) or "NULL"
        elif kind == "READ_ALL":
            n = {i: sum(k[0] == i for k in grades) for i in students}
            asked[seq] = ";".join(f"{i},{students[i][0]}" for i in sorted(n) if n[i] == max(n.values()) > 0) or "NULL"
    assert {(r[0], r[1]): r[2] for r in fragments.replay_grades(commands).collect()} == grades
    assert {r[0]: r[1] for r in fragments.profiles(commands).collect()} == answers
    assert fragments.unknown_commands(commands).first()["result"] == "ERROR: Unknown command NOPE"
    said = {r[0]: r[1] for r in fragments.command_answers(commands, courses).collect()}
    assert said == answers | asked | {r[0]: "ERROR: Unknown command NOPE" for r in log if r[1] == "NOPE"} and len(asked) > 50


def test_bad_arguments(spark):
    log = [
        (1, "INSERT_STUDENT", ["S1", "Ann", "x", "a@x"]), (2, "INSERT_STUDENT", ["S1", "Ann", "3"]), (3, "INSERT_STUDENT", ["S1", "Ann", "x"]), (4, "INSERT_STUDENT", ["S1", "Ann", "20", "a@x"]),
        (5, "READ_PROFILE", []), (6, "READ_PROFILE", [""]), (7, "INSERT_GRADE", ["S1", "C", "99999999999"]), (8, "DELETE_STUDENT_COURSE", ["S1"]), (9, "READ_ALL", []), (10, "NOPE", []), (11, "UPDATE_GRADE", ["S1", "", "-4"]),
    ]
    got = {r[0]: r[1] for r in fragments.argument_errors(spark.createDataFrame(log, "seq long, command string, args array<string>")).collect()}
    assert got == {
        1: 'ERROR: For input string: "x"', 2: "ERROR: Index 4 out of bounds for length 4", 3: 'ERROR: For input string: "x"',
        5: "ERROR: Index 1 out of bounds for length 1", 6: "ERROR: Index 1 out of bounds for length 1", 7: 'ERROR: For input string: "99999999999"', 8: "ERROR: Index 2 out of bounds for length 2",
    }


def test_lists_of_students_are_made_where_reads_are_answered(spark, monkeypatch):
    """300 students asked for 300 times are 90,000 places in lists; no row is made or collected for each of them."""
    monkeypatch.setattr(fragments, "PARTS", 8, raising=False)
    log = [(k, "INSERT_STUDENT", f"S{k}", None, None, f"n{k}") for k in range(1, 301)] + [(300 + k, "INSERT_GRADE", f"S{k}", 1, 5, None) for k in range(1, 301)] + [(600 + k, "READ_ALL", None, None, None, None) for k in range(1, 301)]
    commands = spark.createDataFrame([(*r, None) for r in log], "seq long, command string, student_id string, course_id long, score int, name string, email string")
    answers = fragments.top_answers(commands)
    everyone = ";".join(f"S{k},n{k}" for k in sorted(range(1, 301), key=str))
    assert {r[0]: r[1] for r in answers.collect()} == {600 + k: everyone for k in range(1, 301)}
    assert "collect_list" not in answers._jdf.queryExecution().optimizedPlan().toString()
