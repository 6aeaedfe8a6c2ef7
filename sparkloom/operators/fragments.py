"""The fragmented student store: routing, aggregates in one and in two phases, and ordered command replay."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.hashing import fragment_of
from sparkloom.session import ship

FRAGMENTS = 3
#: Parts of a log, of as many reads each, that are answered apart; characters of answers that leave a task's Python at a time.
PARTS, _CHARS = 256, 4_000_000


def route(students: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    return students.select("student_id", fragment_of(F.col("student_id"), fragments).alias("fragment"))


def fragment_counts(students: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    return route(students, fragments).groupBy("fragment").agg(F.count("*").alias("students"))


def graded_courses(grades: DataFrame, courses: DataFrame) -> DataFrame:
    """Grades with their course's department; grades of unknown courses go."""
    return grades.join(courses.select("course_id", "department"), "course_id")


def department_averages(graded: DataFrame) -> DataFrame:
    """Sum of scores over all grades: one without a score counts below the line."""
    return graded.groupBy("department").agg((F.sum("score") / F.count("*")).alias("average"))


def department_averages_two_phase(graded: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """Sums and counts of each fragment, then of all."""
    own = graded.groupBy(fragment_of(F.col("student_id"), fragments).alias("fragment"), "department").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    return own.groupBy("department").agg((F.sum("s") / F.sum("n")).alias("average"))


def enrolments(grades: DataFrame) -> DataFrame:
    return grades.groupBy("student_id").agg(F.count("course_id").alias("courses"))


def _most(counts: DataFrame) -> DataFrame:
    """Rows with the highest count, ties included; the maximum is one pre-aggregated row."""
    return counts.where(F.col("courses") == counts.agg(F.max("courses")).scalar())


def most_courses(grades: DataFrame, students: DataFrame) -> DataFrame:
    return _most(enrolments(grades.join(students.select("student_id"), "student_id"))).join(students.select("student_id", "name"), "student_id")


def most_courses_two_phase(grades: DataFrame, students: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """The maxima of each fragment first, then of these."""
    held = enrolments(grades.join(students.select("student_id"), "student_id")).withColumn("fragment", fragment_of(F.col("student_id"), fragments))
    best = held.groupBy("fragment").agg(F.max("courses").alias("best"))
    local = held.join(F.broadcast(best), "fragment").where("courses = best").select("student_id", "courses")  # a row a fragment
    return _most(local).join(students.select("student_id", "name"), "student_id")


def replay_students(commands: DataFrame, before: int | None = None) -> DataFrame:
    """Students after the commands (those with seq < ``before``): the first insert of an id stays."""
    made = commands.where("command = 'INSERT_STUDENT'")
    made = made if before is None else made.where(F.col("seq") < before)
    return made.groupBy("student_id").agg(F.min("seq").alias("since"), F.min_by("name", "seq").alias("name"), F.min_by("email", "seq").alias("email"))


def replay_grades(commands: DataFrame, before: int | None = None) -> DataFrame:
    """Grades after the commands, in closed form.

    Of the commands after a student's insert: the first grade insert after the last delete makes the grade, and the
    last update after that sets it. Inserts of a grade that is there, and updates of one that isn't, do nothing.
    """
    ops = commands.where(F.col("command").isin("INSERT_GRADE", "UPDATE_GRADE", "DELETE_STUDENT_COURSE"))
    ops = ops if before is None else ops.where(F.col("seq") < before)
    ops = ops.select("student_id", "course_id", "seq", "command", "score").join(replay_students(commands, before).select("student_id", "since"), "student_id").where("seq > since")
    key = Window.partitionBy("student_id", "course_id")

    def of(kind: str) -> Column:
        return F.col("command") == kind

    at = ops.withColumn("gone", F.coalesce(F.max(F.when(of("DELETE_STUDENT_COURSE"), F.col("seq"))).over(key), F.lit(0)))
    at = at.withColumn("made", F.min(F.when(of("INSERT_GRADE") & (F.col("seq") > F.col("gone")), F.col("seq"))).over(key))
    live = at.where("seq = made or (command = 'UPDATE_GRADE' and seq > made)")
    return live.groupBy("student_id", "course_id").agg(F.max_by("score", "seq").alias("score"))


def grade_changes(commands: DataFrame) -> DataFrame:
    """student_id, course_id, seq, score, change: each command that changes a grade. ``change`` is 1 for a grade that comes, -1 for
    one that goes, 0 for another score; ``score`` is what is added to the sum of scores, a null score counting as 0.

    Deletes part a grade's commands into lives. In each the first insert makes the grade, and later updates set it.
    """
    ops = commands.where(F.col("command").isin("INSERT_GRADE", "UPDATE_GRADE", "DELETE_STUDENT_COURSE"))
    ops = ops.select("student_id", "course_id", "seq", "command", F.coalesce("score", F.lit(0)).cast("long").alias("score")).join(replay_students(commands).select("student_id", "since"), "student_id").where("seq > since")
    key = Window.partitionBy("student_id", "course_id").orderBy("seq")
    gone = F.col("command") == "DELETE_STUDENT_COURSE"
    at = ops.withColumn("life", F.sum(gone.cast("int")).over(key.rowsBetween(Window.unboundedPreceding, -1)))
    life = Window.partitionBy("student_id", "course_id", F.coalesce("life", F.lit(0)))
    at = at.withColumn("made", F.min(F.when(F.col("command") == "INSERT_GRADE", F.col("seq"))).over(life))
    live = at.where("seq = made or (command != 'INSERT_GRADE' and seq > made)")
    before = F.lag("score", 1, 0).over(life.orderBy("seq"))
    change = F.when(F.col("command") == "INSERT_GRADE", 1).when(gone, -1).otherwise(0)
    return live.select("student_id", "course_id", "seq", (F.when(gone, 0).otherwise(F.col("score")) - before).alias("score"), change.alias("change"))


def _as_of(changes: DataFrame, reads: DataFrame, key: str, *sums: str) -> DataFrame:
    """For each read (seq) and value of ``key`` the sums of all changes before it, where there are any. The values of the key
    are few: departments, or numbers of courses."""
    values = changes.agg(F.collect_set(key).alias("v")).scalar()
    asked = reads.select("seq", F.explode(values).alias(key), F.lit(True).alias("read"), *(F.lit(0).cast("long").alias(s) for s in sums))
    both = changes.select("seq", key, F.lit(False).alias("read"), *(F.col(s).cast("long").alias(s) for s in sums)).unionByName(asked)
    past = Window.partitionBy(key).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumns({s: F.coalesce(F.sum(s).over(past), F.lit(0)) for s in sums}).where("read").drop("read")


def score_answers(commands: DataFrame, courses: DataFrame) -> DataFrame:
    """seq and answer of each READ_SCORE: the departments' averages of the grades at its place in the log, or NULL."""
    reads = commands.where("command = 'READ_SCORE'").select("seq")
    changes = grade_changes(commands).join(courses.select("course_id", "department"), "course_id")
    now = _as_of(changes, reads, "department", "score", "change").where("change > 0").withColumn("average", F.col("score") / F.col("change"))
    return reads.join(scores_text(now, "seq"), "seq", "left").select("seq", F.coalesce("result", F.lit("NULL")).alias("result"))


def top_answers(commands: DataFrame) -> DataFrame:
    """seq and answer of each READ_ALL: the students with most courses at its place in the log, or NULL."""
    reads = commands.where("command = 'READ_ALL'").select("seq")
    student = Window.partitionBy("student_id").orderBy("seq")
    moves = grade_changes(commands).where("change != 0").groupBy("student_id", "seq").agg(F.sum("change").alias("change"))
    held = moves.withColumn("courses", F.sum("change").over(student)).withColumn("until", F.lead("seq").over(student)).select("student_id", "seq", "courses", "until")
    came = held.select("seq", "courses", F.lit(1).alias("n"))
    left = held.where("until is not null").select(F.col("until").alias("seq"), "courses", F.lit(-1).alias("n"))
    most = _as_of(came.union(left).where("courses > 0"), reads, "courses", "n").where("n > 0").groupBy("seq").agg(F.max("courses").alias("courses"))
    named = held.where(F.array_contains(most.agg(F.collect_set("courses").alias("v")).scalar(), F.col("courses"))).join(replay_students(commands).select("student_id", "name"), "student_id")
    bounds = F.broadcast(reads.agg(F.percentile_approx("seq", [k / PARTS for k in range(1, PARTS)]).alias("bounds")))  # one row

    def part(seq: Column) -> Column:
        return F.size(F.filter("bounds", lambda b: b < seq))

    last = F.when(F.col("until").isNull(), F.lit(PARTS - 1)).otherwise(part(F.col("until")))
    stays = named.crossJoin(bounds).select(F.explode(F.sequence(part(F.col("seq")), last)).alias("part"), "seq", F.lit(False).alias("read"), "courses", "student_id", F.concat_ws(",", "student_id", "name").alias("t"), "until")
    nobody = (F.lit(None).cast("string").alias("student_id"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("long").alias("until"))
    asked = reads.join(most, "seq", "left").crossJoin(bounds).select(part(F.col("seq")).alias("part"), "seq", F.lit(True).alias("read"), "courses", *nobody)
    return _lists(stays.unionByName(asked))


def _lists(rows: DataFrame) -> DataFrame:
    """seq and result of each read among rows (part, seq, read, courses, student_id, t, until): the texts of the students who have its number
    of courses then, by id, or NULL. Students are there after seq and up to until; they come in each part of the log in which they are.

    A read's list is made where it is answered, from that of the reads before it: what is shuffled are students' stays, not lists.
    """

    def answer(seq: list[int], result: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(result, pa.string())], ["seq", "result"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seqs, results, chars = None, [], [], 0
        there: dict[int, tuple[list, list, list]] = {}  # of each number of courses: ids, their texts, and who goes when
        for b in batches:
            for part, seq, read, courses, student, text, until in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "read", "courses", "student_id", "t", "until"))):
                if part != now:
                    now, there = part, {}
                ids, texts, ends = there.setdefault(courses, ([], [], []))
                if not read:
                    i = bisect_left(ids, student)
                    ids.insert(i, student)
                    texts.insert(i, text)
                    if until is not None:
                        heappush(ends, (until, student))
                    continue
                while ends and ends[0][0] < seq:
                    i = bisect_left(ids, heappop(ends)[1])
                    del ids[i], texts[i]
                seqs.append(seq)
                results.append(";".join(texts) if texts else "NULL")
                chars += len(results[-1])
                if chars > _CHARS or len(seqs) >= 10_000:
                    yield answer(seqs, results)
                    seqs, results, chars = [], [], 0
        if seqs:
            yield answer(seqs, results)

    ship(rows.sparkSession)
    # the number of tasks follows from the answers, not from the few rows that are shuffled
    return rows.repartition(PARTS, "part").sortWithinPartitions("part", "seq", F.desc("read")).mapInArrow(work, "seq long, result string")


def profiles(commands: DataFrame) -> DataFrame:
    """seq and answer of each READ_PROFILE: name,email of the student if inserted before, else NULL."""
    reads = commands.where("command = 'READ_PROFILE'").select("seq", "student_id")
    known = replay_students(commands)
    both = reads.join(known, "student_id", "left")
    there = F.col("since") < F.col("seq")
    return both.select("seq", F.when(there, F.concat_ws(",", "name", "email")).otherwise(F.lit("NULL")).alias("result"))


#: Arguments of each command; the place (from 1) of the one that is an integer, if any.
ARGUMENTS = {"INSERT_STUDENT": (4, 3), "INSERT_GRADE": (3, 3), "UPDATE_GRADE": (3, 3), "DELETE_STUDENT_COURSE": (2, 0), "READ_PROFILE": (1, 0), "READ_SCORE": (0, 0), "READ_ALL": (0, 0)}


def unknown_commands(commands: DataFrame) -> DataFrame:
    """seq and error text of commands that the store doesn't have."""
    return commands.where(~F.col("command").isin(*ARGUMENTS)).select("seq", F.concat(F.lit("ERROR: Unknown command "), "command").alias("result"))


def argument_errors(log: DataFrame) -> DataFrame:
    """seq and error text of the commands of a log (seq, command, args) that lack an argument or have one that is no integer. They
    do nothing else. Arguments are read in their order; empty ones at the end don't count."""
    present = F.expr("size(regexp_extract_all(regexp_replace(array_join(args, ','), ',+$', ''), ',', 0)) + if(regexp_replace(array_join(args, ','), ',+$', '') = '', 0, 1)")

    def error(total: int, number: int) -> Column:
        text = F.get("args", F.lit(max(number, 1) - 1))
        wrong = F.when(text.rlike(r"^[+-]?\d+$") & text.try_cast("int").isNotNull(), None).otherwise(F.concat(F.lit('For input string: "'), text, F.lit('"')))
        missing = F.when(present < total, F.concat(F.lit("Index "), (present + 1).cast("string"), F.lit(" out of bounds for length "), (present + 1).cast("string")))
        return F.when((present >= number) & wrong.isNotNull(), wrong).otherwise(missing) if number else missing

    found = F.lit(None).cast("string")
    for command, (total, number) in ARGUMENTS.items():
        found = F.when(F.col("command") == command, error(total, number)).otherwise(found)
    return log.withColumn("_e", found).where("_e is not null").select("seq", F.concat(F.lit("ERROR: "), "_e").alias("result"))


def command_answers(commands: DataFrame, courses: DataFrame) -> DataFrame:
    """seq and answer of every command that has one, as of its place in the log."""
    parts = [profiles(commands), score_answers(commands, courses), top_answers(commands), unknown_commands(commands)]
    return reduce(DataFrame.unionByName, parts)


def scores_text(averages: DataFrame, *keys: str) -> DataFrame:
    """All departments (of each key) in one row: dept:avg;dept:avg with one digit, by department."""
    cells = F.array_sort(F.collect_list(F.struct("department", F.format_string("%s:%.1f", "department", "average").alias("t"))))
    return averages.groupBy(*keys).agg(F.array_join(cells["t"], ";").alias("result"))


def students_text(most: DataFrame, *keys: str) -> DataFrame:
    """id,name;id,name by id (of each key)."""
    cells = F.array_sort(F.collect_list(F.struct("student_id", F.concat_ws(",", "student_id", "name").alias("t"))))
    return most.groupBy(*keys).agg(F.array_join(cells["t"], ";").alias("result"))
