"""Log lines, documents, students and commands made from the standard test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import table
from sparkloom.sources.text import with_batches

BATCH_SIZE = 2500

_LINE = """
case when event_id % 101 = 0 then 'corrupt record'
 else concat('host', cast(user_id % 50 as {text}), ' - - [', {stamp}, ' -0400] "',
  case when event_id % 37 = 5 then 'GET'
       when event_id % 37 = 6 then concat('GET /q"', event_type, '" HTTP/1.0')
       else concat('GET /', event_type, '/', cast(event_id % 37 as {text}), ' HTTP/1.0') end,
  '" ', case event_id % 5 when 0 then '200' when 1 then '302' when 2 then '304' when 3 then '404' else '500' end, ' ',
  case when event_id % 11 = 0 then '-' when event_id % 97 = 1 then 'n/a' else cast(event_id * 7 as {text}) end) end"""


def weblog(spark: SparkSession, sf_dir: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """batch_id, event_id, line: an access-log line for each event."""
    line = F.expr(_LINE.format(text="string", stamp="date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')"))
    # numbers go to the events, which are dealt out by ranges; so their lines aren't made for the ranges' samples too
    numbered = with_batches(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id", size=batch_size)
    return numbered.select("batch_id", "event_id", line.alias("line"))


WEBLOG_SQL = f"""select cast((row_number() over (order by event_id) - 1) // {BATCH_SIZE} as int) + 1 as batch_id, event_id,
{_LINE.format(text="varchar", stamp="strftime(ts, '%d/%b/%Y:%H:%M:%S')")} as line from events"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ln, line: the lines of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


LINES_SQL = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents"


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("student_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("age"), F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"))


STUDENT_SQL = "select concat('S', cast(c_custkey as varchar)) as student_id, c_name as name, cast(c_nationkey as int) as age, concat(lower(c_mktsegment), '@example.org') as email from customer"


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("course_id"), F.col("p_name").alias("course_name"), F.col("p_brand").alias("department"))


COURSE_SQL = "select p_partkey as course_id, p_name as course_name, p_brand as department from part"


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grade a student and course: that of the first order line."""
    both = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    first = both.groupBy("o_custkey", "l_partkey").agg(F.min_by("l_quantity", order).alias("q"))
    return first.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("student_id"), F.col("l_partkey").alias("course_id"), F.col("q").cast("int").alias("score"))


GRADE_SQL = """select student_id, course_id, score from (
    select concat('S', cast(o_custkey as varchar)) as student_id, l_partkey as course_id, cast(l_quantity as int) as score,
        row_number() over (partition by o_custkey, l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) rn
    from orders join lineitem on o_orderkey = l_orderkey) x where rn = 1"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, command, student_id, course_id, score, name, email: an ordered command log from the events."""
    kind = "case event_type when 'signup' then 'INSERT_STUDENT' when 'purchase' then 'INSERT_GRADE' when 'view' then 'UPDATE_GRADE' when 'error' then 'DELETE_STUDENT_COURSE' else 'READ_PROFILE' end"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 as seq", f"{kind} as command", "concat('U', cast(user_id as string)) as student_id", "event_id % 5 as course_id", "cast(floor(value) as int) as score",
        "concat('name', cast(user_id as string), '-', cast(event_id as string)) as name", "concat('u', cast(user_id as string), '@example.org') as email",
    )


COMMANDS_SQL = """select event_id + 1 as seq,
    case event_type when 'signup' then 'INSERT_STUDENT' when 'purchase' then 'INSERT_GRADE' when 'view' then 'UPDATE_GRADE' when 'error' then 'DELETE_STUDENT_COURSE' else 'READ_PROFILE' end as command,
    concat('U', cast(user_id as varchar)) as student_id, event_id % 5 as course_id, cast(floor(value) as int) as score,
    concat('name', cast(user_id as varchar), '-', cast(event_id as varchar)) as name, concat('u', cast(user_id as varchar), '@example.org') as email from events"""


_READS = "case when event_id % 60 = 7 then 'READ_SCORE' when event_id % 60 = 37 then 'READ_ALL' when event_id % 97 = 5 then 'NO_SUCH' else command end"


def commands_with_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`commands`, some of them reads of all departments or students, or none that exists."""
    return commands(spark, sf_dir).withColumn("event_id", F.col("seq") - 1).withColumn("command", F.expr(_READS)).drop("event_id")


COMMANDS_WITH_READS_SQL = f"select seq, {_READS.replace('event_id', '(seq - 1)')} as command, student_id, course_id, score, name, email from ({COMMANDS_SQL})"
