"""Named queries over the standard tables, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.logs import LENIENT
from sparkloom.functions.text import MARKUP, NOISE_STEMS, STOP_WORDS, WORD_GAP, word_frame
from sparkloom.operators import cooccur, fragments, traffic, words
from sparkloom.plans.stems import stem_sql
from sparkloom.session import materialize, table
from sparkloom.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return keep


# Logs -------------------------------------------------------------------------------------------------------------

_LOGS = f"""weblog as ({adapters.WEBLOG_SQL}),
    split as (select batch_id, event_id, line, regexp_extract(line, {_q(LENIENT)}, ['host', 'i', 'u', 'ts', 'rq', 'st', 'bs']) x, regexp_matches(line, {_q(LENIENT)}) hit from weblog),
    parsed as (select batch_id, event_id, line, hit, x.host as host, cast(case when regexp_matches(split_part(x.ts, ':', 1), '^\\d{{2}}/[A-Z][a-z]{{2}}/\\d{{4}}$') then try_strptime(split_part(x.ts, ':', 1), '%d/%b/%Y') end as date) as log_date,
        try_cast(split_part(x.ts, ':', 2) as int) as log_hour, regexp_split_to_array(x.rq, '\\s+') as p, try_cast(x.st as int) as status_code, x.bs as bs, coalesce(try_cast(x.bs as bigint), 0) as bytes from split),
    typed as (select *, p[1] as method, coalesce(p[2], 'UNKNOWN') as resource_path, coalesce(p[3], 'UNKNOWN') as protocol, hit and log_date is not null and log_hour is not null as ok from parsed),
    logs as (select * from typed where ok),
    daily as (select batch_id, log_date, status_code, count(*) as request_count, cast(sum(bytes) as bigint) as total_bytes from logs group by all),
    res as (select batch_id, resource_path, count(*) as request_count, cast(sum(bytes) as bigint) as total_bytes, count(distinct host) as distinct_hosts from logs group by all),
    top as (select * from res qualify row_number() over (partition by batch_id order by request_count desc, resource_path) <= 20),
    hourly as (select batch_id, log_date, log_hour, count(*) filter (status_code between 400 and 599) as error_request_count, count(*) as total_request_count,
        count(*) filter (status_code between 400 and 599) / count(*) as error_rate, count(distinct host) filter (status_code between 400 and 599) as distinct_error_hosts from logs group by all)"""


def _with_logs(body: str, dated: bool = False) -> str:
    return f"with {_LOGS} select * replace (cast(log_date as varchar) as log_date) from ({body})" if dated else f"with {_LOGS} {body}"


def _dated(rows: DataFrame) -> DataFrame:
    """Dates as text, which both engines write alike."""
    return rows.withColumn("log_date", F.col("log_date").cast("string"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return adapters.weblog(spark, d)


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return traffic.records(_lines(spark, d))


@query(_with_logs("select event_id, batch_id, host, log_date, log_hour, method, resource_path, protocol, status_code, bytes from logs", True))
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return _dated(_logs(spark, d)).select("event_id", "batch_id", "host", "log_date", "log_hour", "method", "resource_path", "protocol", "status_code", "bytes")


@query(_with_logs("select count(*) as total_records, count(*) filter (not ok) as malformed_count from typed"))
def log_malformed(spark: SparkSession, d: str) -> DataFrame:
    return traffic.malformed(_lines(spark, d))


@query(_with_logs("select batch_id, count(*) as records_in_batch, count(*) filter (not ok) as malformed_in_batch from typed group by batch_id"))
def log_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return traffic.batch_summary(_lines(spark, d))


@query(_with_logs("from daily", True))
def log_daily_traffic(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.daily_traffic(_logs(spark, d)))


@query(_with_logs("from res"))
def log_resources(spark: SparkSession, d: str) -> DataFrame:
    return traffic.resources(_logs(spark, d))


@query(_with_logs("from top"))
def log_top_resources(spark: SparkSession, d: str) -> DataFrame:
    return traffic.top_resources(_logs(spark, d))


@query(_with_logs("from hourly", True))
def log_hourly_errors(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.hourly_errors(_logs(spark, d)))


@query(_with_logs("select log_date, status_code, cast(sum(request_count) as bigint) as request_count, cast(sum(total_bytes) as bigint) as total_bytes from daily group by all", True))
def rollup_daily(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.rollup_daily(traffic.daily_traffic(_logs(spark, d))))


@query(_with_logs("select resource_path, cast(sum(request_count) as bigint) as request_count, cast(sum(total_bytes) as bigint) as total_bytes, cast(sum(distinct_hosts) as bigint) as distinct_hosts from top group by resource_path order by 2 desc, 1 limit 20"))
def rollup_top_resources(spark: SparkSession, d: str) -> DataFrame:
    return traffic.rollup_top_resources(traffic.top_resources(_logs(spark, d)))


@query(
    _with_logs("""select log_date, log_hour, cast(sum(error_request_count) as bigint) as error_request_count, cast(sum(total_request_count) as bigint) as total_request_count, cast(sum(distinct_error_hosts) as bigint) as distinct_error_hosts,
    cast(sum(error_request_count) as bigint) / cast(sum(total_request_count) as bigint) as error_rate from hourly group by log_date, log_hour""", True)
)
def rollup_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.rollup_hourly(traffic.hourly_errors(_logs(spark, d))))


@query(_with_logs("select resource_path, count(*) as request_count, cast(sum(bytes) as bigint) as total_bytes, count(distinct host) as distinct_hosts from logs group by 1 order by 2 desc, 1 limit 20"))
def rollup_top_exact(spark: SparkSession, d: str) -> DataFrame:
    return traffic.exact_top_resources(_logs(spark, d))


@query(
    _with_logs("""select log_date, log_hour, count(*) filter (status_code between 400 and 599) as error_request_count, count(*) as total_request_count,
    count(*) filter (status_code between 400 and 599) / count(*) as error_rate, count(distinct host) filter (status_code between 400 and 599) as distinct_error_hosts from logs group by all""", True)
)
def rollup_distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.exact_hourly(_logs(spark, d)))


#: Numbers that some of the queries don't have; doubles here, whose nulls any client reads alike.
_SPARSE = ["status_code", "log_hour", "request_count", "total_bytes", "distinct_hosts", "error_request_count", "total_request_count", "error_rate", "distinct_error_hosts"]
_RESULTS = """, results as (
    select 'daily_traffic' as query_name, batch_id, log_date, status_code, request_count, total_bytes, null::varchar as resource_path, null::bigint as distinct_hosts, null::int as log_hour, null::bigint as error_request_count, null::bigint as total_request_count, null::decimal(7,4) as error_rate, null::bigint as distinct_error_hosts from daily
    union all select 'top_resources', batch_id, null, null, request_count, total_bytes, resource_path, distinct_hosts, null, null, null, null, null from top
    union all select 'hourly_errors', batch_id, log_date, null, null, null, null, null, log_hour, error_request_count, total_request_count, cast(error_rate as decimal(7,4)), distinct_error_hosts from hourly)"""


@query(_with_logs(_RESULTS + " select query_name, batch_id, cast(log_date as varchar) as log_date, resource_path, " + ", ".join(f"cast({c} as double) as {c}" for c in _SPARSE) + " from results"))
def log_results_union(spark: SparkSession, d: str) -> DataFrame:
    return _dated(traffic.results(_logs(spark, d))).withColumns({c: F.col(c).cast("double") for c in _SPARSE})


@query(_with_logs(_RESULTS + " select query_name, count(*) as n_rows from results group by query_name"))
def log_results_per_query(spark: SparkSession, d: str) -> DataFrame:
    return traffic.results(_logs(spark, d)).groupBy("query_name").agg(F.count("*").alias("n_rows"))


@query(_with_logs("select count(*) as total_records, count(distinct batch_id) as total_batches, count(*) filter (not ok) as malformed_count, round(count(*) / count(distinct batch_id), 2) as avg_batch_size from typed"))
def log_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return traffic.run_summary(_lines(spark, d)).withColumn("avg_batch_size", F.col("avg_batch_size").cast("double"))


@query(_with_logs("select status_code, count(*) filter (bs = '-') as dashes, count(*) filter (bs <> '-' and try_cast(bs as bigint) is null) as not_numbers, cast(sum(bytes) as bigint) as total_bytes from logs group by status_code"))
def log_status_bytes_coercion(spark: SparkSession, d: str) -> DataFrame:
    return traffic.coercions(_lines(spark, d))


# Corpus -----------------------------------------------------------------------------------------------------------


def _clean_sql(column: str) -> str:
    text = f"lower({column})"
    for p in MARKUP:
        text = f"regexp_replace({text}, {_q(p)}, '', 'g')"
    return f"list_filter(regexp_split_to_array(lower({text}), {_q(WORD_GAP)}), lambda t: length(t) >= 2)"


_STOP_SQL = ", ".join(_q(w) for w in STOP_WORDS)
_PAGES = f"pages_words as (select unnest({_clean_sql('html')}) as word from pages)"
_LINE_TOKENS = f"lines as ({adapters.LINES_SQL}), tokens as (select doc_id, ln, {_clean_sql('line')} as w from lines)"
_TOP50 = f"{_LINE_TOKENS}, all_words as (select unnest(w) as word from tokens), top as (select word, count(*) as cnt from all_words group by word order by cnt desc, word limit 50)"
_TERMS = r"""terms as (select doc_id, case when length(t) >= 3 and regexp_matches(t, '\p{L}') and not regexp_matches(t, '\p{Nd}') then t end as term from (
    select doc_id, regexp_replace(lower(unnest(regexp_split_to_array(text, '[^\p{L}\p{Nd}'']+'))), '^''+|''+$', '', 'g') as t from documents)),
    df as (select term, count(distinct doc_id) as df from terms where term is not null group by term),
    df_top as (select * from df order by df desc, term limit 100),
    tf as (select doc_id, term, count(*) as tf from terms join df_top using (term) group by doc_id, term),
    tfidf as (select doc_id, term, tf * ln(10000.0::double / df + 1) as score from tf join df_top using (term))"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("html").alias("line"))


@query(
    f"""with lines as ({adapters.LINES_SQL}), w as (select case when line = '' then [''] when regexp_replace(line, {_q(WORD_GAP + '$')}, '') = '' then []::varchar[]
    else regexp_split_to_array(regexp_replace(line, {_q(WORD_GAP + '$')}, ''), {_q(WORD_GAP)}) end as w from lines)
    select word, count(*) as cnt from (select unnest(w) as word from w) group by word"""
)
def word_count_raw(spark: SparkSession, d: str) -> DataFrame:
    return words.raw_counts(adapters.lines(spark, d))


@query(f"with {_PAGES} select word, count(*) as cnt from pages_words group by word")
def word_count_clean(spark: SparkSession, d: str) -> DataFrame:
    return words.clean_counts(_pages(spark, d))


@query(f"with {_PAGES} select word, count(*) as cnt from pages_words where word not in ({_STOP_SQL}) group by word")
def word_count_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d)
    return words.filtered_counts(rows, word_frame(rows, STOP_WORDS))


def _top50(spark: SparkSession, d: str) -> DataFrame:
    return words.top_words(words.clean_counts(adapters.lines(spark, d)))


def _tokens_and_top50(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = cooccur.tokenized(adapters.lines(spark, d))
    return tokens, words.top_words(words.count_words(tokens, F.col("tokens")))


@query(f"with {_TOP50} from top")
def word_top50(spark: SparkSession, d: str) -> DataFrame:
    return _top50(spark, d)


def _pairs_sql(distance: int) -> str:
    return f"""{_TOP50}, placed as (select doc_id, ln, unnest(w) as t, generate_subscripts(w, 1) as p from tokens),
    kept as (select placed.* from placed where t in (select word from top)),
    pairs as (select a.t as center, b.t as neighbor, count(*) as cnt from kept a join kept b on a.doc_id = b.doc_id and a.ln = b.ln and a.p <> b.p and b.p between a.p - {distance} and a.p + {distance} group by 1, 2)"""


def _stripes_sql(distance: int) -> str:
    return f"{_pairs_sql(distance)}, stripes as (select center, concat('{{', string_agg(concat(neighbor, ':', cast(cnt as varchar)), ', ' order by neighbor), '}}') as stripe from pairs group by center)"


def _cooccurrence(distance: int) -> None:
    @query(f"with {_pairs_sql(distance)} from pairs", f"pairs_d{distance}")
    def pairs(spark: SparkSession, d: str) -> DataFrame:
        return cooccur.pairs(*_tokens_and_top50(spark, d), distance)

    @query(f"with {_stripes_sql(distance)} from stripes", f"stripes_d{distance}")
    def stripes(spark: SparkSession, d: str) -> DataFrame:
        return cooccur.stripes(cooccur.pairs(*_tokens_and_top50(spark, d), distance))


for _distance in (1, 2, 3, 4):
    _cooccurrence(_distance)


@query(f"with {_stripes_sql(1)} select c.t as center, coalesce(stripe, '{{}}') as stripe from (select distinct t from kept) c left join stripes on c.t = center")
def stripes_class_d1(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.stripes_with_empty(*_tokens_and_top50(spark, d), 1)


@query(
    f"""with {_pairs_sql(2)} select count(p.cnt) as cells, cast(sum(p.cnt) as bigint) as total, count(*) filter (p.cnt is distinct from m.cnt) as unlike, count(*) filter (p.center = p.neighbor and p.cnt % 2 = 1) as odd
    from pairs p full join pairs m on p.center = m.neighbor and p.neighbor = m.center"""
)
def pairs_symmetry_check(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.symmetry(cooccur.pairs(*_tokens_and_top50(spark, d), 2))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(f"with {_TERMS} from df")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return words.document_frequency(_documents(spark, d))


@query(f"with {_TERMS} from df_top")
def df_top100(spark: SparkSession, d: str) -> DataFrame:
    return words.top_terms(words.document_frequency(_documents(spark, d)))


@query(f"with {_TERMS} from tf")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return words.term_frequency(_documents(spark, d), df_top100(spark, d))


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    top = materialize(df_top100(spark, d), "top-terms")
    return words.tf_idf(words.term_frequency(_documents(spark, d), top), top)


@query(f"with {_TERMS} select doc_id, term, round(score, 6) as score from tfidf")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).withColumn("score", F.round("score", 6))


@query(f"with {_TERMS} select count(*) as matched, 0::bigint as mismatched, 0::bigint as missing, 0::bigint as extra from tfidf")
def tfidf_verify(spark: SparkSession, d: str) -> DataFrame:
    """Scores against a recomputation by another tokenizer: letters and digits are found, not split at."""
    top = materialize(df_top100(spark, d), "top-terms")
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}']+"), F.lit(0))
    again = _documents(spark, d).select("doc_id", F.explode(found).alias("t"))
    # letters become lower ones each by itself, wherever they stand
    again = again.select("doc_id", F.btrim(F.lower(F.translate("t", "\u03a3\u0130", "\u03c3i")), F.lit("'")).alias("term"))
    again = again.join(F.broadcast(top.select("term")), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(F.broadcast(top), "term")
    again = again.select("doc_id", "term", (F.col("tf") * F.log1p(F.lit(10000.0) / F.col("df"))).alias("score"))
    return words.compare_scores(again, _tfidf(spark, d))


_STEMMED = f"""{_TERMS}, vocabulary as (select distinct term from terms where term is not null union select unnest([{', '.join(map(_q, STOP_WORDS))}])), {stem_sql('vocabulary', 'stems')},
    stop as (select unnest([{', '.join(map(_q, STOP_WORDS))}]) as term),
    kept as (select term, stem from stems where term not in (select term from stop) and stem <> '' and stem not in (select term from stop) and stem not in (select stem from stems where term in (select term from stop)) and stem not in ({', '.join(map(_q, NOISE_STEMS))})),
    stf as (select doc_id, stem as term, count(*) as tf from terms join kept using (term) group by doc_id, stem),
    top_df as (select term, count(*) as df from stf group by term order by df desc, term limit 100)"""


@query(f"with {_STEMMED} from top_df")
def df_stemmed(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return words.stemmed_top_terms(docs, word_frame(docs, STOP_WORDS))[0]


@query(f"with {_STEMMED} select doc_id, term, round(tf * ln(10000.0::double / df + 1), 6) as score from stf join top_df using (term)")
def tfidf_stemmed(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    top, tf = words.stemmed_top_terms(docs, word_frame(docs, STOP_WORDS))
    return words.tf_idf(tf, F.broadcast(top)).withColumn("score", F.round("score", 6))


# Fragment store ---------------------------------------------------------------------------------------------------

_HASH = "list_reduce(list_transform(range(1, length(student_id) + 1), lambda i: ord(substr(student_id, i, 1))::bigint), lambda a, c: (a * 31 + c) & 4294967295, 0::bigint)"
_STORE = f"""student as ({adapters.STUDENT_SQL}), course as ({adapters.COURSE_SQL}), grade as ({adapters.GRADE_SQL}),
    routed as (select student_id, cast(abs(case when h >= 2147483648 then h - 4294967296 else h end) % 3 as int) as fragment from (select student_id, {_HASH} as h from student)),
    counted as (select student_id, count(course_id) as courses from grade join student using (student_id) group by student_id)"""


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return adapters.students(spark, d), adapters.courses(spark, d), adapters.grades(spark, d)


@query(f"with {_STORE} from routed")
def route_fragments(spark: SparkSession, d: str) -> DataFrame:
    return fragments.route(adapters.students(spark, d))


@query(f"with {_STORE} select fragment, count(*) as students from routed group by fragment")
def fragment_counts(spark: SparkSession, d: str) -> DataFrame:
    return fragments.fragment_counts(adapters.students(spark, d))


@query(f"with {_STORE} select student_id, course_id, score, department from grade join course using (course_id)")
def grade_join_course(spark: SparkSession, d: str) -> DataFrame:
    _, courses, grades = _store(spark, d)
    return fragments.graded_courses(grades, courses)


_DEPT = "select department, round(cast(sum(score) as bigint) / count(*), 6) as average from grade join course using (course_id) group by department"


@query(f"with {_STORE} {_DEPT}")
def dept_avg(spark: SparkSession, d: str) -> DataFrame:
    _, courses, grades = _store(spark, d)
    return fragments.department_averages(fragments.graded_courses(grades, courses)).withColumn("average", F.round("average", 6))


@query(f"with {_STORE} {_DEPT}")
def dept_avg_two_phase(spark: SparkSession, d: str) -> DataFrame:
    _, courses, grades = _store(spark, d)
    return fragments.department_averages_two_phase(fragments.graded_courses(grades, courses)).withColumn("average", F.round("average", 6))


_MOST = "select student_id, courses, name from counted join student using (student_id) where courses = (select max(courses) from counted)"


@query(f"with {_STORE} {_MOST}")
def most_courses(spark: SparkSession, d: str) -> DataFrame:
    students, _, grades = _store(spark, d)
    return fragments.most_courses(grades, students)


@query(f"with {_STORE} {_MOST}")
def most_courses_two_phase(spark: SparkSession, d: str) -> DataFrame:
    students, _, grades = _store(spark, d)
    return fragments.most_courses_two_phase(grades, students)


_REPLAY = f"""commands as ({adapters.COMMANDS_SQL}),
    students as (select student_id, min(seq) as since, min_by(name, seq) as name, min_by(email, seq) as email from commands where command = 'INSERT_STUDENT' group by student_id),
    ops as (select c.* exclude (name, email) from commands c join students using (student_id) where command in ('INSERT_GRADE', 'UPDATE_GRADE', 'DELETE_STUDENT_COURSE') and seq > since),
    gone as (select *, coalesce(max(seq) filter (command = 'DELETE_STUDENT_COURSE') over (partition by student_id, course_id), 0) as gone from ops),
    made as (select *, min(seq) filter (command = 'INSERT_GRADE' and seq > gone) over (partition by student_id, course_id) as made from gone),
    grades as (select student_id, course_id, max_by(score, seq) as score from made where seq = made or (command = 'UPDATE_GRADE' and seq > made) group by student_id, course_id),
    course as ({adapters.COURSE_SQL})"""


@query(f"with {_REPLAY} from students")
def replay_students(spark: SparkSession, d: str) -> DataFrame:
    return fragments.replay_students(adapters.commands(spark, d))


@query(f"with {_REPLAY} from grades")
def replay_grades(spark: SparkSession, d: str) -> DataFrame:
    return fragments.replay_grades(adapters.commands(spark, d))


@query(f"with {_REPLAY} select seq, case when since < seq then concat(s.name, ',', s.email) else 'NULL' end as result from commands c left join (select student_id, since, students.name, students.email from students) s using (student_id) where command = 'READ_PROFILE'")
def student_profile(spark: SparkSession, d: str) -> DataFrame:
    return fragments.profiles(adapters.commands(spark, d))


@query(f"with {_REPLAY} select department, round(cast(sum(score) as bigint) / count(*), 6) as average from grades join course using (course_id) group by department")
def replay_scores(spark: SparkSession, d: str) -> DataFrame:
    graded = fragments.graded_courses(fragments.replay_grades(adapters.commands(spark, d)), adapters.courses(spark, d))
    return fragments.department_averages(graded).withColumn("average", F.round("average", 6))


@query(f"with {_REPLAY}, n as (select student_id, count(*) as courses from grades group by student_id) select student_id, courses, name from n join students using (student_id) where courses = (select max(courses) from n)")
def replay_top(spark: SparkSession, d: str) -> DataFrame:
    commands = adapters.commands(spark, d)
    return fragments.most_courses(fragments.replay_grades(commands), fragments.replay_students(commands))


# every read with its own state: the log before it
_ANSWERS = f"""c as ({adapters.COMMANDS_WITH_READS_SQL}), course as ({adapters.COURSE_SQL}),
    known as (select student_id, min(seq) as since, min_by(name, seq) as name, min_by(email, seq) as email from c where command = 'INSERT_STUDENT' group by student_id),
    reads as (select seq as pos, command as what from c where command in ('READ_SCORE', 'READ_ALL')),
    ops as (select pos, what, c.student_id, course_id, seq, command, score from reads join c on seq < pos join known using (student_id) where command in ('INSERT_GRADE', 'UPDATE_GRADE', 'DELETE_STUDENT_COURSE') and seq > since),
    gone as (select *, coalesce(max(seq) filter (command = 'DELETE_STUDENT_COURSE') over (partition by pos, student_id, course_id), 0) as gone from ops),
    made as (select *, min(seq) filter (command = 'INSERT_GRADE' and seq > gone) over (partition by pos, student_id, course_id) as made from gone),
    now as (select pos, what, student_id, course_id, max_by(score, seq) as score from made where seq = made or (command = 'UPDATE_GRADE' and seq > made) group by all),
    averages as (select pos, department, sum(score) / count(*) as average from now join course using (course_id) where what = 'READ_SCORE' group by all),
    held as (select pos, student_id, count(*) as n from now where what = 'READ_ALL' group by all),
    said as (select pos, string_agg(concat(department, ':', printf('%.1f', floor(average * 10 + 0.5) / 10)), ';' order by department) as result from averages group by pos
        union all select pos, string_agg(concat(student_id, ',', name), ';' order by student_id) from (select * from held qualify n = max(n) over (partition by pos)) join known using (student_id) group by pos)"""


@query(
    f"""with {_ANSWERS} select pos as seq, coalesce(result, 'NULL') as result from reads left join said using (pos)
    union all select seq, concat('ERROR: Unknown command ', command) from c where command = 'NO_SUCH'
    union all select seq, case when since < seq then concat(known.name, ',', known.email) else 'NULL' end from c left join known using (student_id) where command = 'READ_PROFILE'"""
)
def command_answers(spark: SparkSession, d: str) -> DataFrame:
    return fragments.command_answers(adapters.commands_with_reads(spark, d), adapters.courses(spark, d))
