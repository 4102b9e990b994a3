"""Line model: numbering, buckets, context, slices, merges, sections, predicates."""

from pyspark.sql import functions as F

from fleetlog import operators as ops
from fleetlog.catalog.base import EV, by_type, fmt, query, render
from fleetlog.docs import metadata
from fleetlog.extract import buckets as B
from fleetlog.extract import device
from fleetlog.functions import any_of, any_of_lower, clean, grab, log_millis, log_time, to_int
from fleetlog.sources import lines_from_texts, merge_lines, slice_lines

DOC_LINES = r"""
dl AS (
  SELECT CAST(doc_id AS VARCHAR) AS dump_id, i - 1 AS line_no, p[i] AS raw
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents), unnest(range(1, len(p) + 1)) u(i)
)"""


@query(
    "line_numbers",
    f"""WITH {DOC_LINES}
    SELECT dump_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(line_no) AS BIGINT) AS pos_sum,
           CAST(sum(CASE WHEN regexp_matches(raw, '[^ \\t\\r\\n\\x0b\\f]') THEN 1 ELSE 0 END) AS BIGINT) AS nonblank,
           CAST(sum(length(raw)) AS BIGINT) AS chars
    FROM dl GROUP BY dump_id""",
)
def line_numbers(t):
    """Ordered lines of whole texts."""
    lines = lines_from_texts(t.documents, "doc_id")
    return lines.groupBy("dump_id").agg(
        F.count("*").alias("lines"), F.sum("line_no").alias("pos_sum"), F.count_if(clean("raw") != "").alias("nonblank"),
        F.sum(F.length("raw")).cast("bigint").alias("chars"),
    )


BUCKET_LINES = dict(
    view="{ts_raw}  1  2 D BatteryService: level={k}",
    click="{ts_raw} radio  1  2 D RILJ    : [{k}]> SETUP_DATA_CALL [PHONE0]",
    purchase="{ts_raw}  1  2 E AndroidRuntime: FATAL EXCEPTION: main {k}",
    error="{ts_raw}  1  2 E ActivityManager: ANR in com.example.app{k}",
    signup="binder_sample: [a.b.C,12,{k},com.example.app,100]",
)


@query(
    "bucket_counts",
    f"""WITH {EV}, b AS (
      SELECT dump_id, line_no, k, unnest(CASE ty WHEN 'view' THEN ['battery','battery_thermal']
        WHEN 'click' THEN ['datacall','internet_stall','rilj'] WHEN 'purchase' THEN ['crash'] WHEN 'error' THEN ['anr']
        ELSE ['binder','binder_context'] END) AS bucket, ty FROM ev)
    SELECT dump_id, bucket, CAST(count(*) AS BIGINT) AS hits,
      CAST(count(DISTINCT CASE WHEN bucket IN ('binder','binder_context') THEN k ELSE line_no + 1000 END) AS BIGINT) AS texts
    FROM b GROUP BY ALL""",
)
def bucket_counts(t):
    """Bucket tags and distinct texts per bucket."""
    lines = render(t.ev(), by_type(**BUCKET_LINES))
    tags = B.tag_lines(lines).select("dump_id", "bucket", "line_no")
    hits = tags.groupBy("dump_id", "bucket").agg(F.count("*").alias("hits"))
    texts = B.distinct_texts(lines, tags).groupBy("dump_id", "bucket").agg(F.count("*").alias("texts"))
    return hits.join(texts, ["dump_id", "bucket"])


@query(
    "line_context",
    f"""WITH {EV}, m AS (
      SELECT DISTINCT l.dump_id, h.bucket, l.line_no FROM ev l JOIN (
        SELECT dump_id, line_no, 'crash' AS bucket, 80 AS r FROM ev WHERE ty='purchase' AND k < 30
        UNION ALL SELECT dump_id, line_no, 'datacall', 20 FROM ev WHERE ty='click' AND k < 50
        UNION ALL SELECT dump_id, line_no, 'datacall', 5 FROM ev WHERE ty='click' AND k >= 50
        UNION ALL SELECT dump_id, line_no, 'binder_context', 20 FROM ev WHERE ty='signup') h
      ON l.dump_id=h.dump_id AND abs(l.line_no-h.line_no) <= h.r
      WHERE h.bucket <> 'binder_context' OR l.ty IN ('click','error'))
    SELECT dump_id, bucket, CAST(count(*) AS BIGINT) AS lines, CAST(sum(line_no) AS BIGINT) AS line_sum FROM m GROUP BY ALL""",
)
def line_context(t):
    """Lines around hits, with a radius per hit and a word test on the lines around."""
    lines = render(t.ev(), by_type(**BUCKET_LINES)).withColumn("k", F.lit(0))
    k = grab("raw", r"(?:main |\[)(\d+)").try_cast("int")
    click, crash = F.col("raw").contains("SETUP_DATA_CALL"), F.col("raw").contains("FATAL EXCEPTION")
    rules = [
        ("crash", crash & (k < 30), 80), ("datacall", click & (k < 50), 20), ("datacall", click & (k >= 50), 5),
        ("binder_context", F.col("raw").contains("binder_sample"), 20),
    ]
    got = B.bucket_members(lines, rules, context_words=["RILJ", "ANR in"])
    return got.groupBy("dump_id", "bucket").agg(F.count("*").alias("lines"), F.sum("line_no").alias("line_sum"))


@query(
    "time_slice_carry",
    f"""WITH {EV}, s AS (
      SELECT *, CASE WHEN ty IN ('view','click') THEN left(ts_raw, 14) END AS t FROM ev),
    f AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seen FROM s),
    z AS (SELECT dump_id, min(line_no) AS stop FROM s WHERE t > '01-20 12:00:00' GROUP BY dump_id)
    SELECT f.dump_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(line_no) AS BIGINT) AS line_sum
    FROM f LEFT JOIN z USING (dump_id) WHERE seen BETWEEN '01-05 06:00:00' AND '01-20 12:00:00' AND (stop IS NULL OR line_no < stop)
    GROUP BY f.dump_id""",
)
def time_slice_carry(t):
    """Lines of a time range; lines without a time follow the line before."""
    raw = F.when(F.col("ty").isin("view", "click"), fmt("{ts_raw}  1  2 D tag: {k}")).otherwise(fmt("    at frame {k}"))
    got = slice_lines(render(t.ev(), raw), "01-05 06:00:00", "01-20 12:00:00")
    return got.groupBy("dump_id").agg(F.count("*").alias("lines"), F.sum("line_no").alias("line_sum"))


@query(
    "merge_sort",
    f"""WITH {EV}, s AS (
      SELECT *, CASE WHEN ty IN ('view','click','error') THEN 0 ELSE 1 END AS f,
        CASE WHEN ty IN ('view','signup') THEN ts_ms END AS key FROM ev),
    c AS (SELECT *, coalesce(last_value(key IGNORE NULLS) OVER (PARTITION BY dump_id, f ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS key_ms FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY key_ms, f, line_no) - 1 AS pos FROM c)
    SELECT dump_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(pos * (line_no % 1009)) AS BIGINT) AS order_sum,
      CAST(sum(CASE WHEN f = 1 THEN pos ELSE 0 END) AS BIGINT) AS second_file_sum FROM n GROUP BY dump_id""",
)
def merge_sort(t):
    """Two files of one dump merged by time; lines without a time keep their place."""
    raw = F.when(F.col("ty").isin("view", "signup"), fmt("{ts_raw}  1  2 D tag: {k}")).otherwise(fmt("    at frame {k}"))
    ev = t.ev()
    first = F.col("ty").isin("view", "click", "error")
    got = merge_lines([render(ev.where(first), raw), render(ev.where(~first), raw)])
    return got.groupBy("dump_id").agg(
        F.count("*").alias("lines"), F.sum(F.col("line_no") * (F.col("src_line_no") % 1009)).alias("order_sum"),
        F.sum(F.when(F.col("file_ord") == 1, F.col("line_no")).otherwise(0)).alias("second_file_sum"),
    )


@query(
    "section_interval",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty IN ('signup','error') THEN struct_pack(slot := CASE WHEN ty='signup' THEN k END, at := line_no) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS o FROM ev)
    SELECT dump_id, CAST(o.slot AS VARCHAR) AS slot, CAST(count(*) AS BIGINT) AS lines, CAST(sum(line_no) AS BIGINT) AS line_sum
    FROM s WHERE ty IN ('view','click') AND o.slot IS NOT NULL GROUP BY ALL""",
)
def section_interval(t):
    """The owner a marker sets for the lines below it, until another marker ends it."""
    lines = render(t.ev(), by_type(signup="NetId: {k}", error="---------", view="row {k}", click="row {k}"))
    marks = lines.where(any_of("raw", ["NetId:", "---------"])).select("dump_id", "line_no", grab("raw", r"NetId: (\d+)").alias("slot"))
    rows = lines.where(F.col("raw").startswith("row"))
    got = ops.carry_from(rows, marks, ["dump_id"], ["slot"]).where("slot is not null")
    return got.groupBy("dump_id", "slot").agg(F.count("*").alias("lines"), F.sum("line_no").alias("line_sum"))


@query(
    "block_first_n",
    f"""WITH {EV}, s AS (
      SELECT *, last_value(CASE WHEN ty='signup' THEN struct_pack(b := line_no) WHEN ty='error' THEN struct_pack(b := NULL) END IGNORE NULLS)
        OVER (PARTITION BY dump_id ORDER BY line_no ROWS UNBOUNDED PRECEDING).b AS block FROM ev),
    r AS (SELECT * FROM s WHERE block IS NOT NULL AND ty NOT IN ('signup','error') AND value >= 0.5),
    f AS (SELECT r.*, row_number() OVER (PARTITION BY dump_id ORDER BY value DESC, line_no) AS rk
          FROM r WHERE block = (SELECT min(block) FROM r q WHERE q.dump_id = r.dump_id))
    SELECT dump_id, line_no, 'proc' || CAST(k AS VARCHAR) AS process, value AS cpu_percent, CAST(rk AS BIGINT) AS rank FROM f WHERE rk <= 10""",
)
def block_first_n(t):
    """Top processes of the first CPU block that has rows."""
    lines = render(t.ev(), by_type(
        signup="CPU usage from 1ms to 2ms", error="TOTAL", view="{value}% {user_id}/proc{k}: 1% user", click="{value}% {user_id}/proc{k}: 1% user",
        purchase="{value}% {user_id}/proc{k}: 1% user",
    ))
    return device.cpu_usage(lines)


@query(
    "line_filters",
    f"""WITH {DOC_LINES}
    SELECT CAST(count(*) AS BIGINT) AS lines,
      CAST(sum(CASE WHEN contains(raw, 'the ') OR contains(raw, 'ing ') THEN 1 ELSE 0 END) AS BIGINT) AS any_word,
      CAST(sum(CASE WHEN contains(lower(raw), 'the ') OR contains(lower(raw), 'der') THEN 1 ELSE 0 END) AS BIGINT) AS any_word_lower,
      CAST(sum(CASE WHEN regexp_matches(raw, '[0-9]+') THEN 1 ELSE 0 END) AS BIGINT) AS with_number,
      CAST(sum(CAST(regexp_extract(raw, '([0-9]{{1,6}})', 1) AS VARCHAR) <> '' AND try_cast(regexp_extract(raw, '([0-9]{{1,6}})', 1) AS BIGINT) >= 1000) AS BIGINT) AS big_number
    FROM dl""",
)
def line_filters(t):
    """Substring predicates before a regex, and a threshold on an extracted number."""
    lines = lines_from_texts(t.documents, "doc_id")
    return lines.agg(
        F.count("*").alias("lines"), F.count_if(any_of("raw", ["the ", "ing "])).alias("any_word"),
        F.count_if(any_of_lower("raw", ["the ", "der"])).alias("any_word_lower"), F.count_if(F.col("raw").rlike("[0-9]+")).alias("with_number"),
        F.count_if(grab("raw", "([0-9]{1,6})").try_cast("bigint") >= 1000).alias("big_number"),
    )


@query(
    "time_shapes",
    f"""WITH {EV} SELECT dump_id, line_no, CASE ty WHEN 'purchase' THEN left(ts_raw, 14) || '.000' ELSE ts_raw END AS ts_raw,
      CASE ty WHEN 'purchase' THEN ts_ms - ts_ms % 1000 ELSE ts_ms END AS ts_ms FROM ev WHERE ty IN ('view','click','purchase')""",
)
def time_shapes(t):
    """Three shapes of log time give one normalised time."""
    iso = F.concat(F.lit("2024-"), F.substring("ts_raw", 1, 5), F.lit("T"), F.substring("ts_raw", 7, 12), F.lit(" - state"))
    split = F.concat(F.lit("("), F.substring("ts_raw", 1, 5), F.lit(") call ("), F.substring("ts_raw", 7, 8), F.lit(") end"))
    raw = F.when(F.col("ty") == "view", iso).when(F.col("ty") == "click", fmt("{ts_raw}  1  2 D tag: {k}")).when(F.col("ty") == "purchase", split)
    lines = render(t.ev(), raw).withColumn("ts_raw", log_time("raw"))
    return lines.select("dump_id", "line_no", "ts_raw", log_millis("ts_raw", F.col("year")).alias("ts_ms"))


@query(
    "typed_casts",
    f"""WITH {EV} SELECT dump_id, line_no,
      coalesce(try_cast(CASE ty WHEN 'error' THEN 'n/a' WHEN 'signup' THEN CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS BIGINT), -1) AS number,
      CASE WHEN ty='view' THEN NULL ELSE ty END AS label, CAST(CASE WHEN ty='view' THEN 1 ELSE 2 END AS BIGINT) AS filled
      FROM ev""",
)
def typed_casts(t):
    """Casts with a default, and dropping empty fields."""
    ev = t.ev().withColumn("txt", F.when(F.col("ty") == "error", "n/a").when(F.col("ty") == "signup", F.concat(F.lit(","), F.col("k").cast("string"))).otherwise(F.col("k").cast("string")))
    number = to_int("txt")
    fields = metadata({"type": F.when(F.col("ty") != "view", F.col("ty")), "k": F.col("txt")})
    return ev.select("dump_id", "line_no", number.alias("number"), fields["type"].alias("label"), F.size(fields).cast("bigint").alias("filled"))
