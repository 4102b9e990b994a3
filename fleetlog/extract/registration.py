"""Network registration changes (out of service, recovery)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlog import codes as C
from fleetlog.functions import any_of, any_of_lower, clean, grab, log_millis
from fleetlog.functions.timeutil import STAMP
from fleetlog.operators import carry_from, change_points, numbered, running_total, window_totals
from fleetlog.session import SPAN_LINES, span, stage

TAG = r"(?i)[VDIWE]\s+([a-zA-Z0-9_\-]+)\s*(?=:)"
CONTEXT_LINES = 20
#: retained lines kept with a change
CONTEXT_ROWS = 15


def radio_marks(lines: DataFrame) -> DataFrame:
    opens = any_of("raw", ["logcat -b radio", "--------- beginning of radio"])
    closes = any_of("raw", ["was the duration of 'RADIO LOG'", "--------- beginning of main", "--------- beginning of system"])
    return lines.where(opens | closes).select("dump_id", "line_no", F.when(opens, F.lit(True)).alias("in_radio"))


def _field(body: Column, name: str) -> Column:
    value = F.regexp_replace(grab(body, rf"(?i){name}\s*=\s*([^,\s]+)"), r"\)+$", "")
    return F.when(value.contains("("), F.concat(value, F.lit(")"))).otherwise(value)


def radio_rows(lines: DataFrame) -> DataFrame:
    """Radio-section rows of telephony tags, with their position ``seq`` among them."""
    tagged = lines.where(any_of("raw", C.RADIO_TAGS)).withColumn("tag", grab("raw", TAG)).where(F.col("tag").isin(C.RADIO_TAGS))
    rows = carry_from(tagged.select("dump_id", "line_no", "year", clean("raw").alias("t"), "tag"), radio_marks(lines), ["dump_id"], ["in_radio"])
    rows = rows.where("in_radio").where(~any_of("t", C.REASON_EXCLUDED_TAGS))
    return stage(numbered(stage(rows), ["dump_id"], ["line_no"]))


def service_states(lines: DataFrame) -> DataFrame:
    """Every service-state poll with its fields and the hints among the 20 rows before it."""
    rows = radio_rows(lines)
    t = F.col("t")
    polls = rows.where(F.lower("t").contains("poll servicestate done") & t.contains("newSS={"))
    hints = rows.where(any_of_lower("t", ["rrc connection release", "out_of_service", "no_service"]))
    low = F.lower("t")
    # the window of a poll is the 20 positions before it
    near = window_totals(
        polls.select("dump_id", "line_no", (F.col("seq") - 1).alias("seq")), hints, ["dump_id"], ident=["line_no"], at="seq",
        before=CONTEXT_LINES - 1, after=0,
        measures={
            "rrc": low.contains("rrc connection release").cast("int"),
            "lost": (low.contains("out_of_service") | low.contains("no_service")).cast("int"),
        },
        span=span(lines.sparkSession, SPAN_LINES),
    )
    body = F.regexp_replace(F.regexp_replace(t, r"(?s)^.*?newSS=\{", ""), r"(?s)\}[^}]*$", "")
    fields = polls.withColumn("body", body)
    b = F.col("body")
    ts = grab(t, STAMP)
    slot = F.when(F.col("tag").isin("RILD2", "SST-1") | t.contains("PHONE1"), "1").otherwise("0")
    out = fields.select(
        "dump_id", "line_no", ts.alias("ts_raw"), log_millis(ts, F.col("year")).alias("ts_ms"), slot.alias("slot"),
        _field(b, "m?VoiceRegState").alias("voice_reg"), _field(b, "mDataRegState").alias("data_reg"),
        _field(b, "m?RadioTechnology").alias("rat"), _field(b, "m?OperatorAlphaLong").alias("operator_long"),
        _field(b, "m?OperatorAlphaShort").alias("operator_short"), _field(b, "m?RejectCause").alias("reject_cause"),
        _field(b, "m?IsEmergencyOnly").alias("is_emergency"),
    )
    return stage(out.join(near, ["dump_id", "line_no"], "left"))


def registration_events(states: DataFrame) -> DataFrame:
    """Polls where the voice or data state differs from the poll before of the slot."""
    rows = states.withColumn("v", F.substring("voice_reg", 1, 1)).withColumn("d", F.substring("data_reg", 1, 1))
    changes = stage(change_points(rows, ["dump_id", "slot"], ["line_no"], ["v", "d"]))
    was_in = F.coalesce((F.col("prev_v") == "0") & (F.col("prev_d") == "0"), F.lit(False))
    now_in = F.coalesce((F.col("v") == "0") & (F.col("d") == "0"), F.lit(False))
    kind = F.when(~was_in & now_in, "RECOVER").when(was_in & ~now_in, "ENTER").otherwise("CHANGE")
    reason = (
        F.when((F.col("v") == "0") | (F.col("d") == "0"), "None")
        .when(F.col("reject_cause") != "0", F.concat(F.lit("NW_REJECT_CAUSE_"), "reject_cause"))
        .when(F.col("rrc") > 0, "RRC_RELEASE_BY_NW")
        .when(F.col("lost") > 0, "SIGNAL_LOSS_OR_SHADOW_AREA")
        .otherwise("Unknown")
    )
    return changes.withColumn("event_type", kind).withColumn("reason", reason).drop("v", "d", "prev_v", "prev_d", "rrc", "lost")


def change_context(changes: DataFrame, retained: DataFrame, n: int = CONTEXT_ROWS) -> DataFrame:
    """The last n retained lines before each change: dump_id, slot, line_no (of the change), back (1 is the nearest), context_line, raw.

    Retained lines are numbered once per dump; a change then looks up n positions, so no range is joined.
    """
    lines = stage(retained.select("dump_id", "line_no", "raw"))
    both = lines.select("dump_id", "line_no", F.lit(1).alias("own"), "raw").unionByName(
        changes.select("dump_id", "line_no").distinct().withColumn("own", F.lit(0)).withColumn("raw", F.lit(None).cast("string"))
    )
    # a change's own line, retained or not, comes after it in this count
    placed = stage(running_total(both, ["dump_id"], ["line_no", "own"], {"pos": F.col("own")}))
    at = placed.where("own = 0").select("dump_id", "line_no", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("back"), "pos")
    at = at.select("dump_id", "line_no", "back", (F.col("pos") + 1 - F.col("back")).alias("pos")).where("pos > 0")
    found = placed.where("own = 1").select("dump_id", "pos", F.col("line_no").alias("context_line"), "raw")
    return changes.select("dump_id", "slot", "line_no").join(at.join(found, ["dump_id", "pos"]).drop("pos"), ["dump_id", "line_no"])


def is_out_of_service() -> Column:
    v, d = F.coalesce("voice_reg", F.lit("")), F.coalesce("data_reg", F.lit(""))
    return (v == "1") | (d == "1") | v.contains("OUT_OF_SERVICE") | d.contains("OUT_OF_SERVICE")


def state_timeline(events: DataFrame) -> DataFrame:
    """Voice and data state changes per slot, as one long table."""
    names = F.create_map(*[F.lit(x) for kv in C.REG_STATES.items() for x in kv])
    long = events.select(
        "dump_id", "slot", "line_no", "ts_ms",
        F.inline(F.array(
            F.struct(F.lit("Voice").alias("type"), F.col("voice_reg").alias("reg")),
            F.struct(F.lit("Data").alias("type"), F.col("data_reg").alias("reg")),
        )),
    )
    long = long.withColumn("state", F.coalesce(F.try_element_at(names, F.substring("reg", 1, 1)), F.lit("UNKNOWN")))
    return change_points(long, ["dump_id", "slot", "type"], ["line_no"], ["state"]).drop("prev_state", "reg")
