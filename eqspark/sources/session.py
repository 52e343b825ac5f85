"""Session documents: one JSON text a row, read with a fixed schema, checked by column expressions, written in a fixed key order.

Version 1 documents are raised to version 2 (a time limit of 60 s where there is none). A document's first broken rule is its
error; reading strictly raises it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HARD_MAX_FILTERS, MAX_GAIN_DB, MAX_HZ, MAX_Q, MIN_HZ, MIN_Q, TIME_LIMITS_S

SETTINGS = "minFrequencyHz double, maxFrequencyHz double, minGainDb double, maxGainDb double, minQ double, maxQ double, maxFilters double, timeLimitSeconds double"
NORMALIZATION = "mode string, frequencyHz double, levelDb double"
FILTER = "id string, enabled boolean, type string, frequencyHz double, gainDb double, q double"
METRICS = "maeDb double, rmseDb double, maxAbsDb double, maxAbsFrequencyHz double"
MANIFEST = f"schemaVersion int, algorithmVersion string, sampleRateHz double, fitPointsPerOctave double, autoeqSettings struct<{SETTINGS.replace(' ', ':').replace(',:', ',')}>, normalization struct<mode:string,frequencyHz:double,levelDb:double>, sourceName string, targetName string, finalFilters array<struct<{FILTER.replace(' ', ':').replace(',:', ',')}>>, metrics struct<{METRICS.replace(' ', ':').replace(',:', ',')}>, preampDb double, targetAchieved boolean, terminationReason string"
SCHEMA = (
    "schemaVersion int, curves array<struct<id:string,name:string,kind:string,rawPoints:array<struct<frequencyHz:double,db:double>>,metadata:map<string,variant>>>, activeFrId string, activeTargetId string, "
    f"normalization struct<mode:string,frequencyHz:double,levelDb:double>, autoeqSettings struct<{SETTINGS.replace(' ', ':').replace(',:', ',')}>, filters array<struct<{FILTER.replace(' ', ':').replace(',:', ',')}>>, "
    "filterProvenance string, solutionState string, autoEqRun struct<manifest:struct<" + ",".join(x.replace(" ", ":", 1) for x in MANIFEST.split(", ")) + ">>"
)
#: The provenance of filters that a fit delivered, as documents spell it (a fixed value of the format).
FITTED = "autoeq"
DEFAULT_TIME_LIMIT = 60.0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def valid_settings(s: Column, timed: bool = True) -> Column:
    ok = F.lit(True)
    for lo, hi, least, most in (("minFrequencyHz", "maxFrequencyHz", MIN_HZ, MAX_HZ), ("minGainDb", "maxGainDb", -MAX_GAIN_DB, MAX_GAIN_DB), ("minQ", "maxQ", MIN_Q, MAX_Q)):
        ok &= finite(s[lo]) & finite(s[hi]) & (s[lo] >= least) & (s[hi] <= most) & (s[lo] < s[hi])
    ok &= finite(s["maxFilters"]) & (s["maxFilters"] == F.floor(s["maxFilters"])) & s["maxFilters"].between(0, HARD_MAX_FILTERS)
    return ok & s["timeLimitSeconds"].isin(*map(float, TIME_LIMITS_S)) if timed else ok


def valid_normalization(n: Column) -> Column:
    return n["mode"].isin("hz", "db") & n["frequencyHz"].between(MIN_HZ, MAX_HZ) & n["levelDb"].between(0, 100)


def valid_curve(c: Column) -> Column:
    points = c["rawPoints"]
    rising = F.forall(F.transform(points, lambda p, i: (i == 0) | (F.get(points, i - 1)["frequencyHz"] < p["frequencyHz"])), lambda x: F.coalesce(x, F.lit(False)))
    fine = F.forall(points, lambda p: finite(p["frequencyHz"]) & finite(p["db"]) & (p["frequencyHz"] > 0))
    return (F.length(F.trim(c["id"])) > 0) & c["name"].isNotNull() & c["kind"].isin("fr", "target") & (F.size(points) >= 2) & fine & rising


def valid_metadata(curves: Column) -> Column:
    """Whether every curve of a document has metadata whose values are texts, truth values or numbers; as variants they keep their kinds."""
    simple = lambda v: F.schema_of_variant(v).rlike(r"^(STRING|BOOLEAN|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$")
    return F.forall(curves, lambda c: c["metadata"].isNotNull() & F.forall(F.map_values(c["metadata"]), simple))


def valid_filter(f: Column) -> Column:
    return (F.length(F.trim(f["id"])) > 0) & f["enabled"].isNotNull() & f["type"].isin("PK", "LS", "HS") & f["frequencyHz"].between(MIN_HZ, MAX_HZ) & f["gainDb"].between(-MAX_GAIN_DB, MAX_GAIN_DB) & f["q"].between(MIN_Q, MAX_Q)


def valid_manifest(m: Column) -> Column:
    """Version 2 has no outcome fields; in version 3 they must agree with the metrics."""
    numbers = F.lit(True)
    for x in ("maeDb", "rmseDb", "maxAbsDb", "maxAbsFrequencyHz"):
        numbers &= finite(m["metrics"][x])
    common = numbers & finite(m["preampDb"]) & valid_normalization(m["normalization"]) & F.forall(m["finalFilters"], valid_filter) & (m["sampleRateHz"] > 0)
    met = (m["metrics"]["rmseDb"] <= 0.25) & (m["metrics"]["maxAbsDb"] <= 0.75)
    first = (m["schemaVersion"] == 2) & valid_settings(m["autoeqSettings"], timed=False)
    second = (m["schemaVersion"] == 3) & valid_settings(m["autoeqSettings"]) & (m["targetAchieved"] == met) & m["terminationReason"].isin("target-reached", "converged", "time-limit")
    return F.coalesce(common & (first | second), F.lit(False))


def read_sessions(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, session, error of documents (key, text)."""
    s = F.from_json("text", SCHEMA, {"mode": "PERMISSIVE"})
    out = texts.select(key, F.explode(F.array(s)).alias("s"))  # parsed once: the optimizer does not copy it into every rule
    limit = F.when(F.col("s.schemaVersion") == 1, F.coalesce("s.autoeqSettings.timeLimitSeconds", F.lit(DEFAULT_TIME_LIMIT))).otherwise(F.col("s.autoeqSettings.timeLimitSeconds"))
    names = [x.split()[0] for x in SETTINGS.split(", ")][:-1]
    out = out.select(key, "s", F.explode(F.array(F.struct(*[F.col(f"s.autoeqSettings.{n}").alias(n) for n in names], limit.alias("timeLimitSeconds")))).alias("settings"))
    c = lambda name: F.col("settings") if name == "autoeqSettings" else F.col(f"s.{name}")
    no = lambda x: ~F.coalesce(x, F.lit(False))
    ids = lambda name: F.transform(c(name), lambda x: x["id"])
    refers = lambda name, kind: c(name).isNull() | F.exists(c("curves"), lambda x: (x["id"] == c(name)) & (x["kind"] == kind))
    run, how, state = c("autoEqRun.manifest"), c("filterProvenance"), c("solutionState")
    same_settings = F.lit(True)
    for x in ("minFrequencyHz", "maxFrequencyHz", "minGainDb", "maxGainDb", "minQ", "maxQ", "maxFilters"):
        same_settings &= c("autoeqSettings")[x].eqNullSafe(run["autoeqSettings"][x])
    same_settings &= run["autoeqSettings"]["timeLimitSeconds"].isNull() | c("autoeqSettings")["timeLimitSeconds"].eqNullSafe(run["autoeqSettings"]["timeLimitSeconds"])
    clean = (how == FITTED) & (state == "clean")
    rules = [
        (F.col("s").isNull() | c("schemaVersion").isNull(), "not a session document"),
        (~c("schemaVersion").isin(1, 2), "unsupported version"),
        (no(valid_settings(c("autoeqSettings"))), "invalid settings"),
        (c("curves").isNull() | no(F.forall(c("curves"), valid_curve)) | no(valid_metadata(c("curves"))), "malformed curve"),
        (F.size(F.array_distinct(ids("curves"))) != F.size("s.curves"), "duplicate curve ids"),
        (no(refers("activeFrId", "fr")), "the active response is no response curve"),
        (no(refers("activeTargetId", "target")), "the active target is no target curve"),
        (no(valid_normalization(c("normalization"))), "invalid normalization"),
        (c("filters").isNull() | (F.size("s.filters") > HARD_MAX_FILTERS), "too many filters"),
        (no(F.forall(c("filters"), valid_filter)), "malformed filter"),
        (F.size(F.array_distinct(ids("filters"))) != F.size("s.filters"), "duplicate filter ids"),
        (how.isNotNull() & ~how.isin("manual", FITTED), "invalid provenance"),
        (no(state.isin("clean", "modified", "stale")), "invalid solution state"),
        (run.isNotNull() & ~valid_manifest(run), "invalid run"),
        (how.isNull() & (F.size("s.filters") > 0), "filters without provenance"),
        ((how.isNull() | (how == "manual")) & run.isNotNull(), "a run without fitted provenance"),
        ((how.isNull() | (how == "manual")) & (state != "clean"), "an unfitted solution must be clean"),
        ((how == FITTED) & run.isNull(), "fitted provenance needs a run"),
        (clean & (c("activeFrId").isNull() | c("activeTargetId").isNull()), "a clean fit needs active curves"),
        (clean & ~c("normalization").eqNullSafe(run["normalization"]), "normalization differs from the run"),
        (clean & ~same_settings, "settings differ from the run"),
        (clean & ~c("filters").eqNullSafe(run["finalFilters"]), "filters differ from the run"),
    ]
    error = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(message)) for broken, message in rules])
    out = out.withColumn("error", error)
    fields = ["curves", "activeFrId", "activeTargetId", "normalization", "autoeqSettings", "filters", "filterProvenance", "solutionState", "autoEqRun"]
    whole = F.struct(F.lit(2).alias("schemaVersion"), *[c(n).alias(n) for n in fields])
    return out.select(key, F.when(F.col("error").isNull(), whole).alias("session"), "error")


def strict(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session", F.when(F.col("error").isNull(), F.col("session")).otherwise(F.raise_error(F.concat(F.lit("validation: "), F.col("error")))))


def write_sessions(sessions: DataFrame, key: str = "path") -> DataFrame:
    """key, text: pretty JSON in the schema's key order with a final newline."""
    text = F.to_json("session", {"pretty": "true", "ignoreNullFields": "false"})
    return sessions.where("error IS NULL").select(key, F.concat(text, F.lit("\n")).alias("text"))


def session_points(sessions: DataFrame, key: str = "path") -> DataFrame:
    """key, curve_id, kind, idx, f, db of all curves."""
    rows = sessions.where("error IS NULL").select(key, F.explode("session.curves").alias("c")).select(key, F.col("c.id").alias("curve_id"), F.col("c.kind").alias("kind"), F.posexplode("c.rawPoints").alias("idx", "p"))
    return rows.select(key, "curve_id", "kind", "idx", F.col("p.frequencyHz").alias("f"), F.col("p.db").alias("db"))
