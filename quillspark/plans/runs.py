"""Queries on tables of runs, derived from orders, line items, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import runs
from quillspark.plans.register import registry, rounded
from quillspark.sources import derived as d
from quillspark.sources import readers

QUERIES, ORACLE_SQL, query = registry()


def _runs(spark, sf):
    """Orders as runs: customer as model, status, an error rate that failed runs lack."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("pending")
    rate = F.when(F.col("o_orderstatus") == "F", F.round(F.pmod("o_orderkey", F.lit(1000)) / 1400, 6))
    return d.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("model"), status.alias("status"), rate.alias("cer"), F.col("o_orderdate").alias("at"))


RUNS = "WITH runs AS (SELECT o_orderkey, o_custkey AS model, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderstatus = 'F' THEN round(o_orderkey % 1000 / 1400, 6) END AS cer, o_orderdate AS started FROM orders)"
ADVICE = "CASE WHEN cer IS NULL THEN 'failed' WHEN cer < 0.1 THEN 'excellent' WHEN cer < 0.3 THEN 'good' WHEN cer < 0.5 THEN 'needs_sweep' ELSE 'needs_investigation' END"


@query(f"{RUNS} SELECT {ADVICE} AS recommendation, count(*) AS n FROM runs GROUP BY ALL")
def recommendation(spark, sf):
    return _runs(spark, sf).groupBy(runs.recommendation(F.col("cer")).alias("recommendation")).agg(F.count("*").alias("n"))


@query(f"{RUNS} SELECT status, CASE WHEN status <> 'pending' THEN {ADVICE} END AS recommendation, count(*) AS n FROM runs GROUP BY ALL")
def run_status(spark, sf):
    return runs.status_counts(_runs(spark, sf))


@query(f"{RUNS} SELECT model, arg_max(o_orderkey, (started, o_orderkey)) AS o_orderkey, arg_max(status, (started, o_orderkey)) AS status FROM runs GROUP BY model")
def latest_run(spark, sf):
    rows = _runs(spark, sf).select("model", "o_orderkey", "status", "at")
    return runs.latest_run(rows, "model", F.struct("at", "o_orderkey")).select("model", "o_orderkey", "status")


@query(f"{RUNS} SELECT model, arg_min(o_orderkey, (cer, o_orderkey)) AS o_orderkey, min(cer) AS cer FROM runs WHERE status = 'completed' GROUP BY model")
def best_config(spark, sf):
    done = _runs(spark, sf).withColumn("status", F.when(F.col("status") == "completed", "success").otherwise(F.col("status")))
    return runs.best_config(done, "model", "o_orderkey")


@query("""WITH m AS (SELECT event_type, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 = 0 THEN 'inf'::DOUBLE ELSE value END AS loss, value AS cer FROM events)
SELECT event_type, round(avg(loss) FILTER (WHERE NOT isnan(loss) AND NOT isinf(loss)), 6) AS loss, round(avg(cer), 6) AS cer FROM m GROUP BY event_type""")
def nan_safe_mean(spark, sf):
    loss = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).when(F.col("event_id") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = d.table(spark, sf, "events").select("event_type", loss.alias("loss"), F.col("value").alias("cer"))
    return rounded(runs.nan_safe_means(rows, "event_type", "loss", "cer"))


@query("""WITH c AS (SELECT user_id, event_id AS epoch, value AS cer, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events),
i AS (SELECT *, best_before IS NULL OR cer < best_before AS improved, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS n FROM c),
w AS (SELECT *, n - max(n) FILTER (WHERE improved) OVER (PARTITION BY user_id ORDER BY epoch) AS waited FROM i),
s AS (SELECT *, coalesce(max((waited >= 5)::INT) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM w)
SELECT user_id, epoch, cer, best_before, improved, waited::BIGINT AS waited FROM s WHERE stopped = 0""")
def early_stop(spark, sf):
    curves = d.table(spark, sf, "events").select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("cer"))
    return runs.early_stop(curves, "user_id", "epoch", "cer", 5).withColumn("waited", F.col("waited").cast("long"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, CASE WHEN k > n - floor(n * 0.1) THEN 'validation' ELSE 'train' END AS part FROM r""")
def tail_split(spark, sf):
    return runs.tail_split(d.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


BACKBONES, DEFAULT_RATE = ["ring", "bolt", "gear"], 0.001


@query(f"""WITH r AS (SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'gear') THEN 'gear' ELSE 'simple' END AS backbone FROM part),
dim AS (SELECT * FROM (VALUES ('ring', 0.0005), ('gear', 0.0001)) v(backbone, rate))
SELECT p_partkey, backbone, coalesce(rate::DOUBLE, {DEFAULT_RATE}::DOUBLE) AS rate FROM r LEFT JOIN dim USING (backbone)""")
def dim_lookup(spark, sf):
    rows = d.table(spark, sf, "part").select("p_partkey", runs.architecture(F.col("p_name"), BACKBONES, "simple").alias("backbone"))
    dimension = spark.createDataFrame([("ring", 0.0005), ("gear", 0.0001)], "backbone string, rate double")
    return runs.with_dimension(rows, F.broadcast(dimension), "backbone", "rate", DEFAULT_RATE)  # two rows


@query("SELECT DISTINCT o_custkey + 7 AS name FROM orders WHERE o_custkey + 7 NOT IN (SELECT c_custkey FROM customer)")
def unknown_names(spark, sf):
    requested = d.table(spark, sf, "orders").select((F.col("o_custkey") + 7).alias("name"))
    return runs.unknown_names(requested, d.table(spark, sf, "customer").select(F.col("c_custkey").alias("name")), "name")


@query("""SELECT p_partkey, lr, batch, width FROM part, unnest([0.001::DOUBLE, 0.0001::DOUBLE]) a(lr), unnest([16, 32]) b(batch), unnest([512, 768]) c(width) WHERE p_size > 25 OR width = 512""")
def param_grid(spark, sf):
    configurations = d.table(spark, sf, "part").select("p_partkey", "p_size")
    return runs.parameter_grid(configurations, {"lr": [0.001, 0.0001], "batch": [16, 32], "width": [512, 768]}, {"width": F.col("p_size") > 25}).drop("p_size")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT % 3000 + 50 AS w, l_quantity::BIGINT + 20 AS h FROM lineitem), n AS (SELECT *, floor(w * 64 / h)::BIGINT AS new_w FROM i)
SELECT *, CASE WHEN new_w < 1024 THEN 'pad' WHEN new_w > 1024 THEN 'crop' ELSE 'exact' END AS action, greatest(0, 1024 - new_w)::BIGINT AS padding FROM n""")
def width_plan(spark, sf):
    images = d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice") % 3000 + 50).alias("w"), (F.col("l_quantity").cast("long") + 20).alias("h"))
    return runs.width_plan(images, 64, 1024)


def _logs(spark, sf):
    """Events as training logs: an epoch line each, and a final line for every other user's last event."""
    e = d.table(spark, sf, "events")
    rate = F.format_string("%.4f", F.col("value") / 100)
    epoch = F.concat(F.lit("Epoch "), (F.col("event_id") % 100).cast("string"), F.lit("/100 | Train Loss: "), rate, F.lit(" | Val Loss: "), rate, F.lit(" | CER: "), rate, F.lit(" | WER: "), rate)
    final = F.concat(F.lit("Training complete. Best CER: "), rate)
    return e.select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), F.when((F.col("user_id") % 2 == 0) & (F.col("event_type") == "error"), final).otherwise(epoch).alias("text"))


LOGS = "WITH e AS (SELECT user_id AS log, event_id AS line_no, event_id % 100 AS epoch, format('{:.4f}', value / 100)::DOUBLE AS rate, user_id % 2 = 0 AND event_type = 'error' AS final FROM events)"


@query(f"""{LOGS} SELECT log, coalesce(arg_min(rate, line_no) FILTER (WHERE final), arg_max(rate, line_no) FILTER (WHERE NOT final)) AS cer, arg_max(rate, line_no) FILTER (WHERE NOT final) AS wer, true AS success FROM e GROUP BY log""")
def log_final_metric(spark, sf):
    return readers.log_result(_logs(spark, sf))


@query(f"{LOGS} SELECT log, epoch::INT AS epoch, rate AS train_loss, rate AS val_loss, rate AS cer FROM e WHERE NOT final")
def log_epoch_curve(spark, sf):
    return readers.log_epochs(_logs(spark, sf))


#: Seconds without a line after which a run counts as dead in the given events, which are hours apart.
IDLE = 2 * 86_400


@query(f"""WITH e AS (SELECT user_id AS log, ts, event_id, CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'success' WHEN event_type = 'error' AND user_id % 3 = 1 AND value < 10 THEN 'error' WHEN event_type = 'signup' AND user_id % 7 = 0 AND value > 90 THEN 'failed' END AS kind,
  format('{{:.4f}}', value / 100) AS rate, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
l AS (SELECT log, min(ts) AS first, max(ts) AS last, min(before + INTERVAL {IDLE} SECOND) FILTER (ts > before + INTERVAL {IDLE} SECOND) AS stall,
  min({{'ts': ts, 'id': event_id, 'kind': kind, 'rate': rate}}) FILTER (kind IS NOT NULL) AS ended FROM e GROUP BY log),
s AS (SELECT log, first, last, ended, coalesce(stall, CASE WHEN (SELECT max(ts) FROM events) > last + INTERVAL {IDLE} SECOND THEN last + INTERVAL {IDLE} SECOND END) AS stall FROM l),
o AS (SELECT *, ended IS NOT NULL AND (stall IS NULL OR ended.ts <= stall) AS done FROM s)
SELECT log, CASE WHEN done THEN ended.kind WHEN stall IS NOT NULL THEN 'timeout' ELSE 'running' END AS status, CASE WHEN done AND ended.kind = 'success' THEN ended.rate::DOUBLE END AS best_cer,
  CASE WHEN done AND ended.kind = 'error' THEN 'out of memory at ' || ended.rate WHEN done AND ended.kind = 'failed' THEN '2' END AS message,
  floor(epoch_us(CASE WHEN done THEN ended.ts ELSE coalesce(stall, last) END - first) / 1000000)::BIGINT AS seconds FROM o""")
def run_outcome(spark, sf):
    """Events as lines of runs: some end well, some with an error or an exit code, some fall silent."""
    e = d.table(spark, sf, "events")
    rate = F.format_string("%.4f", F.col("value") / 100)
    is_ = lambda kind, cond: (F.col("event_type") == kind) & cond
    user, value = F.col("user_id"), F.col("value")
    text = F.when(is_("purchase", user % 3 == 0), F.concat(F.lit("Training complete. Best CER: "), rate))
    text = text.when(is_("error", (user % 3 == 1) & (value < 10)), F.concat(F.lit("RuntimeError: out of memory at "), rate))
    text = text.when(is_("signup", (user % 7 == 0) & (value > 90)), F.lit("Exit code: 2")).otherwise(F.concat(F.lit("CER: "), rate, F.lit(" | WER: "), rate))
    lines = e.select(user.alias("log"), F.col("ts").alias("at"), F.col("event_id").alias("line_no"), text.alias("text"))
    return readers.run_outcomes(lines, IDLE)
