"""Windows, dedupe, splits, resampling, joins in time, sets, paging and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, strings
from ..operators import metrics, sequences
from .tables import PRIORITIES, longs, query, rounded, table


def _ordered(spark, d):
    """Events by user in time order, with seconds since the start of 2024."""
    return table(spark, d, "events").withColumn("t", (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)).cast("double"))


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")

E = "e AS (SELECT *, CAST(epoch(date_trunc('second', ts)) - 1704067200 AS DOUBLE) AS t FROM events)"


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last(spark, d):
    """WIN-03, SRC-06, SRC-23."""
    e = table(spark, d, "events")
    return rounded(sequences.keep_one(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value"))


@query("WITH u AS (SELECT doc_id, quality, 0 AS src FROM labels UNION ALL SELECT doc_id, NULL, 1 FROM documents) SELECT doc_id, quality FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (quality IS NULL)::INT, src) = 1")
def merge_prefer_labelled(spark, d):
    """SET-01, SET-02, TRAP-16."""
    both = table(spark, d, "labels").select("doc_id", "quality", F.lit(0).alias("src")).unionByName(table(spark, d, "documents").select("doc_id", F.lit(None).cast(table(spark, d, "labels").schema["quality"].dataType).alias("quality"), F.lit(1).alias("src")))
    return sequences.keep_one(both, ["doc_id"], [F.col("quality").isNull().cast("int"), F.col("src")]).select("doc_id", "quality")


@query("WITH q AS (SELECT (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS week, o_orderkey FROM orders) SELECT week, week >= (SELECT min(week) FROM (SELECT DISTINCT week FROM q ORDER BY week DESC LIMIT 3)) AS test, count(*) AS n FROM q GROUP BY ALL")
def week_split(spark, d):
    """WIN-22, JOIN-23, OP-01."""
    from .tables import week_of

    q = table(spark, d, "orders").select(week_of(F.col("o_orderdate")).cast("long").alias("week"))
    return sequences.last_groups(q, "week", 3).groupBy("week", "test").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT greatest(1, least(count(*) - 1, round_even(0.2 * count(*), 0))) AS k FROM c), r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey DESC) AS rn FROM c) SELECT o_custkey, rn <= (SELECT k FROM k) AS test, count(*) AS n FROM orders JOIN r USING (o_custkey) GROUP BY ALL")
def game_split(spark, d):
    """WIN-23, TRAP-29."""
    return sequences.last_share(table(spark, d, "orders").select("o_custkey"), "o_custkey", 0.2).groupBy("o_custkey", "test").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS semi, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS anti FROM customer")
def semi_anti(spark, d):
    """JOIN-03, JOIN-23, JOIN-24, SET-04."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    semi, anti = c.join(o, "c_custkey", "left_semi").agg(F.count(F.lit(1)).alias("semi")), c.join(o, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("anti"))
    return semi.crossJoin(anti)  # one row each


@query("SELECT s_suppkey, p_partkey, round(abs(p_retailprice - s_acctbal), 4) AS off FROM supplier JOIN part ON p_size = s_suppkey % 50 + 1 AND abs(p_retailprice - s_acctbal) <= 150")
def band_pairs(spark, d):
    """JOIN-13, JOIN-18: equal key and a band, by bins."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 50 + 1).alias("k"))
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("long").alias("k"))
    return sequences.band_join(s, p, "k", "s_acctbal", "p_retailprice", 150.0).select("s_suppkey", "p_partkey", F.round(F.abs(F.col("p_retailprice") - F.col("s_acctbal")), 4).alias("off"))


@query("SELECT a.event_id, a.user_id, b.event_id AS prior_id, round(b.value, 6) AS prior_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_prior(spark, d):
    """JOIN-14: the last view before each purchase."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("prior_id"), F.col("value").alias("prior_value"))
    return rounded(sequences.asof(left, right, "user_id", "ts", ["prior_id", "prior_value"]).select("event_id", "user_id", "prior_id", "prior_value"))


@query(f"""WITH {E}, g AS (SELECT u.user_id, CAST(s.h * 21600 AS DOUBLE) AS t FROM (SELECT DISTINCT user_id FROM e) u, range(0, 121) s(h)),
x AS (SELECT g.user_id, g.t, (SELECT max(t) FROM e WHERE e.user_id = g.user_id AND e.t <= g.t) AS a, (SELECT min(t) FROM e WHERE e.user_id = g.user_id AND e.t >= g.t) AS b FROM g),
y AS (SELECT x.*, (SELECT arg_max(value, event_id) FROM e WHERE e.user_id = x.user_id AND e.t = x.a) AS va, (SELECT arg_max(value, event_id) FROM e WHERE e.user_id = x.user_id AND e.t = x.b) AS vb FROM x)
SELECT user_id, t, round(CASE WHEN a = b THEN va WHEN b - a <= 86400 THEN va + (vb - va) * ((t - a) / (b - a)) END, 4) AS value FROM y""")
def resample_grid(spark, d):
    """WIN-07, JOIN-15, STR-08: six-hour grid, gaps of a day at most."""
    e = sequences.keep_one(_ordered(spark, d), ["user_id", "t"], [F.col("event_id").desc()])
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("h")).select("user_id", (F.col("h") * 21600).cast("double").alias("t"))
    return rounded(sequences.resample(e, grid, "user_id", "t", "value", 86400.0, 0.0), "value", digits=4)


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT r.user_id, r.event_id, round(CASE WHEN r.n = 1 THEN 0 ELSE (h.value - l.value) / ((h.i - l.i) * 0.1) END, 4) AS velocity FROM r JOIN r h ON h.user_id = r.user_id AND h.i = least(r.i + 2, r.n) JOIN r l ON l.user_id = r.user_id AND l.i = greatest(r.i - 2, 1)""")
def velocity(spark, d):
    """WIN-04."""
    out = table(spark, d, "events").select("user_id", "event_id", sequences.central_difference(F.col("value"), by_user(), 2, 0.1).alias("velocity"))
    return rounded(out, "velocity", digits=4)


@query("SELECT user_id, event_id, round(CASE WHEN value IS NULL THEN NULL WHEN len(v) >= 2 THEN list_median(v) ELSE value END, 6) AS smooth FROM (SELECT user_id, event_id, value, list_filter(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), lambda x: x IS NOT NULL) AS v FROM (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events))".replace("list_median(v)", "list_aggregate(v, 'median')"))
def median_filter(spark, d):
    """WIN-06, TRAP-01."""
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rounded(e.select("user_id", "event_id", sequences.median3(F.col("value"), by_user()).alias("smooth")))


@query("SELECT user_id, event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 4 THEN value ELSE sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 END, 6) AS smooth FROM events")
def moving_average(spark, d):
    """WIN-09, TRAP-13."""
    return rounded(table(spark, d, "events").select("user_id", "event_id", sequences.moving_average(F.col("value"), by_user(), 4).alias("smooth")))


@query(f"WITH {E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 43200 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS events, max(t) - min(t) AS seconds FROM s GROUP BY ALL")
def sessions(spark, d):
    """STR-04."""
    e = _ordered(spark, d)
    return sequences.sessions(e, "user_id", F.col("t"), 43200).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), (F.max("t") - F.min("t")).alias("seconds"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    """STR-06: the batch twin of streaming.windows."""
    from ..streaming.windows import windowed

    return rounded(windowed(table(spark, d, "events"), "1 day").select("event_type", F.col("window.start").alias("day"), "n", "total"), "total", digits=4)


@query("SELECT event_type, s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL")
def sliding_windows(spark, d):
    """STR-06."""
    from ..streaming.windows import windowed

    return rounded(windowed(table(spark, d, "events"), "2 days", "1 day").select("event_type", F.col("window.start").alias("start"), "n", "total"), "total", digits=4)


@query("WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY ALL), s AS (SELECT event_type, greatest(median(abs(value - m)), 1e-6) AS s FROM events JOIN m USING (event_type) GROUP BY ALL) SELECT event_type, event_id FROM events JOIN m USING (event_type) JOIN s USING (event_type) WHERE value > m + 2.5 * s")
def spikes(spark, d):
    """WIN-11, VIS-26."""
    return sequences.spikes(table(spark, d, "events"), "event_type", "event_id", "value").select("event_type", "event_id")


@query()
def spaced_spikes(spark, d):
    """WIN-11, WIN-29: the greedy gap is a fold, beyond plain SQL."""
    return sequences.spaced(sequences.spikes(table(spark, d, "events"), "event_type", "event_id", "value"), "event_type", "event_id", 50)


@query("""WITH x AS (SELECT user_id, event_id, row_number() OVER w AS f, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS quiet, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS loud FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, CASE WHEN loud / greatest(quiet, 1e-6) >= 1.5 THEN loud - quiet END AS gain FROM x), z AS (SELECT *, max(gain) OVER (PARTITION BY user_id) AS peak FROM y) SELECT user_id, min(f) AS frame FROM z WHERE gain >= 0.4 * peak GROUP BY user_id""")
def snap_frames(spark, d):
    """WIN-10."""
    e = table(spark, d, "events").withColumn("frame", F.row_number().over(by_user()).cast("long"))
    return sequences.snap_frame(e, "user_id", "frame", "value", 5, 3, 1.5)


@query("SELECT user_id, arg_min(event_id, -jump * 1e6 + i) AS event_id FROM (SELECT *, abs(lead(value) OVER w - value) AS jump, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE jump IS NOT NULL GROUP BY user_id")
def largest_jump(spark, d):
    """WIN-25, WIN-21: the first of the largest steps."""
    e = table(spark, d, "events").withColumns({"jump": F.abs(F.lead("value").over(by_user()) - F.col("value")), "i": F.row_number().over(by_user())}).filter("jump is not null")
    return e.groupBy("user_id").agg(F.min_by("event_id", -F.col("jump") * 1e6 + F.col("i")).alias("event_id"))


@query("WITH g AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events) SELECT user_id, round(stddev_pop(gap), 4) AS spacing, round(max(gap), 6) AS widest FROM g GROUP BY user_id HAVING count(gap) > 0")
def gap_spread(spark, d):
    """WIN-19, AGG-39."""
    order = Window.partitionBy("user_id").orderBy("value", "event_id")
    g = table(spark, d, "events").withColumn("gap", F.col("value") - F.lag("value").over(order)).filter("gap is not null")
    return rounded(rounded(g.groupBy("user_id").agg(F.stddev_pop("gap").alias("spacing"), F.max("gap").alias("widest")), "spacing", digits=4), "widest")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200 OFFSET 400")
def paged_listing(spark, d):
    """PRJ-06, PRJ-07, SRT-06, SRT-09, JOIN-05: a page is the feature."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    listing = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(lines, "o_orderkey", "left")
    return sequences.page(listing, [F.col("o_orderkey")], 400, 200).select("o_orderkey", "o_custkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.coalesce("n", F.lit(0)).alias("lines"))


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT n_nationkey, 'none' FROM nation EXCEPT SELECT s_nationkey, 'none' FROM supplier)")
def set_operations(spark, d):
    """SET-01, SET-03, SET-04, SET-05, SET-06."""
    t = lambda n, c: table(spark, d, n).select(F.col(c).alias("k"))
    both = t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).withColumn("side", F.lit("both"))
    return both.unionByName(t("nation", "n_nationkey").exceptAll(t("supplier", "s_nationkey").distinct()).distinct().withColumn("side", F.lit("none")))


PRED = "p AS (SELECT event_id, event_type AS truth, ['click', 'error', 'purchase', 'signup', 'view'] AS c, event_id % 5 AS a, (event_id * 7 + 3) % 11 % 5 AS b, (value % 100) / 100 AS conf FROM events), q AS (SELECT event_id, truth, CASE WHEN conf > 0.4 THEN truth ELSE c[CAST(a AS BIGINT) + 1] END AS predicted, c[CAST(b AS BIGINT) + 1] AS second, conf FROM p)"
FIVE = ["click", "error", "purchase", "signup", "view"]


def _predictions(spark, d):
    """A made-up classifier over events: right where a number says so."""
    classes = F.array(*map(F.lit, FIVE))
    conf = (F.col("value") % 100) / 100
    first = F.when(conf > 0.4, F.col("event_type")).otherwise(F.get(classes, (F.col("event_id") % 5).cast("int")))
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("truth"), first.alias("predicted"), F.get(classes, ((F.col("event_id") * 7 + 3) % 11 % 5).cast("int")).alias("second"), conf.alias("conf"))


@query(f"WITH {PRED}, d AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS c) SELECT a.c AS truth, b.c AS predicted, (SELECT count(*) FROM q WHERE q.truth = a.c AND q.predicted = b.c) AS n FROM d a, d b")
def confusion_matrix(spark, d):
    """AGG-14, TRAP-30."""
    return metrics.confusion(_predictions(spark, d), "truth", "predicted", FIVE)


@query(f"WITH {PRED}, m AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM q GROUP BY truth)) SELECT count(*) AS n, round(avg((truth = predicted)::INT), 6) AS accuracy, round(avg((truth = predicted OR truth = second)::INT), 6) AS top2, round(avg(((truth IN ('error', 'purchase')) = (predicted IN ('error', 'purchase')))::INT), 6) AS family_accuracy, round((SELECT m FROM m) / count(*), 6) AS majority, round(avg((truth = predicted)::INT) - (SELECT m FROM m) / count(*), 6) AS lift FROM q")
def accuracy_summary(spark, d):
    """AGG-15, WIN-18, OP-02."""
    p = _predictions(spark, d).withColumn("ranked", F.array("predicted", "second"))
    families = {c: "buy" if c in ("error", "purchase") else "look" for c in FIVE}
    return longs(rounded(metrics.accuracy_summary(p, "truth", "ranked", families)), "n")


@query(f"WITH {PRED}, c AS (SELECT DISTINCT truth AS class FROM q UNION SELECT DISTINCT predicted FROM q), s AS (SELECT class, (SELECT count(*) FROM q WHERE truth = class) AS t, (SELECT count(*) FROM q WHERE predicted = class) AS p, (SELECT count(*) FROM q WHERE truth = class AND predicted = class) AS tp FROM c) SELECT class, t AS support, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(t + p, 0), 0), 6) AS f1 FROM s")
def f1_by_class(spark, d):
    """AGG-16."""
    return rounded(metrics.f1_by_class(_predictions(spark, d), "truth", "predicted"))


@query(f"WITH {PRED} SELECT least(9, floor(conf * 10))::INT AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg((truth = predicted)::INT), 6) AS accuracy, round(avg(conf) - avg((truth = predicted)::INT), 6) AS gap FROM q GROUP BY 1")
def calibration_bins(spark, d):
    """AGG-18, OP-03."""
    return rounded(metrics.calibration(_predictions(spark, d), F.col("conf"), F.col("truth") == F.col("predicted")))


@query(f"WITH {PRED}, b AS (SELECT least(9, floor(conf * 10)) AS bin, count(*) AS n, abs(avg(conf) - avg((truth = predicted)::INT)) AS gap FROM q GROUP BY 1), l AS (SELECT -avg(ln(greatest(1e-15, CASE WHEN truth = predicted THEN conf ELSE (1 - conf) / 4 END))) AS ll FROM q) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round((SELECT ll FROM l), 6) AS log_loss FROM b")
def calibration_error(spark, d):
    """AGG-17, AGG-18."""
    p = _predictions(spark, d)
    right = F.col("truth") == F.col("predicted")
    loss = metrics.log_loss(p, F.when(right, F.col("conf")).otherwise((1 - F.col("conf")) / 4))
    return rounded(metrics.expected_calibration_error(metrics.calibration(p, F.col("conf"), right)).crossJoin(loss))  # one row each


@query(f"WITH {PRED}, o AS (SELECT event_id, truth, conf, (truth = predicted)::INT AS tp, row_number() OVER (PARTITION BY truth ORDER BY conf DESC, event_id) AS rn FROM q), c AS (SELECT *, sum(tp) OVER (PARTITION BY truth ORDER BY rn) / rn AS p, sum(tp) OVER (PARTITION BY truth) AS total FROM o), e AS (SELECT *, max(p) OVER (PARTITION BY truth ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS env FROM c) SELECT truth, round(sum(env * tp / total), 6) AS ap FROM e GROUP BY truth")
def average_precision(spark, d):
    """WIN-16."""
    p = _predictions(spark, d)
    right = F.col("truth") == F.col("predicted")
    total = F.sum(right.cast("long")).over(Window.partitionBy("truth"))
    curve = metrics.precision_recall(p.withColumn("total", total), "conf", right, F.col("total"), "event_id", ["truth"])
    return rounded(metrics.average_precision(curve, ["truth"]))


@query(f"WITH {PRED}, s AS (SELECT avg((truth = predicted)::INT) AS accuracy, avg(conf) AS confidence FROM q), g AS (SELECT 'accuracy' AS criterion, CASE WHEN accuracy >= 0.9 THEN 10 WHEN accuracy >= 0.5 THEN 8 + 2 * (accuracy - 0.5) / 0.4 ELSE greatest(1, 7 * accuracy / 0.5) END AS score FROM s UNION ALL SELECT 'confidence', CASE WHEN confidence >= 0.9 THEN 10 WHEN confidence >= 0.6 THEN 8 + 2 * (confidence - 0.6) / 0.3 ELSE greatest(1, 7 * confidence / 0.6) END FROM s) SELECT criterion, round(score, 6) AS score, (SELECT arg_min(criterion, score) FROM g) AS weakest FROM g")
def acceptance_gates(spark, d):
    """ML-10, FN-MATH-16, SRT-10."""
    row = _predictions(spark, d).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"), F.avg("conf").alias("confidence"))
    return rounded(metrics.gates(row, {"accuracy": (0.5, 0.9), "confidence": (0.6, 0.9)}))


BOXES = """b AS (SELECT p_partkey AS id, p_partkey // 50 AS frame, (p_size * 7) % 90 AS x, (p_partkey * 13) % 60 AS y, 12 + p_size % 9 AS w, 9 + p_partkey % 7 AS h, p_retailprice AS conf, p_partkey % 50 < 25 AS truth FROM part),
pr AS (SELECT p.id AS p_id, t.id AS t_id, p.frame, p.conf, greatest(0, least(p.x + p.w, t.x + t.w) - greatest(p.x, t.x)) * greatest(0, least(p.y + p.h, t.y + t.h) - greatest(p.y, t.y)) AS i, p.w * p.h + t.w * t.h AS u FROM b p JOIN b t ON p.frame = t.frame AND NOT p.truth AND t.truth)"""


def _boxes(spark, d):
    p = table(spark, d, "part")
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    box = p.select(key.alias("id"), F.floor(key / 50).alias("frame"), (size * 7 % 90).alias("x1"), (key * 13 % 60).alias("y1"), (12 + size % 9).alias("w"), (9 + key % 7).alias("h"), F.col("p_retailprice").alias("conf"), (key % 50 < 25).alias("truth"))
    return box.select("*", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"))


def _box_pairs(spark, d, least: float):
    b = _boxes(spark, d)
    a, t = b.filter(~F.col("truth")).alias("a"), b.filter("truth").alias("t")
    side = lambda s: [F.col(f"{s}.{c}").cast("double") for c in ("x1", "y1", "x2", "y2")]
    pairs = a.join(t, F.col("a.frame") == F.col("t.frame")).select(F.col("a.frame").alias("frame"), F.col("a.id").alias("p_id"), F.col("t.id").alias("t_id"), F.col("a.conf").alias("conf"), geometry.iou(side("a"), side("t")).alias("iou"))
    return pairs.filter(F.col("iou") >= least)


@query(f"WITH {BOXES} SELECT frame, p_id, t_id, round(i / (u - i), 6) AS iou FROM pr WHERE i / (u - i) >= 0.3")
def iou_pairs(spark, d):
    """FN-MATH-11, JOIN-16 (candidates)."""
    return rounded(_box_pairs(spark, d, 0.3).drop("conf"))


@query()
def greedy_boxes(spark, d):
    """JOIN-16, JOIN-17, TRAP-14: the greedy choice is sequential within a frame."""
    return sequences.greedy_match(_box_pairs(spark, d, 0.3), "frame", "p_id", "t_id", ["conf", "iou"], [False, False])


@query()
def detection_metrics(spark, d):
    """AGG-24, OP-30."""
    b = _boxes(spark, d)
    matched = sequences.greedy_match(_box_pairs(spark, d, 0.3), "frame", "p_id", "t_id", ["conf", "iou"], [False, False])
    t = b.filter("truth").select(F.col("id").alias("t_id"), F.lit(True).alias("is_t")).join(matched.select("t_id", "p_id", "iou"), "t_id", "left")
    p = b.filter("not truth").select(F.col("id").alias("p_id")).join(matched.select("p_id", F.lit(True).alias("m")), "p_id", "left_anti")
    rows = t.select(F.col("p_id").isNotNull().alias("p"), F.lit(True).alias("t"), "iou").unionByName(p.select(F.lit(True).alias("p"), F.lit(False).alias("t"), F.lit(None).cast("double").alias("iou")))
    return metrics.detection_summary(rows, [], F.col("p"), F.col("t"), F.col("iou"))


@query()
def association(spark, d):
    """JOIN-19, JOIN-20, STR-02."""
    b = _boxes(spark, d).select(F.floor(F.col("id") / 100).alias("clip"), (F.col("id") % 10).alias("frame"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"), F.when(F.col("truth"), "offense").otherwise("defense").alias("side"))
    return sequences.associate(b, "clip", "frame", "x", "y", "side")


@query()
def smoothed_values(spark, d):
    """WIN-27."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return rounded(sequences.exponential_smoothing(e, "user_id", "event_id", "value", 0.55))


H = [0.1, 0.02, 10.0, 0.01, 0.1, 5.0, 0.0002, 0.0001, 1.0]


@query("""SELECT p_partkey, round((0.1 * x + 0.02 * y + 10) / w, 6) AS u, round((0.01 * x + 0.1 * y + 5) / w, 6) AS v, round(x * 1.0, 4) AS back_x, round(y * 1.0, 4) AS back_y,
 CASE WHEN y > 6 - 1.5 THEN 'left' WHEN y < -(6 - 1.5) THEN 'right' ELSE 'middle' END AS hash, p_partkey % 4 + 1 AS down, CASE WHEN p_size % 11 > 0 THEN p_retailprice % 12 >= CASE p_partkey % 4 + 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 1.0 END * (p_size % 11) END AS success
 FROM (SELECT *, p_size AS x, p_partkey % 30 - 15 AS y, 0.0002 * p_size + 0.0001 * (p_partkey % 30 - 15) + 1 AS w FROM part)""")
def field_geometry(spark, d):
    """FN-MATH-02, FN-MATH-10, FN-MATH-12, VIS-31."""
    p = table(spark, d, "part")
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 30 - 15).cast("double")
    u, v = geometry.project(H, x, y)
    back = geometry.project(geometry.invert3(H), F.col("u"), F.col("v"))
    down = F.col("p_partkey") % 4 + 1
    rows = p.select("p_partkey", u.alias("u"), v.alias("v"), geometry.hash_of(y, 6.0).alias("hash"), down.alias("down"), geometry.success(down, (F.col("p_size") % 11).cast("double"), F.col("p_retailprice") % 12).alias("success"))
    out = rows.withColumns({"back_x": F.round(back[0], 4) + 0.0, "back_y": F.round(back[1], 4) + 0.0})
    return rounded(out, "u", "v")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(source)), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS team, regexp_replace(regexp_replace(lower('  ' || source || ' (' || lang || ') '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' END AS label, CASE doc_id % 3 WHEN 0 THEN '12' WHEN 1 THEN '00' ELSE '21' END AS personnel, CASE doc_id % 3 WHEN 0 THEN '12' WHEN 2 THEN '21' END AS personnel_or_null FROM documents""")
def normalised_text(spark, d):
    """FN-STR-01, FN-STR-02, FN-STR-05, FN-STR-06, TRAP-20."""
    doc = table(spark, d, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, "1 RB, 2 TE, 2 WR").when(F.col("doc_id") % 3 == 1, "5 WR").otherwise("2 RB, 1 TE")
    return doc.select("doc_id", strings.normalize_team(F.col("source"), {}).alias("team"), strings.slug(F.concat(F.lit("  "), "source", F.lit(" ("), "lang", F.lit(") "))).alias("slug"), strings.normalize_label(F.col("lang"), {"en": "English", "fr": "French"}, ["English", "French"]).alias("label"), strings.personnel_code(text).alias("personnel"), strings.personnel_code(text, F.lit(None).cast("string")).alias("personnel_or_null"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 2 = 0 AS even FROM events")
def json_flatten(spark, d):
    """FN-ARR-03, VIS-20."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", "p.k", (F.col("p.k") % 2 == 0).alias("even"))


@query("""WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, i, avg(e[i]) AS m FROM u, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS m FROM p GROUP BY label)
SELECT vec_id, arg_max(c.label, [round(list_cosine_similarity(u.e, c.m), 9), -c.label]) AS nearest, round(max(list_cosine_similarity(u.e, c.m)), 5) AS cosine FROM u, c GROUP BY vec_id""")
def centroid_assign(spark, d):
    """AGG-29, ML-07 (assignment), VIS-09: the nearest mean vector of a label by cosine; the few means travel as one row."""
    from pyspark.sql import Column

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    u = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = u.select("label", F.posexplode("e")).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("m"))
    row = centroids.agg(F.collect_list(F.struct("label", "m")).alias("c"))
    both = u.crossJoin(F.broadcast(row))  # one row, a vector for each label
    cosine = lambda c: dot(F.col("e"), c["m"]) / F.sqrt(dot(F.col("e"), F.col("e"))) / F.sqrt(dot(c["m"], c["m"]))
    best = F.array_max(F.transform("c", lambda c: F.struct(F.round(cosine(c), 9).alias("s"), (-c["label"]).alias("l"))))
    return both.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.l")).alias("nearest"), F.round("b.s", 5).alias("cosine"))


@query("WITH c AS (SELECT label, avg(embedding[1]::DOUBLE) AS m1, median(embedding[2]::DOUBLE) AS m2, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(m1, 5) AS mean1, round(m2, 5) AS median2 FROM c")
def track_profiles(spark, d):
    """AGG-28, AGG-29."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 5).alias("mean1"), F.round(F.median(F.col("embedding")[1].cast("double")), 5).alias("median2"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns, arg_max(length(text), turn) AS last_chars FROM conversations GROUP BY conv_id")
def ordered_collect(spark, d):
    """PRJ-22, VIS-17, FN-ARR-02: ordered lists by key."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"), F.count(F.lit(1)).alias("turns"), F.max_by(F.length("text"), "turn").cast("long").alias("last_chars"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda x: x["role"]), ">").alias("roles"), "turns", "last_chars")
