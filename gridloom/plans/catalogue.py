"""The engine's queries over the driver's tables, and the SQL that gives the same rows.

The tables hold no boxes, so line items stand in: an order is an image of 200 by 200 pixels, its line items are ground-truth
boxes, and the same boxes moved by up to 39 pixels, some with another class, are its detections. Documents stand
in for files and items, orders and line items for the tables of a prediction run. Every query covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geometry, text
from gridloom.operators import audit, constraints, evaluation, matching, prediction, splits, suppression
from gridloom.sinks import files as sinks
from gridloom.sources import files as sources

W, H = 200, 200
CORNERS = ("xmin", "ymin", "xmax", "ymax")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- stand-ins ------------------------------------------------------------------------------


def lines(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Line items, unless told otherwise with their number from 1 within the order.

    Orders are dealt to as many tasks as rows ask for, where these are more than the session would run; so numbering needs no more memory the larger the table.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    if not numbered:
        return own
    parts = evaluation.tasks(own.count())
    if parts > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        own = own.repartition(parts, "l_orderkey")
    return own.withColumn("box_number", F.row_number().over(order))


def boxes(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """``image_id, image_path, box_number, class_id, xmin, ymin, xmax, ymax, width, height``; without numbers, line items needn't be dealt by order."""
    x, y, side = F.col("l_partkey") % 20, F.col("l_suppkey") % 20, F.lit(10) + F.col("l_quantity").cast("long")
    number = ["box_number"] if numbered else []
    return lines(spark, sf_dir, numbered).select(F.col("l_orderkey").alias("image_id"), F.col("l_orderkey").cast("string").alias("image_path"), *number, (F.col("l_partkey") % 12).alias("class_id"), x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side).alias("ymax"), F.lit(W).cast("long").alias("width"), F.lit(H).cast("long").alias("height"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = boxes(spark, sf_dir)
    index = F.col("box_number") - 1
    return own.select("image_id", text.numbered(F.col("image_id"), "gt", index).alias("ground_truth_id"), index.alias("ordinal"), "class_id", "xmin", "ymin", "xmax", "ymax")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth moved by (part % 40, supplier % 7); every seventh part has the next class; confidence from the price."""
    x, y, side = F.col("l_partkey") % 20 + F.col("l_partkey") % 40, F.col("l_suppkey") % 20 + F.col("l_suppkey") % 7, F.lit(10) + F.col("l_quantity").cast("long")
    part, index = F.col("l_partkey"), F.col("box_number") - 1
    kind = F.when(part % 7 == 0, (part + 1) % 12).otherwise(part % 12)
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("image_id"), text.numbered(F.col("l_orderkey"), "det", index).alias("detection_id"), index.alias("ordinal"), kind.alias("predicted_class_id"), ((part % 97 + 1) / F.lit(100.0)).alias("confidence"), x.alias("xmin"), y.alias("ymin"), (x + side).alias("xmax"), (y + side).alias("ymax"))


LINES_SQL = """lines AS (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::INT AS box_number FROM lineitem
), boxes AS (
    SELECT l_orderkey AS image_id, l_orderkey::VARCHAR AS image_path, box_number, l_partkey % 12 AS class_id, l_partkey % 20 AS xmin, l_suppkey % 20 AS ymin,
        l_partkey % 20 + 10 + l_quantity::BIGINT AS xmax, l_suppkey % 20 + 10 + l_quantity::BIGINT AS ymax FROM lines
)"""
PAIRS_SQL = (
    LINES_SQL
    + """, gt AS (
    SELECT image_id, printf('%d_gt_%04d', image_id, box_number - 1) AS ground_truth_id, box_number - 1 AS ordinal, class_id, xmin, ymin, xmax, ymax FROM boxes
), det AS (
    SELECT l_orderkey AS image_id, printf('%d_det_%04d', l_orderkey, box_number - 1) AS detection_id, box_number - 1 AS ordinal,
        CASE WHEN l_partkey % 7 = 0 THEN (l_partkey + 1) % 12 ELSE l_partkey % 12 END AS predicted_class_id, (l_partkey % 97 + 1) / 100.0::DOUBLE AS confidence,
        l_partkey % 20 + l_partkey % 40 AS xmin, l_suppkey % 20 + l_suppkey % 7 AS ymin,
        l_partkey % 20 + l_partkey % 40 + 10 + l_quantity::BIGINT AS xmax, l_suppkey % 20 + l_suppkey % 7 + 10 + l_quantity::BIGINT AS ymax FROM lines
), lapped AS (
    SELECT d.image_id, detection_id, ground_truth_id, predicted_class_id = class_id AS same_class,
        (greatest(0, least(d.xmax, g.xmax) - greatest(d.xmin, g.xmin)) * greatest(0, least(d.ymax, g.ymax) - greatest(d.ymin, g.ymin)))::DOUBLE AS common,
        ((d.xmax - d.xmin) * (d.ymax - d.ymin) + (g.xmax - g.xmin) * (g.ymax - g.ymin))::DOUBLE AS areas
    FROM det d JOIN gt g ON d.image_id = g.image_id
), pairs AS (
    SELECT image_id, detection_id, ground_truth_id, same_class, common / (areas - common) AS iou FROM lapped WHERE common / (areas - common) >= 0.5
)"""
)
MATCH_SQL = (
    PAIRS_SQL
    + """, ordered AS (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, detection_id, ground_truth_id) AS k FROM pairs
), walk AS (
    SELECT image_id, k, detection_id, ground_truth_id, iou, same_class, true AS taken, [detection_id] AS ds, [ground_truth_id] AS gs FROM ordered WHERE k = 1
    UNION ALL
    SELECT o.image_id, o.k, o.detection_id, o.ground_truth_id, o.iou, o.same_class,
        NOT list_contains(w.ds, o.detection_id) AND NOT list_contains(w.gs, o.ground_truth_id),
        CASE WHEN NOT list_contains(w.ds, o.detection_id) AND NOT list_contains(w.gs, o.ground_truth_id) THEN list_append(w.ds, o.detection_id) ELSE w.ds END,
        CASE WHEN NOT list_contains(w.ds, o.detection_id) AND NOT list_contains(w.gs, o.ground_truth_id) THEN list_append(w.gs, o.ground_truth_id) ELSE w.gs END
    FROM walk w JOIN ordered o ON o.image_id = w.image_id AND o.k = w.k + 1
), matched AS (
    SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY k) - 1)::INT AS rank, detection_id, ground_truth_id, iou, same_class FROM walk WHERE taken
)"""
)
COMPARED_SQL = (
    MATCH_SQL
    + """, compared AS (
    SELECT image_id, 0 AS phase, rank AS place, detection_id, ground_truth_id, iou, CASE WHEN same_class THEN 'true_positive' ELSE 'class_error' END AS status FROM matched
    UNION ALL SELECT image_id, 1, ordinal, detection_id, '', NULL, 'false_positive' FROM det WHERE detection_id NOT IN (SELECT detection_id FROM matched)
    UNION ALL SELECT image_id, 2, ordinal, '', ground_truth_id, NULL, 'false_negative' FROM gt WHERE ground_truth_id NOT IN (SELECT ground_truth_id FROM matched)
)"""
)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- boxes ----------------------------------------------------------------------------------

AREA = "((xmax - xmin) * (ymax - ymin))::DOUBLE / 40000.0::DOUBLE"


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, xmax - xmin AS box_width, ymax - ymin AS box_height, {AREA} AS relative_area FROM boxes")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.measured(boxes(spark, sf_dir)).select("image_id", "box_number", "box_width", "box_height", "relative_area")


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, CASE WHEN {AREA} < 0.01::DOUBLE THEN 'small' WHEN {AREA} <= 0.05::DOUBLE THEN 'medium' ELSE 'large' END AS size FROM boxes")
def box_size_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.measured(boxes(spark, sf_dir)).select("image_id", "box_number", "size")


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, CASE WHEN {AREA} > 0 AND {AREA} <= 0.01::DOUBLE THEN 'small' WHEN {AREA} > 0.01::DOUBLE AND {AREA} <= 0.05::DOUBLE THEN 'medium' WHEN {AREA} > 0.05::DOUBLE AND {AREA} <= 1 THEN 'large' END AS size FROM boxes")
def box_size_bucket_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.measured(boxes(spark, sf_dir)).select("image_id", "box_number", geometry.size_class_cut(F.col("relative_area")).alias("size"))


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, class_id - 1 AS class_id, (xmin + xmax)::DOUBLE / 2 / 200 AS x_center, (ymin + ymax)::DOUBLE / 2 / 200 AS y_center, (xmax - xmin)::DOUBLE / 200 AS width, (ymax - ymin)::DOUBLE / 200 AS height FROM boxes")
def box_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = boxes(spark, sf_dir)
    shares = geometry.to_normalised(geometry.box(), F.col("width"), F.col("height"))
    return own.select("image_id", "box_number", (F.col("class_id") - 1).alias("class_id"), *[c.alias(n) for n, c in shares.items()])


@query(f"""WITH {LINES_SQL}, n AS (SELECT image_id, box_number, (xmin + 3 * xmax)::DOUBLE / 200 AS x, (ymin + 3 * ymax)::DOUBLE / 200 AS y, (xmax - xmin)::DOUBLE / 100 AS w, (ymax - ymin)::DOUBLE / 100 AS h FROM boxes)
SELECT image_id, box_number, least(1.0::DOUBLE, greatest(0.0::DOUBLE, x - w / 2)) * 200 AS xmin, least(1.0::DOUBLE, greatest(0.0::DOUBLE, y - h / 2)) * 200 AS ymin,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, x + w / 2)) * 200 AS xmax, least(1.0::DOUBLE, greatest(0.0::DOUBLE, y + h / 2)) * 200 AS ymax FROM n""")
def yolo_to_box_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = geometry.box()
    scaled = boxes(spark, sf_dir).select("image_id", "box_number", ((x0 + 3 * x1).cast("double") / 200).alias("x"), ((y0 + 3 * y1).cast("double") / 200).alias("y"), ((x1 - x0).cast("double") / 100).alias("w"), ((y1 - y0).cast("double") / 100).alias("h"))
    corners = geometry.from_normalised(*(F.col(c) for c in "xywh"), F.lit(W), F.lit(H))
    return scaled.select("image_id", "box_number", *[c.alias(n) for n, c in corners.items()])


@query(f"""WITH {PAIRS_SQL} SELECT detection_id, least(greatest((xmin * 4)::DOUBLE, 0), 200) AS xmin, least(greatest((ymin * 4)::DOUBLE, 0), 200) AS ymin, least(greatest((xmax * 4)::DOUBLE, 0), 200) AS xmax, least(greatest((ymax * 4)::DOUBLE, 0), 200) AS ymax FROM det""")
def detection_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = geometry.clamped(tuple(c * 4 for c in geometry.box()), F.lit(W), F.lit(H))
    return detections(spark, sf_dir).select("detection_id", *[c.alias(n) for n, c in moved.items()])


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, xmin >= xmax - 15 OR ymin >= ymax - 15 AS reversed, xmin - 5 < 0 OR ymin - 5 < 0 OR xmax - 20 > 50 OR ymax - 20 > 50 AS outside FROM boxes")
def corner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = boxes(spark, sf_dir).withColumns({"xmin": F.col("xmin") - 5, "ymin": F.col("ymin") - 5, "xmax": F.col("xmax") - 20, "ymax": F.col("ymax") - 20, "width": F.lit(50), "height": F.lit(50)})
    return audit.corner_checks(moved).select("image_id", "box_number", "reversed", "outside")


# -- matching -------------------------------------------------------------------------------


@query(f"WITH {PAIRS_SQL} SELECT image_id, detection_id, ground_truth_id, iou FROM pairs")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidate_pairs(detections(spark, sf_dir), ground_truth(spark, sf_dir)).drop("same_class")


@query(f"WITH RECURSIVE {MATCH_SQL} SELECT image_id, rank, detection_id, ground_truth_id, iou, same_class FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matches(detections(spark, sf_dir), ground_truth(spark, sf_dir))


@query(f"WITH RECURSIVE {MATCH_SQL} SELECT image_id, detection_id FROM det WHERE detection_id NOT IN (SELECT detection_id FROM matched)")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detections(spark, sf_dir)
    return matching.false_positives(found, matching.matches(found, ground_truth(spark, sf_dir)))


@query(f"WITH RECURSIVE {MATCH_SQL} SELECT image_id, ground_truth_id FROM gt WHERE ground_truth_id NOT IN (SELECT ground_truth_id FROM matched)")
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = ground_truth(spark, sf_dir)
    return matching.false_negatives(truth, matching.matches(detections(spark, sf_dir), truth))


@query(f"""WITH RECURSIVE {COMPARED_SQL} SELECT printf('%d_cmp_%04d', image_id, row_number() OVER (PARTITION BY image_id ORDER BY phase, place) - 1) AS comparison_id,
    image_id, detection_id, ground_truth_id, iou, status FROM compared""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.comparisons(detections(spark, sf_dir), ground_truth(spark, sf_dir))


@query(f"""WITH RECURSIVE {COMPARED_SQL} SELECT s.status, count(c.status)::BIGINT AS n FROM (VALUES ('true_positive'), ('class_error'), ('false_positive'), ('false_negative')) s(status)
    LEFT JOIN compared c ON c.status = s.status GROUP BY s.status""")
def cmp_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.status_counts(matching.comparisons(detections(spark, sf_dir), ground_truth(spark, sf_dir)))


@query(f"""WITH RECURSIVE {COMPARED_SQL}, n AS (SELECT count(*) FILTER (status = 'true_positive') t, count(*) FILTER (status = 'class_error') c, count(*) FILTER (status = 'false_positive') p, count(*) FILTER (status = 'false_negative') m FROM compared)
SELECT t::DOUBLE / (t + c + p) AS precision, t::DOUBLE / (t + c + m) AS recall FROM n""")
def overall_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_recall(matching.comparisons(detections(spark, sf_dir), ground_truth(spark, sf_dir)))


HITS_SQL = (
    PAIRS_SQL
    + """, near AS (
    SELECT p.image_id, p.detection_id, d.predicted_class_id AS class_id, d.confidence, list({'iou': iou, 'g': ground_truth_id} ORDER BY iou DESC, ground_truth_id) AS cands
    FROM pairs p JOIN det d ON d.detection_id = p.detection_id WHERE same_class GROUP BY ALL
), queued AS (
    SELECT near.*, j, 0.5::DOUBLE + 0.05::DOUBLE * j AS t, row_number() OVER (PARTITION BY image_id, class_id, j ORDER BY confidence DESC, detection_id) AS k FROM near, thresholds
), walk AS (
    SELECT image_id, class_id, j, k, detection_id, pick, CASE WHEN pick IS NULL THEN []::VARCHAR[] ELSE [pick] END AS taken
    FROM (SELECT *, list_filter(cands, lambda c: c.iou >= t)[1].g AS pick FROM queued WHERE k = 1)
    UNION ALL
    SELECT image_id, class_id, j, k, detection_id, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END
    FROM (SELECT q.*, w.taken, list_filter(q.cands, lambda c: c.iou >= q.t AND NOT list_contains(w.taken, c.g))[1].g AS pick
        FROM walk w JOIN queued q ON q.image_id = w.image_id AND q.class_id = w.class_id AND q.j = w.j AND q.k = w.k + 1)
), ranked AS (
    SELECT predicted_class_id AS class_id, h.j, (h.pick IS NOT NULL)::INT AS hit, row_number() OVER w AS rank, sum((h.pick IS NOT NULL)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS tp
    FROM (SELECT det.*, thresholds.j, walk.pick FROM det CROSS JOIN thresholds LEFT JOIN walk ON walk.detection_id = det.detection_id AND walk.j = thresholds.j) h
    WINDOW w AS (PARTITION BY predicted_class_id, j ORDER BY confidence DESC, detection_id)
), positives AS (
    SELECT class_id, count(*) AS n FROM gt GROUP BY class_id
), curve AS (
    SELECT r.class_id, j, rank, hit, tp::DOUBLE / rank AS precision, tp::DOUBLE / p.n AS recall, p.n FROM ranked r JOIN positives p ON p.class_id = r.class_id
), aps AS (
    SELECT class_id, j, sum(hit * envelope / n) AS ap FROM (SELECT *, max(precision) OVER (PARTITION BY class_id, j ORDER BY rank DESC ROWS UNBOUNDED PRECEDING) AS envelope FROM curve) GROUP BY class_id, j
)"""
).replace("OVER (w ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY predicted_class_id, j ORDER BY confidence DESC, detection_id ROWS UNBOUNDED PRECEDING)")
CURVE_SQL, METRICS_SQL = (f"WITH RECURSIVE thresholds AS (SELECT range AS j FROM range({n})), {HITS_SQL}" for n in (1, 10))


def scored(spark: SparkSession, sf_dir: str, thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Detections with their hits; each line item is a detection and a ground truth."""
    rows = 2 * table(spark, sf_dir, "lineitem").count()
    return evaluation.hits(detections(spark, sf_dir), ground_truth(spark, sf_dir), thresholds, rows)


@query(f"{CURVE_SQL} SELECT class_id, rank::INT AS rank, precision, recall FROM curve")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.curve(scored(spark, sf_dir), boxes(spark, sf_dir, numbered=False))


@query(f"{CURVE_SQL} SELECT class_id, round(ap, 9) AS ap FROM aps")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.average_precision(scored(spark, sf_dir), boxes(spark, sf_dir, numbered=False))
    return found.select("class_id", F.round(F.get("ap", F.lit(0)), 9).alias("ap"))


@query(f"""{METRICS_SQL}, per AS (SELECT class_id, sum(ap) FILTER (j = 0) AS a, sum(ap) / 10 AS b FROM aps GROUP BY class_id), first AS (SELECT class_id, sum(hit) AS tp, count(*) AS n FROM ranked WHERE j = 0 GROUP BY class_id)
SELECT p.class_id, p.n::INT AS instances, coalesce(tp / f.n, 0)::DOUBLE AS precision, coalesce(tp / p.n, 0)::DOUBLE AS recall, coalesce(round(a, 9), 0) AS AP50, coalesce(round(b, 9), 0) AS AP50_95
FROM positives p LEFT JOIN first f ON f.class_id = p.class_id LEFT JOIN per ON per.class_id = p.class_id""")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten overlaps after one matching."""
    rows = evaluation.class_metrics(scored(spark, sf_dir, evaluation.THRESHOLDS), boxes(spark, sf_dir, numbered=False), len(evaluation.THRESHOLDS))
    return rows.drop("class_name").withColumns({c: F.round(c, 9) for c in ("AP50", "AP50_95")})


LAP = "greatest(0, least({b}x1, o.xmax) - greatest({b}x0, o.xmin)) * greatest(0, least({b}y1, o.ymax) - greatest({b}y0, o.ymin))".format(b="b.")


@query(f"""WITH RECURSIVE {PAIRS_SQL}, ordered AS (
    SELECT image_id, detection_id, predicted_class_id % 2 AS class_id, confidence, xmin, ymin, xmax, ymax, row_number() OVER (PARTITION BY image_id, predicted_class_id % 2 ORDER BY confidence DESC, detection_id) AS k FROM det WHERE confidence > 0.25
), walk AS (
    SELECT image_id, class_id, k, detection_id, confidence, true AS stays, [{{'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax}}] AS kept FROM ordered WHERE k = 1
    UNION ALL
    SELECT image_id, class_id, k, detection_id, confidence, stays, CASE WHEN stays THEN list_append(kept, {{'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax}}) ELSE kept END
    FROM (SELECT o.*, w.kept, len(list_filter(w.kept, lambda b: ({LAP})::DOUBLE / ((b.x1 - b.x0) * (b.y1 - b.y0) + (o.xmax - o.xmin) * (o.ymax - o.ymin) - {LAP})::DOUBLE > 0.3::DOUBLE)) = 0 AS stays
        FROM walk w JOIN ordered o ON o.image_id = w.image_id AND o.class_id = w.class_id AND o.k = w.k + 1)
)
SELECT image_id, detection_id, class_id AS predicted_class_id, confidence FROM walk WHERE stays""")
def nms_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two classes here, so that many boxes of one class overlap."""
    two = detections(spark, sf_dir).withColumn("predicted_class_id", F.col("predicted_class_id") % 2)
    return suppression.suppressed(two, 0.25, 0.3).select("image_id", "detection_id", "predicted_class_id", "confidence")


# -- audit ----------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT class_id, count(*) AS n FROM boxes GROUP BY class_id")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.class_counts(boxes(spark, sf_dir, numbered=False))


@query(f"WITH {LINES_SQL} SELECT CASE WHEN {AREA} < 0.01::DOUBLE THEN 'small' WHEN {AREA} <= 0.05::DOUBLE THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM boxes GROUP BY 1")
def size_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.size_counts(audit.box_records(audit.measured(boxes(spark, sf_dir, numbered=False))))


@query(f"""WITH {LINES_SQL}, c AS (SELECT CASE WHEN {AREA} < 0.01::DOUBLE THEN 'small' WHEN {AREA} <= 0.05::DOUBLE THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM boxes GROUP BY 1)
SELECT s.place, s.size, coalesce(n, 0)::BIGINT AS n FROM (VALUES (0, 'small'), (1, 'medium'), (2, 'large')) s(place, size) LEFT JOIN c ON c.size = s.size""")
def size_counts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.size_counts_in_order(audit.box_records(audit.measured(boxes(spark, sf_dir, numbered=False))))


@query(f"WITH {LINES_SQL}, c AS (SELECT class_id, count(*) AS n FROM boxes GROUP BY class_id) SELECT max(n) AS most, min(n) AS fewest, max(n)::DOUBLE / min(n) AS ratio FROM c")
def class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.class_imbalance(audit.class_counts(boxes(spark, sf_dir, numbered=False)))


@query("SELECT p_size::VARCHAR || 'x' || p_brand AS dimensions, count(*) AS n FROM part GROUP BY 1")
def dimension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dimension_histogram(table(spark, sf_dir, "part"), "p_size", "p_brand")


@query("SELECT p_size::VARCHAR || 'x' || p_brand AS dimensions, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, dimensions LIMIT 20")
def topn_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.most_common(audit.dimension_histogram(table(spark, sf_dir, "part"), "p_size", "p_brand"), "dimensions", 20)


@query("SELECT objects, count(*) AS images FROM (SELECT o_orderkey, count(l_orderkey) AS objects FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY objects")
def objects_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct()
    return audit.objects_per_image(images, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query(f"WITH {LINES_SQL} SELECT min({AREA}) AS least, max({AREA}) AS most, round(avg({AREA}), 9) AS mean FROM boxes")
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.area_stats(audit.box_records(audit.measured(boxes(spark, sf_dir, numbered=False)))).withColumn("mean", F.round("mean", 9))


@query("SELECT sha256(text) AS sha256, array_to_string(list(doc_id ORDER BY doc_id), ',') AS members, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = audit.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "doc_id")
    return groups.withColumn("members", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))))


@query("SELECT count(*) AS unique_contents, (sum(n - 1))::BIGINT AS extra_copies FROM (SELECT sha256(text), count(*) AS n FROM documents GROUP BY 1)")
def duplicate_extra_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_totals(table(spark, sf_dir, "documents"), F.col("text"))


@query(f"""WITH {LINES_SQL}, b AS (SELECT * FROM boxes)
SELECT image_path AS image, 'unknown_class' AS type, printf('Box %d: class %d', box_number, class_id) AS message FROM b WHERE class_id NOT BETWEEN 1 AND 10
UNION ALL SELECT image_path, 'invalid_box', printf('Box %d: (%d,%d,%d,%d), image size=60x60', box_number, xmin, ymin, xmax, ymax) FROM b WHERE NOT (xmin >= 0 AND xmin < xmax AND xmax <= 60 AND ymin >= 0 AND ymin < ymax AND ymax <= 60)""")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images count as 60 by 60 here, so that many boxes leave them."""
    small = boxes(spark, sf_dir).withColumns({"width": F.lit(60).cast("long"), "height": F.lit(60).cast("long")})
    return audit.box_issues(audit.measured(small))


@query("SELECT count(*) AS total_images, count(*) FILTER (NOT (l.doc_id IS NULL)) AS positive_images, count(*) FILTER (l.doc_id IS NULL) AS background_images, count(*) FILTER (n_chars > 300) AS readable_images FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.totals(items(spark, sf_dir), F.col("n_chars") > 300)


@query("SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_and_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.missing_and_orphan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CASE WHEN s = '' THEN '[no extension]' ELSE s END AS suffix, count(*) AS n FROM (SELECT lower(regexp_extract(list_last(string_split(url, '/')), '^.+(\\.[^.]+)$', 1)) AS s FROM pages) GROUP BY 1")
def suffix_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.suffix_histogram(table(spark, sf_dir, "pages"), "url")


@query(f"""WITH {LINES_SQL}, i AS (SELECT l.doc_id IS NULL AS bg, CASE WHEN n_chars > 300 THEN n_chars % 50 ELSE -1 END AS w, doc_id % 3 AS h, lang FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
b AS (SELECT class_id, xmax <= 60 AND ymax <= 60 AS ok, (xmax - xmin) * (ymax - ymin) / 3600.0::DOUBLE AS area FROM boxes)
SELECT 'total_images' AS figure, '' AS key, count(*) AS n FROM i UNION ALL SELECT CASE WHEN bg THEN 'background_images' ELSE 'positive_images' END, '', count(*) FROM i GROUP BY 1
UNION ALL SELECT 'readable_images', '', count(*) FROM i WHERE w >= 0 UNION ALL SELECT 'dimension_counts', w || 'x' || h, count(*) FROM i WHERE w >= 0 GROUP BY 2 UNION ALL SELECT 'mode_counts', lang, count(*) FROM i WHERE w >= 0 GROUP BY 2
UNION ALL SELECT 'class_counts', class_id::VARCHAR, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'total_objects', '', count(*) FROM b WHERE ok
UNION ALL SELECT 'size_counts', CASE WHEN area < 0.01::DOUBLE THEN 'small' WHEN area <= 0.05::DOUBLE THEN 'medium' ELSE 'large' END, count(*) FROM b WHERE ok GROUP BY 2
UNION ALL SELECT 'objects_per_image', n::VARCHAR, count(*) FROM (SELECT o, count(l_orderkey) AS n FROM (SELECT DISTINCT o_orderkey AS o FROM orders) LEFT JOIN lineitem ON l_orderkey = o GROUP BY o) GROUP BY 2""")
def audit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of an audit in one pass: documents are its images, line items its boxes in images of 60 by 60."""
    lang, readable = F.col("lang").alias("mode"), F.col("n_chars") > 300
    sized = items(spark, sf_dir).select("is_background", F.when(readable, F.col("n_chars") % 50).otherwise(-1).alias("width"), (F.col("doc_id") % 3).alias("height"), lang)
    small = boxes(spark, sf_dir, numbered=False).withColumns({"width": F.lit(60).cast("long"), "height": F.lit(60).cast("long")})
    return audit.profile(sized, audit.measured(small), objects_per_image(spark, sf_dir))


@query("""WITH i AS (SELECT doc_id, l.doc_id IS NULL AS bg, d.lang, d.n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT doc_id::VARCHAR AS image, CASE WHEN n_chars <= 300 THEN 'unreadable_image' WHEN lang = 'fr' THEN 'missing_annotation' ELSE 'annotation_parse_error' END AS type,
    CASE WHEN n_chars <= 300 THEN 'image cannot be decoded' WHEN lang = 'fr' THEN 'positive image without an annotation file' ELSE 'bad ' || doc_id END AS message
FROM i WHERE n_chars <= 300 OR (NOT bg AND (lang = 'fr' OR doc_id % 4 = 0))""")
def item_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents are unreadable images, labelled French ones lack their annotation, and a quarter of annotations don't parse."""
    path = F.col("doc_id").cast("string")
    own = items(spark, sf_dir).select(path.alias("image_path"), "is_background", F.when(~F.col("is_background") & (F.col("lang") != "fr"), path).alias("annotation_path"), "n_chars", "doc_id")
    images = own.filter("n_chars is not null").select("image_path", F.when(F.col("n_chars") > 300, 10).otherwise(-1).alias("width"))
    bad = own.filter("doc_id % 4 = 0").select(F.col("image_path").alias("annotation_path"), F.concat(F.lit("bad "), "image_path").alias("error"))
    return audit.item_issues(own.select("image_path", "is_background", "annotation_path"), images, bad)


# -- splits ---------------------------------------------------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: those without label are backgrounds."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left").withColumn("is_background", F.col("labelled").isNull())


def rule_split(key: Column) -> Column:
    """A stand-in for a manifest's split: 14 of 20 ids, then 3, then 3."""
    return F.when(key % 20 < 14, "train").when(key % 20 < 17, "val").otherwise("test")


SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END"


@query(f"SELECT d.doc_id, coalesce(s.split, 'external') AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, {SPLIT} AS split FROM labels) s ON s.doc_id = d.doc_id")
def manifest_enriched_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "labels").select("doc_id", rule_split(F.col("doc_id")).alias("split")).distinct()
    return splits.effective_split(table(spark, sf_dir, "documents").select("doc_id"), manifest, "doc_id")


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS matched, count(*) FILTER (l.doc_id IS NULL) AS unmatched FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def manifest_matched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.matched_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels)
SELECT d.doc_id, coalesce('labels/' || source || '/' || a.doc_id || '.txt', 'labels/' || b.doc_id || '.txt') AS annotation_path FROM documents d
LEFT JOIN l a ON a.doc_id = d.doc_id AND d.lang = 'en' LEFT JOIN l b ON b.doc_id = d.doc_id AND d.lang <> 'de'""")
def label_fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents have their label beside them, others but German ones in the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    images = docs.select("doc_id", F.concat_ws("/", F.lit("/images"), "source", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path"))
    named = table(spark, sf_dir, "labels").select("doc_id").distinct().join(docs, "doc_id")
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    labels = named.filter("lang = 'en'").select(F.concat_ws("/", F.lit("labels"), "source", file).alias("path")).unionByName(named.filter("lang not in ('de', 'en')").select(F.concat_ws("/", F.lit("labels"), file).alias("path")))
    return sources.label_of(images, labels, "/images", "labels", False).select("doc_id", "annotation_path")


@query(f"""WITH s AS (SELECT DISTINCT lang || n_chars AS k, {SPLIT} AS split FROM documents)
SELECT a.split AS first, b.split AS second, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND (a.split, b.split) IN (('train', 'val'), ('train', 'test'), ('val', 'test')) GROUP BY 1, 2""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("lang", "n_chars").alias("k"), rule_split(F.col("doc_id")).alias("split"))
    return constraints.overlaps(docs, "k")


@query(f"""SELECT {SPLIT} AS split, count(*) AS images, count(*) FILTER (n IS NULL) AS backgrounds, coalesce(sum(n), 0)::BIGINT AS objects FROM documents d LEFT JOIN (SELECT doc_id AS i, count(*) AS n FROM labels GROUP BY 1) l ON i = d.doc_id GROUP BY 1""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(items(spark, sf_dir).withColumn("split", rule_split(F.col("doc_id"))), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH s AS (SELECT *, CASE WHEN doc_id % 20 < 17 THEN 'train' ELSE 'val' END AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id AS i FROM labels) l ON i = d.doc_id), per AS (SELECT split, count(*) AS n, count(DISTINCT source || n_chars) AS u, count(*) FILTER (i IS NULL) AS b FROM s GROUP BY 1)
SELECT 1 AS rule, '2' AS place, 'split is empty: test' AS message UNION ALL SELECT 2, CASE split WHEN 'train' THEN '0' ELSE '1' END, 'repeated image paths in split: ' || split FROM per WHERE u < n
UNION ALL SELECT 3, CASE split WHEN 'train' THEN '0' ELSE '1' END, 'no background images in split: ' || split FROM per WHERE b = 0
UNION ALL SELECT 4, 'train val', 'train and val share ' || n || ' images' FROM (SELECT count(*) AS n FROM (SELECT source || n_chars FROM s WHERE split = 'train' INTERSECT SELECT source || n_chars FROM s WHERE split = 'val')) WHERE n > 0""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and length stand in for a path, so paths repeat; nothing is kept for testing."""
    rows = items(spark, sf_dir).select(F.concat("source", "n_chars").alias("image_path"), "is_background", F.when(F.col("doc_id") % 20 < 17, "train").otherwise("val").alias("split"))
    return constraints.split_violations(rows)


TARGETS = ", ".join(f"max(CASE WHEN l_linenumber = {k} THEN 1 ELSE 0 END)::VARCHAR" for k in range(1, 11))


@query(f"SELECT o_orderkey, concat({TARGETS}, max(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END)::VARCHAR) AS targets FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def multilabel_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("class_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").distinct().join(own.select("o_orderkey").distinct().withColumn("x", F.lit(1)), "o_orderkey", "left").withColumn("is_background", F.col("x").isNull())
    return splits.multilabel_targets(orders, own, "o_orderkey").withColumn("targets", F.concat_ws("", F.transform("targets", lambda x: x.cast("string"))))


@query(f"WITH {LINES_SQL} SELECT image_id, 'class out of range: ' || class_id AS message FROM boxes WHERE class_id NOT BETWEEN 1 AND 10 UNION ALL SELECT doc_id, 'positive image without an annotation file' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'es'")
def target_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish documents without label stand for positives without annotation."""
    found = items(spark, sf_dir).select(F.col("doc_id").alias("image_id"), (F.col("lang") != "es").alias("is_background"), F.when(~F.col("is_background"), "label").alias("annotation_path"))
    return splits.target_violations(found, boxes(spark, sf_dir, numbered=False), "image_id")


@query("""WITH l AS (SELECT doc_id AS i, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id), items AS (
    SELECT doc_id, concat((lang = 'en')::INT, (lang = 'fr')::INT, (lang = 'de')::INT, (lang = 'es')::INT, coalesce(q, 0), coalesce(t, 0), (q IS NULL)::INT) AS c FROM documents LEFT JOIN l ON i = doc_id
), counts AS (SELECT c, count(*) AS n FROM items GROUP BY c), labelled AS (SELECT c, n, k FROM counts, range(1, 8) r(k) WHERE substr(c, k::INT, 1) = '1'),
rarest AS (SELECT c, min((size, k)) AS r FROM labelled JOIN (SELECT k, sum(n) AS size FROM labelled GROUP BY k) s USING (k) GROUP BY c),
a AS (SELECT counts.c, n, r, sum(n) OVER (ORDER BY r IS NULL, r, counts.c) AS upto FROM counts LEFT JOIN rarest ON rarest.c = counts.c),
b AS (SELECT *, floor(upto::DOUBLE * 0.7::DOUBLE + 0.5::DOUBLE) - floor((upto - n)::DOUBLE * 0.7::DOUBLE + 0.5::DOUBLE) AS train FROM a),
d AS (SELECT *, n - train AS rest, sum(n - train) OVER (ORDER BY r IS NULL, r, c) AS upto2 FROM b),
e AS (SELECT c, train, floor(upto2::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE) - floor((upto2 - rest)::DOUBLE * 0.5::DOUBLE + 0.5::DOUBLE) AS val FROM d),
placed AS (SELECT doc_id, items.c, row_number() OVER (PARTITION BY items.c ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 AS k FROM items)
SELECT doc_id, CASE WHEN k < train THEN 'train' WHEN k < train + val THEN 'val' ELSE 'test' END AS split FROM placed JOIN e ON e.c = placed.c""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, quality and toxicity; those without label count as a kind of their own."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    flags = [F.when(F.col("lang") == lang, 1).otherwise(0) for lang in ("en", "fr", "de", "es")] + [F.coalesce(c, F.lit(0)) for c in ("q", "t")] + [F.when(F.col("q").isNull(), 1).otherwise(0)]
    return splits.stratified(docs.select("doc_id", F.array(*[f.cast("int") for f in flags]).alias("targets")), key="doc_id")


ORDER_SPLIT = "CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'val' ELSE 'test' END"


@query(f"WITH {LINES_SQL} SELECT split, class_id - 1 AS class_id, count(*) AS n FROM boxes JOIN (SELECT DISTINCT o_orderkey, {ORDER_SPLIT} AS split FROM orders) o ON o_orderkey = image_id GROUP BY ALL")
def objects_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("image_path"), rule_split(F.col("o_orderkey")).alias("split")).distinct()
    return splits.objects_by_class(images, boxes(spark, sf_dir, numbered=False))


@query(f"""SELECT CASE WHEN l.doc_id IS NULL THEN 'background_' ELSE 'positive_' END || doc_id AS image_id, source || '/' || doc_id || '.v1.png' AS image_path, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'truth/' || doc_id || '.txt' END AS annotation_path,
    l.doc_id IS NULL AS is_background, {SPLIT} AS split, 42 AS seed, 0.7::DOUBLE AS train_ratio, 0.15::DOUBLE AS val_ratio, 0.15::DOUBLE AS test_ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""".replace("|| doc_id AS image_id", "|| doc_id || '.v1' AS image_id"))
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below the data set's root, and ids by kind and stem."""
    key = F.col("doc_id").cast("string")
    rows = items(spark, sf_dir).select(F.concat(F.lit("/set/"), "source", F.lit("/"), key, F.lit(".v1.png")).alias("image_path"), F.when(~F.col("is_background"), F.concat(F.lit("/set/truth/"), key, F.lit(".txt"))).alias("annotation_path"), "is_background", rule_split(F.col("doc_id")).alias("split"))
    return sinks.manifest(rows, "/set", splits.SplitConfig())


@query(f"""WITH {LINES_SQL}, labels_of AS (
    SELECT image_id, count(*)::INT AS n, string_agg(printf('%d %.8f %.8f %.8f %.8f', class_id % 10, (xmin + xmax) / 2::DOUBLE / 200, (ymin + ymax) / 2::DOUBLE / 200, (xmax - xmin)::DOUBLE / 200, (ymax - ymin)::DOUBLE / 200), chr(10) ORDER BY box_number) || chr(10) AS label FROM boxes GROUP BY image_id
), o AS (SELECT DISTINCT o_orderkey AS k, {ORDER_SPLIT} AS split FROM orders)
SELECT printf('%s_%04d_%s_%d', split, row_number() OVER (PARTITION BY split ORDER BY k) - 1, CASE WHEN n IS NULL THEN 'background' ELSE 'positive' END, k) AS output_id, split, '/set/' || k || '.png' AS source_image,
    CASE WHEN n IS NULL THEN '' ELSE k::VARCHAR END AS source_annotation, n IS NULL AS is_background, coalesce(n, 0) AS object_count, coalesce(label, '') AS label FROM o LEFT JOIN labels_of ON image_id = k""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, counts and label texts of an export: orders are images, and those without line items backgrounds."""
    own = boxes(spark, sf_dir).select(F.col("image_path").alias("annotation_path"), "box_number", (F.col("class_id") % 10 + 1).alias("class_id"), "xmin", "ymin", "xmax", "ymax")
    key = F.col("o_orderkey").cast("string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey").distinct().join(own.select(F.col("annotation_path").cast("long").alias("o_orderkey")).distinct().withColumn("has", F.lit(True)), "o_orderkey", "left")
    rows = orders.select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("/set/"), key, F.lit(".png")).alias("image_path"), F.when(F.col("has"), key).alias("annotation_path"), F.col("has").isNull().alias("is_background"), rule_split(F.col("o_orderkey")).alias("split"))
    images = rows.select(F.col("image_path").alias("path"), F.lit(W).alias("width"), F.lit(H).alias("height"))
    return sinks.export_rows(rows, own, images)


# -- predictions ----------------------------------------------------------------------------

NAMES = {k: f"class {k}" for k in range(12)}


@query(f"""WITH {PAIRS_SQL} SELECT detection_id, image_id::VARCHAR AS image_id, predicted_class_id::INT AS predicted_class_id, 'class ' || predicted_class_id AS predicted_class_name, confidence,
    least(xmin, 50)::DOUBLE AS xmin, least(ymin, 50)::DOUBLE AS ymin, least(xmax, 50)::DOUBLE AS xmax, least(ymax, 50)::DOUBLE AS ymax FROM det""")
def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector gave for images of 50 by 50, as rows: moved inside, named and numbered."""
    box = F.struct(F.col("ordinal"), F.struct(*[F.col(c).cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("predicted_class_id").cast("int").alias("class_id"), "confidence").alias("b"))
    raw = detections(spark, sf_dir).select(F.col("image_id").cast("string").alias("image_id"), box.alias("box")).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("box")), lambda x: x["b"]).alias("boxes"))
    return prediction.detection_table(raw.withColumns({"width": F.lit(50), "height": F.lit(50)}), NAMES)


@query(f"WITH {PAIRS_SQL} SELECT ground_truth_id, image_id::VARCHAR AS image_id, class_id::INT AS class_id, 'class ' || class_id AS class_name, xmin, ymin, xmax, ymax FROM gt")
def ground_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth named by the model's classes, all of which it knows."""
    own = boxes(spark, sf_dir).select(F.col("image_id").cast("string").alias("image_id"), (F.col("box_number") - 1).alias("index"), "class_id", "xmin", "ymin", "xmax", "ymax")
    return prediction.ground_truth_table(own, NAMES)


PATHS_SQL = "SELECT rtrim(url, '/') || '/' || page_id || ['.PNG', '.txt', '.tiff', '.jpeg', '', '.gif', '.b.Bmp'][page_id % 7 + 1] AS path FROM pages"


@query(f"""WITH p AS ({PATHS_SQL}), i AS (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ordinal FROM p WHERE lower(path) SIMILAR TO '.*\\.(jpg|jpeg|png|bmp|tif|tiff)')
SELECT ordinal, path, printf('%s_%06d_%s', 'my_set', ordinal, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '')) AS image_id FROM i""")
def image_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images among paths, by suffix of any case, numbered in path order, with the ids of a run."""
    suffix = F.element_at(F.array(*map(F.lit, [".PNG", ".txt", ".tiff", ".jpeg", "", ".gif", ".b.Bmp"])), (F.col("page_id") % 7 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), F.col("page_id").cast("string"), suffix).alias("path"))
    return prediction.with_image_id(sources.discover_images(files), "my set!")


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM orders)
SELECT split AS place, 'image/label stem mismatch' AS message FROM o WHERE (k % 3 = 0) <> (k % 5 = 0) GROUP BY split
UNION ALL SELECT '/out/labels/' || split || '/' || k || '.txt:2', 'invalid class' FROM o WHERE k % 5 <> 0 AND k % 7 = 0""")
def label_tree_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order lacks its image, every fifth its label; the second line that isn't blank of every seventh label has an unknown class."""
    key, split = F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val")
    orders = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    path = lambda kind, suffix: F.concat(F.lit(f"/out/{kind}/"), split, F.lit("/"), key, F.lit(suffix))
    tree = orders.filter("o_orderkey % 3 <> 0").select(path("images", ".png").alias("path")).unionByName(orders.filter("o_orderkey % 5 <> 0").select(path("labels", ".txt").alias("path")))
    said = F.when(F.col("o_orderkey") % 7 == 0, "1 0.5 0.5 0.2 0.2\n\n10 0.5 0.5 0.2 0.2\n").otherwise("\n1 0.5 0.5 0.2 0.2")
    labels = orders.filter("o_orderkey % 5 <> 0").select(path("labels", ".txt").alias("path"), F.encode(said, "UTF-8").alias("content"))
    return sinks.label_tree_issues(sources.label_tree(tree), labels)


# -- source trees ---------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, l.doc_id IS NULL AS bg FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE doc_id % 5 <> 0),
i AS (SELECT '/set/' || CASE WHEN bg THEN 'Negative image set/' ELSE 'positive image set/' END || doc_id || CASE WHEN doc_id % 5 = 1 THEN '.JPG' ELSE '.png' END AS image_path,
    CASE WHEN NOT bg AND doc_id % 3 <> 0 THEN '/set/Ground Truth/' || doc_id || '.txt' END AS annotation_path, bg AS is_background FROM d)
SELECT row_number() OVER (ORDER BY is_background, image_path) - 1 AS ordinal, * FROM i""")
def dataset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a source tree: every fifth is no image, every third has no annotation, and names that aren't numbers or lie deeper don't count."""
    key = F.col("doc_id").cast("string")
    kind = F.when(F.col("is_background"), "Negative image set").otherwise("positive image set")
    suffix = F.when(F.col("doc_id") % 5 == 0, ".gif").when(F.col("doc_id") % 5 == 1, ".JPG").otherwise(".png")
    docs = items(spark, sf_dir)
    images = docs.select(F.concat(F.lit("/set/"), kind, F.lit("/"), key, suffix).alias("path"))
    deeper = docs.select(F.concat(F.lit("/set/"), kind, F.lit("/more/"), key, F.lit(".png")).alias("path"))
    truth = docs.select(F.concat(F.lit("/set/Ground Truth/"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("v"), key)).otherwise(key), F.lit(".txt")).alias("path"))
    return sources.discover_items(images.unionByName(deeper).unionByName(truth))


LABEL_FILES_SQL = (
    LINES_SQL
    + """, truth AS (
    SELECT image_id, '/out/labels/' || CASE WHEN image_id % 2 = 0 THEN 'train' ELSE 'val' END || '/' || image_id || '.txt' AS path, box_number, class_id, xmin, ymin, xmax, ymax FROM boxes
)"""
)


def label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, path`` of the label file of each order."""
    split = F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("val")
    return table(spark, sf_dir, "orders").select("o_orderkey").distinct().select("o_orderkey", F.concat(F.lit("/out/labels/"), split, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("path"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of label files that hold the boxes of each order, with a blank line after the first; orders without line items have an empty file."""
    own = boxes(spark, sf_dir)
    shares = geometry.to_normalised(geometry.box(), F.col("width"), F.col("height"))
    line = geometry.label_line(F.col("class_id"), shares)
    texts = own.groupBy(F.col("image_id").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("box_number", line.alias("line")))).alias("all"))
    said = F.concat(F.get("all", F.lit(0))["line"], F.lit("\n\n"), F.array_join(F.transform(F.slice("all", 2, 1 << 30), lambda x: x["line"]), "\n"))
    every = label_paths(spark, sf_dir).join(texts, "o_orderkey", "left")
    return every.select("o_orderkey", "path", F.encode(F.coalesce(said, F.lit("")), "UTF-8").alias("content"))


@query(f"WITH {LABEL_FILES_SQL} SELECT path, (box_number - 1)::INT AS index, class_id, xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax FROM truth")
def label_file_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as label files and read back as ground truth in pixels: classes from 0 that a detector may know or not."""
    lines_of = sources.parsed_labels(sources.annotation_lines(label_files(spark, sf_dir)))
    back = sources.label_boxes(lines_of, F.lit(W), F.lit(H))
    return back.select("path", "index", F.col("class_id").cast("long").alias("class_id"), *[F.round(c, 4).alias(c) for c in CORNERS])


@query(f"WITH {LINES_SQL} SELECT image_id, box_number, class_id % 10 AS class_id, xmin::DOUBLE AS xmin, ymin::DOUBLE AS ymin, xmax::DOUBLE AS xmax, ymax::DOUBLE AS ymax FROM boxes")
def source_truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source annotations with classes from 1 as ground truth with classes from 0."""
    own = boxes(spark, sf_dir).withColumn("class_id", F.col("class_id") % 10 + 1)
    return sources.source_ground_truth(own, F.col("width"), F.col("height")).select("image_id", "box_number", "class_id", *CORNERS)


@query(f"""WITH {LABEL_FILES_SQL}, o AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT 'images' AS figure, '' AS key, count(*) AS n FROM o WHERE k % 4 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'labels', '', count(*) FROM o HAVING count(*) > 0
UNION ALL SELECT 'backgrounds', '', count(*) FROM o WHERE k NOT IN (SELECT image_id FROM boxes) HAVING count(*) > 0 UNION ALL SELECT 'class', class_id::VARCHAR, count(*) FROM truth GROUP BY class_id""")
def label_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an exported tree in which every fourth image is lacking; classes beyond the known ones count, too."""
    paths = label_paths(spark, sf_dir)  # a listing knows no contents
    image = F.regexp_replace(F.regexp_replace("path", "/labels/", "/images/"), r"\.txt$", ".png")
    tree = paths.select("path").unionByName(paths.filter("o_orderkey % 4 <> 0").select(image.alias("path")))
    return sinks.label_tree_totals(sources.label_tree(tree), label_files(spark, sf_dir).select("path", "content"))


@query("""WITH n AS (SELECT CASE page_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpg' WHEN 2 THEN 'txt' ELSE 'other' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'named' ELSE 'numeric' END AS stem FROM pages)
SELECT kind, stem, count(*) AS n FROM n GROUP BY kind, stem""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of four suffixes, every third with a letter in its stem."""
    suffix = F.element_at(F.array(*map(F.lit, [".JPG", ".jpeg", ".txt", ".png"])), (F.col("page_id") % 4 + 1).cast("int"))
    stem = F.concat(F.when(F.col("page_id") % 3 == 0, "p").otherwise(""), F.col("page_id").cast("string"))
    return audit.inventory(table(spark, sf_dir, "pages").select(F.concat(F.lit("/site/"), stem, suffix).alias("path")))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'L' ELSE 'RGB' END AS mode, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1")
def mode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images of two modes, every fourth unreadable."""
    key = F.col("doc_id") % 4
    return audit.mode_histogram(table(spark, sf_dir, "documents").select(F.when(key == 1, "L").when(key != 0, "RGB").alias("mode")))


class Ruled:
    """A detector whose boxes follow from the number that names an image: three apart from each other and one that mostly covers the first."""

    names = {k: f"class {k}" for k in range(12)}
    device = "rule"

    def predict(self, paths: list[str]) -> list[prediction.Found]:
        return [self._one(int(path.rsplit("/", 1)[1].split(".")[0])) for path in paths]

    def _one(self, k: int) -> prediction.Found:
        boxes = [(60.0 * j, 10.0, 60.0 * j + 50, 60.0) for j in range(3)] + [(2.0, 10.0, 52.0, 60.0)]
        return prediction.Found(W, H, boxes, [(k + j) % 12 for j in range(3)] + [k % 12], [(k + 31 * j) % 100 / 100 for j in range(4)])


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (
    SELECT k, j, CASE WHEN j = 3 THEN k % 12 ELSE (k + j) % 12 END AS c, ((k + 31 * j) % 100) / 100.0::DOUBLE AS p, CASE WHEN j = 3 THEN 2 ELSE 60 * j END AS x FROM o, range(4) r(j)
), strong AS (SELECT * FROM b WHERE p > 0.25::DOUBLE), kept AS (
    SELECT * FROM strong s WHERE NOT (j IN (0, 3) AND EXISTS (SELECT 1 FROM strong t WHERE t.k = s.k AND t.j = 3 - s.j AND t.p > s.p))
) SELECT printf('%d_det_%04d', k, row_number() OVER (PARTITION BY k ORDER BY p DESC) - 1) AS detection_id, k::VARCHAR AS image_id, c::INT AS predicted_class_id, 'class ' || c AS predicted_class_name, p AS confidence,
    x::DOUBLE AS xmin, 10::DOUBLE AS ymin, (x + 50)::DOUBLE AS xmax, 60::DOUBLE AS ymax FROM kept""")
def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images through a detector, with the thresholds of a run: weak boxes go, then those that a stronger one of their class covers."""
    images = table(spark, sf_dir, "orders").select("o_orderkey").distinct().select(F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("/set/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))
    raw = prediction.predict(images, Ruled, prediction.Options(confidence=0.25, overlap=0.7))
    return prediction.detection_table(raw.withColumn("image_id", text.stem(F.col("path"))), Ruled.names)


# -- constraints ----------------------------------------------------------------------------


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def referential_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    english = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return constraints.unresolved(table(spark, sf_dir, "labels"), "doc_id", english, "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT o_orderkey, claimed, actual FROM (SELECT o_orderkey, o_orderkey % 7 AS claimed, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) WHERE claimed <> actual")
def count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("c")).distinct()
    return constraints.count_mismatch(parents, table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "c")


INFERENCE_SQL = f"""{PAIRS_SQL}, images AS (SELECT image_id::VARCHAR AS image_id, CASE WHEN image_id % 11 = 0 THEN '' ELSE 'd' END AS dataset_id, 70 AS w, count(*) - (image_id % 5 = 0)::INT AS claimed, count(*) AS actual FROM det GROUP BY det.image_id)"""


@query(f"""WITH {INFERENCE_SQL}
SELECT 2 AS rule, image_id AS place, 'no dataset id: ' || image_id AS message FROM images WHERE dataset_id = ''
UNION ALL SELECT 10, detection_id, 'box outside its image: ' || detection_id FROM det WHERE NOT (xmin >= 0 AND xmin < xmax AND xmax <= 70 AND ymin >= 0 AND ymin < ymax AND ymax <= 70)
UNION ALL SELECT 11, image_id, 'prediction count of ' || image_id || ': ' || claimed || ' claimed, ' || actual || ' found' FROM images WHERE claimed <> actual""")
def inference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images count as 70 by 70, one in eleven has no dataset, one in five claims too few detections."""
    return constraints.inference_violations(*_inference(spark, sf_dir))


def _inference(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = detections(spark, sf_dir).withColumns({"image_id": F.col("image_id").cast("string"), "predicted_class_name": F.concat(F.lit("c"), F.col("predicted_class_id").cast("string"))})
    n = F.col("image_id").cast("long")
    images = found.groupBy("image_id").agg(F.count("*").alias("n")).select("image_id", F.when(n % 11 == 0, "").otherwise("d").alias("dataset_id"), F.lit("external").alias("source_split"), F.lit(70).alias("image_width"), F.lit(70).alias("image_height"), (F.col("n") - (n % 5 == 0).cast("int")).cast("int").alias("prediction_count"))
    return images, found


@query(f"WITH {INFERENCE_SQL} SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM det) AS detections, (SELECT count(*) FROM images WHERE claimed = 0) AS images_without_detections")
def inference_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.inference_totals(*_inference(spark, sf_dir))


@query(f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE {SPLIT} = 'test')")
def held_out_guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "labels").select("doc_id", rule_split(F.col("doc_id")).alias("split"))
    return constraints.held_out(table(spark, sf_dir, "documents").select("doc_id"), manifest, "doc_id")


# -- text formats ---------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN printf('(%d,%d),(%d %d),1', o_orderkey % 50, 1, 2, 3) ELSE printf('( %d , %d ),(%d,%d), %d ', o_orderkey % 50, o_custkey % 50, o_orderkey % 50 + 9, o_custkey % 50 + 9, o_orderkey % 12) END AS raw FROM orders)
SELECT k::VARCHAR AS path, 1 AS line, trim(raw) AS said, k % 9 <> 0 AS valid, CASE WHEN k % 9 <> 0 THEN regexp_extract(raw, '(\\d+)\\s*,\\s*(\\d+)\\s*\\),\\(', 1)::BIGINT END AS xmin, CASE WHEN k % 9 <> 0 THEN regexp_extract(raw, '(\\d+)\\s*,\\s*(\\d+)\\s*\\),\\(', 2)::BIGINT END AS ymin,
    CASE WHEN k % 9 <> 0 THEN regexp_extract(raw, '\\),\\((\\d+),(\\d+)', 1)::BIGINT END AS xmax, CASE WHEN k % 9 <> 0 THEN regexp_extract(raw, '\\),\\((\\d+),(\\d+)', 2)::BIGINT END AS ymax, CASE WHEN k % 9 <> 0 THEN regexp_extract(raw, '(\\d+)\\s*$', 1)::BIGINT END AS class_id FROM l""")
def annotation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of source annotation per order; one in nine lacks a comma."""
    k, c = F.col("o_orderkey") % 50, F.col("o_custkey") % 50
    good = F.format_string("( %d , %d ),(%d,%d), %d ", k, c, k + 9, c + 9, F.col("o_orderkey") % 12)
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.format_string("(%d,%d),(%d %d),1", k, F.lit(1), F.lit(2), F.lit(3))).otherwise(good)
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode(F.concat(raw, F.lit("\r\n")), "UTF-8").alias("content"))
    return sources.parsed_annotations(sources.annotation_lines(files))


@query("""WITH l AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN '1 0.5 0.5 0.2' WHEN 1 THEN '1 0.5 x 0.2 0.2' WHEN 2 THEN '1 nan 0.5 0.2 0.2' WHEN 3 THEN '12 0.5 0.5 0.2 0.2' WHEN 4 THEN '1 1.5 0.5 0.2 0.2' WHEN 5 THEN '1 0.05 0.5 0.2 0.2' ELSE '1 0.5 0.5 0.2 0.2' END AS said, o_orderkey % 8 AS m FROM orders)
SELECT o_orderkey::VARCHAR AS path, 1 AS line, said, CASE m WHEN 0 THEN 'expected 5 fields' WHEN 1 THEN 'non-numeric value' WHEN 2 THEN 'non-finite value' WHEN 3 THEN 'invalid class' WHEN 4 THEN 'normalized value outside range;box outside image' WHEN 5 THEN 'box outside image' ELSE '' END AS issues FROM l""")
def yolo_label_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label line per order, six of eight wrong in some way."""
    said = ["1 0.5 0.5 0.2", "1 0.5 x 0.2 0.2", "1 nan 0.5 0.2 0.2", "12 0.5 0.5 0.2 0.2", "1 1.5 0.5 0.2 0.2", "1 0.05 0.5 0.2 0.2", "1 0.5 0.5 0.2 0.2", "1 0.5 0.5 0.2 0.2"]
    raw = F.element_at(F.array(*map(F.lit, said)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content"))
    return sources.parsed_labels(sources.annotation_lines(files)).select("path", "line", "said", F.concat_ws(";", "issues").alias("issues"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' #' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS safe FROM part")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.safe_name(F.concat("p_name", F.lit(" #"), "p_type")).alias("safe"))


@query("SELECT o_orderkey, printf('%s_%06d_%s', 'set', o_orderkey, o_orderstatus) AS image_id, printf('%d_det_%04d', o_custkey, o_orderkey) AS detection_id FROM orders")
def padded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%s_%06d_%s", F.lit("set"), key, "o_orderstatus").alias("image_id"), text.numbered(F.col("o_custkey"), "det", key).alias("detection_id"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false WHEN 5 THEN false END AS flag FROM events")
def parse_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ["true", " 1", "YES", "false", "0 ", "No", "maybe"])), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.flag(said).alias("flag"))


@query("SELECT page_id, (row_number() OVER (ORDER BY string_split(url, '/'), page_id) - 1)::BIGINT AS ordinal FROM pages")
def path_component_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.with_ordinal(table(spark, sf_dir, "pages").select("page_id", "url"), [text.components(F.col("url")), F.col("page_id")]).select("page_id", "ordinal")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
