"""Queries of the geometry operators on rectangles derived by integer arithmetic from part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial
from ..operators.suppression import suppress
from ..operators.vision import BACK, FRONT
from . import query, rows_of, table

ELEMENTS = "(SELECT p_partkey AS id, p_partkey // 40 AS page_id, (p_partkey * 37) % 1200 AS x, (p_partkey * 91) % 700 AS y, 20 + (p_partkey * 13) % 300 AS w, 16 + (p_partkey * 7) % 120 AS h FROM part)"
VISUALS = "(SELECT s_suppkey AS vid, s_suppkey // 2 AS page_id, (s_suppkey * 53) % 1200 AS vx, (s_suppkey * 29) % 700 AS vy, 30 + (s_suppkey * 17) % 200 AS vw, 20 + (s_suppkey * 11) % 80 AS vh FROM supplier)"
INTER = "greatest(0, least(x + w, vx + vw) - greatest(x, vx)) * greatest(0, least(y + h, vy + vh) - greatest(y, vy))"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 40).alias("page_id"), G.rect(k * 37 % 1200, k * 91 % 700, 20 + k * 13 % 300, 16 + k * 7 % 120).alias("rect"))


def visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("vid"), F.floor(k / 2).alias("page_id"), G.rect(k * 53 % 1200, k * 29 % 700, 30 + k * 17 % 200, 20 + k * 11 % 80).alias("vrect"))


def flat(r: str) -> list:
    return [F.col(f"{r}.{k}").alias(k) for k in ("x", "y", "width", "height")]


@query(f"SELECT id, CAST(floor((x - 600) / 4.0 + 0.5) AS INT) AS x, CAST(floor((y - 350) / 4.0 + 0.5) AS INT) AS y, CAST(floor(w / 4.0 + 0.5) AS INT) AS width, CAST(floor(h / 4.0 + 0.5) AS INT) AS height FROM {ELEMENTS}")
def g1_round_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    part = G.rect((r["x"] - 600) / 4, (r["y"] - 350) / 4, r["width"] / 4, r["height"] / 4)
    return elements(spark, sf_dir).select("id", G.rounded(part).alias("r")).select("id", *flat("r"))


PAIRS = f"(SELECT * FROM {ELEMENTS} e JOIN {VISUALS} v USING (page_id))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).join(visuals(spark, sf_dir), "page_id")


@query(f"SELECT id, vid, CASE WHEN w * h + vw * vh - {INTER} > 0 THEN ({INTER}) / CAST(w * h + vw * vh - {INTER} AS DOUBLE) ELSE 0.0 END AS iou FROM {PAIRS} WHERE {INTER} > 0")
def g2_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("rect"), F.col("vrect")
    return pairs(spark, sf_dir).filter(G.intersection(a, b) > 0).select("id", "vid", G.iou(a, b).alias("iou"))


@query(f"SELECT id, vid, CAST({INTER} AS BIGINT) AS common, CASE WHEN {INTER} > 0 THEN ({INTER}) / CAST(vw * vh AS DOUBLE) ELSE 0.0 END AS score FROM {PAIRS}")
def g3_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("rect"), F.col("vrect")
    return pairs(spark, sf_dir).select("id", "vid", G.intersection(a, b).cast("long").alias("common"), G.overlap(a, b).alias("score"))


@query(f"SELECT id, vid, ({INTER}) / CAST(vw * vh AS DOUBLE) AS visual_inside, ({INTER}) / CAST(w * h AS DOUBLE) AS element_inside FROM {PAIRS} WHERE {INTER} > 0")
def g4_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("rect"), F.col("vrect")
    return pairs(spark, sf_dir).filter(G.intersection(a, b) > 0).select("id", "vid", G.containment(b, a).alias("visual_inside"), G.containment(a, b).alias("element_inside"))


@query(f"SELECT id, vid, CAST(greatest(0, vx - (x + w), x - (vx + vw)) AS BIGINT) AS gap_x, CAST(greatest(0, vy - (y + h), y - (vy + vh)) AS BIGINT) AS gap_y, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM {PAIRS}")
def g5_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("rect"), F.col("vrect")
    return pairs(spark, sf_dir).select("id", "vid", G.gap_x(a, b).cast("long").alias("gap_x"), G.gap_y(a, b).cast("long").alias("gap_y"), G.centre_x(a).alias("cx"), G.centre_y(a).alias("cy"))


@query(f"SELECT id, CAST(trunc(x + 0.7) AS INT) AS x, CAST(trunc(y + 0.2) AS INT) AS y, CAST(trunc(x + w + 0.9) AS INT) - CAST(trunc(x + 0.7) AS INT) AS width, CAST(trunc(y + h + 0.1) AS INT) - CAST(trunc(y + 0.2) AS INT) AS height, round_even(CAST(x AS DOUBLE) / 1280, 4) AS nx, round_even(CAST(h AS DOUBLE) / 720, 4) AS nh FROM {ELEMENTS}")
def g6_convert_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    c = G.from_corners(r["x"] + 0.7, r["y"] + 0.2, G.right(r) + 0.9, G.bottom(r) + 0.1)
    return elements(spark, sf_dir).select("id", c.alias("c"), G.normalised(r, 1280, 720).alias("n")).select("id", *flat("c"), F.col("n.x").alias("nx"), F.col("n.height").alias("nh"))


@query(f"SELECT id, CAST(floor(x * 0.5 + 0.5) AS INT) AS x, CAST(floor(y * 0.75 + 0.5) AS INT) AS y, greatest(1, CAST(floor(w * 0.5 + 0.5) AS INT)) AS width, greatest(1, CAST(floor(h * 0.75 + 0.5) AS INT)) AS height FROM {ELEMENTS}")
def g7_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", G.scaled(F.col("rect"), 0.5, 0.75).alias("r")).select("id", *flat("r"))


@query(f"""SELECT page_id, CAST(x0 AS INT) AS x, CAST(y0 AS INT) AS y, CAST(greatest(0, x1 - x0) AS INT) AS width, CAST(greatest(0, y1 - y0) AS INT) AS height FROM (SELECT page_id, greatest(0, floor(l - greatest(5.0::DOUBLE, (r - l) * 0.16::DOUBLE))) AS x0, greatest(0, floor(t - greatest(5.0::DOUBLE, (b - t) * 0.22::DOUBLE))) AS y0, least(1280, ceil(r + greatest(5.0::DOUBLE, (r - l) * 0.16::DOUBLE))) AS x1, least(720, ceil(b + greatest(5.0::DOUBLE, (b - t) * 0.22::DOUBLE))) AS y1
FROM (SELECT page_id, min(x / 1280::DOUBLE) * 1280 AS l, max(x / 1280::DOUBLE) * 1280 AS r, min(y / 720::DOUBLE) * 720 AS t, max(y / 720::DOUBLE) * 720 AS b FROM {ELEMENTS} WHERE id % 200 < 60 GROUP BY page_id))""")
def g8_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir).filter("id % 200 < 60").groupBy("page_id").agg(F.collect_list(F.col("rect.x") / 1280).alias("xs"), F.collect_list(F.col("rect.y") / 720).alias("ys"))
    return e.select("page_id", G.landmarks_box(F.col("xs"), F.col("ys"), 1280, 720).alias("r")).select("page_id", *flat("r"))


@query(f"SELECT id, x0 AS x, y0 AS y, r0 - x0 AS width, b0 - y0 AS height FROM (SELECT id, CAST(greatest(0, floor(x / 2.0 + 10 - 4)) AS INT) AS x0, CAST(greatest(0, floor(y / 2.0 + 20 - 3)) AS INT) AS y0, CAST(least(500, ceil((x + w) / 2.0 + 10 + 4)) AS INT) AS r0, CAST(least(300, ceil((y + h) / 2.0 + 20 + 3)) AS INT) AS b0 FROM {ELEMENTS}) WHERE r0 > x0 AND b0 > y0")
def g9_line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    box = G.line_box(r["x"], r["y"], G.right(r), G.bottom(r), 2.0, 10, 20, 500, 300)
    return elements(spark, sf_dir).select("id", box.alias("r")).filter("r IS NOT NULL").select("id", *flat("r"))


ZONES = [*FRONT[:2], BACK[0]]


@query(" UNION ALL ".join(f"SELECT id, '{c}' AS category, CAST(greatest(0, floor(x + w * {x}::DOUBLE + 0.5)) AS INT) AS x, CAST(greatest(0, floor(y + h * {y}::DOUBLE + 0.5)) AS INT) AS y, CAST(floor(w * {w}::DOUBLE + 0.5) AS INT) AS width, CAST(floor(h * {h}::DOUBLE + 0.5) AS INT) AS height FROM {ELEMENTS}" for c, x, y, w, h in ZONES))
def g10_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = F.array(*[F.struct(F.lit(c).alias("category"), G.zone(F.col("rect"), *z).alias("r")) for c, *z in ZONES])
    return elements(spark, sf_dir).select("id", F.explode(zones).alias("z")).select("id", "z.category", *flat("z.r"))


@query(f"SELECT id, least(8, greatest(2, CAST(floor(least(w, h) * 0.08::DOUBLE + 0.5) AS INT))) AS margin, least(18, greatest(4, CAST(floor(greatest(w, h) * 0.08::DOUBLE + 0.5) AS INT))) AS blur FROM {ELEMENTS}")
def g11_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("id", G.redaction_margin(F.col("rect")).alias("margin"), G.blur_radius(F.col("rect")).alias("blur"))


@query(f"SELECT page_id, id FROM {ELEMENTS} e WHERE EXISTS (SELECT 1 FROM {VISUALS} v WHERE v.page_id = e.page_id AND (abs(x - vx) < 3 AND abs(y - vy) < 3 AND abs(w - vw) < 3 AND abs(h - vh) < 3 OR vx >= x AND vy >= y AND vx + vw <= x + w AND vy + vh <= y + h))")
def j5_rect_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = elements(spark, sf_dir), visuals(spark, sf_dir).withColumnRenamed("page_id", "_p")
    return e.join(v, (F.col("page_id") == F.col("_p")) & G.same_place(F.col("rect"), F.col("vrect")), "left_semi").select("page_id", "id")


@query(f"SELECT page_id, id, vid, ({INTER}) / CAST(vw * vh AS DOUBLE) AS score FROM {PAIRS} WHERE ({INTER}) / CAST(vw * vh AS DOUBLE) >= 0.3")
def j6_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_join(elements(spark, sf_dir), visuals(spark, sf_dir)).select("page_id", "id", "vid", "score")


@query(f"""WITH c AS (SELECT *, abs(x + w / 2.0 - vx - vw / 2.0) AS dx, abs(y + h / 2.0 - vy - vh / 2.0) AS dy, greatest(0, vx - (x + w), x - (vx + vw)) AS gx, greatest(0, vy - (y + h), y - (vy + vh)) AS gy, x >= vx + vw - 5 AS beside, y >= vy + vh - 5 AS below FROM {PAIRS}),
s AS (SELECT vid, id, page_id, dx + dy + gx + gy - CASE WHEN beside THEN greatest(0, 50 - dy) ELSE 0 END - CASE WHEN below THEN greatest(0, 50 - dx) ELSE 0 END AS score FROM c WHERE (beside OR below) AND dx + dy + gx + gy <= 1280 * 0.35)
SELECT page_id, vid AS label_id, id AS field_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY score, id) AS rn FROM s) WHERE rn = 1""")
def j7_nearest_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = visuals(spark, sf_dir).select("page_id", F.col("vid").alias("label_id"), F.col("vrect").alias("rect"))
    fields = elements(spark, sf_dir).select("page_id", F.col("id").alias("field_id"), F.col("id").alias("ord"), F.col("rect").alias("frect"))
    return spatial.nearest_field(labels, fields, 1280, 720)


@query(f"SELECT id, count(vid) AS n_visual, coalesce(max(CASE WHEN ok THEN score END), 0.0) AS best FROM {ELEMENTS} LEFT JOIN (SELECT id, vid, ({INTER}) / CAST(vw * vh AS DOUBLE) AS score, true AS ok FROM {PAIRS} WHERE ({INTER}) / CAST(vw * vh AS DOUBLE) >= 0.3) USING (id) GROUP BY id")
def j13_element_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    m = spatial.overlap_join(e, visuals(spark, sf_dir)).groupBy("id").agg(F.collect_list(F.struct("vid", "score")).alias("maps"))
    return e.select("id").join(m, "id", "left").select("id", F.coalesce(F.size("maps"), F.lit(0)).cast("long").alias("n_visual"), F.coalesce(F.array_max("maps.score"), F.lit(0.0)).alias("best"))


@query(f"SELECT vid, string_agg(id, ',' ORDER BY score DESC, id) AS ranked FROM (SELECT id, vid, ({INTER}) / CAST(vw * vh AS DOUBLE) AS score FROM {PAIRS}) WHERE score >= 0.3 GROUP BY vid")
def o3_sort_inside_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.overlap_join(elements(spark, sf_dir), visuals(spark, sf_dir)).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("m"))
    return m.select("vid", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("ranked"))


@query(f"SELECT page_id, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + w) - min(x) AS BIGINT) AS width, CAST(max(y + h) - min(y) AS BIGINT) AS height FROM {ELEMENTS} GROUP BY page_id")
def a1_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    e = elements(spark, sf_dir).groupBy("page_id").agg(F.min(r["x"]).alias("x"), F.min(r["y"]).alias("y"), F.max(G.right(r)).alias("r"), F.max(G.bottom(r)).alias("b"))
    return e.select("page_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), (F.col("r") - F.col("x")).cast("long").alias("width"), (F.col("b") - F.col("y")).cast("long").alias("height"))


@query(f"SELECT page_id, count(*) AS visuals, count(DISTINCT vid) FILTER (WHERE id IS NOT NULL) AS mapped, count(id) AS mappings FROM (SELECT v.page_id, v.vid, m.id FROM {VISUALS} v LEFT JOIN (SELECT vid, id FROM {PAIRS} WHERE ({INTER}) / CAST(vw * vh AS DOUBLE) >= 0.3) m USING (vid)) GROUP BY page_id".replace("count(*) AS visuals", "count(DISTINCT vid) AS visuals"))
def a2_mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visuals(spark, sf_dir)
    m = spatial.overlap_join(elements(spark, sf_dir), v).groupBy("vid").agg(F.count("*").alias("n"))
    return v.select("page_id", "vid").join(m, "vid", "left").groupBy("page_id").agg(F.count("*").alias("visuals"), F.count("n").alias("mapped"), F.coalesce(F.sum("n"), F.lit(0)).alias("mappings"))


@query(f"SELECT id FROM {ELEMENTS} WHERE w BETWEEN 80 AND 1280 * 0.95 AND h <= 90")
def p6_row_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    return elements(spark, sf_dir).filter(r["width"].between(80, 1280 * 0.95) & (r["height"] <= 90)).select("id")


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN 'FACE' ELSE 'EMAIL' END AS category, CASE WHEN id % 7 = 0 THEN 'BLUR' ELSE 'BLACKOUT' END AS strategy FROM {ELEMENTS} WHERE w - 30 > 0 AND h - 20 > 0")
def p11_redaction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.redaction import redaction_map

    r = F.col("rect")
    category = F.when(F.col("id") % 7 == 0, "FACE").otherwise("EMAIL")
    found = elements(spark, sf_dir).select("id", category.alias("category"), G.rect(r["x"], r["y"], r["width"] - 30, r["height"] - 20).alias("rect"))
    return redaction_map(found).select("id", "category", "strategy")


@query("SELECT category, CASE WHEN category = 'FACE' THEN 'BLUR' ELSE 'BLACKOUT' END AS strategy FROM (VALUES ('FACE'), ('EMAIL'), ('PERSON')) AS v(category)")
def p12_redaction_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.redaction import strategy

    return rows_of(spark, "category string", [("FACE",), ("EMAIL",), ("PERSON",)]).select("category", strategy(F.col("category")).alias("strategy"))


TILES = f"(SELECT id, page_id, greatest(0, x - 100) AS l, greatest(0, y - 100) AS t, least(800, x - 100 + w) AS r, least(500, y - 100 + h) AS b FROM {ELEMENTS} WHERE w >= 64 AND h >= 64)"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    moved = elements(spark, sf_dir).select("id", "page_id", G.rect(r["x"] - 100, r["y"] - 100, r["width"], r["height"]).alias("rect")).filter((r["width"] >= 64) & (r["height"] >= 64))
    x, y = F.greatest(F.lit(0), r["x"]), F.greatest(F.lit(0), r["y"])
    clipped = moved.select("id", "page_id", G.rect(x, y, F.least(F.lit(800), G.right(r)) - x, F.least(F.lit(500), G.bottom(r)) - y).alias("rect"))
    return clipped.filter((r["width"] >= 64) & (r["height"] >= 64))


@query(f"SELECT id, CAST(l AS BIGINT) AS x, CAST(t AS BIGINT) AS y, CAST(r - l AS BIGINT) AS width, CAST(b - t AS BIGINT) AS height FROM {TILES} WHERE r - l >= 64 AND b - t >= 64")
def p13_image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir).select("id", *[F.col(f"rect.{k}").cast("long").alias(k) for k in ("x", "y", "width", "height")])


@query(f"SELECT page_id, id, rank FROM (SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, id) AS rank FROM {TILES} WHERE r - l >= 64 AND b - t >= 64) WHERE rank <= 14")
def o1_largest_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import top

    return top(tiles(spark, sf_dir), ["page_id"], [G.area(F.col("rect")).desc(), F.col("id")], 14).select("page_id", "id", "rank")


@query(f"SELECT id FROM {ELEMENTS} WHERE w >= greatest(10, 1280 * 0.015) AND h >= greatest(10, 720 * 0.015) AND w * h >= greatest(100, 1280 * 720 * 0.001) AND w * h <= 1280 * 720 * 0.8")
def p14_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    a = G.area(r)
    return elements(spark, sf_dir).filter((r["width"] >= max(10, 1280 * 0.015)) & (r["height"] >= max(10, 720 * 0.015)) & (a >= max(100, 1280 * 720 * 0.001)) & (a <= 1280 * 720 * 0.8)).select("id")


@query(f"SELECT id FROM {ELEMENTS} WHERE w >= 1280 * 0.08 AND h >= 720 * 0.02 AND h <= 720 * 0.20 AND w * 2 >= 3 * greatest(h, 1)")
def p16_input_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    return elements(spark, sf_dir).filter((r["width"] >= 1280 * 0.08) & (r["height"] >= 720 * 0.02) & (r["height"] <= 720 * 0.20) & (r["width"] * 2 >= 3 * F.greatest(r["height"], F.lit(1)))).select("id")


FACE_OK = "w >= 24 AND h >= 24 AND w / greatest(1, h)::DOUBLE BETWEEN 0.48 AND 1.45 AND w <= 300 * 0.68::DOUBLE AND h <= 200 * 0.76::DOUBLE"


@query(f"SELECT id, x0 AS x, y0 AS y, greatest(0, x1 - x0) AS width, greatest(0, y1 - y0) AS height FROM (SELECT id, CAST(greatest(0, floor(x % 200 - greatest(4.0::DOUBLE, w * 0.13::DOUBLE))) AS INT) AS x0, CAST(greatest(0, floor(y % 100 - greatest(4.0::DOUBLE, h * 0.18::DOUBLE))) AS INT) AS y0, CAST(least(300, ceil(x % 200 + w + greatest(4.0::DOUBLE, w * 0.13::DOUBLE))) AS INT) AS x1, CAST(least(200, ceil(y % 100 + h + greatest(4.0::DOUBLE, h * 0.18::DOUBLE))) AS INT) AS y1 FROM {ELEMENTS} WHERE {FACE_OK})")
def p17_face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    box = G.face_box(G.rect(r["x"] % 200, r["y"] % 100, r["width"], r["height"]), 300, 200)
    return elements(spark, sf_dir).select("id", box.alias("r")).filter("r IS NOT NULL").select("id", *flat("r"))


@query("""SELECT scope, id FROM (SELECT p_partkey AS id, p_partkey % 5 = 0 AS pinned, p_partkey = 7 AS current FROM part) t, (VALUES ('all_except_current'), ('all_unpinned_except_current'), ('tab_numbers'), ('tab_range')) AS s(scope)
WHERE CASE scope WHEN 'all_except_current' THEN NOT current WHEN 'all_unpinned_except_current' THEN NOT current AND NOT pinned WHEN 'tab_numbers' THEN id IN (2, 5, 9) ELSE id BETWEEN 3 AND 8 END""")
def p18_tab_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json_plans import tab_selected

    tabs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5 == 0).alias("pinned"), (F.col("p_partkey") == 7).alias("current"))
    scopes = F.explode(F.array(*[F.lit(s) for s in ("all_except_current", "all_unpinned_except_current", "tab_numbers", "tab_range")]))
    rows = tabs.withColumn("scope", scopes)
    chosen = tab_selected(F.col("scope"), F.col("id"), F.col("pinned"), F.col("current"), F.array(F.lit(2), F.lit(5), F.lit(9)), F.lit(8), F.lit(3))
    return rows.filter(chosen).select("scope", "id")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS accepted FROM " + ELEMENTS)
def f7_screenshot_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.redaction import box_ok

    r = F.col("rect")
    bad = F.when(F.col("id") % 7 == 0, F.lit(0)).otherwise(r["width"])
    e = elements(spark, sf_dir).select(box_ok(G.rect(r["x"], r["y"], bad, r["height"])).alias("ok"))
    return e.agg(F.count("*").alias("n"), F.count_if("ok").alias("accepted"))


F20 = [(1, '{"rect": {"x": 1, "y": 2, "width": 3, "height": 4}}'), (2, '{"box": {"x": 1, "y": 2, "x2": 11, "y2": 22}}'), (3, '{"bounding_box": {"x1": 5, "y1": 6, "x2": 8, "y2": 9}}'), (4, '{"boundingBox": null, "rect": {"x": 0, "y": 0, "width": 1, "height": 1}}'), (5, "{}")]


@query("SELECT * FROM (VALUES (1, 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE), (2, 1, 2, 10, 20), (3, 5, 6, 3, 3), (4, 0, 0, 1, 1), (5, NULL, NULL, NULL, NULL)) AS v(id, x, y, width, height)")
def f20_rect_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "id int, j string", F20).select("id", G.any_rect(F.col("j")).alias("r")).select("id", *flat("r"))


def _boxes(spark: SparkSession, sf_dir: str, by: str, page_size: int = 40) -> DataFrame:
    """Boxes with their rank within a page: by arrival, or the largest first."""
    rank = F.struct(F.lit(0).cast("long").alias("o"), "id") if by == "arrival" else F.struct((-G.area(F.col("rect"))).cast("long").alias("o"), "id")
    return elements(spark, sf_dir).select(F.floor(F.col("id") / page_size).alias("page_id"), rank.alias("rank"), "id", "rect", (F.col("id") % 3).alias("type"))


def _overlap(least: float):
    return lambda k, b: G.iou(k["rect"], b["rect"]) >= least


def _greedy(boxes: str, clash: str, order: str = "o, id") -> str:
    """SQL of greedy suppression of ``boxes`` (page_id, o, id, x, y, w, h, t) by a condition on structs k (kept) and b: a box after the other, page by page."""
    return f"""WITH RECURSIVE boxes AS (SELECT page_id, list({{'id': id, 'x': x, 'y': y, 'w': w, 'h': h, 't': t}} ORDER BY {order}) AS bs FROM {boxes} GROUP BY page_id),
steps AS (SELECT page_id, bs, 0 AS i, bs[1:0] AS kept FROM boxes UNION ALL SELECT page_id, bs, i + 1, CASE WHEN len(list_filter(kept, lambda k: {clash.replace("b.", "bs[i + 1].")})) > 0 THEN kept ELSE list_append(kept, bs[i + 1]) END FROM steps WHERE i < len(bs))
SELECT page_id, b.id AS id, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.t AS t FROM (SELECT page_id, unnest(kept) AS b FROM steps WHERE i = len(bs))"""


_SHARED = "(greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)))"
_IOU = f"{_SHARED} / (k.w * k.h + b.w * b.h - {_SHARED})"
_BY_ID = f"(SELECT *, id AS o, id % 3 AS t FROM {ELEMENTS})"
_BY_AREA = f"(SELECT *, -w * h AS o, id % 3 AS t FROM {ELEMENTS})"


@query(f"SELECT page_id, id FROM ({_greedy(f'(SELECT * FROM {_BY_ID} WHERE w >= 12 AND h >= 12)', _IOU + ' >= 0.42')})")
def w2_face_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = _boxes(spark, sf_dir, "arrival").filter("rect.width >= 12 AND rect.height >= 12")
    return suppress(big, _overlap(0.42)).select("page_id", "id")


@query(f"SELECT page_id, id FROM ({_greedy(_BY_AREA, _IOU + ' >= 0.70')})")
def w3_region_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress(_boxes(spark, sf_dir, "area"), _overlap(0.70)).select("page_id", "id")


@query(f"SELECT page_id, id FROM ({_greedy(_BY_ID, _IOU + ' >= 0.85 AND k.t = b.t')})")
def w4_same_type_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress(_boxes(spark, sf_dir, "arrival"), _alike).select("page_id", "id")


def _alike(k, b):
    return (G.iou(k["rect"], b["rect"]) >= 0.85) & (k["type"] == b["type"])


_CONTAINED = f"({_SHARED} / (k.w * k.h) >= 0.90 OR {_SHARED} / (b.w * b.h) >= 0.90)"


@query(f"SELECT page_id, id FROM ({_greedy('(SELECT *, -w * h AS o FROM (' + _greedy(_BY_AREA, _CONTAINED) + '))', _IOU + ' >= 0.65')})")
def w5_two_pass_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = suppress(_boxes(spark, sf_dir, "area"), _within)
    return suppress(first, _overlap(0.65)).select("page_id", "id")


def _within(k, b):
    return (G.containment(b["rect"], k["rect"]) >= 0.90) | (G.containment(k["rect"], b["rect"]) >= 0.90)


_CROWDED = f"(SELECT * REPLACE (id // 500 AS page_id) FROM {_BY_AREA})"


@query(f"SELECT page_id, id FROM ({_greedy(_CROWDED, _IOU + ' >= 0.42')})")
def w3_crowded_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five hundred boxes, by rounds over their conflicts."""
    return suppress(_boxes(spark, sf_dir, "area", 500), _overlap(0.42)).select("page_id", "id")


#: Styles by the part's key: padding to the left 0 to 6 or unset, an indent and a line height for some.
STYLE = "struct(CASE WHEN k % 7 > 0 THEN k % 7 + 0.5D END AS left, CASE WHEN k % 5 > 0 THEN double(k % 5) END AS right, 2.0D AS top, 1.5D AS bottom, CASE WHEN k % 3 = 0 THEN 10.0D END AS indent, CASE WHEN k % 4 = 1 THEN 18.0D END AS line_height, CASE WHEN k % 2 = 0 THEN 13.0D END AS font_size)"
_STYLED = f"""(SELECT *, CASE WHEN k % 7 > 0 THEN k % 7 + 0.5 ELSE 0 END AS pl, k % 5 AS pr, CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END AS ti, CASE WHEN k % 4 = 1 THEN 18.0 WHEN k % 2 = 0 THEN 16.25 ELSE 20.0 END AS lh FROM (SELECT e.*, id AS k, length(p_name) AS n FROM {ELEMENTS} e JOIN part ON id = p_partkey))"""
_LINED = f"(SELECT *, greatest(1.0, w - pl - pr - ti - 4) AS room, least(h - 2.0, greatest(10.0, lh)) AS th FROM {_STYLED})"


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"))
    return elements(spark, sf_dir).join(values, "id").withColumn("k", F.col("id")).withColumn("style", F.expr(STYLE))


@query(f"""SELECT id, CAST(floor(x + pl + CASE WHEN k % 6 = 5 THEN 0 ELSE ti END + 0.5) AS INT) AS x, CAST(CASE WHEN k % 6 = 5 THEN floor(y + 2.5) ELSE floor(y + (h - th) / 2 + 0.5) END AS INT) AS y,
CAST(CASE WHEN k % 6 = 5 THEN greatest(1, floor(w - pl - pr + 0.5)) ELSE greatest(1, floor(least(room, greatest(8, 8 * n + 4)) + 0.5)) END AS INT) AS width, CAST(CASE WHEN k % 6 = 5 THEN greatest(1, floor(h - 3.5 + 0.5)) ELSE greatest(1, floor(th + 0.5)) END AS INT) AS height FROM {_LINED}""")
def g12_value_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of input values with paddings, indents and line heights; every sixth is a field of several lines."""
    rows = styled(spark, sf_dir).select("id", G.value_box(F.col("rect"), F.col("value"), F.col("k") % 6 == 5, F.col("style")).alias("r"))
    return rows.select("id", *flat("r"))


@query(f"""SELECT id, CAST(floor(x + pl + ti + least(8 * (k % 3), room) + 0.5) AS INT) AS x, CAST(floor(y + (h - th) / 2 + 0.5) AS INT) AS y, CAST(greatest(1, floor(least(8 * 4 + 4.0, room) + 0.5)) AS INT) AS width, CAST(floor(th + 0.5) AS INT) AS height FROM {_LINED}""")
def g12_match_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of four characters of each input's value."""
    start = (F.col("k") % 3).cast("int")
    return styled(spark, sf_dir).select("id", G.match_box(F.col("rect"), start, start + 4, F.col("style")).alias("r")).select("id", *flat("r"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS text_id FROM events, (SELECT max(value) AS top FROM events) WHERE value / top >= 0.30 AND trim(event_type) <> ''""")
def p15_confident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule by a column that the table has: an event's value as a share of the largest."""
    from ..operators.vision import confident

    e = table(spark, sf_dir, "events")
    top = e.agg(F.max("value")).first()[0]
    rows = e.select("user_id", "event_id", F.col("event_type").alias("text"), (F.col("value") / F.lit(top)).alias("confidence"))
    return confident(rows, "user_id", "event_id").select("user_id", "event_id", "text_id")
