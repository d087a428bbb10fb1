"""Readers, joins and sinks over tables of release shape derived from the supplied ones."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from swathline import config as C
from swathline.functions import headers as H
from swathline.operators import change as CH
from swathline.operators import ranking as RK
from swathline.operators import sampling as SM
from swathline.plans.pixel_queries import PATCH_IJ
from swathline.plans.question_queries import CLASS_SQL, LABELS, labels
from swathline.plans.registry import query
from swathline.plans.stats_queries import KEYS, SCENE
from swathline.plans.validate_queries import MASKED, scene_headers, scene_masks
from swathline.plans.views import VIEWS, ctes
from swathline.sources import readers as RD
from swathline.sources import writers as WR

col = F.col


def body(cte):
    """Statement inside ``name AS (...)``; decimal points stay as written."""
    return cte[cte.index("(") + 1 : -1]


MANI = """mn AS (SELECT CAST(o_orderkey AS STRING) AS sample_id, CASE WHEN o_custkey % 4 = 0 THEN 'change_vqa' ELSE 'rs_vqa' END AS adapter, o_orderpriority AS task, concat('img', CAST(o_custkey AS STRING)) AS image,
 concat('Q', CAST(o_orderkey % 50 AS STRING)) AS question, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS answer, CASE WHEN o_custkey % 50 < 8 THEN 'val' ELSE 'train' END AS split FROM orders)"""


def manifest_rows(v):
    rows = v.sql(body(MANI))
    return rows.select("sample_id", "adapter", "task", F.array("image").alias("images"), "question", "answer", "split")


@query("SRC01_read_manifest", "WITH " + MANI + " SELECT sample_id, task, image, question, answer FROM mn WHERE adapter = 'rs_vqa' AND split = 'val'")
def src01(v):
    """Written as JSON lines by the sink, then read back under the strict schema."""
    path = scratch(v, "manifest")
    WR.write_json_manifest(manifest_rows(v), path)
    rows = RD.read_manifest(v.spark, path, adapter="rs_vqa", split="val")
    return rows.select("sample_id", "task", F.get("images", F.lit(0)).alias("image"), "question", "answer")


def scratch(v, name):
    """A new folder beside the shared checkpoint folder, or a temporary one in local mode."""
    import uuid

    shared = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not v.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp") + "/data"


ANNO = """an AS (SELECT CAST(o_orderkey AS STRING) AS patch_id, concat('in', CAST(o_custkey AS STRING)) AS input, o_orderstatus AS output, 'mcq' AS type, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '' WHEN 3 THEN 'Country' WHEN 4 THEN 'climate zone' ELSE 'presence' END AS category,
 CASE WHEN o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'Austria' AS country, 'summer' AS season, 'Cfb' AS climate_zone, o_totalprice AS unused FROM orders)"""


@query("SRC02_read_annotation_parquet", "WITH " + ANNO + " SELECT patch_id, input, output, coalesce(nullif(nullif(category, 'None'), ''), 'caption') AS category FROM an WHERE split = 'train' AND lower(coalesce(nullif(nullif(category, 'None'), ''), 'caption')) NOT IN ('country', 'season', 'climate zone')")
def src02(v):
    """The release is written with all its columns; the reader takes nine of them and one split from the files."""
    path = scratch(v, "annotations")
    v.sql(body(ANNO)).write.parquet(path)
    return RD.read_annotation_parquet(v.spark, path, "train").select("patch_id", "input", "output", "category")


@query("SRC03_read_footprints_geojson", "SELECT c_custkey AS obj_id, (c_custkey % 90 + c_custkey % 90 + 4 + c_custkey % 90 + 2) / 3.0 AS x, (c_custkey % 70 + c_custkey % 70 + c_custkey % 70 + 6) / 3.0 AS y FROM customer")
def src03(v):
    """Feature collections, one file each, written as JSON and read back strictly as whole documents."""
    k = col("c_custkey")
    point = lambda x, y: F.array((x).cast("double"), (y).cast("double"))
    ring = F.array(point(k % 90, k % 70), point(k % 90 + 4, k % 70), point(k % 90 + 2, k % 70 + 6))
    feature = F.struct(F.struct(k.alias("Id")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    path = scratch(v, "footprints")
    # Small documents: a few features each, whatever the size of a nation.
    docs = v.customer.groupBy((k % 20).alias("g"), F.floor(k / 2000).alias("h")).agg(F.collect_list(feature).alias("features"))
    docs.select("features").write.option("maxRecordsPerFile", 1).json(path)
    return RD.read_footprints_geojson(v.spark, path)


COCO = "co AS (SELECT l_orderkey AS image_id, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'cargo' WHEN 1 THEN 'civil' ELSE 'light' END AS role, l_quantity AS x, l_discount * 100 AS y, 5.0 AS w, 6.0 AS h, l_tax > 0.05 AS truncated FROM lineitem)"


def coco(v):
    k = col("l_linenumber") % 3
    role = F.when(k == 0, "cargo").when(k == 1, "civil").otherwise("light")
    box_id = F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return v.lineitem.select(col("l_orderkey").alias("image_id"), box_id.alias("box_id"), role.alias("role"), col("l_quantity").alias("x"), (col("l_discount") * 100).alias("y"), F.lit(5.0).alias("w"), F.lit(6.0).alias("h"), (col("l_tax") > 0.05).alias("truncated"))


@query("SRC04_read_coco_boxes", "WITH " + COCO + " SELECT o_orderkey AS image_id, count(image_id) AS n, coalesce(count(*) FILTER (truncated), 0) AS truncated, min(role) AS first_role FROM orders LEFT JOIN co ON image_id = o_orderkey WHERE o_custkey % 4 > 0 GROUP BY o_orderkey")
def src04(v):
    images = v.orders.select(col("o_orderkey").alias("image_id"))
    listed = v.orders.where("o_custkey % 4 > 0").select(col("o_orderkey").alias("image_id"))
    out = RD.coco_boxes(images, coco(v), listed)
    cut = F.size(F.filter("boxes", lambda b: b["truncated"])).cast("long")
    return out.groupBy("image_id").agg(
        F.coalesce(F.sum(F.when(col("boxes").isNotNull(), F.size("boxes").cast("long"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(col("boxes").isNotNull(), cut)), F.lit(0)).alias("truncated"),
        F.min(F.array_min(F.transform("boxes", lambda b: b["role"]))).alias("first_role"),
    )


@query("SRC04_listed_gap", "SELECT o_orderkey AS image_id FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 5 = 0")
def src04_gap(v):
    """Tiles that a list names and the image table lacks."""
    images = v.orders.where("o_custkey % 4 > 0").select(col("o_orderkey").alias("image_id"))
    return RD.listed_gap(images, v.orders.where("o_orderkey % 5 = 0").select(col("o_orderkey").alias("image_id")))


def release(v):
    questions = v.orders.select(col("o_orderkey").alias("question_id"), col("o_custkey").alias("image_id"), col("o_orderpriority").alias("type"), (col("o_orderkey") % 10 > 0).alias("active"))
    answers = v.orders.where("o_orderkey % 7 > 0").select(col("o_orderkey").alias("question_id"), col("o_orderstatus").alias("answer"))
    images = v.customer.select(col("c_custkey").alias("image_id"), col("c_name").alias("file"))
    splits = v.customer.select(col("c_custkey").alias("image_id"), F.when(col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"), (col("c_custkey") % 9 > 0).alias("active"))
    return questions, answers, images, splits


RELEASE_SQL = "SELECT o_orderkey AS question_id, o_custkey AS image_id, o_orderpriority AS type, o_orderstatus AS answer, c_name AS file, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 10 > 0 AND o_orderkey % 7 > 0 AND c_custkey % 9 > 0"


@query("SRC05_read_vqa_release", RELEASE_SQL)
def src05(v):
    return RD.vqa_release(*release(v)).select("question_id", "image_id", "type", "answer", "file", "split")


@query("JN01_qa_release_join", RELEASE_SQL.replace("SELECT o_orderkey AS question_id, o_custkey AS image_id, o_orderpriority AS type, o_orderstatus AS answer, c_name AS file, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split", "SELECT o_orderpriority AS type, count(*) AS n, count(DISTINCT o_custkey) AS images") + " GROUP BY o_orderpriority")
def jn01(v):
    return RD.vqa_release(*release(v)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


@query("JN06_missing_rows", "SELECT o_orderkey AS question_id, o_orderpriority AS type FROM orders WHERE o_orderkey % 10 > 0 AND o_orderkey % 7 = 0")
def jn06(v):
    questions, answers, _, _ = release(v)
    return RD.unanswered(questions, answers).select("question_id", "type")


BENCH = """bm AS (SELECT p_partkey AS record_id, CASE p_partkey % 3 WHEN 0 THEN 'vrsbench' ELSE 'own' END AS source, 'train' AS split, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS question, CASE WHEN p_partkey % 2 = 1 THEN p_name ELSE '' END AS query, p_brand AS answer,
 CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS type, p_type AS category, CASE p_partkey % 4 WHEN 0 THEN concat('a/b/img', CAST(p_size AS STRING), '.png') WHEN 1 THEN concat('img', CAST(p_size AS STRING), '.tif') WHEN 2 THEN '' ELSE concat('x/none', CAST(p_size AS STRING), '.png') END AS image, concat('img', CAST(p_size AS STRING)) AS image_id FROM part)"""
ALIASES = {"question": ("question", "query"), "answer": ("answer",), "type": ("type", "category"), "image": ("image", "image_id")}


@query(
    "SRC06_read_generic_benchmark",
    "WITH " + BENCH + ", fl AS (SELECT DISTINCT concat('img', p_size, '.png') AS file, concat('/data/img', p_size, '.png') AS path FROM part WHERE p_size % 3 > 0)"
    + """, r AS (SELECT *, regexp_extract(coalesce(nullif(image, ''), image_id), '([^/]+)$', 1) AS name FROM bm), s AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM r)
SELECT record_id, coalesce(nullif(question, ''), nullif(query, '')) AS question, answer, coalesce(nullif(type, ''), category) AS type, coalesce(a.path, b.path) AS path, CASE WHEN source = 'vrsbench' THEN 'test' ELSE split END AS split FROM s LEFT JOIN fl a ON a.file = s.name LEFT JOIN fl b ON regexp_replace(b.file, '\\.[^.]*$', '') = s.stem""",
)
def src06(v):
    name = F.concat(F.lit("img"), col("p_size").cast("string"), F.lit(".png"))
    files = v.part.where("p_size % 3 > 0").select(name.alias("file"), F.concat(F.lit("/data/"), name).alias("path")).distinct()
    return RD.benchmark_records(v.sql(body(BENCH)), ALIASES, files, ("vrsbench",))


LISTING = "ls AS (SELECT DISTINCT regexp_extract(url, '//([^/]+)', 1) AS tile, CASE page_id % 3 WHEN 0 THEN 'optical' WHEN 1 THEN 'sar' ELSE 'label' END AS modality FROM pages)"
MODALITIES = ("optical", "sar", "label")


def listing(v):
    modality = F.when(col("page_id") % 3 == 0, "optical").when(col("page_id") % 3 == 1, "sar").otherwise("label")
    return v.pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("tile"), modality.alias("modality"))


@query("SRC07_modality_inventory", "WITH " + LISTING + " SELECT tile, CAST(bool_or(modality = 'optical') AS INT) AS optical, CAST(bool_or(modality = 'sar') AS INT) AS sar, CAST(bool_or(modality = 'label') AS INT) AS label, count(DISTINCT modality) = 3 AS complete FROM ls GROUP BY tile")
def src07(v):
    return RD.modality_inventory(listing(v), "tile", MODALITIES)


@query("SRC07_drop_counts", "WITH " + LISTING + ", t AS (SELECT tile, count(DISTINCT modality) = 3 AS ok FROM ls GROUP BY tile) SELECT (SELECT count(*) FROM t WHERE ok) AS kept, count(*) FILTER (modality = 'optical' AND NOT ok) AS optical_dropped, count(*) FILTER (modality = 'sar' AND NOT ok) AS sar_dropped, count(*) FILTER (modality = 'label' AND NOT ok) AS label_dropped FROM ls JOIN t USING (tile)")
def src07_drops(v):
    return RD.drop_counts(RD.modality_inventory(listing(v), "tile", MODALITIES), MODALITIES)


@query(
    "SRC08_pair_s1_s2",
    ctes("patch", "s2 AS (SELECT DISTINCT patch_id FROM patch WHERE c_custkey % 5 <> 0)")
    + "SELECT p.patch_id, CASE WHEN s2.patch_id IS NOT NULL THEN concat('/s2/', s2.patch_id) END AS s2_path, CASE WHEN c_custkey % 7 <> 0 THEN concat('/s1/S1_', c_custkey) END AS s1_path, s2.patch_id IS NOT NULL AND c_custkey % 7 <> 0 AS paired, c_custkey FROM patch p LEFT JOIN s2 ON s2.patch_id = p.patch_id",
)
def src08(v):
    k = col("c_custkey")
    metadata = v.patch.select("patch_id", F.concat(F.lit("S1_"), k.cast("string")).alias("s1_name"), "c_custkey")
    optical = v.patch.where("c_custkey % 5 <> 0").select(col("patch_id").alias("stem_s2"), F.concat(F.lit("/s2/"), "patch_id").alias("s2_path")).distinct()
    radar = v.patch.where("c_custkey % 7 <> 0").select(F.concat(F.lit("S1_"), k.cast("string")).alias("stem_s1"), F.concat(F.lit("/s1/S1_"), k.cast("string")).alias("s1_path"))
    return RD.pair_s1_s2(metadata, radar, optical).select("patch_id", "s2_path", "s1_path", (col("s1_path").isNotNull() & col("s2_path").isNotNull()).alias("paired"), "c_custkey")


FILES = "fi AS (SELECT o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS side, concat('p', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS path, o_orderkey % 5 > 1 AS readable FROM orders)"


@query("SRC09_first_decodable_pair", "WITH " + FILES + " SELECT name, min(path) FILTER (side = 'before') AS before, min(path) FILTER (side = 'after') AS after FROM fi WHERE readable GROUP BY name HAVING count(*) FILTER (side = 'before') > 0 AND count(*) FILTER (side = 'after') > 0")
def src09(v):
    return RD.first_decodable_pair(v.sql(body(FILES)))


@query("SRC10_pixel_scan", ctes("px") + f"SELECT {KEYS}, r, c, red, nir FROM px WHERE r BETWEEN 4 AND 11 AND c BETWEEN 2 AND 9")
def src10(v):
    """Through the sorted pixel table, whose footers rule out what lies outside the window."""
    path = scratch(v, "pixels")
    WR.write_pixel_table(v.px, SCENE, path)
    return RD.pixel_window(v.spark.read.parquet(path), 4, 2, 8, 8).select(*SCENE, "r", "c", "red", "nir")


@query(
    "SRC11_overview_scan",
    ctes("px", "grid", "oc AS (SELECT CAST(unnest(range(6)) AS BIGINT) AS i)")
    + f"SELECT {KEYS}, a.i AS r, b.i AS c, red, nir FROM oc a CROSS JOIN oc b JOIN grid g ON g.r = floor((a.i + 0.5) * 16 / 6) AND g.c = floor((b.i + 0.5) * 16 / 6)",
)
def src11(v):
    return RD.overview(v.grid, SCENE, 16, 16, 6, ["red", "nir"])


PRODUCTS = """pt AS (SELECT DISTINCT patch_id, string_split(patch_id, '_') AS s FROM patch), gk AS (SELECT DISTINCT s[1] AS mission, s[2] AS level, s[3] AS sensing, s[5] AS orbit, s[6] AS tile FROM pt),
pd AS (SELECT gk.*, b AS baseline, concat(mission, '_', sensing, '_', tile, '_', b) AS product, NOT (b = 'N0500' AND substr(tile, 2, 2) IN ('33', '35')) AND NOT (b = 'N0205' AND substr(tile, 2, 2) IN ('31', '35')) AS online FROM gk, (SELECT unnest(['N0205', 'N0500']) AS b) u WHERE NOT substr(tile, 2, 2) = '37' AND NOT (b = 'N0205' AND substr(tile, 2, 2) = '38'))"""


@query(
    "SRC12_resolve_granule",
    ctes("patch", PRODUCTS, "c AS (SELECT patch_id, count(product) AS m, count(*) FILTER (online) AS l, min(product) FILTER (online) AS p FROM pt LEFT JOIN pd ON s[1] = mission AND s[2] = level AND s[3] = sensing AND s[5] = orbit AND s[6] = tile GROUP BY patch_id)")
    + "SELECT patch_id, m AS matches, CASE WHEN m = 0 THEN 'none' WHEN l = 0 THEN 'all_offline' WHEN l > 1 THEN 'ambiguous' END AS reject, CASE WHEN m > 0 AND l = 1 THEN p END AS product FROM c",
)
def src12(v):
    p = H.parse_patch_id(col("patch_id"))
    parts = ("mission", "level", "sensing", "orbit", "tile")
    patches = v.patch.select("patch_id", *[p[k].alias(k) for k in parts]).distinct()
    zone = F.substring("tile", 2, 2)
    base = patches.select(*parts).distinct().withColumn("b", F.explode(F.array(F.lit("N0205"), F.lit("N0500"))))
    base = base.where((zone != "37") & ~((col("b") == "N0205") & (zone == "38")))
    online = ~((col("b") == "N0500") & zone.isin("33", "35")) & ~((col("b") == "N0205") & zone.isin("31", "35"))
    products = base.select(*parts, F.concat_ws("_", "mission", "sensing", "tile", "b").alias("product"), online.alias("online"))
    return RD.resolve_granule(patches, products)


@query(
    "SNK01_write_manifest",
    "WITH " + MANI + ", c AS (SELECT task, answer, count(*) AS n FROM mn GROUP BY ALL) SELECT task, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_answers, round(100 * max(n) / sum(n), 2) AS blind_ceiling, string_agg(concat(answer, '=', n), ', ' ORDER BY n DESC, answer) AS top FROM c GROUP BY task",
)
def snk01(v):
    path = scratch(v, "corpus")
    WR.write_manifest(manifest_rows(v), path)
    return WR.manifest_summary(v.spark.read.parquet(f"{path}/rows"))


@query(
    "SNK02_write_mask_table",
    ctes("px", "grid", MASKED, f"f AS (SELECT {KEYS}, count(*) AS n, count(*) FILTER (hit) AS p, max(crs) AS crs FROM mk GROUP BY {KEYS})") + f"SELECT {KEYS}, n AS pixels, p AS positive_px FROM f WHERE n = 256 AND crs = 'EPSG:32644'",
)
def snk02(v):
    """Only conforming masks reach the table; the written table is read back."""
    path = scratch(v, "masks")
    WR.write_mask_table(scene_masks(v), scene_headers(v), SCENE, path)
    written = v.spark.read.parquet(path)
    return written.groupBy(col("scene_id").cast("long").alias("scene_id"), "date_idx").agg(F.count("*").alias("pixels"), F.sum(col("hit").cast("long")).alias("positive_px"))


@query(
    "SNK03_batch_answers",
    "SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 11 = 3 OR o_orderkey % 13 = 5 THEN NULL ELSE upper(o_orderpriority) END AS answer, CASE WHEN o_orderkey % 11 = 3 OR o_orderkey % 13 = 5 THEN 'row needs both images and question' END AS error FROM orders",
)
def snk03(v):
    k = col("o_orderkey")
    rows = v.orders.select(k.alias("sample_id"), F.when(k % 11 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("i"))).alias("images"), F.when(k % 13 != 5, col("o_orderpriority")).alias("question"))
    path = scratch(v, "batch")
    WR.write_batch(WR.batch_answers(rows, F.upper("question")), path)
    both = "sample_id long, answer string, error string"
    return v.spark.read.schema(both).json(f"{path}/answers").unionByName(v.spark.read.schema(both).json(f"{path}/errors"))


@query(
    "JN02_prediction_join",
    ctes("pred") + "SELECT concat('cdvqa_val_', lpad(CAST(p.sample_id AS VARCHAR), 7, '0')) AS row_id, p.prediction, o.o_orderpriority AS type, c.c_name AS file FROM pred p JOIN orders o ON o.o_orderkey = p.sample_id JOIN customer c ON c.c_custkey = o.o_custkey",
)
def jn02(v):
    """Prediction rows name their question only in the id suffix."""
    dumped = v.pred.select(F.concat(F.lit("cdvqa_val_"), F.lpad(col("sample_id").cast("string"), 7, "0")).alias("row_id"), "prediction")
    keyed = dumped.withColumn("question_id", F.regexp_extract("row_id", r"_(\d+)$", 1).cast("long"))
    questions, _, images, _ = release(v)
    return keyed.join(questions, "question_id").join(images, "image_id").select("row_id", "prediction", "type", "file")


@query("JN07_staged_filter", ctes("patch") + "SELECT c_custkey, patch_id FROM patch WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def jn07(v):
    staged = v.orders.where("o_orderstatus = 'P'").select(col("o_custkey").alias("c_custkey"))
    return v.patch.join(staged, "c_custkey", "left_semi").select("c_custkey", "patch_id")


@query("JN08_absent_classes", "WITH " + LABELS + f" SELECT patch, unnest(list_filter({CLASS_SQL}, lambda y: NOT list_contains(labels, y))) AS absent FROM lb")
def jn08(v):
    # The vocabulary has a fixed handful of classes, so it rides along as an array.
    vocabulary = F.array(*[F.lit(c) for c in C.LANDCOVER_CLASSES])
    return labels(v).select("patch", F.explode(F.array_except(vocabulary, F.col("labels"))).alias("absent"))


@query("JN09_split_leak_check", ctes("patch") + "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN c_custkey % 15 < 4 THEN 'test' ELSE 'train' END AS official FROM patch WHERE c_custkey % 3 > 0 AND (c_custkey % 5 = 0) <> (c_custkey % 15 < 4)")
def jn09(v):
    k = col("c_custkey")
    manifest = v.patch.select("c_custkey", F.when(k % 5 == 0, "test").otherwise("train").alias("split"))
    official = v.patch.where("c_custkey % 3 > 0").select("c_custkey", F.when(k % 15 < 4, "test").otherwise("train").alias("official"))
    return manifest.join(official, "c_custkey").where("split <> official")


@query("JN10_metadata_compare", "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS subset_rows, (SELECT count(*) FROM customer) AS official_rows, 'c_custkey,c_mktsegment' AS shared_columns, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) = (SELECT count(*) FROM customer) AS identical_row_count")
def jn10(v):
    subset = v.customer.where("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment", F.lit(1).alias("extra"))
    official = v.customer.select("c_custkey", "c_name", "c_mktsegment")
    return CH.metadata_compare(subset, official)
