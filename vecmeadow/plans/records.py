"""Catalogue, metadata, log and report queries on the relational and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmeadow.functions import text as X
from vecmeadow.operators import evaluate as E, report as R, scoring as S
from vecmeadow.plans.registry import Tables, query
from vecmeadow.plans.sql import FIVE_SHOT, UNITS, centroids
from vecmeadow.plans.vectors import FEW_SHOT, MARGIN, THETA, components, five_shot
from vecmeadow.session import scratch_table
from vecmeadow.sources import catalog as C, metadata as M, stores as ST


def values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows) + ")"


CATALOG = f"catalog AS (SELECT * FROM {values(C.default_species())} v(position, species_id, scientific_name, common_name, taxon, band_low, band_high, target))"


@query(
    "s1_labels_with_enough_rows",
    "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 48",
)
def _(t):
    counts = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 48")
    return t.embeddings.join(counts, "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s5_wanted_recordings",
    "WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE substr(o_orderpriority, 1, 1) END AS q FROM orders) "
    "SELECT o_custkey AS label, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM r WHERE q = '' OR q IN ('1', '2') "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4",
)
def _(t):
    """Customers play labels, orders recordings; status P has no grade."""
    q = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.substring("o_orderpriority", 1, 1))
    df = t.orders.select(F.col("o_custkey").alias("label"), F.col("o_orderkey").alias("id"), q.alias("q"))
    return M.wanted_recordings(df, "label", "q", [F.col("id")], 4, ["1", "2"]).select("label", "id", "rank")


@query(
    "s6_registry_upsert",
    "WITH l AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) "
    "SELECT user_id, count(*) AS recordings, round(sum(value), 4) AS total, max(event_id) AS newest FROM l GROUP BY user_id",
)
def _(t):
    """Registry of the first half of the month, then the second half merged in."""
    df = t.events.select("user_id", "event_type", "ts", "event_id", "value")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    merged = M.upsert_latest(df.filter(F.col("ts") < half), df.filter(F.col("ts") >= half), ["user_id", "event_type"], ["ts", "event_id"])
    return merged.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recordings"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("newest")
    )


@query(
    "s7_catalog_labels",
    f"WITH {CATALOG} SELECT species_id, scientific_name, common_name, taxon, band_high - band_low AS band_width, count(*) AS n FROM embeddings JOIN catalog ON position = label GROUP BY ALL",
)
def _(t):
    """The label number of a vector is its place in the catalogue."""
    counts = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(C.species(t.spark)), F.col("label") == F.col("position")).select(
        "species_id", "scientific_name", "common_name", "taxon", (F.col("band_high") - F.col("band_low")).alias("band_width"), "n"
    )


@query("s8_label_map", "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return C.label_map(t.events, "props").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s9_label_list",
    r"SELECT DISTINCT regexp_replace(n, '^\s+|\s+$', '', 'g') AS name FROM (SELECT unnest(regexp_split_to_array(text, '[\n,]')) AS n FROM documents) WHERE regexp_replace(n, '^\s+|\s+$', '', 'g') <> ''",
)
def _(t):
    return M.label_list(t.documents, "text")


BANK_STORE = f"WITH {FIVE_SHOT}, r1 AS (SELECT label, rn, v FROM ranked WHERE label < 6 AND rn <= 5), r2 AS (SELECT label, rn, v FROM ranked WHERE label >= 4 AND label < 9 AND rn <= 8) "


@query(
    "s10_prototype_store",
    f"WITH {UNITS}, " + centroids("bank", "units") + """, b AS (SELECT label, count(*) AS rows, sum((vec_id % 2 = 0 AND label % 3 <> 1)::INT) AS early FROM embeddings GROUP BY label)
    SELECT label, n AS n_support, i, round(x, 6) AS x, CASE WHEN early > 0 THEN '2024-01-01' ELSE '2024-02-01' END AS created, CASE WHEN rows > early THEN '2024-02-01' ELSE '2024-01-01' END AS updated
    FROM (SELECT label, n, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM bank) JOIN b USING (label) WHERE label <> 2""",
)
def _(t):
    """Save a bank of the even rows of two thirds of the labels, upsert it merged with all other rows, delete label 2: all rows of all labels are in."""
    from vecmeadow.operators.bank import fit_bank, merge_banks

    store = ST.BankStore(t.spark, scratch_table(t.spark, "bank"))
    early = F.expr("vec_id % 2 = 0 AND label % 3 <> 1")
    store.save(fit_bank(t.embeddings.filter(early)), F.lit("2024-01-01").cast("timestamp"))
    rest = fit_bank(t.embeddings.filter(~early))
    touched = store.load().join(rest.select("label"), "label", "left_semi")
    store.save(merge_banks(touched, rest), F.lit("2024-02-01").cast("timestamp"))
    store.delete([2])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    bank = store.load().withColumns({"created": day("created_at"), "updated": day("updated_at")})
    return components(bank, ["label", "n_support", "created", "updated"], "centroid")


def event_log(t: Tables, df: DataFrame) -> DataFrame:
    return ST.detections(
        df, "event_id", F.col("event_type"), F.round(F.col("value"), 4), X.content_hash(F.col("props"), 16), 10.0,
        F.col("ts").cast("timestamp"),
    )


@query(
    "s11_detection_log",
    "SELECT event_id AS source_id, event_type AS label, substr(sha256(props), 1, 16) AS content_hash, round(value, 4) AS confidence, 10.0::DOUBLE AS threshold, strftime(ts, '%Y-%m-%d') AS day FROM events",
)
def _(t):
    """Two appends into a log partitioned by day, read back."""
    path = scratch_table(t.spark, "log")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    ST.append_log(event_log(t, t.events.filter(F.col("ts") < half)), path)
    ST.append_log(event_log(t, t.events.filter(F.col("ts") >= half)), path)
    log = ST.read_log(t.spark, path)
    return log.select("source_id", "label", "content_hash", "confidence", "threshold", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    "s12_quarantine",
    f"WITH {FIVE_SHOT} SELECT vec_id, best_label AS best_match, round(score, 6) AS score FROM top WHERE NOT (score >= {THETA} AND score - second >= {MARGIN})",
)
def _(t):
    """Rejected vectors go to the quarantine table with their real best label."""
    bank, held = five_shot(t)
    d = S.classify(held, bank, THETA, MARGIN, keep_vector=True).filter(~F.col("is_known"))
    path = scratch_table(t.spark, "quarantine")
    ST.append_quarantine(d.select("vec_id", "embedding", F.col("best_label").alias("best_match"), "score"), path)
    return t.spark.read.parquet(path).select("vec_id", "best_match", F.round("score", 6).alias("score"))


@query("s13_clear_log", "SELECT count(*) AS removed, 0::BIGINT AS left_over FROM events")
def _(t):
    path = scratch_table(t.spark, "log")
    ST.append_log(event_log(t, t.events), path)
    removed = ST.clear_log(ST.read_log(t.spark, path), path)
    return ST.read_log(t.spark, path).agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(removed).cast("long").alias("removed"), "left_over")


@query("s14_report_files", FEW_SHOT)
def _(t):
    """Few-shot rows written as CSV and read back."""
    few = E.few_shot(t.embeddings, [5, 10], 3)
    root = scratch_table(t.spark, "report")
    ST.write_reports(few, few, f"{root}/json", f"{root}/csv")
    schema = "k_shots int, fold int, top1_accuracy double, n_queries long"
    back = t.spark.read.schema(schema).option("header", True).csv(f"{root}/csv")
    return back.join(t.spark.read.schema(schema).json(f"{root}/json"), ["k_shots", "fold", "top1_accuracy", "n_queries"], "left_semi")


RAW_TAXA = ["Bird", " frog ", "INSECT", "mammal", "Aves"]


@query(
    "p10_taxon_filter",
    "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (0, 4)",
)
def _(t):
    """Regions carry differently spelled taxa; two of them mean ``aves``."""
    raw = F.get(F.array(*[F.lit(x) for x in RAW_TAXA]), F.col("n_regionkey"))
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("taxon", raw)
    return C.in_taxon(df, "taxon", " BIRD").select("c_custkey", "c_name")


@query(
    "p11_resolve_names",
    "WITH d AS (SELECT p_partkey, 'part_' || p_partkey AS species_id, p_name || ' ' || p_partkey AS sci, p_brand || ' ' || p_partkey AS com FROM part) "
    "SELECT CASE WHEN l_discount >= 0.1 OR d.species_id IS NULL THEN NULL ELSE d.species_id END AS species_id, count(*) AS n, round(sum(l_quantity), 2) AS quantity "
    "FROM lineitem LEFT JOIN d ON p_partkey = l_partkey GROUP BY 1",
)
def _(t):
    """Lines name their part by id, scientific or common name; some names do not exist."""
    key = F.col("p_partkey").cast("string")
    dim = t.part.select(
        F.concat(F.lit("part_"), key).alias("species_id"), F.concat_ws(" ", "p_name", key).alias("scientific_name"),
        F.concat_ws(" ", "p_brand", key).alias("common_name"),
    )
    names = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    asked = (
        F.when(F.col("l_discount") >= 0.1, F.concat(F.lit("nobody "), key))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("part_"), key))
        .when(F.col("l_returnflag") == "N", F.upper(F.concat_ws(" ", "p_name", key)))
        .otherwise(F.concat(F.lit("  "), F.concat_ws(" ", "p_brand", key), F.lit(" ")))
    )
    found = C.resolve_names(names.select("l_quantity", asked.alias("name")), dim)
    return found.groupBy("species_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("p12_latest_of_label", "SELECT event_id, user_id, round(value, 4) AS value FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 100")
def _(t):
    rows = R.query_log(t.events, "error", 100, "event_type", [F.desc("event_id")])
    return rows.select("event_id", "user_id", F.round("value", 4).alias("value"))


@query("p13_known_flag", "SELECT event_id, lower(CASE WHEN value < 10 THEN 'Unknown' ELSE event_type END) <> 'unknown' AS is_known FROM events")
def _(t):
    label = F.when(F.col("value") < 10, "Unknown").otherwise(F.col("event_type"))
    return t.events.select("event_id", R.is_known(label).alias("is_known"))


@query(
    "p14_purge",
    "SELECT page_id, url FROM pages WHERE NOT (url LIKE '%example.net%' OR ((contains(url, '12') OR contains(url, '825')) AND split_part(url, ':', 1) <> 'https'))",
)
def _(t):
    df = t.pages.select("page_id", "url", F.split("url", ":")[0].alias("scheme"))
    return M.purge(df, "url", ["%example.net%"], ["12", "825"], "scheme", ["https"]).select("page_id", "url")


@query(
    "j3_named_detections",
    "SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 3000 THEN c_name END, s_name, 'Label ' || o_custkey) AS common_name, "
    "CASE WHEN c_acctbal > 3000 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) WHEN s_name IS NOT NULL THEN 'Aves' END AS taxon "
    "FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = o_custkey",
)
def _(t):
    """Orders are detections; customers with a balance above 3000 are stored names, suppliers the catalogue."""
    tag = lambda c: F.concat(F.lit("label_"), F.col(c).cast("string")).alias("label")
    stored = t.customer.filter("c_acctbal > 3000").select(tag("c_custkey"), F.col("c_name").alias("common_name"), F.col("c_mktsegment").alias("taxon"))
    known = t.supplier.select(tag("s_suppkey"), F.col("s_name").alias("common_name"), F.lit("aves").alias("taxon"))
    return R.named_detections(t.orders.select("o_orderkey", tag("o_custkey")), stored, known).select("o_orderkey", "common_name", "taxon")


def keyword_case(column: str) -> str:
    rules = " ".join(
        f"WHEN regexp_matches({column}, '{'|'.join(words)}') THEN '{taxon}'" for taxon, words in C.TAXON_WORDS.items()
    )
    return f"CASE {rules} ELSE 'aves' END"


WORDS = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM {t})"


@query(
    "j5_taxon_priority",
    "WITH w AS (SELECT DISTINCT label FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM documents) WHERE label <> ''), "
    "b AS (SELECT DISTINCT label FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS label FROM benchmark) WHERE label <> '') "
    f"SELECT taxon, count(*) AS n, min(label) AS first_label, max(label) AS last_label FROM (SELECT w.label, CASE WHEN b.label IS NOT NULL AND length(b.label) >= 9 THEN 'mammalia' WHEN b.label IS NOT NULL THEN 'insecta' ELSE {keyword_case('w.label')} END AS taxon "
    "FROM w LEFT JOIN b USING (label)) GROUP BY taxon",
)
def _(t):
    """Labels are all words of the documents; benchmark words are the catalogue, its long words the extra map."""
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("label")).filter("label <> ''").distinct()
    catalog = words(t.benchmark).withColumn("taxon", F.lit("insecta"))
    extra = catalog.filter(F.length("label") >= 9).withColumn("taxon", F.lit("mammalia"))
    return C.taxon_of(words(t.documents), catalog, extra).groupBy("taxon").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("first_label"), F.max("label").alias("last_label")
    )


@query("j6_not_enrolled", "SELECT DISTINCT c_custkey AS label FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def _(t):
    urgent = t.orders.filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("label"))
    return M.not_enrolled(t.customer.select(F.col("c_custkey").alias("label")), urgent)


@query(
    "j9_vocabulary_match",
    "SELECT item_id, min(doc_id) AS first_line, min(doc_id) IS NOT NULL AS in_vocabulary FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY item_id",
)
def _(t):
    """The first document that contains a benchmark passage, over whole texts."""
    found = R.vocabulary_matches(t.benchmark, t.documents, "item_id", "text", "doc_id", "text")
    return found.select("item_id", "first_line", "in_vocabulary")


@query(
    "j11_shared_ids",
    "SELECT l_partkey, count(DISTINCT l_suppkey) AS labels, min(l_suppkey) AS first_label, max(l_suppkey) AS last_label FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
)
def _(t):
    return R.shared_ids(t.lineitem, "l_partkey", "l_suppkey")


@query("j11_duplicate_content", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return R.duplicate_content(t.documents, "doc_id", X.content_hash(F.col("text")))


@query(
    "j14_fetch_plan",
    "WITH p AS (SELECT l_orderkey, sum(l_quantity) AS b FROM lineitem GROUP BY 1), d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) "
    "SELECT o_custkey AS label, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders LEFT JOIN p ON l_orderkey = o_orderkey JOIN d USING (o_custkey) "
    "WHERE NOT (coalesce(b, 0) > 100) AND n < 14 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3",
)
def _(t):
    """Orders are wanted files; their summed quantity is the size of what is there."""
    wanted = t.orders.select(F.col("o_custkey").alias("label"), F.col("o_orderkey").alias("id"))
    present = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("bytes"))
    done = wanted.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return M.fetch_plan(wanted, present, done, [F.col("id")], 3, enough=14).select("label", "id", "rank")


@query("a6_top_labels", "SELECT event_type, count(*) AS n, round(avg(value), 3) AS avg_confidence FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def _(t):
    return R.top_by_count(t.events, ["event_type"], 5, F.round(F.avg("value"), 3).alias("avg_confidence"))


@query(
    "a7_station_totals",
    f"WITH {FIVE_SHOT} SELECT (SELECT count(*) FROM events) AS detections, (SELECT count(DISTINCT label) FROM embeddings) AS labels, "
    f"(SELECT count(*) FROM top WHERE score < {THETA}) AS unidentified, (SELECT count(DISTINCT best_label) FROM top WHERE score < {THETA}) AS clusters",
)
def _(t):
    """Rejected rows are grouped by best match to stand for clusters."""
    bank, held = five_shot(t)
    rejected = S.classify(held, bank, THETA).filter(~F.col("is_known"))
    return R.station_totals(
        detections=t.events, labels=t.embeddings.select("label").distinct(), unidentified=rejected,
        clusters=rejected.select("best_label").distinct(),
    )


@query(
    "a20_status_tally",
    "SELECT l_suppkey, sum((l_returnflag = 'A')::INT)::BIGINT AS \"A\", sum((l_returnflag = 'N')::INT)::BIGINT AS \"N\", sum((l_returnflag = 'R')::INT)::BIGINT AS \"R\", count(*) AS total FROM lineitem GROUP BY l_suppkey",
)
def _(t):
    return R.status_tally(t.lineitem, ["l_suppkey"], "l_returnflag", ["A", "N", "R"])


@query(
    "a21_taxon_summary",
    f"WITH s(name, taxon) AS {values(sorted({(a, x) for a, x in C.TAXON_SYNONYMS.items() if a != 'frog'} | {(x.capitalize(), x) for x in set(C.TAXON_SYNONYMS.values())}))}, "
    "r(k, taxon) AS (VALUES (0, 'aves'), (1, 'amphibia'), (2, 'insecta'), (3, 'mammalia'), (4, 'aves')), "
    "c AS (SELECT r.taxon, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN r ON r.k = n_regionkey GROUP BY 1) "
    "SELECT name, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (taxon)",
)
def _(t):
    raw = F.get(F.array(*[F.lit(x) for x in RAW_TAXA]), F.col("n_regionkey"))
    return C.taxon_summary(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(raw.alias("taxon")))


@query(
    "a22_counts_with_total",
    "SELECT coalesce(r_name, 'Total') AS r_name, count(DISTINCT c_custkey) AS labels, count(*) AS items FROM orders JOIN customer ON c_custkey = o_custkey "
    "JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name)",
)
def _(t):
    df = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return R.counts_with_total(df, "r_name", F.col("c_custkey"), F.lit(1).cast("long"))


@query(
    "a23_pivot_mean",
    'SELECT l_linenumber, round(avg(l_discount) FILTER (WHERE l_returnflag = \'A\'), 4) AS "A", round(avg(l_discount) FILTER (WHERE l_returnflag = \'N\'), 4) AS "N", '
    'round(avg(l_discount) FILTER (WHERE l_returnflag = \'R\'), 4) AS "R", round(avg(l_discount) FILTER (WHERE l_returnflag = \'X\'), 4) AS "X" FROM lineitem GROUP BY l_linenumber',
)
def _(t):
    """Mean discount per line number and return flag; a flag without rows is null."""
    return R.pivot_mean(t.lineitem, "l_linenumber", "l_returnflag", ["A", "N", "R", "X"], "l_discount")


@query(
    "a26_under_represented",
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 10",
)
def _(t):
    return M.under_represented(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", 10)


@query("l1_latest", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def _(t):
    return R.query_log(t.events, None, 50, "event_type", [F.desc("event_id")]).select("event_id", "event_type")


@query("l2_label_listing", "SELECT c_name, c_mktsegment FROM customer ORDER BY c_name")
def _(t):
    return t.customer.select("c_name", "c_mktsegment").orderBy("c_name")


@query("l4_most_frequent", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 8")
def _(t):
    return R.top_by_count(t.orders, ["o_custkey"], 8)


@query(
    "u1_union_files",
    "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages",
)
def _(t):
    return M.union_files(
        t.documents.select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")),
        t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind")),
    ).orderBy("kind", "id")


@query(
    "u2_first_links",
    "WITH l AS (SELECT page_id, unnest(m) AS link, generate_subscripts(m, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS m FROM pages)), "
    "d AS (SELECT page_id, link, min(pos) AS pos FROM l GROUP BY ALL) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, link FROM d "
    "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 10",
)
def _(t):
    """The first ten different links of each page."""
    ids = M.found_ids(F.col("html"), 'href="([^"]+)"', 10)
    return t.pages.select("page_id", F.posexplode(ids).alias("p", "link")).select("page_id", (F.col("p") + 1).cast("long").alias("place"), "link")


@query("u2_first_values", "SELECT l_suppkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_suppkey ORDER BY 2, 1 LIMIT 15")
def _(t):
    return M.first_distinct(t.lineitem, "l_suppkey", "l_orderkey", 15)


@query("u3_difference", "SELECT c_custkey AS label FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    enrolled = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("label"))
    return M.not_enrolled(t.customer.select(F.col("c_custkey").alias("label")), enrolled)


@query(
    "u4_top_up",
    "WITH s AS (SELECT DISTINCT user_id, event_type || '-' || floor(value / 50)::BIGINT AS name FROM events WHERE value > 60), "
    "r AS (SELECT DISTINCT user_id, event_type || '-' || floor(value / 50)::BIGINT AS name FROM events), "
    "h AS (SELECT user_id, count(*) AS have FROM s GROUP BY 1), "
    "f AS (SELECT r.*, coalesce(have, 0) AS have, row_number() OVER (PARTITION BY user_id ORDER BY name) AS rn FROM r LEFT JOIN h USING (user_id) WHERE (user_id, name) NOT IN (FROM s)) "
    "SELECT user_id, name, 'strict' AS pass FROM s UNION ALL SELECT user_id, name, 'relaxed' FROM f WHERE have < 8 AND rn <= 8 - have",
)
def _(t):
    """Strict pass: events above 60. Relaxed pass: any event, for users with fewer than eight names."""
    name = F.concat_ws("-", "event_type", F.floor(F.col("value") / 50).cast("string"))
    relaxed = t.events.select("user_id", "value", name.alias("name"))
    strict = relaxed.filter("value > 60").select("user_id", "name").distinct()
    return M.top_up(strict, relaxed.select("user_id", "name").distinct(), "user_id", "name", 8)


@query("u5_shared_labels", "SELECT o_custkey AS label FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(t):
    return M.shared_labels(
        t.orders.select(F.col("o_custkey").alias("label")), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("label"))
    )
