"""Queries over records: sources and sinks, scalar helpers, joins, aggregates, windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..operators import resolve
from ..sources.records import (
    APPLICANTS_SQL, CONTACTS_SQL, FILES_SQL, ITEMS_SQL, REGISTRY_SQL, applicants, contacts, files, items, registry,
)
from ..sources.tables import table
from .registry import Catalog, quoted

CATALOG = Catalog()
query = CATALOG.query

# ---------------------------------------------------------------- sources


@query("SELECT doc_id, text FROM documents WHERE length(text) > 0")
def s01_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").filter(F.length("text") > 0)


@query(f"WITH {APPLICANTS_SQL} SELECT applicant_id, contact_id, account_id FROM applicants WHERE applicant_id = 42 LIMIT 1")
def s05_record_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).filter("applicant_id = 42").select("applicant_id", "contact_id", "account_id").limit(1)


@query(f"WITH {FILES_SQL} SELECT applicant_id, file_no, created_at, CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY created_at DESC, file_no) AS INTEGER) AS place FROM files WHERE storage = 'file'")
def s06_links_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("applicant_id").orderBy(F.desc("created_at"), "file_no")
    return files(spark, sf_dir).filter("storage = 'file'").select("applicant_id", "file_no", "created_at", F.row_number().over(w).alias("place"))


@query(
    f"""WITH {APPLICANTS_SQL}, {FILES_SQL} SELECT f.applicant_id, f.file_no, f.name FROM files f WHERE f.file_no = 1
AND EXISTS (SELECT 1 FROM applicants a WHERE a.applicant_id = f.applicant_id AND a.status = 'O')"""
)
def s07_j05_versions_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = applicants(spark, sf_dir).filter("status = 'O'").select("applicant_id")
    return files(spark, sf_dir).filter("file_no = 1").join(some, "applicant_id", "left_semi").select("applicant_id", "file_no", "name")


@query(f"WITH {FILES_SQL} SELECT applicant_id, file_no, name, created_at FROM files WHERE storage = 'attachment'")
def s08_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("storage = 'attachment'").select("applicant_id", "file_no", "name", "created_at")


@query(
    """WITH marks AS (SELECT s_nationkey AS account, max(s_suppkey) AS mark FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey), everyone AS (SELECT max(s_suppkey) AS mark FROM supplier)
SELECT n_nationkey AS account, coalesce(m.mark, e.mark) AS mark, CASE WHEN m.mark IS NULL THEN 'global' ELSE 'account' END AS scope FROM nation LEFT JOIN marks m ON m.account = n_nationkey, everyone e"""
)
def s09_watermark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest mark of an account, else the newest of all (one row, joined as a scalar)."""
    marks = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    own = marks.filter("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("account")).agg(F.max("s_suppkey").alias("own"))
    everyone = marks.agg(F.max("s_suppkey").alias("mark")).first()["mark"]
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("account")).join(own, "account", "left")
    return rows.select("account", F.coalesce("own", F.lit(everyone)).alias("mark"), F.when(F.col("own").isNull(), "global").otherwise("account").alias("scope"))


@query(
    f"""WITH {APPLICANTS_SQL}, {CONTACTS_SQL} SELECT a.applicant_id, a.name, c.name AS contact_name, a.created_at FROM applicants a JOIN contacts c ON c.contact_id = a.contact_id
WHERE a.status = 'O' ORDER BY a.created_at DESC, a.applicant_id LIMIT 200"""
)
def s10_w03_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir).filter("status = 'O' and contact_id is not null")
    met = rows.join(contacts(spark, sf_dir).select("contact_id", F.col("name").alias("contact_name")), "contact_id")
    return met.orderBy(F.desc("created_at"), "applicant_id").limit(200).select("applicant_id", "name", "contact_name", "created_at")


@query(f"WITH {APPLICANTS_SQL} SELECT applicant_id, name FROM applicants WHERE applicant_id IN (1, 5, 8, 13, 21, 34)")
def s11_by_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).filter(F.col("applicant_id").isin(1, 5, 8, 13, 21, 34)).select("applicant_id", "name")


@query(f"WITH {REGISTRY_SQL} SELECT client_key, client_id FROM db_orgs")
def s12_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir)[1]


_UPSERT = f"""WITH {REGISTRY_SQL}, cur AS (SELECT client_key, client_id, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at FROM db_orgs)
SELECT coalesce(c.client_key, e.client_key) AS client_key, coalesce(e.client_id, c.client_id) AS client_id, coalesce(c.created_at, TIMESTAMP '2024-06-01') AS created_at,
  CASE WHEN e.client_key IS NULL THEN c.updated_at ELSE TIMESTAMP '2024-06-01' END AS updated_at FROM cur c FULL JOIN env_orgs e ON e.client_key = c.client_key"""


@query(_UPSERT)
def s13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    env, db = registry(spark, sf_dir)
    first, now = F.lit(dt.datetime(2024, 1, 1)), F.lit(dt.datetime(2024, 6, 1))
    return resolve.upsert(db.withColumn("created_at", first).withColumn("updated_at", first), env, "client_key", now)


@query(f"WITH {REGISTRY_SQL} SELECT e.client_key, d.client_key IS NOT NULL AS existed FROM env_orgs e LEFT JOIN db_orgs d ON d.client_key = e.client_key")
def s14_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    env, db = registry(spark, sf_dir)
    return resolve.delete(db, env.select("client_key"), "client_key")[1]


@query(
    """SELECT lower(n_name) AS client_key, CASE WHEN n_nationkey % 4 = 0 THEN 'missing client_secret' ELSE NULL END AS error FROM nation"""
)
def s16_parse_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    entry = F.struct(F.lit("i").alias("client_id"), F.when(F.col("n_nationkey") % 4 != 0, "s").alias("client_secret"), F.lit("t").alias("token_url"), F.lit("u").alias("instance_url"))
    raw = nation.select(F.to_json(F.create_map(F.lower("n_name"), entry)).alias("json"))
    return resolve.parse_registry(raw).select("client_key", "error")


@query("SELECT doc_id, text = text AS same FROM documents WHERE text IS NOT NULL")
def s20_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", (F.try_to_binary(coded, F.lit("base64")).cast("string") == F.col("text")).alias("same"))


# ---------------------------------------------------------------- scalars


@query(
    """SELECT c_custkey, trim(regexp_replace('  ' || c_name || chr(10) || c_mktsegment || ' ', '\\s+', ' ', 'g')) AS shown, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS first_filled,
  c_custkey % 2 = 0 AS enough FROM customer"""
)
def f01_f02_f06_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.clean_text(F.concat(F.lit("  "), name, F.lit("\n"), seg, F.lit(" "))).alias("shown"),
        scalars.first_filled(F.when(seg == "BUILDING", "  ").otherwise(seg), name).alias("first_filled"),
        scalars.has_enough(F.when(F.col("c_custkey") % 2 == 0, name), F.lit(" ")).alias("enough"),
    )


@query(
    """WITH s AS (SELECT p_partkey, string_split_regex(p_name || ';' || upper(p_type) || ', ' || p_type || '|' || p_brand || chr(10) || p_name, '[;,|\\n\\r•]+') AS parts FROM part),
u AS (SELECT p_partkey, trim(unnest(parts)) AS part, generate_subscripts(parts, 1) AS n FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(part) ORDER BY n) AS k FROM u WHERE part <> '')
SELECT p_partkey, string_agg(part, '/' ORDER BY n) AS listed FROM r WHERE k = 1 GROUP BY p_partkey"""
)
def f03_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(";"), F.upper("p_type"), F.lit(", "), "p_type", F.lit("|"), "p_brand", F.lit("\n"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.split_list(raw), "/").alias("listed"))


@query(
    """SELECT p_partkey, CASE WHEN p_size = 1 THEN '1 year' ELSE CAST(p_size AS VARCHAR) || ' years' END AS years, 'about ' || CAST(p_size AS VARCHAR) AS worded FROM part"""
)
def f04_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.years(size).alias("years"), scalars.years(F.concat(F.lit("about "), size)).alias("worded"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y') AS shown FROM orders")
def f05_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", scalars.long_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("shown"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) = lower(p_brand) THEN '' ELSE p_brand END AS other FROM part")
def f07_other_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = scalars.split_list(F.concat("p_type", F.lit(";"), "p_name"))
    other = scalars.split_list(F.concat(F.upper("p_type"), F.lit(","), "p_brand", F.lit(","), F.upper("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.other_than(other, own), "/").alias("other"))


@query(
    """SELECT p_partkey, p_type || ' with ' || CAST(p_size AS VARCHAR) || CASE WHEN p_size = 1 THEN ' year' ELSE ' years' END || ' of experience, currently working at ' || p_brand || '. Core skills include ' || p_name || '. Holds X.' AS summary FROM part"""
)
def f08_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scalars.summary(F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string"), F.array("p_name"), F.lit("X."))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("summary"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, 'url: ' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS line FROM pages")
def f09_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.escape_html(F.col("html")).alias("escaped"), scalars.details_line([("none", F.lit("")), ("url", F.col("url"))]).alias("line"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'login' WHEN 'MACHINERY' THEN 'test' ELSE c_mktsegment END AS domain FROM customer")
def f10_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.login_domain(F.when(seg == "BUILDING", " Prod ").when(seg == "MACHINERY", "SANDBOX").otherwise(seg)).alias("domain"))


@query(f"WITH {FILES_SQL} SELECT applicant_id, file_no, starts_with(lower(name), 'masked_') AS own, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM files")
def f11_f12_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("applicant_id", "file_no", scalars.is_masked_output(F.col("name")).alias("own"), scalars.extension(F.col("name")).alias("ext"))


@query(f"WITH {APPLICANTS_SQL} SELECT applicant_id, CASE WHEN applicant_id % 2 = 0 THEN name ELSE 'JA-' || right(CAST(applicant_id AS VARCHAR), 6) END AS shown, 'JD' AS initials FROM applicants")
def f13_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("applicant_id") % 2 == 0, F.col("name")).otherwise("John  doe smith")
    return applicants(spark, sf_dir).select("applicant_id", scalars.display_name(name, F.col("applicant_id")).alias("shown"), scalars.initials(F.lit("John  doe smith")).alias("initials"))


@query(f"WITH {APPLICANTS_SQL} SELECT applicant_id, 'https://example.com/lightning/r/ContentDocument/' || CAST(account_id AS VARCHAR) || '/view' AS link FROM applicants")
def f14_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return applicants(spark, sf_dir).select("applicant_id", scalars.deep_link(F.lit("example.com"), F.col("account_id").cast("string")).alias("link"))


@query(f"WITH {ITEMS_SQL} SELECT item_id, event_type = 'error' AND item_id % 4 <> 1 AS transient, CAST(1.5 * (item_id % 3 + 1) AS DOUBLE) AS wait, substr(message, 1, 12) AS detail FROM items")
def f15_f16_f19_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", scalars.is_transient(F.col("message"), F.when(F.col("item_id") % 4 == 1, "missing_file")).alias("transient"), scalars.backoff_seconds(F.col("item_id") % 3 + 1).cast("double").alias("wait"), scalars.truncated(F.col("message"), 12).alias("detail"))


@query("SELECT s_suppkey, s_name AS opened, CAST(NULL AS VARCHAR) AS wrong FROM supplier")
def f17_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    sealed = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumn("sealed", scalars.seal(F.col("s_name"), key))
    return sealed.select("s_suppkey", scalars.unseal(F.col("sealed"), key).alias("opened"), scalars.unseal(F.col("sealed"), other).alias("wrong"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def f18_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return rows.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("json"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.85 THEN 0.16 ELSE least(0.34, 0.16 / greatest(0.30, l_discount * 10)) END AS opacity,
  (600 - w) / 2 AS x0, (800 - h) / 2 AS y0, (600 + w) / 2 AS x1, (800 + h) / 2 AS y1
FROM (SELECT *, 168.0 * least(1.0, (800 / 3.0) / (168.0 * l_quantity / 10)) AS w, 168.0 * l_quantity / 10 * least(1.0, (800 / 3.0) / (168.0 * l_quantity / 10)) AS h FROM lineitem)"""
)
def f20_f21_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    box = scalars.watermark_box(F.lit(600.0), F.lit(800.0), F.lit(10.0), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", scalars.opacity(F.col("l_discount") * 10).alias("opacity"), box.alias("b")).select("l_orderkey", "l_linenumber", "opacity", "b.*")


@query("SELECT p_partkey, greatest(8, least(36, 2 * CAST(floor(180.0 / p_size) AS INTEGER))) AS size FROM part")
def f22_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", scalars.fitted_font(F.col("p_size").cast("double"), F.lit(600.0)).alias("size"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS folded FROM documents")
def f24_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scalars.latin1(F.col("text")).alias("folded"))


@query(f"WITH {CONTACTS_SQL} SELECT contact_id, coalesce(mobile, segment) AS watermark, left(name, 12) AS revision FROM contacts")
def f25_f26_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.coalesce("mobile", F.lit(""))
    return contacts(spark, sf_dir).select("contact_id", scalars.item_override(own, F.col("segment")).alias("watermark"), scalars.build_revision(F.lit(""), F.col("name")).alias("revision"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'client_credentials' WHEN c_custkey % 5 = 0 THEN 'override_password' WHEN c_custkey % 7 = 0 THEN 'env_client_credentials'
  WHEN c_custkey % 11 = 0 THEN 'env_password' ELSE 'error:not_configured' END AS mode FROM customer"""
)
def f27_f28_sign_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = scalars.auth_mode(F.when(k % 2 == 0, "acme"), k % 3 == 0, F.when(k % 5 == 0, "password"), F.when(k % 7 == 0, "key"), F.when(k % 11 == 0, "user"))
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", mode.alias("mode"))


@query("SELECT page_id, CASE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) WHEN 'tionsh.example.net' THEN 'live' ELSE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) END AS host FROM pages")
def f30_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", scalars.host_choice(F.col("url"), {"tionsh.example.net": "live"}).alias("host"))


# ---------------------------------------------------------------- joins


@query(f"WITH {APPLICANTS_SQL}, {CONTACTS_SQL} SELECT a.applicant_id, a.account_id, s_name AS account, c.name AS contact_name FROM applicants a LEFT JOIN supplier ON s_suppkey = a.account_id LEFT JOIN contacts c ON c.contact_id = a.contact_id")
def j01_j02_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.with_contact(applicants(spark, sf_dir), contacts(spark, sf_dir).select("contact_id", "name"))
    accounts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("account"))
    return rows.join(accounts, "account_id", "left").select("applicant_id", "account_id", "account", "contact_name")


@query(
    f"""WITH {CONTACTS_SQL}, v AS (SELECT contact_id, 0 AS k, phone AS value FROM contacts UNION ALL SELECT contact_id, 1, mobile FROM contacts UNION ALL SELECT contact_id, 2, email FROM contacts),
d AS (SELECT contact_id, value, min(k) AS k FROM v WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY 1, 2)
SELECT contact_id, CAST(row_number() OVER (PARTITION BY contact_id ORDER BY k) - 1 AS INTEGER) AS ord, value FROM d"""
)
def j03_contact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.contact_values(contacts(spark, sf_dir), ["phone", "mobile", "email"])


@query(f"WITH {APPLICANTS_SQL}, {CONTACTS_SQL} SELECT a.applicant_id, trim(c.phone) AS phone, c.email FROM applicants a JOIN contacts c ON c.contact_id = a.contact_id WHERE trim(c.email) <> ''")
def j04_values_of_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = applicants(spark, sf_dir).filter("contact_id is not null").select("applicant_id", "contact_id").join(contacts(spark, sf_dir).filter("trim(email) <> ''"), "contact_id")
    return met.select("applicant_id", F.trim("phone").alias("phone"), "email")


_RANK = "CASE lower(regexp_extract(name, '\\.([^.]*)$', 1)) WHEN 'pdf' THEN 0 WHEN 'docx' THEN 1 WHEN 'doc' THEN 2 END"
_PLACE = "CASE WHEN storage = 'file' AND parent = 'applicant' THEN 0 WHEN storage = 'file' THEN 1 WHEN parent = 'applicant' THEN 2 ELSE 3 END"


@query(
    f"""WITH {FILES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY applicant_id ORDER BY {_PLACE}, {_RANK}, created_at DESC, file_no) AS k FROM files
  WHERE NOT starts_with(lower(name), 'masked_') AND {_RANK} IS NOT NULL) SELECT applicant_id, file_no, name, CAST({_PLACE} AS INTEGER) AS place FROM r WHERE k = 1"""
)
def j06_w01_best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.best_file(files(spark, sf_dir)).select("applicant_id", "file_no", "name", "place")


@query(
    f"""WITH {APPLICANTS_SQL}, {FILES_SQL}, s AS (SELECT applicant_id, count(*) FILTER (WHERE NOT starts_with(lower(name), 'masked_')) AS others, count(*) FILTER (WHERE NOT starts_with(lower(name), 'masked_') AND {_RANK} IS NOT NULL) AS usable FROM files GROUP BY 1)
SELECT a.applicant_id, CASE WHEN usable > 0 THEN 'found' WHEN others > 0 THEN 'unusable' ELSE 'missing' END AS outcome FROM applicants a LEFT JOIN s ON s.applicant_id = a.applicant_id"""
)
def j07_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.file_outcome(applicants(spark, sf_dir), files(spark, sf_dir))


@query(
    f"""WITH {APPLICANTS_SQL} SELECT applicant_id, CASE WHEN applicant_id % 3 = 0 THEN 'request' WHEN s_name IS NOT NULL THEN 'account' WHEN applicant_id % 5 = 0 THEN 'global' WHEN applicant_id % 7 = 0 THEN 'text' ELSE 'none' END AS source
FROM applicants LEFT JOIN supplier ON s_suppkey = account_id"""
)
def j08_watermark_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("own"))
    k = F.col("applicant_id")
    rows = applicants(spark, sf_dir).join(accounts, "account_id", "left")
    choice = resolve.watermark_choice(F.when(k % 3 == 0, "inline"), F.col("own"), F.when(k % 5 == 0, "all"), F.when(k % 7 == 0, "text"))
    return rows.select("applicant_id", choice["source"].alias("source"))


@query(f"WITH {REGISTRY_SQL} SELECT coalesce(d.client_key, e.client_key) AS client_key, coalesce(d.client_id, e.client_id) AS client_id, CASE WHEN d.client_key IS NULL THEN 'env' ELSE 'db' END AS source FROM env_orgs e FULL JOIN db_orgs d ON d.client_key = e.client_key")
def j12_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merged_registry(*registry(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT client_key FROM env_orgs WHERE client_key NOT IN (SELECT client_key FROM db_orgs)")
def j13_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    env, db = registry(spark, sf_dir)
    return env.select("client_key").join(db, "client_key", "left_anti")


@query(f"WITH {CONTACTS_SQL} SELECT contact_id, phone, email FROM contacts")
def j14_known_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir)
    return rows.select(*resolve.fields_of(rows, ["contact_id", "phone", "fax", "email", "pager"]))


@query(
    f"""WITH {APPLICANTS_SQL} SELECT applicant_id // 25 AS selection, count(DISTINCT account_id) AS n_accounts, CASE WHEN count(DISTINCT account_id) = 1 THEN min(account_id) END AS primary_account
FROM applicants GROUP BY 1"""
)
def j15_accounts_of_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = applicants(spark, sf_dir).groupBy(F.floor(F.col("applicant_id") / 25).alias("selection"))
    return rows.agg(F.count_distinct("account_id").alias("n_accounts"), F.when(F.count_distinct("account_id") == 1, F.min("account_id")).alias("primary_account"))


@query("SELECT n_nationkey AS account, CASE WHEN s.n > 0 THEN 'account' ELSE 'global' END AS scope, CAST(coalesce(s.bytes, 0) AS BIGINT) AS bytes FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, sum(strlen(s_name)) AS bytes FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def j17_watermark_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("account")).agg(F.sum(F.octet_length("s_name")).alias("own"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("account")).join(own, "account", "left")
    return rows.select("account", F.when(F.col("own").isNotNull(), "account").otherwise("global").alias("scope"), F.coalesce("own", F.lit(0)).alias("bytes"))


@query(f"WITH {REGISTRY_SQL} SELECT lower(n_name) AS client_key, d.client_id, CASE WHEN d.client_key IS NULL THEN 'unknown key' END AS error FROM nation LEFT JOIN db_orgs d ON d.client_key = lower(n_name)")
def j18_j19_registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, db = registry(spark, sf_dir)
    key = F.lit("0123456789abcdef")
    stored = db.withColumn("client_id", scalars.seal(F.col("client_id"), key))
    opened = stored.withColumn("client_id", scalars.unseal(F.col("client_id"), key)).filter("client_id is not null")
    asked = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("client_key"))
    return asked.join(opened, "client_key", "left").select("client_key", "client_id", F.when(F.col("client_id").isNull(), "unknown key").alias("error"))


@query(f"WITH {APPLICANTS_SQL}, {ITEMS_SQL} SELECT a.applicant_id, coalesce(i.status, 'error') AS status, coalesce(i.event_type, 'no answer') AS detail FROM applicants a LEFT JOIN items i ON i.item_id = a.applicant_id")
def j20_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = items(spark, sf_dir).select(F.col("item_id").alias("applicant_id"), "status", F.col("event_type").alias("detail"))
    return resolve.fan_out(applicants(spark, sf_dir).select("applicant_id"), answers, "applicant_id")


@query(f"WITH {APPLICANTS_SQL} SELECT applicant_id, CASE WHEN status = 'F' THEN CAST(applicant_id AS VARCHAR) ELSE name END AS shown, CASE WHEN status = 'O' THEN 'https://example.com/' || CAST(applicant_id AS VARCHAR) END AS link FROM applicants")
def j21_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("applicant_id").cast("string")
    name = F.when(F.col("status") != "F", F.col("name"))
    return applicants(spark, sf_dir).select("applicant_id", F.coalesce(name, key).alias("shown"), F.when(F.col("status") == "O", F.concat(F.lit("https://example.com/"), key)).alias("link"))


# ---------------------------------------------------------------- aggregates and windows


@query("SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY 1, 2")
def a01_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))


@query(
    f"""WITH {CONTACTS_SQL}, u AS (SELECT contact_id, phone AS v, 0 AS k FROM contacts UNION ALL SELECT contact_id, mobile, 1 FROM contacts), d AS (SELECT contact_id, v, min(k) AS k FROM u WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT contact_id, string_agg(v, '|' ORDER BY k) AS vals, CASE WHEN contact_id % 2 = 0 THEN 'given' ELSE 'detected' END AS used FROM d GROUP BY contact_id"""
)
def a02_a03_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array_distinct(F.filter(F.array("phone", "mobile"), lambda v: v.isNotNull()))
    given = F.when(F.col("contact_id") % 2 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>"))
    used = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("detected")))
    return contacts(spark, sf_dir).filter(F.size(both) > 0).select("contact_id", F.array_join(both, "|").alias("vals"), used[0].alias("used"))


@query(f"WITH {ITEMS_SQL} SELECT job_id, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status <> 'ok') AS failed, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS results FROM items GROUP BY job_id")
def a06_batch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return items(spark, sf_dir).groupBy("job_id").agg(F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), ids.alias("results"))


@query(
    f"""WITH {ITEMS_SQL}, j AS (SELECT job_id, count(*) + job_id % 3 AS total, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status <> 'ok') AS failed FROM items GROUP BY job_id)
SELECT job_id, total, succeeded, failed, greatest(0, total - succeeded - failed) AS pending, CASE WHEN succeeded + failed >= total THEN 'done' ELSE 'running' END AS state FROM j"""
)
def a07_q04_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).groupBy("job_id").agg((F.count(F.lit(1)) + F.col("job_id") % 3).alias("total"), F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"))
    over = F.col("succeeded") + F.col("failed")
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("total") - over)).withColumn("state", F.when(over >= F.col("total"), "done").otherwise("running"))


@query("SELECT count(*) AS queued, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15') AS leased FROM events")
def a08_queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "ts").agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("ts") > F.lit(dt.datetime(2024, 1, 15))).alias("leased"))


@query(f"WITH {CONTACTS_SQL}, v AS (SELECT 'phone' AS field, phone AS value FROM contacts UNION ALL SELECT 'email', email FROM contacts UNION ALL SELECT 'mobile', mobile FROM contacts) SELECT field, CASE WHEN regexp_matches(trim(value), {quoted('^' + fixed.EMAIL + chr(92) + 'z')}) THEN 'email' WHEN regexp_matches(trim(value), {quoted(fixed.PHONE_STRING)}) AND length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 THEN 'phone' ELSE 'name' END AS kind, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2")
def a09_kinds_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.phones import classify

    rows = contacts(spark, sf_dir).unpivot("contact_id", ["phone", "email", "mobile"], "field", "value").filter("value is not null")
    return rows.groupBy("field", classify(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, avg(l_quantity) / 255 AS tone, max(l_extendedprice) / 60000 >= 0.3 AND count(*) < 3 AS needs_ocr, count(*) FILTER (WHERE l_returnflag = 'R') AS needed, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS done FROM lineitem GROUP BY l_orderkey")
def a11_a12_a13_page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").groupBy("l_orderkey")
    needed = F.col("l_returnflag") == "R"
    return rows.agg(
        (F.avg("l_quantity") / 255).alias("tone"), ((F.max("l_extendedprice") / 60000 >= fixed.OCR_IMAGE_SHARE) & (F.count(F.lit(1)) < 3)).alias("needs_ocr"),
        F.count_if(needed).alias("needed"), F.count_if(needed & (F.col("l_linestatus") == "F")).alias("done"),
    )


@query("SELECT c_nationkey, max_by(c_custkey, c_acctbal) AS latest FROM customer GROUP BY c_nationkey")
def w02_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_acctbal").alias("latest"))


@query(
    f"""WITH {ITEMS_SQL}, r AS (SELECT job_id, item_id, row_number() OVER (PARTITION BY job_id ORDER BY item_id) - 1 AS k FROM items)
SELECT job_id, CAST(k AS INTEGER) AS place, CAST(k // 5 AS BIGINT) AS chunk, item_id FROM r"""
)
def w09_w10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("job_id").orderBy("item_id")) - 1
    return items(spark, sf_dir).select("job_id", "item_id", k.alias("place")).withColumn("chunk", F.floor(F.col("place") / 5))
